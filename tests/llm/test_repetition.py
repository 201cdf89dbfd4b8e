import numpy as np

from lexgrain.functions.words import WordIds, words
from lexgrain.llm.repetition import IsolationForest, repetition, statistics


def test_share_by_definition():
    text = "a b c d e f g h " * 3 + "fin"
    w = words(text)
    r = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    assert abs(statistics(text, WordIds(), 5)[1][0] - (1 - len(set(r)) / len(r))) < 1e-12
    assert statistics(None, WordIds(), 5)[0] == 0 and statistics("a b", WordIds(), 5)[1][0] == 0


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.02, (500, 3)), rng.normal(1, 0.05, (10, 3))])
    s = IsolationForest(x).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.99)


def test_found_and_edges(spark):
    plain = [(i, " ".join(f"mot{i}x{k}" for k in range(40)), 1) for i in range(80)]
    loops = [(1000 + i, ("encore la même phrase ici " * 9) + f"fin {i}", 1) for i in range(8)]
    odd = [(2000, None, 1), (2001, "", 1), (2002, "un deux", 1), (None, "x " * 50, 1), (0, plain[0][1], 2), (2003, "mot " * 20_000, 1)]
    df = spark.createDataFrame(plain + loops + odd, "d long, text string, score int")
    got = repetition(df, "d", "text").toPandas()
    assert got.d.is_unique and set(got.d) == {r[0] for r in plain + loops + odd if r[0] is not None}
    hit = set(got[got.anomalous & (got.words >= 5) & (got.repeated_share >= 0.3)].d)
    assert hit == {1000 + i for i in range(8)} | {2003}
    labelled = spark.createDataFrame([(1000, True), (0, False)], "d long, repetitive boolean")
    assert repetition(df, "d", "text", labelled).where("anomalous").count() >= 1
    assert repetition(df.limit(0), "d", "text").count() == 0
