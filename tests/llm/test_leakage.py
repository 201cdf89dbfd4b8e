import random

from lexgrain.llm.leakage import leaks


def test_against_brute_force(spark):
    rng = random.Random(9)
    v = [f"m{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(20, 50)))) for i in range(20)]
    docs = []
    for i in range(150):
        w = [rng.choice(v) for _ in range(80)]
        if i % 3 == 0:
            t = items[rng.randrange(20)][1].split()
            n = rng.randint(10, len(t))
            a = rng.randrange(len(t) - n + 1)
            p = rng.randrange(60)
            w[p : p + n] = t[a : a + n]
        docs.append((i, " ".join(w)))
    want = set()
    for i, t in docs:
        w = t.split()
        have = {tuple(w[k : k + 18]) for k in range(len(w) - 17)}
        for j, u in items:
            x = u.split()
            if any(tuple(x[k : k + 18]) in have for k in range(len(x) - 17)):
                want.add((i, j))
    got = leaks(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame(items, "i long, text string"), "i", "text")
    assert {(r[0], r[1]) for r in got.where("match = 'exact' and run_words >= 18").collect()} == want and want


def test_edges(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    docs = spark.createDataFrame([(1, "Début. " + t.upper() + " fin", 0), (2, None, 0), (3, "", 0), (None, t, 0), (4, " ".join(t.split()[:9] + ["x"] + t.split()[10:]), 0), (5, " ".join(t.split()[7:]), 0)], "d long, text string, item int")
    items = spark.createDataFrame([(7, t), (7, t), (8, None), (9, ""), (None, t), (10, "un deux"), (11, "theta iota kappa lambda")], "i long, text string")
    got = {(r[0], r[1]): (r["match"], r["run_words"], r["doc_place"], r["item_place"]) for r in leaks(docs, "d", "text", items, "i", "text").collect()}
    assert got[(1, 7)] == ("exact", 19, 1, 0)
    assert got[(4, 7)][0] == "proximity"
    assert {i for i, j in got if j == 11} == {1, 5}  # an item of few words, whole
    assert {k for k in got if k[1] != 11} == {(1, 7), (4, 7)}
    assert leaks(docs.limit(0), "d", "text", items, "i", "text").count() == 0
    assert leaks(docs, "d", "text", items.limit(0), "i", "text").count() == 0


def test_proximity_recall(spark):
    """Passages of 24 words with one word in twelve changed, nothing more: nearly all are told by proximity."""
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(24))) for i in range(60)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in (6, 17):
            w[k] = "autre"
        docs.append((i, " ".join(f"x{rng.randrange(5000)}" for _ in range(40)) + " " + " ".join(w)))
    got = leaks(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame(items, "i long, text string"), "i", "text")
    hit = {(r["d"], r["i"]) for r in got.where("match = 'proximity'").collect()}
    assert hit <= {(i, i) for i, _ in items} and len(hit) >= 0.95 * len(items)


def test_looping_text_and_hot_terms(spark):
    """One item made of the corpus's commonest words, in a text that loops it hundreds of times."""
    t = " ".join(f"c{k}" for k in range(20))
    docs = [(0, (t + " ") * 300)] + [(i, f"debut {i} " + t) for i in range(1, 400)] + [(1000 + i, f"rien de commun {i}") for i in range(50)]
    got = leaks(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame([(1, t)], "i long, text string"), "i", "text")
    assert {(r["d"], r["match"], r["run_words"]) for r in got.collect()} == {(i, "exact", 20) for i in range(400)}


def test_no_broadcast_grows_with_the_corpus(spark):
    """Documents that meet test texts are joined to their texts by a shuffle, few as they are: their pairs would pass through the driver."""
    t = " ".join(f"c{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"debut {i} " + t) for i in range(300)] + [(1000 + i, f"rien de commun {i}") for i in range(50)], "d long, text string")
    got = leaks(docs, "d", "text", spark.createDataFrame([(1, t)], "i long, text string"), "i", "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [doc" in plan and "BroadcastExchange" not in plan
    assert {r["d"] for r in got.collect()} == set(range(300))
