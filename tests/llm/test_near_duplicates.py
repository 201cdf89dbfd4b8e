import random

from lexgrain.functions.words import words
from lexgrain.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs, p4_found


def runs3(text):
    w = words(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_against_brute_force(spark, rows_of):
    rng = random.Random(5)
    vocabulary = [f"mot{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(base))
        for edits in (1, 4, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    ids = [f"c{i:04d}" for i in range(len(texts))]
    want = set()
    sets = [runs3(t) for t in texts]
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                want.add((ids[i], ids[j]))
    df = spark.createDataFrame(list(zip(ids, texts)), "id string, content string")
    got = {(r[0], r[1]) for r in near_duplicate_pairs(df, "id", n=3, similarity=0.5, measure="jaccard").collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_family_of_a_third(spark):
    """Pairs of a large family share runs of little weight and differ in heavy ones: plain 0.52, weighted about 0.34."""
    rng = random.Random(9)
    template = " ".join(f"gabarit{i}" for i in range(62))
    texts = [template + " " + " ".join(f"propre{k}x{i}" for i in range(28)) for k in range(60)]
    texts += [" ".join(f"mot{rng.randrange(10_000)}" for _ in range(80)) for _ in range(120)]
    sets = [runs3(t) for t in texts]
    want = {(f"c{i:03d}", f"c{j:03d}") for i in range(180) for j in range(i + 1, 180) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert len(want) == 60 * 59 // 2
    df = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "id string, content string")
    got = {(r[0], r[1]) for r in near_duplicate_pairs(df, "id", n=3, similarity=0.5, measure="jaccard").collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_looping_text(spark):
    """Equal sets of runs with unlike counts: the Jaccard of the distinct runs is 1."""
    data = []
    for k in range(20):
        phrase = " ".join(f"p{k}m{i}" for i in range(8))
        data += [(f"a{k:02d}", " ".join([phrase] * 2)), (f"b{k:02d}", " ".join([phrase] * 60))]
    df = spark.createDataFrame(data, "id string, content string")
    got = {(r[0], r[1]) for r in near_duplicate_pairs(df, "id", n=3, similarity=0.5, measure="jaccard").collect()}
    assert got == {(f"a{k:02d}", f"b{k:02d}") for k in range(20)}


def test_edges(spark, rows_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    data = [("a", "un deux trois quatre cinq six", 1), ("b", "un deux trois quatre cinq six", 2), ("b", "un deux trois quatre cinq six", 3), ("c", None, 1), (None, "un deux trois quatre cinq six", 1), ("d", "", 1), ("e", " ?! ", 1), ("f", long, 1), ("g", long + " fin", 1), ("h", "un", 1), ("i", "un", 1)]
    df = spark.createDataFrame(data, "id string, content string, a int").withColumnRenamed("a", "band")
    got = {(r[0], r[1]) for r in near_duplicate_pairs(df, "id").collect()}
    assert got == {("a", "b"), ("f", "g"), ("h", "i")}
    assert near_duplicate_pairs(df.limit(0), "id").count() == 0
    groups = {(r["id"], r["class_id"], r["links"]) for r in near_duplicate_groups(df, "id").collect()}
    assert groups == {("a", "a", 1), ("b", "a", 1), ("f", "f", 1), ("g", "f", 1), ("h", "h", 1), ("i", "h", 1)}


def test_many_copies_stay_linear(spark):
    """A third of all rows are one text: its copies are stated with their first, and its link to another text stays."""
    copy = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    data = [(f"k{i:03d}", copy) for i in range(100)] + [("z", copy + " lambda")] + [(f"o{i:03d}", f"{i} seul texte numero {i * 7} sans autre pareil {i * 31}") for i in range(200)]
    got = {(r[0], r[1]) for r in near_duplicate_pairs(spark.createDataFrame(data, "id string, content string"), "id", similarity=0.7).collect()}
    assert got == {("k000", f"k{i:03d}") for i in range(1, 100)} | {("k000", "z")}


def test_query(spark, folder):
    rows = p4_found(spark, folder).collect()
    assert rows and all(a < b for a, b in rows) and len(rows) == len(set(rows))


def test_hot_bands_in_blocks(spark):
    """Bands of a third of all texts, cut in blocks before they meet, give the same candidates as uncut."""
    from pyspark.sql import functions as F

    from lexgrain.llm.near_duplicates import candidate_pairs, samples

    template = " ".join(f"gabarit{i}" for i in range(60))
    texts = [template + f" propre{k} autre{k}" for k in range(150)] + [" ".join(f"mot{k}x{i}" for i in range(60)) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    drawn = samples(df, 3, 268, None).where("id is not null").select("id", "drawn")
    cut = {tuple(r) for r in candidate_pairs(drawn, 4, 100, cell=20, part=5000).collect()}
    whole = {tuple(r) for r in candidate_pairs(drawn, 4, 100, cell=10**9).collect()}
    assert cut == whole and len(whole) >= 150 * 149 // 2


def test_every_pair_of_copies_on_demand(spark):
    copy = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(f"k{i:02d}", copy) for i in range(30)] + [("z", copy + " lambda")], "id string, content string")
    got = {(r[0], r[1]) for r in near_duplicate_pairs(df, "id", similarity=0.7, expanded=None).collect()}
    assert len(got) == 30 * 29 // 2 + 30


def test_chance_candidates_stay_in_their_bands(spark):
    """Texts of one small vocabulary share bands by chance, as the square of their number: such pairs don't leave the bands."""
    from lexgrain.llm.near_duplicates import candidate_pairs, samples

    rng = random.Random(3)
    phrases = [" ".join(f"p{i}m{k}" for k in range(5)) for i in range(60)]
    texts = [" ".join(rng.choice(phrases) for _ in range(16)) for _ in range(1500)]
    near = [" ".join(t.split()[:70] + [f"fin{i}"]) for i, t in enumerate(texts[:50])]
    df = spark.createDataFrame(list(enumerate(texts + near)), "id long, content string")
    drawn = samples(df, 3, 268, None).where("id is not null").select("id", "drawn")
    got = {tuple(r) for r in candidate_pairs(drawn, 4, 100).collect()}
    assert got >= {(i, 1500 + i) for i in range(50)}
    assert len(got) < 3000


def test_equal_lower_bits_of_ids(spark):
    """Candidates name ids by their lower bits; the pairs are told apart by the whole ids."""
    from lexgrain.llm.near_duplicates import candidate_pairs, likely_pairs, samples

    a, b = ((" ".join(f"{x}{i}" for i in range(60))) for x in "ab")
    data = [(5, a), (7, a + " fin"), (5 + (1 << 40), b), (-(1 << 50) + 9, b + " fin")]
    drawn = samples(spark.createDataFrame(data, "id long, content string"), 3, 320, None).where("id is not null").select("id", "drawn")
    got = {tuple(r) for r in likely_pairs(candidate_pairs(drawn, 4, 100), drawn, 0.45).collect()}
    assert got == {(5, 7), (-(1 << 50) + 9, 5 + (1 << 40))}


def test_bitmap(spark):
    import numpy as np

    from lexgrain.operators.bitmaps import bitmap, has

    own = np.array([0, 1, -1, 2**62, -(2**62), 123 << 40], np.int64)
    words = bitmap(spark.createDataFrame([(int(x),) for x in own] + [(None,)], "id long"), "id", 20)
    assert len(words) == 1 << 14
    assert has(words, own.view(np.uint64)).all()
    assert has(words, (np.arange(1 << 20).astype(np.uint64) << np.uint64(44))).sum() == len(set((own.view(np.uint64) >> np.uint64(44)).tolist()))
