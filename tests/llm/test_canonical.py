from lexgrain.llm.canonical import bigrams, match_values, spelling

ENTRIES = [(1, "subject", "mathématiques"), (1, "subject", "maths"), (2, "subject", "sciences physiques"), (3, "subject", "grec ancien"), (4, "level", "première"), (4, "level", "1ère"), (5, "track", "S1"), (6, "track", "L'1")]
CASES = {
    ("subject", "Mathematiqes"): 1, ("subject", "  MATHS "): 1, ("subject", "corrigé_mathematiques"): 1, ("subject", "programme de sciences physiques 2019"): 2, ("subject", "physiques, sciences"): 2,
    ("subject", "ancien grec"): 3, ("subject", "scien. phys."): 2, ("subject", "cantine"): 0, ("subject", ""): 0, ("subject", "???"): 0, ("level", "1res"): 0, ("level", "Niveau : 1ere"): 4, ("level", "premeire"): 4, ("track", "s_1"): 5,
    ("track", "(S1)"): 5, ("track", "Série «L’1»"): 6, ("track", "L1"): 0, ("track", "K7"): 0, ("other", "S1"): 0,
}


def test_cases(spark):
    values = spark.createDataFrame([(*k, 1) for k in CASES] + [("subject", None, 1), (None, "maths", 1), ("subject", "  MATHS ", 2)], "field string, value string, ref int").drop("ref")
    entries = spark.createDataFrame(ENTRIES, "ref long, field string, text string")
    rows = match_values(values, entries).collect()
    assert {(r["field"], r["value"]): r["ref"] for r in rows} == CASES
    assert len(rows) == len(CASES)
    assert {r["ref"] for r in match_values(values, entries.limit(0)).collect()} == {0}
    assert match_values(values.limit(0), entries).count() == 0


def test_prefix_filter_loses_nothing(spark):
    """Every pair of forms with a Jaccard of 0.5 or more is found, as by comparing all."""
    names = ["informatique", "agronomie", "topographie", "philosophie", "comptabilite", "electrotechnique", "italien", "portugais"]
    typed = [n[:i] + n[i + 1 :] for n in names for i in range(1, len(n), 2)]
    values = spark.createDataFrame([("f", t) for t in typed], "field string, value string")
    entries = spark.createDataFrame([(i + 1, "f", n) for i, n in enumerate(names)], "ref long, field string, text string")
    got = {r["value"]: r["ref"] for r in match_values(values, entries).collect()}
    for t in typed:
        scores = [(len(set(bigrams(t)) & set(bigrams(n))) / len(set(bigrams(t)) | set(bigrams(n))) + spelling(t, n), -i) for i, n in enumerate(names)]
        assert got[t] == 1 - max(scores)[1]


def test_spelling():
    assert spelling("arbae", "arabe") == 0.8 and spelling("", "") == 1 and spelling("abc", "abc") == 1
