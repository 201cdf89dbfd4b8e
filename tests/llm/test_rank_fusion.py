from lexgrain.llm.rank_fusion import fuse

NAN = float("nan")


def test_positions_ties_and_missing(spark):
    data = [(1, "a", 9.0, 0.1, None, 5), (1, "b", 9.0, 0.2, NAN, 5), (1, "b", 9.0, 0.2, NAN, 6), (1, "c", 1.0, None, 3.0, 5), (2, "a", None, None, None, 5), (None, "a", 1.0, 1.0, 1.0, 5), (2, None, 1.0, 1.0, 1.0, 5)]
    df = spark.createDataFrame(data, "q long, item string, v double, l double, r double, rank int")
    got = {(r["q"], r["item"]): tuple(r)[2:5] + (r["position_sum"], r["rank"]) for r in fuse(df, "q", "item", ["v", "l", "r"]).collect()}
    assert got[(1, "a")][:4] == (1, 2, 2, 5)
    assert got[(1, "b")][:4] == (1, 1, 2, 4)
    assert got[(1, "c")][:4] == (3, 3, 1, 7)
    assert got[(2, "a")] == (1, 1, 1, 3, 1)
    assert sorted(v[4] for k, v in got.items() if k[0] == 1) == [1, 2, 3]
    assert fuse(df.limit(0), "q", "item", ["v", "l", "r"]).count() == 0


def test_scale_does_not_matter(spark):
    rows = [(1, f"i{k}", float((k * 7) % 11), float((k * 5) % 11), float((k * 3) % 11)) for k in range(11)]
    kind = "q long, item string, v double, l double, r double"
    one = fuse(spark.createDataFrame(rows, kind), "q", "item", ["v", "l", "r"])
    two = fuse(spark.createDataFrame([(q, i, v * 1e6 - 4, l, r**3) for q, i, v, l, r in rows], kind), "q", "item", ["v", "l", "r"])
    assert {(r["item"], r["rank"]) for r in one.collect()} == {(r["item"], r["rank"]) for r in two.collect()}
    best = {r["item"]: r["significance"] for r in one.collect()}
    assert 0 < min(best.values()) <= max(best.values()) <= 1


def test_large_group(spark):
    df = spark.range(3000).selectExpr("1L AS q", "id AS item", "double((id * 7919) % 3000) AS v", "double((id * 104729) % 3000) AS l")
    got = fuse(df, "q", "item", ["v", "l"]).toPandas()
    assert sorted(got["rank"]) == list(range(1, 3001))
    assert sorted(got["position_v"]) == list(range(1, 3001))
