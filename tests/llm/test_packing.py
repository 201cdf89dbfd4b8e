import re

import numpy as np
import regex
from pyspark.sql import functions as F

from lexgrain.llm.packing import pack, plan, token_count


def test_plan_uses_everything():
    rng = np.random.default_rng(2)
    h = np.bincount(rng.integers(1, 300, 5000), minlength=513)[:513]
    left = h.copy()
    for sizes, times in plan(h, 512):
        assert sum(sizes) <= 512
        for s in sizes:
            left[s] -= times
    assert not left[1:].any()


def test_pack(spark):
    data = [(i, (i * 37) % 900 + 1, "x") for i in range(2000)] + [(5000, 2100, "x"), (5001, 0, "x"), (5002, None, "x"), (None, 5, "x"), (3, 1, "again")]
    df = spark.createDataFrame(data, "id long, n long, container string")
    got = pack(df, "id", F.col("n"), capacity=1000).toPandas()
    assert set(got.id) == set(range(2000)) | {5000, 5001, 5002}
    assert got.groupby("container")["size"].sum().max() <= 1000
    big = got[got.id == 5000].sort_values("piece")
    assert big["size"].tolist() == [1000, 1000, 100] and big.container.nunique() == 3
    assert got.container.notna().all() and got[got.id == 3]["size"].tolist() == [(3 * 37) % 900 + 1]
    assert got["size"].sum() / (1000 * got.container.nunique()) > 0.98
    assert pack(df.limit(0), "id", F.col("n")).count() == 0
    assert pack(spark.createDataFrame([(1, 0)], "id long, n long"), "id", F.col("n")).first()["container"] == 0


def test_token_rule(spark):
    texts = ["", "Été 2024, l'an neuf !", "éa", "—— x", "数学 abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_count(F.col("t")).alias("n"))
    for r in df.collect():
        if r["t"] is None:
            assert r["n"] is None
        else:
            runs = regex.findall(r"[\p{L}\p{N}]+", r["t"])
            rest = regex.sub(r"[\p{L}\p{N}]+", "", r["t"])
            assert r["n"] == len(runs) + len(re.sub(r"\s", "", rest))


def test_a_size_of_a_third(spark):
    """A third of all rows have one size: every piece still has one place, and no container overflows."""
    data = [(i, 400 if i % 3 == 0 else (i * 53) % 600 + 1) for i in range(6000)]
    got = pack(spark.createDataFrame(data, "id long, n long"), "id", F.col("n"), capacity=1000).toPandas()
    assert len(got) == 6000 and got.id.is_unique
    assert got.groupby("container")["size"].sum().max() <= 1000
    assert got["size"].sum() / (1000 * got.container.nunique()) > 0.98
