"""Relational operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import components, context, conversation, dedup, layout, models, ranking, rerank, store
from lexgrain.sources import store_files


def test_exact_dedup_best_and_first(spark):
    data = [("a", "h1", "medium", 900), ("b", "h1", "high", 100), ("c", "h2", "low", 5), ("d", "h2", "low", 5), ("e", None, "high", 1), ("f", "", "high", 1)]
    got = dedup.exact(spark.createDataFrame(data, "k string, h string, reliability string, n int"), "h", "n", F.col("k")).collect()
    assert {(r["k"], r["first_seen"]) for r in got} == {("b", "a"), ("c", "c")}


def test_near_dup_rules(spark):
    base = "la structure du roman est décrite par le groupe et la classe répond " * 3
    data = [("a", "s", base, "high"), ("b", "s", base + "oui", "high"), ("c", "t", base, "high"), ("d", "s", "a" * 90, "high"), ("e", "s", "a" * 100, "high"), ("f", None, base, "low"), ("g", None, base + "x", "high")]
    got = {(r[0], r[1]) for r in dedup.near(spark.createDataFrame(data, "k string, s string, t string, reliability string"), ["s"], "k", "t").collect()}
    assert got == {("b", "a"), ("g", "f")}  # the shorter or weaker goes; 90 of 100 is under the length bound; null subjects compare


def test_upsert_keeps_what_is_not_listed(spark):
    kind = "chunk_id string, content string, subject string"
    old, new = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], kind), spark.createDataFrame([("1", "A", "z"), ("3", "c", "w")], kind)
    once = store.upsert(old, new, "chunk_id", store.CHUNK_UPDATES)
    want = {("1", "A", "x"), ("2", "b", "y"), ("3", "c", "w")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in store.upsert(once, new, "chunk_id", store.CHUNK_UPDATES).collect()} == want


def test_quality_of_a_document_without_chunks(spark):
    docs = spark.createDataFrame([("d", "f", None, None, None, None, 3, None)], "document_id string, source_file string, subject string, level string, track string, document_profile string, page_count int, gaps array<string>")
    chunks = spark.createDataFrame([], "document_id string, chunk_id string, embedding array<float>, char_count int, reliability string, chunk_type string")
    r = store.quality_report(docs, chunks).first()
    assert (r["chunk_total"], r["embedded"], r["low_reliability"], r["avg_chars"], r["gap_count"]) == (0, 0, 0, None, 0)


def test_context(spark):
    df = spark.createDataFrame([(1, "a.pdf", 0, [], "abc"), (2, "a.pdf", 4, ["T", "U"], "defg")], "i int, f string, p int, h array<string>, c string")
    blocks = df.withColumn("b", context.block(F.col("i"), F.col("f"), F.col("p"), F.col("h"), F.col("c"))).withColumn("q", F.lit(1))
    assert [r["b"] for r in blocks.orderBy("i").collect()] == ["[1] (a.pdf, p.?)\nabc", "[2] (a.pdf, p.4 — T > U)\ndefg"]
    assert [context.within_budget(blocks, "q", "i", "b", n).count() for n in (10, 48, 49)] == [1, 1, 2]


def test_min_max_and_gate(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 2.0), (2, 5.0), (2, 5.0)], "q int, v double")
    assert sorted(r[0] for r in df.select(rerank.min_max(F.col("v"), "q")).collect()) == [0.0, 0.5, 1.0, 1.0, 1.0]
    rows = spark.createDataFrame([(1, "le cours de svt", "SVT"), (1, "le cours de svt", None), (1, "le cours de svt", "latin"), (2, "autre", None)], "q int, question string, subject string")
    subjects = spark.createDataFrame([("svt",), ("latin",)], "value string")
    assert {(r["q"], r["subject"]): r["gate"] for r in rerank.gate(rows.select("q", "question").distinct(), "q", "question", subjects, rows.drop("question")).collect()} == {(1, "SVT"): 1.0, (1, None): 0.25, (1, "latin"): 0.25, (2, None): 1.0}


def test_shortlist_differs_between_rerankers(spark):
    """The best lexical hit stands 21st by vector score: fusion leaves it out, the heuristic does not."""
    data = [(1, f"c{i:02d}", 1 - i / 100, 0.0, 0.0, "rien", [], "high", "mot clef") for i in range(20)] + [(1, "z", 0.75, 9.0, 0.0, "mot clef", ["mot clef"], "high", "mot clef")]
    df = spark.createDataFrame(data, "query_id int, chunk_id string, vector_score double, lexical_score double, rerank_score double, content string, hierarchy_path array<string>, reliability string, question string").withColumn("gate", F.lit(1.0))
    df = df.withColumns({"query_terms": T.terms("question"), "content_terms": T.terms("content")})
    assert "z" not in {r["chunk_id"] for r in rerank.fusion(rerank.shortlist(df, "query_id"), "query_id", 20).collect()}
    assert "z" in {r["chunk_id"] for r in rerank.heuristic(df, "query_id", 8).collect()}


def test_threads(spark):
    turns = spark.createDataFrame([("t", i, {"s": "x"} if i == 1 else None) for i in range(7)] + [("u", 9, None)], "thread string, n int, f map<string,string>")
    assert sorted(r["n"] for r in conversation.last_turns(turns.where("thread = 't'"), "thread", ["n"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert [r["thread"] for r in conversation.recent_threads(turns, "thread", "n", 1).collect()] == ["u"]
    carried = turns.select("thread", "n", conversation.carried(F.col("f"), "thread", ["n"]).alias("c")).where("n = 6").first()["c"]
    assert carried == {"s": "x"}


def test_positions_with_ties_and_large_groups(spark):
    df = spark.range(2000).selectExpr("id", "IF(id < 1500, 1, id % 3 + 2) AS g", "id % 100 AS s")
    got = ranking.positions(df, ["g"], [F.col("s")]).toPandas()
    want = got.groupby("g").s.rank(method="min").astype(int)
    assert (got.position == want).all() and len(got) == 2000


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (103, 102), (7, 7), (None, 5)] + [(200, k) for k in range(201, 400)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 104)) and all(got[i] == 200 for i in range(200, 400))


def test_header_and_rescue(spark):
    items = spark.createDataFrame([("d", "b", None, 1), ("d", "a", 2, 0), ("d", " ", 1, 2), ("d", "late", 7, 3)], "doc string, t string, p int, o int")
    assert layout.header_text(items, "doc", "t", "p", ["o"]).first()["header"] == "a\nb"
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2)], "doc string, p int")
    assert [tuple(r) for r in layout.rescue_pages(pages, pages.where("p = 2"), ["doc", "p"]).collect()] == [("d", 1)]


def test_token_chunks(spark):
    df = spark.createDataFrame([(1, "mot " * 1200), (2, "court"), (3, None), (4, ("a" * 50 + "\n\n") * 3)], "id int, t string")
    got = [(r["id"], r["chunk_order"], r["tokens"]) for r in layout.token_chunks(df, "id", "t").orderBy("id", "chunk_order").collect()]
    assert got == [(1, 0, 512), (1, 1, 512), (1, 2, 176), (4, 0, 3)]


def test_model_seam_isolates_failures(spark):
    def load():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return [len(t) for t in texts]

        return model

    got = {r["id"]: (r["output"], r["error"]) for r in models.apply_model(spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "id int, t string"), "id", "t", load, "bigint").collect()}
    assert got == {1: (3, None), 2: (None, "ValueError: no"), 3: (None, None)}


def test_bucketed_upserts(spark, tmp_path):
    """Only touched buckets are written again; a reader of an earlier version is not disturbed."""
    root = str(tmp_path / "t")
    kind = "k string, content string, subject string"
    assert store_files.read(spark, root) is None
    first = spark.createDataFrame([(f"k{i}", "a", "x") for i in range(50)], kind)
    assert store_files.merge(spark, root, first, "k", ["content"], buckets=8) == list(range(8))
    before = store_files.read(spark, root)
    again = spark.createDataFrame([("k1", "b", "y"), ("new", "c", "z")], kind)
    touched = store_files.merge(spark, root, again, "k", ["content"], buckets=8)
    assert 1 <= len(touched) <= 2
    got = {r["k"]: (r["content"], r["subject"]) for r in store_files.read(spark, root).collect()}
    assert len(got) == 51 and got["k1"] == ("b", "x") and got["new"] == ("c", "z") and got["k2"] == ("a", "x")
    assert before.count() == 50
    store_files.merge(spark, root, again, "k", ["content"], buckets=8)
    assert {r["k"]: (r["content"], r["subject"]) for r in store_files.read(spark, root).collect()} == got
    store_files.tidy(spark, root)
    assert store_files.read(spark, root).count() == 51


def test_context_line(spark):
    df = spark.createDataFrame([("maths", None, "S1", ["A", "B"], "texte"), (None, None, None, None, "seul")], "s string, l string, t string, h array<string>, c string")
    got = [r[0] for r in df.select(T.contextualized(*map(F.col, ("s", "l", "t", "h", "c")))).collect()]
    assert got == ["maths S1 > A > B\n\ntexte", "seul"]


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_sequential_near_dup(spark, seed):
    """The rule on a chain and on a mixed group, against the plain loop over all pairs."""
    import random

    rng = random.Random(seed)
    base = "la structure du roman est décrite par le groupe et la classe répond à la question posée par le maître"
    rows = []
    for i in range(40):
        t = list(base * 2)
        for _ in range(rng.randrange(14)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        rows.append((f"k{i:02d}", "s", "".join(t) + "x" * rng.randrange(6), rng.choice(["high", "medium", "low"])))
    df = spark.createDataFrame(rows, "k string, s string, t string, reliability string")
    rank = {"high": 3, "medium": 2, "low": 1}
    linked = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and min(len(a[2]), len(b[2])) >= 0.92 * max(len(a[2]), len(b[2])) and dedup.indel_ratio(a[2], b[2]) >= 92}
    order = sorted(((len(t), k, rank[r]) for k, _, t, r in rows))
    want = set()
    for i, (n, k, r) in enumerate(order):
        if k in want:
            continue
        for n2, k2, r2 in order[i + 1 :]:
            if k2 not in want and (k, k2) in linked:
                want.add(k if (r, n) <= (r2, n2) else k2)
    assert {r[0] for r in dedup.near_sequential(df, ["s"], "k", "t").collect()} == want


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"1")
    assert [r["length"] for r in store_files.scan_files(spark, str(tmp_path)).collect()] == [5]


def test_scan_files_of_a_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        store_files.scan_files(spark, str(tmp_path / "none")).collect()


def test_batches_of_queries(spark):
    """Many queries in several blocks against plain sorting, with ties, and vectors that are not usable."""
    import numpy as np

    from lexgrain.operators.vector_search import top_k_batch

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("short", [1.0]), ("zero", [0.0] * 4)]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)] + [(99, None)], "q int, v array<double>")
    got = {(r["q"], r["position"]): r["k"] for r in top_k_batch(df, "k", "v", q, "q", "v", 3, 4, block=16).collect()}
    n = np.linalg.norm(x, axis=1)
    for i in range(40):
        if n[i] == 0:
            continue
        s = [(-round(float(x[i] @ x[j] / (n[i] * n[j])), 9), f"k{j:03d}") for j in range(300) if n[j] > 0]
        assert [got[i, p] for p in (1, 2, 3)] == [k for _, k in sorted(s)[:3]]
    assert top_k_batch(df, "k", "v", q.limit(0), "q", "v", 3, 4).count() == 0


def test_contracts_of_models(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "abcde")], "k int, t string")
    got = {r["k"]: r for r in models.embed(df, "k", "t", lambda: lambda some: [[3.0, 4.0] if len(t) < 8 else [1.0] for t in some], 2, "Q: ").collect()}
    assert list(got[1]["vector"]) == [0.6, 0.8] and got[2]["vector"] is None and got[2]["error"] is None and "not 2" in got[3]["error"]


def test_thread_state_is_dropped_when_idle(spark, tmp_path):
    from datetime import datetime, timedelta

    from lexgrain.streaming import ingest

    start = datetime(2024, 1, 1)
    for k, (thread, minutes) in enumerate([("a", 0), ("b", 200), ("b", 400), ("a", 401)]):
        spark.createDataFrame([(thread, start + timedelta(minutes=minutes), str(k))], "thread string, ts timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("thread string, ts timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = ingest.run_to_table(ingest.thread_memory(stream.withWatermark("ts", "1 minute"), "thread", "ts", "v", idle="30 minutes"), "update").collect()
    last = {r["thread"]: (r["turns"], r["newest"]) for r in sorted(rows, key=lambda r: r["batch"])}
    assert last["a"] == (1, "3")  # its first turn was forgotten


def test_wide_rows_keep_the_latest(spark):
    from lexgrain.sources.tables import latest

    data = [("a", 1, "old"), ("a", 2, "new"), ("b", None, "x"), ("b", 1, "y"), ("c", 5, None), (None, 1, "z")]
    df = spark.createDataFrame(data, "k string, at int, content string")
    want = {("a", "new"), ("b", "y"), ("c", None)}
    for wide in (False, True):
        assert {(r["k"], r["content"]) for r in latest(df, ["k"], "at", wide).collect()} == want
        assert latest(df.limit(0), ["k"], "at", wide).count() == 0


def test_full_text_both_ways(spark):
    """The matrix products and the join find the same, over several blocks of queries, with facets, nulls and ties."""
    import random

    from lexgrain.operators import lexical_search as L

    rng = random.Random(2)
    v = [f"mot{i}" for i in range(30)]
    rows = spark.createDataFrame([(f"k{i:03d}", " ".join(rng.choices(v, k=rng.randrange(12))), rng.choice(["a", "b", None])) for i in range(200)] + [("none", None, "a")], "k string, t string, f string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices([*v, "ailleurs"], k=3)), rng.choice(["a", None])) for i in range(20)] + [(98, None, None), (99, "", "a")], "q int, question string, qf string")
    asked = L.asked_terms(queries, "question")
    found = rows.select("k", "f", L.hits("t", asked).alias("h"))
    agree = F.col("qf").isNull() | F.coalesce(F.col("f") == F.col("qf"), F.lit(False))
    want = {(r["q"], r["k"], round(r["lexical_score"], 6)) for r in L.top(L.scores(found, "k", "h", queries, "q", "question", agree, "qf"), "q", "k", 5).collect()}
    got = {(r["q"], r["k"], round(r["lexical_score"], 6)) for r in L.best_matches(found, "k", "h", queries, "q", "question", 5, {"f": "qf"}, block=7).collect()}
    assert got == want and want
    counts = {r["q"]: r["matches"] for r in L.best_matches(found, "k", "h", queries, "q", "question", None, {"f": "qf"}, block=7).collect()}
    every = L.scores(found, "k", "h", queries, "q", "question", agree, "qf").groupBy("q").count()
    assert counts == {r["q"]: r["count"] for r in every.collect()}
    assert L.best_matches(found, "k", "h", queries.limit(0), "q", "question", 5).count() == 0 and L.best_matches(found.limit(0), "k", "h", queries, "q", "question", 5).count() == 0


def test_hot_keys_meet_in_many_tasks(spark):
    from lexgrain.operators.skew import join_facts

    rows = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("u"))
    facts = rows.select("u").distinct().withColumn("fact", F.length("u"))
    got = join_facts(rows, facts, "u", "v", "inner", part=100)
    assert got.count() == 3000 and got.where("fact <> length(u)").count() == 0
    assert join_facts(rows.limit(0), facts, "u", "v").count() == 0


def test_sound_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"")
    (tmp_path / "b.wav").write_bytes(b"123")
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in store_files.scan_sound(spark, str(tmp_path)).collect()} == {"b.wav": "ok"}


def test_kept_tables(spark):
    from lexgrain.session import Kept

    made = []
    kept = Kept(lambda: made.append(1) or spark.range(len(made)), "kept")
    assert kept.get().count() == 1 and kept.get().count() == 1 and len(made) == 1
    assert kept.refresh().count() == 2 and len(made) == 2


def test_shared_folder_on_a_cluster():
    """Without a folder that all executors share, only a local session may go on."""
    from types import SimpleNamespace as N

    from lexgrain.session import shared_folder

    context = N(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(N(conf=N(get=lambda *_: None), sparkContext=context))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_texts_are_never_broadcast(spark):
    """One text against many values: the letters of the texts are the larger side, though Spark estimates them to be the smaller."""
    from lexgrain.operators import facets

    texts = spark.createDataFrame([(1, "le cours de svt"), (2, "rien")], "_key int, _q string")
    values = spark.createDataFrame([("svt",)] + [(f"value number {i}",) for i in range(5000)], "_d string")
    got = facets.containing(texts, values)
    assert "BuildRight" in _plan(got) and "BuildLeft" not in _plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, "le cours de svt", "svt")]


def test_what_is_counted_as_large_is_not_broadcast(spark):
    from lexgrain.session import small

    rows = spark.range(100).withColumnRenamed("id", "k")
    of = lambda n: spark.range(n).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in _plan(rows.join(small(of(10), 10), "k", "left_semi"))
    large = rows.join(small(of(11), 10), "k", "left_semi")
    assert "BroadcastHashJoin" not in _plan(large) and large.count() == 11


def test_near_duplicates_meet_in_blocks(spark):
    """Every pair of a group, over blocks and length buckets of any size, against all pairs; a pair is no row before its counts are near."""
    import random

    rng = random.Random(7)
    base = "la structure du roman est décrite par le groupe et la classe répond à la question posée par le maître"
    rows = []
    for i in range(90):
        t = list((base * 2)[: 150 + rng.randrange(50)])
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
        rows.append((f"k{i:02d}", rng.choice(["s", "t", None]), "".join(t), "high"))
    rows += [("a1", "s", "a", "low"), ("a2", "s", "a", "low"), ("a3", "s", "é", "low"), ("a4", "s", "", "low"), ("a5", "alone", base, "low")]
    df = spark.createDataFrame(rows, "k string, s string, t string, reliability string")
    order = sorted(rows, key=lambda r: (len(r[2]), r[0]))
    want = {(a[0], b[0]) for i, a in enumerate(order) for b in order[i + 1 :] if a[1] == b[1] and a[2] and len(a[2]) >= 0.92 * len(b[2]) and dedup.indel_ratio(a[2], b[2]) >= 92}
    assert len(want) > 30 and ("a1", "a2") in want
    for block in (3, 7, 4000):
        found = dedup.linked(df, ["s"], "k", "t", 92.0, block)
        assert sorted((r["k1"], r["k2"]) for r in found.collect()) == sorted(want)


def test_indel_ratio_stops_only_where_it_cannot_reach(spark):
    import random

    rng = random.Random(3)
    for _ in range(600):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 200))]
        b = list(a)
        for _ in range(rng.randrange(60)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "bc"])
        a, b, least = "".join(a), "".join(b), rng.choice([60.0, 80.0, 92.0])
        whole, got = dedup.indel_ratio(a, b), dedup.indel_ratio(a, b, least)
        assert got == (whole if whole >= least else 0.0)
    assert dedup.lcs_length("a" * 99 + "b" * 99, "b" * 99 + "a" * 99, 150) == 0
