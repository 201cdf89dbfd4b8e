"""Queries on the stored tables: counts, report, upsert, delete, duplicates, pages, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import conversation, dedup, layout, models, store
from lexgrain.plans import base
from lexgrain.session import shared_folder
from lexgrain.sources import store_files
from lexgrain.sources.tables import table

Q = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {base.CHUNKS}, {base.DOCUMENTS} SELECT (SELECT count(*) FROM doc) AS documents, count(*) AS chunks, count(embedding) AS embedded FROM ch")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.corpus_stats(base.documents(spark, d), base.chunks(spark, d, "embedding"))


@query(f"WITH {base.CHUNKS} SELECT subject, count(*) AS n FROM ch GROUP BY subject")
def by_subject(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "subject").groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject")


@query(f"""WITH {base.CHUNKS}, {base.DOCUMENTS}, per AS (SELECT document_id, count(*) AS chunk_total, count(embedding) AS embedded, CAST(round(avg(char_count)) AS BIGINT) AS avg_chars, max(char_count) AS max_chars,
count(*) FILTER (reliability = 'low') AS low_reliability, count(*) FILTER (chunk_type = 'table_row') AS table_rows FROM ch GROUP BY document_id)
SELECT doc.document_id, source_file, subject, level, track, document_profile, page_count, coalesce(chunk_total, 0) AS chunk_total, coalesce(embedded, 0) AS embedded, coalesce(low_reliability, 0) AS low_reliability,
coalesce(table_rows, 0) AS table_rows, avg_chars, max_chars, coalesce(len(gaps), 0) AS gap_count FROM doc LEFT JOIN per USING (document_id)""")
def quality_view(spark: SparkSession, d: str) -> DataFrame:
    docs = base.documents(spark, d, "source_file", "subject", "level", "track", "document_profile", "page_count", "gaps")
    return store.quality_report(docs, base.chunks(spark, d, "document_id", "embedding", "char_count", "reliability", "chunk_type"))


@query(f"WITH {base.CHUNKS}, {base.DOCUMENTS} SELECT doc.document_id, count(ch.chunk_id) AS chunk_count FROM doc LEFT JOIN ch ON ch.document_id = doc.document_id GROUP BY ALL")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk_counts(base.documents(spark, d), base.chunks(spark, d, "document_id"))


_OLD_DOC = "old AS (SELECT * FROM doc WHERE document_id IN (SELECT document_id FROM ch))"


@query(f"""WITH {base.CHUNKS}, {base.DOCUMENTS}, {_OLD_DOC}, new AS (SELECT * REPLACE (page_count + 1 AS page_count, program_year + 1 AS program_year, NULL AS subject) FROM doc)
SELECT new.document_id, new.page_count, CASE WHEN old.document_id IS NULL THEN new.program_year ELSE old.program_year END AS program_year, new.subject, new.level,
CASE WHEN old.document_id IS NULL THEN new.chunk_count ELSE old.chunk_count END AS chunk_count FROM new LEFT JOIN old USING (document_id)""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = base.documents(spark, d, "subject", "level", "program_year", "page_count", "chunk_count")
    old = docs.join(base.chunks(spark, d, "document_id").select("document_id").distinct(), "document_id", "left_semi")
    new = docs.withColumns({"page_count": F.col("page_count") + 1, "program_year": F.col("program_year") + 1, "subject": F.lit(None).cast("string")})
    return store.upsert(old, new, "document_id", store.DOCUMENT_UPDATES).drop("updated_at")


@query(f"""WITH {base.CHUNKS}, old AS (SELECT * FROM ch WHERE content_hash IS NOT NULL), new AS (SELECT * REPLACE (upper(content) AS content, 'new' AS subject, 'medium' AS reliability) FROM ch)
SELECT new.chunk_id, sha256(new.content) AS content_sha, new.reliability, CASE WHEN old.chunk_id IS NULL THEN new.subject ELSE old.subject END AS subject,
CASE WHEN old.chunk_id IS NULL THEN new.page_number ELSE old.page_number END AS page_number, new.content_hash FROM new LEFT JOIN old USING (chunk_id)""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = base.chunks(spark, d, "content", "subject", "reliability", "page_number", "content_hash")
    new = c.withColumns({"content": F.upper("content"), "subject": F.lit("new"), "reliability": F.lit("medium")})
    return store.upsert(c.where("content_hash is not null"), new, "chunk_id", store.CHUNK_UPDATES).select("chunk_id", F.sha2("content", 256).alias("content_sha"), "reliability", "subject", "page_number", "content_hash")


@query(f"""WITH {base.CHUNKS}, {base.DOCUMENTS}, gone AS (SELECT document_id FROM doc WHERE document_type = 'administratif')
SELECT 'documents' AS kept, count(*) AS n FROM doc WHERE document_id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM ch WHERE document_id IS NULL OR document_id NOT IN (FROM gone)""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = base.documents(spark, d, "document_type")
    a, b = store.delete_documents(docs, base.chunks(spark, d, "document_id"), docs.where("document_type = 'administratif'").select("document_id"))
    return a.agg(F.lit("documents").alias("kept"), F.count("*").alias("n")).unionByName(b.agg(F.lit("chunks").alias("kept"), F.count("*").alias("n")))


@query(f"""WITH {base.CHUNKS}, ranked AS (SELECT chunk_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY CASE reliability WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, coalesce(char_count, 0) DESC, chunk_id) AS n,
min(chunk_id) OVER (PARTITION BY content_hash) AS first_seen FROM ch WHERE content_hash IS NOT NULL AND content_hash <> '') SELECT chunk_id, content_hash, first_seen FROM ranked WHERE n = 1""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.exact(base.chunks(spark, d, "content_hash", "reliability", "char_count"), "content_hash", "char_count", F.col("chunk_id"))
    return kept.select("chunk_id", "content_hash", "first_seen")


def _deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that exact deduplication keeps in each file."""
    c = base.chunks(spark, d, "source_file", "subject", "content", "content_hash", "reliability", "char_count")
    return dedup.exact(c, "content_hash", "char_count", F.col("chunk_id"), "source_file")


@query()
def near_dup_indel(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates within one subject, across files."""
    return dedup.near(_deduplicated(spark, d), ["subject"], "chunk_id", "content").select("key_kept", "key_dropped", F.round("ratio", 4).alias("ratio"))


@query()
def near_dup_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The same within one file and subject, as at ingestion."""
    return dedup.near(_deduplicated(spark, d), ["source_file", "subject"], "chunk_id", "content").select("key_kept", "key_dropped", F.round("ratio", 4).alias("ratio"))


@query()
def near_dup_mixed_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the sequential rule drops within one subject."""
    return dedup.near_sequential(_deduplicated(spark, d), ["subject"], "chunk_id", "content")


@query()
def near_dup_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that no pair within one file and subject drops."""
    kept = _deduplicated(spark, d)
    return dedup.survivors(kept, "chunk_id", dedup.near(kept, ["source_file", "subject"], "chunk_id", "content")).select("chunk_id")


@query(f"""WITH {base.CHUNKS}, ranked AS (SELECT chunk_id, row_number() OVER (PARTITION BY content_hash ORDER BY CASE reliability WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, coalesce(char_count, 0) DESC, chunk_id) AS n,
min(chunk_id) OVER (PARTITION BY content_hash) AS first_seen FROM ch WHERE content_hash IS NOT NULL AND content_hash <> '') SELECT chunk_id, row_number() OVER (ORDER BY first_seen) AS place FROM ranked WHERE n = 1""")
def dedup_survivor_order(spark: SparkSession, d: str) -> DataFrame:
    """The chunks kept, in the order in which their hashes were first seen (chunks ordered by id)."""
    from lexgrain.operators.ranking import positions

    kept = dedup.exact(base.chunks(spark, d, "content_hash", "reliability", "char_count"), "content_hash", "char_count", F.col("chunk_id"))
    return positions(kept.select("chunk_id", "first_seen", F.lit(0).alias("all")), ["all"], [F.col("first_seen")], "place").select("chunk_id", "place")


@query(f"WITH {base.CHUNKS} SELECT document_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY chunk_order, chunk_id)) AS merged FROM ch WHERE content IS NOT NULL GROUP BY document_id")
def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a document joined by blank lines, as a hash."""
    c = base.chunks(spark, d, "document_id", "content", "chunk_order").where("content is not null")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_id", "content"))), lambda x: x["content"])
    return c.groupBy("document_id").agg(F.sha2(F.array_join(parts, "\n\n"), 256).alias("merged"))


_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


@query(f"WITH {_VECTORS}, n AS (SELECT vec_id, sqrt(list_dot_product(e, e)) AS n, list_min(e) AS low, list_max(e) AS high FROM v) SELECT round(avg(n), 4) AS mean_norm, round(min(n), 4) AS least_norm, round(max(n), 4) AS most_norm, round(min(low), 4) AS least, round(max(high), 4) AS most FROM n")
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    from lexgrain.functions.vectors import norm

    v = table(spark, d, "embeddings").select(norm(F.col("embedding")).alias("n"), F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"))
    return v.agg(F.round(F.avg("n"), 4).alias("mean_norm"), F.round(F.min("n"), 4).alias("least_norm"), F.round(F.max("n"), 4).alias("most_norm"), F.round(F.min("low"), 4).alias("least"), F.round(F.max("high"), 4).alias("most"))


@query(f"WITH {_VECTORS} SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 4) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 4) AS last FROM v")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    from lexgrain.functions.vectors import normalized

    n = normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n[0], 4).alias("first"), F.round(n[63], 4).alias("last"))


@query(f"WITH {base.CHUNKS} SELECT document_id, min(page_number) AS first_page FROM ch GROUP BY document_id")
def first_page(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "document_id", "page_number").groupBy("document_id").agg(F.min("page_number").alias("first_page"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, list_filter(string_split_regex(p, '{T.SPACES}+'), lambda x: x <> '') AS w FROM p), s AS (SELECT doc_id, i, w, unnest(range(0, len(w), 512)) AS k FROM w WHERE len(w) > 0),
z AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS r, len(w[k + 1:k + 512]) AS n, length(array_to_string(w[k + 1:k + 512], ' ')) AS c FROM s),
l AS (SELECT doc_id, list({{'n': n, 'no': 0, 'nos': [0]}} ORDER BY r) AS l FROM z GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.n + x.n > 512 THEN {{'n': x.n, 'no': a.no + 1, 'nos': list_append(a.nos, a.no + 1)}} ELSE {{'n': a.n + x.n, 'no': a.no, 'nos': list_append(a.nos, a.no)}} END).nos AS nos FROM l),
a AS (SELECT doc_id, nos[r] AS no, sum(n) AS tokens, sum(c) + 2 * (count(*) - 1) AS chars FROM z JOIN f USING (doc_id) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS chunk_order, tokens, chars FROM a WHERE chars >= 80""")
def chunker(spark: SparkSession, d: str) -> DataFrame:
    return layout.token_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_order", "tokens", F.length("content").alias("chars"))


@query("SELECT doc_id, length(text) AS output, CAST(NULL AS VARCHAR) AS error FROM documents")
def model_seam(spark: SparkSession, d: str) -> DataFrame:
    """The seam for external models, with a stand-in that returns the length of the text."""
    return models.apply_model(table(spark, d, "documents"), "doc_id", "text", lambda: lambda some: [len(t) for t in some], "bigint")


_TURNS = "turns AS (SELECT CAST(user_id AS VARCHAR) AS thread, ts, event_id, event_type, value FROM events WHERE user_id IS NOT NULL)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as the turns of threads, a thread for each user."""
    return table(spark, d, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("thread"), "ts", "event_id", "event_type", "value")


@query(f"WITH {_TURNS} SELECT thread, event_id FROM turns QUALIFY row_number() OVER (PARTITION BY thread ORDER BY ts DESC, event_id DESC) <= 6")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_turns(_turns(spark, d), "thread", ["ts", "event_id"]).select("thread", "event_id")


@query(f"WITH {_TURNS} SELECT thread, max(ts) AS last_write FROM turns GROUP BY thread ORDER BY last_write DESC, thread LIMIT 500")
def lru_threads(spark: SparkSession, d: str) -> DataFrame:
    return conversation.recent_threads(_turns(spark, d), "thread", "ts")


@query(f"WITH {_TURNS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY thread ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM turns")
def carry_filters(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return t.select("event_id", conversation.carried(F.when(F.col("event_type") == "purchase", F.col("event_id")), "thread", ["ts", "event_id"]).alias("carried"))


@query(f"WITH {_TURNS} SELECT thread, count(*) FILTER (event_type = 'click') AS tools FROM turns GROUP BY thread")
def tool_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).groupBy("thread").agg(F.count_if(F.col("event_type") == "click").alias("tools"))


@query(r"""WITH r AS (SELECT query_id, question, regexp_replace(trim(left(question, 10 + CAST(query_id % 7 AS INT))), '^["''«» ]+|["''«» ]+$', '', 'g') AS w FROM search_requests)
SELECT query_id, CASE WHEN length(w) >= 12 AND len(regexp_split_to_array(w, '\s+')) >= 3 THEN w ELSE question END AS asked FROM r""")
def rewrite_guard(spark: SparkSession, d: str) -> DataFrame:
    """A rewriting cut to a few characters stands in for the model's."""
    r = table(spark, d, "search_requests")
    return r.select("query_id", conversation.rewrite_guard(F.col("question"), F.left("question", (10 + F.col("query_id") % 7).cast("int"))).alias("asked"))


@query(f"""WITH {base.CHUNKS} SELECT chunk_id, CASE WHEN ascii(right(chunk_id, 1)) % 2 = 0 THEN 'third ' || coalesce(content_hash, '') WHEN reliability = 'high' THEN 'second' ELSE sha256(content) END AS content_sha,
CASE WHEN content_hash IS NOT NULL THEN subject WHEN reliability = 'high' THEN 'again' ELSE 'late' END AS subject FROM ch
WHERE content_hash IS NOT NULL OR reliability = 'high' OR ascii(right(chunk_id, 1)) % 2 = 0""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Three deliveries of chunks, each added to the folder of a stream and ingested from where it stopped: the first of rows with a hash,
    then of changed rows, some of them new; contents follow the last delivery, subjects stay as first delivered."""
    from lexgrain.streaming import ingest

    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = base.chunks(spark, d, "subject", "content_hash", "reliability", content_sha=F.sha2("content", 256)).select("chunk_id", "subject", "content_hash", "reliability", "content_sha")
    odd = F.ascii(F.right("chunk_id", F.lit(1))) % 2 == 0
    deliveries = [
        rows.where("content_hash is not null"), rows.where("reliability = 'high'").withColumns({"content_sha": F.lit("second"), "subject": F.lit("again")}),
        rows.where(odd).withColumns({"content_sha": F.concat(F.lit("third "), F.coalesce("content_hash", F.lit(""))), "subject": F.lit("late")}),
    ]
    for k, delivery in enumerate(deliveries):
        delivery.withColumn("delivered", F.lit(k)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        ingest.ingest(stream, f"{root}/table", "chunk_id", ["content_sha", "content_hash", "reliability", "delivered"], "delivered", f"{root}/state", buckets=16)
    return store_files.read(spark, f"{root}/table").select("chunk_id", "content_sha", "subject")


@query("""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS thread, CAST(event_id AS VARCHAR) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events WHERE user_id IS NOT NULL QUALIFY n <= 6)
SELECT thread, count(*) AS turns, arg_max(v, n) AS oldest, arg_min(v, n) AS newest FROM t GROUP BY thread""")
def stream_thread_state(spark: SparkSession, d: str) -> DataFrame:
    """The turns held of each thread after the last batch."""
    from lexgrain.streaming import ingest

    got = ingest.run_to_table(ingest.thread_memory(ingest.table_stream(spark, d, "events"), "user_id", "ts", "event_id"), "update")
    return got.groupBy("thread").agg(F.max_by(F.struct("turns", "oldest", "newest"), "batch").alias("s")).select("thread", "s.*")


@query("SELECT column_name AS \"column\", v AS value, count(*) AS rows FROM (SELECT 'reliability' AS column_name, reliability AS v FROM chunks UNION ALL SELECT 'chunk_type', chunk_type FROM chunks) WHERE v IS NOT NULL AND NOT (column_name = 'reliability' AND v IN ('high', 'medium')) AND NOT (column_name = 'chunk_type' AND v IN ('paragraph', 'list', 'table_block')) GROUP BY ALL")
def accepted_values(spark: SparkSession, d: str) -> DataFrame:
    """Values outside those that chunking produces."""
    return store.accepted_values(table(spark, d, "chunks"), {"reliability": ["high", "medium"], "chunk_type": ["paragraph", "list", "table_block"]})


QUERIES = Q
