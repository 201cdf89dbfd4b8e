"""Queries of the retrieval pipeline: vectors, full text, hybrid, reranking, context, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.functions.vectors import cosine
from lexgrain.operators import context, facets, lexical_search, rerank, vector_search
from lexgrain.plans import base
from lexgrain.session import written
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


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)"


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"WITH {_V} SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM v, q ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 30")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 30).select("vec_id", F.round("score", 4).alias("score"))


@query(f"WITH {_V} SELECT v.vec_id, round(list_cosine_similarity(v.e, q.e), 4) AS score FROM v, q WHERE label = 3 ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 30")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.top_k(table(spark, d, "embeddings").where("label = 3"), "vec_id", "embedding", _first_vector(spark, d), 30).select("vec_id", F.round("score", 4).alias("score"))


@query(f"""WITH {_V} SELECT b.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, b.e), 4) AS score FROM v, v b WHERE b.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_cosine_similarity(v.e, b.e), 9) DESC, v.vec_id) <= 10""")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_search.top_k_batch(rows, "vec_id", "embedding", queries, "query_id", "query_vector", 10, 64).select("query_id", "vec_id", F.round("score", 4).alias("score"))


_REQ = f"req AS (SELECT query_id, question, {base.clean_filter_sql('subject')} AS qs, {base.clean_filter_sql('level')} AS ql, {base.clean_filter_sql('track')} AS qt FROM search_requests)"
_POST = f"""post AS (SELECT chunk_id, subject, level, track, term, count(*) AS tf FROM (SELECT chunk_id, subject, level, track, unnest({T.all_terms_sql('indexed_content')}) AS term FROM ch) GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, qs, ql, qt, unnest({T.all_terms_sql('question')}) AS term FROM req)"""


@query(f"WITH {_REQ} SELECT query_id, qs AS subject, ql AS level, qt AS track FROM req")
def request_filters(spark: SparkSession, d: str) -> DataFrame:
    return base.requests(spark, d).select("query_id", "subject", "level", "track")


def _hits(spark: SparkSession, d: str, text: str = "indexed_content", of: DataFrame | None = None, *keep: str, **made) -> DataFrame:
    """``chunk_id, hits``: the terms asked for in any question where they stand in a chunk's text; the text itself stays in the scan."""
    asked = lexical_search.asked_terms(table(spark, d, "search_requests"), "question")
    return base.chunks(spark, d, *keep, of=of, hits=lexical_search.hits(text, asked), **made).drop("created_at")


def _best(spark: SparkSession, d: str, k: int | None = 30, **facets: str) -> DataFrame:
    """The k best chunks of each request by full text (or, without k, how many match); facets: name of the chunk's column -> the request's."""
    asked = lexical_search.asked_terms(table(spark, d, "search_requests"), "question")
    folded = {f"c_{c}": T.unaccented(c) for c in facets}
    req = base.requests(spark, d).select("query_id", "question", *[T.unaccented(c).alias(f"q_{c}") for c in facets])
    if asked is not None:
        # written, as every block of requests reads them
        rows = written(base.chunks(spark, d, hits=lexical_search.hits("indexed_content", asked), **folded).drop("created_at"), "hits")
        return lexical_search.best_matches(rows, "chunk_id", "hits", req, "query_id", "question", k, {f"c_{c}": f"q_{c}" for c in facets})
    # more different terms than a task should hold: the terms of texts and questions meet in a join
    rows = base.chunks(spark, d, hits=lexical_search.hits("indexed_content", None), **folded).drop("created_at")
    agree = F.lit(True)
    for c in facets:
        agree = agree & (F.col(f"q_{c}").isNull() | F.coalesce(F.col(f"c_{c}") == F.col(f"q_{c}"), F.lit(False)))
    s = lexical_search.scores(rows, "chunk_id", "hits", req, "query_id", "question", agree, *[f"q_{c}" for c in facets])
    return lexical_search.top(s, "query_id", "chunk_id", k) if k else s.groupBy("query_id").agg(F.count("*").alias("matches"))


@query(f"""WITH {base.CHUNKS}, {_REQ}, {_POST} SELECT query_id, chunk_id, round(sum(tf) * 0.1, 4) AS score FROM post JOIN asked USING (term) GROUP BY query_id, chunk_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, chunk_id) <= 30""")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("query_id", "chunk_id", F.round("lexical_score", 4).alias("score"))


_UNACCENT = lambda x: f"replace(replace(lower(strip_accents({x})), 'œ', 'oe'), 'ß', 'ss')"
_SAME = " AND ".join(f"({q} IS NULL OR {_UNACCENT(c)} = {_UNACCENT(q)})" for c, q in (("subject", "qs"), ("level", "ql"), ("track", "qt")))


@query(f"""WITH {base.CHUNKS}, {_REQ}, {_POST} SELECT query_id, chunk_id, round(sum(tf) * 0.1, 4) AS score FROM post JOIN asked USING (term) WHERE {_SAME} GROUP BY query_id, chunk_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, chunk_id) <= 30""")
def lexical_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, subject="subject", level="level", track="track").select("query_id", "chunk_id", F.round("lexical_score", 4).alias("score"))


@query(f"WITH {base.CHUNKS}, {_REQ}, {_POST} SELECT query_id, count(DISTINCT chunk_id) AS matches FROM post JOIN asked USING (term) GROUP BY query_id")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d, None)


_CAND = """cand AS (SELECT * REPLACE (CASE WHEN isnan(vector_score) THEN NULL ELSE vector_score END AS vector_score, CASE WHEN isnan(lexical_score) THEN NULL ELSE lexical_score END AS lexical_score,
CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END AS rerank_score) FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY logged_at DESC NULLS LAST) = 1)"""
_CHANNELS = """vec AS (SELECT query_id, chunk_id, vector_score FROM cand WHERE vector_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) <= 30),
lex AS (SELECT query_id, chunk_id, lexical_score FROM cand WHERE lexical_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) <= 30)"""


def _channel(rows: DataFrame, score: str) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.where(F.col(score).isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n <= 30").select("query_id", "chunk_id", score)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = base.candidates(spark, d)
    return _channel(c, "vector_score").join(_channel(c, "lexical_score"), ["query_id", "chunk_id"], "full_outer")


@query(f"WITH {_CAND}, {_CHANNELS} SELECT query_id, chunk_id, coalesce(vector_score, 0) AS vector_score, coalesce(lexical_score, 0) AS lexical_score FROM vec FULL OUTER JOIN lex USING (query_id, chunk_id)")
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "chunk_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"))


@query(f"""WITH {base.CHUNKS}, {_CAND}, {_CHANNELS}, h AS (SELECT query_id, chunk_id, vector_score, lexical_score FROM vec FULL OUTER JOIN lex USING (query_id, chunk_id)),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT query_id, chunk_id, round(CASE WHEN h.vector_score IS NOT NULL THEN h.vector_score WHEN len(embedding) = 64 AND isfinite(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.q) ELSE 0 END, 5) AS vector_score FROM h LEFT JOIN ch USING (chunk_id), q""")
def hybrid_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without a vector score get the cosine of their chunk with the query vector (vector 0 stands in for the model's)."""
    h = _hybrid(spark, d).select("query_id", "chunk_id", "vector_score")
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    own = base.chunks(spark, d, "embedding", of=h.where("vector_score is null")).where("embedding is not null").select("chunk_id", cosine(F.col("embedding"), q).alias("own"))
    own = own.where("own is not null and not isnan(own)")
    return h.join(own, "chunk_id", "left").select("query_id", "chunk_id", F.round(F.coalesce("vector_score", "own", F.lit(0.0)), 5).alias("vector_score"))


_SUBJECTS = f"subjects AS (SELECT DISTINCT lower(subject) AS value FROM doc WHERE subject IS NOT NULL AND subject <> '')"


@query(f"""WITH {base.DOCUMENTS}, {_REQ}, {_SUBJECTS}, named AS (SELECT query_id, list(value) AS named FROM req JOIN subjects ON contains({T.folded_sql('question')}, value) GROUP BY query_id), {_CAND}
SELECT c.query_id, c.chunk_id, CASE WHEN named IS NULL OR coalesce(list_contains(named, lower(c.subject)), false) THEN 1.0 ELSE 0.25 END AS gate FROM cand c JOIN req USING (query_id) LEFT JOIN named USING (query_id)""")
def subject_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d, base.candidates(spark, d).join(base.requests(spark, d).select("query_id"), "query_id", "left_semi")).select("query_id", "chunk_id", "gate")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return base.documents(spark, d, "subject").where("subject is not null and subject <> ''").select(F.lower("subject").alias("value")).distinct()


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the distinct terms of their question, worked out once for each question."""
    req = base.requests(spark, d).select("query_id", T.terms("question").alias("query_terms"))
    return base.candidates(spark, d).join(req, "query_id")


def _read(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The rows with ``content_terms``, the distinct asked terms of their chunk, worked out once for each chunk that the rows name."""
    hits = _hits(spark, d, "content", rows).select("chunk_id", F.array_distinct("hits").alias("content_terms"))
    return rows.join(hits, "chunk_id", "left")


def _gated(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    return rerank.gate(table(spark, d, "search_requests").select("query_id", "question"), "query_id", "question", _subjects(spark, d), rows)


_TERMS = lambda x: f"list_distinct({T.all_terms_sql(x)})"
_OVERLAP = lambda q, x: f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {_TERMS(x)})) / len({q}) ELSE 0.0 END"
_ASKED = f"""{_REQ}, {_CAND}, asked AS (SELECT c.*, question, {_TERMS('question')} AS qt_, content, array_to_string(coalesce(hierarchy_path, []), ' ') AS path FROM cand c JOIN req USING (query_id) LEFT JOIN (SELECT chunk_id, content FROM ch) USING (chunk_id))"""


@query(f"WITH {base.CHUNKS}, {_ASKED} SELECT query_id, chunk_id, round({_OVERLAP('qt_', 'content')}, 6) AS share FROM asked")
def term_overlap(spark: SparkSession, d: str) -> DataFrame:
    own = F.coalesce("content_terms", F.array().cast("array<string>"))
    return _read(spark, d, _asked(spark, d)).select("query_id", "chunk_id", F.round(rerank.overlap(F.col("query_terms"), own), 6).alias("share"))


@query(f"""WITH {_CAND} SELECT query_id, chunk_id, round(CASE WHEN max(rerank_score) OVER w = min(rerank_score) OVER w THEN 1.0 ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END, 6) AS signal FROM cand WINDOW w AS (PARTITION BY query_id)""")
def minmax_signals(spark: SparkSession, d: str) -> DataFrame:
    return base.candidates(spark, d).select("query_id", "chunk_id", F.round(rerank.min_max(F.col("rerank_score"), "query_id"), 6).alias("signal"))


@query(f"""WITH {base.CHUNKS}, {_ASKED}, s AS (SELECT query_id, chunk_id, 0.55 * coalesce(vector_score, 0) + 0.20 * ({_OVERLAP('qt_', 'path')}) + 0.15 * ({_OVERLAP('qt_', "coalesce(content, '')")}) + 0.10 * CASE reliability WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 1.0 END AS score FROM asked)
SELECT query_id, chunk_id, round(score + 1e-9, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 8""")
def rerank_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return rerank.heuristic(_read(spark, d, _asked(spark, d)), "query_id", 8).select("query_id", "chunk_id", F.round(F.col("heuristic_score") + 1e-9, 6).alias("score"))


_NORM = lambda x: f"CASE WHEN max({x}) OVER w = min({x}) OVER w THEN 1.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
_FUSED = f"""{base.CHUNKS}, {base.DOCUMENTS}, {_ASKED}, {_SUBJECTS}, named AS (SELECT query_id, list(value) AS named FROM req JOIN subjects ON contains({T.folded_sql('question')}, value) GROUP BY query_id),
short AS (SELECT *, coalesce(vector_score, 0) AS v, coalesce(lexical_score, 0) AS l, coalesce(rerank_score, 0) AS r, {_OVERLAP('qt_', "concat_ws(' ', path, content)")} AS o FROM asked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(vector_score, 0) DESC, chunk_id) <= 20),
fused AS (SELECT s.*, (0.55 * ({_NORM('r')}) + 0.20 * ({_NORM('v')}) + 0.15 * ({_NORM('l')}) + 0.10 * ({_NORM('o')})) * CASE WHEN named IS NULL OR coalesce(list_contains(named, lower(s.subject)), false) THEN 1.0 ELSE 0.25 END AS score FROM short s LEFT JOIN named USING (query_id) WINDOW w AS (PARTITION BY query_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS position FROM fused QUALIFY position <= 8)"""


def _fused(spark: SparkSession, d: str, texts: bool = False) -> DataFrame:
    """The eight best of each request; texts: with the content of those, read at the end."""
    short = written(rerank.shortlist(_asked(spark, d), "query_id"), "shortlist")
    best = rerank.fusion(_gated(spark, d, _read(spark, d, short)), "query_id", 8)
    best = written(best, "best") if texts else best
    return best.join(base.chunks(spark, d, "content", of=best).select("chunk_id", "content"), "chunk_id", "left") if texts else best


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, position, round(score + 1e-9, 6) AS score FROM best")
def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The logged rerank score stands in for the cross-encoder's."""
    return _fused(spark, d).select("query_id", "chunk_id", "position", F.round(F.col("fused_score") + 1e-9, 6).alias("score"))


@query(f"WITH {_FUSED} SELECT query_id, position, source_file, subject, page_number AS page, array_to_string(coalesce(hierarchy_path, []), ' > ') AS section, round(coalesce(vector_score, 0) + 1e-9, 4) AS vector_score, round(coalesce(lexical_score, 0) + 1e-9, 4) AS lexical_score, round(score + 1e-9, 4) AS score, content FROM best")
def search_api(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, texts=True).select(
        "query_id", "position", "source_file", "subject", F.col("page_number").alias("page"), F.array_join(F.coalesce("hierarchy_path", F.array().cast("array<string>")), " > ").alias("section"),
        F.round(F.coalesce("vector_score", F.lit(0.0)) + 1e-9, 4).alias("vector_score"), F.round(F.coalesce("lexical_score", F.lit(0.0)) + 1e-9, 4).alias("lexical_score"), F.round(F.col("fused_score") + 1e-9, 4).alias("score"), "content",
    )


_BLOCK = "'[' || position || '] (' || source_file || ', p.' || CASE WHEN page_number IS NULL OR page_number = 0 THEN '?' ELSE CAST(page_number AS VARCHAR) END || CASE WHEN len(coalesce(hierarchy_path, [])) > 0 THEN ' — ' || array_to_string(hierarchy_path, ' > ') ELSE '' END || ')' || chr(10) || coalesce(content, '')"


@query(f"""WITH {_FUSED}, b AS (SELECT query_id, position, {_BLOCK} AS block FROM best), r AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) AS total FROM b)
SELECT query_id, position, block FROM r WHERE total <= 8000 OR position = 1""")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d, texts=True).withColumn("block", context.block(F.col("position"), F.col("source_file"), F.col("page_number"), F.col("hierarchy_path"), F.col("content")))
    return context.within_budget(rows, "query_id", "position", "block", 8000).select("query_id", "position", "block")


@query(f"""WITH {_FUSED}, b AS (SELECT *, sum(length({_BLOCK})) OVER (PARTITION BY query_id ORDER BY position) AS total FROM best)
SELECT query_id, string_agg(position || ':' || source_file || ':' || coalesce(CAST(page_number AS VARCHAR), ''), ';' ORDER BY position) AS cited FROM b WHERE total <= 8000 OR position = 1 GROUP BY query_id""")
def sources(spark: SparkSession, d: str) -> DataFrame:
    rows = _fused(spark, d, texts=True).withColumn("block", context.block(F.col("position"), F.col("source_file"), F.col("page_number"), F.col("hierarchy_path"), F.col("content")))
    kept = context.within_budget(rows, "query_id", "position", "block", 8000)
    each = F.concat_ws(":", F.col("position").cast("string"), "source_file", F.coalesce(F.col("page_number").cast("string"), F.lit("")))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", each.alias("e")))), lambda x: x["e"]), ";").alias("cited"))


@query(f"WITH {_FUSED} SELECT r.subject, b.query_id, b.chunk_id, row_number() OVER (PARTITION BY r.subject ORDER BY b.query_id, b.position) AS number FROM best b JOIN search_requests r USING (query_id) WHERE r.subject IS NOT NULL")
def continuous_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Sources numbered on across the searches of a turn; requests of one stated subject stand in for a turn."""
    turns = table(spark, d, "search_requests").where("subject is not null").select("query_id", F.col("subject").alias("turn"))
    rows = _fused(spark, d).select("query_id", "chunk_id", "position").join(turns, "query_id")
    by = Window.partitionBy("turn").orderBy("query_id", "position")
    return rows.select(F.col("turn").alias("subject"), "query_id", "chunk_id", F.row_number().over(by).alias("number"))


_VALUES = "SELECT DISTINCT facet, value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, lower({c}) AS value FROM doc" for c in facets.FACETS) + ") WHERE value IS NOT NULL AND value <> ''"


@query(f"WITH {base.DOCUMENTS} {_VALUES}")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return facets.facet_values(base.documents(spark, d, *facets.FACETS))


_SYNONYMS = "CASE f " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in facets.SYNONYMS.items()) + " ELSE f END"


@query(f"""WITH {base.DOCUMENTS}, vals AS MATERIALIZED ({_VALUES}), val AS MATERIALIZED (SELECT facet, value, {T.folded_sql('value')} AS d FROM vals), {_REQ},
stated AS (SELECT DISTINCT 'subject' AS facet, qs AS stated FROM req WHERE qs IS NOT NULL UNION SELECT 'level', ql FROM req WHERE ql IS NOT NULL UNION SELECT 'track', qt FROM req WHERE qt IS NOT NULL),
folded AS MATERIALIZED (SELECT facet, stated, {T.folded_sql('stated')} AS f FROM stated), form AS (SELECT facet, stated, CASE WHEN facet = 'subject' THEN {_SYNONYMS} ELSE f END AS v FROM folded),
met AS (SELECT form.facet, stated, value, CASE WHEN v = d THEN 1 WHEN starts_with(d, v) OR starts_with(v, d) THEN 2 WHEN length(v) >= 4 AND length(d) >= 4 AND left(v, 4) = left(d, 4) THEN 3 END AS rank FROM form JOIN val ON form.facet = val.facet)
SELECT facet, stated, value FROM met WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY facet, stated ORDER BY rank, value) = 1""")
def facet_align(spark: SparkSession, d: str) -> DataFrame:
    values = facets.facet_values(base.documents(spark, d, *facets.FACETS))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("stated")) for c in ("subject", "level", "track")])).alias("p")
    stated = base.requests(spark, d).select(pairs).select("p.*").where("stated is not null")
    return facets.align(stated, values)


@query(f"""WITH {base.DOCUMENTS}, vals AS MATERIALIZED ({_VALUES}), val AS MATERIALIZED (SELECT facet, value, regexp_replace({T.folded_sql('value')}, '[^a-z0-9_]+', ' ', 'g') AS d FROM vals WHERE length({T.folded_sql('value')}) > 0),
asked AS MATERIALIZED (SELECT query_id, ' ' || regexp_replace({T.folded_sql('question')}, '[^a-z0-9_]+', ' ', 'g') || ' ' AS q FROM search_requests)
SELECT query_id, facet, min(value) AS value FROM asked JOIN val ON contains(q, ' ' || d || ' ') GROUP BY query_id, facet""")
def detect_filters(spark: SparkSession, d: str) -> DataFrame:
    values = facets.facet_values(base.documents(spark, d, *facets.FACETS))
    return facets.mentioned(table(spark, d, "search_requests"), "query_id", "question", values)


_FIT = {c: f"({q} IS NULL OR coalesce({_UNACCENT('c.' + c)} = {_UNACCENT(q)}, false))" for c, q in (("subject", "qs"), ("level", "ql"), ("track", "qt"))}


@query(f"""WITH {_REQ}, {_CAND}, a AS (SELECT c.query_id, chunk_id, CASE WHEN {_FIT['subject']} AND {_FIT['level']} AND {_FIT['track']} THEN 1 WHEN {_FIT['subject']} AND {_FIT['level']} THEN 2 WHEN {_FIT['subject']} THEN 3 ELSE 4 END AS attempt FROM cand c JOIN req USING (query_id))
SELECT query_id, chunk_id, attempt FROM a QUALIFY rank() OVER (PARTITION BY query_id ORDER BY attempt) = 1""")
def filter_relaxation(spark: SparkSession, d: str) -> DataFrame:
    """All filters, then without the track, then the subject alone, then none: the first attempt that finds candidates."""
    req = base.requests(spark, d).select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("subject", "level", "track")])
    fit = {c: facets.same(F.col(c), F.col(f"q_{c}")) for c in ("subject", "level", "track")}
    attempt = F.when(fit["subject"] & fit["level"] & fit["track"], 1).when(fit["subject"] & fit["level"], 2).when(fit["subject"], 3).otherwise(4)
    rows = base.candidates(spark, d).join(req, "query_id").select("query_id", "chunk_id", attempt.alias("attempt"))
    return facets.relaxed(rows, "query_id")


QUERIES = Q
