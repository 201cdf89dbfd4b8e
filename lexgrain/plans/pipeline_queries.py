"""Queries of the ingestion pipeline's smaller parts, of model contracts and of the whole retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.functions.vectors import cosine
from lexgrain.operators import facets, layout, lexical_search, models, rerank, store, vector_search
from lexgrain.plans import base, retrieval_queries as R
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


# Pages -----------------------------------------------------------------------------------------------------------------------

_PAGES = "pages AS (SELECT document_id, page_number, min(length(content)) AS chars, sum(length(content)) % 240 AS paths, count(*) FILTER (extraction_method = 'ocr_tesseract') / count(*) AS image_share FROM ch WHERE document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY document_id, page_number)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with signals: the shortest text, a number of paths made from all of its texts, and the share of texts read by OCR."""
    c = base.chunks(spark, d, "document_id", "page_number", "extraction_method", n=F.length("content")).where("document_id is not null and page_number is not null")
    return c.groupBy("document_id", "page_number").agg(F.min("n").alias("chars"), (F.sum("n") % 240).alias("paths"), (F.count_if(F.col("extraction_method") == "ocr_tesseract") / F.count("*")).alias("image_share"))


@query(f"WITH {base.CHUNKS}, {_PAGES} SELECT document_id, page_number, chars < 60 AND (image_share >= 0.5 OR paths >= 120) AS scanned FROM pages")
def scanned_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("document_id", "page_number", layout.is_scanned(F.col("chars"), F.col("paths"), F.col("image_share")).alias("scanned"))


@query(f"""WITH {base.CHUNKS}, w AS (SELECT chunk_id, unnest(string_split(content, ' ')) AS word FROM ch WHERE content IS NOT NULL), c AS (SELECT chunk_id, word, (length(word) * 37) % 131 - 20 AS conf FROM w),
s AS (SELECT chunk_id, coalesce(avg(conf) FILTER (conf >= 0 AND trim(word) <> ''), 0) / 100 AS score, count(*) FILTER (conf >= 0 AND trim(word) <> '') AS n FROM c GROUP BY chunk_id)
SELECT chunk_id, round(score + 1e-9, 6) AS score, CASE WHEN n > 0 AND score >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM s""")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Words of all chunks with confidences made from their lengths, some negative."""
    words = F.split("content", " ")
    c = base.chunks(spark, d, "content").where("content is not null").select("chunk_id", words.alias("w"), F.transform(words, lambda w: (F.length(w) * 37) % 131 - 20).alias("c"))
    got = layout.ocr_confidence(F.col("c"), F.col("w"))
    return c.select("chunk_id", got.alias("g")).select("chunk_id", F.round(F.col("g.score") + 1e-9, 6).alias("score"), F.col("g.level").alias("level"))


_RESCUE = 1200


@query(f"""WITH {base.CHUNKS}, p AS (SELECT document_id, page_number, bool_or(extraction_method = 'ocr_tesseract') AS scanned, bool_or(length(trim(content)) >= {_RESCUE}) AS with_text FROM ch WHERE page_number IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL)
SELECT document_id, page_number FROM p WHERE scanned AND NOT coalesce(with_text, false)""")
def ocr_pages_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages without a text of some length, to be recognised one by one."""
    c = base.chunks(spark, d, "document_id", "page_number", "extraction_method", n=F.length(F.trim("content"))).where("page_number is not null and document_id is not null")
    return layout.rescue_pages(c.where("extraction_method = 'ocr_tesseract'"), c.where(F.col("n") >= _RESCUE), ["document_id", "page_number"])


@query(f"""WITH {base.CHUNKS}, p AS (SELECT source_file, page_number, sum(char_count) AS size, min(content_hash) AS text FROM ch WHERE page_number IS NOT NULL GROUP BY ALL),
k AS (SELECT *, left(sha256(source_file || ':' || size || ':' || page_number || ':' || page_number || ':' || 6), 20) AS key FROM p), cache AS (SELECT key, text FROM k WHERE page_number % 2 = 0 AND text IS NOT NULL)
SELECT source_file, page_number, cache.key IS NOT NULL AS hit, cache.text, CASE WHEN cache.key IS NOT NULL THEN 'medium' END AS reliability, CASE WHEN cache.key IS NOT NULL THEN 0.85 END AS score FROM k LEFT JOIN cache USING (key) WHERE k.size IS NOT NULL""")
def ocr_cache(spark: SparkSession, d: str) -> DataFrame:
    """Pages against a cache that holds those of even numbers."""
    p = base.chunks(spark, d, "source_file", "page_number", "char_count", "content_hash").where("page_number is not null").groupBy("source_file", "page_number").agg(F.sum("char_count").alias("size"), F.min("content_hash").alias("text"))
    pages = p.where("size is not null").withColumn("key", layout.cache_key(F.col("source_file"), F.col("size"), F.col("page_number"), F.col("page_number"), F.lit(6)))
    hits, missing = layout.cached_pages(pages.drop("text"), pages.where("page_number % 2 = 0 and text is not null").select("key", "text"), "key", "text")
    cols = ["source_file", "page_number", "hit", "text", "reliability", "score"]
    return hits.withColumn("hit", F.lit(True)).select(cols).unionByName(missing.select("source_file", "page_number", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reliability"), F.lit(None).cast("double").alias("score")))


@query(f"""WITH {base.CHUNKS}, {_PAGES}, sc AS (SELECT document_id, page_number FROM pages WHERE image_share >= 0.5)
SELECT chunk_id, CASE WHEN sc.page_number IS NOT NULL THEN 'medium' ELSE 'high' END AS reliability, CASE WHEN sc.page_number IS NOT NULL THEN 'ocr_tesseract' WHEN chunk_type = 'table_block' THEN 'docling_table' ELSE 'docling' END AS extraction_method
FROM ch LEFT JOIN sc ON ch.document_id = sc.document_id AND ch.page_number = sc.page_number""")
def reliability_gate(spark: SparkSession, d: str) -> DataFrame:
    """Reliability and method of chunks by whether their page is among the scanned ones."""
    c = base.chunks(spark, d, "document_id", "page_number", "chunk_type")
    return layout.with_provenance(c, _pages(spark, d).where("image_share >= 0.5"), ["document_id", "page_number"], F.col("chunk_type")).select("chunk_id", "reliability", "extraction_method")


@query("""SELECT source AS file, CAST(doc_id % 5 AS INTEGER) AS page, sum(CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE 0 END) AS chars, count(*) FILTER (doc_id % 3 = 1) AS paths,
round(coalesce(sum(CASE WHEN doc_id % 3 = 2 THEN n_chars END), 0) / 1000000, 6) AS image_share, count(*) FILTER (doc_id % 3 = 1) >= 120 AS tables FROM documents GROUP BY ALL""")
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the items of pages, a page for each source and rest of five."""
    kind = F.element_at(F.array(F.lit("text"), F.lit("path"), F.lit("image")), (F.col("doc_id") % 3 + 1).cast("int"))
    items = table(spark, d, "documents").select(F.col("source").alias("file"), (F.col("doc_id") % 5).cast("int").alias("page"), kind.alias("kind"), "text", F.col("n_chars").alias("area"), F.lit(1_000_000).alias("page_area"))
    return layout.page_signals(items, ["file", "page"]).select("file", "page", "chars", "paths", F.round("image_share", 6).alias("image_share"), "tables")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id % 97 <> 0), e AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM l)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, CASE WHEN starts_with(text, '-') THEN 'list_item' ELSE 'text' END AS label, sha256(text) AS text_hash, CAST((i - 1) // 40 + 1 AS INTEGER) AS page_no, CAST(NULL AS VARCHAR) AS error FROM e
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'ValueError: damaged' FROM documents WHERE text IS NOT NULL AND doc_id % 97 = 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE text IS NULL""")
def convert_layout(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files through a stand-in layout model that fails on some of them."""

    def load():
        def model(some):
            if any(t.startswith("damaged ") for t in some):
                raise ValueError("damaged")
            return [[{"label": "list_item" if x.startswith("-") else "text", "text": x, "page_no": i // 40 + 1} for i, x in enumerate(t.split("\n"))] for t in some]

        return model

    files = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("damaged "), "text")).otherwise(F.col("text")).alias("text"))
    got = layout.converted(files, "doc_id", "text", load, batch=4)
    return got.select("doc_id", "position", "label", F.sha2("text", 256).alias("text_hash"), "page_no", "error")


@query(f"""WITH {base.CHUNKS}, w AS (SELECT chunk_id, string_split(content, ' ') AS w FROM ch WHERE content IS NOT NULL), c AS (SELECT chunk_id, list_filter(list_transform(w, lambda x: CASE WHEN trim(x) <> '' THEN length(x) * 7 % 100 ELSE -1 END), lambda x: x >= 0) AS c FROM w)
SELECT chunk_id, round(coalesce(list_avg(c), 0) / 100 + 1e-9, 6) AS score, CASE WHEN len(c) > 0 AND list_avg(c) / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS level, CAST(NULL AS VARCHAR) AS error FROM c""")
def ocr_page(spark: SparkSession, d: str) -> DataFrame:
    """Contents as page images through a stand-in that reads their words with confidences made from their lengths."""
    stand_in = lambda: lambda some: [{"words": t.split(" "), "conf": [len(x) * 7 % 100 for x in t.split(" ")]} for t in some]
    c = base.chunks(spark, d, "content").where("content is not null").select("chunk_id", "content")
    return layout.recognised(c, "chunk_id", "content", stand_in, batch=8).select("chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"), "level", "error")


_LABELS = "list_transform(string_split(content, chr(10)), lambda x: CASE WHEN contains(x, ' | ') THEN 'table' WHEN regexp_matches(x, '^\\s*[-*•]\\s') THEN 'list_item' ELSE 'text' END)"


@query(f"""WITH {base.CHUNKS}, l AS (SELECT chunk_id, {_LABELS} AS labels FROM ch WHERE content IS NOT NULL)
SELECT chunk_id, CASE WHEN list_contains(labels, 'table') THEN 'table_block' WHEN len(labels) > 0 AND len(list_filter(labels, lambda x: x <> 'list_item')) = 0 THEN 'list' ELSE 'paragraph' END AS kind FROM l""")
def label_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of chunks by labels told from their lines."""
    label = lambda x: F.when(x.contains(" | "), "table").when(x.rlike(r"^\s*[-*•]\s"), "list_item").otherwise("text")
    c = base.chunks(spark, d, "content").where("content is not null").select("chunk_id", F.transform(F.split("content", "\n"), label).alias("labels"))
    return c.select("chunk_id", layout.chunk_type(F.col("labels")).alias("kind"))


# Headings -------------------------------------------------------------------------------------------------------------------

_HEADINGS = "SELECT chunk_id, list_transform(coalesce(hierarchy, []), lambda x, i: {'title': x, 'depth': CAST(length(x) % 4 AS INTEGER), 'number': CASE WHEN i % 2 = 1 THEN CAST(i AS VARCHAR) ELSE '' END}) AS h FROM ch"


def _headings() -> Column:
    h = F.coalesce("hierarchy", F.array().cast("array<string>"))
    return F.transform(h, lambda x, i: F.struct(x.alias("title"), (F.length(x) % 4).alias("depth"), F.when(i % 2 == 0, (i + 1).cast("string")).otherwise("").alias("number")))


@query(f"""WITH {base.CHUNKS}, e AS ({_HEADINGS}), f AS (SELECT chunk_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM e)
SELECT e.chunk_id, coalesce(string_agg(trim(concat_ws(' ', nullif(x.number, ''), x.title)), ' > ' ORDER BY x.depth, i), '') AS path FROM e LEFT JOIN f USING (chunk_id) GROUP BY e.chunk_id""")
def hierarchy_labels(spark: SparkSession, d: str) -> DataFrame:
    """Headings with depths and numbers made from them, by depth, as text."""
    return base.chunks(spark, d, "hierarchy").select("chunk_id", F.array_join(layout.level_labels(_headings()), " > ").alias("path"))


@query(f"""WITH {base.CHUNKS}, e AS ({_HEADINGS}), f AS (SELECT chunk_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM e),
k AS (SELECT a.chunk_id, a.x, a.i FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.chunk_id = a.chunk_id AND b.i > a.i AND b.x.depth <= a.x.depth))
SELECT e.chunk_id, coalesce(string_agg(k.x.title, ' > ' ORDER BY k.i), '') AS path, count(k.i) AS depth FROM e LEFT JOIN k USING (chunk_id) GROUP BY e.chunk_id""")
def heading_descend(spark: SparkSession, d: str) -> DataFrame:
    """The path that is left when headings come one after another."""
    path = layout.heading_path(_headings())
    return base.chunks(spark, d, "hierarchy").select("chunk_id", path.alias("p")).select("chunk_id", F.array_join(F.transform("p", lambda x: x["title"]), " > ").alias("path"), F.size("p").alias("depth"))


@query(f"""WITH {base.DOCUMENTS} SELECT document_id, len(list_filter(range(1, least(length(source_file), length(subject)) + 1), lambda i: left(lower(source_file), CAST(i AS INTEGER)) = left(lower(subject), CAST(i AS INTEGER)))) AS same,
regexp_replace(upper(trim(subject)), 'S+$', '') AS trimmed FROM doc WHERE subject IS NOT NULL AND source_file IS NOT NULL""")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The length of the start that file name and subject share, and subjects without their edges."""
    c = base.documents(spark, d, "source_file", "subject").where("subject is not null and source_file is not null")
    return c.select("document_id", facets.common_prefix(F.lower("source_file"), F.lower("subject")).alias("same"), F.regexp_replace(F.upper(F.trim("subject")), "S+$", "").alias("trimmed"))


# Exercises ------------------------------------------------------------------------------------------------------------------

_FLAT = lambda x: f"regexp_replace(regexp_replace(replace(lower({x}), ':', ','), '^{T.SPACES}+', ''), '{T.SPACES}+$', '')"
_EXERCISES = f"""e AS (SELECT doc_id, 1 AS i, CAST(doc_id % 20 AS INTEGER) AS points, coalesce(trim(subject), '') AS competence, {_FLAT('text')} AS statement, coalesce(document_type, '') AS correction FROM documents WHERE text IS NOT NULL AND {_FLAT('text')} <> ''
UNION ALL SELECT doc_id, 3, 0, '', 'suite ' || doc_id, '' FROM documents WHERE text IS NOT NULL)"""


def _exams(spark: SparkSession, d: str) -> DataFrame:
    """Exams made of whole texts: an exercise of the text, one without a statement, one without points."""
    t = table(spark, d, "documents").where("text is not null")
    competence = F.when(F.trim(F.coalesce("subject", F.lit(""))) != "", F.concat(F.lit("\nCompetence : "), F.col("subject"))).otherwise("")
    first = F.concat(F.lit("avant\n### EXERCICE\nPOINTS: "), (F.col("doc_id") % 20).cast("string"), competence, F.lit("\nENONCE: "), F.replace(F.lower("text"), F.lit(":"), F.lit(",")), F.lit("\nCORRIGE: "), F.coalesce("document_type", F.lit("")))
    rest = F.concat(F.lit("\n#EXERCICE \npoints: x\nENONCE:\nCORRIGE: rien\nEXERCICE\nEnonce : suite "), F.col("doc_id").cast("string"), F.lit("\nCORRIGE:"))
    from lexgrain.operators import conversation

    return t.select("doc_id", "source", conversation.parse_exercises(F.concat(first, rest)).alias("e"))


@query(f"WITH {_EXERCISES} SELECT doc_id, points, competence, sha256(statement) AS statement_hash, correction FROM e")
def parse_exercises(spark: SparkSession, d: str) -> DataFrame:
    return _exams(spark, d).select("doc_id", F.inline("e")).select("doc_id", "points", "competence", F.sha2("statement", 256).alias("statement_hash"), "correction")


_SECTION = "'## Exercice ' || n || ' (' || points || ' points)' || CASE WHEN competence <> '' THEN ' — ' || competence ELSE '' END || chr(10) || chr(10)"


@query(f"""WITH {_EXERCISES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e),
m AS (SELECT doc_id, string_agg({_SECTION} || statement, chr(10) || chr(10) ORDER BY n) AS parts, string_agg({_SECTION} || CASE WHEN correction = '' THEN '_Corrigé non disponible._' ELSE correction END, chr(10) || chr(10) ORDER BY n) AS solved,
string_agg('| Exercice ' || n || CASE WHEN competence <> '' THEN ' — ' || competence ELSE '' END || ' | ' || points || ' |' || chr(10), '' ORDER BY n) AS scale, sum(points) AS total FROM o GROUP BY doc_id),
h AS (SELECT m.*, '# Exam' || chr(10) || chr(10) || '**Classe :** ' || source || '  —  **Coefficient :** 2' || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS head FROM m JOIN documents USING (doc_id))
SELECT doc_id, CAST(total AS INTEGER) AS total, sha256(head || parts || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Barème' || chr(10) || chr(10) || '| Exercice | Points |' || chr(10) || '|:---|:---:|' || chr(10) || scale || '| **Total** | **' || total || '** |') AS exam_hash,
sha256(head || solved) AS solved_hash FROM h""")
def exam_markdown(spark: SparkSession, d: str) -> DataFrame:
    from lexgrain.operators import conversation

    infos = {"class": F.col("source"), "duration": F.lit(None).cast("string"), "weight": F.lit("2")}
    made = lambda solved: F.sha2(conversation.exam_markdown(F.lit("Exam"), F.col("e"), infos=infos, solved=solved), 256)
    return _exams(spark, d).select("doc_id", conversation.total_points(F.col("e")).alias("total"), made(False).alias("exam_hash"), made(True).alias("solved_hash"))


# The store ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {base.CHUNKS}, {base.DOCUMENTS} SELECT chunk_id FROM ch WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM doc WHERE document_type IS DISTINCT FROM 'administratif' AND document_id IS NOT NULL)")
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks left behind when documents of one type are deleted without them."""
    docs = base.documents(spark, d, "document_type").where("not (document_type <=> 'administratif')")
    return store.orphans(docs, base.chunks(spark, d, "document_id")).select("chunk_id")


@query("SELECT doc_id, e.vec_id IS NOT NULL AS has_vector, coalesce(len(embedding) = 64, false) AS usable, round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def zip_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors joined to documents by id."""
    got = store.with_vectors(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "embeddings"), "vec_id", "embedding", 64)
    return got.select("doc_id", F.col("vector").isNotNull().alias("has_vector"), "usable", F.round(F.try_element_at("vector", F.lit(1)).cast("double"), 4).alias("first"))


@query("SELECT 'no vector' AS problem, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'no row', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def pairing_errors(spark: SparkSession, d: str) -> DataFrame:
    return store.pairing_errors(table(spark, d, "documents"), "doc_id", table(spark, d, "embeddings"), "vec_id")


@query(f"WITH {base.CHUNKS} SELECT chunk_id, upper(subject) AS subject, content_hash FROM ch ORDER BY chunk_id LIMIT 3")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What a delivery of changed subjects would write, its first three rows."""
    c = base.chunks(spark, d, "subject", "content_hash")
    plan = store.upsert(c.limit(0), c.withColumn("subject", F.upper("subject")), "chunk_id", store.CHUNK_UPDATES)
    return store.preview(plan.select("chunk_id", "subject", "content_hash"), ["chunk_id"])


_NEEDED = {"source_documents": ["document_id", "subject", "gaps", "diagnostics", "vector"], "chunks": ["chunk_id", "document_id", "content", "embedding", "metadata", "language_code"], "search_requests": ["query_id", "question", "top_k"]}


@query("WITH need(table_name, column_name) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _NEEDED.items() for c in cs) + ') SELECT n.table_name AS "table", n.column_name AS "column", c.column_name IS NOT NULL AS present FROM need n LEFT JOIN information_schema.columns c USING (table_name, column_name)')
def catalog_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which of the columns that the store needs (and two that it lacks) its tables have."""
    found = {t: table(spark, d, t).columns for t in _NEEDED}
    return spark.createDataFrame(store.column_check(found, _NEEDED), "table string, column string, present boolean")


@query(f"WITH {base.CHUNKS}, t AS (SELECT chunk_id, unnest({T.all_terms_sql('indexed_content')}) AS term FROM ch) SELECT count(DISTINCT term) AS terms, count(DISTINCT (chunk_id, term)) AS postings, count(*) AS occurrences FROM t")
def rebuild_index(spark: SparkSession, d: str) -> DataFrame:
    """The full-text index built anew: postings ordered by term in ranges of it and written; then its statistics, read from it."""
    index = lexical_search.postings(base.chunks(spark, d, "indexed_content"), "chunk_id", "indexed_content")
    stored = written(index.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "index")
    return stored.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


@query(f"WITH {base.CHUNKS} SELECT chunk_id, coalesce(CAST(to_json(hierarchy) AS VARCHAR), '[]') AS hierarchy, coalesce(CAST(to_json(metadata) AS VARCHAR), '{{}}') AS metadata FROM ch")
def json_columns(spark: SparkSession, d: str) -> DataFrame:
    return store.json_columns(base.chunks(spark, d, "hierarchy", "metadata"), ["hierarchy", "metadata"]).select("chunk_id", "hierarchy", "metadata")


_PROPS = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS p FROM events"


@query(f"WITH e AS ({_PROPS}) SELECT event_id, CASE WHEN json_valid(p) THEN len(json_keys(p)) ELSE 0 END AS n, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.' || json_keys(p)[1]) END AS first FROM e")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events, every seventh with its last character lost."""
    p = F.when(F.col("event_id") % 7 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    got = table(spark, d, "events").select("event_id", store.tolerant_json(p).alias("m"))
    return got.select("event_id", F.coalesce(F.size("m"), F.lit(0)).alias("n"), F.try_element_at(F.map_values("m"), F.lit(1)).alias("first"))


@query("SELECT query_id, 16 AS thread_digits, 8 AS document_digits, true AS hex, true AS now FROM search_requests")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    """Random ids and the time of writing: what can be told of them."""
    r = store.stamped(table(spark, d, "search_requests").select("query_id"), "at").withColumns({"t": store.new_id(), "x": store.new_id(8)})
    return r.select("query_id", F.length("t").alias("thread_digits"), F.length("x").alias("document_digits"), F.concat("t", "x").rlike("^[0-9a-f]+$").alias("hex"), (F.abs(F.unix_timestamp("at") - F.unix_timestamp(F.current_timestamp())) < 3600).alias("now"))


# Models ---------------------------------------------------------------------------------------------------------------------


@query("SELECT query_id, chunk_id, round(max(1 / (1 + exp(lexical_score - vector_score))), 6) AS share FROM candidates WHERE NOT isnan(lexical_score) AND NOT isnan(vector_score) GROUP BY ALL")
def softmax_pair(spark: SparkSession, d: str) -> DataFrame:
    """The share of yes, with two scores of each candidate as logits."""
    c = base.candidates(spark, d).where("lexical_score is not null and vector_score is not null")
    return c.select("query_id", "chunk_id", F.round(models.yes_share(F.col("vector_score"), F.col("lexical_score")), 6).alias("share"))


@query("""SELECT query_id, CASE WHEN question NOT LIKE '%?' THEN round((length(question) + 3) / sqrt((length(question) + 3) * (length(question) + 3) + 1.0), 6) END AS first,
CASE WHEN question LIKE '%?' THEN 'the vector has 3 numbers, not 2' END AS error FROM search_requests""")
def embed_contract(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their instruction through a stand-in model that returns a number too many for some."""
    stand_in = lambda: lambda some: [[float(len(t)), 1.0] + [0.0] * t.endswith("?") for t in some]
    got = models.embed(table(spark, d, "search_requests"), "query_id", "question", stand_in, 2, "Q: ")
    return got.select("query_id", F.round(F.col("vector")[0], 6).alias("first"), "error")


@query(f"""WITH {R._CAND}, {R._REQ}, h AS (SELECT c.query_id, chunk_id, question, concat_ws(' ', nullif(subject, ''), nullif(array_to_string(coalesce(hierarchy_path, []), ' > '), '')) AS head FROM cand c JOIN req USING (query_id))
SELECT query_id, chunk_id, round(1 / (1 + exp(0.5 - length(concat_ws(chr(10), question, nullif(head, ''), 'x')) % 10 / 10)), 6) AS score FROM h""")
def cross_encoder_contract(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of question and candidate through a stand-in model with two logits."""
    stand_in = lambda: lambda some: [[len(t) % 10 / 10, 0.5] for t in some]
    pairs = base.candidates(spark, d).join(base.requests(spark, d).select("query_id", "question"), "query_id").withColumn("content", F.lit("x"))
    return models.cross_scores(pairs, ["query_id", "chunk_id"], "question", "subject", "hierarchy_path", "content", stand_in).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT query_id, 'user: ' || question || ' (0.2, 1500)' AS answer, CAST(NULL AS VARCHAR) AS error FROM search_requests WHERE question IS NOT NULL")
def chat_contract(spark: SparkSession, d: str) -> DataFrame:
    """Questions under a system message through a stand-in that repeats the last message and the settings."""

    def load():
        import json

        def model(some):
            got = [json.loads(t) for t in some]
            return [f"{x['messages'][-1]['role']}: {x['messages'][-1]['content']} ({x['temperature']}, {x['max_tokens']})" for x in got]

        return model

    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    r = table(spark, d, "search_requests").where("question is not null").select("query_id", F.array(message("system", F.lit("Réponds.")), message("user", F.col("question"))).alias("m"))
    return models.chat(r, "query_id", "m", load)


@query(f"SELECT doc_id, {T.normalize_key_sql('source')} || '-' || doc_id || '.docx' AS file_name, octet_length(encode(text)) AS size, CAST(NULL AS VARCHAR) AS error FROM documents")
def render_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files of a stand-in converter."""
    stand_in = lambda: lambda some: [t.encode() for t in some]
    got = models.rendered(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", stand_in)
    return got.select("doc_id", "file_name", F.octet_length("content").cast("long").alias("size"), "error")


# Retrieval as a whole -------------------------------------------------------------------------------------------------------

_USABLE = "len(embedding) = 64 AND isfinite(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0"
_SEARCH = f"""{base.CHUNKS}, {R._REQ}, {R._POST}, qv AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS q FROM search_requests JOIN embeddings ON vec_id = query_id % 100),
cv AS MATERIALIZED (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM ch WHERE {_USABLE}), sim AS MATERIALIZED (SELECT query_id, chunk_id, list_cosine_similarity(e, q) AS s FROM cv, qv),
vec AS (SELECT query_id, chunk_id, s AS vector_score FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) <= 30),
lex AS (SELECT query_id, chunk_id, sum(tf) * 0.1 AS lexical_score FROM post JOIN asked USING (term) GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, chunk_id) <= 30),
hyb AS MATERIALIZED (SELECT query_id, chunk_id, coalesce(vector_score, s, 0) AS vector_score, coalesce(lexical_score, 0) AS lexical_score FROM vec FULL OUTER JOIN lex USING (query_id, chunk_id) LEFT JOIN sim USING (query_id, chunk_id))"""


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, chunk_id, vector_score, lexical_score``: 30 of each channel, merged, with the missing cosines looked up. A stored vector for
    each question stands in for the model's."""
    requests = base.requests(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("query_vector"))
    asked = requests.select("query_id").join(vectors, F.col("query_id") % 100 == F.col("v")).select("query_id", "query_vector")
    chunks = base.chunks(spark, d, "embedding")
    vec = vector_search.top_k_batch(chunks, "chunk_id", "embedding", asked, "query_id", "query_vector", 30, 64).select("query_id", "chunk_id", F.col("score").alias("vector_score"))
    lex = R._best(spark, d).select("query_id", "chunk_id", "lexical_score")
    merged = written(vec.join(lex, ["query_id", "chunk_id"], "full_outer"), "hybrid")
    lacking = merged.where("vector_score is null").select("query_id", "chunk_id")
    own = base.chunks(spark, d, "embedding", of=lacking).select("chunk_id", "embedding")
    found = lacking.join(own, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("query_vector")).alias("own"))
    filled = merged.join(found, ["query_id", "chunk_id"], "left")
    return filled.select("query_id", "chunk_id", F.coalesce("vector_score", F.when(~F.isnan("own"), F.col("own")), F.lit(0.0)).alias("vector_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"))


@query(f"WITH {_SEARCH} SELECT query_id, chunk_id, round(vector_score, 4) + 0.0 AS vector_score, round(lexical_score, 4) AS lexical_score FROM hyb")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors and full text over all chunks, merged and filled up."""
    return _searched(spark, d).select("query_id", "chunk_id", (F.round("vector_score", 4) + 0.0).alias("vector_score"), F.round("lexical_score", 4).alias("lexical_score"))


_OVER = "CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, list_distinct(" + T.all_terms_sql("concat_ws(' ', array_to_string(coalesce(hierarchy, []), ' '), content)") + "))) / len(qt) ELSE 0.0 END"


@query(f"""WITH {_SEARCH}, {base.DOCUMENTS}, {R._SUBJECTS}, named AS (SELECT query_id, list(value) AS named FROM req JOIN subjects ON contains({T.folded_sql('question')}, value) GROUP BY query_id),
k AS (SELECT query_id, coalesce(nullif(top_k, 0), 8) AS k, list_distinct({T.all_terms_sql('question')}) AS qt FROM search_requests),
short AS (SELECT hyb.*, subject, k, {_OVER} AS o FROM hyb JOIN ch USING (chunk_id) JOIN k USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, chunk_id) <= 20),
r AS (SELECT *, 1 / (1 + exp(0.5 - o)) AS r FROM short),
fused AS (SELECT r.*, (0.55 * ({R._NORM('r')}) + 0.20 * ({R._NORM('vector_score')}) + 0.15 * ({R._NORM('lexical_score')}) + 0.10 * ({R._NORM('o')})) * CASE WHEN named IS NULL OR coalesce(list_contains(named, lower(subject)), false) THEN 1.0 ELSE 0.25 END AS score FROM r LEFT JOIN named USING (query_id) WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS position FROM fused QUALIFY position <= k""")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The whole retrieval: hybrid search, the 20 nearest, fusion of four signals, as many as each request asks for. The share of yes of the
    term overlap stands in for the cross-encoder."""
    found = _searched(spark, d).withColumn("vector_score", F.round("vector_score", 9))
    short = written(rerank.shortlist(found, "query_id"), "shortlist")
    facts = base.chunks(spark, d, "subject", "hierarchy", of=short).withColumnRenamed("hierarchy", "hierarchy_path").drop("created_at")
    asked = base.requests(spark, d).select("query_id", "k", T.terms("question").alias("query_terms"))
    rows = R._read(spark, d, short).join(facts, "chunk_id").join(asked, "query_id")
    own = F.array_union(rerank._path_terms(), F.coalesce("content_terms", F.array().cast("array<string>")))
    scored = rows.withColumn("rerank_score", models.yes_share(rerank.overlap(F.col("query_terms"), own), F.lit(0.5)))
    best = rerank.fusion(R._gated(spark, d, scored), "query_id", 20)
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", 6)), "chunk_id")
    return best.withColumn("position", F.row_number().over(by)).where("position <= k").select("query_id", "chunk_id", "position")


QUERIES = Q
