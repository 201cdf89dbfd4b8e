"""Queries on text expressions and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import identity, store
from lexgrain.plans import base
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


@query(f"SELECT doc_id, {T.content_hash_sql('text')} AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("content_hash"))


@query(f"""WITH {base.CHUNKS} SELECT chunk_id, left(sha256(CASE WHEN coalesce(sub_document_id, '') <> '' THEN source_file || '#' || sub_document_id ELSE source_file END), 16) AS new_document_id,
left(sha256(document_id || ':' || coalesce(page_number, 0) || ':' || chunk_order), 24) AS new_chunk_id FROM ch""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = base.chunks(spark, d, "document_id", "source_file", "sub_document_id", "page_number", "chunk_order")
    return c.select("chunk_id", T.document_id(F.col("source_file"), F.col("sub_document_id")).alias("new_document_id"), T.chunk_id(F.col("document_id"), F.col("page_number"), F.col("chunk_order")).alias("new_chunk_id"))


@query(f"WITH {base.DOCUMENTS} SELECT document_id, {T.normalize_key_sql('subject')} AS subject_key, {T.normalize_key_sql('source_file')} AS file_key, {T.match_form_sql('source_file')} AS file_form FROM doc")
def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    c = base.documents(spark, d, "subject", "source_file")
    return c.select("document_id", T.normalize_key("subject").alias("subject_key"), T.normalize_key("source_file").alias("file_key"), T.match_form("source_file").alias("file_form"))


@query(f"SELECT doc_id, {T.fold_sql('text')} AS folded FROM documents")
def strip_accents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold("text").alias("folded"))


@query(f"""SELECT query_id, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]), ' | ') AS or_query
FROM (SELECT query_id, {T.all_terms_sql('question')} AS t FROM search_requests)""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_requests").select("query_id", T.or_query("question").alias("or_query"))


@query(f"SELECT doc_id, {T.detect_language_sql('text')} AS detected FROM documents WHERE text IS NOT NULL")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.detect_language("text").alias("detected"))


@query(f"""WITH {base.CHUNKS} SELECT chunk_id, sha256(CASE WHEN regexp_matches(content, '[Ž¥ƒˆÕ]') THEN translate(content, 'Ž¥ˆƒÕ™”‘', 'é•àÉ''ôîë') ELSE content END) AS repaired_hash FROM ch WHERE content IS NOT NULL""")
def repair_encoding(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "content").where("content is not null").select("chunk_id", F.sha2(T.repair_encoding("content"), 256).alias("repaired_hash"))


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^{T.SPACES}+', ''), '{T.SPACES}+$', '')"
_BREAKS = r"\r\n|[\n\x{0B}\x{0C}\r\x{85}\x{2028}\x{2029}]"
_RTRIM_LINES = lambda x: f"list_transform(string_split_regex({x}, '{_BREAKS}'), lambda l: regexp_replace(l, '{T.SPACES}+$', ''))"
_SP = T.SPACES


@query(rf"""WITH a AS (SELECT doc_id, translate(text, '‘’“”«»–—', repeat(chr(39), 2) || repeat(chr(34), 4) || '--') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\p{{Nd}}+\.?{_SP}+)(?:(?:{_SP}|[;,])*\p{{Nd}}+\.?{_SP}+)+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '(\p{{Nd}}+\.{_SP}+)(?:\p{{Nd}}+\.{_SP}+)+', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '-{_SP}+', '- ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT doc_id, sha256({_TRIM(f"array_to_string({_RTRIM_LINES('t')}, chr(10))")}) AS cleaned_hash FROM c""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.clean_text("text"), 256).alias("cleaned_hash"))


_TWICE = lambda x, p, to: f"regexp_replace(regexp_replace({x}, '{p}', '{to}', 'g'), '{p}', '{to}', 'g')"
_MISREAD = _TWICE(_TWICE(_TWICE("t", "([a-zà-ÿ])[|]([a-zà-ÿ])", r"\1l\2"), r"(\p{Nd})[oO](\p{Nd})", r"\g0"), "([A-Za-z])0([a-z])", r"\1o\2").replace(r"'\g0'", r"'\1' || '0\2'")


@query(rf"""WITH {base.CHUNKS}, a AS (SELECT chunk_id, regexp_replace(regexp_replace(content, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM ch WHERE content IS NOT NULL),
b AS (SELECT chunk_id, {_MISREAD} AS t FROM a), c AS (SELECT chunk_id, translate(t, '«»“”‘’´`', repeat(chr(34), 4) || repeat(chr(39), 4)) AS t FROM b),
l AS (SELECT chunk_id, list_filter({_RTRIM_LINES('t')}, lambda x: length({_TRIM('x')}) <> 1 OR regexp_matches({_TRIM('x')}, '[\p{{L}}\p{{N}}]')) AS k FROM c)
SELECT chunk_id, sha256({_TRIM("array_to_string(k, chr(10))")}) AS cleaned_hash FROM l""")
def ocr_postprocess(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "content").where("content is not null").select("chunk_id", F.sha2(T.ocr_postprocess("content"), 256).alias("cleaned_hash"))


@query(f"""WITH {base.CHUNKS}, h AS (SELECT chunk_id, content, array_to_string(list_filter([coalesce(subject, ''), coalesce(level, ''), coalesce(track, '')], lambda x: x <> ''), ' ') AS head, coalesce(hierarchy, []) AS path FROM ch WHERE content IS NOT NULL),
f AS (SELECT chunk_id, content, array_to_string(CASE WHEN head <> '' THEN [head] ELSE [] END || path, ' > ') AS line FROM h)
SELECT chunk_id, sha256(CASE WHEN line <> '' THEN line || chr(10) || chr(10) || content ELSE content END) AS context_hash, line FROM f""")
def contextualized_text(spark: SparkSession, d: str) -> DataFrame:
    c = base.chunks(spark, d, "content", "subject", "level", "track", "hierarchy").where("content is not null")
    cols = [F.col(x) for x in ("subject", "level", "track", "hierarchy")]
    line = F.regexp_replace(T.contextualized(*cols, F.lit("")), "\n\n$", "")
    return c.select("chunk_id", F.sha2(T.contextualized(*cols, F.col("content")), 256).alias("context_hash"), line.alias("line"))


@query(f"WITH {base.CHUNKS} SELECT chunk_id, array_to_string(coalesce(hierarchy, []), ' > ') AS path, len(coalesce(hierarchy, [])) AS depth FROM ch")
def hierarchy_path(spark: SparkSession, d: str) -> DataFrame:
    h = F.coalesce("hierarchy", F.array().cast("array<string>"))
    return base.chunks(spark, d, "hierarchy").select("chunk_id", F.array_join(h, " > ").alias("path"), F.size(h).alias("depth"))


_FORM = lambda x: rf"trim(regexp_replace(replace(replace(lower(strip_accents({x})), '_', ' '), '-', ' '), '\s+', ' ', 'g'))"
_KEY = lambda x: f"coalesce(nullif(trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'column')"
_CASE = lambda rules, x: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({x}, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{name}'" for name, keys in rules) + " END"
# the parts of a file name that are neutral, said as a pattern here and as a list in the operator
_NEUTRAL = "^(?:programmes?|prog|tles?|(?:terminale|premiere|seconde|classe)s?|cycle|officiel|final|version|v?[0-9]+|ls|l[12]|s[123]a?|senegal|men|doc|document|pour|locale|de|du|des|la|le)$"
_SLUG = rf"""parts AS (SELECT document_id, source_file, list_filter(regexp_split_to_array(regexp_replace(source_file, '\.[^.]*$', ''), '[_\-. ]+'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{_NEUTRAL}')) AS left_over FROM doc),
slugged AS MATERIALIZED (SELECT document_id, source_file, CASE WHEN len(left_over) > 0 THEN {_KEY("array_to_string(left_over, ' ')")} END AS slug FROM parts)"""
_REST = lambda x: f"array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({identity.STRUCTURE}, t) AND regexp_full_match(t, '[a-z]+')), '_')"
_CANONICAL = lambda x: f"coalesce({_CASE(identity.SUBJECTS, _FORM(f'coalesce({x}, {chr(39) * 2})'))}, CASE WHEN length({_REST(x)}) >= 3 THEN {_REST(x)} END)"


@query(f"WITH {base.DOCUMENTS}, {_SLUG} SELECT document_id, slug, {_CANONICAL('slug')} AS subject_found FROM slugged")
def identify_subject(spark: SparkSession, d: str) -> DataFrame:
    slug = identity.subject_of_file(F.col("source_file"))
    return base.documents(spark, d, "source_file").select("document_id", slug.alias("slug"), identity.canonical_subject(slug).alias("subject_found"))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """The header text of every source document."""
    from lexgrain.operators.layout import header_text

    return header_text(base.chunks(spark, d, "document_id", "content", "page_number", "chunk_order"), "document_id", "content", "page_number", ["chunk_order", "chunk_id"])


_HEADER_SQL = f"""{base.CHUNKS}, head AS (SELECT document_id, string_agg(content, chr(10) ORDER BY chunk_order, chunk_id) AS header FROM ch
WHERE (page_number IS NULL OR page_number <= 6) AND trim(content) <> '' GROUP BY document_id)"""


@query(f"WITH {_HEADER_SQL} SELECT document_id, sha256(header) AS header_hash, length(header) AS header_length FROM head")
def header_text(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("document_id", F.sha2("header", 256).alias("header_hash"), F.length("header").alias("header_length"))


_FIRST = "QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) = 1"
_VOTE = lambda name, pattern: f"""{name}_each AS (SELECT document_id, unnest(regexp_extract_all(p, '{pattern}', 1)) AS v, generate_subscripts(regexp_extract_all(p, '{pattern}', 1), 1) AS i FROM plain),
{name} AS (SELECT document_id, v, count(*) AS n, min(i) AS first FROM {name}_each GROUP BY document_id, v {_FIRST})"""  # noqa: E731
_TITLE = r"(?i)programmes?\s+d[e''’]\s*([a-z][a-z\s''’-]{2,45}?)(?:\s*(?:du|de\s|des\s|pour|en\s|a\s|classe|terminale|premier|serie|[-–—.,;:(\n])|$)"
_SERIES = r"(?i)\bseries?\s+([LSG][0-9]?[A-Z]?(?:\s*(?:et|&|,|/)\s*[LSG][0-9]?[A-Z]?){0,3})\b"
_QUOTED = r"[«\"“''‘]\s*([LSG][0-9]?[A-Z]?)\s*[»\"”''’]".replace("\\\"", '"')
_IDENTITY_SQL = rf"""WITH {_HEADER_SQL}, {base.DOCUMENTS}, {_SLUG}, plain AS MATERIALIZED (SELECT document_id, coalesce(header, '') AS h, coalesce(strip_accents(header), '') AS p FROM doc LEFT JOIN head USING (document_id)),
{_VOTE('years', r'\b((?:19[6-9]|20[0-9])[0-9])\b')}, {_VOTE('quoted', _QUOTED)},
title_each AS (SELECT document_id, {_KEY('v')} AS v, i FROM (SELECT document_id, unnest(regexp_extract_all(p, '{_TITLE}', 1)) AS v, generate_subscripts(regexp_extract_all(p, '{_TITLE}', 1), 1) AS i FROM plain)),
titles AS (SELECT document_id, v, count(*) AS n, min(i) AS first FROM title_each WHERE NOT list_contains({identity.GENERIC}, v) AND length(v) BETWEEN 3 AND 45 GROUP BY document_id, v {_FIRST}),
one AS MATERIALIZED (SELECT s.document_id, s.source_file, p, h, {_CANONICAL('s.slug')} AS named, t.v AS title, y.v AS year, q.v AS quoted FROM slugged s JOIN plain USING (document_id) LEFT JOIN titles t USING (document_id) LEFT JOIN years y USING (document_id) LEFT JOIN quoted q USING (document_id)),
told AS (SELECT *, coalesce({_CASE(identity.TYPES, _FORM('source_file'))}, CASE WHEN contains(lower(left(p, 2000)), 'corrige') THEN 'corrige' ELSE 'inconnu' END) AS kind,
CASE WHEN title IS NOT NULL THEN coalesce({_CANONICAL('title')}, title) END AS of_text,
coalesce(regexp_replace(lower(nullif(regexp_extract(p, '(?i)\b(terminales?|premieres?|secondes?|cm[12]|ce[12]|cp|ci)\b', 1), '')), 's+$', ''), CASE WHEN regexp_matches(source_file, '(?i)[_-](?:tle|terminale)s?[_.-]') THEN 'terminale' END) AS raw_level,
regexp_replace(nullif(regexp_extract(p, '{_SERIES}', 1), ''), '\s+', ' ', 'g') AS announced,
nullif(regexp_extract(source_file, '(?i)[_-](LS|[LSG][0-9]?)(?:[_.-]|$)', 1), '') AS of_file, lower(nullif(regexp_extract(p, '(?i)\b(elementaire|moyen|secondaire|prescolaire|superieur)\b', 1), '')) AS stated FROM one)"""


@query(f"""{_IDENTITY_SQL} SELECT document_id, kind, coalesce(named, of_text) AS subject, CASE WHEN named IS NOT NULL THEN 'filename' WHEN of_text IS NOT NULL THEN 'content' ELSE 'unknown' END AS subject_source, {T.detect_language_sql('h')} AS language,
CASE WHEN kind IN ('sujet', 'corrige') AND (raw_level IS NULL OR raw_level IN ('ci', 'cp', 'ce1', 'ce2', 'cm1', 'cm2')) THEN 'terminale' ELSE raw_level END AS level, upper(coalesce(quoted, CASE WHEN length(announced) <= 12 THEN announced END, of_file)) AS track,
coalesce(stated, CASE WHEN raw_level IN ('terminale', 'premiere', 'seconde') THEN 'secondaire' END) AS cycle, CAST(year AS INTEGER) AS program_year FROM told""")
def identify_level_track_year(spark: SparkSession, d: str) -> DataFrame:
    """All that is told of a document by its file name and first pages."""
    heads = _headers(spark, d).select("document_id", "header", T.fold("header").alias("plain"))
    both = base.documents(spark, d, "source_file").join(heads, "document_id", "left")
    both = both.select("document_id", F.col("source_file").alias("f"), F.coalesce("header", F.lit("")).alias("t"), F.coalesce("plain", F.lit("")).alias("p"))
    f, p = F.col("f"), F.col("p")
    found = both.select(
        "document_id", identity.document_type(f, p).alias("kind"), identity.level(f, p).alias("raw_level"), identity.track(f, p).alias("track"), identity.year(p).alias("program_year"), identity.subject(f, p).alias("s"),
        T.detect_language("t").alias("language"), F.regexp_extract(p, identity._CYCLE, 0).alias("c"),
    )
    return found.select(
        "document_id", "kind", F.col("s.name").alias("subject"), F.col("s.source").alias("subject_source"), "language", identity.infer_level(F.col("raw_level"), F.col("kind")).alias("level"), "track",
        identity.cycle(F.col("raw_level"), F.col("c")).alias("cycle"), "program_year",
    )


@query(f"{_IDENTITY_SQL} SELECT document_id, kind FROM told")
def identify_type(spark: SparkSession, d: str) -> DataFrame:
    heads = _headers(spark, d).select("document_id", T.fold("header").alias("plain"))
    return base.documents(spark, d, "source_file").join(heads, "document_id", "left").select("document_id", identity.document_type(F.col("source_file"), F.col("plain")).alias("kind"))


@query(f"""WITH {_HEADER_SQL}, y AS (SELECT document_id, unnest(regexp_extract_all(header, '\\b(?:19[6-9]\\d|20[0-9]\\d)\\b')) AS v, generate_subscripts(regexp_extract_all(header, '\\b(?:19[6-9]\\d|20[0-9]\\d)\\b'), 1) AS i FROM head),
c AS (SELECT document_id, v, count(*) AS n, min(i) AS first FROM y GROUP BY ALL)
SELECT document_id, CAST(v AS INTEGER) AS year FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) = 1""")
def majority_year(spark: SparkSession, d: str) -> DataFrame:
    return _headers(spark, d).select("document_id", identity.year(F.col("header")).alias("year")).where("year is not null")


@query(f"""WITH {base.CHUNKS}, big AS (SELECT document_id, chunk_id, chunk_order, char_count FROM ch WHERE length(trim(content)) >= 80)
SELECT chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_order, chunk_id) - 1 AS new_order FROM big""")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kept = base.chunks(spark, d, "document_id", "chunk_order", "content").where(F.length(F.trim("content")) >= 80)
    return kept.select("chunk_id", (F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_order", "chunk_id")) - 1).alias("new_order"))


@query(f"""WITH {base.CHUNKS}, t AS (SELECT document_id, count(*) AS n, count(*) FILTER (chunk_type IN ('table_block', 'table_row')) AS tables, count(*) FILTER (chunk_type IN ('list', 'heading')) AS lists FROM ch GROUP BY document_id)
SELECT document_id, CASE WHEN tables / n >= 0.4 THEN 'tabular' WHEN lists / n >= 0.4 THEN 'structured' ELSE 'narrative' END AS profile FROM t""")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "document_id", "chunk_type").groupBy("document_id").agg(store.profile(F.col("chunk_type")).alias("profile"))


@query(f"WITH {base.CHUNKS} SELECT document_id, chunk_type, count(*) AS n FROM ch GROUP BY ALL")
def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d, "document_id", "chunk_type").groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"))


@query(f"WITH {base.CHUNKS} SELECT subject, CAST(floor(sum(char_count) / count(char_count)) AS BIGINT) AS mean_size, min(char_count) AS least, max(char_count) AS most FROM ch GROUP BY subject")
def size_stats(spark: SparkSession, d: str) -> DataFrame:
    c = base.chunks(spark, d, "subject", "char_count")
    return c.groupBy("subject").agg(F.floor(F.sum("char_count") / F.count("char_count")).alias("mean_size"), F.min("char_count").alias("least"), F.max("char_count").alias("most"))


QUERIES = Q
