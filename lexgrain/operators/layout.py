"""Pages and layout items: scanned pages, confidence, header text, chunking by tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.text import ocr_postprocess
from lexgrain.operators.models import apply_model


def is_scanned(chars: Column, paths: Column, image_share: Column) -> Column:
    """Hardly any native text and either a large image or many vector paths."""
    return (chars < 60) & ((image_share >= 0.5) | (paths >= 120))


def ocr_confidence(conf: Column, words: Column) -> Column:
    """Mean confidence of recognised words between 0 and 1, with its level: medium from 0.6, else low; 0 and low for none."""
    pairs = F.filter(F.arrays_zip(conf.alias("c"), words.alias("w")), lambda p: (p["c"] >= 0) & (F.trim(p["w"]) != ""))
    score = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["c"]) / F.size(pairs) / 100).otherwise(0.0)
    return F.struct(score.alias("score"), F.when((F.size(pairs) > 0) & (score >= 0.6), "medium").otherwise("low").alias("level"))


def chunk_type(labels: Column) -> Column:
    """table_block with any table item, list if all are list items, else paragraph."""
    return F.when(F.exists(labels, lambda x: x == "table"), "table_block").when((F.size(labels) > 0) & F.forall(labels, lambda x: x == "list_item"), "list").otherwise("paragraph")


def header_text(items: DataFrame, document: str, text: str, page: str, order: list[str], most_pages: int = 6) -> DataFrame:
    """``document, header``: the non-blank texts of the first pages (or of no page) in reading order, a line each.

    A group holds the texts of one document's first pages, never more.
    """
    some = items.where((F.col(page).isNull() | (F.col(page) <= most_pages)) & (F.trim(text) != ""))
    return some.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias("header"))


def rescue_pages(scanned: DataFrame, with_text: DataFrame, keys: list[str]) -> DataFrame:
    """Scanned pages without any text, which have to be recognised one by one."""
    return scanned.select(*keys).distinct().join(with_text.select(*keys).distinct(), keys, "left_anti")


def page_signals(items: DataFrame, page: list[str]) -> DataFrame:
    """``page, chars, paths, image_share, tables``: characters of text, number of vector paths (many hint at tables) and share of the page
    under images. items: the page's columns, ``kind`` (text, path or image), ``text``, ``area`` and ``page_area``."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    got = items.groupBy(*page).agg(of("text", F.length("text")).alias("chars"), of("path", F.lit(1)).alias("paths"), F.coalesce(of("image", F.col("area")) / F.nullif(F.max("page_area"), F.lit(0)), F.lit(0.0)).alias("image_share"))
    return got.withColumn("tables", F.col("paths") >= 120)


ITEMS = "array<struct<label:string,text:string,page_no:int>>"


def converted(files: DataFrame, key: str, content: str, load, batch: int = 1) -> DataFrame:
    """``key, position, label, text, page_no, error``: the layout items of every file in reading order, by an external model that returns
    them as an array (``ITEMS``). A file that fails has one row with its error; the others are not disturbed."""
    got = apply_model(files, key, content, load, ITEMS, batch)
    return got.select(key, "error", F.posexplode_outer("output").alias("position", "i")).select(key, "position", "i.label", "i.text", "i.page_no", "error")


READ = "struct<words:array<string>,conf:array<int>>"


def recognised(pages: DataFrame, key: str, image: str, load, batch: int = 1) -> DataFrame:
    """``key, text, score, level, error``: pages read by an external model that returns words and their confidences (``READ``); the text is
    cleaned as read text is, its confidence the mean of its words'."""
    got = apply_model(pages, key, image, load, READ, batch).withColumn("c", ocr_confidence(F.col("output.conf"), F.col("output.words")))
    return got.select(key, ocr_postprocess(F.array_join("output.words", " ")).alias("text"), F.col("c.score").alias("score"), F.col("c.level").alias("level"), "error")


def cached_pages(pages: DataFrame, cache: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(pages whose text the cache has, with ``text, reliability, score``; pages still to be recognised). A hit is always of medium
    reliability and 0.85, whatever the first recognition scored. cache: ``key, text``, one row for each key."""
    known = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("text"))
    hits = pages.join(known, key).withColumns({"reliability": F.lit("medium"), "score": F.lit(0.85)})
    return hits, pages.join(known.select(key), key, "left_anti")


def cache_key(name: Column, size: Column, changed: Column, page: Column, mode: Column) -> Column:
    """20 hex digits of file name, size, time of change, page and mode of recognition."""
    return F.left(F.sha2(F.concat_ws(":", name, *[c.cast("string") for c in (size, changed, page, mode)]), 256), F.lit(20))


def with_provenance(chunks: DataFrame, scanned: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Adds ``reliability`` and ``extraction_method``: chunks on scanned pages (``keys``) are of medium reliability and read by OCR, others
    high and, by their type (label), a table's or a text's. A chunk without a page is on none."""
    flags = scanned.select(*keys).distinct().withColumn("_scanned", F.lit(True))
    on = F.coalesce("_scanned", F.lit(False))
    return chunks.join(flags, keys, "left").withColumn("reliability", F.when(on, "medium").otherwise("high")).withColumn("extraction_method", F.when(on, "ocr_tesseract").when(label == "table_block", "docling_table").otherwise("docling")).drop("_scanned")


# Fixed value: the type of a heading's level.
LEVELS = "array<struct<title:string,depth:int,number:string>>"


def level_labels(levels: Column) -> Column:
    """Labels of a path of headings from the outermost in: number and title; of equal depth in the order given."""
    placed = F.transform(levels, lambda x, i: F.struct(x["depth"].alias("d"), i.alias("i"), F.trim(F.concat_ws(" ", F.nullif(x["number"], F.lit("")), x["title"])).alias("label")))
    return F.transform(F.array_sort(placed), lambda x: x["label"])


def descend(levels: Column, new: Column) -> Column:
    """The path below which the heading ``new`` stands: levels of its depth or deeper give way to it."""
    return F.concat(F.filter(levels, lambda x: x["depth"] < new["depth"]), F.array(new))


def heading_path(headings: Column) -> Column:
    """The path after a sequence of headings, folded from the first to the last."""
    return F.aggregate(headings, F.array().cast(LEVELS), lambda path, h: descend(path, h))


def token_chunks(rows: DataFrame, key: str, text: str, most_tokens: int = 512, least_chars: int = 80) -> DataFrame:
    """``key, chunk_order, tokens, content``: paragraphs merged up to ``most_tokens`` white-space tokens, longer ones cut; short chunks left out."""

    def cut(batches):
        for batch in batches:
            row, order, count, content = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                kept, held, n = 0, [], 0
                parts = [p.split() for p in (t or "").split("\n\n")]
                pieces = [p[k : k + most_tokens] for p in parts for k in range(0, len(p), most_tokens)]
                for p in [*pieces, None]:
                    if held and (p is None or n + len(p) > most_tokens):
                        s = "\n\n".join(" ".join(x) for x in held)
                        if len(s) >= least_chars:
                            row.append(i)
                            order.append(kept)
                            count.append(n)
                            content.append(s)
                            kept += 1
                        held, n = [], 0
                    if p is not None:
                        held.append(p)
                        n += len(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(order, pa.int32()), pa.array(count, pa.int32()), pa.array(content, pa.string())], names=["key", "chunk_order", "tokens", "content"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(cut, f"key {kind}, chunk_order int, tokens int, content string").withColumnRenamed("key", key)
