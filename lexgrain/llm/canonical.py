"""Freely typed values mapped to the entries of a reference list, by a prefix-filter set-similarity join.

Each distinct value is folded (accents, case, punctuation, wrappings such as a year or a version) and cut into the bigrams
of its letters. Tokens are ordered by how rare they are over values and entries; two sets whose Jaccard similarity reaches t
must share a token among their rarest |x| - ceil(t |x|) + 1, so only these prefixes are joined. Length and positional filters
come before the sets are compared; Jaccard is then computed exactly, spelling distance decides between near entries, and
the best entry is kept. Values without an entry are reported with ref 0.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions.words import folded
from lexgrain.sources.tables import latest

# Words that typists put before a value; another list may be given.
LEADS = ("programme de", "programme du", "programme d'", "programme", "sujet de", "sujet", "corrige de", "corrige", "epreuve de", "epreuve", "classe de", "classe", "niveau", "serie", "ser", "option")


def _before(leads: tuple[str, ...]) -> re.Pattern:
    return re.compile("^(?:" + "|".join(re.escape(x) for x in sorted(leads, key=len, reverse=True)) + r")(?![a-z0-9'])\s*" if leads else r"^(?!)")


_LEAD = _before(LEADS)
_QUOTES = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "`": "'", "´": "'"})
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_OTHER = re.compile(r"[^a-z0-9']+")
_TAIL = re.compile(r"(?:\s+v(?:er|ersion)?\s*\d+|\s+(?:19|20)\d\d)+$")


def _plain(text: str) -> str:
    return _OTHER.sub(" ", folded(text.translate(_QUOTES))).strip().strip("'").strip()


def readings(value: str, lead: re.Pattern = _LEAD) -> list[str]:
    """What a typed value may be without its wrappings: whole, without brackets, lead words, version, year, plural, gaps; words in any order."""
    out: list[str] = []
    for text in (value, _BRACKETS.sub(" ", value)):
        plain = _plain(text)
        bare = _TAIL.sub("", lead.sub("", plain)).strip()
        for x in (plain, bare, bare[:-1] if bare.endswith("s") else bare, _sorted(bare), bare.replace(" ", "")):
            if x and x not in out:
                out.append(x)
    return out


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def names(text: str) -> list[str]:
    """The forms of an entry: its folded text, and its words in sorted order."""
    return list(dict.fromkeys(x for x in (_plain(text), _sorted(_plain(text))) if x))


def bigrams(text: str) -> list[str]:
    padded = f"^{text}$"
    return sorted({padded[i : i + 2] for i in range(len(padded) - 1)})


def spelling(a: str, b: str, least: float = 0.0) -> float:
    """1 - the number of insertions, deletions, changes and swaps of neighbours over the longer length; 0 if their lengths alone keep it under ``least``."""
    if abs(len(a) - len(b)) > (1 - least) * max(len(a), len(b)):
        return 0.0
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return 1 - last[-1] / max(1, len(a), len(b))


def alike_words(a: str, b: str, least: float = 0.0) -> float:
    """Spelling likeness; 0.95 at least where every word of a begins, by three letters or more, or is the word of b in its place."""
    x, y = a.split(), b.split()
    short = len(x) == len(y) and all(p == q or (len(p) >= 3 and q.startswith(p)) for p, q in zip(x, y))
    return max(spelling(a, b, least), 0.95 if short else 0.0)


def _forms(rows: DataFrame, key: str, kind: str, many) -> DataFrame:
    """``key, field, form, tokens`` for each form that ``many`` makes of a text."""

    def cut(batches):
        for batch in batches:
            row, forms = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = many(text) if text is not None else []
                forms += own
                row += [i] * len(own)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(forms, pa.string()), pa.array([bigrams(f) for f in forms], pa.list_(pa.string()))], names=["key", "field", "form", "tokens"])

    return rows.select(key, "field", "text").mapInArrow(cut, f"key {kind}, field string, form string, tokens array<string>")


def match_values(values: DataFrame, entries: DataFrame, similarity: float = 0.3, alike: float = 0.6, short: int = 3, leads: tuple[str, ...] = LEADS) -> DataFrame:
    """``field, value, ref, jaccard, alike`` for every distinct (field, value): the entry of the field it means, or ref 0.

    values: ``field, value``; entries: ``ref, field, text`` with a row for each name and alias (numbers from 1). A value equal to a
    form after folding is that entry. Otherwise the entry with the best mean of Jaccard and spelling likeness wins if it has
    at least ``similarity`` and ``alike``; forms of up to ``short`` characters must be equal. Ties go to the smaller ref. Null values are
    left out; an empty or blank value has ref 0; without entries all have ref 0. leads: folded words that may stand before a value.
    """
    plain = values.where("value is not null and field is not null").select("field", "value").distinct()
    named = plain.select(F.col("value").alias("key"), "field", F.col("value").alias("text"))
    lead = _before(leads)
    left = _forms(named, "key", "string", lambda x: readings(x, lead)).distinct()
    right = _forms(entries.select(F.col("ref").alias("key"), "field", "text"), "key", dict(entries.dtypes)["ref"], names).distinct()
    rarity = left.select("field", F.explode("tokens").alias("t")).unionByName(right.select("field", F.explode("tokens").alias("t"))).groupBy("field", "t").agg(F.count("*").alias("df"))

    def ordered(forms: DataFrame) -> DataFrame:
        """The forms with tokens rarest first, and one row per prefix token with its place."""
        at = forms.select("key", "field", "form", F.explode("tokens").alias("t")).join(rarity, ["field", "t"])
        kept = at.groupBy("key", "field", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("tokens"))
        n = F.size("tokens")
        return kept.withColumn("n", n).withColumn("prefix", F.slice("tokens", 1, n - F.ceil(similarity * n).cast("int") + 1))

    a, b = ordered(left), ordered(right)
    x = a.select(F.col("key").alias("value"), "field", F.col("form").alias("f"), F.col("tokens").alias("s"), F.col("n").alias("m"), F.posexplode("prefix").alias("i", "t"))
    y = b.select(F.col("key").alias("ref"), "field", F.col("form").alias("g"), F.col("tokens").alias("r"), F.col("n").alias("n"), F.posexplode("prefix").alias("j", "t"))
    need = similarity / (1 + similarity) * (F.col("m") + F.col("n"))
    met = x.join(y, ["field", "t"]).where((F.least("m", "n") >= similarity * F.greatest("m", "n")) & (1 + F.least(F.col("m") - F.col("i") - 1, F.col("n") - F.col("j") - 1) + F.least("i", "j") >= need))
    pairs = met.select("field", "value", "ref", "f", "g", "s", "r").dropDuplicates(["field", "value", "ref", "f", "g"])
    common = F.size(F.array_intersect("s", "r"))
    scored = pairs.withColumn("jaccard", common / (F.size("s") + F.size("r") - common)).where(F.col("jaccard") >= similarity)

    def spell(batches):
        for batch in batches:
            f, g = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array([alike_words(*p, least=alike) for p in zip(f, g)], pa.float64())], names=["field", "value", "ref", "f", "g", "jaccard", "alike"])

    spelt = scored.select("field", "value", "ref", "f", "g", "jaccard").mapInArrow(spell, f"field string, value string, ref {dict(entries.dtypes)['ref']}, f string, g string, jaccard double, alike double")
    good = spelt.where((F.col("f") == F.col("g")) | ((F.col("alike") >= alike) & (F.least(F.length("f"), F.length("g")) > short)))
    best = good.withColumn("n", F.row_number().over(Window.partitionBy("field", "value").orderBy(F.desc(F.col("f") == F.col("g")), F.desc(F.length(F.when(F.col("f") == F.col("g"), F.col("g")))), F.desc(F.round(F.col("jaccard") + F.col("alike"), 9)), "ref"))).where("n = 1")
    return plain.join(best.select("field", "value", "ref", "jaccard", "alike"), ["field", "value"], "left").select("field", "value", F.coalesce("ref", F.lit(0)).alias("ref"), "jaccard", "alike")


FIELDS = ["subject", "level", "track"]


def typed_values(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, value`` of every non-null field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return rows.select(key, pairs).select(key, "p.field", "p.value").where("value is not null")


def reference_forms(entries: DataFrame) -> DataFrame:
    """``ref, field, text``: one row for each entry name and alias."""
    forms = F.explode(F.array_distinct(F.concat(F.array("entry_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("text")
    return entries.select(F.col("ref_id").alias("ref"), F.col("field_name").alias("field"), forms).where("text is not null")


def _p3(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = latest(spark.read.parquet(f"{folder}/source_documents.parquet").select("document_id", *FIELDS, "updated_at"), ["document_id"], "updated_at")
    entries = spark.read.parquet(f"{folder}/reference_values.parquet")
    typed = typed_values(docs, "document_id", FIELDS)
    exact = entries.select(F.col("field_name").alias("field"), F.col("entry_name").alias("value")).distinct()
    return typed.join(exact, ["field", "value"], "left_anti"), typed, reference_forms(entries)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry meant by every value that is not letter for letter an entry name; 0 where the list has none."""
    other, _, forms = _p3(spark, folder)
    mapped = match_values(other, forms)
    return other.join(mapped, ["field", "value"]).select("document_id", F.col("field").alias("field_name"), F.col("ref").cast("long").alias("ref_id"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values without an entry, and in how many documents they stand."""
    other, _, forms = _p3(spark, folder)
    none = match_values(other, forms).where("ref = 0")
    return other.join(none, ["field", "value"]).groupBy(F.col("field").alias("field_name"), "value").agg(F.count("*").alias("documents"))


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
SQL: dict[str, str] = {}
