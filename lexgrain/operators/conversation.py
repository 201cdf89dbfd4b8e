"""Threads of questions and answers: the last turns, the threads in use, filters that carry on, exams as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.text import stripped


def last_turns(turns: DataFrame, thread: str, order: list[str], keep: int = 6) -> DataFrame:
    by = Window.partitionBy(thread).orderBy(*[F.desc(c) for c in order])
    return turns.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= keep).drop("_n")


def recent_threads(turns: DataFrame, thread: str, time: str, keep: int = 500) -> DataFrame:
    """The ``keep`` threads written last: aggregated first, then an ordered limit."""
    return turns.groupBy(thread).agg(F.max(time).alias("last_write")).orderBy(F.desc("last_write"), thread).limit(keep)


def carried(value: Column, thread: str, order: list[str]) -> Column:
    """The last value stated so far in the thread."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(thread).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rewrite_guard(original: Column, rewritten: Column) -> Column:
    """The rewritten question if it has 12 characters and three words, quotes trimmed; else the original."""
    plain = F.regexp_replace(F.trim(rewritten), "^[\"'«» ]+|[\"'«» ]+$", "")
    return F.when((F.length(plain) >= 12) & (F.size(F.split(plain, r"\s+")) >= 3), plain).otherwise(original)


# The marks of an exercise and of its parts.
EXERCISE, POINTS, COMPETENCE, STATEMENT, CORRECTION = "EXERCICE", "POINTS", "COMPETENCE", "ENONCE", "CORRIGE"


def _part(block: Column, mark: str, value: str) -> Column:
    """What follows a mark and its colon, case of the mark aside; empty without the mark."""
    return stripped(F.regexp_extract(block, rf"(?is){mark}\s*:\s*{value}", 1))


def parse_exercises(text: Column) -> Column:
    """array<struct<points, competence, statement, correction>> of delimited blocks; those without a statement are dropped."""
    blocks = F.split(text, rf"#*\s*{EXERCISE}\s*\n")
    parsed = F.transform(
        F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b: F.struct(
            F.coalesce(F.nullif(_part(b, POINTS, "([0-9]+)"), F.lit("")).try_cast("int"), F.lit(0)).alias("points"),
            _part(b, COMPETENCE, r"([^\n]+)").alias("competence"),
            _part(b, STATEMENT, rf"(.*?)\n\s*{CORRECTION}\s*:").alias("statement"),
            _part(b, CORRECTION, "(.*)").alias("correction"),
        ),
    )
    return F.filter(parsed, lambda e: e["statement"] != "")


def total_points(exercises: Column) -> Column:
    return F.aggregate(exercises, F.lit(0), lambda s, e: s + e["points"])


# The labels of an exam.
INFOS = {"class": "Classe", "duration": "Durée", "weight": "Coefficient"}
SCALE, TOTAL, NO_SOLUTION = "Barème", "Total", "_Corrigé non disponible._"


def exam_markdown(title: Column, exercises: Column, school: Column | None = None, rules: Column | None = None, infos: dict[str, Column] | None = None, solved: bool = False) -> Column:
    """The exam as Markdown: a heading with those of its infos (class, duration, weight) that are known, a section for each exercise,
    and the table of points with its total. solved: the corrections instead of the statements, without the table."""
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = lambda i: F.concat(F.lit("Exercice "), (i + 1).cast("string"))
    tail = lambda e: F.when(e["competence"] != "", F.concat(F.lit(" — "), e["competence"])).otherwise("")
    heading = [F.concat(F.lit("**"), known(school), F.lit("**"))] if school is not None else []
    heading.append(F.concat(F.lit("# "), title))
    if infos:
        told = F.concat_ws("  —  ", *[F.concat(F.lit(f"**{INFOS[k]} :** "), known(c)) for k, c in infos.items()])
        heading.append(F.nullif(told, F.lit("")))
    if rules is not None:
        heading.append(F.concat(F.lit("*Consignes : "), known(rules), F.lit("*")))
    body = (lambda e: F.coalesce(F.nullif(e["correction"], F.lit("")), F.lit(NO_SOLUTION))) if solved else (lambda e: e["statement"])
    sections = F.transform(exercises, lambda e, i: F.concat(F.lit("## "), label(i), F.lit(" ("), e["points"].cast("string"), F.lit(" points)"), tail(e), F.lit("\n\n"), body(e)))
    parts = [*heading, F.lit("---") if infos or rules is not None or school is not None else F.lit(None).cast("string"), F.array_join(sections, "\n\n")]
    if not solved:
        rows = F.transform(exercises, lambda e, i: F.concat(F.lit("| "), label(i), tail(e), F.lit(" | "), e["points"].cast("string"), F.lit(" |\n")))
        parts += [F.lit("---"), F.concat(F.lit(f"## {SCALE}\n\n| Exercice | Points |\n|:---|:---:|\n"), F.array_join(rows, ""), F.lit(f"| **{TOTAL}** | **"), total_points(exercises).cast("string"), F.lit("** |"))]
    return F.concat_ws("\n\n", *parts)
