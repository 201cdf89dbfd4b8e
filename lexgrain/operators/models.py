"""Where external models plug in: functions from Arrow batches, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.text import normalize_key
from lexgrain.functions.vectors import normalized


def apply_model(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], kind: str, batch: int = 16) -> DataFrame:
    """``key, output, error``: the model's output for every text, ``batch`` texts at a time. load runs once per task; a batch that fails
    is tried text by text, and a text that fails has its error instead of stopping the job. Null texts have neither."""

    def run(batches):
        model = load()
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                try:
                    for i, y in zip(part, model([texts[i] for i in part]), strict=True):
                        out[i] = y
                except Exception:  # noqa: BLE001
                    for i in part:
                        try:
                            out[i] = model([texts[i]])[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "output": out, "error": errors}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(f"key {dict(rows.dtypes)[key]}, output {kind}, error string")
    schema = to_arrow_schema(spark_schema)
    return rows.select(key, text).mapInArrow(run, spark_schema).withColumnRenamed("key", key)


def embed(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], dims: int, instruction: str = "", batch: int = 16) -> DataFrame:
    """``key, vector, error``: unit vectors of the texts. instruction: what stands before a question; documents are embedded without one.
    A vector of another length than ``dims`` is an error of its row, as is a failure of the model; an empty table gives no rows."""
    asked = rows.select(key, F.when(F.col(text).isNotNull(), F.concat(F.lit(instruction), F.col(text))).alias("_text"))
    got = apply_model(asked, key, "_text", load, "array<double>", batch)
    fits = F.size("output") == dims
    wrong = F.concat(F.lit("the vector has "), F.size("output").cast("string"), F.lit(f" numbers, not {dims}"))
    return got.select(key, F.when(fits, normalized(F.col("output"))).alias("vector"), F.coalesce("error", F.when(F.col("output").isNotNull() & ~fits, wrong)).alias("error"))


def yes_share(yes: Column, no: Column) -> Column:
    """The probability of yes from two logits."""
    return 1 / (1 + F.exp(no - yes))


def cross_scores(pairs: DataFrame, key: list[str], question: str, subject: str, path: str, content: str, load: Callable[[], Callable[[list[str]], list]], batch: int = 8) -> DataFrame:
    """``key, score, error``: the cross-encoder's probability that the text answers the question. The model gets the question and, after a
    line end, subject and path over the content, and returns the logits of yes and no."""
    head = F.concat_ws(" ", F.nullif(F.col(subject), F.lit("")), F.nullif(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " > "), F.lit("")))
    text = F.concat_ws("\n", F.col(question), F.nullif(head, F.lit("")), F.coalesce(content, F.lit("")))
    asked = pairs.select(F.struct(*key).alias("_key"), text.alias("_text"))
    got = apply_model(asked, "_key", "_text", load, "array<double>", batch)
    return got.select("_key.*", yes_share(F.col("output")[0], F.col("output")[1]).alias("score"), "error")


def chat(rows: DataFrame, key: str, messages: str, load: Callable[[], Callable[[list[str]], list]], temperature: float = 0.2, most_tokens: int = 1500, batch: int = 4) -> DataFrame:
    """``key, answer, error``: a chat model's answer to ``messages``, an array of role and content. The model gets each conversation as JSON with
    its settings; conversations without messages have neither answer nor error."""
    body = F.struct(F.col(messages).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(most_tokens).alias("max_tokens"))
    asked = rows.select(key, F.when(F.size(messages) > 0, F.to_json(body)).alias("_text"))
    return apply_model(asked, key, "_text", load, "string", batch).withColumnRenamed("output", "answer")


def rendered(rows: DataFrame, key: str, name: str, markdown: str, load: Callable[[], Callable[[list[str]], list]], ending: str = "docx", batch: int = 8) -> DataFrame:
    """``key, file_name, content, error``: Markdown turned into files by an external converter, under names of letters, digits and lines only."""
    got = apply_model(rows, key, markdown, load, "binary", batch)
    safe = F.concat_ws("-", normalize_key(name), F.col(key).cast("string"))
    named = rows.select(F.col(key).alias("_key"), F.concat(safe, F.lit(f".{ending}")).alias("file_name"))
    return got.join(named, F.col(key) == F.col("_key")).select(key, "file_name", F.col("output").alias("content"), "error")
