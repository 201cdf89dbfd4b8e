"""Tables of parquet files that change by merging: rows in buckets by the hash of their key, each bucket at a version of its own.

A merge rewrites only the buckets that its rows fall into, beside the old ones, and then writes a manifest (bucket -> version); a
reader takes the latest manifest, so nothing that is being read is ever overwritten, and a merge that dies leaves no trace.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators.store import upsert

BUCKET = "_bucket"


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The parquet files below a folder; none if it does not exist."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException:
        return []
    return [r[0] for r in found.select("path").collect()]


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, int]]:
    """(number of the latest manifest, bucket -> version); (0, {}) for a table that does not exist."""
    made = sorted({int(f.rsplit("/", 2)[1][1:]) for f in _files(spark, f"{root}/manifests")})
    if not made:
        return 0, {}
    rows = spark.read.schema("bucket int, version int").parquet(f"{root}/manifests/m{made[-1]}").collect()
    return made[-1], {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, root: str, versions: dict[int, int], schema=None) -> DataFrame | None:
    paths = [f"{root}/v{v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
    if not paths:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest state of the table, or None."""
    return _read(spark, root, manifest(spark, root)[1])


def merge(spark: SparkSession, root: str, new: DataFrame, key: str, updates: list[str], buckets: int = 64) -> list[int]:
    """Upserts rows (one for each key) and returns the buckets written; done again, it changes nothing. buckets: as many as let one
    fit a task; it must stay the same for a table."""
    number, versions = manifest(spark, root)
    placed = new.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    old = _read(spark, root, {b: v for b, v in versions.items() if b in set(touched)})
    rows = new if old is None else upsert(old.select(*new.columns), new, key, updates)
    again = rows.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    again.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/v{number + 1}")
    state = versions | {b: number + 1 for b in touched}
    spark.createDataFrame(sorted(state.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/m{number + 1}")
    return touched


def tidy(spark: SparkSession, root: str) -> int:
    """Removes what no bucket of the latest manifest needs; returns the number of folders removed."""
    number, versions = manifest(spark, root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = {f.rsplit("/", 1)[0] for f in _files(spark, root) if f"/{BUCKET}=" in f}
    gone -= {f for f in gone if versions.get(int(f.rsplit("=", 1)[1])) == int(f.rsplit("/", 2)[1][1:])}
    gone |= {f"{root}/manifests/m{k}" for k in range(1, number)}
    for f in gone:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, length, content`` of the files of a folder in the order of their paths, not of those below it. A missing folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", "length", "content").orderBy("path")


#: The largest sound file that is taken.
MOST_SOUND = 25 * 1024 * 1024


def scan_sound(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length, status, content``: sound files that are "too large" (their content is not read) or "ok", for ``models.apply_model``.
    Empty files give no row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).where("length > 0")
    status = F.when(F.col("length") > MOST_SOUND, "too large").otherwise("ok")
    small_ones = found.where(F.col("length") <= MOST_SOUND).select("path", "length", status.alias("status"), "content")
    return small_ones.unionByName(found.where(F.col("length") > MOST_SOUND).select("path", "length", status.alias("status"), F.lit(None).cast("binary").alias("content")))
