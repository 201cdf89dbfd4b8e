"""Session helpers: a local session for tests and bench, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session on one machine may do without: it gets a
    folder of its own, removed at the end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexgrain-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written once in the shared folder: later reads survive the loss of an executor.

    The table is needed as long as a frame built on it; ``forget`` removes all that were written, as does the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        atexit.register(_forget_at_end, spark)
    _WRITTEN.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes the tables that this application wrote so far; frames built on them can no longer be read. Returns their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _forget_at_end(spark: SparkSession) -> None:
    try:
        forget(spark)
    except Exception:  # noqa: BLE001, the session may be gone already
        pass


#: Rows that may be sent to every task.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The frame, marked for broadcast if it is counted to have at most ``most`` rows; beyond that a join is marked for a shuffle, as Spark
    would go by the size of files, and send what is small on disk to the driver."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


class Kept:
    """A table worked out once, written, and used until it is refreshed: what a process would otherwise hold for its whole life."""

    def __init__(self, make: Callable[[], DataFrame], name: str) -> None:
        self.make, self.name, self.table = make, name, None

    def get(self) -> DataFrame:
        if self.table is None:
            self.table = written(self.make(), self.name)
        return self.table

    def refresh(self) -> DataFrame:
        self.table = None
        return self.get()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexgrain-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lexgrain_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    spark.sparkContext.addPyFile(f"{folder}/lexgrain_code.zip")
    _SHIPPED.add(app)
