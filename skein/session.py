"""Session helpers: configuration for local runs and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session on this machine, for tests and bench.py; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local master may go without the setting: one machine then is the whole cluster.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="skein-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="skein-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    home = Path(__file__).parent
    with zipfile.ZipFile(f"{folder}/skein.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"skein/{p.relative_to(home)}")
    sc.addPyFile(f"{folder}/skein.zip")
    sc._skein_shipped = True


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator, written to the shared folder.

    A written table cuts lineage for good: executors may be lost later without
    recomputing what came before. Tables that are no longer read are dropped at
    once; those a lazily evaluated result still reads stay until the JVM ends, with or
    without the session, or until the scope() they were made in is left.
    """

    scopes: ClassVar[list[list[Scratch]]] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if Scratch.scopes:
            Scratch.scopes[-1].append(self)

    def cut(self, df: DataFrame, label: str = "t", tidy: bool = False) -> DataFrame:
        """Write df and return it as read back; tidy: its shuffle files are deleted at once, not when the driver collects garbage."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{label}"
        if self._n == 1:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(p)
        before = self.spark.conf.get(SHUFFLES_KEY, None)
        if tidy:
            self.spark.conf.set(SHUFFLES_KEY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if tidy:
                self.spark.conf.unset(SHUFFLES_KEY) if before is None else self.spark.conf.set(SHUFFLES_KEY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that nothing will read again; other frames are left alone."""
        for df in frames:
            path = getattr(df, "_skein_path", None)
            if path:
                _delete(self.spark, path)

    def clear(self) -> None:
        """Delete all tables; nothing that reads them can be used any more."""
        _delete(self.spark, self.base)


@contextmanager
def scope():
    """Tables that operators write inside are deleted on leaving; results must have been written or collected before."""
    Scratch.scopes.append([])
    try:
        yield
    finally:
        for s in Scratch.scopes.pop():
            s.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
