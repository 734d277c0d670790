"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Sizes are left to the cluster's own configuration; these are behaviours.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort, but only for shuffle partitions below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def get_session(app_name: str = "tracewise", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above; ``conf`` adds to or replaces them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tracewise-")


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _file_system(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath, fs = _file_system(spark, path)
    fs.delete(jpath, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder."""
    jpath, fs = _file_system(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(jpath)]


def create_file(spark: SparkSession, path: str, line: str) -> None:
    """A new file with one line of text; an error if there is one."""
    jpath, fs = _file_system(spark, path)
    out = fs.create(jpath, False)
    try:
        out.write(f"{line}\n".encode())
    finally:
        out.close()


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, without a slash at the end."""
    jpath, fs = _file_system(spark, path)
    return fs.makeQualified(jpath).toString().rstrip("/")


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    jpath, fs = _file_system(spark, path)
    if not fs.rename(jpath, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {path} to {to}")


# Else the files of a shuffle stay until the driver happens to collect garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidied(spark: SparkSession):
    """Jobs begun inside delete the files of their shuffles when they end."""
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_SETTING) if before is None else spark.conf.set(CLEANUP_SETTING, before)


class Staging:
    """Intermediate tables written once as Parquet and read many times.

    A written table cuts the lineage, survives the loss of executors and keeps
    column pruning and filter pushdown for its readers. The folder is unique
    per instance and goes away when the driver ends, or on ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog: list[str] = []
        self.root = f"{shared_dir(spark)}/tracewise-{uuid.uuid4().hex}"
        jpath, fs = _file_system(spark, self.root)
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)

    def table(self, name: str, df: DataFrame, tidy: bool = False) -> DataFrame:
        """``df`` as written. With ``tidy``, what was shuffled for it is deleted as soon as it is."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with _tidied(self.spark) if tidy else nullcontext():
            df.write.mode("errorifexists").parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, name: str, df: DataFrame, buckets: int) -> DataFrame:
        """As ``table``, in buckets by run and process, for joins with others in such buckets."""
        from tracewise.sources.layout import write_bucketed

        saved, known_as = write_bucketed(df, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", buckets)
        self.catalog.append(known_as)
        return saved

    def close(self) -> None:
        for name in self.catalog:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.catalog.clear()
        delete_path(self.spark, self.root)
