"""Helpers shared by the training-data operators: table access, shared scratch tables, grids of blocks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pattern of a word: a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder will do in
    local mode only; on a cluster every executor would write to a disk of its own, so that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors.

    Those that a result still reads stay until the driver's JVM ends, which deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.marked = spark, f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}", False

    def at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.parquet(path)
        if not self.marked:
            fs, root = self.at(self.root)
            self.marked = fs.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete tables that no later step reads."""
        for tag in tags:
            fs, path = self.at(f"{self.root}/{tag}")
            fs.delete(path, True)

    def tidy(self) -> None:
        """Let Spark's cleaner delete the shuffle files of plans that have ended: it acts when the driver collects its garbage,
        which a driver with little to do may put off while disks fill. Costs the driver a fraction of a second."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the actions inside; ``a__b`` stands for ``a.b``."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows, for rows that hold long texts or packed blocks."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text under names of our own, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
