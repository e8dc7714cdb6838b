"""Tables, shared scratch space and small column helpers of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only in a local session where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lakesift-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Parquet tables in the shared folder: written once, read by any executor, dropped when replaced."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.release()
        return out

    def release(self) -> None:
        """Lets executors drop the shuffle files that only finished plans used."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later plan reads."""
        self.drop_path(df._scratch_path)

    def drop_path(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def growing(side: DataFrame) -> DataFrame:
    """The side of a join that grows with the corpus: it is shuffled at every size and never broadcast."""
    return side.hint("merge")


def count_of(text: Column, needles: str) -> Column:
    """How many characters of text are one of the (ASCII) needles."""
    rest = text
    for c in needles:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def words_of(text: Column) -> Column:
    """The white-space separated words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")
