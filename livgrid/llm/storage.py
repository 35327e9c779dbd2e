"""Written tables between the steps of an operator: they cut the lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that a Python worker gets at once, where the session leaves Spark's default.
BATCH = "8m"
_works: list[Work] = []


def bound_batches(spark: SparkSession) -> None:
    """Texts can be long: batches are bounded by bytes, so that memory doesn't grow with them."""
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set(key, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session has none and runs in one process (tests) a temporary folder is made and set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="livgrid-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Work:
    """A folder of written tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _works.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back; its lineage ends there."""
        df.write.mode("overwrite").parquet(at := f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads (the whole folder without names)."""
        jvm = self.spark.sparkContext._jvm
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """How many works there are: what `drop_since` takes."""
    return len(_works)


def drop_since(when: int = 0) -> None:
    """Deletes the tables of all works since `when`. A result of theirs that wasn't read or written yet is lost with them: call it after that."""
    while len(_works) > when:
        _works.pop().drop()
