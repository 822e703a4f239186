"""What the operators share: tables in the cluster's shared folder, lambda bindings, document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every contract of this subpackage.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Frees a job's shuffles when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all runs in one JVM."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder, which cuts lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """df as it was written. Its shuffles go with the job, as a later step reads the table and never them; left to
        the driver's garbage collection, those of all steps lie on disk together."""
        path, before = f"{self.root}/{label}", self.spark.conf.get(FREED, None)
        self.spark.conf.set(FREED, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(FREED) if before is None else self.spark.conf.set(FREED, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Frees tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
            path.getFileSystem(conf).delete(path, True)


    def keep(self, *labels: str) -> None:
        """Frees all tables but these, once what is left of a call's work reads no others."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [status.getPath().getName() for status in fs.listStatus(root)] if fs.exists(root) else []
        self.drop(*[name for name in found if name not in labels])


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as it takes to be no column of df, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often and wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
