"""Tables written once and read again, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        path = tempfile.mkdtemp(prefix="netfell-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


class Scratch:
    """One job's tables in the shared folder. A lost executor costs a reread, not the lineage."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/netfell-{job}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df as a Parquet table and return the table as read back.

        Spark deletes shuffle files when the driver collects the plans that made them; that is asked for here, so that
        those of the steps before don't add up."""
        gc.collect()
        self.spark._jvm.System.gc()
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop_all_but(self, name: str) -> None:
        """Delete the job's tables but one, which does not hang on the others."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(conf)
        for found in files.listStatus(root):
            if found.getPath().getName() != name:
                files.delete(found.getPath(), True)
