"""Tables in the checkpoint folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    present = spark.sparkContext._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terralume-checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """``put`` writes a DataFrame and returns the table read back; ``drop`` deletes those that no later
    step reads, ``keep`` all but those that one does.  What is left goes when the Python process ends, since lazy results may read it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/terralume-{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self.paths.discard(df._scratch_path)
            self._delete(df._scratch_path)

    def keep(self, *dfs: DataFrame) -> None:
        """Delete every table but these."""
        kept = {df._scratch_path for df in dfs}
        for path in self.paths - kept:
            self._delete(path)
        self.paths = kept

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: its cluster clears the checkpoint folder
            pass

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
