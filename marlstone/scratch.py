"""Tables written to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    Where the session names none, a local session gets a temporary folder of
    its own; a cluster, whose machines would not see it, raises ValueError.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    return _own_dirs[app]


class Scratch:
    """Tables written to the shared folder, to cut lineage and to avoid doing work twice.

    ``put`` writes and rereads; ``drop`` removes what is no longer needed, and
    the end of the session removes the rest, as results may still read it.
    A lost executor costs nothing that was put here.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _hadoop(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch", None)
        if path:
            hadoop, fs = self._hadoop(path)
            fs.delete(hadoop, True)
