"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


class Workspace:
    """Writes intermediate results as Parquet and reads them back, so that a lost executor costs no more than the step it was in."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0

    def save(self, df: DataFrame, codec: str = "snappy", by: Sequence[str] = ()) -> DataFrame:
        """``df`` written and read again; columns named in ``by`` become folders, so that a filter on them skips files."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        writer = df.write.option("compression", codec)
        (writer.partitionBy(*by) if by else writer).parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.workspace_path = path
        return saved

    @contextlib.contextmanager
    def bucketed(self, df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
        """``df`` written in buckets by ``key`` and read again, so that what groups or joins it by that key doesn't deal it anew; only inside the ``with``."""
        self._made += 1
        path, name = f"{self.root}/{self._made}", f"t{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        try:
            saved = self.spark.table(name)
            saved.workspace_path = path
            yield saved
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.workspace_path)
            path.getFileSystem(conf).delete(path, True)
