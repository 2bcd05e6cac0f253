"""A keyed table in versions: a change rewrites the buckets it touches, and one small file makes it count.

Rows are dealt into buckets by a hash of their key.  Every version is a manifest, a
JSON file that names a folder of Parquet for each bucket and the changes that went
in.  A change writes new folders for its buckets only and then creates the next
manifest, which fails if another writer made it first; until then nobody sees it,
and what a failed change has left is never read.  A change that a manifest already
names does nothing, so a batch that a stream repeats counts once.

Columns that follow from others (``derived``) are worked out for the rows of the
touched buckets in the same change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import upsert

#: Changes that a manifest names for each source of changes: a stream repeats its last one only.
REMEMBERED = 100


class Conflict(Exception):
    """Another writer has made the next version."""


class VersionedTable:
    """A table in a folder; ``create`` makes one."""

    def __init__(self, spark: SparkSession, folder: str, derived: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.folder, self.derived = spark, folder.rstrip("/"), derived
        about = self._manifest(0)
        self.keys, self.buckets, self.schema = about["keys"], about["count"], T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: T.StructType | str, keys: Sequence[str], buckets: int = 64, derived: Callable[[DataFrame], DataFrame] | None = None) -> VersionedTable:
        """A new, empty table; its rows are unique by ``keys``."""
        schema = spark.createDataFrame([], schema).schema
        if derived is not None:
            schema = derived(spark.createDataFrame([], schema)).schema
        made = object.__new__(cls)
        made.spark, made.folder = spark, folder.rstrip("/")
        made._commit(0, {"keys": list(keys), "count": buckets, "schema": schema.jsonValue(), "buckets": {}, "changes": {}})
        return cls(spark, folder, derived)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifest(self, version: int) -> dict:
        fs, path = self._path("manifests", f"{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        """Create a version's manifest; where the file system renames in one step, nobody sees half of one."""
        fs, path = self._path("manifests", f"{version:010d}.json")
        _, draft = self._path("drafts", f"{uuid.uuid4().hex}.json")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(draft, path):
            raise Conflict(f"version {version} is there already")

    def version(self) -> int:
        """The number of the newest version."""
        fs, path = self._path("manifests")
        return max(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, or of some of its buckets."""
        known = self._manifest(self.version() if version is None else version)["buckets"]
        paths = [f"{self.folder}/{p}" for b, p in known.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def change(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], source: str | None = None, number: int | None = None) -> list[int]:
        """Put ``how(old, rows)`` in place of the touched buckets' old rows, and return these buckets.

        ``rows`` has the keys at least, and is read more than once.  A change that has
        a source and number is made once: again, it touches nothing.
        """
        before = self.version()
        manifest = self._manifest(before)
        done = manifest["changes"].get(source, [])
        if source is not None and number in done:
            return []
        dealt = self._bucket(rows)
        # no more numbers than buckets
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
        if not touched and source is None:
            return []
        if touched:
            merged = how(self.read(before, touched), rows)
            if self.derived is not None:
                merged = self.derived(merged.drop(*[c for c in self.schema.names if c not in merged.columns]))
            place = f"data/{before + 1:010d}-{uuid.uuid4().hex}"
            out = self._bucket(merged.select(self.schema.names)).where(F.col("_bucket").isin(touched))
            out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
            fs, path = self._path(place)
            written = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if "=" in f.getPath().getName()}
            for b in touched:
                manifest["buckets"].pop(str(b), None)
                if b in written:
                    manifest["buckets"][str(b)] = f"{place}/_bucket={b}"
        if source is not None:
            manifest["changes"][source] = [*done, number][-REMEMBERED:]
        self._commit(before + 1, manifest)
        return touched

    def merge(self, rows: DataFrame, columns: dict[str, str] | None = None, keep_when=None, source: str | None = None, number: int | None = None) -> list[int]:
        """Upsert rows (unique by key), with what ``upsert.upsert`` does with columns and rows to keep."""
        plain = lambda old: old.select([c for c in old.columns if c in rows.columns])
        return self.change(rows, lambda old, new: upsert.upsert(plain(old), new, self.keys, columns, keep_when), source, number)

    def delete(self, gone: DataFrame, source: str | None = None, number: int | None = None) -> list[int]:
        """Delete the rows of some keys."""
        return self.change(gone.select(*self.keys).distinct(), lambda old, new: upsert.delete_using(old, new, self.keys), source, number)

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions reads, and older manifests but the first; how many folders went.

        Only while nobody writes: a change that isn't committed yet would lose its data.
        """
        last = self.version()
        kept = range(max(0, last - keep + 1), last + 1)
        used = {p.split("/_bucket=")[0] + "/_bucket=" + p.split("=")[-1] for v in kept for p in self._manifest(v)["buckets"].values()}
        fs, path = self._path("data")
        count = 0
        for change in fs.listStatus(path) if fs.exists(path) else []:
            own = [f.getPath() for f in fs.listStatus(change.getPath()) if "=" in f.getPath().getName()]
            left = [p for p in own if f"data/{change.getPath().getName()}/{p.getName()}" in used]
            for p in own:
                if p not in left:
                    count += bool(fs.delete(p, True))
            if not left:
                fs.delete(change.getPath(), True)
        for v in range(1, kept.start):
            fs.delete(self._path("manifests", f"{v:010d}.json")[1], False)
        return count
