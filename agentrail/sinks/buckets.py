"""A keyed table whose upserts rewrite only the buckets that they touch.

Rows lie in buckets by a hash of their keys.  A version is a manifest: a small
JSON file that names, for every bucket, the folder that holds its rows, with
the schema and the last batch applied of each stream.  An upsert writes the
touched buckets to a folder of its own and commits by creating the next
manifest, which fails if another writer took the number: folders are never
changed, so readers, lost executors and retried batches see whole versions.
``append`` adds a folder to the touched buckets and reads none of their rows, for
tables in which a repeated row does no harm (the postings of a search index).

``<base>/manifests/v00000007.json``, ``<base>/data/<id>/bucket=<n>/part-*.parquet``
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import remove, upsert

BUCKETS = 64
BUCKET = "bucket"


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version that this one was to become."""


class BucketTable:
    def __init__(self, spark: SparkSession, base: str, key: str | list[str] = "trace_id", buckets: int = BUCKETS):
        """``buckets`` holds for a new table; an old one keeps its own."""
        self.spark, self.base = spark, base.rstrip("/")
        self.keys, self.buckets = [key] if isinstance(key, str) else list(key), buckets
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *[p for p in parts if p]]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    # manifests

    def _manifest(self, name: str) -> dict | None:
        """A manifest; none for one whose writer has not finished it."""
        stream = self._fs.open(self._path("manifests", name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        return [int(n[1:-5]) for n in self._names("manifests") if n.endswith(".json") and self._manifest(n) is not None]

    def manifest(self, version: int | None = None) -> dict | None:
        if version is not None:
            return self._manifest(f"v{version:08d}.json")
        for name in reversed([n for n in self._names("manifests") if n.endswith(".json")]):
            found = self._manifest(name)
            if found is not None:
                return found
        return None

    def current(self) -> int | None:
        m = self.manifest()
        return m and m["version"]

    def _commit(self, old: dict | None, where: dict[int, list[str]], **new) -> int:
        taken = [int(n[1:-5]) for n in self._names("manifests") if n.endswith(".json")]
        seen = old["version"] if old else 0
        if any(v > seen and self._manifest(f"v{v:08d}.json") is not None for v in taken):
            raise ConcurrentWrite(f"{self.base}: version {max(taken)} was committed meanwhile")
        version = max([seen, *taken]) + 1
        named = {b: f if len(f) > 1 else f[0] for b, f in where.items()}
        body = json.dumps({"version": version, "keys": self.keys, **new, "where": named}).encode()
        try:
            out = self._fs.create(self._path("manifests", f"v{version:08d}.json"), False)
        except Exception as e:
            raise ConcurrentWrite(f"{self.base}: version {version} was taken meanwhile") from e
        out.write(bytearray(body))
        out.close()
        return version

    # rows

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, n: int, by_bucket: bool) -> tuple[str, list[int]]:
        """Rows written by bucket; the folder and the buckets that have rows.
        With ``by_bucket`` a bucket's rows go to few files, each of them whole
        keys: one task a bucket would take the whole table's share of it."""
        folder = uuid.uuid4().hex[:16]
        df = df.withColumn(BUCKET, self._bucket(n))
        if by_bucket:
            spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n)
            df = df.repartition(BUCKET, F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(spread)))
        df.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.base}/data/{folder}")
        return folder, [int(x.partition("=")[2]) for x in self._names("data", folder) if x.startswith(BUCKET + "=")]

    def _rows(self, where: dict[int, list[str]], schema: T.StructType) -> DataFrame:
        paths = [f"{self.base}/data/{folder}/{BUCKET}={b}" for b, folders in sorted(where.items()) for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _where(manifest: dict) -> dict[int, list[str]]:
        """Folders of every bucket, oldest first (one, unless rows were appended)."""
        return {int(b): [f] if isinstance(f, str) else list(f) for b, f in manifest["where"].items()}

    def read(self, version: int | None = None) -> DataFrame | None:
        m = self.manifest(version)
        return None if m is None else self._rows(self._where(m), T.StructType.fromJson(m["schema"]))

    def lookup(self, ids: DataFrame) -> DataFrame | None:
        """Rows with the keys in ``ids``; only their buckets are read."""
        m = self.manifest()
        if m is None:
            return None
        asked = {r[0] for r in ids.select(self._bucket(m["buckets"])).distinct().collect()}   # ``buckets`` numbers
        rows = self._rows({b: f for b, f in self._where(m).items() if b in asked}, T.StructType.fromJson(m["schema"]))
        return rows.join(ids.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stream: tuple[str, int] | None = None) -> int:
        """The next version: in the touched buckets ``combine(old rows, batch)``,
        the others as they were.  The batch is written once, by bucket, and
        evaluated by that alone.  ``stream`` = (stream, batch number): a batch
        that the table has already is left out."""
        if BUCKET in batch.columns:
            raise ValueError(f"a column is called {BUCKET}")
        old = self.manifest()
        streams = dict(old["streams"]) if old else {}
        if stream is not None:
            if streams.get(stream[0], -1) >= stream[1]:
                return old["version"]
            streams[stream[0]] = stream[1]
        n = old["buckets"] if old else self.buckets
        where = self._where(old) if old else {}
        schema = T.StructType.fromJson(old["schema"]) if old else batch.schema
        folder, touched = self._write(batch, n, False)
        arrived = self._rows({b: [folder] for b in touched}, batch.schema)
        before = self._rows({b: where[b] for b in touched if b in where}, schema)
        rows = combine(before, arrived)
        new, filled = self._write(rows, n, True)
        where = {b: f for b, f in where.items() if b not in touched} | {b: [new] for b in filled}
        return self._commit(old, buckets=n, schema=rows.schema.jsonValue(), streams=streams, where=where)

    def append(self, batch: DataFrame, stream: tuple[str, int] | None = None, spread: int = 4) -> int:
        """The next version: the batch's rows in a further folder of their
        buckets, sorted by key so that a lookup skips row groups.  No row of the
        table is read.  Rows of one bucket are written by ``spread`` tasks, so a
        key with very many rows is not one task's.  ``stream`` as in ``merge``."""
        if BUCKET in batch.columns:
            raise ValueError(f"a column is called {BUCKET}")
        old = self.manifest()
        streams = dict(old["streams"]) if old else {}
        if stream is not None:
            if streams.get(stream[0], -1) >= stream[1]:
                return old["version"]
            streams[stream[0]] = stream[1]
        n = old["buckets"] if old else self.buckets
        where = self._where(old) if old else {}
        schema = T.StructType.fromJson(old["schema"]) if old else batch.schema
        if batch.columns != schema.fieldNames():
            raise ValueError(f"the table has the columns {schema.fieldNames()}")
        folder = uuid.uuid4().hex[:16]
        dealt = (batch.withColumn(BUCKET, self._bucket(n))
                 .repartition(n * spread, BUCKET, F.pmod(F.xxhash64(*batch.columns), F.lit(spread)))
                 .sortWithinPartitions(BUCKET, *self.keys))
        dealt.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.base}/data/{folder}")
        for name in self._names("data", folder):
            if name.startswith(BUCKET + "="):
                where.setdefault(int(name.partition("=")[2]), []).append(folder)
        return self._commit(old, buckets=n, schema=schema.jsonValue(), streams=streams, where=where)

    def upsert(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Every row of a key in ``batch`` replaced by the batch's rows."""
        return self.merge(batch, lambda old, new: upsert(old, new, self.keys), stream)

    def remove(self, ids: DataFrame) -> int:
        """The rows of the keys in ``ids`` dropped."""
        return self.merge(ids.select(*self.keys), lambda old, new: remove(old, new, self.keys))

    def upsert_batch(self, batch: DataFrame, batch_id: int) -> int:
        """``upsert`` inside ``foreachBatch``, once per (stream, batch id)."""
        return self.upsert(batch, self.batch_of(batch_id))

    def batch_of(self, batch_id: int) -> tuple[str, int]:
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("stream batches are applied inside foreachBatch only")
        return query, batch_id

    # upkeep

    def compact(self, buckets: int | None = None, distinct: bool = False) -> int:
        """The whole table written anew, one folder a bucket, with another number
        of buckets if it has outgrown its own; ``distinct`` drops repeated rows."""
        old = self.manifest()
        if old is None:
            raise ValueError("an empty table has nothing to compact")
        n = buckets or old["buckets"]
        rows = self._rows(self._where(old), T.StructType.fromJson(old["schema"]))
        folder, filled = self._write(rows.distinct() if distinct else rows, n, True)
        return self._commit(old, buckets=n, schema=old["schema"], streams=old["streams"], where={b: [folder] for b in filled})

    def expire(self, keep: int = 2) -> tuple[int, int]:
        """Versions but the newest ``keep`` forgotten, with the buckets that no
        kept version names; (versions, buckets) removed.  A batch being written
        at the same time is not committed yet, so run it between writes."""
        if keep < 1:
            raise ValueError("the newest version stays")
        versions = self.versions()
        kept = versions[-keep:]
        used = {(f, b) for v in kept for b, folders in self._where(self.manifest(v)).items() for f in folders}
        for v in versions[:-keep]:
            self._fs.delete(self._path("manifests", f"v{v:08d}.json"), False)
        gone = 0
        for folder in self._names("data"):
            names = [x for x in self._names("data", folder) if x.startswith(BUCKET + "=")]
            drop = [x for x in names if (folder, int(x.partition("=")[2])) not in used]
            if len(drop) == len(names):
                self._fs.delete(self._path("data", folder), True)
            else:
                for x in drop:
                    self._fs.delete(self._path("data", folder, x), True)
            gone += len(drop)
        return len(versions) - len(kept), gone
