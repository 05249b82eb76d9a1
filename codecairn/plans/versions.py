"""Tables in hash buckets, changed bucket by bucket, with versions.

The rows of a table lie in buckets by a hash of their key.  A merge writes the
buckets it touches anew, below a folder of its version, and leaves the others
where they are.  A manifest names the folder of every bucket; putting the next
manifest in place is the one step that makes a merge visible.  Readers hold the
folders of the manifest they opened, so they see one version from start to end,
and a merge that dies leaves nothing that anybody reads.

    <table>/data/<version>-<id>/bucket=<b>/part-…   rows
    <table>/manifests/<version>.json                folder and rows of every bucket

Of two merges that start from one version the later one fails, before it is seen.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecairn.session import materialize

#: Rows a bucket is meant to hold; a table that outgrows four times that is dealt anew.
BUCKET_ROWS = 1_000_000
#: Versions whose files are kept for readers.
KEEP = 3
_BETWEEN = "\x1f"


def bucket_of(columns: Iterable[str], buckets: int) -> Column:
    """Bucket of a row by its key columns; nulls count as empty."""
    key = F.concat_ws(_BETWEEN, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def bucket_of_values(values: Iterable[object], buckets: int) -> int:
    key = _BETWEEN.join("" if v is None else str(v) for v in values)
    return int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % buckets


class Conflict(RuntimeError):
    """Another merge has put its version in place since this one started."""


class BucketedTable:
    """One table: ``key`` names what a merge replaces, ``within`` tells rows of one key apart.

    All rows of a key lie in one bucket, unless ``within`` deals them out too;
    name it where one key may have very many rows.
    """

    def __init__(self, spark: SparkSession, folder: str, key: tuple[str, ...], within: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.key, self.within = spark, folder.rstrip("/"), tuple(key), tuple(within)
        self.bucket_rows = bucket_rows

    # -- files of the driver: a few small manifests ------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts), self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")]

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.folder}")
        stream = self._fs().open(self._path("manifests", f"{version or known[-1]:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs = self._fs()
        draft = self._path("manifests", f".{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        plain = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(self._path("manifests", f"{manifest['version']:08d}.json")), plain)
        except Exception as exc:
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.folder} is there already") from exc

    # -- reading -----------------------------------------------------------------

    def _read(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = manifest["parts"] if buckets is None else {str(b) for b in buckets} & manifest["parts"].keys()
        folders = [f"{self.folder}/data/{manifest['parts'][b]['folder']}/bucket={b}" for b in wanted]
        schema = T.StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def lookup(self, *values: object) -> DataFrame:
        """Rows of one key: of one bucket, unless ``within`` deals keys out."""
        manifest = self.manifest()
        buckets = None if self.within else [bucket_of_values(values, manifest["buckets"])]
        rows = self._read(manifest, buckets)
        for column, value in zip(self.key, values):
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    # -- writing -----------------------------------------------------------------

    def _put(self, rows: DataFrame, version: int, buckets: int) -> dict:
        """Write rows into the buckets of a version; the folder and rows of each."""
        folder = f"{version:08d}-{uuid.uuid4().hex[:12]}"
        place = f"{self.folder}/data/{folder}"
        dealt = rows.withColumn("bucket", bucket_of(self.key + self.within, buckets)).repartition("bucket")
        dealt.sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(place)
        written = self.spark.read.schema(dealt.schema).parquet(place).groupBy("bucket").count().collect()
        return {str(r.bucket): {"folder": folder, "rows": r["count"]} for r in written}

    def replace(self, rows: DataFrame) -> None:
        """Write the whole table anew, with as many buckets as its rows ask for."""
        known = self.versions()
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        whole = self.spark.read.schema(rows.schema).parquet(staged)
        version, buckets = (known[-1] if known else 0) + 1, max(1, -(-whole.count() // self.bucket_rows))
        self._finish(version, buckets, rows.schema, self._put(whole, version, buckets), staged)

    def merge(self, fresh: DataFrame, gone: DataFrame | None = None) -> None:
        """Replace the rows of the keys in ``fresh``, drop those of the keys in ``gone``.

        Only buckets that hold such a key are written.  ``fresh`` is stored
        first, so it is computed once.
        """
        if not self.exists():
            self.replace(fresh)
            return
        manifest = self.manifest()
        staged, version, buckets = f"{self.folder}/staged/{uuid.uuid4().hex}", manifest["version"] + 1, manifest["buckets"]
        fresh.select(*T.StructType.fromJson(manifest["schema"]).names).write.parquet(staged)
        new = self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(staged)
        keys = new.select(*self.key)
        if gone is not None:
            keys = keys.unionAll(gone.select(*self.key))
        keys = materialize(keys.distinct().withColumnsRenamed({k: f"_{k}" for k in self.key}))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
        dealt = bucket_of(self.key + self.within, buckets).alias("bucket")
        touched = new.select(dealt)
        if gone is not None and not self.within:
            touched = touched.unionAll(gone.select(*self.key).select(dealt))
        if self.within:  # a key's old rows may lie in buckets that its new rows miss
            touched = touched.unionAll(self._read(manifest).join(keys, same, "left_semi").select(dealt))
        hit = {r.bucket for r in touched.distinct().collect()}
        kept = self._read(manifest, hit).join(keys, same, "left_anti")
        written = self._put(kept.unionByName(new), version, buckets) if hit else {}
        parts = {b: p for b, p in manifest["parts"].items() if int(b) not in hit} | written
        self._finish(version, buckets, T.StructType.fromJson(manifest["schema"]), parts, staged)
        if sum(p["rows"] for p in parts.values()) > 4 * buckets * self.bucket_rows:
            self.replace(self.read())

    def _finish(self, version: int, buckets: int, schema: T.StructType, parts: dict, staged: str) -> None:
        manifest = {"version": version, "buckets": buckets, "schema": schema.jsonValue(), "parts": parts}
        self._publish(manifest)
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        self.vacuum()

    def vacuum(self, keep: int = KEEP) -> None:
        """Delete manifests older than the last ``keep`` and the buckets only they name."""
        fs, known = self._fs(), self.versions()
        used: dict[str, set[str]] = {}
        for version in known[-keep:]:
            for bucket, part in self.manifest(version)["parts"].items():
                used.setdefault(part["folder"], set()).add(f"bucket={bucket}")
        for version in known[:-keep]:
            fs.delete(self._path("manifests", f"{version:08d}.json"), False)
        for name in self._names("data"):
            if int(name.partition("-")[0]) > known[-1]:
                continue  # of a merge under way
            if name not in used:
                fs.delete(self._path("data", name), True)
                continue
            for bucket in self._names("data", name):
                if bucket.startswith("bucket=") and bucket not in used[name]:
                    fs.delete(self._path("data", name, bucket), True)
