"""Sharding with size-tiered compaction and a versioned manifest, with DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction takes runs of similarly sized shards, merges them
into files of the target size, and commits a new manifest. A manifest names all live shards; version n is committed by
renaming a finished file to its name without overwriting, which fails if another writer was first. Readers open the
newest version only, so they see an append or a compaction whole or not at all; files of an interrupted write are never
named. Files that no kept version names are removed on demand.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import shared_dir, table

TARGET_BYTES = 128 << 20
#: Shards of one tier that are merged at least; the tiers' sizes differ by this factor.
FANOUT = 4


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class ShardStore:
    """A versioned set of Parquet shards under ``path``, which the driver and all executors reach.

    The driver handles file names and sizes only, as table formats do; rows stay with the executors.
    """

    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target_bytes, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        if not self.fs.exists(self._at("manifest")):
            return 0
        names = (s.getPath().getName() for s in self.fs.listStatus(self._at("manifest")))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def shards(self, version: int | None = None) -> list[dict]:
        """name, bytes and level of each live shard."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._at("manifest", f"{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["shards"]
        finally:
            stream.close()

    def _commit(self, version: int, schema: str, shards: list[dict]) -> None:
        self.fs.mkdirs(self._at("manifest"))
        draft, final = self._at("manifest", f".{uuid.uuid4().hex}"), self._at("manifest", f"{version:08d}.json")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"schema": schema, "shards": shards}).encode()))
        stream.close()
        # FileContext renames without overwriting: on a shared store check and rename are one step there
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(f"version {version} of {self.path} is taken") from None

    def _write(self, df: DataFrame, level: int) -> list[dict]:
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        files = [s for s in self.fs.listStatus(self._at(folder)) if s.getPath().getName().endswith(".parquet")]
        return [{"name": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen(), "level": level} for s in files]

    def append(self, df: DataFrame) -> int:
        """Write ``df`` as new shards, as many as it has partitions, and commit them. Returns the new version.

        All shards have the schema of the first append; another one is refused.
        """
        version = self.version()
        if version and self._schema(version) != df.schema:
            raise ValueError(f"the schema of {self.path} is {self._schema(version).simpleString()}")
        self._commit(version + 1, df.schema.json(), [*self.shards(version), *self._write(df, 0)])
        return version + 1

    def tier(self, size: int) -> int:
        """0 for shards below target / fanout ** 6, then one more for each factor; full shards have the highest."""
        at, bound = 6, self.target_bytes
        while at > 0 and size < bound:
            at, bound = at - 1, bound // self.fanout
        return at

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: the shards of each tier below the full one that has ``fanout`` of them or more."""
        tiers: dict[int, list[dict]] = {}
        for shard in shards:
            if shard["bytes"] < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> int:
        """Merge until no tier has a run left. Returns the version; every round commits one."""
        while runs := self.plan(self.shards(version := self.version())):
            live, made = self.shards(version), []
            for run in runs:
                files = max(1, -(-sum(s["bytes"] for s in run) // self.target_bytes))
                merged = self._open(run).coalesce(files)  # whole shards of alike sizes are put together, without a shuffle
                made += self._write(merged, 1 + max(s["level"] for s in run))
            gone = {s["name"] for run in runs for s in run}
            self._commit(version + 1, self._schema(version).json(), [*(s for s in live if s["name"] not in gone), *made])
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Remove the shards that none of the newest ``keep`` versions names, and older manifests. Returns how many files went.

        Readers of older versions and writers must have ended.
        """
        newest = self.version()
        kept = {s["name"] for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        gone = {s["name"] for v in range(1, newest - keep + 1) if self.fs.exists(self._at("manifest", f"{v:08d}.json")) for s in self.shards(v)} - kept
        for name in gone:
            self.fs.delete(self._at(name), False)
        for v in range(1, newest - keep + 1):
            self.fs.delete(self._at("manifest", f"{v:08d}.json"), False)
        return len(gone)

    def _schema(self, version: int):
        from pyspark.sql.types import StructType

        stream = self.fs.open(self._at("manifest", f"{version:08d}.json"))
        try:
            return StructType.fromJson(json.loads(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["schema"]))
        finally:
            stream.close()

    def _open(self, shards: list[dict]) -> DataFrame:
        schema = self._schema(self.version())
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['name']}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        return self._open(self.shards(version))


#: The query's arrivals, in sixteenths of the table: with one shard each, four small ones make one like the larger three.
ARRIVALS = (4, 4, 4, 1, 1, 1, 1)


def arrive(store: ShardStore, rows: DataFrame) -> None:
    """Append ``rows`` in arrivals of two sizes, dealt by a hash of all columns."""
    place, first = F.pmod(F.xxhash64(*rows.columns), F.lit(sum(ARRIVALS))), 0
    for share in ARRIVALS:
        store.append(rows.filter(place.between(first, first + share - 1)))
        first += share


def op2_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in arrivals of two sizes, compacted tier by tier, and read back through the manifest. Nulls,
    repeated rows and empty texts are rows like any other; an empty table gives a manifest of empty shards and no rows."""
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    arrive(store, table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5, length(text)::BIGINT AS text_chars FROM documents"
