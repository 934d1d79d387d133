"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards, as they come and without a
shuffle. Compaction plans on the manifest alone: in each round the shards of one size
tier form runs in order of their first id, filled up to the target size; what stays small
is in a higher tier in the next round, until nothing merges. At most one small run stays
in each tier, as in a log-structured store. Only shards that are merged are read and
rewritten, each once.

A manifest version is a small file that names the folder of the manifest. It is written
aside and then given its name by one operation that fails where the name exists (a hard
link on local disks, a rename without overwriting elsewhere), so of two writers one wins
and the other is told and retries on the new state. Files are never changed, so readers
of an older version stay whole.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.llm import scratch

#: Bytes of text in a finished shard, about.
TARGET_BYTES = 32 << 20
#: Rows in an arriving shard at most.
ARRIVAL_ROWS = 1024
#: A tier holds shards whose sizes are within this factor.
TIER = 4
#: Shards that one task orders, about; sums over the tasks give the same runs at any number of them.
PLANNED = 4096
#: Shards whose assignment is sent to every executor at most; more are joined by a shuffle.
BROADCAST_SHARDS = 100_000
_BYTES = "_shard_row_bytes"
_SCHEMA = "shard string, path string, n_rows long, n_bytes long, first_id long, last_id long, merged int"


class Store:
    """A sharded table below root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        path_ = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path_, path_.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        path, fs = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in _SCHEMA.split(", "))))
        path, fs = self._fs(f"{self.root}/manifest/v{version}")
        stream = fs.open(path)
        try:
            folder = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.root}/manifest/{folder}")

    def _publish(self, draft: str, name: str) -> bool:
        """Gives the file draft the name, in one step and only if nothing has it; whether it did."""
        source, fs = self._fs(draft)
        goal, _ = self._fs(name)
        jvm = self.spark._jvm
        uri = fs.makeQualified(goal).toUri()
        try:
            if uri.getScheme() == "file":
                paths = [jvm.java.nio.file.Paths.get(x) for x in (fs.makeQualified(p).toUri() for p in (goal, source))]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration())
                context.rename(source, goal, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, shards: DataFrame, expected: int) -> int:
        """Makes shards the version after expected, or fails if another writer has made it."""
        folder = f"shards-{uuid.uuid4().hex}"
        shards.select("shard", "path", "n_rows", "n_bytes", "first_id", "last_id", "merged").coalesce(max(1, shards.count() // 100_000)).write.parquet(f"{self.root}/manifest/{folder}")
        draft = f"{self.root}/manifest/draft-{folder}"
        path, fs = self._fs(draft)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()
        won = self._publish(draft, f"{self.root}/manifest/v{expected + 1}")
        fs.delete(path, False)
        if not won:
            fs.delete(self._fs(f"{self.root}/manifest/{folder}")[0], True)
            raise RuntimeError(f"version {expected + 1} was committed by another writer")
        return expected + 1

    def _listed(self, folder: str, merged: int) -> DataFrame:
        """One row per file of a finished write."""
        schema = f"doc_id long, {_BYTES} long"
        rows = self.spark.read.schema(schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("path"))
        stats = rows.groupBy("path").agg(F.count("*").alias("n_rows"), F.sum(_BYTES).alias("n_bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        return stats.withColumns({"shard": F.regexp_extract("path", r"([^/]+)\.[a-z]+\.parquet$", 1), "merged": F.lit(merged)})

    def append(self, docs: DataFrame) -> int:
        """Adds docs as small shards; doc_id and text must be among the columns."""
        base = self.version()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        sized = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(_BYTES, F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long"))
        sized.write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS).parquet(folder)
        return self.commit(self.manifest(base).unionByName(self._listed(folder, 0)), base)

    def _merged(self, runs: DataFrame, target: int, parts: int) -> DataFrame:
        """run and to, the run that it becomes: small runs of a tier in order, cut where their sum passes a multiple of the target."""
        tier = F.floor(F.log(float(TIER), F.greatest(F.col("size"), F.lit(1)).cast("double")))
        small = runs.where(F.col("size") < target // 2).withColumn("tier", tier)
        order = [F.col("at").asc_nulls_first(), F.col("run").asc()]
        dealt = scratch.table(small.repartitionByRange(parts, F.col("tier").asc(), *order).withColumn("part", F.spark_partition_id()))
        # one row for each tier in each part
        sums = dealt.groupBy("tier", "part").agg(F.sum("size").alias("sum"))
        sums = sums.select("tier", "part", (F.sum("sum").over(W.partitionBy("tier").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum")).alias("before"))
        inner = W.partitionBy("tier", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        bins = dealt.join(sums, ["tier", "part"]).withColumn("bin", F.floor((F.col("before") + F.sum("size").over(inner) - F.col("size")) / target))
        heads = bins.groupBy("tier", "bin").agg(F.min("run").alias("to"), F.count("*").alias("n")).where("n > 1")
        return bins.join(heads, ["tier", "bin"]).select("run", "to")

    def plan(self, shards: DataFrame, target: int) -> DataFrame:
        """shards with run, the shard they become; null for those that stay as they are."""
        now = scratch.table(shards.select("shard", "n_bytes", F.col("first_id").alias("at"), F.col("shard").alias("run")))
        parts = max(1, -(-now.count() // PLANNED))
        while True:
            runs = now.groupBy("run").agg(F.sum("n_bytes").alias("size"), F.min("at").alias("at"))
            merged = scratch.table(self._merged(runs, target, parts))
            if not merged.limit(1).count():
                break
            now = scratch.table(now.join(merged, "run", "left").select("shard", "n_bytes", "at", F.coalesce("to", "run").alias("run")))
        many = now.groupBy("run").count().where("count > 1").select("run")
        return now.select("shard", "run").join(many.withColumn("of", F.col("run")), "run", "left").select("shard", F.col("of").alias("run"))

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merges small shards of similar size into files of about target bytes of text."""
        base = self.version()
        shards = self.manifest(base)
        plan = scratch.table(self.plan(shards, target).join(shards, "shard"))
        moved = plan.where("run is not null").select(F.col("path").alias("_from"), F.col("run").alias("_run"))
        n = moved.select("_run").distinct().count()
        if not n:
            return base
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = self._files(plan.where("run is not null")).withColumn("_from", F.col("_metadata.file_path"))
        rows = rows.join(F.broadcast(moved) if moved.count() <= BROADCAST_SHARDS else moved, "_from").drop("_from")
        # as many partitions as runs; one file for each run, in order of the ids
        rows.repartition(n, "_run").sortWithinPartitions("_run", "doc_id").write.partitionBy("_run").option("compression", "zstd").parquet(folder)
        kept = plan.where("run is null").select("shard", "path", "n_rows", "n_bytes", "first_id", "last_id", "merged")
        new = self._listed(folder, 1).withColumn("shard", F.concat(F.lit("m-"), F.regexp_extract("path", "/_run=([^/]+)/", 1)))
        return self.commit(kept.unionByName(new), base)

    def _files(self, shards: DataFrame) -> DataFrame:
        """The folders that hold the shards, as one scan; other shards may be in them. There is one folder for each commit."""
        at = F.concat(F.lit(f"{self.root}/data/"), F.regexp_extract("path", "/data/([0-9a-f]{32})/", 1))
        folders = sorted(r.folder for r in shards.select(at.alias("folder")).distinct().collect())
        if not folders:
            raise ValueError("no shards")
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*folders)

    def read(self, shards: DataFrame | None = None) -> DataFrame:
        """All rows of the shards (those of the newest version), with _shard_path."""
        shards = self.manifest() if shards is None else shards
        paths = shards.select(F.col("path").alias("_shard_path"))
        rows = self._files(shards).select("*", F.col("_metadata.file_path").alias("_shard_path"))
        return rows.join(F.broadcast(paths) if paths.count() <= BROADCAST_SHARDS else paths, "_shard_path", "left_semi").select(rows.columns)


def sharded(docs: DataFrame, root: str, target: int = TARGET_BYTES) -> DataFrame:
    """docs stored below root, compacted and read back, with shard (named by its first and last id), shard_rows, shard_bytes, version.

    Null texts count no bytes and null ids sort first; repeated rows are stored as they
    come; an empty table gives an empty result. docs may have any other columns, except
    names that begin with _shard or _run; columns named as those added give way to them
    in the result, not in the store.
    """
    store = Store(docs.sparkSession, root)
    store.append(docs)
    version = store.compact(target)
    found = {"shard": F.concat_ws("-", F.lit("ids"), "first_id", "last_id"), "shard_rows": F.col("n_rows"), "shard_bytes": F.col("n_bytes")}
    shards = store.manifest(version).select(F.col("path").alias("_shard_path"), *(c.alias(f"_{n}") for n, c in found.items()))
    own = [F.col(c) for c in docs.columns if c not in (*found, "version")]
    if not shards.count():
        return docs.select(*own, F.lit(None).cast("string").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(version).alias("version"))
    rows = store._files(store.manifest(version)).withColumn("_shard_path", F.col("_metadata.file_path")).drop(_BYTES)
    out = rows.join(F.broadcast(shards) if shards.count() <= BROADCAST_SHARDS else shards, "_shard_path")
    return out.select(*own, *(F.col(f"_{n}").alias(n) for n in found), F.lit(version).alias("version"))
