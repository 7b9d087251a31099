"""A stored table with one row per key that can be upserted: runs of changed rows, merged level by level.

A write adds one run with the rows it changes, filed by a hash of the key, and nothing else; after every ``fanout`` runs
of a level these are merged into one run of the next, so a row is rewritten once per level. Which runs make up version n
follows from n alone, so no list of files is kept, and no run that a version reads is ever written again: a write that
is repeated after a failure overwrites its own output only. A version counts once its commit row is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


class KeyedRuns:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64, fanout: int = 8):
        self.spark, self.path, self.key, self.buckets, self.fanout = spark, path.rstrip("/"), key, buckets, fanout
        self.columns = [f.name for f in schema]
        self._stored = T.StructType([*schema.fields, T.StructField("_version", T.LongType()), T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])

    def _run(self, first: int, last: int) -> str:
        return f"{self.path}/runs/run={first:012d}-{last:012d}"

    def live(self, version: int) -> list[tuple[int, int]]:
        """The runs (first, last) that hold the writes before ``version``, fewer than ``fanout`` per level."""
        size, at, out = 1, 0, []
        while size * self.fanout <= version:
            size *= self.fanout
        while size:
            while at + size <= version:
                out.append((at, at + size - 1))
                at += size
            size //= self.fanout
        return out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        reader = self.spark.read.schema(self._stored).option("basePath", f"{self.path}/runs")
        return reader.parquet(*[self._run(*r) for r in runs])

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c != self.key]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest, "_version"), "_version").alias("_r"))
        return last.select(self.key, *[F.col("_r")[c].alias(c) for c in [*rest, "_version"]])

    def read(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """The table before the write ``version``; with ``keys`` only their rows, from the buckets that they meet."""
        runs = self.live(version)
        if not runs:
            return self.spark.createDataFrame([], T.StructType([f for f in self._stored if f.name in self.columns])).select(*self.columns)
        rows = self._rows(runs)
        if keys is not None:
            keys = keys.select(self.key).distinct()
            met = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            rows = rows.filter(F.col("bucket").isin(met)).join(keys, self.key, "left_semi")
        return self._latest(rows).select(*self.columns)

    def write(self, rows: DataFrame, version: int) -> None:
        """The changed rows of one version, then the merges that are due after it."""
        self._put(rows.select(*self.columns).withColumn("_version", F.lit(version).cast("long")), version, version)
        size = self.fanout
        while (version + 1) % size == 0:
            part = size // self.fanout
            runs = [(i, i + part - 1) for i in range(version + 1 - size, version + 1, part)]
            self._put(self._latest(self._rows(runs)), version + 1 - size, version)
            size *= self.fanout

    def _put(self, rows: DataFrame, first: int, last: int) -> None:
        rows = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._run(first, last))

    # --- versions with commit rows, for batch jobs (a stream brings its own version numbers) ---

    def committed(self) -> DataFrame:
        """(version, batch) of the writes that count."""
        schema = "batch string, version long"
        path = f"{self.path}/commits"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def version(self) -> int:
        return (self.committed().agg(F.max("version")).first()[0] or 0) + 1 if self.committed().take(1) else 0

    def apply(self, batch: str, changed: Callable[[int], DataFrame]) -> bool:
        """Write what ``changed`` gives for the next version, unless ``batch`` was applied before; tells if it was written."""
        if self.committed().filter(F.col("batch") == batch).take(1):
            return False
        version = self.version()
        self.write(changed(version), version)
        row = self.spark.createDataFrame([(batch,)], "batch string").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")
        return True

    def table(self) -> DataFrame:
        return self.read(self.version())

    def vacuum(self, version: int) -> list[str]:
        """Delete the runs that neither ``version`` nor the one before it reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = root.getFileSystem(conf)
        needed = {self._run(*r).rsplit("/", 1)[1] for v in (version, version - 1) for r in self.live(max(v, 0))}
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("run=") and s.getPath().getName() not in needed]
        gone = [p for p in gone if int(p.getName().rsplit("-", 1)[1]) < version]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
