"""Tables on plain parquet that jobs write to the shared folder: whole versions, and hash buckets.

``versions``: immutable directories ``v=<n>``, complete when Spark's commit
wrote its ``_SUCCESS`` marker; the newest complete one counts.  For small
tables that are written whole.

``BucketTable``: rows in partitions by hash bucket (and by columns that
searches filter by).  An upsert reads and rewrites the buckets of the incoming
keys only: their new partitions are written once and renamed into the table;
files of other buckets stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str, committed_only: bool = True) -> list[int]:
    """Versions under ``root``, ascending; by default only committed ones."""
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if not committed_only or fs.exists(st.getPath().suffix("/_SUCCESS")):
                try:
                    out.append(int(name[2:]))
                except ValueError:
                    pass
    return sorted(out)


def next_version(spark: SparkSession, root: str) -> int:
    """A number no directory uses yet: a failed write may have left an
    uncommitted ``v=<n>`` behind, and a retry must not collide with it."""
    vs = versions(spark, root, committed_only=False)
    return (vs[-1] + 1) if vs else 0


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest ``keep`` committed versions."""
    fs, _ = file_system(spark, root)
    for v in versions(spark, root)[:-keep]:
        fs.delete(file_system(spark, f"{root}/v={v}")[1], True)


#: Codec of tables: texts take about two thirds of what the default leaves.
CODEC = "zstd"
#: Keys of which so many at most are broadcast.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is not among ``keys``: few keys, by their count, are broadcast, so that the rows need not move."""
    keys = keys.select(column).distinct()
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, column, "left_anti").select(*rows.columns)


class BucketTable:
    """Rows of ``schema`` under ``path``, in ``buckets`` buckets by a hash of ``bucket_by``.

    ``partition_by`` columns are strings and become directories above the
    buckets; null and the empty string are one value there and read as empty.

    The new content of the touched buckets is first written beside the table.
    Only when that is complete are their partitions renamed into place; a job
    that was lost in between is finished by the next one that writes.  One job
    writes at a time; a reader that meets the replacement reads again.
    """

    BUCKET = "hash_bucket"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket_by: str, buckets: int = 16,
                 partition_by: Sequence[str] = ()):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.bucket_by, self.buckets, self.partition_by = bucket_by, buckets, tuple(partition_by)
        self.rows, self.staged = f"{self.path}/rows", f"{self.path}/staged"

    def _exists(self, path: str) -> bool:
        fs, p = file_system(self.spark, path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = file_system(self.spark, path)
        fs.delete(p, True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, path: str, mode: str, **options: str) -> None:
        parts = [*self.partition_by, self.BUCKET]
        # as many tasks as there are partitions at most, each with whole ones
        df = df.withColumn(self.BUCKET, self.bucket()).repartition(*parts)
        df.write.mode(mode).options(compression=CODEC, **options).partitionBy(*parts).parquet(path)

    def _read(self, path: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.BUCKET, T.IntegerType())])
        df = self.spark.read.schema(schema).parquet(path)
        for c in self.partition_by:
            df = df.withColumn(c, F.coalesce(c, F.lit("")))
        return df

    def create(self) -> None:
        """An empty table where there is none."""
        self.recover()
        if not self._exists(self.rows):
            self._write(self.spark.createDataFrame([], self.schema), self.rows, "ignore")

    def reset(self) -> None:
        for path in (self.staged, self.rows):
            self._delete(path)
        self.create()

    def read(self) -> DataFrame:
        if not self._exists(self.rows):
            return self.spark.createDataFrame([], self.schema)
        return self._read(self.rows).select(*self.schema.names)

    def replace(self, df: DataFrame) -> None:
        """``df`` as the whole table."""
        self._delete(self.staged)
        self._write(df.select(*self.schema.names), self.rows, "overwrite", partitionOverwriteMode="static")

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
               keys: DataFrame | None = None) -> list[int]:
        """Rewrites the buckets of ``incoming`` as ``merge(their rows, incoming)``; answers these buckets.

        ``merge`` must not move rows to other buckets.  ``keys`` holds the
        ``bucket_by`` values of ``incoming`` where they are had more cheaply
        than by computing it; ``merge`` should then use it once.
        """
        self.create()
        given = f"{self.path}/incoming"
        if keys is None:
            # usually expensive (embedding): computed once, in one write, for the buckets and the merge
            incoming.select(*self.schema.names).write.mode("overwrite").option("compression", CODEC).parquet(given)
            keys = incoming = self.spark.read.schema(self.schema).parquet(given)
        touched = sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())
        if touched:
            here = self._read(self.rows).where(F.col(self.BUCKET).isin(*touched)).select(*self.schema.names)
            self._delete(f"{self.path}/touched")
            self.spark.createDataFrame([(b,) for b in touched], "b int").coalesce(1).write.json(f"{self.path}/touched")
            self._write(merge(here, incoming).select(*self.schema.names), self.staged, "overwrite")
        self.recover()
        self._delete(given)
        return touched

    def recover(self) -> None:
        """Puts complete staged buckets in place of the table's, and drops incomplete ones."""
        if self._exists(f"{self.staged}/_SUCCESS"):
            touched = [r.b for r in self.spark.read.schema("b int").json(f"{self.path}/touched").collect()]
            self._replace_partitions(touched)
        self._delete(self.staged)
        self._delete(f"{self.path}/touched")

    def _partitions(self, root: str, bucket: str) -> dict[str, str]:
        """Partitions of ``bucket`` (or a pattern) under ``root``: path below it -> whole path."""
        fs, top = file_system(self.spark, root)
        top = top.toUri().getPath()
        names = [st.getPath().toString() for st in fs.globStatus(
            file_system(self.spark, f"{root}/{'*/' * len(self.partition_by)}{self.BUCKET}={bucket}")[1]) or ()]
        return {name[name.index(top) + len(top):]: name for name in names}

    def _replace_partitions(self, touched: list[int]) -> None:
        """Renames the staged partitions into the table; can be repeated from wherever it was lost."""
        fs, swept = file_system(self.spark, f"{self.staged}/_swept")
        if not fs.exists(swept):
            # a partition that lost its last row has none to take its place; told before any staged one has left
            staged = self._partitions(self.staged, "*")
            for b in touched:
                for below, path in self._partitions(self.rows, str(b)).items():
                    if below not in staged:
                        self._delete(path)
            fs.create(swept).close()
        for below, path in self._partitions(self.staged, "*").items():
            _, target = file_system(self.spark, self.rows + below)
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(file_system(self.spark, path)[1], target):
                raise OSError(f"{path} could not be renamed to {target.toString()}")
