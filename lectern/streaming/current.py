"""The current state of a stream as a table: an idempotent sink of keyed updates.

Rows are kept in buckets by key. A batch writes the buckets that it touches anew, each below the
number of the batch, and then commits the list of buckets and their versions as one small table.
Readers follow the newest committed list, so they see whole batches only; a batch that is played
again after its commit changes nothing, and one that broke off before it is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Buckets of a table; a batch writes those it touches anew.
BUCKETS = 64
_COMMIT = StructType([StructField("bucket", IntegerType()), StructField("version", LongType())])


class CurrentState:
    """A table of one row a key at path, written by foreachBatch(table.merge).

    keys name the columns that tell rows apart; null keys are keys like others. Of several rows
    of a key in one batch the one with the largest order column stays (without one there must be
    only one, as a stateful query in update mode gives).
    """

    def __init__(self, path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS):
        self.path, self.keys, self.order, self.buckets = path.rstrip("/"), list(keys), order, buckets

    def _fs(self, spark: SparkSession, at: str):
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = jvm.Path(at)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self, spark: SparkSession) -> int | None:
        """The number of the newest batch whose commit is whole."""
        fs, where = self._fs(spark, f"{self.path}/commits")
        if not fs.exists(where):
            return None
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def versions(self, spark: SparkSession) -> dict[int, int]:
        """The version of each bucket; at most one row a bucket reaches the driver."""
        last = self.committed(spark)
        if last is None:
            return {}
        return {r.bucket: r.version for r in spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/batch={last}").collect()}

    def _read(self, spark: SparkSession, versions: dict[int, int], schema: StructType) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema: StructType | str) -> DataFrame:
        """The current rows."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return self._read(spark, self.versions(spark), schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of a batch in place of those of equal keys, once, however often it is called with batch_id."""
        spark = batch.sparkSession
        last = self.committed(spark)
        if last is not None and batch_id <= last:
            return
        schema = StructType([StructField(f.name, f.dataType) for f in batch.schema.fields])
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.withColumn("bucket", bucket).persist()
        try:
            if self.order:
                others = [c for c in new.columns if c not in self.keys]
                best = new.groupBy(*self.keys).agg(F.max_by(F.struct(*others), self.order).alias("__s")).select(*self.keys, "__s.*")
            else:
                best = new
            versions = self.versions(spark)
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            old = self._read(spark, {b: versions[b] for b in touched if b in versions}, schema).withColumn("bucket", bucket)
            same = None
            for k in self.keys:
                match = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
                same = match if same is None else same & match
            kept = old.alias("o").join(best.select(*self.keys).alias("n"), same, "left_anti")
            rows = kept.select(*schema.names, "bucket").unionByName(best.select(*schema.names, "bucket"))
            if touched:
                rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/data/version={batch_id}")
            versions |= {b: batch_id for b in touched}
            spark.createDataFrame(list(versions.items()), _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")
            self._forget(spark, batch_id, last)
        finally:
            new.unpersist()

    def _forget(self, spark: SparkSession, batch_id: int, before: int | None) -> None:
        """Delete the lists older than the last two, and the versions that neither of these names."""
        named = set(self.versions(spark).values()) | {batch_id}
        if before is not None:
            named |= {r.version for r in spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/batch={before}").select("version").distinct().collect()}
        for folder, keep in (("commits", {batch_id, before}), ("data", named)):
            fs, where = self._fs(spark, f"{self.path}/{folder}")
            for s in fs.listStatus(where) if fs.exists(where) else ():
                if int(s.getPath().getName().split("=")[1]) not in keep:
                    fs.delete(s.getPath(), True)
