"""Asset manifests: what is new, what is still there, what to purge, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.exprs import size_text
from lectern.sources.files import numbered

# Fixed value: keys of one delete call.
BATCH = 1000


def new_items(scan: DataFrame, done: DataFrame, key: str = "filename") -> DataFrame:
    """Scanned files that the manifest lacks (K6)."""
    return scan.join(done.select(key), key, "left_anti")


def still_present(done: DataFrame, scan: DataFrame, key: str = "filename") -> DataFrame:
    """Manifest entries whose file still exists (K7)."""
    return done.join(scan.select(key), key, "left_semi")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The entries kept, then the new ones (U3); origin says which."""
    return old.withColumn("origin", F.lit("kept")).unionByName(new.withColumn("origin", F.lit("new")), allowMissingColumns=True)


def purge_plan(entries: DataFrame, prefix: str, batch: int = BATCH) -> DataFrame:
    """(batch, key) of the entries below a key prefix, in delete calls of bounded size.

    Keys are numbered range by range, so no task holds them all.
    """
    keys = entries.where(F.col("key").startswith(prefix)).select("key").distinct()
    return numbered(keys, "key").select(F.floor(F.col("number") / batch).cast("int").alias("batch"), "key")


def summary(entries: DataFrame) -> DataFrame:
    """Number of entries, total size and its text."""
    return entries.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).withColumn("size_text", size_text("size"))
