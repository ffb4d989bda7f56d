"""Readers and writers of the library's files; schemas are explicit, never inferred."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import collection_id
from lectern.operators.archive import with_identity
from lectern.operators.curation import FIELDS, PASS_COLUMN, URLS

ROWS = T.StructType([T.StructField(c, T.StringType()) for c in ("collection_path", PASS_COLUMN, *FIELDS)])
BOOKS = T.StructType([T.StructField(c, T.StringType()) for c in (*FIELDS, *URLS)])


def read_rows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Curation rows of a CSV, JSON or Parquet export; empty cells are null."""
    reader = spark.read.schema(ROWS) if fmt != "csv" else spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.format(fmt).load(path)
    if fmt == "csv":  # by name, whatever the sheet's column order
        rows = rows.select(*[F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ROWS.names])
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in ROWS.names])


def _identity(path: Column) -> Column:
    """The collection_id of a file: of {year}/…/file, or of year=/kind=/name= folders."""
    keyed = lambda k: F.coalesce(F.try_url_decode(F.regexp_extract(path, rf"/{k}=([^/]+)/", 1)), F.lit(""))
    year, kind, name = keyed("year"), keyed("kind"), keyed("name")
    from_keys = F.when(kind == "month", name).when(kind == "subject", F.concat(year, F.lit("-subject-"), name)).when(kind == "sleeping_beauty", F.concat(year, F.lit("-sleeping-"), name))
    return F.coalesce(from_keys, collection_id(F.regexp_extract(path, r"/(\d{4}/.+)/[^/]+$", 1)))


def _file_path() -> Column:
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def read_collections(spark: SparkSession, root: str, pattern: str = "metadata.json") -> tuple[DataFrame, DataFrame]:
    """(books with their collection's identity and pos, files that can't be read).

    root holds {year}/…/metadata.json, or year=/kind=/name= folders, with an array of books a
    file. One bad file costs its collection only.
    """
    read = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = _file_path()
    parsed = read.select(path.alias("file"), _identity(path).alias("collection_id"), F.from_json("value", T.ArrayType(BOOKS)).alias("books"), F.try_parse_json("value").isNull().alias("bad"))
    parsed = parsed.where("collection_id is not null")
    good = parsed.where("not bad").select("collection_id", F.posexplode("books").alias("pos", "b")).select("collection_id", "pos", "b.*")
    return with_identity(good), parsed.where("bad").select("collection_id", "file")


def write_collections(books: DataFrame, root: str) -> None:
    """Books as gzipped JSON lines under year=/kind=/name=, one file a collection; only collections in books are replaced."""
    out = with_identity(books).repartition("year", "kind", "name").sortWithinPartitions("pos")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("year", "kind", "name").json(root)


def read_written(spark: SparkSession, root: str) -> DataFrame:
    """What write_collections wrote, with year, kind and name from the folders."""
    schema = T.StructType([T.StructField("collection_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("barcode", T.StringType()), *BOOKS.fields, *[T.StructField(c, T.StringType()) for c in ("title", "author", "year", "kind", "name")]])
    return spark.read.schema(schema).json(root)


def read_companions(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(collection_id, file_name, content) of the Markdown files beside the collections."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = _file_path()
    return files.select(_identity(path).alias("collection_id"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"), F.col("value").alias("content")).where("collection_id is not null")


def listed_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below root, by their paths from there; no content is read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.substring("path", len(full) + 2, 1 << 20).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def asset_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(collection_path, path, size, modified) of the source files of books: {collection_path}/{barcode}/…, as K2 and K3 take them.

    path starts with the book's folder; files of its pic/ folder belong to it too. Files that stand in no book's folder are left out.
    """
    parts = r"^(.+)/([^/]+/(?:pic/)?[^/]+)$"
    cut = lambda k: F.regexp_extract("path", r"^(.+?)/([^/]+/pic/[^/]+|[^/]+/[^/]+)$", k)
    files = listed_files(spark, root, pattern).where(F.col("path").rlike(parts))
    return files.select(cut(1).alias("collection_path"), cut(2).alias("path"), "size", "modified")


def font_files(spark: SparkSession, root: str, pattern: str = "*.{ttf,otf,woff,woff2}") -> DataFrame:
    """(filename, size, modified) of the font files in a folder, as K6 and K7 take them."""
    return listed_files(spark, root, pattern).withColumnRenamed("path", "filename").where(~F.col("filename").contains("/"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a fresh one on this machine if all tasks run here too
    (master local); else there is none, and that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/lectern/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a scratch path and is read no more."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str = "", path: str = "") -> DataFrame:
    """df written to the shared folder (or to path) and read back: cuts its lineage, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """df with a column name: each row's place by key, from 0 on; rows of equal keys in any order.

    Rows are dealt out by ranges of key and written once; each range is numbered by itself,
    from the number of rows in the ranges before it, so no task holds more than a range.
    """
    rows = written(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a range
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return rows.join(before, "__part").withColumn(name, place).drop("__part", "__before")
