"""The archive's read model over flat tables: books (collection_id, year, kind, name, pos, barcode, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.exprs import card_path, collection_kind, collection_name, collection_year, first_text, image_url, month_label, seeded_random, thumbnail_path, trimmed

# Fields of the typed view and what they are called in a published book.
VIEW = {
    "title": "豆瓣书名", "subtitle": "豆瓣副标题", "author": "豆瓣作者", "translator": "豆瓣译者", "publisher": "豆瓣出版社", "pubYear": "豆瓣出版年", "pages": "豆瓣页数", "rating": "豆瓣评分",
    "callNumber": "索书号", "callNumberLink": "索书号链接", "doubanLink": "豆瓣链接", "isbn": "ISBN", "series": "豆瓣丛书", "producer": "豆瓣出品方", "recommendation": "人工推荐语",
    "reason": "初评理由", "summary": "豆瓣内容简介", "authorIntro": "豆瓣作者简介", "catalog": "豆瓣目录",
}


def with_identity(books: DataFrame) -> DataFrame:
    """books with year, kind and name of their collection_id."""
    c = F.col("collection_id")
    return books.withColumns({"year": collection_year(c), "kind": collection_kind(c), "name": collection_name(c)})


def to_books(books: DataFrame, cdn: str = "") -> DataFrame:
    """The typed view of published books: strings only, empty for what is missing, image URLs resolved."""
    have = lambda c: F.col(c).cast("string") if c in books.columns else F.lit(None).cast("string")
    month, code = F.col("collection_id"), F.col("书目条码").cast("string")
    text = {k: F.coalesce(F.when(have(c) != "0", first_text(have(c))), F.lit("")) for k, c in VIEW.items()}
    urls = {
        "coverUrl": image_url(first_text(have("coverImageUrl"), have("豆瓣封面图片链接")), card_path(month, code, "cover"), cdn),
        "coverThumbnailUrl": image_url(have("coverThumbnailUrl"), card_path(month, code, "cover-thumbnail"), cdn),
        "cardImageUrl": image_url(have("cardImageUrl"), card_path(month, code), cdn),
        "cardThumbnailUrl": image_url(have("cardThumbnailUrl"), thumbnail_path(month, code), cdn),
        "originalImageUrl": image_url(have("originalImageUrl"), None, cdn),
        "originalThumbnailUrl": image_url(have("originalThumbnailUrl"), None, cdn),
    }
    return books.select(code.alias("id"), month.alias("month"), *[c.alias(k) for k, c in (text | urls).items()])


def label(collection_id: Column, companion: Column) -> Column:
    """Of months 二零二五年 八月; of subjects the companion file's title, else the name; of others the name."""
    kind = collection_kind(collection_id)
    return F.when(kind == "month", month_label(collection_id)).when(kind == "subject", F.coalesce(first_text(companion), collection_name(collection_id))).when(kind == "sleeping_beauty", collection_name(collection_id)).otherwise(collection_id)


def companion_titles(companions: DataFrame) -> DataFrame:
    """(collection_id, companion): the first Markdown file's name up to its colon; readme files don't count (F8)."""
    files = companions.where(F.col("file_name").endswith(".md") & ~F.lower("file_name").startswith("readme"))
    first = files.groupBy("collection_id").agg(F.min("file_name").alias("file_name"))
    stem = F.regexp_replace("file_name", r"\.md$", "")
    return first.select("collection_id", F.coalesce(first_text(trimmed(F.regexp_extract(stem, "^([^：:]*)", 1))), stem).alias("companion"))


def collection_counts(books: DataFrame) -> DataFrame:
    """(collection_id, book_count) (A1)."""
    return books.groupBy("collection_id").agg(F.count("*").alias("book_count"))


def collections(books: DataFrame, companions: DataFrame | None = None) -> DataFrame:
    """One row a collection: identity, label and number of books."""
    out = with_identity(collection_counts(books))
    if companions is None:
        return out.withColumn("label", label(F.col("collection_id"), F.lit(None).cast("string")))
    return out.join(companion_titles(companions), "collection_id", "left").withColumn("label", label(F.col("collection_id"), F.col("companion"))).drop("companion")


def volumes(collections: DataFrame) -> DataFrame:
    """(collection_id, vol): months numbered from the oldest (W1). The window runs over collections, not books."""
    months = collections.where(collection_kind(F.col("collection_id")) == "month").select("collection_id").distinct()
    return months.withColumn("vol", F.concat(F.lit("Vol. "), F.row_number().over(W.orderBy("collection_id")).cast("string")))


def year_stats(collections: DataFrame) -> DataFrame:
    """(year, issues, books) (A2)."""
    return collections.groupBy("year").agg(F.count("*").alias("issues"), F.sum("book_count").alias("books"))


def year_index(collections: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """(year, months, sleeping_beauties, subjects): ids, months and sleeping beauties newest first, subjects by name.

    Ids are ordered by a collation, as readers expect it of names in several scripts (``zh``
    orders Chinese by sound); ids that it takes for equal are ordered by their bytes.
    """
    keyed = F.struct(F.collate("collection_id", collation).alias("k"), F.col("collection_id").alias("id"))

    def listed(kind: str, newest: bool) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, keyed)), asc=not newest)
        return F.transform(rows, lambda r: r["id"])

    return collections.groupBy("year").agg(listed("month", True).alias("months"), listed("sleeping_beauty", True).alias("sleeping_beauties"), listed("subject", False).alias("subjects"))


def latest(collections: DataFrame) -> DataFrame:
    """The newest month."""
    return collections.where("kind = 'month'").orderBy(F.desc("collection_id")).limit(1)


def hero_images(books: DataFrame) -> DataFrame:
    """(pos, url): original or cover images of the newest month's books (P20)."""
    newest = latest(with_identity(books.select("collection_id").distinct())).select("collection_id")
    url = F.coalesce(first_text("originalImageUrl", "coverImageUrl"), F.lit(""))
    return books.join(F.broadcast(newest), "collection_id").select("pos", url.alias("url")).where("url <> ''")


def _size(collection_id: Column, seed: str, low: int, high: int) -> Column:
    return F.floor(seeded_random(F.concat(F.lit(f"{seed}-"), collection_id)) * (high - low + 1) + low)


def previews(books: DataFrame, seed: str = "preview", low: int = 4, high: int = 6) -> DataFrame:
    """(collection_id, n, barcode, url): low to high books of each collection in a seeded order (T4)."""
    order = seeded_random(F.concat_ws("-", F.lit(seed), "collection_id", "barcode"))
    url = image_url(first_text("cardThumbnailUrl", "cardImageUrl"), thumbnail_path("collection_id", "barcode"))
    ranked = books.withColumn("n", F.row_number().over(W.partitionBy("collection_id").orderBy(order, "barcode"))).where(F.col("n") <= high)  # kept to that early
    return ranked.where(F.col("n") <= _size(F.col("collection_id"), seed, low, high)).select("collection_id", "n", "barcode", url.alias("url"))


def all_books(*parts: DataFrame) -> DataFrame:
    """The books of all kinds with source_id, their collection."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("source_id", F.col("collection_id"))


def shuffle(books: DataFrame, seed: str = "shuffle") -> DataFrame:
    """books by a seeded random key (T5); sort by it, or take its smallest for a page."""
    return books.withColumn("shuffle_key", seeded_random(F.concat_ws("-", F.lit(seed), "collection_id", "barcode")))


#: Places of a stored shuffle in one folder, and folders at most: of a larger one a folder holds several stretches.
STRETCH, FOLDERS = 100_000, 1000


def store_shuffle(books: DataFrame, path: str, seed: str = "shuffle", stretch: int = STRETCH) -> None:
    """Write books in a seeded order, place by place, so that any page can be read by itself (T5).

    Books of equal keys are ordered by collection and barcode. Each range of keys is numbered by
    itself; places lie in folders of ``stretch`` places each, or of twice, four times … as many if
    there were more than FOLDERS of them. A folder is called by its first stretch.
    """
    from lectern.sources.files import numbered

    rows = shuffle(books, seed).withColumn("__order", F.struct("shuffle_key", "collection_id", "barcode"))
    rows = numbered(rows, "__order", "place").drop("__order")
    folders, fold = -(-rows.count() // stretch), 1
    while folders > FOLDERS * fold:
        fold *= 2
    rows = rows.withColumn("stretch", F.floor(F.col("place") / (stretch * fold)) * fold)  # a range's places lie together in one task
    rows.sortWithinPartitions("stretch", "place").write.partitionBy("stretch").parquet(path)


def shuffled_page(spark: SparkSession, path: str, page: int, size: int, stretch: int = STRETCH) -> DataFrame:
    """The books of a page, from 0 on, of a stored shuffle; only the folders of its places are read."""
    first, end = page * size, (page + 1) * size
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    fold = min((n for n in (int(x.split("=")[1]) for x in names if x.startswith("stretch=")) if n), default=1)  # the second folder's first stretch
    of = lambda place: place // (stretch * fold) * fold
    rows = spark.read.parquet(path).where(F.col("stretch").between(of(first), of(max(first, end - 1))))
    return rows.where((F.col("place") >= first) & (F.col("place") < end)).drop("stretch").orderBy("place")


def nav_years(collections: DataFrame, announced: DataFrame) -> DataFrame:
    """All years, existing and announced, newest first."""
    return collections.select("year").union(announced.select("year")).distinct().orderBy(F.desc("year"))


def export_book(books: DataFrame, collection_id: str, barcode: str | None = None) -> DataFrame:
    """(value): one collection's books as JSON, or the one of a barcode."""
    mine = books.where(F.col("collection_id") == collection_id)
    mine = mine if barcode is None else mine.where(F.col("barcode").cast("string") == barcode)
    return mine.select(F.to_json(F.struct(*[c for c in books.columns if c not in ("year", "kind", "name")])).alias("value"))
