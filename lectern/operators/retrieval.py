"""Book retrieval: probes, top-k search, normalising, merging, selecting and rendering hits.

Tables: hits (request_id, query_pos, pos, id, title, author, …, *_score, embedding_id). Order
is data: query_pos and pos carry it, and every sort ends with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.exprs import first_number, first_text, is_blank, number_text, trimmed
from lectern.operators.textsearch import Index, document_weights, report_queries, text_search, text_vectors
from lectern.operators.vectorsearch import batch_search
from lectern.sources.files import written

# Thresholds and sizes of the searches.
SIMILARITY, AUTO_SIMILARITY, AUTO_ANY, MAX_BOOKS = 0.42, 0.42, 0.4, 8
TOP_K, SIMPLE_TOP_K, MIN_RATING, PER_QUERY, FINAL = 8, 10, 6.0, 12, 8
# The plain-text line of a book.
LINE = r"^【(.+?)】(.+?)\s*-\s*([\d.]+)分$"

KEEP_SCORE = ("final_score", "similarity_score", "rating")  # which of two equal books stays
SORT_SCORE = ("final_score", "similarity_score")


def ordered_lines(line: Column, order: Column, sep: str = "\n") -> Column:
    """An aggregate: the lines of a group joined in the order given (a struct or number)."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.array_join(F.transform(rows, lambda r: r["l"]), sep)


def search_texts(expansions: DataFrame) -> DataFrame:
    """(request_id, query_pos, query): the original query, then the probes that are not blank.

    expansions: (request_id, original_query, success, probes: array<struct<type, label, text>>).
    """
    probes = F.when(F.col("success"), F.filter(F.transform("probes", lambda p: p["text"]), lambda t: ~is_blank(t)))
    texts = F.concat(F.array("original_query"), F.coalesce(probes, F.array().cast("array<string>")))
    return expansions.select("request_id", F.posexplode(texts).alias("query_pos", "query"))


def multi_query(queries: DataFrame, corpus: DataFrame, per_query_top_k: int = PER_QUERY, final_top_k: int = FINAL) -> DataFrame:
    """(request_id, vec_id, fused_score, pos): searches of one request fused by reciprocal rank."""
    hits = batch_search(queries, corpus, per_query_top_k)
    fused = hits.groupBy("request_id", "vec_id").agg(F.round(F.sum(1 / (F.col("pos") + 61)), 9).alias("fused_score"))
    best = W.partitionBy("request_id").orderBy(F.desc("fused_score"), "vec_id")
    return fused.withColumn("pos", F.row_number().over(best) - 1).where(F.col("pos") < final_top_k)


def report_search(topics: DataFrame, corpus: DataFrame, id: str = "id", text: str = "text", per_query_top_k: int = PER_QUERY, final_top_k: int = FINAL) -> DataFrame:
    """(request_id, vec_id, fused_score, pos): books for research reports, by their abstracts and keywords.

    topics: as research.report_topics gives them; corpus: ids (whole numbers) and texts of books.
    Both become vectors by one idf of the corpus. Reports without a known term find nothing.
    """
    weights = written(document_weights(corpus, id, text), "weights")
    books = text_vectors(corpus, weights, id, text=text).select(F.col(id).alias("vec_id"), "embedding", F.lit(None).cast("double").alias("rating"))
    queries = text_vectors(report_queries(topics), weights, "request_id", "query_pos", text="query")
    return multi_query(queries, books, per_query_top_k, final_top_k)


# Fields of a hit and the names it may arrive under, first one first.
TEXT_FIELDS = {
    "subtitle": ("subtitle", "豆瓣副标题"), "translator": ("translator", "豆瓣译者"), "publisher": ("publisher",), "publish_year": ("publishYear", "豆瓣出版年份"),
    "call_number": ("call_no", "callNumber", "索书号"), "page_count": ("pageCount", "豆瓣页数"), "cover_url": ("coverUrl",),
    "description": ("summary", "description", "豆瓣内容简介"), "author_intro": ("authorIntro", "豆瓣作者简介"), "table_of_contents": ("tableOfContents", "豆瓣目录"),
    "isbn": ("isbn",), "match_source": ("match_source",), "embedding_id": ("embedding_id",), "source_query_type": ("source_query_type",),
}
SCORES = ("fused_score", "similarity_score", "reranker_score", "final_score")


def _field(item: str, name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({item}, '$[\"{name}\"]', '{kind}')")


def normalize_hits(items: DataFrame) -> DataFrame:
    """Books of raw hits (request_id, query_pos, pos, item: variant) (P5)."""
    text = lambda *names: first_text(*[_field("item", n) for n in names])
    number = lambda *names: F.coalesce(*[F.nullif(_field("item", n, "double"), F.lit(0.0)) for n in names])
    raw_id = F.coalesce(_field("item", "book_id"), _field("item", "id"))
    pos = F.col("pos").cast("string")
    return items.select(
        "request_id", "query_pos", "pos",
        F.when(is_blank(raw_id), F.concat(F.lit("book-"), pos)).otherwise(raw_id).alias("id"),
        F.coalesce(text("title", "豆瓣书名"), F.concat(F.lit("未知书名-"), pos)).alias("title"),
        F.coalesce(text("author", "豆瓣作者"), F.lit("未知作者")).alias("author"),
        *[text(*names).alias(k) for k, names in TEXT_FIELDS.items()],
        number("rating", "豆瓣评分").alias("rating"),
        *[_field("item", k, "double").alias(k) for k in SCORES],
        *[_field("item", k, "array<string>").alias(k) for k in ("highlights", "tags")],
    )


def parse_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Books of plain-text result lines; blank lines are gone before lines are numbered."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: ~is_blank(x))
    rows = df.select("request_id", "query_pos", F.posexplode(lines).alias("pos", "line"))
    hit = F.col("line").rlike(LINE)
    part = lambda k: trimmed(F.regexp_extract("line", LINE, k))
    return rows.select(
        "request_id", "query_pos", "pos",
        F.concat(F.lit("book-"), F.col("pos").cast("string")).alias("id"),
        F.when(hit, part(1)).otherwise(trimmed("line")).alias("title"),
        F.lit("未知作者").alias("author"),
        F.when(hit, F.array(part(2))).alias("highlights"),
        F.when(hit, F.regexp_extract("line", LINE, 3).try_cast("double")).alias("rating"),
        F.when(~hit, trimmed("line")).alias("description"),
    )


def parse_responses(df: DataFrame) -> DataFrame:
    """Books of response bodies (request_id, query_pos, body): results wins over context_plain_text."""
    v = df.withColumn("v", F.expr("try_parse_json(body)"))
    v = v.withColumns({"results": F.expr("variant_get(v, '$.results')"), "plain": F.expr("try_variant_get(v, '$.context_plain_text', 'string')")})
    is_array = F.coalesce(F.expr("schema_of_variant(results) like 'ARRAY%'"), F.lit(False))
    items = v.where(is_array).select("request_id", "query_pos", "results").alias("t")
    exploded = items.lateralJoin(items.sparkSession.tvf.variant_explode(F.col("t.results").outer())).select("request_id", "query_pos", F.col("pos").cast("int").alias("pos"), F.col("value").alias("item"))
    absent = F.coalesce(F.expr("schema_of_variant(results)") == "VOID", F.col("results").isNull())
    lines = parse_lines(v.where(absent & (F.coalesce("plain", F.lit("")) != "")), "plain")
    return normalize_hits(exploded).unionByName(lines, allowMissingColumns=True)


def filter_similarity(hits: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Hits whose similarity, else final score, exceeds the threshold."""
    return hits.where(first_number("similarity_score", "final_score") > threshold)


def auto_select(hits: DataFrame, rule: str = "similarity") -> DataFrame:
    """Hits ticked by default: by similarity only, or by ``any`` score."""
    if rule == "any":
        return hits.where(first_number("similarity_score", "final_score") > AUTO_ANY)
    return hits.where(first_number("similarity_score") > AUTO_SIMILARITY)


def relevance_score() -> Column:
    """A weighted mean of similarity, final, fused and rating."""
    return first_number("similarity_score") * 0.4 + first_number("final_score") * 0.3 + first_number("fused_score") * 0.2 + first_number("rating") / 10 * 0.1


def error_code(message: Column) -> Column:
    """The code of an error message."""
    return F.when(message.contains("timeout"), "TIMEOUT").when(message.contains("network"), "NETWORK_ERROR").when(message.contains("404"), "SERVICE_UNAVAILABLE").otherwise("UNKNOWN_ERROR")


def dedupe_key() -> Column:
    """Which hits are one book: by id, else embedding, else title and author."""
    plain = lambda c: trimmed(F.lower(F.coalesce(F.col(c), F.lit(""))))
    real = (F.coalesce(F.col("id"), F.lit("")) != "") & ~F.col("id").startswith("book-")
    return (
        F.when(real, F.concat(F.lit("book_id:"), F.col("id")))
        .when(first_text("embedding_id").isNotNull(), F.concat(F.lit("embedding:"), F.col("embedding_id")))
        .otherwise(F.concat(F.lit("title_author:"), plain("title"), F.lit("-"), plain("author")))
    )


def dedupe(hits: DataFrame, by: tuple[str, ...] = ("request_id", "query_pos")) -> DataFrame:
    """One hit a book of each response: the best score, the earliest of equal ones, at its first place."""
    keyed = hits.withColumns({"dedupe_key": dedupe_key(), "__score": first_number(*KEEP_SCORE)})
    mine = W.partitionBy(*by, "dedupe_key")
    first = F.min(F.struct("query_pos", "pos")).over(mine)
    best = F.row_number().over(mine.orderBy(F.desc("__score"), "query_pos", "pos"))
    return keyed.withColumns({"first": first, "__n": best}).where("__n = 1").drop("__n", "__score")


def merge_probes(hits: DataFrame, probe_results: DataFrame | None = None) -> DataFrame:
    """The books of all successful probes of a request, each once, with rank by score."""
    if probe_results is not None:
        hits = hits.join(probe_results.where("success").select("request_id", "query_pos").distinct(), ["request_id", "query_pos"], "left_semi")
    score = first_number(*KEEP_SCORE)
    best = W.partitionBy("request_id").orderBy(F.desc(score), "first")
    return dedupe(hits, ("request_id",)).withColumn("rank", F.row_number().over(best))


def filter_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """The hits selected by (request_id, id) (K4)."""
    return hits.join(ids.select("request_id", "id").distinct(), ["request_id", "id"], "left_semi")


def smart_select(hits: DataFrame, ids: DataFrame, threshold: float = SIMILARITY, max_books: int = MAX_BOOKS) -> DataFrame:
    """Selected hits in input order, best ones if too many; without a selection the similar ones."""
    asked = ids.select("request_id").distinct().withColumn("__asked", F.lit(True))
    picked = ids.select("request_id", "id").distinct().withColumn("__picked", F.lit(True))
    df = hits.join(asked, "request_id", "left").join(picked, ["request_id", "id"], "left")
    df = df.where(F.when(F.col("__asked"), F.col("__picked")).otherwise(first_number("similarity_score", "final_score") > threshold))
    group = W.partitionBy("request_id")
    by_score = F.row_number().over(group.orderBy(F.desc(first_number(*SORT_SCORE)), "query_pos", "pos"))
    by_place = F.row_number().over(group.orderBy("query_pos", "pos"))
    df = df.withColumns({"__n": F.count("*").over(group), "__s": by_score, "__p": by_place})
    in_order = F.col("__asked").isNotNull() & (F.col("__n") <= max_books)
    return df.withColumn("rank", F.when(in_order, F.col("__p")).otherwise(F.col("__s"))).where(F.col("rank") <= max_books).drop("__asked", "__picked", "__n", "__s", "__p")


def expanded_search(expansions: DataFrame, embed, corpus: DataFrame, top_k: int = SIMPLE_TOP_K, min_rating: float = MIN_RATING) -> tuple[DataFrame, DataFrame]:
    """(merged books, outcome by request) of expansions; embed turns search texts into vectors."""
    queries = embed(search_texts(expansions))
    hits = batch_search(queries, corpus, top_k, min_rating)
    merged = merge_probes(as_books(hits))
    outcome = queries.select("request_id", "query_pos").join(hits.groupBy("request_id", "query_pos").agg(F.count("*").alias("n")), ["request_id", "query_pos"], "left")
    return merged, outcome.groupBy("request_id").agg(F.coalesce(F.bool_or(F.col("n") > 0), F.lit(False)).alias("success"))


def expanded_text_search(expansions: DataFrame, index: Index, top_k: int = SIMPLE_TOP_K, min_rating: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged books, outcome by request) of expansions, by their texts over an index of texts.

    A request succeeds if any of its probes finds a book; one whose probes are all blank does not.
    """
    queries = search_texts(expansions)
    hits = text_search(queries, index, top_k, min_rating)
    hits = hits.select("request_id", "query_pos", "pos", F.col("id").alias("vec_id"), "similarity_score", F.lit(None).cast("double").alias("rating"))
    found = hits.select("request_id").distinct().withColumn("found", F.lit(True))
    outcome = queries.select("request_id").distinct().join(found, "request_id", "left").select("request_id", F.coalesce("found", F.lit(False)).alias("success"))
    return merge_probes(as_books(hits)), outcome


def as_books(found: DataFrame) -> DataFrame:
    """Search results as hits: titles and authors from the id, the rest empty."""
    vec = F.col("vec_id").cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    return found.select("request_id", "query_pos", "pos", vec.alias("id"), F.concat(F.lit("Book "), vec).alias("title"), F.lit("未知作者").alias("author"), "similarity_score", "rating", none("double").alias("final_score"), none("double").alias("fused_score"), none("string").alias("embedding_id"), none("string").alias("description"), none("array<string>").alias("highlights"))


def dedupe_stats(hits: DataFrame, by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Original, distinct and removed hits (A4)."""
    out = hits.groupBy(*by).agg(F.count("*").alias("original"), F.count_distinct(dedupe_key()).alias("deduplicated"))
    return out.withColumn("removed", F.col("original") - F.col("deduplicated"))


def search_stats(probe_results: DataFrame, hits: DataFrame) -> DataFrame:
    """Probes and books by request, before and after merging (A5)."""
    probes = probe_results.groupBy("request_id").agg(F.count("*").alias("probes"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.bool_or("success").alias("any_success"))
    good = hits.join(probe_results.where("success").select("request_id", "query_pos").distinct(), ["request_id", "query_pos"], "left_semi")
    return probes.join(dedupe_stats(good).select("request_id", F.col("original").alias("total_books"), F.col("deduplicated").alias("merged_books")), "request_id", "left").fillna(0, ["total_books", "merged_books"])


def book_line() -> Column:
    shown = F.coalesce(F.nullif(F.array_join("highlights", "；"), F.lit("")), first_text("description"), F.lit(""))
    return F.concat(F.lit("【"), F.col("title"), F.lit("】"), shown, F.lit(" - "), number_text(first_number("rating")), F.lit("分"))


def context_text(ranked: DataFrame) -> DataFrame:
    """(request_id, text): one line a book in rank order."""
    return ranked.groupBy("request_id").agg(ordered_lines(book_line(), F.col("rank")).alias("text"))


def _block(style: str) -> Column:
    """A book's text block; the column number counts from 1."""
    n = F.col("number").cast("string")
    text = lambda c, other: F.coalesce(first_text(c), F.lit(other))
    fixed = lambda c: F.when(F.col(c).isNull(), "暂无").otherwise(F.format_string("%.3f", F.col(c).cast("double")))
    rated = F.when(first_number("rating") == 0, F.lit(None)).otherwise(number_text("rating"))
    if style == "follow_up":
        short = F.when(F.length("description") > 100, F.concat(F.substring("description", 1, 100), F.lit("..."))).otherwise(first_text("description"))
        return F.concat_ws("\n", F.concat(F.lit("【"), n, F.lit("】《"), F.col("title"), F.lit("》")), F.concat(F.lit("作者: "), first_text("author")), F.concat(F.lit("简介: "), short))
    if style == "interpretation":
        return F.concat_ws("\n", F.concat(F.lit("## 图书 "), n), F.concat(F.lit("**书名：** "), F.col("title")), F.concat(F.lit("**作者：** "), F.col("author")), F.concat(F.lit("**评分：** "), F.coalesce(rated, F.lit("暂无评分"))), F.concat(F.lit("**相似度：** "), fixed("similarity_score")), F.concat(F.lit("**索书号：** "), text("call_number", "暂无")), F.concat(F.lit("**内容简介：** "), text("description", "暂无简介")), F.concat(F.lit("**融合分数：** "), fixed("fused_score")), F.concat(F.lit("**最终分数：** "), fixed("final_score")))
    optional = lambda name, c: F.coalesce(F.concat(F.lit(f"**{name}**: "), c), F.lit(""))
    listed = F.nullif(F.array_join("highlights", "; "), F.lit(""))
    return F.concat_ws(
        "\n", F.concat(F.lit("## 书籍 "), n), F.lit(""), F.concat(F.lit("**书名**: "), F.col("title")), optional("副标题", first_text("subtitle")),
        F.concat(F.lit("**作者**: "), F.col("author")), optional("出版社", first_text("publisher")), optional("出版年份", first_text("publish_year")), optional("评分", rated),
        optional("索书号", first_text("call_number")), F.lit(""), F.lit("**内容简介**:"), text("description", "暂无简介"), F.lit(""),
        F.coalesce(F.concat(F.lit("**作者简介**:\n"), first_text("author_intro")), F.lit("")), F.lit(""), optional("亮点", listed), F.lit(""), F.lit("---"), F.lit(""),
    )


def book_blocks(ranked: DataFrame, style: str = "follow_up") -> DataFrame:
    """(request_id, text): the blocks of ranked books (A10): follow_up, interpretation or deep."""
    df = ranked.withColumn("number", F.col("rank"))
    return df.groupBy("request_id").agg(ordered_lines(_block(style), F.col("rank"), "\n" if style == "deep" else "\n\n").alias("text"))


def apply_selection(ops: DataFrame) -> DataFrame:
    """(request_id, id) selected after (request_id, seq, op: add, remove or clear, id) (U4)."""
    cleared = ops.where("op = 'clear'").groupBy("request_id").agg(F.max("seq").alias("cleared"))
    last = ops.where("op <> 'clear'").groupBy("request_id", "id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return last.join(cleared, "request_id", "left").where("op = 'add' and seq > coalesce(cleared, -1)").select("request_id", "id")
