"""Web and document research: parsing model output, snippets by keyword, combining analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.exprs import first_text, is_blank, strip_fence, trimmed
from lectern.operators.retrieval import ordered_lines

# Limits of uploads and snippets, and the texts shown for what is missing.
MAX_FILES, MAX_BYTES, SNIPPETS = 5, 5 * 1024 * 1024, 8
NO_SNIPPET, TOPIC, TOPIC_TITLE, TOPIC_URL = "暂无摘要", "DuckDuckGo", "DuckDuckGo 结果 ", "https://duckduckgo.com"
# Title, url and snippet (around the query) of a search that failed, and of one that could not be made.
DOWN = ("网络连接问题", "https://duckduckgo.com", '无法连接到外部搜索服务。关于"', '"的搜索暂时不可用，请检查网络连接或稍后重试。')
GONE = ("搜索服务暂时不可用", "", '无法完成对"', '"的搜索，请稍后重试。')
SEPARATOR = "\n\n---\n\n"
#: engine: (default title, default url, whether empty text counts as missing)
ENGINES = {"duckduckgo": (TOPIC_TITLE, TOPIC_URL, False), "jina": ("搜索结果 ", "", True)}


def _exploded(df: DataFrame, array: str, outer: bool = False) -> DataFrame:
    """df with pos and value of the elements of a variant column."""
    t = df.alias("t")
    made = t.sparkSession.tvf.variant_explode_outer if outer else t.sparkSession.tvf.variant_explode
    return t.lateralJoin(made(F.col(f"t.{array}").outer())).drop("key")


def parse_expansions(raw: DataFrame) -> DataFrame:
    """(request_id, original_query, success, probes: array<struct<type, label, text>>) of (request_id, query, raw_output).

    Output that is no JSON, or has no array expanded_probes, is a failure without probes.
    """
    schema = "array<struct<type: string, label: string, text: string>>"
    v = raw.withColumn("v", F.try_parse_json(strip_fence("raw_output")))
    probes = F.try_variant_get("v", "$.expanded_probes", schema)
    ok = F.coalesce(F.expr("schema_of_variant(variant_get(v, '$.expanded_probes')) like 'ARRAY%'"), F.lit(False)) & probes.isNotNull()
    filled = F.transform(probes, lambda p, i: F.struct(
        F.coalesce(first_text(p["type"]), F.concat(F.lit("probe_"), i.cast("string"))).alias("type"),
        F.coalesce(first_text(p["label"]), F.concat(F.lit("探针"), (i + 1).cast("string"))).alias("label"),
        F.coalesce(p["text"], F.lit("")).alias("text")))
    kept = F.filter(filled, lambda p: ~is_blank(p["text"]))
    said = first_text(F.when(ok, F.try_variant_get("v", "$.original_query", "string")), "query")
    none = F.array().cast(schema)
    return v.select("request_id", said.alias("original_query"), ok.alias("success"), F.when(ok, kept).otherwise(none).alias("probes"))


def parse_keywords(raw: DataFrame) -> DataFrame:
    """(request_id, pos, keyword, reason, priority) of (request_id, input, raw_output); the input itself where it can't be parsed."""
    schema = "array<struct<keyword: string, reason: string, priority: string>>"
    v = F.try_parse_json(strip_fence("raw_output"))
    own = F.array(F.struct(F.col("input").alias("keyword"), F.lit("基于用户原始输入").alias("reason"), F.lit("high").alias("priority")))
    got = F.when(v.isNull(), own).otherwise(F.try_variant_get(v, "$.keywords", schema))
    return raw.select("request_id", F.posexplode(got).alias("pos", "k")).select("request_id", "pos", "k.*")


def validate_uploads(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (batch_id, name, size, present) with reason: why it is refused, null if it is taken.

    present files are there already; a batch that would have more than max_files is refused whole.
    """
    total = F.count("*").over(W.partitionBy("batch_id"))
    reason = F.when(total > max_files, "too_many").when(~F.lower("name").endswith(".md"), "type").when(F.col("size") > max_bytes, "size")
    return files.withColumn("__reason", reason).where(~F.col("present")).withColumnRenamed("__reason", "reason")


def normalize_snippets(raw: DataFrame, engine: str) -> DataFrame:
    """raw (…, pos, title, url, snippet, summary, description, content) with defaults of an engine."""
    title, url, empty = ENGINES[engine]
    pick = first_text if empty else lambda *c: F.coalesce(*[F.col(x) if isinstance(x, str) else x for x in c])
    text = first_text("description", F.substring("content", 1, 200)) if empty else F.coalesce("snippet", "summary")
    numbered = F.concat(F.lit(title), (F.col("pos") + 1).cast("string"))
    keys = [c for c in ("request_id", "keyword_pos", "keyword", "pos") if c in raw.columns]
    return raw.select(*keys, F.lit(engine).alias("engine"), F.coalesce(pick("title"), numbered).alias("title"), F.coalesce(pick("url"), F.lit(url)).alias("url"), F.coalesce(text, F.lit(NO_SNIPPET)).alias("snippet"), "content")


def _said(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "string")


def _numbered(title: str, pos: Column) -> Column:
    return F.concat(F.lit(title), (pos + 1).cast("string"))


def _nesting(body: Column) -> Column:
    """How deep arrays nest in a JSON text, strings left out; never more than it names Topics, and one."""
    brackets = F.regexp_replace(F.regexp_replace(body, r'"(\\.|[^"\\])*"', ""), r"[^\[\]]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c == "[", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "[", 1).otherwise(-1)).alias("most"))
    deepest = F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    return F.least(deepest, F.regexp_count(body, F.lit('"Topics"')) + 1)


def flatten_topics(responses: DataFrame, k: int) -> DataFrame:
    """(request_id, pos, title, url, snippet): the first k leaves of nested Topics, related ones before results.

    responses: (request_id, body: JSON with RelatedTopics and Results). One aggregate finds how
    deep topics nest, while this is called; then each row passes once through as many steps, in
    which topics give way to what they hold and leaves stay. A topic whose Topics is no array is a leaf.
    """
    depth = responses.agg(F.max(_nesting(F.col("body")))).first()[0] or 0
    v = responses.select("request_id", F.try_parse_json("body").alias("v")).where("v is not null")
    listed = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    ranked = lambda name, rank: F.transform(listed(name), lambda x, i: F.struct(F.array(F.lit(rank), i).alias("path"), x.alias("item")))
    rows = v.select("request_id", F.explode(F.concat(ranked("RelatedTopics", 0), ranked("Results", 1))).alias("e")).select("request_id", "e.*")
    inner = F.try_variant_get("item", "$.Topics", "array<variant>")
    nested = F.coalesce(F.schema_of_variant(F.try_variant_get("item", "$.Topics", "variant")).startswith("ARRAY"), F.lit(False)) & (F.col("path")[0] == 0)
    for _ in range(depth - 1):
        rows = rows.select("request_id", "path", F.posexplode(F.when(nested, inner).otherwise(F.array("item"))).alias("pos", "item"))
        rows = rows.select("request_id", F.concat("path", F.array("pos")).alias("path"), "item")
    related = F.col("path")[0] == 0
    rows = rows.where(~nested).select(
        "request_id", "path", F.coalesce(_said("Text"), F.when(related, F.coalesce(_said("FirstURL"), F.lit(TOPIC))), _numbered(TOPIC_TITLE, F.col("path")[1])).alias("title"),
        F.coalesce(_said("FirstURL"), F.lit(TOPIC_URL)).alias("url"), F.coalesce(_said("Result"), F.when(related, _said("Text")), F.lit(NO_SNIPPET)).alias("snippet"),
    )
    first = W.partitionBy("request_id").orderBy("path")
    return rows.withColumn("pos", F.row_number().over(first) - 1).where(F.col("pos") < k).select("request_id", "pos", "title", "url", "snippet")


def parse_tool_items(items: DataFrame) -> DataFrame:
    """(request_id, pos, title, url, snippet) of tool results (request_id, item_pos, type, body).

    A body is a JSON array or object; other text makes a snippet titled by its first 40
    characters. What a payload lacks has its default, numbered by the payload's place.
    """
    rows = items.select("request_id", "item_pos", "type", trimmed("body").alias("body")).where("body <> ''").withColumn("v", F.try_parse_json("body"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    place = ["request_id", "item_pos"]
    many = _exploded(rows.where(listed).select(*place, "v"), "v").select(*place, F.col("pos").alias("inner"), F.col("value").alias("item"))
    one = rows.where(~listed).select(*place, F.lit(0).alias("inner"), F.col("v").alias("item"))
    found = many.unionByName(one).select(*place, "inner", _said("title").alias("title"), _said("url").alias("url"), F.coalesce(_said("snippet"), _said("summary")).alias("snippet"))
    free = rows.where(F.col("v").isNull() & (F.col("type") == "text")).select(*place, F.lit(0).alias("inner"), F.substring("body", 1, 40).alias("title"), F.lit(None).cast("string").alias("url"), F.col("body").alias("snippet"))
    pos = F.row_number().over(W.partitionBy("request_id").orderBy("item_pos", "inner")) - 1
    out = found.unionByName(free).withColumn("pos", pos)
    return out.select("request_id", "pos", F.coalesce("title", _numbered(TOPIC_TITLE, F.col("pos"))).alias("title"), F.coalesce("url", F.lit(TOPIC_URL)).alias("url"), F.coalesce("snippet", F.lit(NO_SNIPPET)).alias("snippet"))


def enrich_content(snippets: DataFrame, pages: DataFrame) -> DataFrame:
    """snippets whose empty content is filled from pages (url, content); only those take part in the join (K5)."""
    needs = is_blank("content") & ~is_blank("url")
    full = pages.groupBy("url").agg(F.min("content").alias("__full"))
    filled = snippets.where(needs).join(full, "url", "left").withColumn("content", F.coalesce("__full", "content")).drop("__full")
    return snippets.where(~needs).unionByName(filled)


def fallback_union(primary: DataFrame, secondary: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's rows of the first engine that has any.

    queries: (request_id, query, failed, broken). Two engines without rows leave a query empty,
    unless the second one failed: then there is one row that says so, or, if broken (it could not
    even say so), the row of a service that can't be reached.
    """
    both = primary.withColumn("__p", F.lit(0)).unionByName(secondary.withColumn("__p", F.lit(1)))
    best = both.withColumn("__best", F.min("__p").over(W.partitionBy("request_id"))).where("__p = __best").drop("__p", "__best")
    lost = queries.where("failed or broken").join(both.select("request_id").distinct(), "request_id", "left_anti")
    said = lambda texts: F.concat(F.lit(texts[0]), F.col("query"), F.lit(texts[1]))
    pick = lambda down, gone: F.when(F.coalesce("broken", F.lit(False)), gone).otherwise(down)
    made = {"pos": F.lit(0), "engine": F.lit("duckduckgo"), "title": pick(F.lit(DOWN[0]), F.lit(GONE[0])), "url": pick(F.lit(DOWN[1]), F.lit(GONE[1])), "snippet": pick(said(DOWN[2:]), said(GONE[2:]))}
    row = [made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.col(f.name) if f.name == "request_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in primary.schema.fields]
    return best.unionByName(lost.select(*row))


def top_snippets(snippets: DataFrame, k: int = SNIPPETS) -> DataFrame:
    """The first k snippets of each keyword."""
    return snippets.withColumn("__n", F.row_number().over(W.partitionBy("request_id", "keyword_pos").orderBy("pos"))).where(F.col("__n") <= k).drop("__n")


def snippet_text(snippets: DataFrame) -> DataFrame:
    """(request_id, keyword_pos, text): numbered snippets, blank lines between."""
    n = F.row_number().over(W.partitionBy("request_id", "keyword_pos").orderBy("pos"))
    line = F.concat(F.lit("【"), F.col("__n").cast("string"), F.lit("】"), F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("snippet", F.lit(""))))
    return snippets.withColumn("__n", n).groupBy("request_id", "keyword_pos").agg(ordered_lines(line, F.col("__n"), "\n\n").alias("text"))


def combine(parts: DataFrame, by: str = "request_id") -> DataFrame:
    """(by, text, chars, snippets): analyses that are not blank, in order, failures by their message.

    parts: (by, pos, analysis, error, n_snippets). chars is the length of what is joined, without
    separators: trimmed analyses, and failures' messages.
    """
    said = trimmed(first_text("analysis", "error"))
    kept = F.when(said != "", F.struct(F.col("pos").alias("o"), said.alias("l")))
    rows = F.sort_array(F.collect_list(kept))
    text = F.array_join(F.transform(rows, lambda r: r["l"]), SEPARATOR)
    return parts.groupBy(by).agg(text.alias("text"), F.coalesce(F.sum(F.length(said)), F.lit(0)).alias("chars"), F.sum("n_snippets").alias("snippets"))


def keyword_lines(keywords: DataFrame) -> DataFrame:
    """(request_id, text): one line a keyword."""
    line = F.concat(F.lit("- "), F.col("keyword"), F.lit(" ("), F.col("priority"), F.lit(")"))
    return keywords.groupBy("request_id").agg(ordered_lines(line, F.col("pos")).alias("text"))


def upload_stats(files: DataFrame) -> DataFrame:
    """(batch_id, uploading, ready, error)."""
    return files.groupBy("batch_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("uploading", "ready", "error")])


# The report outline: a topic with name, keywords and abstract, article tables, insights.


def _field(line: Column, name: str) -> Column:
    return first_text(trimmed(F.regexp_extract(line, rf"^-\s*{name}\s*[:：]\s*(.*)$", 1)))


def report_lines(reports: DataFrame) -> DataFrame:
    """(request_id, pos, line, section, article) of (request_id, markdown), headings carried down."""
    rows = reports.select("request_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "raw")).withColumn("line", trimmed("raw")).drop("raw")
    above = W.partitionBy("request_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    section = F.when(F.col("line").rlike(r"^##\s[^#]"), trimmed(F.regexp_extract("line", r"^##\s+(.*)$", 1)))
    article = F.when(F.col("line").rlike(r"^###\s*文章"), F.regexp_extract("line", r"^###\s*文章\s*(\d+)", 1).try_cast("int"))
    return rows.withColumns({"section": F.last(section, True).over(above), "article": F.last(article, True).over(above)})


def report_topics(reports: DataFrame) -> DataFrame:
    """(request_id, name, keywords, abstract, insights) of Markdown reports."""
    rows = report_lines(reports)
    topic = rows.where("section = '共同母题'").groupBy("request_id").agg(
        F.first(_field(F.col("line"), "名称"), True).alias("name"), F.first(_field(F.col("line"), "关键词"), True).alias("__k"), F.first(_field(F.col("line"), "摘要"), True).alias("abstract")
    )
    said = trimmed(F.regexp_extract("line", r"^-\s+(.*)$", 1))
    insight = F.when((F.col("section") == "深度洞察") & (said != ""), F.struct(F.col("pos").alias("o"), said.alias("l")))
    insights = rows.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(insight)), lambda r: r["l"]).alias("insights"))
    return topic.join(insights, "request_id").select("request_id", "name", F.filter(F.transform(F.split("__k", "[,，]"), trimmed), lambda x: x != "").alias("keywords"), "abstract", "insights")


def report_articles(reports: DataFrame) -> DataFrame:
    """(request_id, article, article_id, focus, tags, books: array<struct<title, author>>) of Markdown reports."""
    rows = report_lines(reports).where("section = '文章列表' and article is not null and line like '|%'")
    cell = lambda k: trimmed(F.regexp_extract("line", r"^\|([^|]*)\|(.*)\|$", k))
    value = lambda name: F.first(F.when(cell(1) == name, cell(2)), True)
    out = rows.groupBy("request_id", "article").agg(value("ID").alias("article_id"), value("主题聚焦").alias("focus"), value("标签").alias("__t"), value("提及书籍").alias("__b"))
    books = F.from_json("__b", "array<struct<title: string, author: string>>", {"allowSingleQuotes": "true"})
    none = F.array().cast("array<struct<title: string, author: string>>")
    return out.select("request_id", "article", "article_id", "focus", F.filter(F.transform(F.split("__t", "[,，]"), trimmed), lambda x: x != "").alias("tags"), F.when(F.col("__b") == "无", none).otherwise(F.coalesce(books, none)).alias("books"))
