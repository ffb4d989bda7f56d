"""The registered queries: each operator over whole tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import exprs as X
from lectern.operators import archive, curation, dialogue, manifest, research, retrieval, textsearch
from lectern.plans.tables import duck, given, hits, sheet, table
from lectern.sources import files
from lectern.streaming import progress
from lectern.streaming.current import CurrentState

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None, *names: str):
    """Register a query under its function's name; body is its SQL over the derived tables named."""

    def put(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = duck(body, *names)
        return f

    return put


# Fixed expressions of the SQL side.
TRIM = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(12288))"
NUM = lambda c: f"(case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end)"
FIRST = lambda *c: f"coalesce({', '.join(f'nullif({x}, 0)' for x in c)}, 0)"
LINKED = "'https://catalogue.example/Search/Results?searchtype=vague&lookfor=' || replace(replace(replace(replace(replace(replace(replace(replace(trim(call_number), '/', '%2F'), '#', '%23'), '*', '%2A'), ' ', '%20'), '+', '%2B'), '=', '%3D'), '?', '%3F'), '&', '%26') || '&type=CallNumber'"
VALID = "pass = '通过' and coalesce(barcode, '') not in ('', '0')"
KIND = "case when collection_id like '____-subject-%' then 'subject' when collection_id like '____-sleeping-%' then 'sleeping_beauty' else 'month' end"
NAME = "case when collection_id like '____-subject-%' then substr(collection_id, 14) when collection_id like '____-sleeping-%' then substr(collection_id, 15) else collection_id end"
FOLDER = f"case {KIND} when 'subject' then substr(collection_id, 1, 4) || '/subject/' || {NAME} when 'sleeping_beauty' then substr(collection_id, 1, 4) || '/new/' || {NAME} else substr(collection_id, 1, 4) || '/' || collection_id end"
MONTH = "translate(substr(collection_id, 1, 4), '0123456789', '零一二三四五六七八九') || '年 ' || ['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二'][cast(substr(collection_id, 6, 2) as int)] || '月'"
RANDOM = lambda s: f"(sin(cast(list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({s}, ''), lambda x: cast(ord(x) as bigint))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) as double)) * 10000)"
FRACTION = lambda s: f"({RANDOM(s)} - floor({RANDOM(s)}))"
DEDUPE_KEY = "case when id <> '' and id not like 'book-%' then 'book_id:' || id when embedding_id <> '' then 'embedding:' || embedding_id else 'title_author:' || trim(lower(coalesce(title, ''))) || '-' || trim(lower(coalesce(author, ''))) end"
KEEP = FIRST("final_score", "similarity_score", "rating")


# Scalar functions


@query(f"select barcode, case when trim(call_number) <> '' then {LINKED} end as link from curation", "curation")
def f1_call_number_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "curation").select("barcode", X.call_number_link("call_number").alias("link"))


@query("select path, 'base/content/' || collection_path || '/' || path as key from files", "files")
def f2_object_key(spark, sf_dir):
    return table(spark, sf_dir, "files").select("path", X.object_key(F.lit("/content/"), F.lit(""), F.concat(F.lit("\\"), "collection_path"), "path", base="/base/").alias("key"))


@query("select path, '/' || path as url from files", "files")
def f3_public_url(spark, sf_dir):
    return table(spark, sf_dir, "files").select("path", X.public_url(F.concat(F.lit("//"), "path")).alias("url"))


@query("""select collection_id, barcode, case when u = '' or u like 'http%' or u like '/%' then u else 'http://cdn/' || u end as url
    from (select *, coalesce(nullif(originalImageUrl, ''), nullif(coverImageUrl, ''), '') u from books)""", "books")  # fmt: skip
def f4_image_url(spark, sf_dir):
    return table(spark, sf_dir, "books").select("collection_id", "barcode", X.image_url("originalImageUrl", "coverImageUrl", "http://cdn/").alias("url"))


@query(f"""select collection_id, barcode, '/api/images/' || collection_id || '/' || barcode || '/cover' as cover, '/content/' || {FOLDER} || '/' || barcode || '/' || barcode || '_thumb.jpg' as thumb from books""", "books")
def f5_legacy_paths(spark, sf_dir):
    return table(spark, sf_dir, "books").select("collection_id", "barcode", X.card_path("collection_id", "barcode", "cover").alias("cover"), X.thumbnail_path("collection_id", "barcode").alias("thumb"))


@query(f"select distinct collection_id, {FOLDER} as path, {KIND} as kind, substr(collection_id, 1, 4) as year, {NAME} as name, collection_id as back from books", "books")
def f6_collection_identity(spark, sf_dir):
    out = archive.with_identity(table(spark, sf_dir, "books").select("collection_id").distinct()).withColumn("path", X.collection_path("collection_id"))
    return out.withColumn("back", X.collection_id("path"))


LABELS = f"""select collection_id, case {KIND} when 'month' then {MONTH} when 'subject' then coalesce(t, {NAME}) else {NAME} end as label from (select distinct collection_id from books) left join
    (select collection_id, coalesce(nullif(trim(regexp_extract(f, '^([^：:]*)', 1)), ''), f) t from (select collection_id, regexp_replace(min(file_name), '[.]md$', '') f from companions where lower(file_name) not like 'readme%' group by 1)) using (collection_id)"""


@query(LABELS, "books", "companions")
def f7_f8_labels(spark, sf_dir):
    return archive.collections(table(spark, sf_dir, "books"), table(spark, sf_dir, "companions")).select("collection_id", "label")


@query("""select request_id, regexp_extract(raw_output, '(?s)([a-z{].*[}])', 1) as stripped, case when request_id % 4 in (0, 3) then regexp_extract(raw_output, '(?s)([{].*[}])', 1) else raw_output end as whole from outputs""".replace("([a-z{].*[}])", "((?:broken )?[{].*[}])"), "outputs")
def f12_code_fences(spark, sf_dir):
    return table(spark, sf_dir, "outputs").select("request_id", X.strip_fence("raw_output").alias("stripped"), X.unfence("raw_output").alias("whole"))


OK = "request_id % 4 <> 2"


PROBES = f"""select request_id, 0 as pos, 'one ' || request_id as text, 'a' || request_id % 3 as label, 'probe_0' as type from outputs where {OK} and request_id % 7 > 0
    union all select request_id, 1, 'two ' || request_id, '探针3', 'u' || request_id % 5 from outputs where {OK} and request_id % 7 > 0"""


@query(f"select request_id, case when {OK} then 'q' || request_id else query end as original_query, {OK} as success, pos, text, label, type from outputs left join ({PROBES}) using (request_id)", "outputs")
def f13_parse_expansions(spark, sf_dir):
    out = research.parse_expansions(table(spark, sf_dir, "outputs").withColumnRenamed("query", "query"))
    return out.select("request_id", "original_query", "success", F.posexplode_outer("probes").alias("pos", "p")).select("request_id", "original_query", "success", "pos", "p.text", "p.label", "p.type")


@query(f"""select request_id, 0 as pos, case when {OK} then 'k' || request_id else query end as keyword, case when {OK} then 'r' || request_id % 3 else '基于用户原始输入' end as reason, case when not {OK} then 'high' when request_id % 2 = 0 then 'low' else 'medium' end as priority from outputs
    union all select request_id, 1, 'z' || request_id, null, 'Niche' from outputs where {OK} and request_id % 3 = 0""", "outputs")  # fmt: skip
def f14_parse_keywords(spark, sf_dir):
    return research.parse_keywords(table(spark, sf_dir, "outputs").withColumnRenamed("query", "input"))


@query(f"""select request_id, case when {OK} and request_id % 3 = 0 then 'other' else 'search' end as intent, case when {OK} then case request_id % 5 when 0 then 0.0 when 1 then 0.5 else 1.0 end::double else 0.5::double end as confidence,
    case when {OK} then 'why ' || request_id else 'LLM 分类失败，回落到默认检索' end as reason, case when {OK} then 'llm' else 'rule' end as source from outputs""", "outputs")  # fmt: skip
def f15_parse_intent(spark, sf_dir):
    out = table(spark, sf_dir, "outputs").select("request_id", dialogue.parse_intent(F.col("raw_output"), F.col("query")).alias("v"))
    return out.select("request_id", "v.intent", "v.confidence", "v.reason", "v.source")


@query("select conv_id, turn, role || ': ' || coalesce(text, '') as text from messages", "messages")
def f16_message_text(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("role")), part("image", F.lit("x")), part("text", F.lit(": ")), part("text", F.col("text")))
    return table(spark, sf_dir, "messages").select("conv_id", "turn", X.message_text(parts).alias("text"))


@query("""select conv_id, turn, '# 当前用户输入' || chr(10) || t || case when mode is null then '' else chr(10) || chr(10) || chr(10) || '# 历史对话' || chr(10) || mode end as classifier,
    concat_ws(chr(10) || chr(10), 'base', mode, intent, nullif(trim(draft), '')) as system from (select *, TRIMMED t from turns)""".replace("TRIMMED", TRIM("text")), "turns")  # fmt: skip
def f17_prompt_sections(spark, sf_dir):
    return table(spark, sf_dir, "turns").select("conv_id", "turn", X.classifier_prompt("text", "mode").alias("classifier"), X.system_prompt(F.lit("base"), "mode", "intent", F.trim("draft")).alias("system"))


REPORT = "# 交叉主题分析报告 - x\n\n## 共同母题\n\n- 名称: N{id}\n\n- 关键词: a{id}, b, c\n\n- 摘要: about {id}\n\n## 文章列表\n\n### 文章 1: first\n\n| 字段 | 内容 |\n| --- | --- |\n| ID | A{id} |\n| 主题聚焦 | focus |\n| 标签 | x, y |\n| 提及书籍 | [{{'title': 'T{id}', 'author': 'U'}}, {{'title': 'V', 'author': 'W'}}] |\n\n### 文章 2: second\n\n| 字段 | 内容 |\n| --- | --- |\n| ID | B{id} |\n| 主题聚焦 | f2 |\n| 标签 | z |\n| 提及书籍 | 无 |\n\n## 深度洞察\n\n- one {id}\n- two\n"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "messages").select(F.col("conv_id").alias("request_id")).distinct()
    return ids.withColumn("markdown", F.replace(F.lit(REPORT.format(id="@")), F.lit("@"), F.col("request_id").cast("string")))


@query("select distinct conv_id as request_id, 'N' || conv_id as name, 'a' || conv_id || '|b|c' as keywords, 'about ' || conv_id as abstract, 'one ' || conv_id || '|two' as insights from messages", "messages")
def f18_report_topics(spark, sf_dir):
    out = research.report_topics(reports(spark, sf_dir))
    return out.select("request_id", "name", F.array_join("keywords", "|").alias("keywords"), "abstract", F.array_join("insights", "|").alias("insights"))


@query("""select distinct conv_id as request_id, 1 as article, 'A' || conv_id as article_id, 'focus' as focus, 'x|y' as tags, 'T' || conv_id || '/U|V/W' as books from messages
    union all select distinct conv_id, 2, 'B' || conv_id, 'f2', 'z', '' from messages""", "messages")  # fmt: skip
def f18_report_articles(spark, sf_dir):
    books = F.array_join(F.transform("books", lambda b: F.concat(b["title"], F.lit("/"), b["author"])), "|")
    return research.report_articles(reports(spark, sf_dir)).select("request_id", "article", "article_id", "focus", F.array_join("tags", "|").alias("tags"), books.alias("books"))


@query(f"select collection_id, barcode, round({FRACTION('k')}, 6) as r, round({FRACTION(chr(39) + 's-0' + chr(39))}, 6) as fixed from (select *, collection_id || '-' || barcode as k from books)", "books")
def t6_seeded_random(spark, sf_dir):
    df = table(spark, sf_dir, "books")
    return df.select("collection_id", "barcode", F.round(X.seeded_random(F.concat_ws("-", "collection_id", "barcode")), 6).alias("r"), F.round(X.seeded_randoms(F.lit("s"), 2)[0], 6).alias("fixed"))


# Curation


@query("select barcode, title, author from curation where pass = '通过'", "curation")
def p1_approved(spark, sf_dir):
    return curation.approved(sheet(spark, sf_dir)).select(F.col("书目条码").alias("barcode"), F.col("豆瓣书名").alias("title"), F.col("豆瓣作者").alias("author"))


@query("select coalesce(barcode, '') in ('', '0') as rejected, count(*) as n from curation where pass = '通过' group by 1", "curation")
def p2_valid(spark, sf_dir):
    """The numbers observed while the valid rows are written."""
    ok, counts = curation.counted(curation.approved(sheet(spark, sf_dir)))
    ok.write.parquet(files.scratch(spark, "valid"))
    return spark.createDataFrame([(False, counts.get["valid"]), (True, counts.get["rejected"])], "rejected boolean, n long").where("n > 0")


@query(f"select collection_path, barcode, nullif(title, '') as title, nullif(call_number, '') as call_number, case when trim(call_number) <> '' then {LINKED} end as link, isbn from curation where {VALID}", "curation")
def p3_project(spark, sf_dir):
    out = curation.project(curation.valid(curation.approved(sheet(spark, sf_dir)))[0])
    return out.select("collection_path", F.col("书目条码").alias("barcode"), F.col("豆瓣书名").alias("title"), F.col("索书号").alias("call_number"), F.col("索书号链接").alias("link"), F.col("ISBN").alias("isbn"))


CDN = "'http://cdn/content/' || collection_path || '/' || b || '/' || "
ASSETS = f"""select collection_path, b as barcode, max(case when k = 1 then {CDN} b || '.png' end) as cardImageUrl, max(case when k = 1 then {CDN} b || '_thumb.jpg' end) as cardThumbnailUrl,
    max(case when k = 2 then {CDN} b || '_original.png' end) as originalImageUrl, max(case when k = 2 then {CDN} b || '_original_thumb.jpg' end) as originalThumbnailUrl,
    max(case when k = 3 then {CDN} 'pic/cover.jpg' end) as coverImageUrl, max(case when k = 3 then {CDN} 'pic/cover_thumb.jpg' end) as coverThumbnailUrl
    from (select *, split_part(path, '/', 1) b, case when path like '%-S.png' then 1 when path like '%cover.jpg' then 3 when path like '%/pic/%' then 4 else 2 end k from files) where k < 4 group by 1, 2"""


@query(ASSETS, "files")
def k2_asset_records(spark, sf_dir):
    return curation.asset_records(table(spark, sf_dir, "files"), "http://cdn/")


@query(f"select collection_path, barcode, cardImageUrl, originalImageUrl, coverImageUrl from (select collection_path, barcode from curation where {VALID}) left join ({ASSETS}) using (collection_path, barcode)", "curation", "files")
def k1_content_build(spark, sf_dir):
    out = curation.build(sheet(spark, sf_dir), table(spark, sf_dir, "files"), "http://cdn/")
    return out.select("collection_path", F.col("书目条码").alias("barcode"), "cardImageUrl", "originalImageUrl", "coverImageUrl")


@query(f"select collection_path, barcode from curation where {VALID} and barcode not in (select split_part(path, '/', 1) from files)", "curation", "files")
def k3_missing_assets(spark, sf_dir):
    books = curation.project(curation.valid(curation.approved(sheet(spark, sf_dir)))[0])
    return curation.missing_assets(books, table(spark, sf_dir, "files")).select("collection_path", F.col("书目条码").alias("barcode"))


JSON_SIZE = lambda cols: "sum(2 + greatest(0, " + " + ".join(f"coalesce({len(c) + 6} + length({c}), 0)" for c in cols) + " - 1))"


@query(f"""select rows_before, json_before, rows_after, json_after, round((1 - json_after / json_before) * 100, 1) as reduction from
    (select count(*) rows_before, {JSON_SIZE(["barcode", "title", "author"])} json_before from curation), (select count(*) rows_after, {JSON_SIZE(["barcode", "title"])} json_after from curation where pass = '通过')""", "curation")  # fmt: skip
def a12_build_metrics(spark, sf_dir):
    """Both sizes observed by the one job that writes the published rows."""
    rows, before = curation.measured(table(spark, sf_dir, "curation").select("pass", "barcode", "title", "author"), "barcode", "title", "author")
    kept, after = curation.measured(rows.where("pass = '通过'"), "barcode", "title")
    kept.write.parquet(files.scratch(spark, "published"))
    return spark.createDataFrame([curation.reduction(before, after)], "rows_before long, json_before long, rows_after long, json_after long, reduction double")


@query("select collection_path, barcode, nullif(title, '') as title, pass from curation".replace("barcode,", "nullif(barcode, '') as barcode,"), "curation")
def s1_curation_rows(spark, sf_dir):
    """Written as a sheet export and read back."""
    path = files.scratch(spark, "sheet")
    sheet(spark, sf_dir).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_rows(spark, path).select("collection_path", F.col("书目条码").alias("barcode"), F.col("豆瓣书名").alias("title"), F.col("人工评选").alias("pass"))


@query(f"select collection_id, pos, barcode, {KIND} as kind, substr(collection_id, 1, 4) as year from books", "books")
def s4_write_collections(spark, sf_dir):
    """Written by collection and read back."""
    path = files.scratch(spark, "collections")
    files.write_collections(table(spark, sf_dir, "books"), path)
    return files.read_written(spark, path).select("collection_id", "pos", "barcode", "kind", "year")


HEAT = "select *, quantile_cont(n, 0.9) over () hot, quantile_cont(n, 0.5) over () cool from (select barcode, count(*) n from returns group by 1)"


@query(f"select barcode, n, case when n >= cool then 'normal' else 'cooled' end as band from ({HEAT}) where n <= hot", "returns")
def c1_heat_bands(spark, sf_dir):
    return curation.heat_bands(table(spark, sf_dir, "returns"))


@query()
def c1_period_bands(spark, sf_dir):
    """Bands of half a year of returns, its cuts merged from the months' stored sketches; close to exact, so without SQL."""
    monthly = curation.monthly_returns(given(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("barcode"), F.col("l_shipdate").alias("returned_at")))
    monthly = files.written(monthly, "monthly-returns")
    sketches = files.written(curation.heat_sketches(monthly), "heat-sketches")
    return curation.period_bands(monthly, sketches, "1996-01", "1996-06")


CLASS = "upper(substr(ltrim(call_number), 1, 1))"


@query(f"select barcode, call_number from curation where {CLASS} in ('D', 'I', 'J', 'K') and title not like '%ring%'", "curation")
def c2_class_filter(spark, sf_dir):
    return curation.class_filter(table(spark, sf_dir, "curation"), deny=("ring",)).select("barcode", "call_number")


@query(f"select barcode, rating from curation where cast(rating as double) >= case {CLASS} when 'I' then 8.0 when 'K' then 7.8 when 'B' then 8.2 else 0 end", "curation")
def c3_rating_gate(spark, sf_dir):
    return curation.rating_gate(table(spark, sf_dir, "curation")).select("barcode", "rating")


@query("select barcode, reviews from curation where reviews between 200 and 1200", "curation")
def c4_review_gate(spark, sf_dir):
    return curation.review_gate(table(spark, sf_dir, "curation"), 200, 1200).select("barcode", "reviews")


@query("select barcode from curation where trim(cover) <> '' and trim(summary) <> '' and trim(isbn) <> ''", "curation")
def c5_complete(spark, sf_dir):
    return curation.complete(table(spark, sf_dir, "curation")).select("barcode")


@query("select barcode from curation where barcode is null or barcode not in (select barcode from history)", "curation", "history")
def c6_not_published(spark, sf_dir):
    return curation.not_published(table(spark, sf_dir, "curation"), table(spark, sf_dir, "history")).select("barcode")


@query("""select barcode, theme, rating from (select *, row_number() over (partition by theme order by rating desc, barcode) n from (select barcode, theme, cast(rating as double) rating from curation where coalesce(barcode, '') <> ''))
    where n <= 6 order by rating desc, barcode limit 10""", "curation")  # fmt: skip
def c7_staged_top(spark, sf_dir):
    rows = table(spark, sf_dir, "curation").where("coalesce(barcode, '') <> ''").select("barcode", "theme", F.col("rating").cast("double").alias("rating"))
    return curation.staged_top(rows)


# Archive


def _tree(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """A folder tree with the books of each collection as one array; broken spoils those of December."""
    root = files.scratch(spark, "tree")
    book = F.struct(F.col("barcode").alias("书目条码"), F.col("title").alias("豆瓣书名"), F.col("author").alias("豆瓣作者"))
    rows = table(spark, sf_dir, "books").groupBy("collection_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("pos", book.alias("b")))), lambda x: x["b"])).alias("value"))
    if broken:
        rows = rows.withColumn("value", F.when(F.col("collection_id").endswith("12"), F.concat(F.lit("oops "), "value")).otherwise(F.col("value")))
    archive.with_identity(rows).drop("collection_id").repartition("year", "kind", "name").write.partitionBy("year", "kind", "name").text(root)
    return root


@query(f"select collection_id, pos, barcode, title, author, {KIND} as kind, {NAME} as name from books", "books")
def s2_read_collections(spark, sf_dir):
    """Written as one array a collection and read back."""
    good, _ = files.read_collections(spark, _tree(spark, sf_dir), "part-*")
    return good.select("collection_id", "pos", F.col("书目条码").alias("barcode"), F.col("豆瓣书名").alias("title"), F.coalesce("豆瓣作者", F.lit("")).alias("author"), "kind", "name")


@query("select collection_id, collection_id like '%12' as bad, count(*) filter (collection_id not like '%12') as books from books group by 1", "books")
def s3_unreadable_collections(spark, sf_dir):
    """Some of the files broken: those collections are reported, the others read."""
    good, bad = files.read_collections(spark, _tree(spark, sf_dir, broken=True), "part-*")
    read = good.groupBy("collection_id").agg(F.count("*").alias("books"))
    return read.select("collection_id", F.lit(False).alias("bad"), "books").union(bad.select("collection_id", F.lit(True), F.lit(0).cast("long")))


@query("select distinct collection_id, 'About ' || file_name as content from companions", "companions")
def s5_companions(spark, sf_dir):
    """Companion files written below their collection's folder and read back."""
    root = files.scratch(spark, "companions")
    rows = archive.with_identity(table(spark, sf_dir, "companions").distinct()).withColumn("value", F.concat(F.lit("About "), "file_name"))
    rows.select("value", "year", "kind", "name").repartition("year", "kind", "name").write.partitionBy("year", "kind", "name").text(root)
    return files.read_companions(spark, root, "part-*").select("collection_id", F.regexp_replace("content", "\n$", "").alias("content"))


@query("""select collection_id, barcode as id, title, coalesce(author, '') as author, coalesce(nullif(coverImageUrl, ''), '/api/images/' || collection_id || '/' || barcode || '/cover') as coverUrl,
    case when cardThumbnailUrl is null then '/content/' || """ + FOLDER + """ || '/' || barcode || '/' || barcode || '_thumb.jpg' else '/' || cardThumbnailUrl end as cardThumbnailUrl,
    case when coalesce(originalImageUrl, '') = '' then '' else '/' || originalImageUrl end as originalImageUrl from books""", "books")  # fmt: skip
def p4_typed_view(spark, sf_dir):
    out = archive.to_books(table(spark, sf_dir, "books").withColumnsRenamed({"barcode": "书目条码", "title": "豆瓣书名", "author": "豆瓣作者"}))
    return out.select(F.col("month").alias("collection_id"), "id", "title", "author", "coverUrl", "cardThumbnailUrl", "originalImageUrl")


@query("""select pos, coalesce(nullif(originalImageUrl, ''), coverImageUrl) as url from books where collection_id = (select max(collection_id) from books where length(collection_id) = 7) and coalesce(nullif(originalImageUrl, ''), coverImageUrl, '') <> ''""", "books")
def p20_hero_images(spark, sf_dir):
    return archive.hero_images(table(spark, sf_dir, "books"))


@query("select collection_id, count(*) as book_count from books group by 1", "books")
def a1_collection_counts(spark, sf_dir):
    return archive.collection_counts(table(spark, sf_dir, "books"))


@query("select substr(collection_id, 1, 4) as year, count(distinct collection_id) as issues, count(*) as books from books group by 1", "books")
def a2_year_stats(spark, sf_dir):
    return archive.year_stats(archive.collections(table(spark, sf_dir, "books")))


@query(f"""select substr(collection_id, 1, 4) as year, coalesce(string_agg(collection_id, '|' order by collection_id desc) filter ({KIND} = 'month'), '') as months,
    coalesce(string_agg(collection_id, '|' order by collection_id desc) filter ({KIND} = 'sleeping_beauty'), '') as sleeping, coalesce(string_agg(collection_id, '|' order by collection_id) filter ({KIND} = 'subject'), '') as subjects
    from (select distinct collection_id from books) group by 1""", "books")  # fmt: skip
def a3_t1_year_index(spark, sf_dir):
    out = archive.year_index(archive.collections(table(spark, sf_dir, "books")))
    return out.select("year", F.array_join("months", "|").alias("months"), F.array_join("sleeping_beauties", "|").alias("sleeping"), F.array_join("subjects", "|").alias("subjects"))


@query("select collection_id, 'Vol. ' || row_number() over (order by collection_id) as vol from (select distinct collection_id from books where length(collection_id) = 7)", "books")
def w1_volumes(spark, sf_dir):
    return archive.volumes(archive.collections(table(spark, sf_dir, "books")))


@query("select max(collection_id) as collection_id from books where length(collection_id) = 7", "books")
def t2_latest(spark, sf_dir):
    return archive.latest(archive.collections(table(spark, sf_dir, "books"))).select("collection_id")


@query(f"""select collection_id, n, barcode, case when u = '' or u like '/%' then coalesce(nullif(u, ''), '/content/' || {FOLDER} || '/' || barcode || '/' || barcode || '_thumb.jpg') else '/' || u end as url from
    (select *, coalesce(cardThumbnailUrl, cardImageUrl, '') u, row_number() over (partition by collection_id order by {FRACTION("'preview-' || collection_id || '-' || barcode")}, barcode) n from books)
    where n <= floor({FRACTION("'preview-' || collection_id")} * 3 + 4)""", "books")  # fmt: skip
def t4_previews(spark, sf_dir):
    return archive.previews(table(spark, sf_dir, "books"))


@query(f"select collection_id, barcode, round({FRACTION(chr(39) + 'shuffle-' + chr(39) + ' || collection_id || ' + chr(39) + '-' + chr(39) + ' || barcode')}, 6) as shuffle_key from books", "books")
def t5_shuffle(spark, sf_dir):
    out = archive.shuffle(table(spark, sf_dir, "books")).orderBy("shuffle_key", "collection_id", "barcode")
    return out.select("collection_id", "barcode", F.round("shuffle_key", 6).alias("shuffle_key"))


@query(f"""select collection_id, barcode, place from (select *, row_number() over (order by {FRACTION(chr(39) + 'shuffle-' + chr(39) + ' || collection_id || ' + chr(39) + '-' + chr(39) + ' || barcode')}, collection_id, barcode) - 1 as place from books) where place >= 150 and place < 200""", "books")
def t5_page(spark, sf_dir):
    """The fourth page of fifty of a stored shuffle."""
    path = files.scratch(spark, "shuffle")
    archive.store_shuffle(table(spark, sf_dir, "books"), path, stretch=1000)
    return archive.shuffled_page(spark, path, 3, 50, 1000).select("collection_id", "barcode", "place")


@query("select collection_id as source_id, barcode from books", "books")
def u1_all_books(spark, sf_dir):
    books = archive.with_identity(table(spark, sf_dir, "books"))
    return archive.all_books(*[books.where(F.col("kind") == k) for k in ("month", "subject", "sleeping_beauty")]).select("source_id", "barcode")


@query("select distinct substr(collection_id, 1, 4) as year from books union select '2099'", "books")
def u2_nav_years(spark, sf_dir):
    return archive.nav_years(archive.collections(table(spark, sf_dir, "books")), spark.createDataFrame([("2099",)], "year string"))


@query("select json_extract_string(v, '$.b') as barcode, length(v) as size from (select '{\"b\":\"' || barcode || '\",\"t\":\"' || title || '\"}' v from books where collection_id = (select max(collection_id) from books))", "books")
def s7_export(spark, sf_dir):
    books = table(spark, sf_dir, "books").select("collection_id", F.col("barcode").alias("b"), F.col("title").alias("t"))
    newest = books.agg(F.max("collection_id")).first()[0]
    out = archive.export_book(books.withColumn("barcode", F.col("b")).select("collection_id", "barcode", "b", "t"), newest)
    lean = F.to_json(F.from_json("value", "b string, t string"))
    return out.select(F.get_json_object("value", "$.b").alias("barcode"), F.length(lean).cast("long").alias("size"))


@query("""select barcode, '{"b":"' || barcode || '","t":"' || title || '"}' as value from books where collection_id = (select max(collection_id) from books) and barcode = (select min(barcode) from books where collection_id = (select max(collection_id) from books))""", "books")
def s7_export_book(spark, sf_dir):
    """One book of the newest collection, by its barcode."""
    books = table(spark, sf_dir, "books").select("collection_id", "barcode", F.col("barcode").alias("b"), F.col("title").alias("t"))
    newest = books.agg(F.max("collection_id")).first()[0]
    least = books.where(F.col("collection_id") == newest).agg(F.min("barcode")).first()[0]
    out = archive.export_book(books, newest, least)
    return out.select(F.get_json_object("value", "$.b").alias("barcode"), F.to_json(F.from_json("value", "b string, t string")).alias("value"))


# Retrieval


@query("""select request_id, query_pos, 0 as pos, cast(request_id * 4 + query_pos as varchar) as id, 'T' || (request_id * 4 + query_pos) as title, '未知作者' as author, 8.5::double as rating, 0.5::double as similarity_score, null as description, null as call_number from responses where query_pos = 0
    union all select request_id, query_pos, 1, 'book-1', '未知书名-1', 'A', null, null, 's', 'I1' from responses where query_pos = 0
    union all select request_id, query_pos, 0, 'book-0', 'B' || (request_id * 4 + query_pos), '未知作者', 8.5, null, null, null from responses where query_pos = 1
    union all select request_id, query_pos, 1, 'book-1', 'other line', '未知作者', null, null, 'other line', null from responses where query_pos = 1""", "responses")  # fmt: skip
def p5_p6_p7_parse_responses(spark, sf_dir):
    return retrieval.parse_responses(table(spark, sf_dir, "responses")).select("request_id", "query_pos", "pos", "id", "title", "author", "rating", "similarity_score", "description", "call_number")


@query(f"select request_id, query_pos, pos, id from hits where {FIRST('similarity_score', 'final_score')} > 0.42", "hits")
def p8_filter_similarity(spark, sf_dir):
    return retrieval.filter_similarity(hits(spark, sf_dir)).select("request_id", "query_pos", "pos", "id")


@query(f"select request_id, query_pos, pos, 'similarity' as rule from hits where {FIRST('similarity_score')} > 0.42 union all select request_id, query_pos, pos, 'any' from hits where {FIRST('similarity_score', 'final_score')} > 0.4", "hits")
def p9_auto_select(spark, sf_dir):
    df = hits(spark, sf_dir)
    pick = lambda rule: retrieval.auto_select(df, rule).select("request_id", "query_pos", "pos", F.lit(rule).alias("rule"))
    return pick("similarity").union(pick("any"))


@query("select request_id, query_pos, pos, round(coalesce(similarity_score, 0) * 0.4 + coalesce(final_score, 0) * 0.3 + coalesce(fused_score, 0) * 0.2 + coalesce(rating, 0) / 10 * 0.1, 6) as score from hits", "hits")
def p11_relevance_score(spark, sf_dir):
    return hits(spark, sf_dir).select("request_id", "query_pos", "pos", F.round(retrieval.relevance_score(), 6).alias("score"))


@query("select event_id, case when message like '%timeout%' then 'TIMEOUT' when message like '%network%' then 'NETWORK_ERROR' when message like '%404%' then 'SERVICE_UNAVAILABLE' else 'UNKNOWN_ERROR' end as code from errors", "errors")
def p22_error_code(spark, sf_dir):
    return table(spark, sf_dir, "errors").select("event_id", retrieval.error_code(F.col("message")).alias("code"))


@query("select h.request_id, query_pos, pos, h.id from hits h where exists (select 1 from ids i where i.request_id = h.request_id and i.id = h.id)", "hits", "ids")
def k4_filter_ids(spark, sf_dir):
    return retrieval.filter_ids(hits(spark, sf_dir), table(spark, sf_dir, "ids")).select("request_id", "query_pos", "pos", "id")


@query(f"""select request_id, query_pos, query from (select request_id, 0 as query_pos, case when {OK} then 'q' || request_id else query end as query from outputs
    union all select request_id, pos + 1, text from ({PROBES}))""", "outputs")  # fmt: skip
def r1_search_texts(spark, sf_dir):
    return retrieval.search_texts(research.parse_expansions(table(spark, sf_dir, "outputs")))


COSINE = "round(list_cosine_similarity(s.embedding::double[], c.embedding::double[]), 9)"
SEARCH = lambda k, least: f"select request_id, query_pos, vec_id, sim, pos, rating from (select s.request_id, s.query_pos, c.vec_id, c.rating, {COSINE} sim, row_number() over (partition by s.request_id, s.query_pos order by {COSINE} desc, c.vec_id) - 1 pos from searches s, corpus c where c.rating >= {least}) where pos < {k}"


@query(f"select request_id, query_pos, vec_id, round(sim, 6) as similarity_score, pos from ({SEARCH(10, 6.0)})", "searches", "corpus")
def r2_p10_batch_search(spark, sf_dir):
    out = retrieval.batch_search(table(spark, sf_dir, "searches"), table(spark, sf_dir, "corpus"), retrieval.SIMPLE_TOP_K, retrieval.MIN_RATING)
    return out.select("request_id", "query_pos", "vec_id", F.round("similarity_score", 6).alias("similarity_score"), "pos")


@query(f"""select request_id, vec_id, round(fused_score, 6) as fused_score, pos from (select *, row_number() over (partition by request_id order by fused_score desc, vec_id) - 1 pos from
    (select request_id, vec_id, round(sum(1.0::double / (pos + 61)), 9) fused_score from ({SEARCH(12, 0)}) group by 1, 2)) where pos < 8""", "searches", "corpus")  # fmt: skip
def r3_multi_query(spark, sf_dir):
    out = retrieval.multi_query(table(spark, sf_dir, "searches"), table(spark, sf_dir, "corpus"))
    return out.select("request_id", "vec_id", F.round("fused_score", 6).alias("fused_score"), "pos")


TERMS = lambda text: f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
BM25 = f"""tf as (select doc_id, term, count(*) tf from (select doc_id, unnest({TERMS('text')}) term from documents) group by 1, 2),
    sizes as (select doc_id, coalesce(len({TERMS('text')}), 0) size from documents), mean as (select count(*) n, sum(size)::double / count(*) mean from sizes), df as (select term, count(*) df from tf group by 1),
    impacts as (select doc_id, term, floor(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * size / mean))) * 1000000)::bigint impact from tf join sizes using (doc_id) join df using (term), mean)"""


def _found(queries: str, k: int, rated: str = "true") -> str:
    """The SQL of a text search: queries (request_id, query_pos, query) against documents."""
    return f"""with {BM25}, asked as (select request_id, query_pos, term, count(*) w from (select request_id, query_pos, unnest({TERMS('query')}) term from ({queries})) group by 1, 2, 3)
    select request_id, query_pos, doc_id as id, score, row_number() over (partition by request_id, query_pos order by score desc, doc_id) - 1 as pos from (select request_id, query_pos, doc_id, sum(impact * w)::bigint score from asked join impacts using (term) where {rated} group by 1, 2, 3) qualify pos < {k}"""


@query(f"select request_id, query_pos, id, score::double / 1000000 as similarity_score, pos from ({_found('select * from text_searches', 8)})", "text_searches")
def r2_text_search(spark, sf_dir):
    """The whole texts of every hundredth document as queries over all documents."""
    index = textsearch.build_index(given(spark, sf_dir, "documents"), "doc_id")
    return textsearch.text_search(table(spark, sf_dir, "text_searches"), index)


PROBED = "select request_id, row_number() over (partition by request_id order by probe) - 1 as query_pos, text as query from document_probes where probe = 0 or (request_id % 4 <> 1 and trim(coalesce(text, '')) <> '')"
MERGED_TEXTS = f"""select *, row_number() over (partition by request_id order by score desc, query_pos, pos) as rank from (select *, row_number() over (partition by request_id, id order by score desc, query_pos, pos) n,
    first_value(query_pos) over (partition by request_id, id order by query_pos, pos) fq, first_value(pos) over (partition by request_id, id order by query_pos, pos) fp from ({_found(PROBED, 10, 'doc_id % 100 >= 60')})) where n = 1""".replace("order by score desc, query_pos, pos) as rank", "order by score desc, fq, fp) as rank")


def _text_expansions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Merged books and outcomes of expansions whose queries are texts of documents."""
    part = lambda k: F.max(F.when(F.col("probe") == k, F.col("text")))
    probe = lambda k: F.struct(F.lit("p").alias("type"), F.lit("l").alias("label"), part(k).alias("text"))
    expansions = table(spark, sf_dir, "document_probes").groupBy("request_id").agg(part(0).alias("original_query"), F.array(probe(1), probe(2)).alias("probes")).withColumn("success", F.expr("request_id % 4 <> 1"))
    index = textsearch.build_index(table(spark, sf_dir, "rated_documents"), "doc_id", rating="rating")
    return retrieval.expanded_text_search(expansions, index, min_rating=retrieval.MIN_RATING)


@query(f"select request_id, query_pos, pos, id::varchar as id, rank, score::double / 1000000 as similarity_score from ({MERGED_TEXTS})", "document_probes")
def r8_text_search(spark, sf_dir):
    """Expanded searches whose original queries and probes are whole texts."""
    return _text_expansions(spark, sf_dir)[0].select("request_id", "query_pos", "pos", "id", "rank", "similarity_score")


@query(f"select request_id, max(id) is not null as success from (select distinct request_id from ({PROBED})) left join ({_found(PROBED, 10, 'doc_id % 100 >= 60')}) using (request_id) group by 1", "document_probes")
def r8_search_outcome(spark, sf_dir):
    return _text_expansions(spark, sf_dir)[1]


ABSTRACT = "# 交叉主题分析报告\n\n## 共同母题\n\n- 名称: N\n\n- 关键词: "
WEIGHTS = f"weights as (select term, floor(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * 1000)::bigint idf from (select term, count(distinct doc_id) df from (select doc_id, unnest({TERMS('text')}) term from documents) group by 1), (select count(*) n from documents))"
VECTORS = lambda keys, rows, text: f"""select {keys}, list(v order by j) as embedding from (select {keys}, j, sum(tf * idf * (1 - 2 * (((strpos('0123456789abcdef', substr(md5(term), 1 + j // 4, 1)) - 1) >> (j % 4)) & 1)))::double v
    from (select {keys}, term, count(*) tf from (select {keys}, unnest({TERMS(text)}) term from ({rows})) group by all) join weights using (term), (select unnest(range(0, 64))::int j) group by all) group by all"""  # noqa: E731


@query(f"""select request_id, vec_id, round(fused_score, 6) as fused_score, pos from (with {WEIGHTS}, books as ({VECTORS('doc_id', 'select doc_id, text from documents', 'text')}),
    asked as ({VECTORS('request_id, query_pos', "select request_id, 0 as query_pos, abstract as query from abstracts where abstract <> '' union all select request_id, k, split_part(abstract, ' ', k) from abstracts, (select unnest([1, 2]) k) where split_part(abstract, ' ', k) <> ''", 'query')}),
    near as (select request_id, doc_id as vec_id, row_number() over (partition by request_id, query_pos order by round(list_cosine_similarity(a.embedding, b.embedding), 9) desc, doc_id) - 1 pos from asked a, books b where list_sum(list_transform(a.embedding, lambda x: abs(x))) > 0 and list_sum(list_transform(b.embedding, lambda x: abs(x))) > 0 qualify pos < 12)
    select *, row_number() over (partition by request_id order by fused_score desc, vec_id) - 1 pos from (select request_id, vec_id, round(sum(1.0::double / (pos + 61)), 9) fused_score from near group by 1, 2)) where pos < 8""", "abstracts")  # fmt: skip
def r3_report_search(spark, sf_dir):
    """Reports on conversations as Markdown, parsed, and the documents nearest to their abstracts and keywords."""
    first = lambda k: F.split_part("abstract", F.lit(" "), F.lit(k))
    markdown = F.concat(F.lit(ABSTRACT), first(1), F.lit(", "), first(2), F.lit("\n\n- 摘要: "), F.col("abstract"), F.lit("\n\n## 深度洞察\n"))
    topics = research.report_topics(table(spark, sf_dir, "abstracts").select("request_id", markdown.alias("markdown")))
    return retrieval.report_search(topics, given(spark, sf_dir, "documents"), "doc_id").select("request_id", "vec_id", F.round("fused_score", 6).alias("fused_score"), "pos")


@query(f"select request_id, query_pos, pos, {DEDUPE_KEY} as dedupe_key from hits", "hits")
def r4_dedupe_key(spark, sf_dir):
    return hits(spark, sf_dir).select("request_id", "query_pos", "pos", retrieval.dedupe_key().alias("dedupe_key"))


BEST = lambda by: f"select *, row_number() over (partition by {by}, k order by s desc, query_pos, pos) n, min(query_pos * 100000 + pos) over (partition by {by}, k) first from (select *, {DEDUPE_KEY} k, {KEEP} s from hits)"


@query(f"select request_id, query_pos, pos, id, k as dedupe_key, first % 100000 as first_pos from ({BEST('request_id, query_pos')}) where n = 1", "hits")
def r5_dedupe(spark, sf_dir):
    return retrieval.dedupe(hits(spark, sf_dir)).select("request_id", "query_pos", "pos", "id", "dedupe_key", F.col("first.pos").cast("long").alias("first_pos"))


GOOD = "hits as (select h.* from hits0 h join probe_results p using (request_id, query_pos) where p.success)"
MERGED = f"select request_id, query_pos, pos, id, title, description, shown, rating, similarity_score, fused_score, final_score, call_number, author, row_number() over (partition by request_id order by s desc, first) as rank from ({BEST('request_id')}) where n = 1"


def _merged_sql(select: str) -> str:
    return duck("", "hits", "probe_results").replace("WITH hits AS", "WITH hits0 AS").rstrip() + f", {GOOD} " + select


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.merge_probes(hits(spark, sf_dir), table(spark, sf_dir, "probe_results"))


@query()
def r6_merge_probes(spark, sf_dir):
    return _merged(spark, sf_dir).select("request_id", "query_pos", "pos", "id", "rank")


ORACLES["r6_merge_probes"] = _merged_sql(f"select request_id, query_pos, pos, id, rank from ({MERGED})")


@query(f"""select request_id, query_pos, pos, id, case when asked and n <= 8 then p else s end as rank from (select *, count(*) over (partition by request_id) n,
    row_number() over (partition by request_id order by {FIRST('final_score', 'similarity_score')} desc, query_pos, pos) s, row_number() over (partition by request_id order by query_pos, pos) p
    from (select h.*, h.request_id in (select request_id from ids) asked, exists (select 1 from ids i where i.request_id = h.request_id and i.id = h.id) picked from hits h)
    where case when asked then picked else {FIRST('similarity_score', 'final_score')} > 0.42 end) where case when asked and n <= 8 then p else s end <= 8""", "hits", "ids")  # fmt: skip
def r7_smart_select(spark, sf_dir):
    return retrieval.smart_select(hits(spark, sf_dir), table(spark, sf_dir, "ids")).select("request_id", "query_pos", "pos", "id", "rank")


@query(f"""select request_id, query_pos, pos, id, rank, sim as similarity_score from (select *, row_number() over (partition by request_id order by coalesce(nullif(s, 0), 0) desc, query_pos, pos) rank from
    (select *, cast(vec_id as varchar) id, round(sim, 6) s0, row_number() over (partition by request_id, vec_id order by sim desc, query_pos, pos) n, sim s from ({SEARCH(10, 6.0)})) where n = 1)""".replace("sim as similarity_score", "s0 as similarity_score"), "searches", "corpus")  # fmt: skip
def r8_expanded_search(spark, sf_dir):
    searches = table(spark, sf_dir, "searches")
    texts = searches.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("query_pos", F.col("query_id").cast("string").alias("t")))), lambda x: x["t"]).alias("t"))
    probe = F.transform(F.slice("t", 2, F.size("t")), lambda x: F.struct(F.lit("p").alias("type"), F.lit("l").alias("label"), x.alias("text")))
    expansions = texts.select("request_id", F.col("t")[0].alias("original_query"), F.lit(True).alias("success"), probe.alias("probes"))
    vectors = searches.select(F.col("query_id").cast("string").alias("query"), "embedding")
    merged, _ = retrieval.expanded_search(expansions, lambda q: q.join(vectors, "query"), table(spark, sf_dir, "corpus"))
    return merged.select("request_id", "query_pos", "pos", "id", "rank", F.round("similarity_score", 6).alias("similarity_score"))


@query(f"select request_id, count(*) as original, count(distinct {DEDUPE_KEY}) as deduplicated, count(*) - count(distinct {DEDUPE_KEY}) as removed from hits group by 1", "hits")
def a4_dedupe_stats(spark, sf_dir):
    return retrieval.dedupe_stats(hits(spark, sf_dir))


@query()
def a5_search_stats(spark, sf_dir):
    return retrieval.search_stats(table(spark, sf_dir, "probe_results"), hits(spark, sf_dir))


ORACLES["a5_search_stats"] = _merged_sql(f"""select request_id, probes, succeeded, failed, any_success, coalesce(total_books, 0) as total_books, coalesce(merged_books, 0) as merged_books from
    (select request_id, count(*) probes, count(*) filter (success) succeeded, count(*) filter (not success) failed, bool_or(success) any_success from probe_results group by 1)
    left join (select request_id, count(*) total_books, count(distinct {DEDUPE_KEY}) merged_books from hits group by 1) using (request_id)""")


@query()
def a6_context_text(spark, sf_dir):
    return retrieval.context_text(_merged(spark, sf_dir))


ORACLES["a6_context_text"] = _merged_sql(f"select request_id, string_agg('【' || title || '】' || coalesce(shown, description, '') || ' - ' || {NUM('rating')} || '分', chr(10) order by rank) as text from ({MERGED}) group by 1")


@query()
def a10_follow_up_blocks(spark, sf_dir):
    return retrieval.book_blocks(_merged(spark, sf_dir), "follow_up")


ORACLES["a10_follow_up_blocks"] = _merged_sql(f"select request_id, string_agg('【' || rank || '】《' || title || '》' || chr(10) || '作者: ' || author || coalesce(chr(10) || '简介: ' || description, ''), chr(10) || chr(10) order by rank) as text from ({MERGED}) group by 1")


@query()
def a10_interpretation_blocks(spark, sf_dir):
    return retrieval.book_blocks(_merged(spark, sf_dir), "interpretation")


ORACLES["a10_interpretation_blocks"] = _merged_sql(f"""select request_id, string_agg(concat_ws(chr(10), '## 图书 ' || rank, '**书名：** ' || title, '**作者：** ' || author, '**评分：** ' || case when rating = 0 then '暂无评分' else {NUM('rating')} end,
    '**相似度：** ' || coalesce(printf('%.3f', similarity_score), '暂无'), '**索书号：** ' || coalesce(nullif(call_number, ''), '暂无'), '**内容简介：** ' || coalesce(description, '暂无简介'),
    '**融合分数：** ' || coalesce(printf('%.3f', fused_score), '暂无'), '**最终分数：** ' || coalesce(printf('%.3f', final_score), '暂无')), chr(10) || chr(10) order by rank) as text from ({MERGED}) group by 1""")


@query()
def a10_deep_blocks(spark, sf_dir):
    df = _merged(spark, sf_dir)
    for c in ("subtitle", "publisher", "publish_year", "author_intro"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return retrieval.book_blocks(df, "deep")


ORACLES["a10_deep_blocks"] = _merged_sql(f"""select request_id, string_agg(concat_ws(chr(10), '## 书籍 ' || rank, '', '**书名**: ' || title, '', '**作者**: ' || author, '', '', case when rating = 0 then '' else '**评分**: ' || {NUM('rating')} end,
    case when call_number = '' then '' else '**索书号**: ' || call_number end, '', '**内容简介**:', coalesce(description, '暂无简介'), '', '', '', case when shown is null then '' else '**亮点**: ' || replace(shown, '；', '; ') end, '', '---', ''), chr(10) order by rank) as text from ({MERGED}) group by 1""")


@query("""select request_id, id from (select request_id, id, arg_max(op, seq) op, max(seq) seq from selection_ops where op <> 'clear' group by 1, 2) l
    left join (select request_id, max(seq) cleared from selection_ops where op = 'clear' group by 1) using (request_id) where op = 'add' and seq > coalesce(cleared, -1)""", "selection_ops")  # fmt: skip
def u4_apply_selection(spark, sf_dir):
    return retrieval.apply_selection(table(spark, sf_dir, "selection_ops"))


# Dialogue

INJECTED = "regexp_matches(text, '(?i)ignore\\s+previous|forget\\s+instructions?|system\\s+prompt|jailbreak|act\\s+as|越狱|提示词|注入|指令')"


@query(f"select conv_id, turn, coalesce({INJECTED}, false) as injected from turns", "turns")
def p12_injection_flag(spark, sf_dir):
    return table(spark, sf_dir, "turns").select("conv_id", "turn", dialogue.injection_flag(F.col("text")).alias("injected"))


@query(f"""select conv_id, turn, case when mode is null or t = '' or {INJECTED} or regexp_matches(lower(t), '^(你好|您好|hello|hi|嗨|在吗|在不在)') then false
    when mode = 'deep' then length(t) <= 24 and regexp_matches(lower(t), '(继续|下一步|接着|继续执行|go on|next|proceed|确认执行)$') else length(t) <= 12 and lower(t) in ('继续', 'ok', '收到') end as bypass from (select *, {TRIM('text')} t from turns)""", "turns")  # fmt: skip
def p13_can_bypass(spark, sf_dir):
    return table(spark, sf_dir, "turns").select("conv_id", "turn", dialogue.can_bypass(F.col("text"), F.col("mode")).alias("bypass"))


@query(f"""select conv_id, turn, case when refuse then 'reply' when trim(draft) <> '' then 'deep' else mode end as route, case when refuse then suggested_query end as reply_query
    from (select *, intent = 'other' or coalesce({INJECTED}, false) refuse from turns)""", "turns")  # fmt: skip
def p14_route(spark, sf_dir):
    df = table(spark, sf_dir, "turns").withColumn("injection", dialogue.injection_flag(F.col("text")))
    return dialogue.route(df).select("conv_id", "turn", "route", "reply_query")


@query("select conv_id, arg_max(text, turn) as text from messages where role = 'user' and trim(text) <> '' group by 1", "messages")
def w2_latest_user(spark, sf_dir):
    return dialogue.latest_user(table(spark, sf_dir, "messages"))


@query("select conv_id, coalesce(arg_max(text, turn), '') as text from messages where role = 'assistant' group by 1", "messages")
def w4_last_assistant(spark, sf_dir):
    return dialogue.last_assistant(table(spark, sf_dir, "messages"))


@query("""select conv_id, string_agg('[' || role || '] ' || substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 280), chr(10) order by turn) as summary
    from (select *, row_number() over (partition by conv_id order by turn desc) n from messages) where n <= 6 group by 1""", "messages")  # fmt: skip
def w3_summary(spark, sf_dir):
    return dialogue.summary(table(spark, sf_dir, "messages"))


# Research


@query("""select batch_id, name, case when n > 5 then 'too_many' when lower(name) not like '%.md' then 'type' when size > 5242880 then 'size' end as reason from (select *, count(*) over (partition by batch_id) n from uploads) where not present""", "uploads")
def p15_validate_uploads(spark, sf_dir):
    return research.validate_uploads(table(spark, sf_dir, "uploads")).select("batch_id", "name", "reason")


@query("""select request_id, keyword_pos, pos, 'duckduckgo' as engine, coalesce(title, 'DuckDuckGo 结果 ' || (pos + 1)) as title, coalesce(url, 'https://duckduckgo.com') as url, coalesce(snippet, summary, '暂无摘要') as snippet from snippets
    union all select request_id, keyword_pos, pos, 'jina', coalesce(nullif(title, ''), '搜索结果 ' || (pos + 1)), coalesce(url, ''), coalesce(nullif(description, ''), nullif(substr(content, 1, 200), ''), '暂无摘要') from snippets""", "snippets")  # fmt: skip
def p16_normalize_snippets(spark, sf_dir):
    df = table(spark, sf_dir, "snippets")
    return research.normalize_snippets(df, "duckduckgo").unionByName(research.normalize_snippets(df, "jina")).drop("content")


TOPIC_LEAVES = """select request_id, 0 as o, 'first ' || request_id as title, 'u' || request_id as url, 'r' as snippet from topics where request_id % 11 > 0
    union all select request_id, 1, 'v' || request_id, 'v' || request_id, '暂无摘要' from topics where request_id % 11 > 0 and request_id % 2 = 0
    union all select request_id, 2, 'deep ' || request_id, 'https://duckduckgo.com', 'deep ' || request_id from topics where request_id % 11 > 0
    union all select request_id, 3, 'DuckDuckGo', 'https://duckduckgo.com', '暂无摘要' from topics where request_id % 11 > 0
    union all select request_id, 4, 'last ' || request_id, 'https://duckduckgo.com', 's' from topics where request_id % 11 > 0 and request_id % 3 = 0
    union all select request_id, 4, 'DuckDuckGo 结果 1', 'https://duckduckgo.com', '暂无摘要' from topics where request_id % 11 > 0 and request_id % 3 > 0
    union all select request_id, 5, 'DuckDuckGo 结果 2', 'w', '暂无摘要' from topics where request_id % 11 > 0 and request_id % 3 > 0"""


@query(f"select request_id, pos, title, url, snippet from (select *, row_number() over (partition by request_id order by o) - 1 pos from ({TOPIC_LEAVES})) where pos < 5", "topics")
def p17_flatten_topics(spark, sf_dir):
    return research.flatten_topics(table(spark, sf_dir, "topics"), 5)


TOOL_ROWS = """select request_id, 0 as o, 'a' || request_id as title, 'u' || request_id as url, 's' as snippet from tool_items where item_pos = 0
    union all select request_id, 1, null, null, null from tool_items where item_pos = 0 and request_id % 2 = 0
    union all select request_id, 2, null, null, 'sum ' || request_id from tool_items where item_pos = 0
    union all select request_id, 3, 'c' || request_id, null, '' from tool_items where item_pos = 1
    union all select request_id, 4, substr(trim(body), 1, 40), null, trim(body) from tool_items where item_pos = 2
    union all select request_id, 5, null, 'j' || request_id, null from tool_items where item_pos = 3 and request_id % 4 > 0"""


@query(f"""select request_id, pos, coalesce(title, 'DuckDuckGo 结果 ' || (pos + 1)) as title, coalesce(url, 'https://duckduckgo.com') as url, coalesce(snippet, '暂无摘要') as snippet
    from (select *, row_number() over (partition by request_id order by o) - 1 pos from ({TOOL_ROWS}))""", "tool_items")  # fmt: skip
def p18_parse_tool_items(spark, sf_dir):
    return research.parse_tool_items(table(spark, sf_dir, "tool_items"))


@query("""select request_id, keyword_pos, pos, case when coalesce(trim(s.content), '') = '' and coalesce(s.url, '') <> '' then coalesce(f.content, s.content) else s.content end as content from snippets s left join (select url, min(content) content from full_pages group by 1) f using (url)""", "snippets", "full_pages")
def k5_enrich_content(spark, sf_dir):
    return research.enrich_content(table(spark, sf_dir, "snippets"), table(spark, sf_dir, "full_pages")).select("request_id", "keyword_pos", "pos", "content")


ASKED = "select request_id * 3 + keyword_pos as request_id, pos, title from snippets"  # a search a keyword
LOST = f"select distinct request_id, 'query ' || request_id as query from ({ASKED})"


@query(f"""select request_id, pos, title, case request_id % 5 when 0 then 'first' else 'second' end as engine, 'u' || pos as url, 's' as snippet from ({ASKED}) where request_id % 5 < 2
    union all select request_id, 0, '网络连接问题', 'duckduckgo', 'https://duckduckgo.com', '无法连接到外部搜索服务。关于"' || query || '"的搜索暂时不可用，请检查网络连接或稍后重试。' from ({LOST}) where request_id % 5 = 3
    union all select request_id, 0, '搜索服务暂时不可用', 'duckduckgo', '', '无法完成对"' || query || '"的搜索，请稍后重试。' from ({LOST}) where request_id % 5 = 4""", "snippets")  # fmt: skip
def r10_fallback_union(spark, sf_dir):
    df = table(spark, sf_dir, "snippets").select((F.col("request_id") * 3 + F.col("keyword_pos")).alias("request_id"), "pos", "title", F.concat(F.lit("u"), F.col("pos").cast("string")).alias("url"), F.lit("s").alias("snippet"))
    queries = df.select("request_id").distinct().select("request_id", F.concat(F.lit("query "), F.col("request_id").cast("string")).alias("query"), (F.col("request_id") % 5 != 2).alias("failed"), (F.col("request_id") % 5 == 4).alias("broken"))
    first, second = df.where("request_id % 5 = 0").withColumn("engine", F.lit("first")), df.where("request_id % 5 < 2").withColumn("engine", F.lit("second"))
    return research.fallback_union(first, second, queries)


@query("select request_id, keyword_pos, pos from (select *, row_number() over (partition by request_id, keyword_pos order by pos) n from snippets) where n <= 3", "snippets")
def r11_top_snippets(spark, sf_dir):
    return research.top_snippets(table(spark, sf_dir, "snippets"), 3).select("request_id", "keyword_pos", "pos")


@query("""select request_id, keyword_pos, string_agg('【' || n || '】' || coalesce(title, '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(snippet, ''), chr(10) || chr(10) order by n) as text
    from (select *, row_number() over (partition by request_id, keyword_pos order by pos) n from snippets) group by 1, 2""", "snippets")  # fmt: skip
def a7_snippet_text(spark, sf_dir):
    return research.snippet_text(table(spark, sf_dir, "snippets"))


@query("""select request_id, coalesce(string_agg(said, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) filter (said <> ''), '') as text, coalesce(sum(length(said)), 0)::bigint as chars, sum(n_snippets)::bigint as snippets
    from (select *, TRIMMED said from (select *, coalesce(nullif(analysis, ''), error) raw from analyses)) group by 1""".replace("TRIMMED", TRIM("raw")), "analyses")  # fmt: skip
def a8_combine(spark, sf_dir):
    return research.combine(table(spark, sf_dir, "analyses"))


@query(f"select request_id, case when {OK} then '- k' || request_id || case when request_id % 2 = 0 then ' (low)' else ' (medium)' end || case when request_id % 3 = 0 then chr(10) || '- z' || request_id || ' (Niche)' else '' end else '- ' || query || ' (high)' end as text from outputs", "outputs")
def a9_keyword_lines(spark, sf_dir):
    return research.keyword_lines(research.parse_keywords(table(spark, sf_dir, "outputs").withColumnRenamed("query", "input")))


@query("select batch_id, count(*) filter (status = 'uploading') as uploading, count(*) filter (status = 'ready') as ready, count(*) filter (status = 'error') as error from uploads group by 1", "uploads")
def a11_upload_stats(spark, sf_dir):
    return research.upload_stats(table(spark, sf_dir, "uploads"))


# Manifests


@query("select filename, size from scan where filename not in (select filename from manifest)", "scan", "manifest")
def k6_new_items(spark, sf_dir):
    return manifest.new_items(table(spark, sf_dir, "scan"), table(spark, sf_dir, "manifest"))


@query("select filename, key from manifest where filename in (select filename from scan)", "scan", "manifest")
def k7_still_present(spark, sf_dir):
    return manifest.still_present(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "scan")).select("filename", "key")


@query("""select filename, size, 'kept' as origin from manifest where filename in (select filename from scan) union all select filename, size, 'new' from scan where filename not in (select filename from manifest)""", "scan", "manifest")
def u3_merge(spark, sf_dir):
    scan, done = table(spark, sf_dir, "scan"), table(spark, sf_dir, "manifest").select("filename", "size")
    return manifest.merge(manifest.still_present(done, scan), manifest.new_items(scan, done))


@query("select cast(floor((row_number() over (order by key) - 1) / 10) as int) as batch, key from manifest where key like 'fonts/2025-1%'", "manifest")
def u5_purge_plan(spark, sf_dir):
    return manifest.purge_plan(table(spark, sf_dir, "manifest"), "fonts/2025-1", 10)


@query(f"""select total, size, {NUM("floor(size / pow(1024, k) * 100 + 0.5) / 100")} || ' ' || ['Bytes', 'KB', 'MB'][k + 1] as size_text from (select *, cast(floor(ln(size) / ln(1024)) as int) k from (select count(*) total, sum(size)::bigint size from manifest))""", "manifest")
def a13_summary(spark, sf_dir):
    return manifest.summary(table(spark, sf_dir, "manifest"))


# Progress streams, folded as batches; tests hold the streams against them.

FIELDS = "type phase status message details content draftMarkdown".split()
READ = ", ".join(f"json_extract_string(j, '$.{x}') as {x}" for x in FIELDS)
EVENTS = f"select session_id, seq, ts, {READ} from (select *, case when json_valid(substr(line, 7)) then substr(line, 7)::json end j from frames where line like 'data: %') where j is not null"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.decode(table(spark, sf_dir, "frames"))


@query(f"select session_id, seq, {", ".join(FIELDS)} from ({EVENTS})", "frames")
def x1_decode(spark, sf_dir):
    return _events(spark, sf_dir).select("session_id", "seq", *FIELDS)


@query(f"select session_id, phase, arg_max(status, seq) as status, arg_max(message, seq) as message, max_by(coalesce(details, chr(0)), seq) as details, min(seq) as place from ({EVENTS}) where phase is not null group by 1, 2", "frames")
def x2_latest_by_phase(spark, sf_dir):
    return progress.latest_by_phase(_events(spark, sf_dir)).withColumn("details", F.coalesce("details", F.lit("\0")))


@query(f"select session_id, phase, arg_max(status, seq) as status, max(seq) as place from ({EVENTS}) where phase is not null group by 1, 2", "frames")
def x3_latest_moved_to_end(spark, sf_dir):
    return progress.latest_by_phase(_events(spark, sf_dir), "last").select("session_id", "phase", "status", "place")


@query(f"""select session_id, coalesce(arg_max(draftMarkdown, seq) filter (type = 'draft-complete'), string_agg(content, '' order by seq) filter (type = 'draft-chunk'), '') as text, not bool_or(type = 'draft-complete') as streaming, bool_or(type = 'draft-complete') as complete
    from ({EVENTS}) where type like 'draft-%' group by 1""", "frames")  # fmt: skip
def x4_assemble_draft(spark, sf_dir):
    return progress.assemble_draft(_events(spark, sf_dir))


@query(f"""select session_id, coalesce(arg_max(case type when 'draft-start' then 'draft-streaming' else 'draft-confirm' end, seq) filter (type in ('draft-start', 'draft-complete')), 'progress') as phase from ({EVENTS}) group by 1""", "frames")
def x5_session_phase(spark, sf_dir):
    return progress.session_phase(_events(spark, sf_dir))


NTH = lambda column, k: f"try_cast(regexp_extract({column}, '([0-9]+)/([0-9]+)', {k}) as bigint)"
SAID = "coalesce(details, message)"


@query(f"""select session_id, coalesce(max({NTH(SAID, 1)}) filter (phase = 'search'), 0) as searched, coalesce(max({NTH(SAID, 1)}) filter (phase in ('analysis', 'document-analysis')), 0) as analysed,
    coalesce(greatest(max({NTH(SAID, 2)}) filter (phase in ('search', 'analysis', 'document-analysis')), max(try_cast(regexp_extract(message, '([0-9]+) 个', 1) as bigint)) filter (phase = 'keyword')), 0) as total from ({EVENTS}) group by 1""", "frames")  # fmt: skip
def x6_counters(spark, sf_dir):
    return progress.counters(_events(spark, sf_dir))


@query(f"select session_id, round(count(*) filter (status = 'completed') * 100.0 / count(*), 6)::double as ratio from (select session_id, phase, arg_max(status, seq) status from ({EVENTS}) where phase is not null group by 1, 2) group by 1", "frames")
def a14_ratio(spark, sf_dir):
    return progress.ratio(progress.latest_by_phase(_events(spark, sf_dir))).select("session_id", F.round("ratio", 6).cast("double").alias("ratio"))


def _streamed(spark: SparkSession, sf_dir: str, fold, keys: list[str]) -> DataFrame:
    """The frames written as files, read as a stream in several batches, folded, and merged into a table of the current state."""
    root = files.scratch(spark, "frames")
    half = max(2, spark.sparkContext.defaultParallelism)  # files of a batch, so that all cores have work
    table(spark, sf_dir, "frames").select("session_id", "seq", "ts", "line").repartition(2 * half).write.parquet(f"{root}/in")
    own = spark.newSession()  # so that the state store is named for this stream only
    own.conf.set(*progress.STATE_STORE)
    out = fold(progress.decode(own.readStream.schema(progress.FRAMES).option("maxFilesPerTrigger", half).parquet(f"{root}/in")))
    state = CurrentState(f"{root}/current", keys)
    out.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(state.merge).start().awaitTermination()
    return state.read(spark, out.schema)


@query(ORACLES["x2_latest_by_phase"])
def x2_current_state(spark, sf_dir):
    """The latest log of each phase as a table that a stream keeps."""
    return _streamed(spark, sf_dir, progress.latest_by_phase, ["session_id", "phase"]).withColumn("details", F.coalesce("details", F.lit("\0")))


@query(ORACLES["x4_assemble_draft"])
def x4_current_drafts(spark, sf_dir):
    """Drafts assembled by a stream with state, kept as a table."""
    return _streamed(spark, sf_dir, lambda e: progress.assemble_draft_stream(e, "3650 days"), ["session_id"])


@query(ORACLES["x5_session_phase"])
def x5_current_phase(spark, sf_dir):
    """The state of each session as a table that a stream keeps."""
    return _streamed(spark, sf_dir, progress.session_phase, ["session_id"])


@query(f"select session_id, seq, type from ({EVENTS})", "frames")
def s6_read_frames(spark, sf_dir):
    """Frames written as files, read as a stream until none is left, and decoded."""
    root = files.scratch(spark, "frames")
    table(spark, sf_dir, "frames").select("session_id", "seq", "ts", "line").write.parquet(f"{root}/in")
    events = progress.decode(progress.read_frames(spark, f"{root}/in")).select("session_id", "seq", "type")
    run = events.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    run.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out")

