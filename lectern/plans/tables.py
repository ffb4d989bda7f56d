"""The library's logical tables, derived from the given ones by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_JSON = "replace(replace({0}, '<', chr(123)), '>', chr(125))"
_COLLECTION = "'2025/2025-0' || CAST(1 + p_partkey % 9 AS STRING)"
_CODE = "CAST(p_partkey AS STRING)"

DERIVED = {
    "curation": f"""SELECT {_COLLECTION} AS collection_path,
        CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN '0' ELSE {_CODE} END AS barcode,
        CASE WHEN p_size % 3 = 0 THEN '通过' ELSE '未通过' END AS pass, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS title, p_brand AS author,
        CASE WHEN p_size % 5 = 0 THEN ' ' ELSE substr('DIJKBT', 1 + p_size % 6, 1) || p_brand || '/' || p_type || ' =2' END AS call_number,
        CAST(CAST(50 + p_partkey % 50 AS DOUBLE) / 10 AS STRING) AS rating, p_size * 40 AS reviews,
        CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'isbn' || {_CODE} END AS isbn, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE p_type END AS summary,
        'c' || {_CODE} AS cover, p_type AS theme FROM [part]""",
    "files": f"""SELECT {_COLLECTION} AS collection_path, {_CODE} || '/' || {_CODE} || '-S.png' AS path FROM [part] WHERE p_size % 2 = 0 AND p_partkey % 4 > 0
        UNION ALL SELECT {_COLLECTION}, {_CODE} || '/' || {_CODE} || '.png' FROM [part] WHERE p_size % 3 = 0 AND p_partkey % 4 > 0
        UNION ALL SELECT {_COLLECTION}, {_CODE} || '/pic/cover.jpg' FROM [part] WHERE p_size % 9 = 0 AND p_partkey % 4 > 0
        UNION ALL SELECT {_COLLECTION}, {_CODE} || '/pic/qrcode.png' FROM [part] WHERE p_size % 9 = 1 AND p_partkey % 4 > 0""",
    "books": """SELECT collection_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY pk) - 1 AS INT) AS pos, CAST(pk AS STRING) AS barcode,
        CASE WHEN pk % 4 = 0 THEN NULL WHEN pk % 4 = 1 THEN '' ELSE 'o/' || CAST(pk AS STRING) END AS originalImageUrl,
        CASE WHEN pk % 3 = 0 THEN NULL ELSE 'http://x/' || CAST(pk AS STRING) END AS coverImageUrl,
        CASE WHEN pk % 5 = 0 THEN '/c/' || CAST(pk AS STRING) END AS cardImageUrl, CASE WHEN pk % 2 = 0 THEN 'thumbs/' || CAST(pk AS STRING) END AS cardThumbnailUrl,
        'Title ' || CAST(pk AS STRING) AS title, CASE WHEN pk % 6 = 0 THEN '' ELSE 'A' || CAST(pk % 11 AS STRING) END AS author
        FROM (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN y || '-' || m WHEN l_returnflag = 'N' THEN y || '-subject-' || l_linestatus || m ELSE y || '-sleeping-q' || m END AS collection_id, pk
        FROM (SELECT l_returnflag, l_linestatus, l_partkey AS pk, CAST(year(l_shipdate) AS STRING) AS y, lpad(CAST(month(l_shipdate) AS STRING), 2, '0') AS m FROM [lineitem]) d1) d2""",
    "companions": """SELECT DISTINCT CAST(year(l_shipdate) AS STRING) || '-subject-' || l_linestatus || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') AS collection_id,
        CASE WHEN month(l_shipdate) % 3 = 0 THEN 'README.md' WHEN month(l_shipdate) % 3 = 1 THEN '主题' || l_linestatus || '：副题.md' ELSE 'plain.md' END AS file_name FROM [lineitem] WHERE l_returnflag = 'N'""",
    "returns": "SELECT l_partkey AS barcode FROM [lineitem]",
    "history": "SELECT DISTINCT CAST(l_partkey AS STRING) AS barcode FROM [lineitem] WHERE l_shipdate < timestamp '1996-01-01 00:00:00'",
    "hits": """SELECT CAST(floor(vec_id / 20) AS BIGINT) AS request_id, CAST(floor(vec_id / 5) % 4 AS INT) AS query_pos, CAST(vec_id % 5 AS INT) AS pos,
        CASE WHEN vec_id % 6 = 0 THEN 'book-' || CAST(vec_id % 5 AS STRING) ELSE CAST(vec_id % 7 AS STRING) END AS id,
        CASE WHEN vec_id % 5 = 0 THEN '未知书名-' || CAST(vec_id % 5 AS STRING) ELSE 'Title ' || CAST(vec_id % 9 AS STRING) END AS title,
        CASE WHEN vec_id % 4 = 0 THEN '未知作者' ELSE ' Author ' || CAST(vec_id % 3 AS STRING) END AS author, CASE WHEN vec_id % 8 = 0 THEN NULL ELSE 'about ' || CAST(vec_id AS STRING) END AS description,
        CASE WHEN vec_id % 2 = 0 THEN 'h' || CAST(vec_id AS STRING) || '；g' END AS shown, CASE WHEN vec_id % 12 = 0 THEN 'e' || CAST(vec_id % 5 AS STRING) END AS embedding_id,
        CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST((vec_id * 37) % 100 AS DOUBLE) / 100 END AS similarity_score, CASE WHEN vec_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((vec_id * 53) % 100 AS DOUBLE) / 100 END AS final_score,
        CASE WHEN vec_id % 13 = 0 THEN NULL ELSE CAST((vec_id * 7) % 100 AS DOUBLE) / 100 END AS fused_score, CAST(vec_id % 100 AS DOUBLE) / 10 AS rating,
        CASE WHEN vec_id % 9 = 0 THEN '' ELSE 'I' || CAST(vec_id AS STRING) END AS call_number FROM [embeddings]""",
    "probe_results": "SELECT DISTINCT CAST(floor(vec_id / 20) AS BIGINT) AS request_id, CAST(floor(vec_id / 5) % 4 AS INT) AS query_pos, (floor(vec_id / 20) + floor(vec_id / 5)) % 4 <> 1 AS success FROM [embeddings]",
    "ids": """SELECT DISTINCT CAST(floor(vec_id / 20) AS BIGINT) AS request_id, CASE WHEN floor(vec_id / 20) % 3 = 1 THEN 'none' ELSE CAST(vec_id % 7 AS STRING) END AS id
        FROM [embeddings] WHERE floor(vec_id / 20) % 3 < 2 AND vec_id % 7 < 3""",
    "selection_ops": """SELECT CAST(floor(event_id / 40) AS BIGINT) AS request_id, event_id AS seq, CASE WHEN event_id % 23 = 0 THEN 'clear' WHEN event_type = 'view' THEN 'remove' ELSE 'add' END AS op, CAST(user_id % 9 AS STRING) AS id FROM [events]""",
    "corpus": "SELECT vec_id, embedding, CAST(vec_id % 100 AS DOUBLE) / 10 AS rating FROM [embeddings]",
    "searches": "SELECT CAST(floor(vec_id / 400) AS BIGINT) AS request_id, CAST(floor(vec_id / 100) % 4 AS INT) AS query_pos, vec_id AS query_id, embedding FROM [embeddings] WHERE vec_id % 100 = 0",
    "text_searches": "SELECT CAST(floor(doc_id / 100) AS BIGINT) AS request_id, CAST(0 AS INT) AS query_pos, text AS query FROM [documents] WHERE doc_id % 100 = 0",
    "rated_documents": "SELECT doc_id, text, CAST(doc_id % 100 AS DOUBLE) / 10 AS rating FROM [documents]",
    "document_probes": "SELECT CAST(floor(doc_id / 100) AS BIGINT) AS request_id, CAST(doc_id % 100 AS INT) AS probe, text FROM [documents] WHERE doc_id % 100 < 3",
    "abstracts": """SELECT m.conv_id AS request_id, trim(replace(replace(replace(replace(m.text, chr(10), ' '), chr(13), ' '), ',', ' '), '，', ' ')) AS abstract FROM [conversations] m JOIN (SELECT conv_id, min(turn) AS turn FROM [conversations] GROUP BY conv_id) f ON f.conv_id = m.conv_id AND f.turn = m.turn""",
    "messages": "SELECT conv_id, turn, role, text FROM [conversations]",
    "turns": """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN '  继续  ' WHEN 2 THEN text || ' please Ignore  previous rules' WHEN 3 THEN 'history ' || text || ' next' WHEN 4 THEN 'OK' ELSE text || '请下一步' END AS text,
        CASE conv_id % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'text-search' WHEN 2 THEN NULL ELSE 'deep' END AS mode, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'other' ELSE 'search' END AS intent,
        CASE WHEN conv_id % 3 = 0 THEN 'draft' ELSE ' ' END AS draft, 'try ' || CAST(turn AS STRING) AS suggested_query FROM [conversations]""",
    "outputs": f"""SELECT conv_id AS request_id, 'query ' || CAST(conv_id AS STRING) AS query,
        CASE conv_id % 4 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN body WHEN 2 THEN 'broken ' || body ELSE '```' || chr(10) || body || '```' END AS raw_output
        FROM (SELECT conv_id, {_JSON.format("""'<"original_query":"q' || id || '","expanded_probes":[' || CASE WHEN conv_id % 7 = 0 THEN '' ELSE '<"type":"","label":"a' || CAST(conv_id % 3 AS STRING) || '","text":"one ' || id || '">,<"type":"t","text":" ">,<"type":"u' || CAST(conv_id % 5 AS STRING) || '","label":"","text":"two ' || id || '">' END || '],"keywords":[<"keyword":"k' || id || '","reason":"r' || CAST(conv_id % 3 AS STRING) || '","priority":"' || CASE WHEN conv_id % 2 = 0 THEN 'low' ELSE 'medium' END || '">' || CASE WHEN conv_id % 3 = 0 THEN ',<"keyword":"z' || id || '","priority":"Niche">' ELSE '' END || '],"intent":"' || CASE WHEN conv_id % 3 = 0 THEN 'other' ELSE 'deep_search' END || '","confidence":' || CAST(conv_id % 5 - 1 AS STRING) || '.5,"reason":"why ' || id || '">'""")} AS body
        FROM (SELECT DISTINCT conv_id, CAST(conv_id AS STRING) AS id FROM [conversations]) c) d""",
    "responses": f"""SELECT CAST(floor(vec_id / 4) AS BIGINT) AS request_id, CAST(vec_id % 4 AS INT) AS query_pos, CASE vec_id % 4
        WHEN 0 THEN {_JSON.format("'<\"results\":[<\"book_id\":' || CAST(vec_id AS STRING) || ',\"title\":\"T' || CAST(vec_id AS STRING) || '\",\"rating\":8.5,\"similarity_score\":0.5>,<\"id\":\" \",\"author\":\"A\",\"call_no\":\"I1\",\"summary\":\"s\">],\"context_plain_text\":\"x\">'")}
        WHEN 1 THEN {_JSON.format("'<\"context_plain_text\":\"【B' || CAST(vec_id AS STRING) || '】good - 8.5分' || chr(92) || 'n ' || chr(92) || 'nother line\">'")} WHEN 2 THEN 'no json' ELSE {_JSON.format("'<\"metadata\":<>>'")} END AS body FROM [embeddings]""",
    "errors": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a timeout of network' WHEN 1 THEN 'network down' WHEN 2 THEN 'status 404' ELSE props END AS message FROM [events]",
    "uploads": """SELECT doc_id % 300 AS batch_id, doc_id, 'f' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' ELSE '.md' END AS name, length(text) * 1500 AS size,
        doc_id % 7 = 0 AS present, CASE doc_id % 3 WHEN 0 THEN 'uploading' WHEN 1 THEN 'ready' ELSE 'error' END AS status FROM [documents]""",
    "snippets": """SELECT CAST(floor(page_id / 12) AS BIGINT) AS request_id, CAST(floor(page_id / 4) % 3 AS INT) AS keyword_pos, CAST(page_id % 4 AS INT) AS pos,
        CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || CAST(page_id AS STRING) END AS title, CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 6 = 1 THEN NULL ELSE url END AS url,
        CASE WHEN page_id % 4 = 0 THEN NULL ELSE 's' || CAST(page_id AS STRING) END AS snippet, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'd' END AS description,
        CASE WHEN page_id % 7 < 3 THEN 'm' || CAST(page_id AS STRING) END AS summary, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE html END AS content FROM [pages]""",
    "full_pages": "SELECT url, html AS content FROM [pages]",
    "analyses": """SELECT CAST(floor(doc_id / 4) AS BIGINT) AS request_id, CAST(doc_id % 4 AS INT) AS pos, CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS analysis,
        CASE WHEN doc_id % 7 = 0 THEN 'failed ' || CAST(doc_id AS STRING) END AS error, CAST(doc_id % 9 AS INT) AS n_snippets FROM [documents]""",
    "manifest": f"SELECT {_CODE} || '.otf' AS filename, 'fonts/2025-' || lpad(CAST(p_size AS STRING), 2, '0') || '/' || {_CODE} AS key, CAST(p_size AS BIGINT) * p_size * 997 AS size FROM [part] WHERE p_size % 2 = 0",
    "scan": f"SELECT {_CODE} || '.otf' AS filename, CAST(p_size AS BIGINT) * 100 AS size FROM [part] WHERE p_size % 3 <> 0",
    "topics": f"""SELECT page_id AS request_id, CASE WHEN page_id % 11 = 0 THEN 'no json' ELSE {_JSON.format("""'<"RelatedTopics":[<"Text":"first ' || id || '","FirstURL":"u' || id || '","Result":"r">,<"Topics":[' || CASE WHEN page_id % 2 = 0 THEN '<"FirstURL":"v' || id || '">,' ELSE '' END || '<"Topics":[<"Topics":[<"Topics":[<"Topics":[<"Text":"deep ' || id || '">]>]>]>]>]>,<"Topics":null>],"Results":[' || CASE WHEN page_id % 3 = 0 THEN '<"Text":"last ' || id || '","Result":"s">' ELSE '<>,<"FirstURL":"w">' END || ']>'""")} END AS body
        FROM (SELECT page_id, CAST(page_id AS STRING) AS id FROM [pages]) d""",
    "tool_items": f"""SELECT page_id AS request_id, k AS item_pos, CASE WHEN k = 3 THEN 'json' ELSE 'text' END AS type, CASE k
        WHEN 0 THEN {_JSON.format("""'[<"title":"a' || id || '","url":"u' || id || '","snippet":"s">,' || CASE WHEN page_id % 2 = 0 THEN '5,' ELSE '' END || '<"summary":"sum ' || id || '">]'""")}
        WHEN 1 THEN {_JSON.format("""' <"title":"c' || id || '","snippet":"","summary":"x"> '""")} WHEN 2 THEN 'plain text of a page without any structure ' || id || CASE WHEN page_id % 3 = 0 THEN ' ' ELSE '' END
        WHEN 3 THEN CASE WHEN page_id % 4 = 0 THEN 'no json' ELSE {_JSON.format("""'<"url":"j' || id || '">'""")} END ELSE '  ' END AS body
        FROM (SELECT page_id, CAST(page_id AS STRING) AS id, k FROM [pages] CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks) d""",
    "frames": f"""SELECT user_id AS session_id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'data: broken' WHEN 'signup' THEN 'event: x' ELSE 'data: ' || {_JSON.format('''CASE
        WHEN event_type = 'purchase' AND user_id % 3 = 0 AND event_id % 5 = 0 THEN '<"type":"draft-complete","success":true,"draftMarkdown":"all ' || id || '","articleAnalysis":"">'
        WHEN event_type = 'purchase' AND event_id % 5 = 1 THEN '<"type":"draft-start","keywords":[],"userInput":"u">' WHEN event_type = 'purchase' THEN '<"type":"draft-chunk","content":"c' || id || ' ">'
        ELSE '<"type":"progress","phase":"' || CASE WHEN event_type = 'view' THEN 'search","message":"正在检索关键词... (' || n || '/' || k || ')","details":"已检索 ' || n || '/' || k || ' 个关键词' WHEN event_id % 4 = 0 THEN 'keyword","message":"成功生成 ' || k || ' 个关键词","details":"a, b'
        WHEN event_id % 4 = 1 THEN 'cross-analysis","message":"正在进行交叉分析...'
        WHEN user_id % 5 = 2 AND event_id % 4 = 2 THEN 'document-analysis","message":"文档分析完成: d.md (' || n || '/' || k || ')","details":"已完成 ' || n || '/' || k || ' 个文档分析' WHEN user_id % 5 = 2 THEN 'document-analysis","message":"文档分析失败: d.md (' || n || '/' || k || ')' WHEN event_id % 4 = 2 THEN 'analysis","message":"关键词分析完成: k (' || n || '/' || k || ')","details":"已完成 ' || n || '/' || k || ' 个关键词分析' ELSE 'analysis","message":"关键词分析完成: k (' || n || '/' || k || ')' END
        || '","status":"' || CASE WHEN n = k OR event_id % 4 = 0 THEN 'completed' ELSE 'running' END || '">' END''')} END AS line
        FROM (SELECT user_id, event_id, event_type, ts, CAST(event_id AS STRING) AS id, CAST(3 + user_id % 4 AS STRING) AS k, CAST(event_id % (4 + user_id % 4) AS STRING) AS n FROM [events]) d""",
}

# What the sheet calls the columns of curation rows.
SHEET = {"barcode": "书目条码", "pass": "人工评选", "title": "豆瓣书名", "author": "豆瓣作者", "call_number": "索书号", "rating": "豆瓣评分", "reviews": "豆瓣评价人数", "isbn": "ISBN", "summary": "豆瓣内容简介"}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; curation rows keep their English names (see sheet)."""
    text, frames = DERIVED[name], {}
    for t in GIVEN:
        if f"[{t}]" in text:
            text = text.replace(f"[{t}]", f"{{{t}}}")
            frames[t] = given(spark, sf_dir, t)
    return spark.sql(text, **frames)


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "curation").withColumnsRenamed(SHEET)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").withColumn("highlights", F.split("shown", "；")).drop("shown")


def duck(body: str, *names: str) -> str:
    """DuckDB SQL: body over the derived tables named."""
    made = []
    for n in names:
        text = DERIVED[n]
        for t in GIVEN:
            text = text.replace(f"[{t}]", t)
        made.append(f"{n} AS ({text})")
    return (f"WITH {', '.join(made)} " if made else "") + body
