"""What every operator does with odd columns, ids and tables."""


import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, html_text, katz, linededup, sentencepiece_codec, simhash, suffix_dedup, toxicity, url_filter

RUN = "a passage of some words that stands in several of these documents and is long enough to be found by all of the operators"
ITEM = "the quick brown fox jumps over the lazy dog and runs away from the hunters"
ROWS = [
    ("1", f"{RUN}\nown words of the first", "en", 1, "p", "v", 7), ("2", f"{RUN}\nother words", None, 2, None, "v", 8), ("x", f"{RUN}\nno number as id", "en", 3, "p", None, 9), (None, f"{RUN}\nno id at all {ITEM}", "de", 4, "p", "v", 0),
    ("9007199254740993123", ITEM, "en", 5, "p", "v", 0), ("3", None, "en", 6, "p", "v", 0), ("4", "", "en", 7, "p", "v", 0), ("1", "the same id again", "en", 8, "p", "v", 0), ("2", f"{RUN}\nother words", "en", 9, "p", "v", 0),
]
ODD = ["doc_id", "text", "lang", "a.b", "__id", "c0", "n_lines"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string, lang string, k long, p string, v string, n long").toDF(*ODD)


def texts(df):
    return {r["a.b"]: r["text"] for r in df.collect()}


def test_line_dedup(odd):
    out = linededup.dedup(odd)
    assert out.columns == ODD
    got = texts(out)
    assert got == {r[3]: r[1] for r in ROWS} | {2: "other words", 3: "no number as id", 9: "other words"}
    counted = linededup.dedup(odd, counts=True)
    assert counted.columns == [*(c for c in ODD if c != "n_lines"), "n_lines", "n_removed", "n_spans"]
    assert {r["a.b"]: r.n_removed for r in counted.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 1}
    assert linededup.dedup(odd.limit(0)).count() == 0


def test_near_duplicates(odd):
    out = simhash.keep_one(odd)
    assert out.columns == ODD
    assert sorted(texts(out)) == [1, 2, 3, 4, 5, 6, 8, 9]  # the null text is kept, the empty one is alike and goes; ids stand for all their rows
    assert simhash.keep_one(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ROWS)


def test_decontamination(odd, spark):
    items = spark.createDataFrame([("5", ITEM, 1), ("y", RUN, 2), (None, RUN, 3), ("6", None, 4), ("7", "own words", 5), ("8", "ord", 6), ("9", " ", 7)], "item_id string, text string, x int").toDF("item_id", "text", "a.b")
    out = decontaminate.decontaminate(odd, items)
    assert out.columns == ODD
    assert sorted(texts(out)) == [6, 7, 8]  # short items as whole words; each row by its own text, whatever its id
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(odd, items).collect()}
    assert found == {("1", "7", 0), (None, "5", 0), ("9007199254740993123", "5", 0), ("1", "y", 0), ("2", "y", 0), ("x", "y", 0), (None, "y", 0)}
    assert decontaminate.decontaminate(odd.limit(0), items).count() == 0 and decontaminate.decontaminate(odd, items.limit(0)).count() == len(ROWS)


def test_toxicity(odd, spark):
    labels = spark.createDataFrame([("1", 1), ("2", 0), ("x", 1), (None, 1), ("4", None)], "doc_id string, toxic int")
    model = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, model, "c0")
    assert scored.columns == [*(c for c in ODD if c != "c0"), "c0"] and all(0 <= r.c0 <= 1 for r in scored.collect())
    out = toxicity.reject(odd, model)
    assert out.columns == ODD and toxicity.reject(odd.limit(0), model).count() == 0


def test_toxicity_sample_is_bounded_in_bytes(spark):
    df = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'fine'} " * 200, "en", k % 2) for k in range(60)], "doc_id long, text string, lang string, toxic int")
    small = toxicity.fit(df, df, total_bytes=8000)
    assert small.embedding.shape == toxicity.fit(df, df).embedding.shape
    assert toxicity.score(df.limit(4), small).count() == 4


def test_sentencepiece(odd, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for chunk in (8, 1 << 15):
        out = sentencepiece_codec.encode(odd.withColumn("ids", F.lit("old")), chunk=chunk, verify=True)
        assert out.columns == [*ODD, "ids", "exact"]
        assert texts(sentencepiece_codec.decode(out, out_col="text")) == {r[3]: r[1] for r in ROWS}
        assert {r.exact for r in out.collect()} == {True, None}
    assert sentencepiece_codec.encode(odd.limit(0)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_katz_and_suffix_dedup(odd):
    scored = katz.score(odd, F.col("doc_id") == "1").collect()
    assert sorted(r.doc_id or "" for r in scored) == ["", "1", "1", "2", "2", "3", "4", "9007199254740993123", "x"]
    kept = {r.doc_id: r.n_removed for r in suffix_dedup.dedup(odd).where("doc_id is not null").collect()}
    assert kept["2"] >= 100 and kept["x"] >= 100 and kept["1"] == kept["3"] == kept["4"] == 0
    assert suffix_dedup.dedup(odd).count() == len(ROWS) and suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_html_and_urls(odd, spark):
    pages = odd.withColumnsRenamed({"text": "html", "doc_id": "page_id", "lang": "url"})
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "a.b", "__id", "c0", "n_lines", "text", "n_chars"] and out.count() == len(ROWS)
    assert html_text.extract(pages.limit(0)).count() == 0
    judged = url_filter.judge(pages.withColumnRenamed("n_lines", "rule"), spark.createDataFrame([("1", 1), ("x", 0), (None, 1)], "page_id string, good int"))
    assert judged.columns == ["page_id", "html", "url", "a.b", "__id", "c0", *url_filter.ADDED] and judged.count() == len(ROWS)
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0


KINDS = {"string": lambda k: f"id {k:03d}", "double": lambda k: k + 0.2 if k % 2 else k - 0.3, "long": lambda k: (1 << 62) + k}


@pytest.mark.parametrize("kind", KINDS)
def test_ids_of_any_type(spark, kind):
    """Ids of every type give what the same rows give when they are numbered."""
    name = KINDS[kind]
    said = [f"{RUN}\nown words {k % 4}" if k % 3 else ITEM if k % 2 else f"words of row {k}" for k in range(12)]
    plain = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(said)], "doc_id long, text string, toxic int")
    other = spark.createDataFrame([(name(k), t, k % 2) for k, t in enumerate(said)], f"doc_id {kind}, text string, toxic int")
    items = [spark.createDataFrame([(i(7), ITEM)], f"item_id {t}, text string") for i, t in ((lambda k: k, "long"), (name, kind))]
    back = {name(k): k for k in range(12)} | {k: k for k in range(12)} | {None: None}
    rows = lambda df, *ids: sorted(tuple(back[r[c]] if c in ids else r[c] for c in df.columns) for r in df.collect())
    index = lambda df: df.select("doc_id", "text")
    for make, ids in (
        (lambda df, i: linededup.dedup(index(df), counts=True), ["doc_id"]), (lambda df, i: simhash.near_duplicates(index(df)), ["id", "component_id"]), (lambda df, i: simhash.similar_groups(index(df)), ["id", "group_id"]),
        (lambda df, i: simhash.keep_one(index(df)), ["doc_id"]), (lambda df, i: suffix_dedup.dedup(index(df)), ["doc_id"]), (lambda df, i: decontaminate.matches(index(df), i), ["doc_id", "item_id"]),
        (lambda df, i: katz.score(df.select("doc_id", "text", F.col("text").contains("own").alias("t")), F.col("t")).drop("score", "base_score"), ["doc_id"]), (lambda df, i: toxicity.score(index(df), toxicity.fit(df, df)).drop("score"), ["doc_id"]),
        (lambda df, i: url_filter.judge(df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.length("text"), F.lit(".org/")).alias("url")), df.select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("good"))).select("page_id", "verdict", "n_labelled"), ["page_id"]),
    ):
        assert rows(make(other, items[1]), *ids) == rows(make(plain, items[0]), *ids), ids


def test_very_long_texts(spark):
    words = " ".join(f"w{k % 50_000}" for k in range(300_000))
    df = spark.createDataFrame([(1, words), (2, words + f" {ITEM}"), (3, "a" * 1_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.matches(df, items).collect()] == [2]
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {1, 3}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup(df).collect()}[2] > 1_000_000
    assert all(r.exact for r in sentencepiece_codec.encode(df, verify=True).collect())
    assert linededup.dedup(df).count() == 3
