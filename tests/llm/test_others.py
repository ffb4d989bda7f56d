"""URL filter, HTML extraction, images, toxicity, SentencePiece and the pipeline."""

import os
import random
import re
import time
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import html_text, images, queries, sentencepiece_codec, toxicity, url_filter

# URL filter


def test_url_filter_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = con.execute(url_filter.ORACLE_SQL).df().sort_values("page_id").reset_index(drop=True)
    got = queries.op2_url_filter(spark, sf_dir).toPandas().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)].astype(object).fillna("null"), want[sorted(want)].astype(object).fillna("null"), check_dtype=False, atol=1e-6)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://WWW.Example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://x.net/es/#f", "x.net", "/es/", "net/es/", "block"),
        ("http://x.net/esp", "x.net", "/esp", None, None),
        ("http://x.com", "x.com", "", None, None),
        ("http://x.com?a=/b", "x.com", "", None, None),
        ("no scheme.com/en/", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    r = df.select("h", "p", *url_filter.matched_rule(F.col("h"), F.col("p"))).first()
    assert tuple(r) == (host, path, rule, verdict)


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [(k, f"http://bad.d1.org/{k}") for k in range(40)] + [(100 + k, f"http://good.d2.org/{k}") for k in range(40)] + [(200, "http://new.d1.org/"), (201, "http://new.d2.org/"), (202, None), (203, "http://10.0.0.1:80/x"), (204, "http://a.b.co.uk/")]
    labels = [(k, 0) for k in range(40)] + [(100 + k, 1) for k in range(40)] + [(100, 1), (7, None)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), rules=()).collect()}
    assert len(out) == len(rows)
    assert out[0].verdict == "block" and out[100].verdict == "allow"
    assert out[200].posterior_mean < out[201].posterior_mean
    assert out[0].posterior_bound < out[0].posterior_mean
    none = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "page_id long, good int")).collect()
    assert len(none) == len(rows)


# HTML extraction


def test_articles_of_the_given_pages(spark, sf_dir):
    got = {r.page_id: r for r in queries.op4_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", "\n", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


FULL = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="home">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies and many words here to fool the scan</div>
<main><article><h1>A &amp; B</h1><p>First <b>bold</b>word, &lt;tag&gt; text.<p>Second para
with   spaces &#8212; and more words to read.<div class="ad">Buy now</div><aside>Side</aside><form><input value="x">Search</form><!-- hidden -->
<ul><li>one<li>two</ul><blockquote>Quote</blockquote></article><section class="comments"><p>Reader says a lot of words about this text</p></section></main>
<footer>Imprint and contact and terms and more words</footer></body></html>"""


def test_only_the_article_stays():
    want = "A & B First boldword, <tag> text. Second para with spaces — and more words to read. one two Quote"
    assert html_text.main_text(FULL, html_text.Weights()) == want
    assert html_text.main_text(FULL, html_text.learn([FULL])) == want


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("<p></p>", ""), ("<script>x", ""), ("just text", "just text"), ("<p>a<p>b</div></p>", "a b"), ("<div>x < y</div>", "x < y"), ("<p>a" + "</p><p>b" * 2000, "a" + " b" * 2000)])
def test_odd_pages(html, want):
    assert html_text.main_text(html, html_text.Weights()) == want


def test_region_is_the_best_contiguous_one():
    rng = random.Random(8)
    for _ in range(300):
        gains = [rng.choice([-2.5, -1.0, -0.5, 0.0, 0.7, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        best = max([0.0, *(sum(gains[a:b]) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1))])
        a, b = html_text.region(gains)
        assert sum(gains[a:b]) == pytest.approx(best)


BODY = " ".join(["word"] * 60)


@pytest.mark.parametrize("html, want", [
    (f'<body><nav>x y</nav><article class="post has-sidebar"><h1>T</h1><p>{BODY}</p></article><div class="ad">buy now</div></body>', f"T {BODY}"),
    (f'<main class="content no-sidebar"><p>{BODY}</p></main>', BODY),
    (f'<div class="layout with-nav"><nav>a b</nav><div><p>{BODY}</p></div></div>', BODY),
    (f'<div class="wrapper sidebar-right"><p>{BODY}</p></div>', BODY),
    (f'<article><p>{BODY}</p><div class="social-science"><p>soc {BODY}</p></div></article>', f"{BODY} soc {BODY}"),
    (f'<body><div class="sidebar">s s s</div><div><p>first {BODY}</p></div><div class="ad">{BODY}</div><div><p>second {BODY}</p></div><div class="comments"><p>{BODY} {BODY} {BODY} {BODY}</p></div></body>', f"first {BODY} second {BODY}"),
    (f'<div id="page"><header><h1>Site</h1></header><div class="entry"><h2>T</h2><p>{BODY}</p></div><div id="comments"><article class="comment">{BODY}</article></div><footer>c</footer></div>', f"T {BODY}"),
    (f'<p title="x>y">{BODY}</p><p class=it\'s>z</p>', f"{BODY} z"),
])
def test_names_veto_no_article(html, want):
    learnt = html_text.learn(["<nav>a b c</nav><div class='ad'>" + "x " * 50 + "</div><article><h1>t</h1><p>words of the text</p></article>"] * 3)
    for weights in (html_text.Weights(), learnt):
        assert html_text.main_text(html, weights) == want


def test_names_are_learnt():
    """A name that labelled pages show outside their content is furniture, one that they show inside is not."""
    page = "<div class='zed'>" + "noise " * 40 + "</div><article><div class='promo'>" + "text " * 40 + "</div></article>"
    weights = html_text.learn([page])
    assert html_text.main_text(f"<div><div class='zed'>{BODY}</div><div class='promo'>in {BODY}</div></div>", weights) == f"in {BODY}"


@pytest.mark.parametrize("html", [
    '<script a="b" ' * 80_000, '<a b="x ' * 100_000, '<a b="x> ' * 100_001, "<div>" * 100_000 + "x", "<div>" * 50_000 + "x " + "</section>" * 50_000 + "</div>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
    "<" * 300_000, "<!--" * 100_000, "<script>" * 100_000, "<script>" + "</script " * 100_000, '<div class="a b c">' * 50_000 + "y",
], ids=range(11))
def test_hostile_pages_take_linear_time(html):
    began = time.time()
    html_text.main_text(html, html_text.Weights())
    html_text.learn(["<article>x</article>" + html])
    assert time.time() - began < 20


def test_extract_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "old", 5), (2, None, None, 6)], "page_id long, html string, text string, extra int")
    out = {r.page_id: r for r in html_text.extract(df).collect()}
    assert (out[1].text, out[1].n_chars, out[1].extra) == ("x", 1, 5) and (out[2].text, out[2].n_chars) == ("", 0)
    assert html_text.extract(df.limit(0)).count() == 0
    odd = df.toDF("a.b", "html", "text", "__id")
    assert {r["a.b"]: r["text"] for r in html_text.extract(odd).collect()} == {1: "x", 2: ""}
    assert html_text.extract(odd).columns == ["a.b", "__id", "text", "n_chars"]


# Images


def test_copies_are_found_and_others_left_alone(spark):
    rows = []
    for k in range(60):
        base = images.picture(k)
        rows.append((10 * k, bytearray(images.to_pgm(base))))
        for kind in range(3):
            rows.append((10 * k + 1 + kind, bytearray(images.to_pgm(images.edited(base, kind)))))
    rows.append((5, rows[0][1]))  # byte-equal
    rows += [(901, None), (902, bytearray(b"")), (903, bytearray(b"P5 9 9 255\n" + b"x" * 81)), (904, bytearray(b"broken")), (905, bytearray(images.to_pgm(np.full((96, 96), 7.0))))]
    df = spark.createDataFrame(rows, "image_id long, media binary")
    out = {r.image_id: r for r in images.copies(df).collect()}
    assert len(out) == len(rows)
    want = {i: i // 10 * 10 if i < 900 else i for i in out}
    right = sum(out[i].class_id == want[i] for i in out if i < 900)
    assert right / sum(i < 900 for i in out) >= 0.9
    assert all(out[i].class_id == i for i in out if i >= 900)
    assert all(out[i].class_id in (want[i], i) for i in out)  # never with another picture
    assert out[5].n_links > 0
    assert images.copies(df.limit(0)).count() == 0


def test_turned_and_resized_copies_under_wide_ids(spark):
    """Quarter turns and half sizes; ids beyond 2**43 and columns of any name."""
    half = lambda a: a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).mean((1, 3))
    rows, least = [], 1 << 60
    for k in range(12):
        base = images.picture(k, 192)
        rows += [(least + 10 * k + q, bytearray(images.to_pgm(x)), "x", 5) for q, x in enumerate((base, np.rot90(base), half(base)))]
    df = spark.createDataFrame([*rows, (None, rows[0][1], "x", 5)], "image_id long, media binary, a string, b long").toDF("image_id", "media", "a.b", "number")
    out = {r.image_id: r for r in images.copies(df).collect()}
    assert len(out) == len(rows)
    right = sum(r.class_id == least + (i - least) // 10 * 10 for i, r in out.items())
    assert right >= 0.9 * len(rows) and all((r.class_id - least) // 10 == (i - least) // 10 for i, r in out.items())


def test_a_stamp_on_every_picture_hides_no_copy(spark):
    """Corners that all pictures share, far more often than NEAR."""
    rows = []
    for k in range(40):
        base = images.picture(k, 128)
        base[:40, :40] = images.picture(999, 40)
        rows += [(10 * k, bytearray(images.to_pgm(base))), (10 * k + 1, bytearray(images.to_pgm(base[:, :118])))]
    out = {r.image_id: r for r in images.copies(spark.createDataFrame(rows, "image_id long, media binary"), votes=12).collect()}
    assert sum(out[10 * k + 1].class_id == out[10 * k].class_id for k in range(40)) >= 36


def test_pictures_are_drawn_by_many_tasks(spark, monkeypatch):
    """However few files the vectors lie in."""
    monkeypatch.setattr(images, "DRAWN", 10)
    vectors = spark.range(0, 40, 1, 1).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    drawn = images.from_embeddings(vectors)
    assert drawn.rdd.getNumPartitions() == 4
    assert sorted(r.image_id for r in drawn.collect()) == sorted([2 * k for k in range(40)] + [2 * k + 1 for k in range(0, 40, 4)])


def test_every_pair_of_copies_is_a_link(spark):
    """More copies of a picture than a descriptor was once compared with, beside others."""
    base = images.picture(3)
    rows = [(k, bytearray(images.to_pgm(base * (0.7 + 0.01 * k) + k))) for k in range(24)]
    rows += [(100 + k, bytearray(images.to_pgm(images.picture(50 + k)))) for k in range(6)]
    out = {r.image_id: r for r in images.copies(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in out.items()} == {i: (0, 23) if i < 24 else (i, 0) for i in out}


def test_pictures_from_vectors(spark, sf_dir):
    df = images.from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(8))
    got = df.collect()
    assert len(got) == 10 and all(images.from_pgm(bytes(r.media)) is not None for r in got)


# Toxicity


def words_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return toxicity.word_buckets(raw, np.array([0, len(raw)]))


def test_toxicity_on_held_out_documents(spark, sf_dir):
    """Learns the given marks from other documents."""
    wide = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{wide}/labels.parquet").collect()}
    got = [r for r in queries.op8_toxicity(spark, wide).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    toxic = [r.score for r in got if labels[r.doc_id]]
    clean = [r.score for r in got if not labels[r.doc_id]]
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert auc > 0.85 and np.mean([s < 0.5 for s in clean]) > 0.99


def test_pooling_sees_the_whole_text_and_no_neighbour():
    rng = np.random.default_rng(9)
    rows = [(words_of(" ".join(rng.choice(["fine", "good", "day", "tree", "stone", "bird"], 30)) + (" vileword" if y else ""))[0], y) for y in (0, 1) for _ in range(120)]
    model = toxicity.train(rows)
    texts = ["fine day", "day " * 3000 + "vileword", "", "VILEWORD!", "fine"]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = toxicity.scores(model, *toxicity.word_buckets(data, offs))
    alone = [toxicity.scores(model, *words_of(t))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6)
    assert together[1] > 0.5 and together[3] > 0.5 and max(together[[0, 2, 4]]) < 0.5


def test_toxicity_follows_the_balance_of_all_labels(spark):
    """A sample of two equal halves scores as the whole, of which a tenth is toxic."""
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choices(["day", "tree", "stone", "bird", "lake", "hill"], k=20)), "en", int(k % 10 == 0)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), sample=800)
    got = [r.score for r in toxicity.score(df, model).collect()]
    assert 0.05 < np.mean(got) < 0.2


def test_thresholds_count_a_weighted_row_as_so_many():
    rng = np.random.default_rng(13)
    rows = [(words_of(" ".join(rng.choice(["fine", "good", "day", "vile", "bad"], 6, p=[0.3, 0.2, 0.2, 0.15, 0.15] if y else [0.3, 0.3, 0.2, 0.1, 0.1])))[0], y, "en") for y in (0, 1) for _ in range(150)]
    model = toxicity.train([r[:2] for r in rows])
    found = []
    for held, weights in ((rows, (7.0, 1.0)), ([r for r in rows for _ in range(1 if r[1] else 7)], (1.0, 1.0)), (rows, (1.0, 1.0))):
        toxicity.calibrate(model, held, weights)
        found.append(model.thresholds["en"])
    assert found[0] == pytest.approx(found[1]) and found[0] > found[2]


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "words", None), (3, "words", None)], "doc_id long, text string, lang string")
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(df, empty).collect()
    assert [r.score for r in out] == [0.0] * 4
    assert toxicity.reject(df, empty).count() == 4
    assert toxicity.score(df.limit(0), empty).count() == 0


def test_toxicity_gets_texts_by_bytes(spark):
    """Texts go to Python a few MB at a time, however many there are and however long they are, and all are scored."""
    df = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('fine day ', 2000) as text")  # 36 MB in one partition
    model = toxicity.Model(np.zeros((toxicity.BUCKETS, toxicity.DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=True)
    scored = toxicity.score(df, model)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    got = scored.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 2000
    assert max(r.size for r in got) < 6_000_000, got


def test_toxicity_sample_reaches_the_driver_in_parts(spark, monkeypatch):
    """No part holds the words of all rows of a label."""
    df = spark.createDataFrame([(k, "bad " if k % 2 else "fine ", k % 2) for k in range(400)], "doc_id long, text string, toxic int")
    kind, parts = type(df), []
    whole = kind.toLocalIterator

    def spied(self, *args, **more):
        parts.extend(r["count"] for r in self.groupBy(F.spark_partition_id()).count().collect())
        return whole(self, *args, **more)

    monkeypatch.setattr(kind, "toLocalIterator", spied)
    toxicity.fit(df, df)
    assert sum(parts) == 400 and max(parts) <= 100, parts


def test_toxicity_learns_from_all_labelled_rows(spark):
    """What only rows beyond the sample say, and only long texts, is learnt too; thresholds come from all held-out rows."""
    rng = random.Random(14)
    calm = lambda n: " ".join(rng.choices(["day", "tree", "stone", "bird", "lake", "hill"], k=n))
    rows = [(k, calm(20) + (" vile" if k % 2 else ""), "en", k % 2) for k in range(400)]
    rows += [(1000 + k, calm(400) + (" gruesome" if k % 2 else ""), "de", k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df, df, sample=40, train_bytes=300)
    asked = spark.createDataFrame([(0, calm(20) + " gruesome"), (1, calm(20) + " vile"), (2, calm(20)), (3, calm(500))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert min(got[0], got[1]) > 0.5 > max(got[2], got[3]), got
    assert set(model.thresholds) == {"en", "de", ""} and all(0 < model.thresholds[g] < 1 for g in ("en", "de"))
    again = toxicity.fit(df.repartition(7), df, sample=40, train_bytes=300)
    assert np.array_equal(again.embedding, model.embedding) and again.thresholds == model.thresholds


def test_toxicity_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    rows = [(k, "fine day " * 5 + ("vile " if k % 2 else ""), k % 2) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df, sample=20)
    got = [r.score for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert max(got[::2]) < 0.5 < min(got[1::2])


def test_thresholds_of_tables_are_those_of_calibrate(spark):
    rng = np.random.default_rng(15)
    model = toxicity.Model(np.zeros((1, 1)), [], np.zeros(0), np.zeros(0), 0.0)
    rows = [(g, int(y), float(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1))) for g, n in (("en", 300), ("de", 90), ("fr", 10)) for y in rng.integers(0, 2, n)] + [("xx", 0, 0.1 + k / 100) for k in range(30)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "scores", lambda *_: np.array([s for _, _, s in rows]))
        toxicity.calibrate(model, [(np.zeros((0, toxicity.COLUMNS), np.int32), y, g) for g, y, _ in rows])
    got = toxicity._thresholds(spark.createDataFrame(rows, "lang string, label int, score double").repartition(5))
    assert got.keys() == model.thresholds.keys() and all(got[g] == pytest.approx(t) for g, t in model.thresholds.items())


# SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.load()


def samples():
    rng = random.Random(10)
    made = ["".join(rng.choice("abcdefgh  éü.!T▁日\n") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    return ["", " ", "a", "  two  spaces ", "▁literal▁", "日本語", "x" * 300, " " * 70, *made]


def test_encoding_equals_the_library(vocabulary):
    """The library's own unigram encoder over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    lattice = sentencepiece_codec.Lattice(vocabulary)
    for t in samples():
        if "▁" not in t:  # which the library takes for a space
            assert lattice.encode([t])[0].tolist() == library.encode(t), t


@pytest.mark.parametrize("chunk", [17, 40, 16_384])
def test_chunked_documents_equal_whole_ones_and_round_trip(spark, vocabulary, chunk, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "FAN", 3)
    texts = [*samples(), None]
    df = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)] + [(0, texts[0], "e"), (None, "no id", "e")], "doc_id long, text string, extra string")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(df, chunk=chunk)).collect()
    assert len(out) == len(texts) + 2
    lattice = sentencepiece_codec.Lattice(vocabulary)
    for r in out:
        assert r.decoded == r.text and r.extra == "e"
        assert r.ids == (None if r.text is None else lattice.encode([r.text])[0].tolist())


# The pipeline


def test_pipeline(spark, sf_dir):
    import __spark_entry__
    import corpus_pipeline

    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, counts = before, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes), name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * before.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    out = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert out.count() == counts[-1] and out.where("not exact").count() == 0


def test_memory_does_not_grow_with_texts(vocabulary):
    """Ids are decoded a block at a time, a chunk's ids take four bytes each, and long texts share a slice with few others."""
    import tracemalloc

    from lectern.llm.sentencepiece_codec import IDS, Lattice, decode_ids, runs

    text = "the quick brown fox  jumps over lazy dogs é漢 " * 50
    ids, offs = Lattice(vocabulary).encode([text])
    times = 8 * IDS // len(ids)
    many = np.tile(ids, times)
    tracemalloc.start()
    got = decode_ids(vocabulary, many, np.array([0, len(ids), len(many)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == text.encode() and got[1] == (" ".join([text] * (times - 1))).encode()
    assert peak < 40 * len(many), peak / len(many)
    traced = Lattice(vocabulary).traced(text.replace(" ", "▁"), "", [0.0], [0])[0][0]
    assert memoryview(traced).itemsize == 4
    assert list(runs(np.array([1, 1, 5, 1, 1, 1, 0, 0]), 3, 3)) == [(0, 2), (2, 3), (3, 6), (6, 8)] and not list(runs(np.zeros(0), 3, 3))
