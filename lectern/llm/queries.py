"""The numbered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import collocations, decontaminate, html_text, images, katz, licenses, linededup, sentencepiece_codec, simhash, suffix_dedup, toxicity, url_filter, whitening


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", "n_spans", "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its rule, verdict and its host's posterior."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    out = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled", F.round("posterior_mean", 6).alias("posterior_mean"), F.round("posterior_bound", 6).alias("posterior_bound"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from those whose crc32 leaves no 2 by 7."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = katz.score(read(spark, sf_dir, "documents"), remainder != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture made from the embeddings, with its class of copies and its links."""
    return images.copies(images.from_embeddings(read(spark, sf_dir, "embeddings"))).select("image_id", "class_id", "n_links")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes left after 100-byte strings that start earlier went."""
    return suffix_dedup.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the class that links of 4 bits or fewer make."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels whose crc32 is not divisible by 5."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder != 0)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to the very text."""
    coded = sentencepiece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that occurs in it, with the edit distance and place."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first four whitened components."""
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases, their places, and the licences whose templates stand in it."""
    out = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 most cohesive phrases of two to five words."""
    return collocations.mine(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_katz, op4_html_text, op5_image_copies, op6_suffix_dedup, op7_simhash, op8_toxicity, op9_sentencepiece, op10_decontaminate, op11_whitening, op12_licenses, op13_collocations)}
ORACLES = {"op2_url_filter": url_filter.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
