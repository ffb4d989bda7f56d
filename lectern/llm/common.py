"""Shared helpers: tables in the shared folder, vectorised tokens, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.sources.files import numbered, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 2_000_000
#: Links from which on no table of theirs is sent whole to every task.
MANY_LINKS = 100_000
#: What Spark sends to a Python worker at once, where the session doesn't say; a longer row goes alone.
BATCH_BYTES = 4_000_000

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return written(df, label)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at ``BATCH_BYTES``, unless it names a limit of its own.

    By default a batch ends at 64 MB of texts only; task and Python worker each hold such batches several times over.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, …, so that no name can clash or be misread, and what each is called now."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    called: dict[str, str] = {}
    for old, new in zip(docs.columns, names):
        called.setdefault(old, new)
    return docs.toDF(*names), called


def with_number(df: DataFrame, name: str) -> tuple[DataFrame, Column, DataFrame | None]:
    """df, a whole number for each id in column name, and the table (own, number) that names the ids again.

    Whole numbers stand for themselves (then df is as it was and there is no table). Ids of any
    other type, such as texts and fractions, are numbered in their order, so that smaller ids
    have smaller numbers; df gets a column ``number``. Null ids have no number.
    """
    if isinstance(df.schema[name].dataType, IntegralType):
        return df, F.col(name).cast("long"), None
    own = numbered(df.select(F.col(name).alias("own")).where("own is not null").distinct(), "own", "number")
    own = materialize(own.select("own", "number"), "ids")
    return df.join(own.select(F.col("own").alias("__own"), "number"), F.col(name) == F.col("__own"), "left").drop("__own"), F.col("number"), own


def own_ids(df: DataFrame, own: DataFrame | None, *columns: str) -> DataFrame:
    """df with the ids themselves in place of their numbers in these columns."""
    if own is None:
        return df
    order = df.columns
    for k, c in enumerate(columns):
        df = df.join(own.select(F.col("number").alias(c), F.col("own").alias(f"__own{k}")), c, "left").drop(c).withColumnRenamed(f"__own{k}", c)
    return df.select(*order)


def same_ids(a: DataFrame, x: str, b: DataFrame, y: str) -> tuple[Column, Column]:
    """Column x of a and column y of b as ids that can be compared: whole numbers if both are, else as they are or as texts."""
    kinds = a.schema[x].dataType, b.schema[y].dataType
    if all(isinstance(k, IntegralType) for k in kinds):
        return F.col(x).cast("long"), F.col(y).cast("long")
    if kinds[0] == kinds[1]:
        return F.col(x), F.col(y)
    return F.col(x).cast("string"), F.col(y).cast("string")


def as_text(name: str) -> Column:
    return F.col(name).cast("string")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * _MULT) | U64(1)
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWERED]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            grown = np.full(size, base, U64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last with their UTF-8 bytes and offsets (nulls are empty), about limit bytes at a time."""
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def span_hasher(data: np.ndarray, lower: bool = True) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends: the 64-bit hashes of these byte spans of data."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data] * up[: len(data)], out=total[1:])
    return lambda starts, ends: mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _MULT)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data."""
    return span_hasher(data, lower)(starts, ends)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of size bytes of data."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    n = len(data) - size + 1
    return mix64((total[size:] - total[:n]) * down[:n])


def token_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row of each; words hold no byte of \\x20\\x09-\\x0D."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _MULT + mix64(b))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (a, b: long).

    Large-star and small-star rounds, each written to the shared folder; only two numbers
    a round reach the driver. Self links, repeated and reversed edges are allowed; an empty
    edge table gives an empty result.
    """
    now = materialize(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), label)
    mark, n = None, now.count()
    while True:
        wide = lambda df: df.hint("merge") if n > MANY_LINKS else df  # noqa: B023, E731 - files of links are far smaller than the links
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(wide(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(wide(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()
        now = materialize(small, label)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark, n = tuple(seen), seen[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
