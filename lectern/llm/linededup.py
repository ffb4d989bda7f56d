"""Line dedup: winnowing over line hashes.

A gram is the shortest run of lines from a given line on that has ``gram_words`` words; a
window the shortest that has ``window_words``. The least gram hash of each window (the first
of equal ones) is a fingerprint, so any two equal runs of ``window_words`` words or more share
one. Each fingerprint joins its first position in the corpus (smallest doc_id, then line); the
match is extended line by line both ways, up to a window on either side, beyond which the next
fingerprint takes over; and the later run is deleted. The first position of a fingerprint may
lie in another context than a run's own first copy. So each whole window, the shortest from a
line on and the shortest up to a line, joins its first position as well: these cover every run
of ``window_words`` words or more, and all of it goes that stands earlier. A line goes only if
the same line stands at an earlier place, so one copy of everything stays.

Defined cases: lines are compared without outer white space; blank lines take no part, and go
only between two lines of one deleted run; a null text stays null; a text of deleted lines only
becomes empty; whole texts are read, however long; rows whose doc_id is null
stay as they are; ids are of any type with an order; rows that share a doc_id are judged alike, none a copy of another; an empty
table gives an empty result; all columns are kept, whatever their names (n_lines, n_removed and
n_spans are replaced if counts are asked for).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, materialize, shielded, with_number

GRAM_WORDS, WINDOW_WORDS = 8, 24

PRINTS = "doc_id long, version long, print long, pos int, size int, before array<long>, after array<long>"


def fingerprints(lines: list[bytes], gram_words: int, window_words: int) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(hash, first line, lines, hashes before from near to far, hashes after) of the selected grams of stripped non-blank lines."""
    n = len(lines)
    digest = xxhash.xxh3_64_intdigest
    h = [digest(x) - (1 << 63) for x in lines]
    total = [0]
    for x in lines:
        total.append(total[-1] + len(x.split()))
    words = np.array(total)
    gram_end = np.searchsorted(words, words[:-1] + gram_words, "left")
    window_end = np.searchsorted(words, words[:-1] + window_words, "left")
    grams = [digest(b"\n".join(lines[i:e])) - (1 << 63) if e <= n else None for i, e in enumerate(gram_end.tolist())]
    chosen: set[int] = set()
    for i, e in enumerate(window_end.tolist()):
        if e > n:
            break
        best, j = i, i + 1
        while j < n and gram_end[j] <= e:
            if grams[j] < grams[best]:
                best = j
            j += 1
        chosen.add(best)
    out = []
    for i in sorted(chosen):
        e = int(gram_end[i])
        a = int(np.searchsorted(words, words[i] - window_words, "right")) - 1
        b = int(np.searchsorted(words, words[e] + window_words, "left"))
        out.append((grams[i], i, e - i, h[max(a, 0) : i][::-1], h[e:b]))
    return out


def windows(lines: list[bytes], window_words: int) -> list[tuple[int, int, int]]:
    """(hash, first line, lines) of the shortest runs of window_words words from each line on and up to each line."""
    words = np.cumsum([0, *(len(x.split()) for x in lines)])
    ends = np.searchsorted(words, words[:-1] + window_words, "left")
    starts = np.searchsorted(words, words[1:] - window_words, "right") - 1
    spans = {(i, e) for i, e in enumerate(ends.tolist()) if e <= len(lines)} | {(a, e + 1) for e, a in enumerate(starts.tolist()) if a >= 0}
    return [(xxhash.xxh3_64_intdigest(b"\n".join(lines[a:e]), 1) - (1 << 63), a, e - a) for a, e in sorted(spans)]


def split_lines(raw: bytes) -> tuple[list[bytes], list[int]]:
    """The stripped non-blank lines and their places among all lines."""
    kept = [(x, k) for k, line in enumerate(raw.split(b"\n")) if (x := line.strip())]
    return [x for x, _ in kept], [k for _, k in kept]


def prints(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The fingerprints with their context, and the whole windows, which need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PRINTS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.int64())] * 2
        for batch in batches:
            out = []
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lines, _ = split_lines(text.as_buffer().to_pybytes())
                out += [(doc, version, *p) for p in fingerprints(lines, gram_words, window_words)]
                out += [(doc, version, *w, [], []) for w in windows(lines, window_words)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id"), F.xxhash64("text").alias("version"), F.col("text"))
    return rows.mapInArrow(run, PRINTS)


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, version, runs): the deleted runs [first, past last) of non-blank lines, by document text."""
    found = materialize(prints(docs, gram_words, window_words), "line-prints")
    first = found.groupBy("print").agg(F.min(F.struct("doc_id", "pos", "size", "before", "after")).alias("f"), F.count("*").alias("n")).where("n > 1").select("print", "f")
    both = found.join(first, "print").where("doc_id <> f.doc_id or pos <> f.pos").where("size = f.size")
    length = "coalesce(array_position(zip_with({0}, f.{0}, (x, y) -> coalesce(x = y, false)), false), 0)"
    reach = lambda side: F.expr(f"case when {length.format(side)} = 0 then size({side}) else {length.format(side)} - 1 end").cast("int")
    runs = both.select("doc_id", "version", F.struct((F.col("pos") - reach("before")).alias("a"), (F.col("pos") + F.col("size") + reach("after")).alias("b")).alias("run"))
    return runs.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("run")).alias("runs"))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int, int]:
    """(text left, non-blank lines, of these deleted, maximal deleted runs)."""
    _, at = split_lines(raw)
    if not spans:
        return raw, len(at), 0, 0
    gone = np.zeros(len(at) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    lines = raw.split(b"\n")
    drop = np.zeros(len(lines), bool)
    drop[np.array(at)[gone]] = True
    for k in np.flatnonzero(gone[:-1] & gone[1:]):
        drop[at[k] : at[k + 1]] = True
    return b"\n".join(x for x, d in zip(lines, drop) if not d), len(at), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())


def dedup(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, counts: bool = False) -> DataFrame:
    """docs without repeated runs of lines; counts adds n_lines, n_removed and n_spans."""
    numbers = ["n_lines", "n_removed", "n_spans"] if counts else []
    plain, called = shielded(docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in numbers]))
    columns, text = plain.columns, as_text(called["text"])
    plain, doc_id, _ = with_number(plain, called["doc_id"])
    runs = repeated_runs(plain.select(doc_id.alias("doc_id"), text.alias("text")), gram_words, window_words)
    runs = runs.select("doc_id", "version", F.expr("flatten(transform(runs, r -> array(r.a, r.b)))").alias("runs"))
    joined = plain.withColumns({"id": doc_id, "hash": F.xxhash64(text)}).join(runs, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("version")), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long, n_spans long")
    def cut(texts, runs):
        import pandas as pd

        out = []
        for text, flat in zip(texts, runs):
            if text is None:
                out.append((None, 0, 0, 0))
                continue
            spans = [] if flat is None else list(zip(flat[::2].tolist(), flat[1::2].tolist()))
            left, *numbers = _without(text.encode(), spans)
            out.append((left.decode() if spans else text, *numbers))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "n_spans"])

    done = joined.withColumn("cut", cut(text, "runs"))
    cols = [F.col("cut.text") if c == called["text"] else F.col(c) for c in columns]
    names = [c for c in docs.columns if c not in numbers]
    return done.select(*cols, *[F.col(f"cut.{c}") for c in numbers]).toDF(*names, *numbers)
