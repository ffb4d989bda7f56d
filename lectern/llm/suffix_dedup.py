"""Suffix-array dedup with a run-length index: bytes covered by a long string that starts earlier go.

Every ``length``-byte window has a minimizer, its least hashed gram (the first of equal ones), so
equal windows share it. A segment is a stretch of text whose windows have one minimizer
occurrence. Segments meet in a bucket by minimizer: whole segments equal to an earlier one go.
Distinct segments around one minimizer are put, in corpus order, into the bucket's run-length
index: the run-compressed Burrows-Wheeler transform with text positions and match lengths
sampled at run borders only. Streaming through the text, the samples give each position's
match with its lexicographic predecessor (phi, and its length less one a step); positions
whose chains of matches of ``length`` bytes or more reach an earlier one are marked.

Tasks first drop segments that repeat inside their own block, so a hot passage sends one row a
block; buckets hold about ``PART_BYTES`` of text each. A minimizer with more than ``HOT_SEGMENTS``
distinct segments (a phrase in ever new surroundings) fills no bucket: it exceeds its share in
some block, which says so; its segments are dealt out by their own hash, and their windows meet
one by one, by the hash of the whole window, in a join that Spark splits.

Defined cases: a null text counts as empty; whole texts are read, however long; matches never
cross documents; bytes are those of UTF-8; of equal strings the first place stays, and rows that
share a doc_id are judged as one document; rows whose id is null are neither
copies nor originals; ids are of any type with an order; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U64, as_text, gram_hashes, materialize, shielded, span_hasher, text_slices, with_number

LENGTH, GRAM = 100, 32
PART_BYTES, BLOCK_BYTES = 8_000_000, 12_000_000
#: Distinct segments around one minimizer that one bucket takes, and hot minimizers that are broadcast.
HOT_SEGMENTS, BROADCAST = 48_000, 50_000

#: kind 0: a removed stretch; 1: a segment, with its minimizer, hash and the minimizer's place in it,
#: 2: one of a hot minimizer; 3: a hot minimizer.
SEGMENTS = "kind int, doc long, version int, start long, size int, mini long, hash long, at int"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], _NAMES)


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first byte, past-last byte, minimizer's byte, minimizer's hash, segment's hash) of all segments, in order."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    if len(data) < length:
        return none
    hashes = gram_hashes(data, gram)
    least = (hashes & ~U64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=U64)
    width, size = length - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    arg = (least & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(arg)]
    at = np.flatnonzero(np.arange(len(arg)) + length <= offs[row + 1])
    if not len(at):
        return none
    arg, row = arg[at], row[at]
    new = np.flatnonzero(np.concatenate([[True], (arg[1:] != arg[:-1]) | (row[1:] != row[:-1])]))
    start, end = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1] + length
    mini = arg[new]
    return row[new], start, end, mini, hashes[mini], span_hasher(data, lower=False)(start, end) + (mini - start).astype(U64)


def _merge(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches sorted by key and start, with overlapping and touching ones of a key as one."""
    if not len(key):
        return key, start, end
    high = np.maximum.accumulate(end + key * (1 << 40)) - key * (1 << 40)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > high[:-1])]))
    return key[new], start[new], high[np.concatenate([new[1:], [len(key)]]) - 1]


def _later(order_key: list[np.ndarray], mini, hashes) -> tuple[np.ndarray, np.ndarray]:
    """(order by minimizer, hash and place; in it, which are copies of one at an earlier place)."""
    order = np.lexsort((*order_key[::-1], hashes, mini))
    m, h = mini[order], hashes[order]
    first = np.concatenate([[True], (m[1:] != m[:-1]) | (h[1:] != h[:-1])])
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    for k in order_key:  # rows at the very place of the first are no copies of it
        later |= k[order] != k[order][head]
    return order, later


def _segments_of(docs: DataFrame, length: int, gram: int, share: float) -> DataFrame:
    """share: the distinct segments around one minimizer that a byte of a block may have without its being hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, version, row, start, end, mini, h, s = (np.concatenate(x) for x in zip(*held))
            order, later = _later([doc, start], h, s)
            gone = order[later]
            gone = gone[np.lexsort((start[gone], row[gone]))]
            if len(gone):
                first = np.unique(row, return_index=True)
                r, a, b = _merge(row[gone], start[gone], end[gone])
                of = first[1][np.searchsorted(first[0], r)]
                none = np.zeros(len(r), np.int64)
                yield _batch(none, doc[of], version[of], a, b - a, none, none, none)
            kept = order[~later]
            minis, n = np.unique(h[kept], return_counts=True)
            hot = minis[n > max(1, share * size)].view(np.int64)
            if len(hot):
                none = np.zeros(len(hot), np.int64)
                yield _batch(np.full(len(hot), 3, np.int32), none, none, none, none, hot, none, none)
            for a in range(0, len(kept), 100_000):
                k = kept[a : a + 100_000]
                yield _batch(np.ones(len(k), np.int32), doc[k], version[k], start[k], end[k] - start[k], h[k].view(np.int64), s[k].view(np.int64), mini[k] - start[k])

        for batch in batches:
            ids, versions = (batch.column(c).to_numpy() for c in ("doc", "version"))
            for first, _, data, offs in text_slices(batch.column("text")):
                row, start, end, mini, h, s = segments(data, offs, length, gram)
                base = offs[row]
                held.append((ids[first + row], versions[first + row], rows + first + row, start - base, end - base, mini - base, h, s))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
            rows += batch.num_rows
        if held:
            yield from flush()

    return docs.mapInArrow(run, SEGMENTS)


def _meet(table: pa.Table) -> pa.Table:
    """One bucket's segments: those that copy an earlier one are removed (0); the first ones of minimizers with several stay (1), and of hot ones (2)."""
    kind = table["kind"].to_numpy()
    doc, version, start, size, mini, h, at = (table[c].to_numpy() for c in _NAMES[1:])
    order, later = _later([doc, start], mini, h)
    m, hs = mini[order], h[order]
    new = np.concatenate([[True], m[1:] != m[:-1]])
    group = np.cumsum(new) - 1
    variant = new | np.concatenate([[True], hs[1:] != hs[:-1]])
    several = (np.bincount(group, variant)[group] > 1) | (kind[order] == 2)
    out = later | (several & variant)
    pick = order[out]
    return pa.Table.from_batches([_batch(np.where(later[out], 0, kind[pick]).astype(np.int32), doc[pick], version[pick], start[pick], size[pick], mini[pick], h[pick], at[pick])])


class RunLengthIndex:
    """The run-compressed BWT of texts, with the samples at its run borders that stream phi and match lengths."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        """data[offs[k] : offs[k + 1]] are the texts."""
        n = len(data) + len(offs) - 1
        text = np.zeros(n, np.int64)  # 0 ends a text
        text[np.arange(len(data)) + np.repeat(np.arange(len(offs) - 1), np.diff(offs))] = data.astype(np.int64) + 1
        self.starts = offs[:-1] + np.arange(len(offs) - 1)
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], -1)  # nothing stands before the first
        border = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.heads, self.lengths = before[border], np.diff(np.concatenate([border, [n]]))  # the BWT, run by run
        at, last = order[border], order[border - 1]  # first positions of the runs, last ones of the runs before
        match = np.zeros(len(at), np.int64)
        going = np.arange(len(at))[border > 0]
        k = 0
        while len(going):
            a, b = at[going] + k, last[going] + k
            inside = (a < n) & (b < n)
            going, a, b = going[inside], a[inside], b[inside]
            going = going[text[a] == text[b]]
            k += 1
            match[going] = k
        by_place = np.argsort(at)
        self.sample_at, self.sample_phi, self.sample_match = at[by_place], last[by_place], match[by_place]
        self.size = n
        self.left = np.repeat(offs[1:] + np.arange(len(offs) - 1), np.diff(offs) + 1) - np.arange(n)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """(phi, match with it inside one text) of every position, from the samples alone."""
        near = np.searchsorted(self.sample_at, np.arange(self.size), "right") - 1
        step = np.arange(self.size) - self.sample_at[near]
        return self.sample_phi[near] + step, np.minimum(self.sample_match[near] - step, self.left)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of text (symbols 0 to 256) in order, by prefix doubling from seven symbols on."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key[: n - k] += text[k:] << (9 * (6 - k)) if k < n else 0
    covered = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[: max(n - covered, 0)] += rank[covered:]
        covered *= 2


def repeated_windows(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each window that also starts in an earlier text, or earlier in its own."""
    index = RunLengthIndex(data, offs)
    phi, match = index.stream()
    n = index.size
    # Positions linked to phi by a match of a window or more form chains, each a range of the
    # suffix order; the root is where the chain ends, and the least position of it is the first.
    root = np.where(match >= length, phi, np.arange(n))
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    first = np.full(n, n)
    np.minimum.at(first, root, np.arange(n))
    found = np.flatnonzero(first[root] < np.arange(n))
    text = np.searchsorted(index.starts, found, "right") - 1
    return text, found - index.starts[text]


def _indexed(length: int):
    def run(table):
        """One bucket's distinct segments, in corpus order, to the stretches that repeat."""
        doc, version, start = (table[c].to_numpy() for c in ("doc", "version", "start"))
        order = np.lexsort((start, doc))
        texts = table["piece"].take(pa.array(order)).to_pylist()
        doc, version, start = doc[order], version[order], start[order]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        text, at = repeated_windows(np.frombuffer(b"".join(texts), np.uint8), offs, length)
        k, a, b = _merge(text, at, at + length)
        return pa.table({"doc": doc[k], "version": version[k], "start": start[k] + a, "size": (b - a).astype(np.int32)}, schema=pa.schema([("doc", pa.int64()), ("version", pa.int32()), ("start", pa.int64()), ("size", pa.int32())]))

    return run


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """(mini, doc, version, start, piece): the bytes of each document's asked stretches; of hot ones their windows' hashes as mini."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, version, asked, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "asked")), batch.column("text")):
                raw = text.as_buffer().to_pybytes()
                for x in asked:
                    piece = raw[x["start"] : x["start"] + x["size"]]
                    if x["kind"] == 2:
                        minis = gram_hashes(np.frombuffer(piece, np.uint8), length).view(np.int64).tolist()
                        new = (minis, [doc] * len(minis), [version] * len(minis), range(x["start"], x["start"] + len(minis)), [None] * len(minis))
                    else:
                        new = ([x["mini"]], [doc], [version], [x["start"]], [piece])
                    for col, values in zip(out, new):
                        col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["mini", "doc", "version", "start", "piece"])

    return rows.mapInArrow(run, "mini long, doc long, version int, start long, piece binary")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc, version, start, size) of stretches of (doc, version, text) that are to go; they may overlap."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    made = materialize(_segments_of(docs, length, gram, hot_segments / max(size, 1)), "segments")
    stretch = ["doc", "version", "start", "size"]
    hot = made.where("kind = 3").select("mini", F.lit(True).alias("hot")).distinct()
    count = hot.count()
    hot = F.broadcast(hot) if count <= BROADCAST else hot
    found = made.where("kind = 1")
    if count:
        found = found.join(hot, "mini", "left").withColumn("kind", F.when(F.col("hot"), 2).otherwise(1)).select(*_NAMES)
    deal = F.when(F.col("kind") == 2, F.xxhash64("mini", "hash")).otherwise(F.xxhash64("mini"))
    met = found.withColumn("bucket", F.pmod(deal, F.lit(parts))).groupBy("bucket")
    met = materialize(met.applyInArrow(lambda key, table: _meet(table.drop_columns(["bucket"])), SEGMENTS), "met")
    asked = met.where("kind > 0").groupBy("doc", "version").agg(F.collect_list(F.struct("kind", "mini", "start", "size")).alias("asked"))
    pieces = materialize(_pieces(docs.dropDuplicates(["doc", "version"]).join(asked, ["doc", "version"]), length), "pieces")
    run = _indexed(length)
    marked = pieces.where("piece is not null").groupBy(F.pmod(F.xxhash64("mini"), F.lit(parts)).alias("bucket")).applyInArrow(lambda key, table: run(table), "doc long, version int, start long, size int")
    gone = made.where("kind = 0").select(*stretch).union(met.where("kind = 0").select(*stretch)).union(marked)
    if count:
        windows = pieces.where("piece is null")
        first = windows.groupBy("mini").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
        later = windows.join(first, "mini").where("doc <> f.doc or start <> f.start")
        gone = gone.union(later.select("doc", "version", "start", F.lit(length).alias("size")))
    return gone


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: binary) of each row of docs."""
    plain, called = shielded(docs)
    plain, number, _ = with_number(plain, called["doc_id"])
    kind = plain.schema[called["doc_id"]].dataType.simpleString()
    base = plain.select(number.alias("doc_id"), F.col(called["doc_id"]).alias("own"), F.coalesce(as_text(called["text"]), F.lit("")).alias("text")).withColumn("version", F.hash("text"))
    gone = repeats(base.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "version", "text"), length, gram, hot_segments)
    gone = gone.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    joined = base.join(gone.withColumnsRenamed({"doc": "doc_id"}), ["doc_id", "version"], "left").select("own", "text", F.col("gone.start").alias("starts"), F.col("gone.size").alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, sizes in zip(batch.column("text"), batch.column("starts"), batch.column("sizes")):
                raw = text.as_buffer().to_pybytes()
                spans = []
                if starts.is_valid:
                    a = starts.values.to_numpy()
                    order = np.argsort(a)
                    _, a, b = _merge(np.zeros(len(a), np.int64), a[order], (a + sizes.values.to_numpy())[order])
                    spans = list(zip(a.tolist(), b.tolist()))
                cuts = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
