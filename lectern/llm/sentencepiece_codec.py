"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is the best segmentation of a text into vocabulary pieces by the sum of the piece
scores (Viterbi; of equal sums the one whose pieces, from the end, are longest). A document
longer than ``CHUNK`` characters is split. Each chunk gives a max-plus matrix over boundary
states, a state being the number of characters a crossing piece takes beyond the boundary.
A scan of associative products gives every chunk its start vector; with it the chunk's map
from exit state to entry state, and a second scan, of compositions, the state at its end.
Then each chunk is traced back by itself. Scans go through groups of ``FAN`` neighbours, level
by level, so no task ever holds more than that, whatever the length of a document.

Spaces become U+2581 and one more is put in front; characters outside the vocabulary become
byte pieces, and so does a literal U+2581, which makes decoding exact. The vocabulary file's
path is a parameter; its pieces are read on the driver and broadcast (a fixed vocabulary).

The ids are those of the best path by the file's scores, which is unigram encoding. Of a file
made for merges (BPE) they are the same pieces, but not always the same cut as its merges give.
All paths are worked out here: words, between whose starts every path is cut, many at a time
(``words``), and all that touches a chunk's border by itself (``forward``).

Defined cases: a null text gives null ids and decodes to null; an empty text gives no ids;
repeated rows are encoded alike; texts of any length are encoded whole; rows may have any id or
none; an empty table gives an empty result; columns are kept whatever their names, but for those
that the result adds, which are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import as_text, materialize, shielded

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN, CACHE, WIDE, AHEAD = 32_768, 256, 60_000, 24, 32
#: Ids and bytes handled at once, so that a task's memory does not grow with its texts.
ROWS, BYTES, IDS = 300, 1_000_000, 250_000

SPACE, LITERAL = "▁", "\udc81"  # a lone surrogate is in no text
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = -np.inf


@dataclass
class Vocabulary:
    """Pieces with their scores; bytes_of gives what a piece decodes to."""

    ids: dict[str, tuple[float, int]]
    byte_ids: list[int]
    bytes_of: list[bytes]
    longest: int
    unknown: float

    @cached_property
    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Hashes of the pieces' characters in order, scores, ids, where the hashes of each first bits begin, and the most that share them."""
        made = sorted((int((hash_rows(codes([piece], len(piece)))[:, -1] * _MIX)[0]), score, k) for piece, (score, k) in self.ids.items())
        if len({h for h, _, _ in made}) < len(made):
            raise ValueError("two pieces share a hash")
        h, score, k = zip(*made)
        h = np.array(h, np.uint64)
        counts = np.bincount((h >> SHIFT).astype(np.int64), minlength=1 << BITS)
        most = int(counts.max())
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        return np.concatenate([h, np.zeros(most, np.uint64)]), np.array([*score, *[NONE] * most]), np.array([*k, *[-1] * most], np.int32), first, most

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where each piece's begin."""
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])


def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, tuple[float, int]] = {}
    byte_ids, bytes_of = [0] * 256, [b""] * model.get_piece_size()
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            bytes_of[k] = bytes([int(piece[3:5], 16)])
        elif not (model.is_unknown(k) or model.is_control(k) or model.is_unused(k)):
            ids[piece] = (float(model.get_score(k)), k)
            bytes_of[k] = piece.replace(SPACE, " ").encode()
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece crosses a word's start; words can't be cut apart")
    return Vocabulary(ids, byte_ids, bytes_of, max(map(len, ids)), min(s for s, _ in ids.values()) - 10)


def escape(text: str) -> str:
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)


_BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 20
SHIFT = np.uint64(64 - BITS)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def codes(words: list[str], n: int) -> np.ndarray:
    """The characters of words of length n, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)


def hash_rows(chars: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, … characters of each row, from which those of all stretches follow."""
    out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    for k in range(chars.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + chars[:, k] + np.uint64(1)
    return out


class Lattice:
    """Viterbi over stretches of escaped text, with a cache of whole words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.sums = array("i"), array("q", [0]), array("d")

    def ready(self, found: list[list[str]]) -> None:
        """Put the words of several texts into the cache, which is emptied first where it is full."""
        if len(self.words) > CACHE:
            self.forget()
        self.learn(set().union(*found))

    def words_inside(self, body: str) -> list[str]:
        """The words of a chunk between its first and last word start."""
        first, last = self.cuts(body)
        return WORD.findall(body[first:last]) if first >= 0 else []

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: those of one length together, long ones one by one."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self.words:
                by_length.setdefault(len(w), []).append(w)
        for n, new in by_length.items():
            if n > WIDE:
                for w in new:
                    self._add(w)
            for a in range(0, len(new) if n <= WIDE else 0, 2000):
                self._add_all(new[a : a + 2000], n)

    def _add(self, w: str) -> None:
        best, back = self.forward(w, [0.0], len(w))
        self._put(w, self.pieces(w, back, len(w))[0], best[len(w)])

    def _put(self, w: str, ids: list[int], total: float) -> None:
        self.words[w] = len(self.sums)
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.sums.append(total)

    def _add_all(self, words: list[str], n: int) -> None:
        """The best paths of words of length n, all at once: the same sums in the same order as ``forward``."""
        keys, scores, ids, begins, most = self.v.hashed
        chars = codes(words, n)
        h = np.ascontiguousarray(hash_rows(chars).T)
        bytes_at = np.array(self.v.byte_ids, np.int32)
        best, piece, back = np.full((n + 1, len(words)), NONE), np.full((n + 1, len(words)), -1, np.int32), np.zeros((n + 1, len(words)), np.int8)
        best[0] = 0
        odd = np.zeros(len(words), bool)  # with a character that is no piece and takes several bytes
        power = _BASE ** np.arange(n + 1, dtype=np.uint64)
        for e in range(1, n + 1):
            for p in range(max(0, e - self.v.longest), e):
                made = (h[e] - h[p] * power[e - p]) * _MIX
                at = begins[(made >> SHIFT).view(np.int64)]
                hit = keys[at] == made
                for _ in range(most - 1):
                    at = at + ~hit
                    hit = keys[at] == made
                total, made = np.where(hit, best[p] + scores[at], NONE), ids[at]
                if p == e - 1 and not hit.all():
                    none = np.flatnonzero(~hit)
                    char = chars[none, p].astype(np.int64)
                    total[none], made[none] = best[p, none] + self.v.unknown, bytes_at[char % 128]
                    odd[none[char >= 128]] = True
                better = total > best[e]
                np.copyto(best[e], total, where=better)
                np.copyto(piece[e], made, where=better)
                np.copyto(back[e], p, where=better, casting="unsafe")
        rows = np.flatnonzero(~odd)
        at, columns = np.full(len(rows), n), []
        while (at > 0).any():
            columns.append(np.where(at > 0, piece[at, rows], -1))
            at = np.where(at > 0, back[at, rows], 0)
        if len(rows):
            made = np.array(columns[::-1]).T
            kept = made >= 0
            first, base = len(self.sums), len(self.flat)
            self.flat.frombytes(made[kept].astype(np.int32).tobytes())
            self.starts.frombytes((base + np.cumsum(kept.sum(1))).astype(np.int64).tobytes())
            self.sums.frombytes(best[n, rows].tobytes())
            self.words.update(zip([words[k] for k in rows.tolist()], range(first, first + len(rows))))
        for k in np.flatnonzero(odd).tolist():
            start = back[:, k].tolist()
            self._put(words[k], self.pieces(words[k], [-1, *start[1:]], n)[0], best[n, k])

    def forward(self, text: str, init: list[float], limit: int) -> tuple[list[float], list[int]]:
        """Best sum and first position of the last piece for each position of text; pieces start before limit.

        init[p]: the sum with which a path may start at position p. Where that is best, the
        piece's start is -1.
        """
        ids, longest, unknown = self.v.ids, self.v.longest, self.v.unknown
        best, back = [NONE] * (len(text) + 1), [-1] * (len(text) + 1)
        best[: len(init)] = init[: len(text) + 1]
        for p in range(min(limit, len(text))):
            here = best[p]
            if here == NONE:
                continue
            single = False
            for e in range(p + 1, min(p + longest, len(text)) + 1):
                got = ids.get(text[p:e])
                if got:
                    single |= e == p + 1
                    if here + got[0] > best[e]:
                        best[e], back[e] = here + got[0], p
            if not single and here + unknown > best[p + 1]:
                best[p + 1], back[p + 1] = here + unknown, p
        return best, back

    def pieces(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """(ids of the path that ends at end, where it started)."""
        out: list[list[int]] = []
        while back[end] >= 0:
            start = back[end]
            got = self.v.ids.get(text[start:end])
            out.append([got[1]] if got else [self.v.byte_ids[b] for b in (SPACE.encode() if text[start:end] == LITERAL else text[start:end].encode())])
            end = start
        return [k for part in reversed(out) for k in part], end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text)."""
        found = [WORD.findall(escape(text)) if text else [] for text in texts]
        self.ready(found)
        index, number = array("q"), self.words.__getitem__
        for words in found:
            index.extend(map(number, words))
        at, starts = np.array(index), np.array(self.starts)
        sizes = np.diff(starts)[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.array(self.flat, np.int32)[np.repeat(starts[at] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)]

    # Chunks. States: the first ``longest`` positions from a boundary on.

    def cuts(self, body: str) -> tuple[int, int]:
        """First and last word start inside a chunk, at which every path is cut; (-1, -1) if it has none."""
        found = re.search(f"(?<=[^{SPACE}]){SPACE}", body)
        if not found:
            return -1, -1
        last = len(body[: body.rfind(SPACE) + 1].rstrip(SPACE))
        return found.start(), last

    def matrix(self, body: str, ahead: str) -> np.ndarray:
        """Best sums of a chunk from each entry state to each exit state."""
        n, (first, last) = self.v.longest, self.cuts(body)

        def exits(best: list[float], at: int) -> list[float]:
            return (best[at:] + [NONE] * n)[:n]

        def enter(a: int) -> list[float]:
            return [NONE] * a + [0.0] + [NONE] * (n - 1 - a)

        if first < 0:
            return np.array([exits(self.forward(body + ahead, enter(a), len(body))[0], len(body)) for a in range(n)])
        head = [self.forward(body[:first], enter(a), first)[0][first] if a <= first else NONE for a in range(n)]
        words = WORD.findall(body[first:last])
        self.learn(set(words))
        middle = sum(self.sums[self.words[w]] for w in words)
        tail = exits(self.forward(body[last:] + ahead, [middle], len(body) - last)[0], len(body) - last)
        return np.array(head)[:, None] + np.array(tail)

    def entries(self, body: str, ahead: str, init: list[float]) -> list[int]:
        """The entry state of the best path to each exit state; 0 where no path ends."""
        n, (first, _) = self.v.longest, self.cuts(body)
        if first < 0:
            return [entry for _, entry in self.traced(body, ahead, init, list(range(n)))]
        best, back = self.forward(body[:first], init, first)
        return [self.pieces(body[:first], back, first)[1] if best[first] > NONE else 0] * n

    def traced(self, body: str, ahead: str, init: list[float], exits: list[int]) -> list[tuple[list[int] | array, int]]:
        """(ids of the pieces that start in the chunk, entry state) for each exit state that a path reaches."""
        first, last = self.cuts(body)
        if first < 0:
            text = body + ahead
            best, back = self.forward(text, init, len(body))
            return [self.pieces(text, back, len(body) + b) if len(body) + b <= len(text) and best[len(body) + b] > NONE else ([], 0) for b in exits]
        head_text = body[:first]
        best, back = self.forward(head_text, init, first)
        head, entry = self.pieces(head_text, back, first) if best[first] > NONE else ([], 0)
        middle = array("i", head)
        words = WORD.findall(body[first:last])
        self.learn(set(words))
        for w in words:
            k = self.words[w]
            middle += self.flat[self.starts[k] : self.starts[k + 1]]
        tail_text = body[last:] + ahead
        best, back = self.forward(tail_text, [0.0], len(body) - last)
        out = []
        for b in exits:
            end = len(body) - last + b
            tail = self.pieces(tail_text, back, end)[0] if end <= len(tail_text) and best[end] > NONE else []
            out.append((middle + array("i", tail), entry))
        return out


def _lattice(shared) -> Lattice:
    """One lattice, with its cache, for each Python worker and vocabulary."""
    global _kept
    if _kept is None or _kept.v.bytes_of != shared.value.bytes_of:
        _kept = Lattice(shared.value)
    return _kept


_kept: Lattice | None = None


def _times(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for m in parts[1:]:
        out = np.max(out[:, :, None] + m[None], axis=1)
    return out


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    """Maps from exit to entry state of neighbours, first to last, as one map."""
    out = parts[-1]
    for m in reversed(parts[:-1]):
        out = m[out]
    return out


def _scan(items: DataFrame, ascending: bool, n: int) -> DataFrame:
    """items (doc, version, k, m: binary) with state: what reaches each k from its document's start (or end).

    ascending: m is a max-plus matrix, the state a vector of sums at the start of k; else m is
    a map from exit to entry state and the state the exit state of k. Groups of FAN at a time.
    """
    schema = "doc long, version long, k long, m binary"
    dtype = np.float64 if ascending else np.int64
    shape = (n, n) if ascending else (n,)

    def up(key, table):
        rows = sorted(zip(table["k"].to_pylist(), table["m"].to_pylist()))
        parts = [np.frombuffer(m, dtype).reshape(shape) for _, m in rows]
        made = (_times if ascending else _chain)(parts)
        return pa.table({"doc": pa.array([key[0].as_py()], pa.int64()), "version": pa.array([key[1].as_py()], pa.int64()), "k": pa.array([key[2].as_py()], pa.int64()), "m": [made.tobytes()]})

    def down(key, above, table):
        rows = sorted(zip(table["k"].to_pylist(), table["m"].to_pylist()), reverse=not ascending)
        state = np.frombuffer(above["state"][0].as_py(), dtype)
        states = []
        for _, m in rows:
            states.append(state.tobytes())
            part = np.frombuffer(m, dtype).reshape(shape)
            if ascending:
                state = np.max(state[:, None] + part, axis=0)
                state = state - state.max()
            else:
                state = part[state]
        size = len(rows)
        return pa.table({"doc": pa.array([key[0].as_py()] * size, pa.int64()), "version": pa.array([key[1].as_py()] * size, pa.int64()), "k": pa.array([k for k, _ in rows], pa.int64()), "state": pa.array(states, pa.binary())})

    group = F.expr(f"k div {FAN}").alias("g")
    levels = [items]
    while levels[-1].agg(F.max("k")).first()[0] or 0:
        made = levels[-1].groupBy("doc", "version", group).applyInArrow(up, schema)
        levels.append(materialize(made, "scan"))
    first = np.full(n, NONE)
    first[0] = 0
    first = first.tobytes() if ascending else np.zeros(1, np.int64).tobytes()
    states = levels[-1].select("doc", "version", "k", F.lit(bytearray(first)).alias("state"))
    for below in reversed(levels[:-1]):
        states = states.groupBy("doc", "version", F.col("k").alias("g")).cogroup(below.groupBy("doc", "version", group)).applyInArrow(down, "doc long, version long, k long, state binary")
        states = materialize(states, "scan-states")
    return items.join(states, ["doc", "version", "k"])


def _chunks(giants: DataFrame, chunk: int, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                whole = escape(text)
                at = range(0, len(whole), chunk)
                bodies = [whole[a : a + chunk].encode("utf-8", "surrogatepass") for a in at]
                ahead = [whole[a + chunk : a + chunk + longest - 1].encode("utf-8", "surrogatepass") for a in at]
                size = len(bodies)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * size, pa.int64()), pa.array([version] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array(bodies, pa.binary()), pa.array(ahead, pa.binary())], ["doc", "version", "k", "body", "ahead"])

    return giants.mapInArrow(run, "doc long, version long, k long, body binary, ahead binary")


def _encode_giants(giants: DataFrame, shared, chunk: int, n: int) -> DataFrame:
    """(doc, version, ids) of the distinct rows (doc, version, text) of giants."""
    chunks = materialize(_chunks(giants, chunk, n), "chunks").repartition("doc", "version", "k")
    # one row a chunk; the bodies are dealt out, however long their document

    def texts(batch: pa.RecordBatch, lattice: Lattice | None = None) -> Iterator[tuple[str, str]]:
        """The chunks of a batch; a lattice learns the words of AHEAD chunks at once."""
        for a in range(0, batch.num_rows, AHEAD):
            part = batch.slice(a, AHEAD)
            made = [(body.decode("utf-8", "surrogatepass"), ahead.decode("utf-8", "surrogatepass")) for body, ahead in zip(part.column("body").to_pylist(), part.column("ahead").to_pylist())]
            if lattice:
                lattice.ready([lattice.words_inside(body) for body, _ in made])
            yield from made

    def keyed(batch: pa.RecordBatch, values: list, kind: pa.DataType, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "version", "k")), pa.array(values, kind)], ["doc", "version", "k", name])

    def matrices(batches):
        for batch in batches:
            lattice = _lattice(shared)
            yield keyed(batch, [lattice.matrix(*t).tobytes() for t in texts(batch, lattice)], pa.binary(), "m")

    def maps(batches):
        for batch in batches:
            lattice, out = _lattice(shared), []
            for t, state in zip(texts(batch), batch.column("state").to_pylist()):
                out.append(np.array(lattice.entries(*t, np.frombuffer(state).tolist()), np.int64).tobytes())
            yield keyed(batch, out, pa.binary(), "m")

    def ids(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AHEAD):
                part, lattice, out = batch.slice(a, AHEAD), _lattice(shared), []
                for t, state, end in zip(texts(part, lattice), part.column("state").to_pylist(), part.column("end").to_pylist()):
                    out.append(np.array(lattice.traced(*t, np.frombuffer(state).tolist(), [int(np.frombuffer(end, np.int64)[0])])[0][0], np.int32))
                yield keyed(part, out, pa.list_(pa.int32()), "ids")

    key = ["doc", "version", "k"]
    starts = _scan(materialize(chunks.mapInArrow(matrices, "doc long, version long, k long, m binary"), "matrices"), True, n).drop("m")
    started = materialize(chunks.join(starts, key), "started")
    ends = _scan(materialize(started.mapInArrow(maps, "doc long, version long, k long, m binary"), "maps"), False, n)
    ends = ends.select(*key, F.col("state").alias("end"))
    traced = started.join(ends, key).mapInArrow(ids, "doc long, version long, k long, ids array<int>")
    return traced.groupBy("doc", "version").agg(F.expr("flatten(transform(sort_array(collect_list(struct(k, ids))), x -> x.ids))").alias("ids"))


def encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, verify: bool = False) -> DataFrame:
    """docs and a column ids: the pieces of column text.

    verify adds a column exact: whether the ids, decoded again, are the very text.
    """
    vocabulary = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a fixed vocabulary
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("exact", T.BooleanType())] * verify
    names = [f.name for f in added]
    plain, called = shielded(docs)
    kept = [k for k, n in enumerate(docs.columns) if n not in names]
    base = plain.select(*[f"c{k}" for k in kept], as_text(called["text"]).alias("text"))
    schema = T.StructType([*base.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), ROWS, BYTES):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                ids, offs = _lattice(shared).encode([t or "" for t in texts])
                null = pa.array([t is None for t in texts]) if None in texts else None
                made = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()), mask=null)]
                if verify:
                    made.append(pa.array([None if t is None else r == t.encode() for t, r in zip(texts, decode_ids(shared.value, ids, offs))], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(f"c{k}") for k in kept), *made], [*(f"c{k}" for k in kept), *names])

    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    short = base.where(~giant).mapInArrow(run, schema)
    # a long document is known by two hashes of its text, so equal ones are encoded once
    key = {"doc": F.xxhash64("text", F.lit(1)), "version": F.xxhash64("text")}
    long = base.where(giant).withColumns(key)
    coded = _encode_giants(long.select("doc", "version", "text").dropDuplicates(["doc", "version"]), shared, chunk, vocabulary.longest)
    long = long.join(coded, ["doc", "version"])
    if verify:
        long = decode(long, path, "decoded").withColumn("exact", F.col("decoded") == F.col("text"))
    return short.unionByName(long.select(*[f"c{k}" for k in kept], *names)).toDF(*[docs.columns[k] for k in kept], *names)


def runs(sizes: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """First and last of neighbouring rows, at most so many and of sizes up to most together; a larger one is alone."""
    total, first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while first < len(sizes):
        last = min(first + rows, max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1))
        yield first, last
        first = last


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """The bytes of each row of ids."""
    flat, starts = vocabulary.table
    parts, ends = [], [np.zeros(1, np.int64)]
    for a in range(0, len(ids), IDS):
        part = ids[a : a + IDS]
        sizes = np.diff(starts)[part]
        total = np.concatenate([[0], np.cumsum(sizes)])
        parts.append(flat[np.repeat(starts[part] - total[:-1], sizes) + np.arange(total[-1])].tobytes())
        ends.append(ends[-1][-1] + total[1:])
    raw, at = b"".join(parts), np.concatenate(ends)[offs].tolist()
    return [raw[a + 1 : b] for a, b in zip(at, at[1:])]  # without the space in front


def decode(coded: DataFrame, path: str = VOCABULARY, out_col: str = "decoded") -> DataFrame:
    """coded and a column out_col: the text of column ids (ids that are no UTF-8 are replaced)."""
    shared = coded.sparkSession.sparkContext.broadcast(load(path))  # a fixed vocabulary
    plain, called = shielded(coded)
    kept = [k for k, n in enumerate(coded.columns) if n != out_col]
    schema = T.StructType([*(plain.schema[k] for k in kept), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(pc.fill_null(pc.list_value_length(batch.column(called["ids"])), 0).to_numpy(zero_copy_only=False), 100, IDS):
                part = batch.slice(a, b - a)
                col = part.column(called["ids"])
                lists = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in col]
                sizes = [0 if x is None else len(x) for x in lists]
                flat = np.concatenate([np.zeros(0, np.int32), *(x for x in lists if x is not None)]).astype(np.int32)
                raw = decode_ids(shared.value, flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                texts = [None if x is None else r.decode("utf-8", "replace") for x, r in zip(lists, raw)]
                yield pa.RecordBatch.from_arrays([*(part.column(f"c{k}") for k in kept), pa.array(texts, pa.string())], [*(f"c{k}" for k in kept), "decoded"])

    return plain.select(*[f"c{k}" for k in kept]).mapInArrow(run, schema).toDF(*[coded.columns[k] for k in kept], out_col)
