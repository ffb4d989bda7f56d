"""LM scoring: a Katz backoff model of order three with Good-Turing discounts.

Words are lower-cased in A-Z; each text ends with one end token, and one start token is the
history of its first. p(w | h) = r*(h w) / c(h) where h w was seen r times, else a(h) p(w | h')
with h' the history without its first word, down to p(w) = r*(w) / N and the mass left over for
all unknown words as one class. r* is Turing's (r + 1) n[r + 1] / n[r] up to ``K`` (absolute
discounts where the counts of counts don't allow it) and r - ``ABOVE`` beyond, so every history
keeps mass back; a(h) = (c(h) - sum of r*) / c(h) / (1 - sum of p(w | h') over w seen after h)
normalises exactly. The first token has no history of two words and is scored by one.

All statistics cover all training documents. Documents are cut into blocks of about
``BLOCK_TOKENS`` tokens, written as a table. Each order is one exchange: a block asks once for
each of its distinct n-grams; a partition, which holds all n-grams of its histories, counts
them and answers with counts and with what the weights of histories need
(their seen n-grams by count, and the sum of the lower order's probabilities). The answers join
the block, whose tokens are then scored order by order, backing off where an n-gram is unseen.
Repeated n-grams are summed in the block before anything is sent; n-grams of a frequent history
are dealt out by word, and its sums, at most ``HOT`` rows an order, are added up by Spark and
broadcast; histories that occur in one block only are worked out there. What is sent are packed
columns, one row for each block and partition.

Defined cases: a null text counts as empty, that is one end token; whole texts are scored,
however long; rows of one doc_id are scored each, with ids of any type or none; a null training flag counts as false; an empty table gives an empty result; without
training documents all tokens are unknown and both scores 0; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import as_text, mix64, own_ids, span_hashes, text_slices, token_spans, with_number
from lectern.sources.files import discard, scratch

ORDER, K, ABOVE = 3, 5, 0.5
BLOCK_TOKENS, PART_TOKENS = 400_000, 1_500_000
#: A history is frequent with more than one in HOT of all tokens, and a sixth of a partition.
HOT = 20_000
#: Shares in which blocks are joined with their answers, and partitions asked, of orders above two.
TURNS, ROUNDS = 4, 1
END = np.uint64(0xE0D)

ASKED = "part long, block long, payload binary"
MADE = "kind string, key long, payload binary, n array<long>, s double"


def pack(*arrays: np.ndarray) -> bytes:
    """Columns as compressed bytes; unsigned ones in the narrowest type, byte by byte of all numbers."""
    slim = [a.astype(np.min_scalar_type(int(a.max()))) if a.dtype.kind == "u" and len(a) else a for a in arrays]
    head = json.dumps([(a.dtype.str, len(a)) for a in slim]).encode()
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in slim]
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(raw))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """A rising column as its differences."""
    return np.diff(a, prepend=0).astype(np.uint64)


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, row numbers) of the tokens of some rows: words in order, then the end."""
    for first, last, data, offs in text_slices(texts):
        starts, ends, row = token_spans(data, offs)
        n = np.bincount(row, minlength=last - first)
        out = np.full(len(starts) + last - first, END)
        out[np.arange(len(starts)) + row] = span_hashes(data, starts, ends)
        yield out, np.repeat(np.arange(first, last), n + 1)


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a column, the first place of each, and each row's number among them."""
    if not len(a):
        return a, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a)
    rising = a[order]
    new = np.concatenate([[True], rising[1:] != rising[:-1]])
    at, back = np.flatnonzero(new), np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return rising[at], np.minimum.reduceat(order, at), back


def ranks(a: np.ndarray) -> np.ndarray:
    """Of each value of a column of different ones, how many are smaller."""
    out = np.empty(len(a), np.int64)
    out[np.argsort(a)] = np.arange(len(a))
    return out


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by whole columns from zero on, the first one first; by one sort if a row's values fit 63 bits."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    code = keys[0].astype(np.int64)
    for k, b in zip(keys[1:], bits[1:]):
        code = code << b | k.astype(np.int64)
    return np.argsort(code)


def discounted(n: list[int]) -> np.ndarray:
    """r* of the counts 1 to K, from n[r], how many types have count r, for r = 1 to K + 1."""
    r = np.arange(1, K + 1)
    n = np.array(n, float)
    if (n > 0).all():
        turing = (r + 1) * n[1:] / n[:-1]
        if ((turing > 0) & (turing < r)).all():
            return turing
    least = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return r - least


def starred(c: np.ndarray, stars: np.ndarray) -> np.ndarray:
    return np.where(c > K, c - ABOVE, np.concatenate([[0], stars])[np.minimum(c, K).astype(np.int64)])


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, K + 2)]


def by_class(group: np.ndarray, c: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each group, how many of its members have count 1 to K, and more."""
    return [np.bincount(group[c == r], minlength=size) for r in range(1, K + 1)] + [np.bincount(group[c > K], minlength=size)]


def log_weight(m: list[np.ndarray], below: np.ndarray, c: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """log10 a(h), from the classes of what was seen after h, the sum of the lower order's probabilities and c(h)."""
    left = sum(k * (r + 1 - stars[r]) for r, k in enumerate(m[:K])) + ABOVE * m[K]
    return np.log10(left / c) - np.log10(np.maximum(1 - below, 1e-300))


class Block:
    """Some documents' tokens, and what is known of their words and n-grams.

    Words and histories have numbers within the block; the start is the number after the last
    word. known[k] = [counts in training documents, in all, ids, log weights of histories] of
    the distinct k-grams, in the order of ``grams``.
    """

    def __init__(self, columns: list[np.ndarray]):
        self.ids, self.train, self.sizes, self.tok, *rest = columns
        self.known = {k + 1: rest[4 * k : 4 * k + 4] for k in range(len(rest) // 4)}
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.tok = self.tok.astype(np.int64)
        self.place = np.arange(len(self.tok)) - np.repeat(np.cumsum(self.sizes.astype(np.int64)) - self.sizes, self.sizes)
        self.flag = self.train.astype(bool)[self.doc]
        self.words = int(self.tok.max()) + 1
        self.number = {1: self.tok}
        self.history, self.word, self.first = {}, {}, {}

    def columns(self) -> list[np.ndarray]:
        return [self.ids, self.train, self.sizes, self.tok.astype(np.uint64), *(x for k in sorted(self.known) for x in self.known[k])]

    def grams(self, order: int) -> None:
        """Number the distinct n-grams up to order: of each its history, word, and first place; number holds each token's."""
        if order in self.number:
            return
        for k in range(2, order + 1):
            at = np.flatnonzero(self.place >= k - 2)
            past = np.where(self.place[at] == 0, self.words, self.tok[at - 1]) if k == 2 else self.number[k - 1][at - 1]
            code, first, back = numbered(past * (self.words + 1) + self.tok[at])
            self.history[k], self.word[k] = np.divmod(code, self.words + 1)
            self.first[k] = at[first]
            self.number[k] = np.full(len(self.tok), -1)
            self.number[k][at] = back

    def own_counts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each k-gram, how often it stands in the block's training documents and in all."""
        n = self.number[k]
        size = self.words if k == 1 else len(self.word[k])
        return np.bincount(n[(n >= 0) & self.flag], minlength=size), np.bincount(n[n >= 0], minlength=size)

    def of_history(self, k: int, column: int, start: int) -> np.ndarray:
        """A column of the (k-1)-grams, as of the histories of k-grams."""
        got = self.known[k - 1][column].astype(np.int64)
        return np.append(got, start) if k == 2 else got

    def request(self, k: int, model: Model, parts: int) -> Request:
        """What to ask of each partition at order k; numbers of k-grams by partition, history and word."""
        self.grams(k)
        out = Request()
        history, word, i = self.history[k], self.word[k], self.first[k]
        out.train, out.all = self.own_counts(k)
        out.c, out.a = self.of_history(k, 0, model.docs), self.of_history(k, 1, model.all_docs)
        here = np.append(self.own_counts(1)[1], len(self.sizes)) if k == 2 else self.own_counts(k - 1)[1]
        out.local = here == out.a
        out.hot = (out.a > model.hot) & ~out.local
        ids = np.append(self.known[1][2].astype(np.int64) + 1, 0) if k == 2 else self.known[k - 1][2].astype(np.int64)
        out.history, out.of_word = ids[history], self.known[1][2].astype(np.int64)[word]
        out.below = self.known[k - 1][0].astype(np.int64)[self.tok[i] if k == 2 else self.number[k - 1][i]]
        if k > 2:
            out.total = self.known[k - 2][0].astype(np.int64)[self.number[k - 2][i - 1]]
        else:
            out.total = np.full(len(word), model.tokens)
        out.asked = np.zeros(len(out.c), bool)  # histories whose weight is needed: something may be unseen after them
        out.asked[history[out.train == 0]] = True
        out.asked &= out.c > 0
        h = mix64(out.history.astype(np.uint64))
        p = (np.where(out.hot[history], mix64(h ^ mix64(out.of_word.astype(np.uint64))), h) % np.uint64(parts)).astype(np.int64)
        sent = np.flatnonzero(~out.local[history])
        # histories and words of the block have different ids, so their ranks sort as these do
        out.order = sent[sorted_by(p[sent], ranks(ids)[history[sent]], ranks(self.known[1][2].astype(np.int64))[word[sent]])]
        out.cuts = np.searchsorted(p[out.order], np.arange(parts + 1))
        return out

    def settle(self, k: int, model: Model, parts: int, answers: dict[int, list[np.ndarray]]) -> None:
        """known[k] from the answers by partition, and from the block itself for histories of its own."""
        r = self.request(k, model, parts)
        stars, below_stars = model.stars[k], model.stars[k - 1]
        c, a, ids, weight = r.train.copy(), r.all.copy(), np.zeros(len(r.all), np.int64), np.zeros(len(r.c))
        for p, (got_c, got_a, got_id, *sums) in answers.items():
            mine = r.order[r.cuts[p] : r.cuts[p + 1]]
            c[mine], a[mine], ids[mine] = got_c, got_a, np.cumsum(got_id) if len(got_id) else 0
            histories = _distinct(self.history[k][mine])
            histories = histories[r.asked[histories] & ~r.hot[histories]]
            weight[histories] = log_weight(sums[:-1], sums[-1], r.c[histories], stars)
        own = np.flatnonzero(r.local[self.history[k]] & (c > 0))
        h = self.history[k][own]
        m, below = by_class(h, c[own], len(r.c)), np.bincount(h, starred(r.below[own], below_stars) / np.maximum(r.total[own], 1), len(r.c))
        mine = np.flatnonzero(r.local & r.asked)
        weight[mine] = log_weight([x[mine] for x in m], below[mine], r.c[mine], stars)
        hot = np.flatnonzero(r.hot & r.asked)
        if len(hot):
            names = np.append(self.known[1][2].astype(np.int64) + 1, 0) if k == 2 else self.known[k - 1][2].astype(np.int64)
            keys, m, below = model.sums[k]
            at = np.searchsorted(keys, names[hot])
            weight[hot] = log_weight([x[at] for x in m], below[at], r.c[hot], stars)
        self.known[k] = [c.astype(np.uint64), a.astype(np.uint64), ids.astype(np.uint64), weight]

    def scores(self, order: int, model: Model) -> pa.Table:
        """Every document's row, its tokens scored order by order."""
        self.grams(order)
        c = self.known[1][0].astype(np.int64)
        n = max(model.tokens, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.log10(np.where(c > 0, starred(c, model.stars[1]) / n, model.unknown))[self.tok]
            for k in range(2, order + 1):
                at = np.flatnonzero(self.number[k] >= 0)
                gram = self.number[k][at]
                seen = self.known[k][0].astype(np.int64)[gram]
                history = self.history[k][gram]
                total = self.of_history(k, 0, model.docs)[history]
                p[at] = np.where(seen > 0, np.log10(starred(seen, model.stars[k])) - np.log10(total), self.known[k][3][history] + p[at])
        if not model.docs:
            p[:] = 0
        base = (np.log10(c + 1) - np.log10(model.tokens + model.types + 1))[self.tok]
        sums = lambda x: np.bincount(self.doc, x, len(self.sizes))
        known = sums(c[self.tok] > 0).astype(np.int64)
        return pa.table({"doc_id": self.ids, "train": self.train.astype(bool), "n_tokens": self.sizes.astype(np.int64), "n_known": known, "train_tokens": np.full(len(self.ids), model.tokens), "base_score": sums(base), "score": sums(p)})


class Request:
    """Columns of a block's k-grams (train, all, history, of_word, below, total) and of their histories (c, a, local, hot, asked)."""


class Model:
    """Numbers that the driver has of the orders worked out so far: stars and sums by order, and the rest of all words."""

    tokens = all_tokens = types = docs = all_docs = 0
    unknown, hot = 1.0, 0

    def __init__(self):
        self.stars: dict[int, np.ndarray] = {}
        self.sums: dict[int, tuple] = {}


def _distinct(a: np.ndarray) -> np.ndarray:
    """The values of a column whose equal ones are neighbours."""
    return a[np.flatnonzero(np.diff(a, prepend=-1))]


def _blocks(docs: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """(kind, key, payload, n): blocks of documents, the words as hashes; n: their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush():
            ids, train, w, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            words, tok = np.unique(w, return_inverse=True)
            payload = pack(ids, train.astype(np.uint8), np.bincount(row, minlength=len(ids)).astype(np.uint64), tok.astype(np.uint64), words)
            return _rows([("b", block, payload, [len(w)], None)]).to_batches()[0]

        for batch in batches:
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            all_train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for w, row in tokens(batch.column("text")):
                a, b = row[0], row[-1] + 1
                held.append((all_ids[a:b], all_train[a:b], w, row - a + sum(len(x[0]) for x in held)))
                size += len(w)
                if size >= most:
                    yield flush()
                    size, block = 0, block + 1
        if held:
            yield flush()

    return docs.select("doc_id", "train", "text").mapInArrow(run, MADE)


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("kind", "key", "payload", "n", "s"), zip(*rows) if rows else [()] * 5, kinds)})


def _ask(blocks: DataFrame, ask, wanted) -> DataFrame:
    """ASKED rows of each block by ask(payload, wanted): pairs (partition, payload) of the partitions wanted; partition None is the block's own counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("key").to_pylist(), batch.column("payload")):
                for p, x in ask(unpack(payload.as_py()), wanted):
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - block if p is None else p]), pa.array([block]), pa.array([x], pa.binary())], ["part", "block", "payload"])

    return blocks.select("key", "payload").mapInArrow(run, ASKED)


def _ask_words(parts: int):
    def ask(columns: list[np.ndarray], wanted):
        *columns, words = columns
        block = Block(columns)
        train, every = block.own_counts(1)
        p = (mix64(words) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        cuts = np.searchsorted(p[order], np.arange(parts + 1))
        for k in filter(wanted, np.flatnonzero(np.diff(cuts)).tolist()):
            mine = order[cuts[k] : cuts[k + 1]]
            yield k, pack(words[mine], train[mine].astype(np.uint64), every[mine].astype(np.uint64))

    return ask


def _answer_words(parts: int):
    """One partition's words: their ids and counts, back to each block; sums over all of them."""

    def run(key, table):
        part = key[0].as_py()
        loads = [unpack(x.as_py()) for x in table["payload"]]
        words, back = np.unique(np.concatenate([x[0] for x in loads]), return_inverse=True)
        c, a = (np.bincount(back, np.concatenate([x[k] for x in loads])).astype(np.uint64) for k in (1, 2))
        ends = np.flatnonzero(words == END)
        rows: list[tuple] = [("n", 0, None, [*counts_of_counts(c), int((c > K).sum()), int((c > 0).sum()), int(c.sum()), int(a.sum()), int(c[ends].sum()), int(a[ends].sum())], None)]
        at = 0
        for block, x in zip(table["block"].to_pylist(), loads):
            mine = back[at : at + len(x[0])]
            at += len(x[0])
            rows.append(("r", block, pack(np.array([part]), c[mine], a[mine], mine.astype(np.uint64)), None, None))
        return _rows(rows)

    return run


def _ask_grams(k: int, model: Model, parts: int, last: bool):
    def ask(columns: list[np.ndarray], wanted):
        block = Block(columns)
        r = block.request(k, model, parts)
        if wanted(0):  # once, whatever the rounds
            yield None, pack(np.array(counts_of_counts(r.train[r.local[block.history[k]]])))
        for p in filter(wanted, np.flatnonzero(np.diff(r.cuts)).tolist()):
            mine = r.order[r.cuts[p] : r.cuts[p + 1]]
            first = np.flatnonzero(np.diff(block.history[k][mine], prepend=-1))
            h = block.history[k][mine[first]]
            flags = (r.asked[h] & ~r.hot[h]) + 2 * r.hot[h].astype(np.uint8)
            many = r.all[mine] * (not last)
            yield p, pack(steps(r.history[mine[first]]), np.diff(np.append(first, len(mine))).astype(np.uint64), r.total[mine[first]].astype(np.uint64), flags.astype(np.uint8), r.of_word[mine].astype(np.uint64), r.train[mine].astype(np.uint64), many.astype(np.uint64), r.below[mine].astype(np.uint64))

    return ask


def _answer_grams(k: int, model: Model, parts: int, last: bool):
    """One partition's k-grams: their counts and ids and the sums of their histories, back to each block."""

    def run(key, table):
        part = key[0].as_py()
        if part < 0:
            return _rows([("n", 0, None, unpack(table["payload"][0].as_py())[0].tolist(), None)])
        loads = [unpack(x.as_py()) for x in table["payload"]]
        sizes = [x[1].astype(np.int64) for x in loads]
        history = np.concatenate([np.repeat(np.cumsum(x[0]).astype(np.int64), n) for x, n in zip(loads, sizes)])
        word = np.concatenate([x[4] for x in loads]).astype(np.int64)
        order = sorted_by(history, word)
        new = np.concatenate([[True], (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
        c, a = (np.bincount(back, np.concatenate([x[f] for x in loads])).astype(np.int64) for f in (5, 6))
        of_type = history[first]
        opens = np.concatenate([[True], np.diff(of_type) != 0])
        group = np.cumsum(opens) - 1
        names = of_type[opens]
        seen = np.flatnonzero(c > 0)
        total = np.concatenate([np.repeat(x[2], n) for x, n in zip(loads, sizes)]).astype(np.int64)[first]
        below = np.concatenate([x[7] for x in loads]).astype(np.int64)[first]
        m = by_class(group[seen], c[seen], len(names))
        lower = np.bincount(group[seen], starred(below[seen], model.stars[k - 1]) / np.maximum(total[seen], 1), len(names))
        rows: list[tuple] = [("n", 0, None, counts_of_counts(c), None)]
        hot, at = set(), 0
        for block, x, n in zip(table["block"].to_pylist(), loads, sizes):
            mine = back[at : at + len(x[4])]
            at += len(x[4])
            of_block = np.cumsum(x[0]).astype(np.int64)
            hot |= set(of_block[x[3] > 1].tolist())
            g = np.searchsorted(names, of_block[x[3] == 1])
            ids = np.zeros(0, np.uint64) if last else steps(mine * parts + part)
            rows.append(("r", block, pack(np.array([part]), c[mine].astype(np.uint64), a[mine].astype(np.uint64) if not last else np.zeros(len(mine), np.uint64), ids, *(x[g].astype(np.uint64) for x in m), lower[g]), None, None))
        for name in sorted(hot):
            g = int(np.searchsorted(names, name))
            rows.append(("s", name, None, [int(x[g]) for x in m], float(lower[g])))
        return _rows(rows)

    return run


def _exchange(blocks: DataFrame, ask, answer, parts: int, label: str, rounds: int = 1) -> tuple[DataFrame, list[str]]:
    """The answers to all blocks, written by kind; one share of the partitions a round, so that less is shuffled at once."""
    spark, paths = blocks.sparkSession, []
    for turn in range(rounds):
        wanted = lambda p, turn=turn: p % rounds == turn
        paths.append(scratch(spark, label))
        _write(_ask(blocks, ask, wanted).repartition(parts, "part").groupBy("part").applyInArrow(answer, MADE), paths[-1])
    return reduce(DataFrame.union, [_read(spark, p) for p in paths]), [f"{p}/kind=r" for p in paths]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, by_kind: bool = True) -> None:
    """Written, by kind; what was shuffled for it goes at once."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy("kind") if by_kind else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MADE).parquet(path).select("kind", "key", "payload", "n", "s")


def _joined(blocks: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """finish(block's columns, its answers by partition) for each block."""

    def run(key, table):
        loads = list(zip(table["kind"].to_pylist(), table["payload"]))
        columns = unpack(next(x for kind, x in loads if kind == "b").as_py())
        got = (unpack(x.as_py()) for kind, x in loads if kind == "r")
        return finish(key[0].as_py(), columns, {int(x[0][0]): x[1:] for x in got})

    both = blocks.where("kind = 'b'").select("kind", "key", "payload").unionByName(answers.where("kind = 'r'").select("kind", "key", "payload"))
    return both.groupBy("key").applyInArrow(run, schema)


def _settled(blocks: DataFrame, answers: DataFrame, finish, label: str, old: list[str], schema: str = MADE) -> tuple[DataFrame, list[str]]:
    """finish of blocks with their answers, some of them at a time, so that less is shuffled at once; what it replaces is deleted."""
    spark, paths = blocks.sparkSession, []
    for turn in range(TURNS):
        mine = lambda df, turn=turn: df.where(F.pmod(F.xxhash64("key"), F.lit(TURNS)) == turn)
        paths.append(scratch(spark, label))
        _write(_joined(mine(blocks), mine(answers), finish, schema), paths[-1], schema == MADE)
    for path in old:
        discard(spark, path)
    read = _read if schema == MADE else lambda spark, path: spark.read.schema(schema).parquet(path)
    return reduce(DataFrame.union, [read(spark, p) for p in paths]), paths


#: Stands for a null id while texts are scored.
NO_ID = -(1 << 63)
RESULT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_at: int | None = None) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    The model learns from the rows where train holds; base_score is the add-one unigram's.
    hot_at: tokens beyond which a history counts as frequent.
    """
    docs = docs.select(F.col(id_col).alias("own"), F.coalesce(train, F.lit(False)).alias("train"), as_text(text_col).alias("text"))
    docs, number, own = with_number(docs, "own")
    out = _scored(docs.select(F.coalesce(number, F.lit(NO_ID)).alias("doc_id"), "train", "text"), order, hot_at)
    return own_ids(out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))), own, "doc_id")


def _scored(docs: DataFrame, order: int, hot_at: int | None) -> DataFrame:
    """The same of (doc_id: long, train, text)."""
    spark = docs.sparkSession
    path = scratch(spark, "katz-blocks")
    _write(_blocks(docs), path)
    blocks, old = _read(spark, path), [path]
    size = blocks.agg(F.coalesce(F.sum(F.col("n")[0]), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], RESULT)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))
    model = Model()
    answers, made = _exchange(blocks, _ask_words(parts), _answer_words(parts), parts, "katz-1")
    n = answers.where("kind = 'n'").agg(*[F.sum(F.col("n")[k]) for k in range(K + 7)]).first()
    model.stars[1] = discounted(n[: K + 1])
    above, model.types, model.tokens, model.all_tokens, model.docs, model.all_docs = n[K + 1 :]
    model.hot = hot_at if hot_at is not None else max(model.all_tokens // HOT, PART_TOKENS // 6)
    if model.tokens:
        model.unknown = (sum(m * (k + 1 - model.stars[1][k]) for k, m in enumerate(n[:K])) + ABOVE * above) / model.tokens

    def words(key: int, columns: list[np.ndarray], got: dict[int, list[np.ndarray]]) -> pa.Table:
        *columns, hashes = columns
        p = (mix64(hashes) % np.uint64(parts)).astype(np.int64)
        known = [np.zeros(len(hashes), np.uint64) for _ in range(3)]
        for part, (c, a, at) in got.items():
            mine = np.flatnonzero(p == part)
            known[0][mine], known[1][mine], known[2][mine] = c, a, at.astype(np.uint64) * np.uint64(parts) + np.uint64(part)
        return _rows([("b", key, pack(*columns, *known, np.zeros(0)), None, None)])

    blocks, old = _settled(blocks, answers, words, "katz-words", [*old, *made])
    for k in range(2, order + 1):
        last = k == order
        answers, made = _exchange(blocks, _ask_grams(k, model, parts, last), _answer_grams(k, model, parts, last), parts, f"katz-{k}", ROUNDS if k > 2 else 1)
        n = answers.where("kind = 'n'").agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(K + 1)]).first()
        model.stars[k] = discounted(n)
        sums = answers.where("kind = 's'").groupBy("key").agg(*[F.sum(F.col("n")[r]) for r in range(K + 1)], F.sum("s")).orderBy("key").collect()  # HOT rows at most
        columns = [np.array(x) for x in zip(*sums)] if sums else [np.zeros(0)] * (K + 3)
        model.sums[k] = (columns[0], columns[1:-1], columns[-1])
        if last:
            return _settled(blocks, answers, _finish(k, model, parts, True), "katz-scores", [*old, *made], RESULT)[0]
        blocks, old = _settled(blocks, answers, _finish(k, model, parts, False), f"katz-{k}-blocks", [*old, *made])
    return _joined(blocks, answers.limit(0), lambda key, columns, got: Block(columns).scores(1, model), RESULT)


def _finish(k: int, model: Model, parts: int, last: bool):
    def finish(key: int, columns: list[np.ndarray], got: dict[int, list[np.ndarray]]) -> pa.Table:
        block = Block(columns)
        block.settle(k, model, parts, got)
        return block.scores(k, model) if last else _rows([("b", key, pack(*block.columns()), None, None)])

    return finish
