"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with white space runs as one space. An item of m characters
may differ by ``m // PER_EDIT`` edits; cut into one piece more than that, at least one piece
stays intact in any such copy. Exact piece hits (Aho-Corasick over the whole text) give
candidate windows, each verified with Myers' bit-parallel edit distance.

The benchmark is searched in blocks of ``BLOCK_CHARS`` characters: only one bounded block
reaches the driver and the tasks at a time, and every block meets all documents.

Defined cases: null texts count as empty and match nothing; whole texts are searched, however
long; items shorter than ``PER_EDIT`` may not differ and count where they stand as whole words;
items without text or id are left out; items of equal text are all reported; of several places
the one of least distance is reported, of equal ones the first; repeated document rows are each
reported and each judged by their own text, with or without an id, of any
type; items without one are left out; empty tables give no matches; ``decontaminate`` keeps all columns whatever their names,
``matches`` ignores other columns.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import as_text, shielded

PER_EDIT, BLOCK_CHARS = 20, 1_000_000

FOUND = "distance int, budget int, start int, end int"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, per_edit: int = PER_EDIT) -> list[tuple[object, str]]:
    """(offset, piece): the item cut into error budget plus one pieces, as even as can be."""
    n = len(item) // per_edit + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        out[c] |= 1 << k
    return dict(out)


def myers(pattern: dict[str, int], m: int, text: str, most: int, anchored: bool = False) -> tuple[int, int]:
    """(least distance of the pattern to a substring of text, its last end); most + 1 if none is near enough.

    anchored: the substring starts where text does.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, min(m, most + 1), 0
    for j, c in enumerate(text, 1):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) | anchored
        mh <<= 1
        pv, mv = ((mh | ~(xv | ph)) & full), ph & xv & full
        if score < best or score == best <= most:
            best, end = score, j
    return best, end


def whole_words(text: str, a: int, b: int) -> bool:
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


class Matcher:
    """The pieces of one block of items."""

    def __init__(self, items: list[tuple[object, str]], per_edit: int):
        self.per_edit = per_edit
        self.items = [(i, t, len(t) // per_edit) for i, t in items]
        self.found: ahocorasick.Automaton | None = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t, _) in enumerate(self.items):
            for at, piece in pieces(t, per_edit):
                where[piece].append((k, at))
        for piece, at in where.items():
            self.found.add_word(piece, (len(piece), at))
        self.masks: dict[int, tuple[dict, dict]] = {}
        if where:
            self.found.make_automaton()
        else:
            self.found = None

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, start, end) of each item's best place in a normalised text."""
        if self.found is None or not text:
            return
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, at) in self.found.iter(text):
            for k, offset in at:
                _, t, budget = self.items[k]
                if not budget and len(t) < self.per_edit and not whole_words(text, end + 1 - size, end + 1):
                    continue
                begin = end + 1 - size - offset
                a, b = max(0, begin - budget), min(len(text), begin + len(t) + budget)
                mine = windows[k]
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(b, mine[-1][1])
                else:
                    mine.append([a, b])
        for k, mine in windows.items():
            item, t, budget = self.items[k]
            if k not in self.masks:
                self.masks[k] = masks(t), masks(t[::-1])
            best = None
            for a, b in mine:
                far, end = myers(self.masks[k][0], len(t), text[a:b], budget)
                if far <= budget and (best is None or far < best[0]):
                    back = text[max(a, a + end - len(t) - far) : a + end][::-1]
                    _, size = myers(self.masks[k][1], len(t), back, far, anchored=True)
                    best = (far, a + end - size, a + end)
            if best:
                yield item, best[0], budget, best[1], best[2]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items (id, normalised text), about block_chars characters at a time, by a hash of their id."""
    plain, called = shielded(benchmark)
    items = plain.select(F.col(called["item_id"]).alias("item_id"), as_text(called["text"]).alias("text")).where("text is not null and item_id is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-chars // block_chars) or 1
    for k in range(parts):
        found = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        yield sorted((r.item_id, t) for r in found if (t := normalise(r.text)))


def _matcher(shared) -> Matcher:
    """One block's matcher, kept for the tasks of a Python worker."""
    if shared.id not in _kept:
        _kept.clear()
        _kept[shared.id] = Matcher(*shared.value)
    return _kept[shared.id]


class _Block:
    """A broadcast block with a name of its own: BLOCK_CHARS characters at most, but for one longer item."""

    def __init__(self, docs: DataFrame, items: list[tuple[object, str]], per_edit: int):
        self.id, self.sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((items, per_edit))

    @property
    def value(self):
        return self.sent.value


_kept: dict[str, Matcher] = {}


def _search(docs: DataFrame, items: list[tuple[object, str]], per_edit: int, item: T.DataType) -> DataFrame:
    shared = _Block(docs, items, per_edit)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item), *T.StructType.fromDDL(FOUND).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            out = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid for m in matcher.matches(normalise(text.as_py()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema.names)

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and item that occurs in it within the item's error budget.

    distance is the least of all places; start and end are the place's offsets in the
    normalised text.
    """
    plain, called = shielded(docs)
    texts = plain.select(F.col(called["doc_id"]).alias("doc_id"), as_text(called["text"]).alias("text"))
    item = benchmark.schema["item_id"].dataType
    return reduce(DataFrame.union, [_search(texts, items, per_edit, item) for items in blocks(benchmark, block_chars)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, per_edit: int = PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in whose text no item occurs; each row is read once and dropped where it is found."""
    out, called = shielded(docs)
    text, schema = called["text"], out.schema
    for items in blocks(benchmark, block_chars):
        shared = _Block(docs, items, per_edit)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                clean = [not x.is_valid or next(matcher.matches(normalise(str(x.as_py()))), None) is None for x in batch.column(text)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns)
