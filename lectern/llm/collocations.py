"""Phrase collocation mining by direct-address tiling.

Words are counted, and the frequent ones get ids by frequency rank. A task turns its texts into
ids and counts pairs of neighbours: ranks (i, j) belong to the tile (i // SIDE, j // SIDE); a tile
with many of the pairs at hand is counted in a dense array with one bincount, a thin one as sorted
coordinates. Tasks send one packed row a tile; these are added up in shares, then all shares by
part of a tile. The frequent pairs are ranked by frequency in turn and take the place of the left
word, so that the same step counts phrases of three words, then of four and five.

Bounds, whatever the input: HELD ids by rank, other words and phrases keep a 62-bit hash as id,
and pairs with such an id are added up as sorted coordinates in TILES buckets by hash; one bit a
frequent phrase in a table of 2**BITS bits tells which ids may be frequent (a clash of bits lets
a rare one be counted too, and its own count then drops it). Both are broadcast, 9 MB a level. A
task holds PAIRS pairs, or one tile's cells, or the distinct pairs of one part of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import U64, materialize, mix64, pair_hash, span_hasher, text_slices

#: Words of the longest phrase; least occurrences of a phrase; phrases returned for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A phrase goes if a longer one around it has this share of its occurrences, in hundredths.
COVER = 100
#: Ids by rank; tables of 2**BITS bits; pairs and words a task holds at most.
HELD, BITS, PAIRS, WORDS = 1 << 16, 26, 1 << 20, 1 << 18
#: Ranks of a tile's side; the tiles of ranked pairs, and as many buckets of other pairs.
SIDE = 1024
TILES, CELLS = (HELD // SIDE) ** 2, SIDE * SIDE
#: Pairs from which a tile is counted densely; parts of a tile, and shares of what tasks found in one, that are added up apart.
DENSE, PARTS, SHARES = CELLS // 16, 4, 16
#: Entries of a packed row; bytes of text that a task turns into ids at once.
ROW, SLICE = 16_384, 1_000_000
_BIT, _MASK = U64(1 << 62), U64((1 << 62) - 1)

_SOFT, _HARD = np.zeros(256, bool), np.zeros(256, bool)
_SOFT[[9, 32]] = True
_HARD[[10, 11, 12, 13, *b".,;:!?"]] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and piece of each word; words of one piece are neighbours in it."""
    hard = _HARD[data]
    word = ~(_SOFT[data] | hard)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:-1]))
    ends = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, row, np.cumsum(hard, dtype=np.int64)[starts] + row


def _word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """62-bit ids of words, by language."""
    return pair_hash(span_hasher(data)(starts, ends), seed) & _MASK | _BIT


def _seeds(langs: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    coded = pc.fill_null(langs, "und").dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.array([xxhash.xxh64_intdigest(x.as_py().encode()) for x in coded.dictionary], U64)
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else known


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans of data as strings, A-Z lower-cased."""
    size = ends - starts
    offs = np.r_[0, np.cumsum(size)]
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(starts, size)
    raw = data[at]
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(raw)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each slice of the texts: bytes, starts, ends, row of the batch, piece and id of each word, and the batch."""
    for batch in batches:
        seeds = _seeds(batch.column(1))
        for first, _, data, offs in text_slices(batch.column(0), SLICE):
            starts, ends, row, piece = tokens(data, offs)
            if len(starts):
                yield data, starts, ends, row + first, piece, _word_ids(data, starts, ends, seeds[row + first]), batch


WORD_ROWS = "lang string, word string, key long, n long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, lang) to word counts; a row without a word has the number of all words of a language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.large_string()), ("key", pa.int64()), ("n", pa.int64())])
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        table = pa.concat_tables(held)
        key, first, back = np.unique(table["key"].to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(back, table["n"].to_numpy(), len(key)).astype(np.int64)  # exact: far below 2**53 in a task
        return pa.table([table["lang"].take(first), table["word"].take(first), pa.array(key), pa.array(n)], schema=schema)

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.set_column(1, "word", table["word"].cast(pa.string()))
        yield from table.to_batches(max_chunksize=50_000)

    for data, starts, ends, row, _, key, batch in _slices(batches):
        langs = pc.fill_null(batch.column(1), "und").cast(pa.string())
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        held.append(pa.table([langs.take(pa.array(row[first])), _words(data, starts[first], ends[first]), pa.array(key.astype(np.int64)), pa.array(n)], schema=schema))
        by = pc.value_counts(langs.take(pa.array(row)))
        held.append(pa.table([by.field(0), pa.nulls(len(by), pa.large_string()), pa.array(-1 - (np.array([xxhash.xxh64_intdigest(x.as_py().encode()) for x in by.field(0)], U64) >> U64(2)).astype(np.int64)), by.field(1)], schema=schema))
        if sum(map(len, held)) > WORDS:
            held = [merged()]
            if len(held[0]) > WORDS // 2:
                yield from out(held.pop())
    if held:
        yield from out(merged())


def added(cell: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of a tile and their sums: many by bincount over the whole tile, few as sorted coordinates."""
    if len(cell) >= DENSE:
        sums = np.bincount(cell, n, CELLS).astype(np.int64)  # exact: sums in a task stay below 2**53
        at = np.flatnonzero(sums)
        return at.astype(np.uint32), sums[at]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    return cell[new], np.diff(np.r_[new, len(cell)]) if n is None else np.add.reduceat(n[order], new) if len(new) else n[order]


def added_pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ids and their sums, as sorted coordinates."""
    if not len(left):
        return left, right, n
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[new], right[new], np.add.reduceat(n[order], new)


#: A tile's counts in a task, in rows of bounded size: cells and their counts; in a bucket, both ids and the counts.
TILE_ROWS = "tile int, share int, part int, a binary, b binary, n binary"
Packed = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]  # tile, part, cells or left ids, right ids, counts


def count_pairs(left: np.ndarray, right: np.ndarray) -> Iterator[Packed]:
    """The pairs of two arrays of ids, counted by tile; pairs with an id beyond the ranks by bucket."""
    ranked = (left < HELD) & (right < HELD)
    a, b = left[ranked].astype(np.uint32), right[ranked].astype(np.uint32)
    tile = (a // SIDE * (HELD // SIDE) + b // SIDE).astype(np.uint16)
    order = np.argsort(tile, kind="stable")  # uint16: a radix sort
    cell = (a % SIDE * SIDE + b % SIDE)[order]
    first = np.r_[0, np.cumsum(np.bincount(tile, minlength=TILES))]
    for t in np.flatnonzero(np.diff(first)):
        yield int(t), 0, *_cells(*added(cell[first[t] : first[t + 1]]))
    left, right, n = added_pairs(left[~ranked], right[~ranked], np.ones(np.count_nonzero(~ranked), np.int64))
    bucket = (pair_hash(left.astype(U64), right.astype(U64)) % U64(TILES)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(bucket, minlength=TILES))]
    for t in np.flatnonzero(np.diff(first)):
        at = order[first[t] : first[t + 1]]
        yield TILES + int(t), 0, left[at], right[at], n[at]


def _cells(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return cell, np.zeros(0, np.int64), n


def _packed(rows: Iterator[tuple[int, Packed]]) -> Iterator[pa.RecordBatch]:
    """Rows of TILE_ROWS, some megabytes at a time."""
    names, held, size = ["tile", "share", "part", "a", "b", "n"], [], 0

    def out():
        columns = list(zip(*held))
        return pa.record_batch([*(pa.array(c, pa.int32()) for c in columns[:3]), *(pa.array(c, pa.binary()) for c in columns[3:])], names)

    for share, (tile, part, a, b, n) in rows:
        wide = a.astype(np.uint32 if tile < TILES else np.int64)
        for k in range(0, len(n), ROW):
            held.append((tile, share, part, wide[k : k + ROW].tobytes(), b[k : k + ROW].tobytes(), n[k : k + ROW].astype(np.int64).tobytes()))
            size += 8 * len(n[k : k + ROW]) + len(held[-1][3])
            if size > 2_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each (tile, part) of rows sorted by them: its sums, added up as the rows come."""
    now, held, size = None, [], 0

    def summed():
        a, b, n = (np.concatenate(x) for x in zip(*held))
        if now[0] < TILES:
            cell, n = added(a, n)
            return cell, b, n
        return added_pairs(a, b, n)

    for batch in batches:
        tile, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for k in range(len(batch)):
            key = (int(tile[k]), int(part[k]))
            if key != now:
                if held:
                    yield *now, *summed()
                now, held, size = key, [], 0
            kinds = (np.uint32 if key[0] < TILES else np.int64, np.int64, np.int64)
            held.append(tuple(np.frombuffer(batch.column(3 + c)[k].as_buffer(), kind) for c, kind in enumerate(kinds)))
            size += len(held[-1][2])
            if size > 4 * PAIRS:
                held = [summed()]
                size = len(held[0][2])
    if held:
        yield *now, *summed()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tasks found in a share of a tile, added up and cut into parts by cell."""

    def rows():
        for tile, _, a, b, n in _unpacked(batches):
            part = (a // (CELLS // PARTS) if tile < TILES else mix64(a.astype(U64)) % U64(PARTS)).astype(np.int64)
            for p in np.unique(part):
                at = part == p
                yield 0, (tile, int(p), a[at], b[at] if tile >= TILES else b, n[at])

    return _packed(rows())


PAIR_ROWS = "left long, right long, n long"


def _frequent(least: int):
    """The sums of parts of tiles to the pairs with a count of least and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, _, a, b, n in _unpacked(batches):
            at = np.flatnonzero(n >= least)
            if not len(at):
                continue
            left, right = a[at].astype(np.int64), b[at] if tile >= TILES else None
            if tile < TILES:
                left, right = tile // (HELD // SIDE) * SIDE + left // SIDE, tile % (HELD // SIDE) * SIDE + left % SIDE
            yield pa.record_batch([pa.array(left), pa.array(right), pa.array(n[at])], ["left", "right", "n"])

    return run


def frequent_pairs(tiles: DataFrame, least: int) -> DataFrame:
    """(left, right, n) of rows of TILE_ROWS: first shares of a tile are added up, then the parts of all shares."""
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = tiles.repartition(parts, "tile", "share").sortWithinPartitions("tile", "share").mapInArrow(_merged, TILE_ROWS)
    return merged.repartition(parts, "tile", "part").sortWithinPartitions("tile", "part").mapInArrow(_frequent(least), PAIR_ROWS)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The 62-bit key of the phrase that a phrase id and a word id make."""
    return pair_hash(left.astype(U64), right.astype(U64)) & _MASK | _BIT


class Level:
    """Which phrases of one length may be frequent, and the ids of the most frequent ones."""

    def __init__(self, bits: np.ndarray, key: np.ndarray, rank: np.ndarray):
        self.bits, self.key, self.rank = bits, key, rank

    def may(self, key: np.ndarray) -> np.ndarray:
        at = key & U64((1 << BITS) - 1)
        return (self.bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)

    def ids(self, key: np.ndarray) -> np.ndarray:
        """Ranks where a key has one, else the key."""
        if not len(self.key):
            return key.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], key.astype(np.int64))


def level_of(frequent: DataFrame) -> Level:
    """The level of a table with the columns key and n; what reaches the driver is bounded by BITS and HELD."""
    spot = F.col("key").bitwiseAND((1 << BITS) - 1)
    one = F.expr("shiftleft(1L, cast(key & 63 as int))")
    words = frequent.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), U64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().view(U64)
    top = frequent.select("key", "n").orderBy(F.desc("n"), "key").limit(HELD).toArrow()["key"].to_numpy().astype(U64)
    order = np.argsort(top)
    return Level(bits, top[order], order.astype(np.int64))


def _counted(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs counted a bounded number at a time, as rows of TILE_ROWS."""

    def rows():
        held, size, share = [], 0, TaskContext.get().partitionId()
        for pair in pairs:
            held.append(pair)
            size += len(pair[0])
            if size > PAIRS:
                yield from ((share % SHARES, x) for x in count_pairs(*(np.concatenate(x) for x in zip(*held))))
                held, size, share = [], 0, share + 1
        if held:
            yield from ((share % SHARES, x) for x in count_pairs(*(np.concatenate(x) for x in zip(*held))))

    return _packed(rows())


def _pairs_of_texts(shared):
    """Rows of (text, lang) to the counts of pairs of words that may be frequent."""

    def pairs(batches):
        words = shared.value
        for _, _, _, _, piece, key, _ in _slices(batches):
            good = words.may(key)
            at = np.flatnonzero(good[:-1] & good[1:] & (piece[1:] == piece[:-1]))
            ids = np.full(len(key), -1, np.int64)
            ids[good] = words.ids(key[good])
            yield ids[at], ids[at + 1]

    return lambda batches: _counted(pairs(batches))


def _runs_of_texts(shared, shared_pairs):
    """Rows of (text, lang) to the stretches of three words and more whose pairs may all be frequent, each ended by -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = shared.value, shared_pairs.value
        for _, _, _, _, piece, key, _ in _slices(batches):
            if len(key) < 3:
                continue
            good = words.may(key)
            ids = np.full(len(key), -1, np.int64)
            ids[good] = words.ids(key[good])
            pair = (piece[1:] == piece[:-1]) & good[:-1] & good[1:]
            at = np.flatnonzero(pair)
            pair[at] = level.may(joined(ids[at], ids[at + 1]))
            three = pair[:-1] & pair[1:]
            keep = np.zeros(len(key), bool)
            for k in range(3):
                keep[k : k + len(three)] |= three
            last = keep & ~np.r_[pair, False]  # the word that ends a stretch
            n = keep.astype(np.int64) + last
            out = np.full(n.sum(), -1, np.int64)
            out[(np.cumsum(n) - n)[keep]] = ids[keep]
            if len(out):
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["ids"])

    return run


def _pairs_of_runs(levels):
    """Rows of stretches to the counts of (phrase of levels + 1 words, word) that may be frequent."""

    def pairs(batches):
        known = [x.value for x in levels]
        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_buffer(), np.int64)
                left, good = ids, ids >= 0
                for level in known:  # to phrases of one word more
                    if len(left) < 2:
                        break
                    right = ids[len(ids) - len(left) + 1 :]
                    key = joined(left[:-1], right)
                    good = good[:-1] & good[1:] & (right >= 0)
                    good[good] = level.may(key[good])
                    left = level.ids(key)
                at = np.flatnonzero(good[:-1] & good[1:])
                yield left[at], ids[len(ids) - len(left) + 1 :][at]

    return lambda batches: _counted(pairs(batches))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = joined(batch.column(0).to_numpy(), batch.column(1).to_numpy()).astype(np.int64)
        yield pa.record_batch([*batch.columns, pa.array(key)], ["left", "right", "n", "key"])


def _with_ids(frequent: DataFrame, shared) -> DataFrame:
    """A table of frequent phrases with the column id: rank or key."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("key")
            yield batch.append_column("id", pa.array(shared.value.ids(batch.column(at).to_numpy().astype(U64))))

    return frequent.mapInArrow(run, StructType([*frequent.schema.fields, StructField("id", LongType())]))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, n) of all phrases up to longest words with n >= least, and (lang, n) of all words.

    Each level is written to the shared folder; jobs run while this is called.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    counts = rows.mapInArrow(count_words, WORD_ROWS).groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    words = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), "key", "n")
    shared = [context.broadcast(level_of(words))]
    word_ids = _with_ids(words, shared[0])
    found, shorter, stretches = [words.withColumn("n_words", F.lit(1))], word_ids, None
    for size in range(2, longest + 1):
        if size == 2:
            tiles = rows.mapInArrow(_pairs_of_texts(shared[0]), TILE_ROWS)
        else:
            if size == 3:
                stretches = materialize(rows.mapInArrow(_runs_of_texts(*shared), "ids binary"), "stretches")
            tiles = stretches.mapInArrow(_pairs_of_runs(shared[1:]), TILE_ROWS)
        pairs = frequent_pairs(tiles, least).mapInArrow(_keyed, PAIR_ROWS + ", key long")
        head = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        tail = word_ids.select(F.col("id").alias("right"), F.col("phrase").alias("tail"))
        named = pairs.join(head, "left").join(tail, "right")
        level = materialize(named.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "key", "n"), f"phrases-{size}")
        found.append(level.withColumn("n_words", F.lit(size)))
        if size < longest:
            shared.append(context.broadcast(level_of(level)))
            if not shared[-1].value.bits.any():
                break
            shorter = _with_ids(level, shared[-1])
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases.drop("key"), counts.where("word is null").select("lang", "n")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's most cohesive phrases.

    A-Z are lower-cased, texts are cut at ``.,;:!?`` and line breaks into pieces and those at
    blanks and tabs into words. Phrases of 2 to longest words that occur a >= least times within
    pieces are candidates; cut after k words into parts that occur l and r times they score
    floor(1000 * a * n / (l * r)), n being all words of the language, and the lowest-scoring cut
    counts (ties: the smallest k). A candidate goes if a longer one holds its words and has at
    least cover hundredths of its occurrences. The first ``top`` of a language stay, by score,
    then a (both falling), then phrase.

    Defined cases: null texts are empty; a null language is ``und``; empty tables, and languages
    without candidates, give no rows; repeated rows count each time; texts and words of any
    length are read whole; other columns, whatever their names, are not looked at. Words and
    phrases are told apart by 62-bit hashes while they are counted.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names).select(F.col(names[docs.columns.index(text)]).alias("text"), F.col(names[docs.columns.index(lang)]).alias("lang"))
    phrases, totals = frequent_phrases(plain, "text", "lang", longest, least)
    candidates = phrases.where("n_words > 1").withColumn("words", F.split("phrase", " ", -1))
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    cut = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))
    said = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.select("lang", "phrase", "n_words", F.col("n").alias("a"), "words", cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", said(F.lit(1), F.col("k")).alias("first"), said(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "times": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(34,0))) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    scored = cuts.withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    spans = candidates.where("n_words > 2").select("lang", "n", "words", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    spans = spans.select("lang", "n", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("start"))
    around = spans.groupBy("lang", said(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where((F.coalesce("longer", F.lit(0)).cast("decimal(19,0)") * 100 < wide("a") * cover))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # a language's first ones are among its shares' first ones
    kept = kept.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""WITH pieces AS (SELECT lang, doc_id, generate_subscripts(p, 1) AS piece, unnest(p) AS said
    FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]') AS p FROM documents) d),
parted AS (SELECT lang, list_filter(regexp_split_to_array(said, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, s AS n_words
    FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM parted, (SELECT unnest(range(1, 6)) AS s) z WHERE len(w) >= s) e),
f AS (SELECT lang, phrase, n_words, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM parted GROUP BY lang),
c AS (SELECT lang, phrase, n_words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE n_words > 1),
cut AS (SELECT c.*, k FROM c, (SELECT unnest(range(1, 5)) AS k) z WHERE k < n_words),
scored AS (SELECT cut.lang, cut.phrase, cut.w, cut.a, x.n AS l, y.n AS r, total.n, k, ((1000::HUGEINT * cut.a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1:], ' ') JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, a, w, s, unnest(range(1, n_words - s + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS s) z WHERE s < n_words) e),
longer AS (SELECT lang, phrase, max(a) AS m FROM spans GROUP BY ALL),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
    FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE coalesce(100 * g.m, 0) < 100 * b.a)
SELECT * FROM ranked WHERE rank <= 2000"""
