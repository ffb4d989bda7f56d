"""SimHash near-duplicates: 64-bit fingerprints of word shingles, searched with BK-trees.

Fingerprints within ``radius`` bits agree on at least ``agree`` of ``radius + agree`` blocks of
bits, so all links lie inside groups of one value of ``agree`` blocks; ``agree`` grows with the
number of fingerprints, so that groups stay small whatever the input. Each group is cut into shards of bounded size;
a shard becomes a BK-tree (children keyed by their Hamming distance to the parent) that is
sent to a bounded block of the group's fingerprints, which follow only edges within the
radius. A cell returns a spanning forest of its links, never the pairs.

Defined cases: a null text counts as empty; no words give fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of all words; whole texts are read, however
long; equal fingerprints are one tree node, so copies cost nothing; a bit that is set in just
half the shingles is 0; an empty table gives an empty result; ids are of any type with an order;
rows whose id is null link nothing: ``near_duplicates`` gives them the class of their fingerprint
if another row has one, ``similar_groups`` leaves them out, ``keep_one`` keeps them, and keeps all columns whatever their names; the others ignore
further columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_text, connected_components, materialize, mix64, own_ids, shielded, text_slices, with_number

#: Fingerprints in a shard's tree, and in the block of queries that meets it.
SHARD = 8192
#: Values that one node of a tree holds at most.
LEAF = 64
#: Rows (a fingerprint in a band) that are dealt out at once, about, and bands at least; what a round shuffles goes before the next begins.
ROUND, LEAST = 1 << 26, 8
#: Pairs of texts whose shingles are sent at once, about.
PAIRS = 1 << 20
#: Smaller partners that a fingerprint names at once in a cell; where one has more, the cell is gone through again.
FEW = 8
#: For verified similarity: bits a candidate may differ by, and independent fingerprints. At a
#: similarity of 0.8, 0.85 and 0.9 these make 97, 99.9 and 99.99 % of pairs candidates.
RADIUS, TABLES = 7, 14


#: The bits of each byte, as eight counters of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _votes(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the n hashes from each first on have each of their 64 bits set, from the highest on."""
    parts = -(-n // 255)  # counters of a byte hold that many
    begin = np.cumsum(parts) - parts
    starts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(begin, parts))
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.add.reduceat(_LANES[raw[:, k]], starts) for k in range(8)], axis=1)
    return np.add.reduceat(counts.view(np.uint8).reshape(-1, 64), begin, axis=0, dtype=np.int32)


def _fingerprint(texts: pa.Array, shingle: int, tables: int = 1) -> np.ndarray:
    """One column a table; those after the first vote with the same hashes, mixed anew."""
    out = np.zeros((len(texts), tables), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, last, data, offs in text_slices(texts, 1_000_000):
        raw, hashes, sizes = data.tobytes(), [], []
        for a, b in zip(offs[:-1], offs[1:]):
            words = raw[a:b].lower().split()
            n, joined = len(words), b" ".join(words)
            if n <= shingle:
                hashes.extend([digest(joined, 42)] if n else [])
            else:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
                hashes.extend([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())])
            sizes.append(max(n - shingle + 1, 1) if n else 0)
        n = np.array(sizes, np.int64)
        some = np.flatnonzero(n)
        if len(some):
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            h = np.array(hashes, np.uint64)
            for k in range(tables):
                votes = _votes(mix64(h + np.uint64(k)) if k else h, at[some], n[some])
                out[first + some, k] = np.packbits(2 * votes > n[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", tables: int | None = None) -> DataFrame:
    """(id, fingerprint): one row for each row of docs; with several tables (id, fingerprint_0, …)."""
    names = ["fingerprint"] if tables is None else [f"fingerprint_{k}" for k in range(tables)]
    tables = tables or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _fingerprint(batch.column(1), shingle, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(tables))], ["id", *names])

    plain, called = shielded(docs)
    rows = plain.select(F.col(called[id_col]).cast("long").alias("id"), as_text(called[text_col]).alias("text"))
    return rows.mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in names)]))


class BKTree:
    """Distinct 64-bit values; each child hangs below its parent at their Hamming distance.

    A child with LEAF values or fewer below it holds them together.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.children, self.leaves = values, {}, {}
        stack = [np.arange(len(values))] if len(values) else []
        while stack:
            here = stack.pop()
            if len(here) <= LEAF:
                self.leaves[int(here[0])] = here
                continue
            root, rest = int(here[0]), here[1:]
            below = {}
            if len(rest):
                far = np.bitwise_count(values[rest] ^ values[root])
                order = np.argsort(far, kind="stable")
                rest, far = rest[order], far[order]
                cuts = np.flatnonzero(np.diff(far)) + 1
                for part, edge in zip(np.split(rest, cuts), far[np.concatenate([[0], cuts])].tolist()):
                    below[edge] = int(part[0])
                    stack.append(part)
            self.children[root] = below

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indices of the queries at most radius away), walking only edges that can hold such."""
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, asking = stack.pop()
            if node in self.leaves:
                leaf = self.leaves[node]
                near = np.bitwise_count(queries[asking] ^ self.values[leaf][:, None]) <= radius
                for k in np.flatnonzero(near.any(1)):
                    yield int(leaf[k]), asking[near[k]]
                continue
            far = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int16)
            near = asking[far <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                left = asking[np.abs(far - edge) <= radius]
                if len(left):
                    stack.append((child, left))


def _forest(tree_ids, tree_values, query_ids, query_values, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the tree's matches connect: each id with the smallest of its class."""
    ids, at = np.unique(np.concatenate([tree_ids, query_ids]), return_inverse=True)
    of_tree, of_query = at[: len(tree_ids)], at[len(tree_ids) :]
    parent = np.arange(len(ids))

    def roots(x):
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    for node, near in BKTree(tree_values).within(query_values, radius):
        found = roots(np.concatenate([[of_tree[node]], of_query[near]]))
        parent[found] = found.min()
    top = roots(np.arange(len(ids)))
    moved = np.flatnonzero(top != np.arange(len(ids)))
    return list(zip(ids[moved].tolist(), ids[top[moved]].tolist()))


def _neighbours(tree_ids, tree_values, query_ids, query_values, radius: int, tree_many, query_many) -> tuple[list[tuple[int, int]], bool]:
    """(id, smaller id) of each query's matches of smaller ids, if more than FEW the nearest and the first only, and the same seen from the tree.

    And whether the cell holds pairs of documents beyond these: matches left out, or of fingerprints that many documents have.
    """
    out, rest = set(), False
    for ids, values, many, others, other_values, other_many in ((query_ids, query_values, query_many, tree_ids, tree_values, tree_many), (tree_ids, tree_values, tree_many, query_ids, query_values, query_many))[: 1 if tree_ids is query_ids else 2]:
        nearest = np.full(len(ids), np.iinfo(np.int64).max)
        first = np.full(len(ids), np.iinfo(np.int64).max)
        far = np.full(len(ids), 65)
        n = np.zeros(len(ids), np.int64)
        tree = BKTree(other_values)
        for node, near in tree.within(values, radius):
            there = others[node]
            near = near[ids[near] > there]
            rest |= bool(len(near) and (other_many[node] or many[near].any()))
            gap = np.bitwise_count(values[near] ^ other_values[node]).astype(np.int64)
            better = (gap < far[near]) | ((gap == far[near]) & (there < nearest[near]))
            nearest[near[better]], far[near[better]] = there, gap[better]
            first[near] = np.minimum(first[near], there)
            n[near] += 1
        got = far < 65
        out |= set(zip(ids[got].tolist(), nearest[got].tolist())) | set(zip(ids[got].tolist(), first[got].tolist()))
        left = n > 1 + (nearest != first)
        rest |= bool((n[left] > FEW).any())
        asking = np.flatnonzero(left & (n <= FEW))
        for node, near in tree.within(values[asking], radius) if len(asking) else ():
            near = asking[near]
            out |= {(i, int(others[node])) for i in ids[near[ids[near] > others[node]]].tolist()}
    return sorted(out), rest


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each cell of rows sorted by band, value, i and j, whatever the batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(4))
        same = _tail(batch, key)
        head, tail = batch.slice(0, same), batch.slice(same)
        if kept and (head.num_rows or tuple(kept[0].column(c)[0].as_py() for c in range(4)) != key):
            yield from _cut(pa.Table.from_batches([*kept, head]))
            kept = []
        elif head.num_rows:
            yield from _cut(pa.Table.from_batches([head]))
        kept.append(tail)
    if kept:
        yield from _cut(pa.Table.from_batches(kept))


def _cut(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    columns = {c: table[c].to_numpy(zero_copy_only=False) for c in table.column_names}
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in ("band", "value", "i", "j"):
        new |= np.diff(columns[c]) != 0
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            yield {c: x[a:b] for c, x in columns.items()}


def _cells(batches: Iterator[pa.RecordBatch], radius: int, join=_forest) -> Iterator[pa.RecordBatch]:
    """(a, b, rest); a cell has about SHARD tree rows and SHARD queries at most. rest: a is a band and b a value with more pairs than are named."""
    found: list[tuple[int, int, bool]] = []
    for cell in _by_cell(batches):
        ids, fps, many, t = cell["id"], cell["fingerprint"].view(np.uint64), cell["many"], cell["tree"]
        extra = join is _neighbours
        if cell["i"][0] == cell["j"][0]:
            got = join(ids, fps, ids, fps, radius, *((many, many) if extra else ()))
        else:
            got = join(ids[t], fps[t], ids[~t], fps[~t], radius, *((many[t], many[~t]) if extra else ()))
        pairs, rest = got if extra else (got, False)
        found += [(*p, False) for p in pairs]
        if rest:
            found.append((int(cell["band"][0]), int(cell["value"][0]), True))
        if len(found) > 100_000:
            yield _links(found)
            found = []
    if found:
        yield _links(found)


def _unlike(batches: Iterator[pa.RecordBatch], radius: int, edges: list[int], agree: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of all pairs of a cell within radius whose classes differ, in the first band only that both share, block by block."""
    bands = list(combinations(range(len(edges) - 1), agree))
    mask = [np.uint64((1 << edges[k + 1]) - (1 << edges[k])) for k in range(len(edges) - 1)]
    for cell in _by_cell(batches):
        blocks = bands[cell["band"][0] % len(bands)]
        differ = [mask[k] for k in range(blocks[-1]) if k not in blocks]
        ids, fps, of, t = cell["id"], cell["fingerprint"].view(np.uint64), cell["class"], cell["tree"]
        names, n = np.unique(of, return_counts=True)
        common = of == names[n.argmax()]
        here = cell["i"][0] == cell["j"][0]
        mine, others = (np.arange(len(ids)),) * 2 if here else (np.flatnonzero(t), np.flatnonzero(~t))
        # the most common class meets the others only
        for x, y in ((mine[~common[mine]], others), (mine[common[mine]], others[~common[others]]))[: 1 if here else 2]:
            for at in range(0, len(x) if len(y) else 0, 256):
                k = x[at : at + 256]
                gap = fps[k, None] ^ fps[y][None]
                near = (np.bitwise_count(gap) <= radius) & (of[k, None] != of[y][None])
                for m in differ:
                    near &= (gap & m) != 0
                if here:
                    near &= (ids[k, None] > ids[y][None]) | (common[k, None] != common[y][None])
                p, q = np.nonzero(near)
                if len(p):
                    a, b = ids[k[p]], ids[y[q]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _tail(batch: pa.RecordBatch, key: tuple) -> int:
    """Where the last cell of a sorted batch begins."""
    other = np.zeros(batch.num_rows, bool)
    for c, k in enumerate(key):
        other |= batch.column(c).to_numpy() != k
    found = np.flatnonzero(other)
    return int(found[-1]) + 1 if len(found) else 0


def _links(links: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, rest = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(rest)], ["a", "b", "rest"])


def _blocks(radius: int, size: int, shard: int) -> tuple[int, list[int]]:
    """On how many blocks of bits values must agree, and the blocks' edges."""
    for agree in range(1, 5):
        if size >> (64 * agree // (radius + agree)) <= shard // 4:
            break
    return agree, [64 * k // (radius + agree) for k in range(radius + agree + 1)]


def block_keys(radius: int, size: int, shard: int = SHARD) -> list[Column]:
    """Keys of column fingerprint, one or more of which any two values within radius bits share; finer for more values."""
    agree, edges = _blocks(radius, size, shard)
    keys = []
    for blocks in combinations(range(radius + agree), agree):
        key = F.lit(0).cast("long")
        for k in blocks:
            width = edges[k + 1] - edges[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fingerprint", edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def _dealt(nodes: DataFrame, radius: int, shard: int, size: int, *more: str, only: range | None = None) -> DataFrame:
    """Each node with each band (of only) and its value there; bands of tables follow each other."""
    bands = block_keys(radius, size, shard)
    only = only or range(len(bands))
    table = F.col("table") if "table" in nodes.columns else F.lit(0)
    dealt = nodes.select("id", "fingerprint", *more, table.alias("t"), F.posexplode(F.array(*[bands[k] for k in only])).alias("band", "value"))
    return dealt.withColumn("band", F.col("band") + only.start + F.col("t") * len(bands)).drop("t")


def _rounds(size: int, bands: int, tables: int) -> list[tuple[range, range]]:
    """Tables and bands that are dealt out at once: several tables, or some bands of one."""
    most = max(ROUND // max(size, 1), LEAST)
    if most >= bands:
        return [(range(t, min(t + most // bands, tables)), range(bands)) for t in range(0, tables, most // bands)]
    parts = -(-bands // most)
    return [(range(t, t + 1), range(bands * k // parts, bands * (k + 1) // parts)) for t in range(tables) for k in range(parts)]


def _sharded(dealt: DataFrame, shard: int, by: str, *more: str) -> DataFrame:
    """The rows of groups (band, value) of more than one, by cells of a shard's tree and a shard's queries."""
    sizes = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
    # after an explode Spark takes both sides for small
    own = dealt.join(sizes.hint("merge"), ["band", "value"]).withColumn("s", F.pmod(F.xxhash64(by), "shards").cast("int"))
    cells = own.select("band", "value", "id", "fingerprint", *more, F.explode(F.expr("""
        concat(array(struct(s as i, s as j, true as tree)),
               transform(filter(sequence(0, shards - 1), x -> x > s), x -> struct(s as i, x as j, false as tree)),
               transform(filter(sequence(0, shards - 1), x -> x < s), x -> struct(x as i, s as j, true as tree)))""")).alias("c"))
    cells = cells.select("band", "value", "c.i", "c.j", "c.tree", "id", "fingerprint", *more)
    return cells.repartition("band", "value", "i", "j").sortWithinPartitions("band", "value", "i", "j")


def links(nodes: DataFrame, radius: int = 4, shard: int = SHARD, join=_forest, size: int = 0, only: range | None = None) -> DataFrame:
    """(a, b, rest): links that connect distinct fingerprints (id, fingerprint) as all links within radius would.

    nodes may have a column table; fingerprints of different tables never meet. size: about how
    many fingerprints a table has. only: the bands of a table that are dealt out, all by default. join: what a cell returns. With _neighbours rows without rest are
    links of each id to smaller ids instead of a forest, and those with rest are the groups (band a,
    value b) that hold pairs beyond these; a column many tells which fingerprints stand for several documents.
    """
    nodes = nodes if "many" in nodes.columns else nodes.withColumn("many", F.lit(False))
    cells = _sharded(_dealt(nodes, radius, shard, size, "many", only=only), shard, "fingerprint", "many")
    return cells.mapInArrow(lambda batches: _cells(batches, radius, join), "a long, b long, rest boolean")


def unlike(nodes: DataFrame, groups: DataFrame | None, radius: int = 4, shard: int = SHARD, size: int = 0, only: range | None = None) -> DataFrame:
    """(a, b): all pairs of nodes (id, fingerprint, class) within radius whose classes differ, each once a table, a the larger id.

    groups: only pairs whose first common group is one of these (band, value). only: the bands of a table that are dealt out,
    all by default; each pair comes in one band. nodes may have a column table.
    """
    agree, edges = _blocks(radius, size, shard)
    dealt = _dealt(nodes, radius, shard, size, "class", only=only)
    dealt = dealt if groups is None else dealt.join(groups.distinct().hint("merge"), ["band", "value"], "left_semi")
    return _sharded(dealt, shard, "id", "class").mapInArrow(lambda batches: _unlike(batches, radius, edges, agree), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id that links reach, itself included."""
    plain, called = shielded(docs)
    plain, number, own = with_number(plain, called[id_col])
    prints = materialize(fingerprints(plain.select(number.alias("id"), as_text(called[text_col]).alias("text")), shingle, "id", "text"), "simhash")
    nodes = prints.where("id is not null").groupBy("fingerprint").agg(F.min("id").alias("id"))
    found = connected_components(links(nodes, radius, size=prints.count()), "simhash-links").withColumnRenamed("node", "first")
    classes = nodes.withColumnRenamed("id", "first").join(found, "first", "left")
    out = prints.join(classes, "fingerprint", "left").select("id", "fingerprint", F.coalesce("component", "first").alias("component_id"))
    return own_ids(out, own, "id", "component_id")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().lower().split()
                grams = {xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) - (1 << 63) for k in range(max(len(words) - shingle, 0) + 1)} if words else set()
                out.append(list(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def similar_groups(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, similarity: float = 0.8, tables: int = TABLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id) of the documents whose group holds more than one: verified near duplicates.

    Equal texts are linked by their hash, and only the smallest id of each text goes on. Texts
    within ``radius`` bits in one of ``tables`` independent fingerprints are candidates; a link holds
    if the Jaccard similarity of the shingle sets reaches ``similarity``, and groups are what all
    links of candidates connect. A document is first compared with the first of its
    fingerprint and with up to ``FEW`` smaller ids, or the nearest and the first, in each BK-tree cell. Cells that
    hold more candidates are then gone through again, and all of these that are not yet in one
    group are compared. Texts without words are alike. Rows of one id are one document.
    """
    plain, called = shielded(docs)
    plain, number, own = with_number(plain, called[id_col])
    base = plain.select(number.alias("id"), as_text(called[text_col]).alias("text")).where("id is not null")
    versions = base.groupBy("id").agg(F.min(F.xxhash64("text")).alias("version"))
    prints = fingerprints(base, shingle, "id", tables=tables).groupBy("id").agg(F.min(F.struct(*[f"fingerprint_{k}" for k in range(tables)])).alias("p"))
    prints = materialize(prints.join(versions, "id").select("id", "version", "p.*"), "simhash")
    names = [f"fingerprint_{k}" for k in range(tables)]
    texts = prints.groupBy("version").agg(F.min(F.struct("id", *names)).alias("f"), F.count("*").alias("n"))
    texts = materialize(texts.select("version", "f.*", "n"), "simhash-texts")
    copies = prints.join(texts.where("n > 1").select("version", F.col("id").alias("b")), "version").where("id <> b").select(F.col("id").alias("a"), "b")
    size = prints.count()
    bands = len(block_keys(radius, size))
    of = lambda df, tables, *more: df.select("id", *more, F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col(names[t]).alias("fingerprint")) for t in tables])).alias("p")).select("id", *more, "p.*")
    rounds, near = _rounds(size, bands, tables), []
    for some, only in rounds:
        mine = of(texts, some)
        nodes = mine.groupBy("table", "fingerprint").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        got = links(nodes.select("table", "id", "fingerprint", (F.col("n") > 1).alias("many")), radius, join=_neighbours, size=size, only=only)
        if only.start == 0:
            first = nodes.where("n > 1").select("table", "fingerprint", F.col("id").alias("b")).hint("merge")
            got = got.unionByName(mine.join(first, ["table", "fingerprint"]).where("id <> b").select(F.col("id").alias("a"), "b", F.lit(False).alias("rest")))
            # fingerprints that three texts or more share hold pairs beyond these, in their first band
            got = got.unionByName(_dealt(nodes.where("n > 2"), radius, SHARD, size, only=range(1)).select(F.col("band").cast("long").alias("a"), F.col("value").alias("b"), F.lit(True).alias("rest")))
        near.append(materialize(got, "simhash-cells"))
    asked = materialize(_union(near).where("not rest").select("a", "b").distinct(), "simhash-links")
    found = connected_components(copies.union(_similar(base, asked, shingle, similarity)), "near-duplicates")
    # what is left: pairs of cells that hold more
    classed = texts.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", *names, F.coalesce("component", "id").alias("class"))
    classed, left = materialize(classed, "simhash-classes"), []
    groups = _union(near).where("rest").select(F.col("a").cast("int").alias("band"), F.col("b").alias("value"))
    groups = materialize(groups.distinct(), "simhash-groups")
    full = {r.band for r in groups.select("band").distinct().collect()}  # some hundred at most
    for some, only in rounds:
        here = [t * bands + k for t in some for k in only if t * bands + k in full]
        if here:
            left.append(materialize(unlike(of(classed, some, "class"), groups.where(F.col("band").isin(here)), radius, size=size, only=only), "simhash-rest"))
    left = materialize(_union(left).distinct(), "simhash-rest") if left else None
    if left is not None and left.limit(1).count():
        held = _similar(base, left, shingle, similarity)
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(held), "near-duplicates")
    return own_ids(found.select(F.col("node").alias("id"), F.col("component").alias("group_id")), own, "id", "group_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _similar(base: DataFrame, asked: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' shingle sets have the similarity; about PAIRS of them at once."""
    n = asked.count()
    ends = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct().hint("merge" if n > PAIRS // 16 else "broadcast")
    sets = materialize(_shingle_sets(base.join(ends, "id", "left_semi").dropDuplicates(["id"]), shingle), "shingles")

    def compared(asked: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(c)).hint("merge") for k, c in (("a", "x"), ("b", "y")))
        both = asked.join(x, "a").join(y, "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(((F.size("x") == 0) & (F.size("y") == 0)) | (common >= similarity * (F.size("x") + F.size("y") - common))).select("a", "b")

    parts = -(-n // PAIRS)
    if parts <= 1:
        return compared(asked)
    return _union([materialize(compared(asked.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k)), "similar") for k in range(parts)])


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, similarity: float = 0.8, tables: int = TABLES) -> DataFrame:
    """docs with only the smallest doc_id of each group of near duplicates; rows without an id stay."""
    plain, called = shielded(docs)
    columns = plain.columns
    plain, doc_id, _ = with_number(plain, called["doc_id"])
    groups = similar_groups(plain.select(doc_id.alias("id"), as_text(called["text"]).alias("text")), shingle, radius, similarity, tables, "id")
    gone = groups.where("id <> group_id").select("id")
    return plain.join(gone, doc_id == F.col("id"), "left_anti").select(*columns).toDF(*docs.columns)
