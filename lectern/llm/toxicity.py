"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters, A-Z lower-cased) is the sum of ``COLUMNS`` hashed embeddings: two of the whole
word, so that one collision is not enough, and one of its first 4 and 6 bytes; filters of widths
``WIDTHS`` slide over a text, ReLU and max pooling over the whole text follow, then a logistic
layer. The first embedding dimension starts from the smoothed log odds of its bucket between
the two labels, in all rows that train. Training starts on the driver with at most ``SAMPLE`` labelled rows, half of either label where
there are as many, of at most ``TRAIN_BYTES`` each and ``TOTAL_BYTES`` in all. A row counts there in the loss and the bias
as many times as its label has rows for each one sampled, so that they follow the
balance of all labels. If these are not all labelled rows, training goes on over all of them, whatever
their length: ``PASSES`` times each shard of about ``SHARD_ROWS`` rows goes on from the same model inside a task, and what
the shards learnt is averaged, each bucket by how often a shard moved it. Thresholds are calibrated by language on a
fifth of all labelled rows, which never trains. Scoring reads whole texts only: no label, language, source or id.

Defined cases: null and empty texts, and texts without words, score as one blank word; long
texts are scored whole; several labels of a document count as their largest; rows without a
label, or whose id is null, never train (ids are of any type) but are scored; of repeated ids one
row trains; if the sample lacks one of the labels, every score is 0, and so is an empty table's
model; a document whose score ties with its threshold is rejected; a language without a
threshold takes 0.5; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import as_text, materialize, mix64, same_ids, shielded, small_batches, span_hasher, text_slices

BUCKETS, COLUMNS, DIM, FILTERS, WIDTHS = 1 << 17, 4, 8, 8, (1, 2, 3)
SAMPLE, TRAIN_BYTES, TOTAL_BYTES, EPOCHS, BATCH, RATE = 5000, 64_000, 40_000_000, 6, 64, 0.05
#: Text whose words are handled at once; their numbers take some hundred bytes a word.
SLICE = 250_000
#: Parts in which the sample's words come to the driver, one at a time.
PARTS = 16
#: Passes over all labelled rows, and rows of a shard, about; words of a step at most, but for a longer text.
PASSES, SHARD_ROWS, STEP_WORDS = 3, 8192, 100_000
#: Buckets that are averaged at once.
PIECE = 1024

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  #: for each width (width, DIM, FILTERS)
    shifts: np.ndarray  #: of each filter
    weights: np.ndarray
    bias: float
    constant: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)  #: by language, "" for any other


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets of each word, words of each row)."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], letter[:-1]]) if len(letter) else letter
    after = np.concatenate([letter[1:], [False]]) if len(letter) else letter
    starts, ends = np.flatnonzero(letter & (~before | edge[:-1])), np.flatnonzero(letter & (~after | edge[1:])) + 1
    hashed = span_hasher(data)
    whole = hashed(starts, ends)
    parts = [whole, mix64(whole), *(mix64(hashed(starts, np.minimum(ends, starts + k)) ^ np.uint64(k)) for k in (4, 6))]
    return np.stack([h % np.uint64(BUCKETS) for h in parts], 1).astype(np.int32), np.diff(np.searchsorted(starts, offs))


def _convolve(model: Model, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word vectors, activations before ReLU, first position of each row, row lengths); a row without words has one blank word."""
    sizes = np.maximum(counts, 1)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.zeros((int(sizes.sum()), DIM), np.float32)
    there = np.ones(len(x), bool)
    there[first[counts == 0]] = False
    x[there] = sum(model.embedding[buckets[:, k]] for k in range(COLUMNS))
    last = first + sizes
    acts = []
    for w, kernel in zip(WIDTHS, model.filters):
        total = x @ kernel[0]
        for k in range(1, w):
            moved = x[k:] @ kernel[k]
            outside = (last[:, None] - 1 - np.arange(k)).ravel()  # no word of the next row
            outside = outside[(outside >= np.repeat(first, k)) & (outside < len(moved))]
            moved[outside] = 0
            total[:-k] += moved
        acts.append(total)
    return x, np.concatenate(acts, 1) + model.shifts, first, sizes


def scores(model: Model, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if model.constant:
        return np.zeros(len(counts))
    _, acts, first, _ = _convolve(model, buckets, counts)
    pooled = np.maximum(np.maximum.reduceat(acts, first, axis=0), 0)
    return 1 / (1 + np.exp(-(pooled @ model.weights + model.bias).astype(np.float64)))


def _started(seed: int) -> tuple[np.random.Generator, Model, list[np.ndarray]]:
    """(random numbers, a model that learnt nothing yet, its sums of squared gradients)."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    model = Model(rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32), [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.full(n, -0.1, np.float32), np.abs(rng.normal(0.3, 0.1, n)).astype(np.float32), -1.0)
    return rng, model, [*(np.full_like(a, 1e-3) for a in (model.embedding, *model.filters, model.shifts, model.weights)), np.full(1, 1e-3)]


def train(rows: list[tuple[np.ndarray, int]], seed: int = 7, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """rows: (buckets of the words, label); weights: of a row of either label. Adagrad on the logistic loss; only pooled positions learn."""
    return _trained(rows, seed, weights)[0]


def _seen(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of either label that hold each bucket, rows of either label)."""
    seen = np.zeros((2, BUCKETS), np.float32)
    for words, y in rows:
        seen[y, np.unique(words)] += 1
    return seen, np.bincount([y for _, y in rows], minlength=2).astype(np.float32)


def _trained(rows: list[tuple[np.ndarray, int]], seed: int = 7, weights: tuple[float, float] = (1.0, 1.0), known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Model, list[np.ndarray]]:
    """(model, its sums of squared gradients); known: what _seen gives of all rows, if these are a sample."""
    rng, model, past = _started(seed)
    labels = np.array([y for _, y in rows], np.float32)
    seen, n = known or _seen(rows)
    if not n.all():
        model.constant = True
        return model, past
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    model.embedding[:, 0] = np.where(seen.sum(0) >= 3, np.clip(odds, -3, 3), 0) / 3
    for kernel in model.filters:
        kernel[:, 0] = np.abs(kernel[:, 0]) + 0.3
    weight = np.array(weights, np.float32)[labels.astype(int)]
    weight /= weight.mean() if len(weight) else 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            _step(model, past, [rows[i][0] for i in pick], labels[pick], weight[pick])
    return model, past


def _step(model: Model, past: list[np.ndarray], words: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The model learns from a few rows at once; the buckets it moved."""
    n = len(WIDTHS) * FILTERS
    counts = np.array([len(w) for w in words])
    buckets = np.concatenate(words).reshape(-1, COLUMNS)
    x, acts, first, sizes = _convolve(model, buckets, counts)
    top = np.stack([acts[f : f + s].argmax(0) + f for f, s in zip(first, sizes)])
    pooled = np.maximum(acts[top, np.arange(n)], 0)
    error = (1 / (1 + np.exp(-(pooled @ model.weights + model.bias))) - labels) * weight / len(words)
    back = error[:, None] * model.weights * (pooled > 0)
    grad_w, grad_b = error @ pooled, float(error.sum())
    grad_x = np.zeros_like(x)
    grads = []
    for j, (w, kernel) in enumerate(zip(WIDTHS, model.filters)):
        mine = slice(j * FILTERS, (j + 1) * FILTERS)
        grad = np.zeros_like(kernel)
        for k in range(w):
            inside = top[:, mine] + k < (first + sizes)[:, None]
            pos = np.where(inside, top[:, mine] + k, 0)
            flow = back[:, mine] * inside
            grad[k] = np.einsum("bfd,bf->df", x[pos], flow)
            np.add.at(grad_x, pos.ravel(), (flow[:, :, None] * kernel[k].T[None]).reshape(-1, DIM))
        grads.append(grad)
    there = np.ones(len(x), bool)
    there[first[counts == 0]] = False
    moved = np.flatnonzero(np.abs(grad_x).sum(1) > 0)
    row_of = np.cumsum(there) - 1
    moved = moved[there[moved]]
    hit, back_to = np.unique(buckets[row_of[moved]].ravel(), return_inverse=True)
    grad_e = np.zeros((len(hit), DIM), np.float32)
    np.add.at(grad_e, back_to.ravel(), np.repeat(grad_x[moved], COLUMNS, axis=0))
    past[0][hit] += grad_e**2
    model.embedding[hit] -= RATE * grad_e / np.sqrt(past[0][hit])
    for p, value, grad in zip(past[1:], [*model.filters, model.shifts, model.weights], [*grads, back.sum(0), grad_w]):
        p += grad**2
        value -= RATE * grad / np.sqrt(p)
    past[-1] += grad_b**2
    model.bias -= RATE * grad_b / float(past[-1][0]) ** 0.5
    return hit


def _flat(model: Model, past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, embedding and its sums) and all other numbers in one row; the sums of one follow its numbers."""
    dense = [*model.filters, model.shifts, model.weights, np.array([model.bias])]
    return np.concatenate([model.embedding, past[0]], 1), np.concatenate([a.ravel() for a in (*dense, *past[1:])]).astype(np.float64)


def _unflat(table: np.ndarray, dense: np.ndarray) -> tuple[Model, list[np.ndarray]]:
    _, model, past = _started(0)
    model.embedding, past[0] = np.ascontiguousarray(table[:, :DIM], np.float32), np.ascontiguousarray(table[:, DIM:], np.float32)
    at = 0
    values = [*model.filters, model.shifts, model.weights, np.zeros(1)]
    for a in (*values, *past[1:]):
        a[...] = dense[at : at + a.size].reshape(a.shape)
        at += a.size
    model.bias = float(values[-1][0])
    return model, past


def _all_seen(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What _seen gives of all rows (label, text), counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label, at = batch["label"].to_numpy(), 0
            n += np.bincount(label, minlength=2)
            for _, _, data, offs in text_slices(batch["text"], SLICE):
                both, counts = word_buckets(data, offs)
                for words in np.split(both, np.cumsum(counts)[:-1]):
                    seen[label[at], np.unique(words)] += 1
                    at += 1
        pieces = [n.tobytes(), *(seen[:, k : k + PIECE].tobytes() for k in range(0, BUCKETS, PIECE))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(pieces) - 1), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "seen"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in rows["seen"].to_pylist())
        return pa.table({"piece": rows["piece"][:1], "seen": pa.array([total.tobytes()], pa.binary())})

    seen, n = np.zeros((2, BUCKETS), np.float32), np.zeros(2, np.float32)
    for r in labelled.select("label", "text").mapInArrow(run, "piece int, seen binary").groupBy("piece").applyInArrow(added, "piece int, seen binary").toLocalIterator():
        got = np.frombuffer(r.seen, np.int64).reshape(2, -1)
        if r.piece < 0:
            n[:] = got[:, 0]
        else:
            seen[:, r.piece * PIECE : (r.piece + 1) * PIECE] = got
    return seen, n


PIECES = "shard int, piece int, many binary, moved binary"


def _learnt(shared):
    """What each shard of rows (shard, label, text) in a row learns, going on from the shared model: for each piece of buckets how often each was moved, and how far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = past = many = None
        shard, words, labels, steps = -1, [], [], 0

        def step():
            nonlocal words, labels, steps
            if words:
                many[_step(model, past, words, np.array(labels, np.float32), np.ones(len(words), np.float32))] += 1
                words, labels, steps = [], [], steps + 1

        def moved() -> Iterator[pa.RecordBatch]:
            (old, old_dense), (new, new_dense) = _flat(*shared.value), _flat(model, past)
            for k in range(-1, BUCKETS // PIECE):
                mine = slice(k * PIECE, (k + 1) * PIECE)
                n, x = (many[mine], new[mine] - old[mine]) if k >= 0 else (np.array([steps]), new_dense - old_dense)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([n.astype(np.float64).tobytes()], pa.binary()), pa.array([x.astype(np.float64 if k < 0 else np.float32).tobytes()], pa.binary())], ["shard", "piece", "many", "moved"])

        for batch in batches:
            at = 0
            for _, _, data, offs in text_slices(batch["text"], SLICE):
                both, counts = word_buckets(data, offs)
                for mine in np.split(both, np.cumsum(counts)[:-1]):
                    if batch["shard"][at].as_py() != shard:
                        if model is not None:
                            step()
                            yield from moved()
                        shard, steps, many = batch["shard"][at].as_py(), 0, np.zeros(BUCKETS)
                        model, past = _unflat(*_flat(*shared.value))
                    if sum(map(len, words)) + len(mine) > STEP_WORDS:
                        step()
                    words.append(mine)
                    labels.append(batch["label"][at].as_py())
                    at += 1
                    if len(words) == BATCH:
                        step()
        if model is not None:
            step()
            yield from moved()

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """How far a piece of buckets (-1: all other numbers) moves: the mean of the shards, each by how often it moved."""
    rows = rows.sort_by("shard")
    total = weight = 0.0
    for piece, many, moved in zip(rows["piece"].to_pylist(), rows["many"].to_pylist(), rows["moved"].to_pylist()):
        n = np.frombuffer(many, np.float64)[:, None]
        x = np.frombuffer(moved, np.float64 if piece < 0 else np.float32).reshape(len(n), -1)
        total, weight = total + n * x, weight + n
    return pa.table({"piece": rows["piece"][:1], "moved": pa.array([(total / np.maximum(weight, 1)).tobytes()], pa.binary())})


def _go_on(model: Model, past: list[np.ndarray], labelled: DataFrame, n: int) -> Model:
    """The model after PASSES more passes over all n rows (doc_id, label, text) of labelled; only its own numbers reach the driver."""
    context = labelled.sparkSession.sparkContext
    shards = -(-n // SHARD_ROWS) or 1
    for k in range(PASSES):
        shared = context.broadcast((model, past))  # BUCKETS x DIM numbers, whatever the input
        dealt = labelled.select("label", "text", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("doc_id", F.lit(k)).alias("place"), "doc_id")
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id").select("shard", "label", "text")
        moved = materialize(dealt.mapInArrow(_learnt(shared), PIECES), "learnt")
        table, dense = _flat(model, past)
        table = table.astype(np.float64)
        for r in moved.groupBy("piece").applyInArrow(_averaged, "piece int, moved binary").toLocalIterator():
            if r.piece < 0:
                dense = dense + np.frombuffer(r.moved, np.float64)
            else:
                table[r.piece * PIECE : (r.piece + 1) * PIECE] += np.frombuffer(r.moved, np.float64).reshape(PIECE, -1)
        model, past = _unflat(table, dense)
        shared.unpersist()
    return model


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """By language of scored (lang, label, score): best F1, midway between the scores around it, as in calibrate.

    Rows are dealt out by ranges of language and score, and each range adds up its own, so no task holds a language.
    """
    each = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    each = materialize(each.repartitionByRange("lang", F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    parts = each.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))  # a row a range and language
    so_far, whole, own = W.partitionBy("lang").orderBy("part"), W.partitionBy("lang"), W.partitionBy("lang", "part").orderBy(F.desc("score"))
    parts = parts.select("lang", "part", *[e.alias(a) for c in ("n", "hits") for e, a in ((F.sum(c).over(so_far) - F.col(c), f"{c}_before"), (F.sum(c).over(whole), f"{c}_all"))])
    summed = each.withColumns({"n_to": F.sum("n").over(own), "hits_to": F.sum("hits").over(own)}).join(parts, ["lang", "part"])
    f1 = 2.0 * (F.col("hits_to") + F.col("hits_before")) / (F.col("n_to") + F.col("n_before") + F.col("hits_all"))
    usable = summed.where("n_all >= 20 and hits_all > 0 and hits_all < n_all")
    best = usable.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("b")).select("lang", F.col("b.score").alias("at"))
    below = each.join(best, "lang").where("score < at").groupBy("lang").agg(F.max("score").alias("next"))
    found = {r["lang"]: (r["at"] + (r["next"] or 0)) / 2 for r in best.join(below, "lang", "left").collect()}  # a row a language
    return {r["lang"]: found.get(r["lang"], 0.5) for r in each.select("lang").distinct().collect()} | {"": 0.5}


def calibrate(model: Model, held: list[tuple[np.ndarray, int, str]], weights: tuple[float, float] = (1.0, 1.0)) -> None:
    """weights: of a row of either label. The threshold of each language that has both labels in held: best F1, midway between the scores around it."""
    got = scores(model, np.concatenate([np.zeros((0, COLUMNS), np.int32), *(w for w, _, _ in held)]), np.array([len(w) for w, _, _ in held], np.int64)) if held else np.zeros(0)
    labels, langs = np.array([y for _, y, _ in held]), np.array([g for _, _, g in held])

    def best(mine: np.ndarray) -> float:
        s, y = got[mine], labels[mine]
        if len(s) < 20 or not 0 < y.sum() < len(y):
            return 0.5
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        w = np.array(weights)[y]
        hits = np.cumsum(w * y)
        f1 = 2 * hits / (np.cumsum(w) + hits[-1])
        k = int(f1.argmax())
        return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)

    model.thresholds = {g: best(langs == g) for g in sorted(set(langs.tolist()))} | {"": 0.5}


def fit(docs: DataFrame, labels: DataFrame, train_if: Column | None = None, sample: int = SAMPLE, train_bytes: int = TRAIN_BYTES, total_bytes: int = TOTAL_BYTES, label_col: str = "toxic") -> Model:
    """A model from all labelled documents (doc_id, text, lang) for which train_if holds.

    train_if is a column of labels.doc_id. It starts from a sample: of either label no more than half of ``sample`` rows
    and of ``total_bytes`` of text, first ones by a hash of the id, of at most ``train_bytes`` each; then all rows are learnt from, unless these were all.
    """
    small_batches(docs.sparkSession)
    marks, mark = shielded(labels.withColumn("train_if", train_if if train_if is not None else F.lit(True)))
    plain, called = shielded(docs)
    own, theirs = same_ids(plain, called["doc_id"], marks, mark["doc_id"])
    known = marks.where(mark["train_if"]).select(theirs.alias("doc_id"), F.col(mark[label_col]).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    lang = as_text(called["lang"]) if "lang" in called else F.lit("")
    texts = plain.select(own.alias("doc_id"), as_text(called["text"]).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    labelled = materialize(texts.join(known.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id", F.lit(11))), "labelled")
    counts = dict(labelled.groupBy("label").count().collect())
    small = labelled.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes)
    picked = [small.where(F.col("label") == y).orderBy("h", "doc_id").limit(sample // 2).select("doc_id") for y in (0, 1)]
    picked = picked[0].union(picked[1])  # sample ids: bounded
    texts = labelled.join(F.broadcast(picked), "doc_id")
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("label").orderBy("h", "doc_id"))  # over sample rows at most
    texts = texts.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where(F.col("so_far") <= total_bytes // 2)
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 4
    texts = texts.withColumn("held", held_out).drop("so_far", "h")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offs in text_slices(batch["text"], SLICE):
                both, counts = word_buckets(data, offs)
                out += [part.tobytes() for part in np.split(both, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["lang"], batch["held"], pa.array(out, pa.binary())], ["doc_id", "label", "lang", "held", "words"])

    texts = texts.repartition(PARTS)  # else one partition a label
    rows = texts.mapInArrow(words, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label int, lang string, held boolean, words binary").toLocalIterator()  # a partition at a time
    rows = sorted(((r.doc_id, r.label, r.lang, np.frombuffer(r.words, np.int32).reshape(-1, COLUMNS), r.held) for r in rows), key=lambda r: r[0])
    weights = tuple(max(counts.get(y, 0) / max(sum(r[1] == y for r in rows), 1), 1.0) for y in (0, 1))
    if len(rows) == sum(counts.values()):  # the sample is all
        held = [i for i in range(len(rows)) if i % 5 == 4]
        model = train([(w, y) for i, (_, y, _, w, _) in enumerate(rows) if i % 5 != 4], weights=weights)
        calibrate(model, [(rows[i][3], rows[i][1], rows[i][2]) for i in held], weights)
        return model
    learning = labelled.where(~held_out)
    known = _all_seen(learning)
    model, past = _trained([(w, y) for _, y, _, w, held in rows if not held], weights=weights, known=known)
    del rows
    if not model.constant:
        model = _go_on(model, past, learning, int(known[1].sum()))
    model.thresholds = _thresholds(score(labelled.where(held_out).select("lang", "label", "text"), model).select("lang", "label", "score"))
    return model


def score(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """docs and a column score_col: the score of column text. A column of that name is replaced."""
    plain, called = shielded(docs)
    kept = [k for k, n in enumerate(docs.columns) if n != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, whatever the input

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        got, model = [], shared.value
        for _, _, data, offs in text_slices(texts, SLICE):
            got.append(scores(model, *word_buckets(data, offs)))
        return pa.array(np.concatenate(got) if got else np.zeros(0))

    return plain.select(*[f"c{k}" for k in kept], run(as_text(called["text"])).alias("score")).toDF(*[docs.columns[k] for k in kept], score_col)


def threshold(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a language."""
    out = F.lit(model.thresholds.get("", 0.5))
    for g, t in model.thresholds.items():
        out = F.when(lang == g, t).otherwise(out) if g else out
    return out


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below their language's threshold, with the columns they had."""
    plain, called = shielded(docs)
    lang = as_text(called["lang"]) if "lang" in called else F.lit("")
    scored = score(plain.withColumnRenamed(called["text"], "text"), model).where(F.col("score") < threshold(model, lang))
    return scored.drop("score").toDF(*docs.columns)
