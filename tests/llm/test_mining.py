"""Collocations, whitening and licence scans against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import collocations, licenses, whitening

# Collocations


def phrases_by_hand(rows, longest, least, top, cover):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in some.items():
            inside = lambda q: len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
            if any(inside(q) and 100 * b >= cover * a for q, b in some.items()):
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def sentences(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "a", "é", "日本", "new", "york", "x y", "b\x00", "of", "state", "long" * 9]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "!", "? ", "\x0b", ""]
    for k in range(n):
        said = [w + marks[m] for w, m in zip(rng.choice(words, 25, p=[0.2, 0.1, 0.1, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05, 0.1, 0.05, 0.05]), rng.integers(0, len(marks), 25))]
        yield "".join(said) + " new york state of the", ["en", "de", None, "und"][k % 4]


@pytest.mark.parametrize("longest, least, top, cover", [(5, 3, 40, 100), (3, 2, 5, 60), (2, 4, 100, 100)])
def test_collocations_equal_brute_force(spark, longest, least, top, cover):
    rows = [*sentences(60), (None, "en"), ("", "xx"), ("one two", "fr"), ("word", None)] + [("hot words here and here", "en")] * 50
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(map(tuple, collocations.mine(df, longest=longest, least=least, top=top, cover=cover).collect()))
    assert got == phrases_by_hand(rows, longest, least, top, cover)


def test_collocations_of_odd_tables(spark):
    odd = spark.createDataFrame([("a b c, a b", "en", 1, "x")] * 4, "t string, l string, n int, k string").toDF("text", "lang", "a.b", "phrase")
    assert sorted((r.phrase, r.a, r.n) for r in collocations.mine(odd, least=4).collect()) == [("a b", 8, 20), ("a b c", 4, 20)]
    assert collocations.mine(odd.limit(0)).count() == 0 and collocations.mine(odd, least=100).count() == 0


def test_pairs_by_tile_and_bucket():
    rng = np.random.default_rng(1)
    some = np.r_[rng.integers(0, 40, 200_000), rng.integers(0, collocations.HELD, 20_000), (1 << 62) + rng.integers(0, 30, 20_000)]
    left, right = rng.permutation(some), rng.permutation(some)
    got = Counter()
    for tile, _, a, b, n in collocations.count_pairs(left, right):
        if tile < collocations.TILES:
            side = collocations.HELD // collocations.SIDE
            b = tile % side * collocations.SIDE + a.astype(np.int64) % collocations.SIDE
            a = tile // side * collocations.SIDE + a.astype(np.int64) // collocations.SIDE
        got.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))
    assert got == Counter(zip(left.tolist(), right.tolist()))


def test_cells_are_added_up():
    rng = np.random.default_rng(2)
    for size in (0, 1, 50, collocations.DENSE + 7):
        cell, n = rng.integers(0, 3000, size).astype(np.uint32), rng.integers(1, 9, size)
        for weights in (None, n):
            want = Counter()
            for c, k in zip(cell.tolist(), (np.ones(size, int) if weights is None else n).tolist()):
                want[c] += k
            a, b = collocations.added(cell, weights)
            assert dict(zip(a.tolist(), b.tolist())) == want and list(a) == sorted(a)


# Whitening


def whitened_by_hand(vectors, k):
    x = [tuple(math.floor(256 * c) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    n, sums = len(fit), [sum(c) for c in zip(*set(x))]
    centred = fit - fit.mean(0)
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    share = values / values.sum()
    values, turn = values[:k], turn[:, :k]
    y = (np.array(x, float) - fit.mean(0)) @ turn / np.sqrt(values)
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], y, share


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_whitening_equals_numpy(spark, monkeypatch, scale):
    monkeypatch.setattr(whitening, "ROWS", 32)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(150, 7)) * [9, 7, 5, 3, 1, 0.5, 0.2] * scale).tolist()
    vectors += [vectors[0]] * 70
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    n, deviation, y, share = whitened_by_hand(vectors, 4)
    out = whitening.whiten(df).collect()
    assert len(out) == 4 * len(vectors)
    got = np.full(y.shape, np.nan)
    for r in out:
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got[r.vec_id, r.component - 1] = r.whitened
    got *= np.sign(got[3] * y[3])
    assert np.allclose(got, y, atol=1e-8)


def test_whitening_of_odd_rows(spark):
    rows = [("a", [1.0, 2.0], 1), (None, [2.0, 1.0], 2), ("a", [1.0, 2.0], 3), ("b", None, 4), ("c", [None, 1.0], 5), ("d", [float("nan"), 1.0], 6), ("e", [float("inf"), 1.0], 7), ("f", [1.0], 8), ("g", [], 9), ("h", [5.0, 5.5], 10), ("i", [1e300, 0.0], 11)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, n int").toDF("vec_id", "embedding", "a.b").withColumn("component", F.lit("x"))
    out = whitening.whiten(df, components=9)
    assert out.columns == ["vec_id", "embedding", "a.b", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = [(r["a.b"], r.component) for r in out.collect()]
    assert sorted(got) == sorted((k, c) for k in (1, 2, 3, 10) for c in (1, 2)) and {r.n for r in out.collect()} == {3}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 'a'")).count() == 0  # one distinct vector


# Licences


def scanned_by_hand(text, index):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    where = lambda phrase: [k for k in range(len(words) - len(phrase.split()) + 1) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = sorted(k for p in index.base for k in where(p))
    base = {label for p, label in index.base.items() if where(p)}
    more, score = set(), 0.0
    for label, body, keys in licenses.TEMPLATES:
        body = body.split()
        weights = [index.idf[index.number[w]] for w in body]
        chain, last = None, 0
        for key in keys:
            last = next(k for k in range(last, len(body)) if body[k : k + len(key.split())] == key.split())
            spots = [k - last for k in where(key)]
            for s in spots:
                same = sum(x for k, (w, x) in enumerate(zip(body, weights)) if 0 <= s + k < len(words) and words[s + k] == w)
                score = max(score, same / sum(weights))
            chain = spots if chain is None else [s for s in spots if any(abs(s - c) <= licenses.DRIFT for c in chain)]
        if chain:
            more.add(label)
    return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(base | more)), score


def licence_texts():
    rng = np.random.default_rng(8)
    fill = ["the", "license", "gnu", "cc", "by", "mit", "version", "3", "ünd", "日本", "public", "x"]
    yield from ["", None, "MIT", "no words here", "Released under the MIT License.", "cc by cc by", "GNU General-Public\nLicense, version 3.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."]
    for k in range(80):
        parts = []
        for _ in range(rng.integers(1, 4)):
            parts += list(rng.choice(fill, rng.integers(0, 12)))
            body = licenses.TEMPLATES[rng.integers(0, len(licenses.TEMPLATES))][1].split()
            drop = rng.integers(0, len(body)) if k % 3 == 0 else -1
            extra = rng.integers(0, len(body)) if k % 4 == 0 else -1
            for j, w in enumerate(body):
                parts += [w.title()] if j != drop else []
                parts += ["word"] * int(rng.integers(1, 16)) if j == extra else []
        yield " ".join(parts)


def test_licences_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CELLS", 200)
    texts = [*licence_texts(), " ".join(["mit license"] * 3000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    index = licenses.fit(df)
    out = {r.doc_id: r for r in licenses.scan(df, index=index).collect()}
    for k, text in enumerate(texts):
        r = out[k]
        *want, score = scanned_by_hand(text, index)
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels] == want, text
        assert abs(r.score - score) < 1e-9
    assert sum("gpl-3.0" in r.labels for r in out.values()) > 1 and out[7].labels == "apache,apache-2.0,cc-by,cc-by-nc-4.0"


def test_licences_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "mit license", "x", 1), ("a", None, "y", 2), ("a", "mit license", "z", 3)], "doc_id string, text string, labels string, n int").toDF("doc_id", "text", "labels", "a.b")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((r["a.b"], r.n_base, r.labels) for r in out.collect()) == [(1, 1, "mit"), (2, 0, ""), (3, 1, "mit")]
    assert licenses.scan(df.limit(0)).count() == 0
