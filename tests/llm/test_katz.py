"""The Katz model against a plain dictionary version of any order."""

from collections import Counter, defaultdict
from math import log10

import pytest

from lectern.llm import katz


def plain(rows, order):
    """{row number: (n_tokens, n_known, N, base, score)} of (doc_id, text, train), by recursion over histories."""
    docs = [([*(t or "").encode().lower().split(), "END"], tr) for _, t, tr in rows]
    counts = {k: Counter() for k in range(1, order + 1)}

    def history(w, i, k):
        """The k words before place i, one start for what lies before the text; None where two would be."""
        return None if i - k < -1 else tuple(["START", *w][i + 1 - k : i + 1])

    for w, tr in docs:
        for i in range(len(w)) if tr else ():
            for k in range(1, order + 1):
                h = history(w, i, k - 1)
                if h is not None:
                    counts[k][(*h, w[i])] += 1
    N, V = sum(counts[1].values()), len(counts[1])
    stars = {}
    for k, c in counts.items():
        n = Counter(c.values())
        s = katz.discounted([n[r] for r in range(1, katz.K + 2)])
        stars[k] = lambda r, s=s: s[r - 1] if r <= katz.K else r - katz.ABOVE
    after = {k: defaultdict(list) for k in range(2, order + 1)}
    for k in after:
        for g, c in counts[k].items():
            after[k][g[:-1]].append((g[-1], c))
    unknown = 1 - sum(stars[1](c) / N for c in counts[1].values()) if N else 1.0
    known = {}

    def p(h, w):
        if not h:
            return stars[1](counts[1][(w,)]) / N if (w,) in counts[1] else unknown
        if (h, w) not in known:
            seen = after[len(h) + 1].get(h)
            if seen is None:
                known[h, w] = p(h[1:], w)
            else:
                total = sum(c for _, c in seen)
                c = counts[len(h) + 1].get((*h, w))
                known[h, w] = stars[len(h) + 1](c) / total if c else weight(h, seen, total) * p(h[1:], w)
        return known[h, w]

    def weight(h, seen, total):
        return (1 - sum(stars[len(h) + 1](c) for _, c in seen) / total) / (1 - sum(p(h[1:], x) for x, _ in seen))

    for h in [*list(after.get(order, ()))[:40], *([()] if N else [])]:  # exactly normalised
        assert abs(sum(p(h, w) for (w,) in counts[1]) + p(h, "no such word") - 1) < 1e-9
    out = {}
    for row, (w, _) in enumerate(docs):
        score = 0.0
        for i in range(len(w)) if N else ():
            k = order - 1
            while history(w, i, k) is None:
                k -= 1
            score += log10(p(history(w, i, k), w[i]))
        out[row] = (len(w), sum((x,) in counts[1] for x in w), N, sum(log10((counts[1][(x,)] + 1) / (N + V + 1)) for x in w), score)
    return out


def check(spark, rows, order=3, **args):
    df = spark.createDataFrame([(k, t, tr) for k, (_, t, tr) in enumerate(rows)], "doc_id long, text string, t boolean").repartition(3)
    got = {r.doc_id: r for r in katz.score(df, df.t, order=order, **args).collect()}
    want = plain(rows, order)
    assert len(got) == len(want)
    for k, (n, known, total, base, score) in want.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("order, hot_at, block", [(3, None, 1_000_000), (3, 30, 2_000), (4, 100, 5_000), (2, None, 3_000), (1, None, 9_000)])
def test_real_texts(spark, sf_dir, order, hot_at, block, monkeypatch):
    monkeypatch.setattr(katz._blocks, "__defaults__", (block,))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(90).collect()
    check(spark, [(r.doc_id, r.text, r.doc_id % 7 != 2) for r in rows], order, hot_at=hot_at)


def test_edges(spark):
    rows = [(0, "a b a b a b c", True), (1, None, True), (2, "", False), (3, "zz a b", False), (4, "a b", True), (5, "a b", True), (6, "a b a c zz", False)]
    check(spark, rows)
    check(spark, rows, hot_at=0)


def test_nothing_to_learn_from(spark):
    check(spark, [(0, "a b", False), (1, "", False)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, t boolean")
    assert katz.score(df, df.t).count() == 0


def test_packed_columns():
    import numpy as np

    columns = [np.arange(7, dtype=np.uint64), np.array([1.5, -2.0]), np.zeros(0, np.int64), np.array([300, 2], np.uint64), np.array([-5])]
    got = katz.unpack(katz.pack(*columns))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, got))
