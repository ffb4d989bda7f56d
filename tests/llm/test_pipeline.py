"""Line dedup and the pipeline's stages against plain versions with code of their own."""

import random

import pytest
import xxhash

import corpus_pipeline
from lectern.llm import linededup, sentencepiece_codec, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def runs_of(lines):
    """All (start, end) of runs of lines, with their words."""
    for a in range(len(lines)):
        words = 0
        for e in range(a, len(lines)):
            words += len(lines[e].split())
            yield a, e + 1, words


def judged(docs, least, most):
    """{doc: (lines of runs of most words or more that stand earlier, lines of such of least or more)} of (id, lines)."""
    first = {}
    for d, lines in docs:
        for a, e, _ in runs_of(lines):
            first.setdefault(tuple(lines[a:e]), (d, a))
    out = {}
    for d, lines in docs:
        sure, may = set(), set()
        for a, e, words in runs_of(lines):
            if first[tuple(lines[a:e])] != (d, a):
                sure |= set(range(a, e)) if words >= most else set()
                may |= set(range(a, e)) if words >= least else set()
        out[d] = sure, may
    return out


def left_lines(text):
    return [x for x in (text or "").split("\n") if x.strip()]


def test_line_dedup_on_random_runs(spark):
    """Every run of a window's words that stands earlier goes whole; nothing goes that is in no earlier run of a gram's words."""
    rng = random.Random(21)
    docs = []
    for case in range(400):
        line = lambda k, n: " ".join(f"c{case}w{k}x{i}" for i in range(n))  # noqa: E731, B023
        pool = [line(k, rng.choice([1, 3, 8, 8, 9, 12, 24, 30])) for k in range(rng.randint(3, 9))]
        for _ in range(rng.randint(2, 5)):
            mine = []
            for _ in range(rng.randint(1, 3)):
                a = rng.randrange(len(pool))
                mine += pool[a : a + rng.randint(1, 6)]
                mine += [line(rng.randrange(10**6), rng.randint(1, 9)) for _ in range(rng.randint(0, 2))]
            docs.append((len(docs), mine))
    want = judged(docs, linededup.GRAM_WORDS, linededup.WINDOW_WORDS)
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs], "doc_id long, text string")
    out = {r.doc_id: r for r in linededup.dedup(df, counts=True).collect()}
    assert len(out) == len(docs)
    for d, lines in docs:
        sure, may = want[d]
        kept = left_lines(out[d].text)
        must = [x for k, x in enumerate(lines) if k not in may]
        at = 0
        for x in kept:  # kept lines are a subsequence without any of the sure ones
            while at < len(lines) and (lines[at] != x or at in sure):
                at += 1
            assert at < len(lines), (d, x)
            at += 1
        assert len(kept) <= len(lines) - len(sure)
        left = iter(kept)
        assert all(x in left for x in must), d
    assert {x for d in out for x in left_lines(out[d].text)} == {x for _, lines in docs for x in lines}


def shingles(text):
    w = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(len(w) - 5, 0) + 1)} if w else set()


def near_classes(docs, similarity):
    """{id: smallest id of its class} by all pairs."""
    root = {d: d for d, _ in docs}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: shingles(t or "") for d, t in docs}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if (not x and not y) or len(x & y) >= similarity * len(x | y):
                p, q = sorted((up(a), up(b)))
                root[q] = p
    return {d: up(d) for d in ids}


def holds(item, text):
    """Whether the item occurs in the text within one edit in twenty characters."""
    p, t = (" ".join(x.lower().split()) for x in (item, text))
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) <= len(p) // 20


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with toxic documents, repeated passages, near copies and benchmark items."""
    rng = random.Random(22)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, items = [say(20) for _ in range(3)], [say(15) for _ in range(3)]
    rows, labels = [], []
    for k in range(160):
        body = [say(rng.randint(5, 40)) for _ in range(rng.randint(2, 6))]
        if k % 11 == 0:
            body[1:1] = passage
        if k % 17 == 5:
            words = items[k % 3].split()
            body.append(f"{say(4)} {' '.join(words)} {say(3)}" if k % 2 else f"{say(4)} {items[k % 3].upper().replace(words[3].upper(), words[3].upper()[:-1])} {say(3)}")
        text = "\n".join(body)
        if k % 5 == 0:
            text += " you vile stupid wretch, vile vile " + say(3)
        rows.append((k, text))
        labels.append((k, k % 2, int(k % 5 == 0)))
    for k in range(30):
        words = rows[rng.randrange(160)][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((200 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  "), (303, rows[1][1])]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, items


def test_stages_match_plain_versions(spark, folder):
    root, items = folder
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    texts = {"": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, root), "test")
        seen[name] = docs.collect()
        texts[name] = {r.doc_id: r.text for r in seen[name]}
    toxic = {d for d, t in texts[""].items() if "vile" in (t or "")}
    gone = set(texts[""]) - set(texts["toxicity"])
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.02 * len(texts[""])
    before, after = texts["toxicity"], texts["line_dedup"]
    assert set(before) == set(after)
    want = judged([(d, [x.strip() for x in left_lines(before[d])]) for d in sorted(before)], linededup.GRAM_WORDS, linededup.WINDOW_WORDS)
    for d, (sure, may) in want.items():
        assert len(sure) <= len(left_lines(before[d])) - len(left_lines(after[d])) <= len(may)
    assert sum(len(s) for s, _ in want.values()) > 20
    classes = near_classes(sorted(after.items()), 0.8)
    assert set(texts["simhash_near_dedup"]) == {d for d, c in classes.items() if d == c}
    before, after = texts["simhash_near_dedup"], texts["benchmark_decontamination"]
    assert set(after) == {d for d, t in before.items() if not any(holds(i, t or "") for i in items)} and len(after) < len(before)
    lattice = sentencepiece_codec.Lattice(sentencepiece_codec.load())
    for r in seen["sentencepiece"]:
        assert r.text == after[r.doc_id] and (r.exact or r.text is None)
        escaped = sentencepiece_codec.escape(r.text) if r.text else ""
        _, back = lattice.forward(escaped, [0.0], len(escaped))
        assert r["ids"] == (None if r.text is None else lattice.pieces(escaped, back, len(escaped))[0])
    out = corpus_pipeline.run(spark, root)
    assert {r.doc_id: r["ids"] for r in out.collect()} == {r.doc_id: r["ids"] for r in seen["sentencepiece"]}


def test_stages_without_rows(spark, folder):
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0, name


def test_near_duplicates_in_rounds_are_those_of_one(spark, monkeypatch):
    """Some bands of one table at a time, and some pairs at a time, link what all at once do."""
    rng = random.Random(21)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(k % 3 * 2):
            near = list(words)
            near[rng.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(near)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(r) for r in simhash.similar_groups(df, tables=3).collect())
    assert whole and [len(a) * len(b) for a, b in simhash._rounds(len(rows), 8, 3)] == [24]
    monkeypatch.setattr(simhash, "ROUND", 0)
    monkeypatch.setattr(simhash, "LEAST", 4)
    monkeypatch.setattr(simhash, "PAIRS", 40)
    assert [len(b) for _, b in simhash._rounds(len(rows), 8, 3)] == [4] * 6
    assert sorted(tuple(r) for r in simhash.similar_groups(df, tables=3).collect()) == whole


def test_dealt_fingerprints_are_not_broadcast(spark):
    """Spark takes a table after an explode for as small as before it."""
    nodes = spark.createDataFrame([(k, k * 7919) for k in range(50)], "id long, fingerprint long")
    groups = spark.createDataFrame([(0, 1)], "band int, value long")
    for made in (simhash.links(nodes), simhash.unlike(nodes.withColumn("class", nodes.id), groups)):
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
