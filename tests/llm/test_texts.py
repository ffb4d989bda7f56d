"""Line dedup, SimHash, suffix dedup and decontamination against brute-force versions, and their edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lectern.llm import decontaminate, linededup, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# Line dedup


def test_line_dedup_guarantee(spark):
    """Of any run of a window's words that stands earlier, some part goes; one copy of every line stays."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    texts = []
    for k in range(40):
        own = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(8)]
        cut = rng.randrange(40)
        texts.append("\n".join(own[:4] + pool[cut : cut + 12] + own[4:]))
    left = {r.doc_id: r.text for r in linededup.dedup(docs_of(spark, texts)).collect()}
    assert {x for t in left.values() for x in t.split("\n") if x} == {x for t in texts for x in t.split("\n")}
    seen = set()
    for k, t in enumerate(texts):
        for run in set(windows(left[k].split("\n"), linededup.WINDOW_WORDS)):
            assert run not in seen or run not in "\n".join(t.split("\n"))
        seen |= set(windows(t.split("\n"), linededup.WINDOW_WORDS))


def windows(lines, words):
    for i in range(len(lines)):
        total = 0
        for j in range(i, len(lines)):
            total += len(lines[j].split())
            if total >= words:
                yield "\n".join(lines[i : j + 1])
                break


def test_line_dedup_under_hot_lines(spark):
    """Against all runs of a window's words: each that stands earlier goes whole, also if its fingerprints are first met elsewhere."""
    rng = random.Random(11)
    made = lambda k: " ".join(f"{rng.randrange(10**6)}" for _ in range(k))
    hot = [made(10) for _ in range(40)]
    texts = ["\n".join([made(10), h, made(10)]) for h in hot]
    passages = [[made(10), made(10), h, made(10), made(10)] for h in hot] + [[made(23), h, made(3), made(2)] for h in hot]
    texts += ["\n".join([made(12), *p, made(12)]) for _ in range(2) for p in passages]
    lines, first, want = [t.split("\n") for t in texts], {}, {}
    for k, mine in enumerate(lines):
        gone = set()
        for a in range(len(mine)):
            for e in range(a + 1, len(mine) + 1):
                if sum(len(x.split()) for x in mine[a:e]) >= linededup.WINDOW_WORDS and first.setdefault(tuple(mine[a:e]), (k, a)) != (k, a):
                    gone |= set(range(a, e))
        want[k] = {x for i, x in enumerate(mine) if i not in gone}
    left = {r.doc_id: r.text.split("\n") for r in linededup.dedup(docs_of(spark, texts)).collect()}
    assert sum(len(mine) - len(want[k]) for k, mine in enumerate(lines)) == sum(map(len, passages))
    assert all(set(left[k]) - {""} <= want[k] for k in want)
    assert {x for t in left.values() for x in t if x} == {x for t in lines for x in t}


def test_line_dedup_keeps_columns_and_clean_texts(spark):
    line = "a line of nine words that stands in both"
    rows = [(1, f"{line}\nx", "en", "s", 7, 5), (2, f"{line}\ny", "en", "s", 7, 5), (None, line, None, None, None, None), (3, None, "en", "s", 0, 1)]
    df = spark.createDataFrame(rows, DOCS + ", version long")
    out = linededup.dedup(df, window_words=8)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"{line}\nx", 2: "y", None: line, 3: None}
    assert linededup.dedup(df.limit(0)).count() == 0


# SimHash


def test_equal_texts_are_linked_whatever_else_shares_their_fingerprints(spark):
    """One repeated shingle makes all fingerprints equal; the first of them is unlike the two equal texts."""
    text = lambda k: "x " * 100 + " ".join(f"w{k}n{i}" for i in range(30))
    docs = docs_of(spark, [text(0), text(1), text(1), text(2), "", None, text(1)])
    assert {r.id: r.group_id for r in simhash.similar_groups(docs).collect()} == {1: 1, 2: 1, 6: 1, 4: 4, 5: 4}


def plain_simhash(text, shingle):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("radius, shard", [(4, 8192), (4, 7), (9, 30)])
def test_simhash_matches_brute_force(spark, real, radius, shard, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (4, shard, *simhash.links.__defaults__[2:]))
    texts = real + [(9001, None), (9002, "  "), (9003, "One TWO"), (9004, "one\ttwo"), (9005, real[0][1])]
    want = {d: plain_simhash(t, 4) for d, t in texts}
    classes = plain_components(want, radius)
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), radius=radius).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint % (1 << 64) == want[r.id]
        assert r.component_id == classes[r.id]


def test_simhash_fingerprint_agrees_with_spark(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64) == plain_simhash("A b C d", 4)


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    found = {(n, int(q)) for n, near in simhash.BKTree(values).within(values, 4) for q in near}
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= 4}
    assert found == want


def test_simhash_empty_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = simhash.near_duplicates(spark.createDataFrame([(4, "a"), (4, "a"), (None, "a")], "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id) for r in out) == [(0, 4), (4, 4), (4, 4)]  # a row without an id has its fingerprint's class


def test_near_duplicate_groups_are_verified(spark):
    rng = random.Random(2)
    base = [f"word{rng.randrange(10**6)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    half = base[:200] + [f"other{k}" for k in range(200)]
    texts = [" ".join(x) for x in (base, near, half, base)] + ["", None, "clean text of its own"]
    df = docs_of(spark, texts).withColumnRenamed("text", "text")
    groups = {r.id: r.group_id for r in simhash.similar_groups(df).collect()}
    assert groups == {0: 0, 1: 0, 3: 0, 4: 4, 5: 4}
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 2, 4, 6]


@pytest.mark.parametrize("shard, size", [(8192, 0), (7, 0), (7, 5000)])
def test_all_pairs_of_unlike_classes(spark, shard, size):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    values = base[rng.integers(0, 12, 200)] ^ (np.int64(1) << rng.integers(0, 63, 200)) ^ (np.int64(1) << rng.integers(0, 63, 200))
    of = rng.integers(0, 5, 200)
    nodes = spark.createDataFrame([(k, int(v), int(c)) for k, (v, c) in enumerate(zip(values, of))], "id long, fingerprint long, class long")
    want = sorted((a, b) for a in range(200) for b in range(a) if of[a] != of[b] and int(values[a] ^ values[b]).bit_count() <= 3)
    assert sorted(map(tuple, simhash.unlike(nodes, None, 3, shard, size).collect())) == want


@pytest.mark.parametrize("few", [1, 8])
def test_no_candidate_link_is_lost_among_look_alikes(spark, few, monkeypatch):
    """Families of look-alikes, most of them unlike enough: groups are what all verified candidates connect."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(7)
    texts = []
    for family in range(4):
        common = [f"f{family}c{k}" for k in range(60)]
        for a in range(12):
            own = [f"f{family}a{a}w{k}" for k in range(14)]
            for b in range(3):
                texts.append(" ".join(["x"] * 150 * (family % 2) + common + own + [f"f{family}a{a}b{b}w{k}" for k in range(3 + 2 * b)]))
    rng.shuffle(texts)
    prints = [[int(x) for x in row] for row in simhash._fingerprint(pa.array(texts), 5, simhash.TABLES)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            near = any((x ^ y).bit_count() <= simhash.RADIUS for x, y in zip(prints[a], prints[b]))
            if near and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {k: root(k) for k in range(len(texts)) if sum(root(j) == root(k) for j in range(len(texts))) > 1}
    assert len(set(want.values())) > 1
    assert {r.id: r.group_id for r in simhash.similar_groups(docs_of(spark, texts)).collect()} == want


# Suffix dedup


def plain_suffix(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def check_suffix(spark, texts, **args):
    got = suffix_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string"), **args).collect()
    want = plain_suffix(texts, args.get("length", 100))
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_suffix_dedup_matches_brute_force(spark, real):
    check_suffix(spark, real[:120] + [(9001, None), (9002, ""), (9003, "é" * 400), (9004, "ab" * 200), (9005, real[5][1][3:] + real[6][1])])


def test_suffix_dedup_on_repetitive_texts(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(5, 40))) for _ in range(6)]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for k in range(60)]
    check_suffix(spark, texts, length=30, gram=10)


@pytest.mark.parametrize("hot_segments", [1, 12])
def test_suffix_dedup_with_hot_minimizers(spark, real, hot_segments):
    """A phrase shorter than a window in ever new surroundings, partly repeated, dealt out window by window."""
    rng = random.Random(14)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(80))
    around = ["".join(rng.choice("klmnop ") for _ in range(60)) for _ in range(12)]
    texts = [(k, rng.choice(around)[rng.randrange(30):] + phrase + rng.choice(around)[:rng.randrange(60)]) for k in range(150)]
    check_suffix(spark, texts + [(1000 + d, t) for d, t in real[:40]], hot_segments=hot_segments)


def test_run_length_index_finds_repeated_windows():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 50))) for _ in range(30)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen, want = set(), set()
    for k, t in enumerate(texts):
        for a in range(len(t) - 7):
            if t[a : a + 8] in seen:
                want.add((k, a))
            seen.add(t[a : a + 8])
    text, at = suffix_dedup.repeated_windows(data, offs, 8)
    assert set(zip(text.tolist(), at.tolist())) == want


def test_suffix_dedup_without_rows_or_ids(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = suffix_dedup.dedup(spark.createDataFrame([(None, "x" * 300), (1, "x" * 300)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {None: 0, 1: 299} or {r.doc_id: r.n_removed for r in out}[None] == 0


# Decontamination


def plain_distance(pattern, text):
    """Least edit distance of the pattern to a substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        want = plain_distance(p, t)
        assert decontaminate.myers(decontaminate.masks(p), len(p), t, len(p))[0] == min(want, len(p) + 1)


def test_decontamination_matches_brute_force(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    rng = random.Random(7)
    texts = [(k, r.text[:600]) for k, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(20).collect())]
    for k, (_, item) in enumerate(bench):
        chars = list(item)
        for _ in range(k):
            chars[rng.randrange(len(chars))] = rng.choice("xyz ")
        texts.append((100 + k, f"start {''.join(chars).upper() if k % 2 else ''.join(chars)} end"))
    texts += [(200, None), (201, ""), (202, f"{bench[0][1]} and {bench[0][1]}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([*bench, (900, None), (901, "short"), (902, bench[1][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(df, items, block_chars=900).collect()}
    want = {}
    for d, t in texts:
        for i, item in [*bench, (902, bench[1][1])]:
            p = decontaminate.normalise(item)
            far = plain_distance(p, decontaminate.normalise(t or ""))
            if t and far <= len(p) // decontaminate.PER_EDIT:
                want[d, i] = far
    assert {k: r.distance for k, r in got.items()} == want
    for (d, i), r in got.items():
        place = decontaminate.normalise(dict(texts)[d])[r.start : r.end]
        assert plain_distance(decontaminate.normalise(dict([*bench, (902, bench[1][1])])[i]), place) == r.distance


def test_decontaminate_keeps_clean_rows(spark):
    df = spark.createDataFrame([(1, "all clean"), (None, "no id"), (2, "the quick brown fox jumps over it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quick brown  fox jumps over")], "item_id long, text string")
    assert {r.text for r in decontaminate.decontaminate(df, items).collect()} == {"all clean", "no id"}
    assert decontaminate.matches(df, items.limit(0)).count() == 0
