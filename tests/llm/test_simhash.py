import re

import numpy as np
import pytest
import xxhash

from lattica.llm import simhash


def brute_print(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, " \t\n", "one", "Two words", "ÄB c D e F", "a b c d", "a b c d a b c d a b c d", "x" * 5000, " ".join(f"w{k}" for k in range(3000)), "nul\x1cl b c d e"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [brute_print(text)]


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    whole = simhash.fingerprint(text, parts=2)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, parts=2) == whole


@pytest.mark.parametrize("parts,radius", [(1, 4), (2, 20)])
def test_close_pairs_are_all_pairs(parts, radius):
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, (600, parts), dtype=np.int64).astype(np.uint64)
    for k in range(200):
        a[k] = a[0] ^ (np.uint64(1) << draw.integers(0, 64, parts).astype(np.uint64))
    b = a[::3].copy()
    got = {(int(i), int(j)) for I, J in simhash.close_pairs(a, b, radius) for i, j in zip(I, J)}
    bits = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(bits <= radius))))


def brute_components(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus():
    draw = np.random.default_rng(2)
    vocabulary = [f"v{k}" for k in range(400)]
    texts = [" ".join(draw.choice(vocabulary, n)) for n in draw.integers(1, 200, 60)]
    for k in range(60):
        words = texts[k].split()
        words[int(draw.integers(len(words)))] = "changed"
        texts.append(" ".join(words))
    return [*texts, *texts[:20], "", None, "", "a", "A"]


@pytest.mark.parametrize("tile_rows", [5, 8192])
def test_components_agree_with_all_pairs(spark, tile_rows):
    texts = corpus()
    rows = [(1000 - 7 * k, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string, f0 int")
    got = {r.id: (r.f0, r.component) for r in simhash.near_duplicates(docs, tile_rows=tile_rows).collect()}
    prints = {i: brute_print(t) for i, t, _, _ in rows}
    assert {i: v[0] & (1 << 64) - 1 for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == brute_components(prints)


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None)], schema)
    assert sorted((r.id, r.component) for r in simhash.near_duplicates(docs).collect() if r.id) == [(3, 3), (3, 3)]
    assert all(r.component is None for r in simhash.near_duplicates(docs).collect() if r.id is None)
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "None", "None"]


@pytest.mark.parametrize("bound", [0, 100])
def test_keep_one_by_similarity(spark, monkeypatch, bound):
    monkeypatch.setattr(simhash, "DROPPED", bound)
    draw = np.random.default_rng(4)
    words = [f"w{k}" for k in draw.integers(0, 5000, 400)]
    near = words.copy()
    near[200] = "other"  # 5 of 396 shingles
    rows = [(5, " ".join(words)), (9, " ".join(near)), (11, " ".join(words)), (12, " ".join(draw.permutation(words))), (13, "short"), (14, "text")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 12, 13, 14]


def brute_kept(rows, words=5, least=0.8):
    """The smallest id of each group over pairs of exact similarity."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def varied():
    """Texts with partners at similarities from 0.5 to 1, and ones with a much-repeated word."""
    draw = np.random.default_rng(7)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in draw.integers(0, 4000, int(draw.integers(8, 300)))]
        rows.append(" ".join(words))
        for _ in range(3):
            near = words.copy()
            for at in draw.integers(0, len(words), max(1, int(len(words) * draw.uniform(0, 0.06)))):
                near[int(at)] = f"c{draw.integers(1000)}"
            rows.append(" ".join(near))
    rows += [" ".join(["again"] * 300 + [f"q{x}" for x in draw.integers(0, 4000, 80)]) for _ in range(6)]
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("group", [1 << 21, 300])
def test_keep_one_is_by_exact_similarity(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rows = varied()
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_keep_one_leaves_texts_that_only_fingerprints_link(spark):
    """One much-repeated line fills the fingerprint of the repeated shingles, at a Jaccard similarity under 0.1."""
    draw = np.random.default_rng(3)
    rows = [(k, "on and on and on it goes " * 200 + " ".join(f"w{x}" for x in draw.integers(0, 9000, 90))) for k in range(4)]
    prints = [simhash.fingerprint(t, 5, 2) for _, t in rows]
    assert sum((x ^ y).bit_count() for x, y in zip(prints[0], prints[1])) <= 26
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]


def test_empty_text_links_only_with_empty_texts(spark):
    """Of many six-word texts, whose fingerprints are often near zero, none goes for an empty text or another six words."""
    draw = np.random.default_rng(6)
    rows = [(1, ""), (2, " "), (3, None)] + [(10 + k, " ".join(f"w{x}" for x in draw.integers(0, 9000, 6))) for k in range(60)]
    assert any(sum(x.bit_count() for x in simhash.fingerprint(t, 5, 2)) <= 26 for _, t in rows[3:])
    rows += [(500, rows[5][1].upper()), (501, "one two"), (502, "one three")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, *range(10, 70), 501, 502]


def test_keep_one_with_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = b.replace("b59", "other")
    rows = [(3, a), (5, a), (5, b), (7, near), (8, "x y"), (8, "X  y"), (None, a), (None, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (8, "X  y"), (None, a), (None, a)], key=repr)
