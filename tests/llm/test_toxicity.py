import zlib

import numpy as np
import pytest

from lattica.llm import toxicity

BAD = ["trash", "idiot", "scum", "moron"]


def corpus(n=600, seed=0):
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    weights = 1 / np.arange(1, 3001)
    docs, labels = [], []
    for k in range(n):
        words = list(draw.choice(vocabulary, int(draw.integers(5, 120)), p=weights / weights.sum()))
        toxic = bool(draw.random() < 0.15)
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(int(draw.integers(len(words) + 1)), str(draw.choice(BAD)))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    made = toxicity.toxicity_scores(frame, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int"))
    return made.toPandas().set_index("doc_id"), docs, labels


def test_held_out_accuracy(scored):
    frame, docs, labels = scored
    truth = {i: y for i, _, y in labels}
    for i, _ in docs:
        assert frame.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = frame[frame.held_out]
    assert ((held.predicted == 1) == [truth[i] == 1 for i in held.index]).mean() > 0.97
    assert frame.score.between(0, 1).all()


def test_labels_of_held_out_rows_are_not_read(spark, scored):
    frame, docs, labels = scored
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels if i % 5]
    again = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    assert np.allclose(again.loc[frame.index].score, frame.score)


def test_edge_cases(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "idiot " * 20000, "c"), (4, "x y", "d")], "doc_id long, text string, held_out string")
    for given in ([], [(1, 1, 1)], [(4, None, None), (None, 1, 1)], [(1, 1, 1), (4, 1, 0)]):
        made = toxicity.toxicity_scores(docs, spark.createDataFrame(given, labels)).collect()
        assert len(made) == 4 and all(0 <= r.score <= 1 for r in made)
    assert toxicity.toxicity_scores(docs.where("false"), spark.createDataFrame([(1, 1, 1)], labels)).count() == 0


def test_rising():
    assert toxicity.rising(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 1, 1])).tolist() == [0.1, 0.4, 0.4, 0.9]


def test_word_probabilities_sum_to_one():
    before = np.array([[0, 50, 1, 2, 400, 0, 3], [0, 40, 0, 2, 0, 300, 2]])
    _, p = toxicity.word_ratios(before)
    assert np.allclose(p.sum(axis=1), 1, atol=0.02)


def test_stems():
    names = ["grumo", "grumoa", "grumob", "grumoc", "grumod", "the", "them", "then", "once"]
    n = np.array([[0, 0, 0, 0, 0, 900, 300, 300, 0], [200, 50, 50, 50, 50, 90, 30, 30, 200]])
    kinds = np.array([[0, 0, 0, 0, 0, 9, 1, 1, 0], [5, 1, 1, 1, 1, 9, 1, 1, 1]])
    assert set(toxicity.stem_ratios(names, n, kinds, np.array([90_000, 10_000]))) == {"grumo"}
    assert toxicity.stem_ratios([], n[:, :0], kinds[:, :0], np.array([1, 1])) == {}
    model = toxicity.Model({"bad": 2, "grumo*": 3}, 3, np.array([0.0, -0.1, 5.0, 7.0]), np.empty(0, np.int64), np.empty(0))
    assert model.ratio("bad grumox grum word") == pytest.approx((5 + 7 - 0.1 - 0.1) / 4)
    assert model.ratio("") == 0.0


def test_pairs_need_more_than_their_words():
    size, words = 200, np.array([[10, 0, *[400] * 198], [10, 0, *[40] * 198]])
    _, p = toxicity.word_ratios(words)
    keys = np.array([2 * size + 3, 4 * size + 5, 2 * size + 5])
    n = np.array([[2, 200, 0], [60, 20, 2]])
    got, ratios = toxicity.pair_ratios(keys, n, size, words * 3, words, np.array([200_000, 20_000]), 1000, [0.75, 0.75], p)
    assert got.tolist() == [2 * size + 3] and ratios[0] > np.log(20)


def brute_ratios(texts):
    """Kneser-Ney word ratios by plain loops over (text, label)."""
    tokens = {c: [toxicity.words(t) for t, label in texts if label == c] for c in (0, 1)}
    counts = {c: {} for c in (0, 1)}
    for c in (0, 1):
        for text in tokens[c]:
            for w in text:
                counts[c][w] = counts[c].get(w, 0) + 1
    kept = {w for c in (0, 1) for w, n in counts[c].items() if n >= 2}
    pairs = {c: {} for c in (0, 1)}  # bigrams, with the different words before each
    for c in (0, 1):
        for text in tokens[c]:
            run = ["<s>", "<s>", *(w if w in kept else "<other>" for w in text)]
            for a, b, w in zip(run, run[1:], run[2:]):
                pairs[c].setdefault((b, w), set()).add(a)
    before = {c: {} for c in (0, 1)}
    for c in (0, 1):
        for _, w in pairs[c]:
            before[c][w] = before[c].get(w, 0) + 1
    names = ["<s>", "<other>", *sorted(kept)]
    n = {c: [before[c].get(w, 0) for w in names] for c in (0, 1)}
    total = {c: sum(n[c]) for c in (0, 1)}
    shared = [(n[0][k] + n[1][k] + 0.5) / (total[0] + total[1] + 0.5 * len(names)) for k in range(len(names))]
    own, told = {0: {}, 1: {}}, []
    for c in (0, 1):
        once, twice = sum(x == 1 for x in n[c]), sum(x == 2 for x in n[c])
        d = min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.75
        left = d * sum(x > 0 for x in n[c]) / total[c]
        own[c] = [max(x - d, 0) / total[c] + left * s for x, s in zip(n[c], shared)]
    for k in range(2, len(names)):
        mean = [(n[0][k] + n[1][k]) * total[c] / (total[0] + total[1]) for c in (0, 1)]
        g = 2 * sum(n[c][k] * np.log(n[c][k] / mean[c]) for c in (0, 1) if n[c][k])
        if g > 2 * np.log(len(names)) + toxicity.MARGIN and abs(np.log(own[1][k] / own[0][k])) > np.log(toxicity.STRONG):
            told.append(k)
    rest = [(1 - sum(own[c][k] for k in told)) / (1 - sum(shared[k] for k in told)) for c in (0, 1)]
    ratio = {w: np.log(rest[1] / rest[0]) for w in names}
    return ratio | {names[k]: np.log(own[1][k] / own[0][k]) for k in told}, [names[k] for k in told]


def test_model_agrees_with_brute_force(spark):
    docs, labels = corpus(400, 3)
    texts = [(t, y) for (_, t), (_, _, y) in zip(docs, labels)]
    model, _ = toxicity.train(spark.createDataFrame(texts, "text string, label int"))
    want, told = brute_ratios(texts)
    assert told and set(told) <= set(model.vocabulary)
    for word in [*told, "w1", "w77", "neverseen"]:
        if model.stem(word) == 1:
            assert model.words[model.vocabulary.get(word, 1)] == pytest.approx(want.get(word, want["<other>"]))


def test_a_bounded_sample(spark):
    docs, labels = corpus(600)
    frame = spark.createDataFrame(docs * 3, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = toxicity._labelled(frame, marks, toxicity.held_out, 300).count()
    assert 40 < learned < 200  # a sixth of the rows, copies once
    assert toxicity._labelled(frame, marks, toxicity.held_out, 5000).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in docs)
    held = toxicity.toxicity_scores(frame, marks, learn=900).where("held_out").toPandas()
    truth = {i: y for i, _, y in labels}
    assert ((held.predicted == 1) == [truth[i] == 1 for i in held.doc_id]).mean() > 0.95
