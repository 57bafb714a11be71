"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, durable

WORD = regex.compile(r"\w+")
#: Different labelled texts that a model is fitted on, about; of more, those whose hashes are low.
#: This alone bounds the model, whatever the input; every word and bigram of these texts counts.
LEARN = 20_000
#: Labels are joined by broadcast up to so many; beyond, both sides are shuffled.
LABELS = 2_000_000
#: Lengths of the beginnings of words that are counted, and the share of a beginning's words that
#: one longer beginning may have: a beginning that all but always goes on alike is no stem.
STEMS, ALIKE = range(3, 9), 0.9
#: A stem begins so many different words in its class.
KINDS = 4
#: Bins of the histogram of ratios from which probabilities are read.
BINS, REACH = 4096, 4.0
#: An expression is attested if twice the log-likelihood ratio of its counts in the two classes
#: against the classes' sizes is over twice the log of the number of expressions, plus this, and if
#: it is so many times likelier in one class. All others are smoothed to the shared counts.
MARGIN, STRONG = 4.0, 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ids_of(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Word ids, with 1 for any other word, after a 0 that stands for the start of the text."""
    return np.array([0, *(vocabulary.get(w, 1) for w in words(text))], np.int64)


@dataclass
class Model:
    """log p(word | toxic) - log p(word | plain) by the word and the one before it.

    words: by word id. keys, pairs: for attested bigrams by left * size + right, sorted. Every
    other bigram backs off to its word, a word that isn't attested to the longest attested stem
    that it begins with, kept in the vocabulary with a star, and other words to the counts that
    the classes share, where only the classes' backoff weights differ.
    """

    vocabulary: dict[str, int]
    size: int
    words: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray

    def __post_init__(self):
        self.heads = {w[: STEMS[0]] for w in self.vocabulary if w.endswith("*")}

    def stem(self, word: str) -> int:
        """The id of the longest stem that the word begins with, or 1."""
        if word[: STEMS[0]] in self.heads:
            for n in reversed(STEMS):
                found = self.vocabulary.get(word[:n] + "*")
                if found and len(word) >= n:
                    return found
        return 1

    def trimmed(self, stems: dict[str, float]) -> Model:
        """The same model with stems and only the words that matter: all others have one ratio."""
        rest = self.words[1]
        told = np.unique(np.concatenate([np.flatnonzero(self.words != rest), self.keys // self.size, self.keys % self.size]))
        told = told[told > 1]
        names = {k: w for w, k in self.vocabulary.items()}
        vocabulary = {names[int(k)]: j + 2 for j, k in enumerate(told)}
        number = lambda ids: np.where(ids > 1, np.searchsorted(told, ids) + 2, ids)
        size = len(told) + 2
        keys = number(self.keys // self.size) * size + number(self.keys % self.size)
        vocabulary |= {f"{stem}*": size + j for j, stem in enumerate(stems)}
        ratios = np.concatenate([self.words[:2], self.words[told], np.array([*stems.values()], float)])
        out = Model(vocabulary, size, ratios, keys, self.pairs)
        for j, k in enumerate(told):  # those that only matter in bigrams
            if self.words[k] == rest:
                ratios[j + 2] = ratios[out.stem(names[int(k)])]
        return out

    def ratio(self, text: str | None) -> float:
        """The mean over the words; 0 without words."""
        get, stem = self.vocabulary.get, self.stem
        ids = np.array([0, *(get(w) or stem(w) for w in words(text))], np.int64)
        left, right = ids[:-1], ids[1:]
        if not len(left):
            return 0.0
        ratio = self.words[right]
        if len(self.keys):
            plain = np.where(ids < self.size, ids, 1)  # a stem is another word to a bigram
            keys = plain[:-1] * self.size + plain[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ratio = np.where(self.keys[at] == keys, self.pairs[at], ratio)
        return float(ratio.mean())


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.3, once / (once + 2 * twice))) if once else 0.75


def evidence(n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of counts n, (2, expressions), against the classes' totals."""
    share = totals / max(1, totals.sum())
    mean = n.sum(axis=0) * share[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(n > 0, n * np.log(n / mean), 0.0).sum(axis=0)


def word_ratios(before: np.ndarray, totals: np.ndarray | None = None, kept: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, (2, words) probabilities) from before: numbers of different words before each, by class.

    totals: the sums over all words, if some aren't here. The first `kept` are never attested.

    An attested word has its class's Kneser-Ney estimate, which gives what the discounts leave to
    the shared continuation counts; the others have the shared estimate, scaled to what is left.
    """
    before = before.astype(float)
    totals = before.sum(axis=1) if totals is None else totals.astype(float)
    shared = (before.sum(axis=0) + 0.5) / (before.sum() + 0.5 * before.shape[1])
    if not totals.all():
        return np.zeros(before.shape[1]), np.tile(shared, (2, 1))
    few = [discount(int((b == 1).sum()), int((b == 2).sum())) for b in before]
    left = [d * (b > 0).sum() / t for d, b, t in zip(few, before, totals)]
    own = np.array([np.maximum(b - d, 0) / t + r * shared for b, d, t, r in zip(before, few, totals, left)])
    attested = evidence(before, totals) > 2 * math.log(max(2, before.shape[1])) + MARGIN
    attested &= np.abs(np.log(own[1]) - np.log(own[0])) > math.log(STRONG)
    attested[:kept] = False  # the start and words that aren't kept
    rest = np.maximum(1e-3, 1 - own[:, attested].sum(axis=1)) / max(1e-3, 1 - shared[attested].sum())
    p = np.where(attested, own, shared * rest[:, None])
    return np.log(p[1]) - np.log(p[0]), p


def stem_ratios(stems: list[str], n: np.ndarray, kinds: np.ndarray, totals: np.ndarray) -> dict[str, float]:
    """Ratios of the stems among beginnings of words.

    n, kinds: (2, beginnings) words, and different words, of each class that begin so; totals: the
    words of each class. A stem is attested as a word is, is STRONG times likelier in one class,
    begins at least KINDS different words there, and no single longer beginning has ALIKE of them.
    """
    if not stems or not totals.all():
        return {}
    ratios, _ = word_ratios(n, totals, 0)
    side, places = (ratios > 0).astype(int), np.arange(len(stems))
    told = evidence(n.astype(float), totals.astype(float)) > 2 * math.log(max(2, len(stems))) + MARGIN
    told &= np.abs(ratios) > math.log(STRONG)
    # The larger class has bursts of one word that the other never saw; its different words must tell, too.
    told &= (totals[side] <= totals[1 - side]) | (evidence(kinds.astype(float), kinds.sum(axis=1).astype(float)) > 2 * math.log(max(2, len(stems))) + MARGIN)
    most: Counter = Counter()
    for k, stem in enumerate(stems):
        for c in (0, 1):
            most[stem[:-1], c] = max(most[stem[:-1], c], int(kinds[c, k]))
    chosen = np.flatnonzero(told & (kinds[side, places] >= KINDS))
    return {stems[k]: float(ratios[k]) for k in chosen if most[stems[k], side[k]] < ALIKE * kinds[side[k], k]}


def pair_ratios(keys: np.ndarray, n: np.ndarray, size: int, follow: np.ndarray, types: np.ndarray, totals: np.ndarray, kinds: int, few: list[float], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ratios of the attested bigrams: Kneser-Ney estimates that back off to the class's words.

    n: (2, bigrams) numbers of different words before each; follow, types: (2, words) sums and numbers of the bigrams that begin so;
    totals, kinds: the sums of all bigrams by class, and their number.
    """
    order = np.argsort(keys)
    keys, n = keys[order], n[:, order].astype(float)
    left, right = keys // size, keys % size
    ahead = follow[:, left].astype(float)  # a bigram must stand out among those that begin like it, too
    expected = ahead * (p[:, right] / p[:, right].mean(axis=0))
    told = np.minimum(evidence(n, totals.astype(float)), _within(n, expected))
    chosen = (told > 2 * math.log(max(2, kinds)) + MARGIN) & (ahead > 0).all(axis=0)
    keys, n, left, right, ahead = keys[chosen], n[:, chosen], left[chosen], right[chosen], ahead[:, chosen]
    own = [(np.maximum(n[c] - few[c], 0) + few[c] * types[c][left] * p[c][right]) / ahead[c] for c in (0, 1)]
    ratios = np.log(np.maximum(own[1], 1e-12)) - np.log(np.maximum(own[0], 1e-12))
    strong = np.abs(ratios) > math.log(STRONG)
    return keys[strong], ratios[strong]


def _within(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """evidence against shares that differ by expression."""
    share = expected / np.maximum(1e-12, expected.sum(axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(n > 0, n * np.log(n / np.maximum(1e-12, n.sum(axis=0) * share)), 0.0).sum(axis=0)


def rising(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence to share, weighted (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for s, w in zip(share, weight):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            s2, w2, n2 = blocks.pop()
            s1, w1, n1 = blocks[-1]
            blocks[-1] = [(s1 * w1 + s2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Calibration:
    """Probability of label 1 by ratio: level over each block of the rising fit, linear between blocks."""

    at: np.ndarray
    share: np.ndarray

    @classmethod
    def fit(cls, bins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> Calibration:
        if not len(bins):
            return cls(np.array([-REACH, REACH]), np.array([0.0, 0.0]))
        order = np.argsort(bins)
        centre = (bins[order] + 0.5) / BINS * 2 * REACH - REACH
        n, ones = n[order].astype(float), ones[order].astype(float)
        share = rising(ones / n, n)
        starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        stops = np.append(starts[1:], len(share)) - 1
        weights = np.add.reduceat(n, starts)
        level = (share[starts] * weights + 0.01) / (weights + 0.02)
        at, levels = np.column_stack([centre[starts], centre[stops]]).ravel(), np.repeat(level, 2)
        return cls(np.r_[-REACH, at, REACH], np.r_[level[0] / 2, levels, (1 + level[-1]) / 2])

    def __call__(self, ratio: np.ndarray) -> np.ndarray:
        return np.interp(ratio, self.at, self.share)


def _labelled(docs: DataFrame, labels: DataFrame, held_out, learn: int) -> DataFrame:
    """(text, label) of about `learn` different texts, or all, of the documents that may be learned from."""
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    marks = marks.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.where(~held_out("doc_id"))
    if marks.count() <= LABELS:
        marks = F.broadcast(marks)  # checked just above
    rows = docs.select("doc_id").join(marks, "doc_id").count()
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(marks, "doc_id")
    if rows > learn:
        found = found.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)) < int((1 << 40) * learn / rows))
    # Copies are one text, so a hot group of them is combined before anything is shuffled.
    found = found.groupBy(F.md5("text").alias("key"), "label").agg(F.min("text").alias("text"))
    return durable(found.select("text", "label"))


def train(rows: DataFrame) -> tuple[Model, Calibration]:
    """A model from (text, label), over all rows, of which there are a bounded number. Words, beginnings and bigrams that come again reach the driver."""
    spark = rows.sparkSession

    def count_words(part: pa.RecordBatch) -> dict:
        sides: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(part.column(0), part.column(1)):
            sides[label.as_py() == 1].update(words(text.as_py()))
        every = sides[0] | sides[1]
        return {"word": list(every), "plain": [sides[0][w] for w in every], "toxic": [sides[1][w] for w in every]}

    schema = "word string, plain long, toxic long"
    counted = rows.mapInArrow(batches(count_words, schema), schema).groupBy("word").agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
    counted = counted.persist()
    sums = counted.agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic")).first()
    kept = counted.where((F.col("plain") >= 2) | (F.col("toxic") >= 2)).select("word")
    vocabulary = {w: k + 2 for k, w in enumerate(sorted(kept.toArrow().column(0).to_pylist()))}
    lengths = F.expr(f"sequence({STEMS[0]}, least({STEMS[-1]}, length(word)))")
    begin = F.explode(F.transform(lengths, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem")
    begun = counted.where(F.length("word") >= STEMS[0]).select(begin, "plain", "toxic")
    kinds = [F.sum((F.col(c) > 0).cast("long")) for c in ("plain", "toxic")]
    begun = begun.groupBy("stem").agg(F.sum("plain").alias("n0"), F.sum("toxic").alias("n1"), kinds[0].alias("k0"), kinds[1].alias("k1")).persist()
    tokens = np.array([sums["plain"] or 0, sums["toxic"] or 0])
    common = begun.where((F.col("n0") >= 4) | (F.col("n1") >= 4)).toArrow()
    columns = [common.column(c).to_numpy() for c in ("n0", "n1", "k0", "k1")]
    stems = stem_ratios(common.column("stem").to_pylist(), np.array(columns[:2]), np.array(columns[2:]), tokens)
    begun.unpersist()
    counted.unpersist()
    size = len(vocabulary) + 2
    known = spark.sparkContext.broadcast(vocabulary)

    def trigrams(part: pa.RecordBatch) -> dict:
        """Which runs of three words each class has."""
        out: tuple[list, list, list] = ([], [], [])
        label = np.asarray(part.column(1).to_pylist())
        for side in (0, 1):
            texts = [ids_of(part.column(0)[int(k)].as_py(), known.value) for k in np.flatnonzero((label == 1) == side)]
            keys = [(np.append(0, ids[:-2]) * size + ids[:-1]) * size + ids[1:] for ids in texts if len(ids) > 1]
            keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
            for column, values in zip(out, (keys, np.full(len(keys), 1 - side), np.full(len(keys), side))):
                column.append(values)
        return dict(zip(("key", "n0", "n1"), map(np.concatenate, out)))

    # A bigram counts once for each different word before it, so copies of a text add nothing.
    schema = "key long, n0 int, n1 int"
    seen = rows.mapInArrow(batches(trigrams, schema), schema).groupBy("key").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    bigrams = seen.groupBy((F.col("key") % (size * size)).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    kinds = [F.sum((F.col(c) > 0).cast("long")) for c in ("n0", "n1")]
    few = [F.sum((F.col(c) == k).cast("long")) for c in ("n0", "n1") for k in (1, 2)]
    total = [x or 0 for x in bigrams.agg(F.sum("n0"), F.sum("n1"), F.count("*"), *few).first()]

    def by_word(word: str, sums: list) -> np.ndarray:
        """(len(sums), words): sums by one of the bigrams' two words."""
        out = np.zeros((len(sums), size), np.int64)
        got = bigrams.groupBy(F.expr(word).alias("word")).agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)]).toArrow()
        out[:, got.column("word").to_numpy()] = [got.column(f"x{k}").to_numpy() for k in range(len(sums))]
        return out

    ratios, p = word_ratios(by_word(f"key % {size}", kinds))
    left = by_word(f"key div {size}", [F.sum("n0"), F.sum("n1"), *kinds])
    often = bigrams.where((F.col("n0") >= 2) | (F.col("n1") >= 2)).toArrow()
    n = np.array([often.column("n0").to_numpy(), often.column("n1").to_numpy()])
    discounts = [discount(total[3], total[4]), discount(total[5], total[6])]
    keys, pairs = pair_ratios(often.column("key").to_numpy(), n, size, left[:2], left[2:], np.array(total[:2]), total[2], discounts, p)
    bigrams.unpersist()
    known.unpersist()
    model = Model(vocabulary, size, ratios, keys, pairs).trimmed(stems)
    shared = spark.sparkContext.broadcast(model)

    def ratios_of(part: pa.RecordBatch) -> dict:
        ratio = np.array([shared.value.ratio(t.as_py()) for t in part.column(0)])
        return {"bin": np.clip((ratio + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int32), "label": part.column(1)}

    schema = "bin int, label int"
    histogram = rows.withColumn("label", (F.col("label") == 1).cast("int")).mapInArrow(batches(ratios_of, schema), schema)
    got = histogram.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).toArrow()
    return model, Calibration.fit(*(got.column(c).to_numpy() for c in ("bin", "n", "ones")))


def held_out(column: str):
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, learn: int = LEARN) -> DataFrame:
    """docs with held_out, score and predicted (these replace columns of the same names).

    A text's score is the probability of label 1 at its ratio, the mean over its words of
    log p(word | toxic) - log p(word | plain). The probabilities come from the labelled texts by
    a rising fit over a histogram of their ratios. Labels of
    held-out ids are not read. Null and empty texts have ratio 0 and the score that goes with
    it. A repeated id keeps all its rows; of its labels the highest counts. Without labels all
    scores are near 0. Whole texts are read, in training as in scoring. The model is fitted on
    about `learn` different labelled texts, chosen by hash, or on all if there are fewer.
    """
    model, calibration = train(_labelled(docs, labels, held_out, learn))
    shared = docs.sparkSession.sparkContext.broadcast((model, calibration))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, calibration = shared.value
        for part in parts:
            yield pa.array(calibration(np.array([model.ratio(t.as_py()) for t in part], np.float64)), pa.float64())

    # Only texts go to Python and only scores come back. Called once a row even if score is used twice.
    score = F.arrow_udf(run, "double").asNondeterministic()
    scored = docs.select(*kept).withColumn("score", score(F.col("text").cast("string")))
    return scored.withColumn("held_out", held_out("doc_id")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
