import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import packing
from lattica.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def best(items, room):
    """The least number of bins, by trying all."""
    items = sorted(items, reverse=True)
    least = [len(items)]

    def go(k, bins):
        if len(bins) >= least[0]:
            return
        if k == len(items):
            least[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= room:
                rest = list(bins)
                rest.remove(b)
                go(k + 1, (*rest, b + items[k]))
        go(k + 1, (*bins, items[k]))

    go(0, ())
    return least[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_a_best_packing(seed):
    draw = random.Random(seed)
    room = draw.choice([10, 20, 50])
    items = [draw.randint(max(1, room // draw.choice([2, 4, 10])), room) for _ in range(draw.randint(1, 9))]
    fixed, rest = packing.reduce(Counter(items), room)
    assert all(sum(s) <= room for s, _ in fixed)
    placed = Counter()
    for s, times in fixed:
        for n in s:
            placed[n] += times
    assert placed + Counter(rest) == Counter(items)
    left = list(Counter(rest).elements())
    assert sum(t for _, t in fixed) + best(left, room) == best(items, room)


def plain_best_fit(items, room):
    bins = []
    for n in sorted(items, reverse=True):
        fits = [k for k, b in enumerate(bins) if b >= n]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(room - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_by_length_is_best_fit(seed):
    draw = random.Random(seed)
    items = [draw.randint(1, 30) for _ in range(draw.randint(0, 300))]
    made = packing.best_fit(Counter(items), 30)
    assert sorted(itertools.chain.from_iterable([30 - sum(c)] * n for c, n in made)) == plain_best_fit(items, 30)


def texts():
    draw = random.Random(3)
    words = ["alpha", " beta", " gamma", "\n", " 12", "é", "<|endoftext|>", "😀", "   "]
    out = ["".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(200)]
    return [*out, "", None, "x " * 3000, "a" * 100_000, *["same text"] * 80]


def test_pack(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(k, t, -1) for k, t in enumerate(texts())]
    room = 64
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, room).toPandas()
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == doc].sort_values("piece")
        assert mine.length.tolist() == packing.cut(len(ids), room)
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]]
        assert mine.piece.tolist() == list(range(len(mine)))
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(mine.start, mine.length)]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= room
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / room) + 1


def test_sequences_hold_the_ids(spark):
    rows = [(1, "hello world"), (2, "hello"), (2, "hello"), (None, "x"), (3, None)]
    made = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 16).collect()
    encode = packing.byte_bpe(PATH)
    want = Counter(tuple([*map(int, encode(t or "")), 0]) for _, t in rows)
    got = Counter()
    for r in made:
        at = 0
        for n in r.lengths:
            got[tuple(r.ids[at : at + n])] += 1
            at += n
    assert got == want


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_texts_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    from lattica.llm.common import BATCH, batches

    log = str(tmp_path / "log")

    def watched(f, schema):
        inside = batches(f, schema)

        def run(parts):
            def noted():
                for part in parts:
                    with open(log, "a") as out:
                        out.write(f"{part.num_rows} {part.nbytes}\n")
                    yield part

            yield from inside(noted())

        return run

    monkeypatch.setattr(packing, "batches", watched)
    settings = dict(spark.conf.getAll)
    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", "repeat('eight by ', 1000) AS text")
    assert packing.pack(docs, PATH).select("doc_id").distinct().count() == 1500
    rows, size = np.loadtxt(log, int).T
    assert rows.sum() == 1500 and size.max() < BATCH + 20_000
    assert dict(spark.conf.getAll) == settings
