from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines string, _of int"


def brute(rows, ratio, least):
    pages, on = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        on.update({(host, x) for x in (text or "").split("\n") if x.strip()})
    out = []
    for doc, text, host in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (on[host, x] >= least and on[host, x] > ratio * pages[host])]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    draw = np.random.default_rng(0)
    common = defaultdict(list)
    for host in ("a", "b", None, ""):
        common[host] = [f"{host} boiler {k}" for k in range(4)]
    rows = []
    for k in range(300):
        host = ["a", "b", None, "", "a", "a"][k % 6]
        lines = [f"line {k} {j}" for j in range(int(draw.integers(0, 5)))] + list(draw.choice(common[host], int(draw.integers(0, 4)))) + ["", "  ", "rare"] * int(draw.integers(0, 2))
        draw.shuffle(lines)
        rows.append((k, "\n".join(lines), host))
    return [*rows, (1, None, "a"), (2, "", None), (3, "\n\n", "a"), (4, "x" * 200_000, "b"), *[(5, "same\nsame", "c")] * 7]


@pytest.mark.parametrize("ratio,least,bound", [(0.02, 5, 32 << 20), (0.3, 2, 0), (0.0, 1, 0)])
def test_agrees_with_counting(spark, monkeypatch, ratio, least, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST", bound)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = line_dedup.drop_boilerplate(docs, ratio=ratio, min_pages=least).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(rows, ratio, least)


def test_no_documents(spark):
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_copies_do_not_make_their_lines_boilerplate(spark):
    """A third of the rows are copies of one document; the pipeline's stage takes only the line of many texts."""
    import corpus_pipeline

    rows = [(k, f"menu\nonly {k}\nand {k}", "en", "a", 1) for k in range(40)] + [(100 + k, "first of all\nsecond", "en", "a", 1) for k in range(20)]
    rows += [(200 + k, None, "en", "a", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {i: t and t.removeprefix("menu\n") for i, t, *_ in rows}
    counted = line_dedup.drop_boilerplate(docs, distinct_texts=True, ratio=0.97, min_pages=40).collect()
    assert sum(r.n_dropped for r in counted) == 0  # 40 of 42 different pages, the null one included
