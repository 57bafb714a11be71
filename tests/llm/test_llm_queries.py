import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA, same
from test_simhash import brute_kept
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_covers_its_table(spark, name):
    table = "pages" if "html" in name else "documents"
    key = "page_id" if "html" in name else "doc_id"
    got = queries.QUERIES[name](spark, str(DATA))
    assert got.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())


def brute_lines(rows):
    """Texts without the lines that are on over a fiftieth, and five, of their source's different texts."""
    texts = {(r["source"], r["text"]) for r in rows}
    pages = Counter(source for source, _ in texts)
    on = Counter((source, line) for source, text in texts for line in {x for x in (text or "").split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)})
    gone = {k for k, n in on.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    return [None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in gone) for r in rows]


def check_packing(docs, packed):
    """Every text's ids, whole and in order, in sequences without gaps that are about as few as their total length allows."""
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    total = 0
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, piece in enumerate(sorted(pieces.pop(r["doc_id"]), key=lambda p: p["piece"])):
            assert (piece["piece"], piece["start"]) == (k, at) and 0 < piece["length"] <= 2048
            assert piece["ids_crc32"] == zlib.crc32(np.array(ids[at : at + piece["length"]], "<u4").tobytes())
            at += piece["length"]
        assert at == len(ids)
    assert not pieces
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= max(-(-total // 2048) * 1.03 + 1, sum(2 * n > 2048 for s in sequences.values() for _, n in s))


def hold_stages(spark, docs, folder):
    """Each stage against plain Python, on what the stage before it gave; the rows of the whole run against the last."""
    plain = lambda frame: [r.asDict() for r in frame.collect()]
    key = lambda r: repr(sorted(r.items(), key=repr))
    scores = toxicity.toxicity_scores(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {(r.doc_id, r.text) for r in scores if r.score >= 0.3}
    before = plain(docs)
    first = plain(corpus_pipeline.reject_toxic(spark, docs, folder))
    assert sorted(map(key, first)) == sorted(key(r) for r in before if (r["doc_id"], r["text"]) not in bad)
    frame = spark.createDataFrame(first, docs.schema)
    second = plain(corpus_pipeline.drop_lines(spark, frame, folder))
    want = [r | {"text": t, "n_chars": None if t is None else len(t)} for r, t in zip(first, brute_lines(first))]
    assert sorted(map(key, second)) == sorted(map(key, want))
    frame = spark.createDataFrame(second, docs.schema)
    third = plain(corpus_pipeline.keep_one_copy(spark, frame, folder))
    assert list(frame.columns) == list(third[0]) == list(docs.columns)
    left = Counter(map(key, second))
    left.subtract(map(key, third))
    assert min(left.values()) >= 0  # rows as they were
    return second, third


def test_pipeline_by_stages(spark):
    """Near copies are held against the exact similarity of five-word shingles."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    second, third = hold_stages(spark, docs, str(DATA))
    assert sorted(r["doc_id"] for r in third) == brute_kept([(r["doc_id"], r["text"]) for r in second])
    clean = [r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()]
    lost = set(clean) - {r["doc_id"] for r in second}
    assert len(lost) <= 0.01 * len(clean)
    ran = [r.asDict() for r in corpus_pipeline.run(spark, str(DATA)).collect()]
    assert {r["doc_id"] for r in ran} == {r["doc_id"] for r in third}
    check_packing(third, ran)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and ids, columns named as those of the stages."""
    long = " ".join(f"w{k}" for k in range(20_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, component string, _s string"
    rows = [
        (1, "a b c d e f g", "en", "s", 13, "x", 1, "c", "s"), (2, "A b c d e f g", None, "s", 13, "y", 2, None, None), (3, "", None, None, None, None, None, None, None),
        (4, None, None, None, None, None, None, None, None), (5, long, "en", "s", 1, None, 5, None, None), (6, long + " end", "en", "t", 1, None, 6, None, None),
        (7, "one\ntwo\n three", "en", "s", 1, None, 7, None, None), (7, "one\ntwo\n three", "en", "s", 1, None, 7, None, None), (7, "another text of that id", "en", "s", 1, None, 8, None, None),
        (None, "no id", None, "s", None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    _, third = hold_stages(spark, docs, str(tmp_path))
    kept = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in third), key=repr)
    want = [(1, "a b c d e f g"), (3, ""), (5, long[:20]), (7, "another text of that"), (7, "one\ntwo\n three"), (None, "no id"), (None, "")]
    assert kept == sorted(want, key=repr)
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in ran} == {i for i, _ in want}


def test_pipeline_without_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
