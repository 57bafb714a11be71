import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import sharding


def check(rows, made, shards, slack):
    frame = made.toPandas()
    assert len(frame) == len(rows)
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert [size[i] for i in frame.doc_id] == frame["size"].tolist()
    for _, s in frame.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    sums = frame.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sums.max() - sums.min() <= slack
    return frame


@pytest.mark.parametrize("partitions", [4, 40])
def test_sizes_are_near_equal(spark, partitions):
    draw = np.random.default_rng(0)
    rows = [(k, "x" * int(n)) for k, n in enumerate(draw.integers(0, 300, 700))] + [(1000 + k, "copy of a text") for k in range(500)] + [(5000, "é" * 400), (5001, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = check(rows, sharding.shard(spark.createDataFrame([(*r, 1.5, -1) for r in rows], "doc_id long, text string, size double, shard int")), 16, 2 * 801)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    copies = frame[frame.text == "copy of a text"]
    assert copies.shard.nunique() <= 3


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    check([(1, "a")], sharding.shard(spark.createDataFrame([(1, "a")], schema)), 16, 2)
    same = sharding.shard(spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, schema)).collect()
    assert len(same) == 53 and len({r.shard for r in same if r.doc_id}) == 1
    assert sharding.shard(spark.createDataFrame([(1, "a"), (2, "b")], schema), shards=1).agg(F.max("shard")).first()[0] == 0


def test_splitters_by_weight(spark):
    keyed = spark.range(1000).select(F.lpad(F.lower(F.hex("id")), 32, "0").alias("key"), F.lit(1).alias("size"))
    found = sharding.splitters(keyed, {"n": [(0.25, 0.0), (0.5, 0.0)]}, {"n": "size"})
    assert found == [250, 500]


def test_equal_texts_share_a_shard_but_for_a_hot_group(spark):
    draw = np.random.default_rng(3)
    texts = [f"text {k} " + "y" * int(n) for k, n in enumerate(draw.integers(0, 200, 1500))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(10_000 + 5 * k + j, t) for k, t in enumerate(texts[:700]) for j in range(4)]
    frame = check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")), 16, 0.1 * sum(len(t) + 1 for _, t in rows) / 16)
    assert (frame.groupby("text").shard.nunique() == 1).all()
    hot = rows + [(50_000 + k, "the same text again, everywhere") for k in range(4000)]
    frame = check(hot, sharding.shard(spark.createDataFrame(hot, "doc_id long, text string")), 16, 0.1 * sum(len(t) + 1 for _, t in hot) / 16)
    spread = frame.groupby("text").shard.nunique()
    assert (spread.drop("the same text again, everywhere") == 1).all() and spread["the same text again, everywhere"] > 1


def test_columns_of_common_names_are_kept(spark):
    made = sharding.shard(spark.createDataFrame([(1, "a", "k", 7), (2, None, None, None)], "doc_id long, text string, _key string, _part int"))
    assert sorted((r.doc_id, r["_key"], r["_part"]) for r in made.collect()) == [(1, "k", 7), (2, None, None)]
