import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.llm import chat
from lattica.llm.queries import PROBE

tricky = st.text(alphabet=st.sampled_from(list("\\#</turn>: \nabé😀")), max_size=40) | st.text(max_size=20)


@given(st.lists(st.tuples(tricky, tricky), max_size=5))
def test_round_trip(turns):
    text, _ = chat.render(turns)
    assert chat.parse(text) == turns


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), tricky), max_size=5))
def test_mask(turns):
    text, spans = chat.render(turns)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_markers_are_escaped():
    text, _ = chat.render([("user", PROBE), ("assistant", PROBE)])
    assert text.count("</turn>\n") == 2 and chat.parse(text) == [("user", PROBE), ("assistant", PROBE)]


M = "tree string, node string, parent string, score double, role string, text string"


def test_branches_are_ranked(spark):
    rows = [
        ("t", "1", None, 0.0, "user", "q"), ("t", "2", "1", 1.0, "assistant", "good"), ("t", "3", "1", 0.5, "assistant", "bad"), ("t", "4", "2", 1.0, "user", "more"),
        ("t", "5", "2", 1.0, "user", "other"), ("t", "6", "9", 9.0, "user", "orphan"), ("c", "1", "2", 1.0, "user", "x"), ("c", "2", "1", 1.0, "user", "y"), ("t2", "1", None, None, None, None),
    ]
    made = chat.format_trees(spark.createDataFrame(rows, M)).collect()
    got = {(r.tree, r.branch): [t for _, t in chat.parse(r.formatted)] for r in made}
    assert got == {("t", 1): ["orphan"], ("t", 2): ["q", "good", "more"], ("t", 3): ["q", "good", "other"], ("t", 4): ["q", "bad"], ("t2", 1): [""]}
    assert chat.format_trees(spark.createDataFrame(rows, M), branches=2).count() == 3


@pytest.mark.parametrize("depth", [1, 2, 3, 8, 9, 70])
def test_long_chains(spark, depth):
    rows = [(k, 5, "assistant" if k % 2 else "user", f"text {k}") for k in range(depth)]
    talk = spark.createDataFrame([(5, k, r, t) for k, _, r, t in reversed(rows)], "conv_id long, turn long, role string, text string")
    made = chat.format_trees(chat.chains(talk)).collect()
    assert len(made) == 1 and chat.parse(made[0].formatted) == [(r, t) for _, _, r, t in rows]


def test_digests_and_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, tree int"
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", "b", 1), (1, 1, "assistant", "b", 1), (None, None, None, None, 1), (2, 5, "assistant", "c" * 100_000, 1)]
    formatted = chat.format_trees(chat.chains(spark.createDataFrame(rows, schema)))
    got = {r.tree: r for r in chat.digests(formatted).collect()}
    assert got["1"].n_turns == 4 and got["1"].loss_chars == 2
    assert got["1"].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got["2"].loss_sha256 == hashlib.sha256(b"c" * 100_000).hexdigest() and got["null"].n_turns == 1
    assert chat.digests(chat.format_trees(chat.chains(spark.createDataFrame([], schema)))).count() == 0
