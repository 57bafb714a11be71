import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe
from lattica.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_bpe(symbols, merges):
    """Apply each merge in order wherever it is, from the left."""
    out = list(symbols)
    for k, (a, b) in enumerate(merges):
        at, made = 0, []
        while at < len(out):
            if out[at : at + 2] == [a, b]:
                made.append(4 + k)
                at += 2
            else:
                made.append(out[at])
                at += 1
        out = made
    return out


@pytest.mark.parametrize("seed", range(40))
def test_automaton_agrees_with_merging(seed):
    draw = random.Random(seed)
    merges, seen = [], {(k,) for k in range(4)}
    spelling = [(k,) for k in range(4)]
    for _ in range(12):
        a, b = draw.randrange(len(spelling)), draw.randrange(len(spelling))
        if spelling[a] + spelling[b] not in seen and len(spelling[a] + spelling[b]) < 9:
            seen.add(spelling[a] + spelling[b])
            spelling.append(spelling[a] + spelling[b])
            merges.append((a, b))
    automaton = bpe.Automaton([(k,) for k in range(4)], merges)
    for _ in range(150):
        text = [draw.randrange(4) for _ in range(draw.randint(1, 14))]
        assert automaton.encode(text) == plain_bpe(text, merges)
    used = [k for k in range(len(spelling)) if k not in automaton.unused]
    for last in used:
        for label in used:
            assert automaton.follows(last, label) == automaton.has_arc(automaton.state[last], label)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcdefghinorst's ré1\n\t\x1c\x85ΣİßÅ漢😀<|>.,!", "<|endoftext|>", "\u0301"]), max_size=40).map("".join) | st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=20))
def test_encodes_as_the_library(text):
    from tokenizers import Tokenizer

    global _library
    try:
        _library
    except NameError:
        _library = Tokenizer.from_file(PATH)
    ids = _library.encode(text, add_special_tokens=False).ids
    mine = bpe.load(PATH)
    assert mine.encode(text) == ids
    assert mine.decode(ids) == _library.decode(ids, skip_special_tokens=False)


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "ENTRIES", 3)
    mine = bpe.WordBPE(PATH)
    text = "the quick brown fox jumps over the lazy dogs' antidisestablishmentarianism " * 3
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library):
    rows = [(1, "Hello  World", 5), (1, "Hello  World", 5), (2, None, 5), (3, "", 5), (None, "a" * 30_000, 5), (4, "é \n", 5)]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert want in {tuple(r)[1:] for r in got if r.doc_id == doc}
    assert bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).where("doc_id = 1").first().ids == library.encode(rows[0][1], add_special_tokens=False).ids
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_code_point_as_the_library(library):
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = [" ".join(f"a{chr(k)}b" for k in points[at : at + 256]) for at in range(0, len(points), 256)]
    mine = bpe.load(PATH)
    for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text) == theirs.ids


def test_marks_trade_places_as_in_the_library(library):
    mine = bpe.load(PATH)
    for text in ("經ᫍ̚ȩ", "á̕b", "q̴ᫍ", "Ạ̊"):
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows_of_the_file_agree_with_gadgets():
    automaton, draw = bpe.load(PATH).automaton, random.Random(3)
    used = [k for k in range(len(automaton.spelling)) if k not in automaton.unused]
    met = [(a, b) for a, b in zip(automaton.left, automaton.right) if a >= 0]
    for last, label in [*draw.sample(met, 2000), *((draw.choice(used), draw.choice(used)) for _ in range(2000))]:
        assert automaton.follows(last, label) == automaton.has_arc(automaton.state[last], label)


def test_the_table_is_sent_without_its_states():
    import pickle

    mine = bpe.WordBPE(PATH)
    before = mine.encode("the quick brown fox")
    again = pickle.loads(pickle.dumps(mine))
    assert len(again.automaton.sets) == 1 and not again.known
    assert again.encode("the quick brown fox") == before


def test_unknown_steps_are_refused(tmp_path):
    import json

    file = json.load(open(PATH))
    for change in ({"decoder": {"type": "ByteLevel"}}, {"normalizer": {"type": "StripAccents"}}, {"pre_tokenizer": {"pretokenizers": []}}):
        (tmp_path / "file.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.WordBPE(str(tmp_path / "file.json"))
