"""BPE by a tokenization automaton."""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches

#: Words whose encoding a worker keeps, and states of the table it keeps; both are emptied when full.
WORDS, ENTRIES = 1 << 18, 1 << 17


class Automaton:
    """The deterministic automaton over tokens that accepts the correct BPE sequences, and its table over symbols.

    It begins with one state and an arc to it for each base symbol, so that it accepts every
    sequence of symbols. Each merge (a, b) -> c, in order, is a gadget on the automaton so far:
    the state after a is copied without its arc b, a's arcs are led to the copy, so that b can no
    longer follow a, and from wherever an arc a leaves, an arc c leaves to the state that b led
    to. All arcs of a label end in one state at any time, so a state is known by its label. A
    merge whose arc b isn't there makes no arc.

    Construction keeps a state as what its gadget did: the state it copies, the one arc taken
    away, and the time. Compilation then writes the arcs of every state out: with labels numbered
    so that those with a common left part are neighbours, the later ones first, each gadget on
    the state after a, or on a state that it copies, takes one interval of labels away, and
    a state's row is the sorted borders of these intervals.

    Symbols are read by a second table. After a prefix of a word, all that decides what follows
    is the states in which tokens still being read began, and how far these have come; each such
    set is a state, and its output the one token that the accepted path of the prefix ends with.
    Its transitions are worked out from the rows when first taken, and looked up from then on.
    """

    def __init__(self, symbols: list[tuple[int, ...]], merges: list[tuple[int, int]]):
        """symbols: labels 0.. by their symbol; merges: pairs of labels, the kth making the next label."""
        n = len(symbols)
        self.spelling: list[tuple[int, ...]] = list(symbols)
        self.state = [0] * n  # where arcs of each label end
        self.copied, self.without, self.time = [-1], [-1], [-1]  # by state
        self.left, self.right, self.made = [-1] * n, [-1] * n, [-1] * n  # by label
        self.gadget: dict[tuple[int, int], int] = {}
        self.unused = unused = set()  # labels of merges that never apply, as earlier ones keep their parts apart
        for k, (a, b) in enumerate(merges):
            if a in unused or b in unused or not self._joins(a, b):
                unused.add(n + k)
            after = self.state[b]
            self.copied.append(self.state[a])
            self.without.append(b)
            self.time.append(k)
            self.state[a] = len(self.copied) - 1
            self.state.append(after)
            self.spelling.append(self.spelling[a] + self.spelling[b])
            self.left.append(a)
            self.right.append(b)
            self.made.append(k)
            if n + k not in unused:
                self.gadget[a, b] = k
        self._compile()
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]  # label spelt by the path to each node of the trie
        for label, spelling in enumerate(self.spelling):
            if label in unused:
                continue
            node = 0
            for symbol in spelling:
                to = self.trie[node].get(symbol)
                if to is None:
                    to = self.trie[node][symbol] = len(self.ends)
                    self.trie.append({})
                    self.ends.append(-1)
                node = to
            self.ends[node] = label
        self.length = [len(s) for s in self.spelling]
        self._empty()

    def _joins(self, a: int, b: int) -> bool:
        """Whether the arc b leaves the state after a, by the gadgets so far, skipping those that touch neither.

        The state after a holds the gadgets on a, then, up to the time that label was made, those
        on its right part, and so on; at each time b stands as the longest of its left parts made
        by then. So only a gadget on a right part of a and a left part of b can have taken the
        arc away, if it falls into the time of both.
        """
        until = len(self.copied)
        while a >= 0:
            label, late = b, len(self.copied)
            while label >= 0:
                k = self.gadget.get((a, label))
                if k is not None and k < until and k <= late:
                    return False
                label, late = self.left[label], self.made[label]
            a, until = self.right[a], self.made[a]
        return True

    def has_arc(self, state: int, label: int) -> bool:
        """Whether an arc leaves the state, by the gadgets alone, one by one: what the rows are tested against."""
        while state:
            if self.made[label] >= self.time[state]:
                label = self.left[label]
            elif self.without[state] == label:
                return False
            else:
                state = self.copied[state]
        return True

    def _compile(self) -> None:
        """place: labels' numbers; rows[first[a] : first[a + 1]]: the borders of the intervals that state[a] has no arcs for."""
        n = len(self.left)
        children: list[list[int]] = [[] for _ in range(n)]  # in order of making
        for label, a in enumerate(self.left):
            if a >= 0:
                children[a].append(label)
        size = [1] * n
        for label in reversed(range(n)):
            if self.left[label] >= 0:
                size[self.left[label]] += size[label]
        self.place, at = [0] * n, 0
        for label in range(n):
            if self.left[label] < 0:
                self.place[label], at = at, at + size[label]
        for label in range(n):
            at = self.place[label] + 1
            for child in reversed(children[label]):
                self.place[child], at = at, at + size[child]
        taken: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # time and interval, by the label before
        for (a, b), k in self.gadget.items():
            late = bisect_left(children[b], k, key=self.made.__getitem__)  # from here on made with b at time k or later
            stop = self.place[children[b][late]] + size[children[b][late]] if late < len(children[b]) else self.place[b] + 1
            taken[a].append((k, self.place[b], stop))
        own = [np.array(t, np.int64).reshape(-1, 3) for t in taken]
        kind, rows, self.first, known = np.uint16 if n < 1 << 16 else np.uint32, [], [], {}
        total = 0
        for label in range(n):
            pieces, a, until = [], label, 1 << 62
            while a >= 0:
                if len(own[a]):
                    pieces.append(own[a][: np.searchsorted(own[a][:, 0], until)])
                a, until = self.right[a], self.made[a]
            cut = np.concatenate(pieces)[:, 1:] if pieces else np.empty((0, 2), np.int64)
            cut = cut[np.argsort(cut[:, 0], kind="stable")]
            reach = np.maximum.accumulate(cut[:, 1])
            begins = np.flatnonzero(np.append(True, cut[1:, 0] > reach[:-1])) if len(cut) else np.empty(0, np.int64)
            row = np.column_stack([cut[begins, 0], reach[np.append(begins[1:], len(cut)) - 1]]).astype(kind).ravel() if len(cut) else np.empty(0, kind)
            there = known.get(key := row.tobytes())  # equal rows are one
            if there is None:
                there = known[key] = (total, total + len(row))
                rows.append(row)
                total += len(row)
            self.first.append(there)
        self.rows = memoryview(np.concatenate(rows))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": np.asarray(self.rows), "table": None, "sets": None, "number": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.rows = memoryview(self.rows)
        self._empty()

    def follows(self, last: int, label: int) -> bool:
        """Whether an arc with the label leaves the state after `last`, from the compiled rows."""
        return self._arc(self.first[last], label)

    def _arc(self, row: tuple[int, int], label: int) -> bool:
        return not (bisect_right(self.rows, self.place[label], *row) - row[0]) & 1

    def _empty(self) -> None:
        self.table: list[dict[int, tuple[int, int]]] = [{}]  # by state and symbol, the next state and its output
        self.sets: list[tuple] = [(((0, 0), 0),)]  # (row of the state it began in, node of the trie) of each token being read
        self.number: dict[tuple, int] = {self.sets[0]: 0}

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The entry of the table: the next state, and the token that the path so far ends with."""
        ended, alive = -1, []
        for row, node in self.sets[state]:
            to = self.trie[node].get(symbol)
            if to is None:
                continue
            label = self.ends[to]
            if label >= 0 and ended < 0 and self._arc(row, label):
                ended = label
            if self.trie[to]:
                alive.append((row, to))
        if ended < 0:
            raise ValueError("no accepted path")
        held = (*alive, (self.first[ended], 0))
        to = self.number.get(held)
        if to is None:
            to = self.number[held] = len(self.sets)
            self.sets.append(held)
            self.table.append({})
        self.table[state][symbol] = to, ended
        return to, ended

    def encode(self, symbols: list[int]) -> list[int]:
        """The labels of the one accepted path that spells the symbols, by one transition for each."""
        if len(self.sets) >= ENTRIES:
            self._empty()
        state, ends, table = 0, [], self.table
        for symbol in symbols:
            entry = table[state].get(symbol)
            if entry is None:
                if len(self.sets) >= 2 * ENTRIES:  # a very long word
                    held = self.sets[state]
                    self._empty()
                    table = self.table
                    self.sets.append(held)
                    table.append({})
                    self.number[held] = state = 1
                entry = self._step(state, symbol)
            state = entry[0]
            ends.append(entry[1])
        out, at = [], len(symbols)
        while at:
            out.append(ends[at - 1])
            at -= self.length[out[-1]]
        return out[::-1]


def _unlike(normalizer) -> regex.Pattern:
    """Code points that Python's Unicode data and the tokenizers library's may treat unlike: those without a category here, and those composed or ordered in another way there."""
    known = [k <= sys.maxunicode and unicodedata.category(chr(k)) != "Cn" for k in range(sys.maxunicode + 2)]
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.combining(c) or unicodedata.decomposition(c):
            # Marks of the lowest and of a high combining class, which a mark after or before them trades places with.
            probes = (c, c + "\u0334", "\u0315" + c, "\u0345" + c)
            known[k] = all(normalizer.normalize_str(p) == unicodedata.normalize("NFC", p).replace("\u03a3", "\u03c3").lower() for p in probes)
    turns = [0, *(k for k in range(1, sys.maxunicode + 2) if known[k] != known[k - 1])]
    spans = [f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in pairwise([*turns, sys.maxunicode + 1]) if a < b and not known[a]]
    return regex.compile(f"[{''.join(spans)}]")


class WordBPE:
    """Encoder and decoder of a tokenizers file of BPE with word ends.

    What it does to a text before splitting, how it splits, and how it decodes are read from the
    file; a file that asks for other steps than those known here is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, model, vocabulary = path, file["model"], file["model"]["vocab"]
        steps = file["normalizer"]["normalizers"] if (file["normalizer"] or {}).get("type") == "Sequence" else [file["normalizer"]] if file["normalizer"] else []
        self.steps = []
        # Fixed value: white space as Unicode has it; the regex module's \s also takes U+001C to U+001F.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        for step in steps:
            if step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"}:
                self.steps.append(("Replace", (regex.compile(f"[{space}]+"), step["content"])))
            elif step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
                self.steps.append((step["type"], None))
            else:
                raise ValueError(f"unknown step before splitting: {step}")
        splits = file["pre_tokenizer"]["pretokenizers"]
        split, whole = splits if len(splits) == 2 else ({}, {})
        if (split.get("type"), split.get("behavior"), split.get("invert")) != ("Split", "Removed", True) or (whole.get("type"), whole.get("use_regex"), whole.get("add_prefix_space")) != ("ByteLevel", False, False):
            raise ValueError(f"unknown way to split: {splits}")
        if file["decoder"] is not None:
            raise ValueError(f"unknown decoder: {file['decoder']}")
        pattern = split["pattern"]["Regex"]
        if r"\s" in pattern.replace(r"[^\s", ""):
            raise ValueError(f"unknown pattern: {pattern}")
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{space}"))
        # White space that is replaced by a space splits words as that does, so the step is left out where nothing else sees it.
        if [name for name, _ in self.steps] == ["NFC", "Replace", "Lowercase"] and self.steps[1][1][1] == " ":
            del self.steps[1]
        suffix = model["end_of_word_suffix"] or ""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte = {c: b for b, c in letter.items()}
        names = [letter[b] for b in range(256)] + [letter[b] + suffix for b in range(256)]
        label = {name: k for k, name in enumerate(names)}
        merges = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            merges.append((label[a], label[b]))
            label[a + b] = len(names)
            names.append(a + b)
        self.automaton = Automaton([(k,) for k in range(512)], merges)
        self.ids = [vocabulary[name] for name in names]
        self.name = {k: name for name, k in vocabulary.items()}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.name |= {k: content for content, k in added.items()}
        self.added = added
        self.split_added = regex.compile("|".join(sorted(map(regex.escape, added), key=len, reverse=True))) if added else None
        self.library = Tokenizer.from_file(path)
        self.unlike, self.like = _unlike(self.library.normalizer), set()  # like: characters looked up so far
        self.known: dict[str, tuple[int, str, str]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "library": None}

    def _encode_bytes(self, word: bytes) -> list[int]:
        symbols = list(word)
        symbols[-1] += 256
        return [self.ids[k] for k in self.automaton.encode(symbols)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, with a space between them, as a file without a decoder has it."""
        return " ".join(self.name[k] for k in ids)

    def _word(self, word: str) -> tuple[int, str, str]:
        entry = self.known.get(word)
        if entry is None:
            entry = self._entry(word.encode("utf-8"))
            if len(self.known) >= WORDS:
                self.known.clear()
            if len(word) <= 64:  # long words seldom come again and would fill the memory
                self.known[word] = entry
        return entry

    def _entry(self, word: bytes) -> tuple[int, str, str]:
        ids = self._encode_bytes(word)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def read(self, text: str) -> list[tuple[int, str, str]]:
        """For each word or added token its number of ids, the ids and their labels, space-joined."""
        out, at = [], 0
        for mark in self.split_added.finditer(text) if self.split_added else ():
            out += self._plain(text[at : mark.start()])
            out.append((1, str(self.added[mark[0]]), mark[0]))
            at = mark.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        if not text.isascii():
            new = set(text) - self.like
            if new and self.unlike.search("".join(new)):
                return self._split_by_library(text)
            self.like |= new
        for name, more in self.steps:
            if name == "Lowercase":  # letter by letter, so without the rule for a final sigma
                text = text.replace("\u03a3", "\u03c3").lower()
            elif name == "Replace":
                text = more[0].sub(more[1], text)
            elif not text.isascii():
                text = unicodedata.normalize(name, text)
        known, word = self.known, self._word
        return [known.get(w) or word(w) for w in self.words.findall(text)]

    def _split_by_library(self, text: str) -> list[tuple[int, str, str]]:
        """The words of a text with code points that the library may treat unlike Python, split by the library."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self._entry(bytes(self.byte[c] for c in word)) for word, _ in words]

    def encode(self, text: str) -> list[int]:
        return [int(k) for _, ids, _ in self.read(text) for k in ids.split()]


@functools.cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _shared(docs: DataFrame, path: str):
    """The tokenizer, compiled once on the driver and sent to each executor; its size is that of its vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded) for each row; a null text counts as empty and has no ids."""
    schema, tokenizer = "doc_id long, ids array<int>, decoded string", _shared(docs, path)

    def run(part: pa.RecordBatch) -> dict:
        read = [tokenizer.value.read(t.as_py() or "") for t in part.column(1)]
        return {
            "doc_id": part.column(0),
            "ids": [[int(k) for _, ids, _ in words for k in ids.split()] for words in read],
            "decoded": [" ".join(labels for _, _, labels in words) for words in read],
        }

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches(run, schema), schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of encode's ids, in decimal and space-joined, and its decoded text."""
    schema, tokenizer = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _shared(docs, path)

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in part.column(1):
            read = tokenizer.value.read(text.as_py() or "")
            out["n_tokens"].append(sum(n for n, _, _ in read))
            for column, which in (("ids_sha256", 1), ("decoded_sha256", 2)):
                out[column].append(hashlib.sha256(" ".join([w[which] for w in read]).encode()).hexdigest())
        return {"doc_id": part.column(0)} | out

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches(run, schema), schema)
