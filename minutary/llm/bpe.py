"""Byte-level BPE by an automaton over tokens, built one merge at a time.

The automaton accepts a sequence of tokens exactly if it is the BPE tokenization of the text it
spells. It begins with one state and an arc for every byte. The gadget of a merge (u, v) -> w
gives u a state of its own, a copy of the one u led to but without the arc v, and adds the arc
w, which leads where v led, next to every arc u. The state after a token then depends on
the token alone, so a transition is two table look-ups: may the token follow this state, and its
state. A word has one accepted path, found longest arc first; the labels of its arcs are
the tokens, and decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from minutary.llm import batches

# How byte-level tokenizers cut text into words before merging (fixed value of the format).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_IN_CACHE = 200_000
TEXTS_IN_HAND = 64
_START = 0


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable ones for themselves, then U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(others)}


def _merge_states(letters: list[int], merges: list[tuple[int, int, int]], tokens: int):
    """(allowed, state): bit s of allowed[t] says that token t may follow state s; state[t] is
    the state after t."""
    allowed = np.zeros((tokens, 2048), dtype=np.uint8)
    state = np.zeros(tokens, dtype=np.int32)
    users = [len(letters) + 1]  # of each state; the first is also the start, so it is never changed
    allowed[letters, 0] = 128
    live = max(letters) + 1  # no token beyond has an arc yet
    for u, v, w in merges:
        before, after = int(state[u]), state[v]
        if not allowed[v, before >> 3] << (before & 7) & 128:
            continue  # u and v never stand side by side, so w is never made
        own = before
        if users[before] > 1 or u == v:
            own = len(users)
            if own >= allowed.shape[1] * 8:
                allowed = np.concatenate([allowed, np.zeros_like(allowed)], axis=1)
            copied = (allowed[:live, before >> 3] >> (7 - (before & 7))) & 1
            allowed[:live, own >> 3] |= copied << (7 - (own & 7))
            users[before] -= 1
            users.append(1)
            state[u] = own
        allowed[v, own >> 3] &= 255 - (128 >> (own & 7))
        allowed[w] = allowed[u]
        state[w] = after
        users[after] += 1
        live = max(live, w + 1)
    return allowed[:, : (len(users) + 7) // 8], state


class MergeAutomaton:
    """Tables of one tokenizer: `labels` of tokens, their `states`, and which may follow which."""

    def __init__(self, labels: list[bytes], specials: dict[str, int], rows: np.ndarray, states: np.ndarray, allowed: np.ndarray):
        self.labels, self.specials = labels, specials
        self.rows, self.states, self.allowed = rows, states, allowed
        self._ready = False

    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if not name.startswith("_")} | {"_ready": False}

    def _prepare(self) -> None:
        """Look-up structures of this process; not sent along."""
        marked = set(self.specials.values())
        self._arcs = {label: at for at, label in enumerate(self.labels) if at not in marked}
        self._longest: dict[bytes, int] = {}
        for label in self._arcs:
            self._longest[label[:2]] = max(len(label), self._longest.get(label[:2], 1))
        self._row, self._state, width = self.rows.tolist(), self.states.tolist(), self.allowed.shape[1]
        self._bits, self._width = self.allowed.tobytes(), width
        self._split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self._words = regex.compile(WORDS)
        self._cache: dict[str, bytes] = {}
        self._ready = True

    def word(self, word: bytes) -> list[int]:
        """Tokens of one word. A prefix has one accepted path too, so a place once found to
        lead nowhere never does."""
        if not self._ready:
            self._prepare()
        arcs, longest, rows, states, bits, width = self._arcs, self._longest, self._row, self._state, self._bits, self._width
        total, at, state = len(word), 0, _START
        path: list[tuple[int, int, int]] = []
        found: list[int] = []
        dead: set[int] = set()
        end = min(total, longest.get(word[:2], 1))
        while at < total:
            while end > at:
                token = arcs.get(word[at:end])
                if token is not None and bits[rows[token] * width + (state >> 3)] << (state & 7) & 128 and end not in dead:
                    break
                end -= 1
            if end == at:
                dead.add(at)
                at, state, end = path.pop()
                found.pop()
                end -= 1
                continue
            path.append((at, state, end))
            found.append(token)
            at, state = end, states[token]
            end = min(total, at + longest.get(word[at : at + 2], 1))
        return found

    def _packed(self, word: str) -> bytes:
        ids = np.array(self.word(word.encode("utf-8")), dtype="<u4").tobytes()
        if len(self._cache) >= WORDS_IN_CACHE:
            self._cache.clear()
        self._cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._prepare()
        parts = self._split.split(text) if self._split else [text]
        out, cache, packed = [], self._cache, self._packed
        for part in parts:
            if part in self.specials:
                out.append(np.uint32(self.specials[part]).astype("<u4").tobytes())
            else:
                out += [cache.get(word) or packed(word) for word in self._words.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Labels of the arcs one after another; bytes that are no UTF-8 become U+FFFD."""
        labels = self.labels
        text = b"".join([labels[at] for at in np.frombuffer(ids, dtype="<u4").tolist()])
        return text.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def compile_tokenizer(path: str) -> MergeAutomaton:
    """The automaton of a byte-level BPE file. Equal table rows are kept once."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    vocabulary = file["model"]["vocab"]
    merges = [tuple(each) if isinstance(each, list) else tuple(each.split(" ")) for each in file["model"]["merges"]]
    specials = {each["content"]: each["id"] for each in file["added_tokens"]}
    of_letter = byte_letters()
    labels = [b""] * (max([*vocabulary.values(), *specials.values()]) + 1)
    for name, at in vocabulary.items():
        labels[at] = bytes(of_letter[letter] for letter in name)
    for name, at in specials.items():
        labels[at] = name.encode("utf-8")
    letters = [at for name, at in vocabulary.items() if len(name) == 1 and name in of_letter]
    triples = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]
    allowed, states = _merge_states(letters, triples, len(labels))
    kinds: dict[bytes, int] = {}
    rows = np.array([kinds.setdefault(row.tobytes(), len(kinds)) for row in allowed], dtype=np.int32)
    distinct = np.frombuffer(b"".join(kinds), dtype=np.uint8).reshape(len(kinds), -1)
    return MergeAutomaton(labels, specials, rows, states, distinct)


def _shared(spark: SparkSession, path: str):
    """Sent once to each executor. Its size is set by the vocabulary, whatever the input."""
    return spark.sparkContext.broadcast(compile_tokenizer(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(rest, n_tokens, ids, decoded) for every row of `docs` (text, anything else).

    `rest` holds all columns but text as a struct, `ids` little-endian unsigned 32-bit
    integers, `decoded` the text that `ids` decode to, as bytes. The file of the tokenizer at `path` is
    read on the driver. Null and empty texts have no tokens. An empty table gives an empty one.
    """
    shared = _shared(docs.sparkSession, path)
    others = [F.col(name) for name in docs.columns if name != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), F.coalesce("text", F.lit("")).alias("text"))

    def step(source):
        automaton = shared.value
        for batch in batches.pieces(source, TEXTS_IN_HAND, "text"):
            ids = [automaton.encode(text) for text in batch.column("text").to_pylist()]
            yield {
                "rest": batch.column("rest"),
                "n_tokens": [len(each) // 4 for each in ids],
                "ids": ids,
                "decoded": [automaton.decode(each) for each in ids],
            }

    added = T.StructType.fromDDL("n_tokens long, ids binary, decoded binary")
    schema = T.StructType(packed.select("rest").schema.fields + added.fields)
    return batches.map_arrow(packed, step, schema)
