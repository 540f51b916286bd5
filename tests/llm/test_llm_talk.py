"""Chat formatting, prefix trie and whitening against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from minutary.llm import chat, parens, queries, trie, whitening

TURNS = "conv_id long, turn long, role string, text string, chunk double, mask string, _turns long"


@pytest.fixture
def make_talk(spark):
    """Turns from (conv_id, turn, role, text), with columns whose names the operators use within."""

    def make(rows):
        return spark.createDataFrame([(*row, 1.5, "x", 7) for row in rows], TURNS)

    return make


# ---- chat formatting ----

NASTY = [
    None, "", "plain", "\\", "</turn>", "\\</turn>", "\n</turn>\n", "a\n<text>\nb", "\\\\<more>", "<turn>\nassistant\n<text>\nhi\n</turn>\n",
    "ends in \\", "\n", "<<turn>>", "ünïcode 日本 😀", "x" * 100_000,
]


def nasty_rows():
    rows = [(1, n, "user" if n % 3 else "assistant", text) for n, text in enumerate(NASTY)]
    rows += [(2, n, "assistant", text) for n, text in enumerate(NASTY)]
    rows += [(3, None, "system", "no number"), (3, 0, None, "no role"), (3, 1, "</turn>\n<text>", "odd role"), (3, 1, "", "tie"), (3, 1, "", "tie")]
    rows += [(None, 5, "assistant", "no conversation"), (None, 4, "user", None), (4, 0, "user", None)]
    return rows


def plain_turns(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def plain_format(turns):
    def escaped(text):
        return re.sub("(</?turn>|<text>|<more>)", r"\\\1", text)

    out, before = "", None
    for role, text in turns:
        if role == before:
            out += f"\n<more>\n{escaped(text)}"
        else:
            out += ("\n</turn>\n" if out else "") + f"<turn>\n{escaped(role)}\n<text>\n{escaped(text)}"
        before = role
    return out + "\n</turn>\n"


@pytest.mark.parametrize("limit", [4096, 4, 1])
def test_chat_comes_back_as_it_was(make_talk, limit):
    rows = nasty_rows()
    random.Random(3).shuffle(rows)
    chunks = chat.format_turns(make_talk(rows), limit=limit)
    expected = plain_turns(rows)
    found = {row.conv_id: row for row in chat.read_back(chat.whole(chunks)).collect()}
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        assert found[conv].formatted == plain_format(turns)
        assert [tuple(turn) for turn in found[conv].turns] == turns
        assert found[conv].learned == [text for role, text in turns if role == "assistant"]
        at, under = 0, []
        for part in found[conv].mask:
            at += part.marks
            under += [found[conv].formatted[at : at + part.chars]] if part.loss else []
            at += part.chars
        assert [chat_text(text) for text in under] == found[conv].learned
    if limit < 10:
        assert chunks.count() > len(expected)


def chat_text(text):
    return re.sub(r"\\(</?turn>|<text>|<more>)", r"\1", text)


def test_chat_of_nothing(make_talk):
    empty = chat.format_turns(make_talk([]))
    assert empty.count() == 0 and chat.read_back(chat.whole(empty)).count() == 0


def test_chat_plan_has_one_shuffle_and_no_python(make_talk):
    plan = chat.read_back(chat.whole(chat.format_turns(make_talk(nasty_rows()))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_digests(spark, make_talk, tmp_path):
    rows = nasty_rows()
    make_talk(rows).write.parquet(str(tmp_path / "conversations.parquet"))
    expected = plain_turns(rows) | {-7: [("user", queries.MARKED_TEXT), ("assistant", queries.MARKED_TEXT)]}
    found = queries.QUERIES["op11_chat"](spark, str(tmp_path)).collect()
    assert {row.conv_id for row in found} == set(expected) and len(found) == len(expected)
    for row in found:
        turns = expected[row.conv_id]
        learned = "".join(text for role, text in turns if role == "assistant")
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(turns), len(learned), len(plain_format(turns)))
        assert row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


# ---- whitening ----


def plain_axes(vectors, components):
    """Of vectors of whole numbers, by numpy."""
    matrix = np.array(vectors, dtype=float)
    off = matrix - matrix.mean(axis=0)
    spread = off.T @ off / len(matrix)
    values, axes = np.linalg.eigh(spread)
    best = np.argsort(-values)[:components]
    return values[best], axes[:, best], spread.trace(), off


def planted(rng, n, dims):
    return rng.normal(size=(n, dims)) * np.linspace(3, 0.2, dims) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0]


VECTORS = "vec_id long, embedding array<double>, whitened string, n double, deviation string, label int"


@pytest.fixture
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", 0.5, "y", 3) for row in rows], VECTORS)


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_whitening_equals_numpy(make_vectors, dims):
    rng = np.random.default_rng(dims)
    good = [(n, [float(c) for c in row]) for n, row in enumerate(planted(rng, 300, dims))]
    good += [(7, good[7][1]), (None, good[3][1])]
    bad = [(1000, None), (1001, []), (1002, [None] * dims), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims)]
    bad += [(1005, [1.0] * (dims + 1)), (1006, [1e300] * dims)]
    found = whitening.whiten(make_vectors(good + bad)).collect()
    whole = [[math.floor(1024 * c) + 100_000 for c in row] for _, row in good]
    values, axes, trace, off = plain_axes(whole, 8)
    n, sums = len(whole), [sum(column) for column in zip(*whole)]
    assert len(found) == n * min(8, dims) and {row.n for row in found} == {n}
    assert all(row.identity_error < 1e-9 for row in found)
    expected = {}
    for (key, _), row, apart in zip(good, whole, off):
        deviation = sum((n * x - total) ** 2 for x, total in zip(row, sums))
        expected.setdefault(key, []).append((deviation, apart @ axes / np.sqrt(values)))
    signs = {}
    for row in found:
        deviation, coordinates = expected[row.vec_id][0]
        assert row.deviation == deviation
        assert row.explained == pytest.approx(values[row.component - 1] / trace, rel=1e-9)
        own = coordinates[row.component - 1]
        sign = signs.setdefault(row.component, np.sign(own * row.whitened))
        assert row.whitened == pytest.approx(sign * own, abs=1e-8)


def test_whitening_of_too_little(make_vectors):
    assert whitening.whiten(make_vectors([])).collect() == []
    assert whitening.whiten(make_vectors([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(make_vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(make_vectors([(n, [float(n), 2.0 * n]) for n in range(5)])).collect()
    assert {row.component for row in line} == {1} and len(line) == 5
    assert all(row.explained == pytest.approx(1) for row in line)


def test_whitening_of_far_apart_entries(make_vectors):
    far = [(n, [(-1.0) ** n * 1e10, float(n)]) for n in range(4)]
    found = whitening.whiten(make_vectors(far)).collect()
    assert {row.deviation for row in found} == {None}
    assert all(row.identity_error < 1e-9 for row in found)


@given(st.integers(1, 12), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_factor_and_rotations(size, seed):
    rng = np.random.default_rng(seed)
    root = rng.integers(-3, 4, size=(size, rng.integers(1, size + 1))).astype(float)
    matrix = root @ root.T
    order, factor = whitening.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[order][:, order], atol=1e-9)
    assert np.allclose(np.triu(factor, 1), 0) and factor.shape[1] == np.linalg.matrix_rank(matrix)
    turned = whitening.orthogonal_columns(factor)
    inner = turned.T @ turned
    assert np.allclose(inner, np.diag(inner.diagonal()), atol=1e-12 * max(1.0, np.abs(inner).max(initial=0)))
    assert np.allclose(turned @ turned.T, factor @ factor.T, atol=1e-9)
    pairs = [pair for a, b in whitening._rounds(size) for pair in zip(a.tolist(), b.tolist())]
    assert sorted(pairs) == [(a, b) for a in range(size) for b in range(a + 1, size)]


# ---- prefix trie ----


def plain_trie(sequences):
    """Nodes by their beginning, from {conversation: [(role, text), ...]} or pairs of these."""
    pairs = list(sequences.items()) if isinstance(sequences, dict) else sequences
    members, ends = {}, {}
    for conv, turns in pairs:
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    rows = []
    for key, own in members.items():
        under = [other for other in members if other[: len(key)] == key]
        kids = [other for other in under if len(other) == len(key) + 1]
        leaves = [other for other in under if not any(more[:-1] == other for more in members if more)]
        saved = sum((len(members[other]) - 1) * len(other[-1][1].encode()) for other in under if other)
        ids = ",".join(map(str, sorted(ends.get(key, []))))
        parent = min(members[key[:-1]]) if key else None
        rows.append((min(own), len(key), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=str)


def talk_of(seed, convs=60):
    rng = random.Random(seed)
    said = [("user", "hi"), ("user", "hé"), ("assistant", "hi"), ("", ""), ("user", "hi ho" * 9)]
    found = {conv: [rng.choice(said[: 2 + conv % 4]) for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9]))] for conv in range(convs)}
    found |= {1000 + n: found[3] for n in range(40)}
    return found | {2000: [said[n % 5] for n in range(90)], -4: [said[n % 5] for n in range(80)]}


def encoded_path(turns):
    marks = [hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(8, "big") for role, text in turns]
    return b"".join(marks)


def rows_of_nodes(frame):
    return sorted((tuple(row) for row in frame.select(*trie.NAMES).collect()), key=str)


@pytest.mark.parametrize("turns_per_shard", [1, 7, 1 << 17])
def test_trie_equals_plain_trie(spark, turns_per_shard):
    talk = talk_of(turns_per_shard)
    rows = [(conv, bytearray(encoded_path(turns))) for conv, turns in talk.items()]
    paths = spark.createDataFrame(rows, "conv_id long, path binary")
    assert rows_of_nodes(trie.nodes(paths, turns_per_shard)) == plain_trie(talk)


def test_trie_counts_repeated_rows(spark):
    path = encoded_path([("user", "a")])
    twice = spark.createDataFrame([(1, bytearray(path)), (1, bytearray(path)), (2, bytearray())], "conv_id long, path binary")
    assert rows_of_nodes(trie.nodes(twice, 1)) == plain_trie([(1, [("user", "a")]), (1, [("user", "a")]), (2, [])])


def test_trie_of_nothing(make_talk):
    assert trie.nodes(trie.shared_start_paths(make_talk([]))).collect() == []
    assert trie.nodes(trie.shared_start_paths(make_talk([(None, 1, "user", "nobody's")]))).collect() == []


def test_trie_query_rebuilds_conversations(spark, make_talk, tmp_path):
    talk = {conv: turns for conv, turns in talk_of(5, 90).items() if turns and conv % 10 != 5}
    rows = [(conv, n, role or None, text or None) for conv, turns in talk.items() for n, (role, text) in enumerate(turns)]
    rows = [(conv, None if n == 0 and conv % 3 == 0 else n, role, text) for conv, n, role, text in rows]
    random.Random(1).shuffle(rows)
    make_talk(rows + [(None, 3, "user", "nobody's")]).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for conv, turns in talk.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = int(math.fmod(conv, 5))
        rebuilt[conv] = [*talk.get(conv - base, [])[:h], *turns[h:]]
    assert rows_of_nodes(queries.QUERIES["op12_prefixes"](spark, str(tmp_path))) == plain_trie(rebuilt)


@given(st.integers(0, 10**6), st.integers(1, 400))
@settings(max_examples=30, deadline=None)
def test_close_parentheses(seed, pairs):
    rng = random.Random(seed)
    bits, opened, left = [], 0, pairs
    while left or opened:
        if left and (not opened or rng.random() < 0.5 + 0.4 * (seed % 2)):
            bits, opened, left = [*bits, True], opened + 1, left - 1
        else:
            bits, opened = [*bits, False], opened - 1
    stack, close = [], {}
    for at, bit in enumerate(bits):
        if bit:
            stack.append(at)
        else:
            close[stack.pop()] = at
    tree = parens.Parens(np.array(bits))
    assert tree.find_close().tolist() == [close[at] for at in sorted(close)]
    assert tree.leaf_rank()[-1] == sum(close[at] == at + 1 for at in close)
    values = np.array([rng.randrange(1000) for _ in range(pairs)])
    starts = np.array([rng.randrange(pairs) for _ in range(20)])
    ends = np.array([rng.randint(start + 1, pairs) for start in starts])
    assert parens.least_between(values, starts, ends).tolist() == [values[a:b].min() for a, b in zip(starts, ends)]
