"""Interpolated modified Kneser-Ney n-gram model (Chen & Goodman 1998), counted in Spark.

Words are counted and numbered first, frequent ones low, so that sorted n-grams take few bytes.
Tasks combine n-grams of their texts before anything is shuffled, so a frequent n-gram is one
record per task and chunk. Records go to shards by a hash of the whole n-gram, which spreads a
frequent context over all of them. Each shard is written to the shared folder as sorted arrays of
hashes with their counts, in one file per kind; scoring tasks map these files into memory and look
the different n-grams of many texts up in order of hash. The model grows with the corpus, and no task holds more than a shard.

Words are `batches.words_of`; every text ends with one end token, which counts as a token, and is
preceded by start tokens, which do not.
"""

from __future__ import annotations

import mmap
import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from minutary.llm import batches, hashing
from minutary.session import remove, work_dir

ORDER = 3
TEXT_PER_SHARD = 16 << 20
TOKENS_PER_CHUNK = 1_500_000
DOCS_IN_HAND, BYTES_IN_HAND = 1024, 4 << 20
# Every shard is searched once for the texts scored together.
DOCS_SCORED, BYTES_SCORED = 4096, 6 << 20
OPEN_FILES = 1024
KEYS_PER_BUCKET = 16
_KNOWN_BITS, _LARGE = 16, 255
_ARRAYS = ("ends", "keys", "counts", "places", "large", "nth")
# No word holds white space, so these texts stand for no word.
_END, _START = (np.uint64(h) for h in (0x656E64206F662074, 0x7374617274206F66))
ROWS = "kind string, shard int, grams binary, counts binary, stats binary"


# ---- hashes ----


def token_hashes(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts): hashes of each text's words between order - 1 start tokens and an end
    token, and how many tokens each text has, start tokens included."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined, starts, ends, _ = hashing.shingle_spans(texts, 1)
    hashes = hashing.xxh64_spans(joined, starts, ends, 0)
    full = counts + order
    firsts = np.cumsum(full) - full
    words = np.full(int(full.sum()), _START, dtype=np.uint64)
    words[firsts + full - 1] = _END
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    words[firsts[owner] + order - 1 + nth] = hashes
    return words, full


def gram_columns(words: np.ndarray, full: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, owner): every n-gram of `order` words, one column per word."""
    own = full - order + 1
    owner = np.repeat(np.arange(len(full)), own)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    first = (np.cumsum(full) - full)[owner] + nth
    return words[first[:, None] + np.arange(order)], owner


def keys_of(grams: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of words."""
    return _keys_of_columns(list(grams.T))


def _keys_of_columns(columns: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(columns[0]), len(columns) + 1, dtype=np.uint64)
    for column in columns:
        key = (key ^ column) * hashing.P1
        key ^= key >> np.uint64(29)
        key *= hashing.P2
        key ^= key >> np.uint64(32)
    return key


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, compressed with all first bytes together, then all second bytes
    and so on: the high bytes of small numbers and of steps between sorted ones take no room."""
    head = np.array([len(arrays)] + [x for array in arrays for x in (len(array), array.itemsize)], dtype=np.uint32)
    planes = [np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes() for array in arrays]
    return head.tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unsqueezed(raw: bytes) -> list[np.ndarray]:
    many = int(np.frombuffer(raw, dtype=np.uint32, count=1)[0])
    head = np.frombuffer(raw, dtype=np.uint32, count=2 * many, offset=4).reshape(many, 2).tolist()
    size = sum(length * width for length, width in head)
    planes = np.frombuffer(pa.decompress(raw[4 + 8 * many :], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    found, at = [], 0
    for length, width in head:
        part = planes[at : at + length * width].reshape(width, length)
        found.append(np.ascontiguousarray(part.T).view(f"<u{width}").ravel())
        at += length * width
    return found


def _pack(grams: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, order of the rows in them). Rows of word numbers are sorted by their first two
    words; the first is kept as steps, the second as steps where the first stays the same."""
    short = grams.max() < 1 << 32
    columns = [np.ascontiguousarray(column) for column in grams.T]
    if len(columns) == 1:
        order = np.argsort(columns[0])
    else:
        order = np.argsort(columns[0] << np.uint64(32) | columns[1]) if short else np.lexsort(columns[1::-1])
    coded = columns = [column[order] for column in columns]
    if len(columns) > 1:
        same = np.flatnonzero(columns[0][1:] == columns[0][:-1]) + 1
        second = columns[1].copy()
        second[same] -= columns[1][same - 1]
        coded = [columns[0], second, *columns[2:]]
    coded[0] = np.diff(coded[0], prepend=np.uint64(0))
    return _squeezed(*[column.astype(np.uint32) if short else column for column in coded]), order


def _unpack(raw: bytes) -> np.ndarray:
    columns = [column.astype(np.uint64) for column in _unsqueezed(raw)]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    if len(columns) > 1:
        # Steps add up from where the first word's run begins.
        starts = batches.run_starts(columns[0])
        sums = np.cumsum(columns[1], dtype=np.uint64)
        before = sums[starts] - columns[1][starts]
        columns[1] = sums - np.repeat(before, np.diff(np.append(starts, len(sums))))
    return np.stack(columns, axis=1)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, index of the row of each); equal ones keep their order.

    Numpy sorts numbers several times faster than places by numbers. So the first bits of the keys
    are sorted, with the place in the bits after them. Hashes that differ in later bits only are rare,
    and put in order afterwards.
    """
    bits = np.uint64(len(keys).bit_length())
    packed = keys >> bits << bits
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << int(bits)) - 1)
    order = packed.view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        firsts = found >> bits
        for first in np.unique(firsts[wrong]):
            run = slice(*np.searchsorted(firsts, np.array([first, first + np.uint64(1)], dtype=np.uint64)))
            order[run] = order[run][np.argsort(keys[order[run]], kind="stable")]
        found = keys[order]
    return found, order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys in order, index of one row for each, which of these each key is)."""
    found, order = _sorted(keys)
    starts = batches.run_starts(found)
    places = np.empty(len(keys), dtype=np.int64)
    places[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    return found[starts], order[starts], places


def _combined(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys in order, index of one row for each, sums of the values)."""
    keys, order = _sorted(keys)
    starts = batches.run_starts(keys) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = [np.add.reduceat(value[order], starts, axis=0) if len(keys) else value for value in values]
    return keys[starts], order[starts], *sums


def _cut(keys: np.ndarray, bits: int):
    """(shard, slice) of the shards that sorted keys fall into."""
    shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = batches.run_starts(shards) if len(shards) else []
    for start, end in zip(starts, [*starts[1:], len(shards)]):
        yield int(shards[start]), slice(int(start), int(end))


# ---- counting ----


def _rows(kind: str, bits: int, keys: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Rows of n-grams, in order of their keys, for their shards; `counts` has columns or none."""
    rows = []
    for shard, part in _cut(keys, bits):
        packed, order = _pack(grams[part])
        rows.append({"kind": kind, "shard": shard, "grams": packed, "counts": _small(counts[part][order]), "stats": None})
    return rows


def _small(counts: np.ndarray) -> bytes:
    """In four bytes each if all fit, else in eight."""
    kind = np.uint32 if counts.max() < 1 << 32 else np.uint64
    return _squeezed(*np.atleast_2d(counts.astype(kind).T))


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, grams, sums of their counts) of the rows that one shard got, keys in order."""
    grams = np.concatenate([_unpack(raw) for raw in table.column("grams").to_pylist()])
    pieces = [np.stack(_unsqueezed(raw), axis=1).astype(np.int64) for raw in table.column("counts").to_pylist()]
    keys, at, counts = _combined(keys_of(grams), np.concatenate(pieces))
    return keys, grams[at], counts


def _columns(rows: list[dict]) -> dict[str, list]:
    names = ("kind", "shard", "grams", "counts", "stats")
    return {name: [row[name] for row in rows] for name in names}


def counted_words(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of word hashes and counts, combined over chunks of a task's tokens."""

    def step(source):
        for tokens in _chunks(source, lambda texts: token_hashes(texts, 1)[0]):
            words, counts = np.unique(tokens, return_counts=True)
            rows = []
            for shard, part in _cut(words, bits):
                listed = _squeezed(np.diff(words[part], prepend=np.uint64(0)))
                rows.append({"kind": "v", "shard": shard, "grams": listed, "counts": _small(counts[part]), "stats": None})
            yield _columns(rows)

    return batches.map_arrow(docs.select(batches.text_bytes().alias("text")), step, ROWS)


def counted_chunks(docs: DataFrame, model: NgramModel) -> DataFrame:
    """Rows of n-grams and counts, combined over chunks of a task's tokens."""
    shared, order = docs.sparkSession.sparkContext.broadcast(model), model.order

    def step(source):
        model = shared.value

        def grams_of(texts):
            words, full = token_hashes(texts, order)
            return gram_columns(model.numbers(words)[0], full, order)[0]

        for grams in _chunks(source, grams_of):
            keys, at, counts = _combined(keys_of(grams), np.ones(len(grams), dtype=np.uint32))
            yield _columns(_rows(f"g{order}", model.bits, keys, grams[at], counts))

    return batches.map_arrow(docs.select(batches.text_bytes().alias("text")), step, ROWS)


def _chunks(source, made_of):
    """What `made_of` makes of the texts' words, put together to at least TOKENS_PER_CHUNK rows but at the end."""
    held: list[np.ndarray] = []
    waiting = 0
    for batch in batches.pieces(source, DOCS_IN_HAND, "text", BYTES_IN_HAND):
        held.append(made_of([batches.words_of(text) for text in batch.column("text").to_pylist()]))
        waiting += len(held[-1])
        if waiting >= TOKENS_PER_CHUNK:
            yield np.concatenate(held)
            held.clear()
            waiting = 0
    if waiting:
        yield np.concatenate(held)


def _save(folder: str, kind: str, shard: int, bits: int, keys: np.ndarray, counts: np.ndarray, **more: np.ndarray) -> None:
    """A shard's sorted keys and counts (a column for each figure), as arrays in one file to be mapped.

    The first bits of a key follow from its shard and its bucket, so of each key the last 48
    are kept. Counts are bytes; those of 255 and more stand in a short list by place.
    A file has a name of its own first: a second attempt of a task replaces the whole file.
    """
    buckets = max(_KNOWN_BITS - bits, (len(keys) // KEYS_PER_BUCKET).bit_length())
    firsts = np.arange(1 << buckets, dtype=np.uint64)
    ends = np.searchsorted(_bucket(keys, bits, buckets), firsts, side="right")
    large = np.flatnonzero((counts >= _LARGE).any(axis=1))
    arrays = {
        "ends": np.append(0, ends).astype(np.uint32 if len(keys) < 1 << 32 else np.uint64),
        # Two more bytes let the last key be read as eight.
        "keys": np.append(np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].ravel(), np.zeros(2, dtype=np.uint8)),
        "counts": np.minimum(counts, _LARGE).astype(np.uint8),
        "places": large,
        "large": counts[large],
        **more,
    }
    head = np.zeros((len(_ARRAYS), 3), dtype=np.int64)
    for at, array in enumerate(arrays.get(name, np.zeros(0, dtype=np.uint8)) for name in _ARRAYS):
        head[at] = len(array), array.itemsize, array.shape[1] if array.ndim > 1 else 0
    os.makedirs(f"{folder}/{kind}", exist_ok=True)
    draft = f"{folder}/{kind}/.{uuid.uuid4().hex}"
    with open(draft, "wb") as file:
        file.write(head.tobytes())
        for name in _ARRAYS:
            if name in arrays:
                raw = np.ascontiguousarray(arrays[name]).tobytes()
                file.write(raw + bytes(-len(raw) % 8))
    os.replace(draft, f"{folder}/{kind}/{shard}.arrays")


def _mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file that `_save` wrote."""
    with open(path, "rb") as file:
        raw = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    found, at = {}, 24 * len(_ARRAYS)
    for name, (length, size, width) in zip(_ARRAYS, np.frombuffer(raw, dtype=np.int64, count=3 * len(_ARRAYS)).reshape(-1, 3).tolist()):
        found[name] = np.frombuffer(raw, dtype=f"<u{size}", count=length * max(width, 1), offset=at)
        if width:
            found[name] = found[name].reshape(length, width)
        at += -(-found[name].nbytes // 8) * 8
    return found


def _bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bits after those of the shard."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - buckets) if buckets else np.zeros_like(keys)


def _search(known: np.ndarray, ends: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in `known`, whether it is there) by halving the key's bucket."""
    last = np.uint64((1 << 64 - _KNOWN_BITS) - 1)
    listed = np.ndarray(((len(known) - 2) // 6,), dtype="<u8", buffer=known, strides=(6,))
    own = _bucket(keys, bits, (len(ends) - 1).bit_length() - 1).astype(np.int64)
    low, high = ends[own].astype(np.int64), ends[own + 1].astype(np.int64)
    wanted = keys & last
    there = low < high
    left = np.where(there, high - low, 1)
    low[~there] = 0
    for _ in range(int(left.max(initial=1) - 1).bit_length() if len(listed) else 0):
        half = left >> 1
        low += half * ((listed[low + half - (half > 0)] & last) < wanted)
        left -= half
    # `low` is now the first of the bucket that is not less, or the last one of all.
    if len(listed):
        there &= (listed[low] & last) == wanted
    return low, there


def _levels(counts: np.ndarray) -> np.ndarray:
    """0 for the largest counts, one more for each halving."""
    return 64 - np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _reduce_words(bits: int, folder: str):
    """One shard of the vocabulary: hashes, counts, and the place of each word among those of its level."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        pieces = [np.cumsum(_unsqueezed(raw)[0], dtype=np.uint64) for raw in table.column("grams").to_pylist()]
        values = [_unsqueezed(raw)[0].astype(np.int64) for raw in table.column("counts").to_pylist()]
        words, _, counts = _combined(np.concatenate(pieces), np.concatenate(values))
        levels = _levels(counts)
        order = np.argsort(levels, kind="stable")
        sizes = np.bincount(levels, minlength=65)
        nth = np.empty(len(words), dtype=np.uint32 if len(words) < 1 << 32 else np.uint64)
        nth[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _save(folder, "v", shard, bits, words, counts[:, None], nth=nth)
        return _table([{"kind": "tv", "shard": shard, "grams": None, "counts": None, "stats": np.append(sizes, counts.sum()).astype(np.int64).tobytes()}])

    return run


def _count_classes(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _reduce_grams(order: int, bits: int, folder: str):
    """One shard of n-grams: its file, and rows for its contexts and for the next lower order."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, grams, counts = _read(table)
        _save(folder, f"g{order}", shard, bits, keys, counts)
        counts = counts[:, 0]
        classes = np.stack([counts, counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)
        rows = _grouped(f"c{order}", bits, grams[:, :-1], classes)
        # The next lower order counts the different words seen before.
        lower = f"g{order - 1}" if order > 2 else "w"
        rows += _grouped(lower, bits, grams[:, 1:], np.ones(len(grams), dtype=np.int64))
        rows.append({"kind": f"t{order}", "shard": shard, "grams": None, "counts": None, "stats": np.array(_count_classes(counts), dtype=np.int64).tobytes()})
        return _table(rows)

    return run


def _grouped(kind: str, bits: int, grams: np.ndarray, counts: np.ndarray) -> list[dict]:
    keys, at, sums = _combined(keys_of(grams), counts)
    return _rows(kind, bits, keys, grams[at], sums)


def _table(rows: list[dict]) -> pa.Table:
    binary = ("grams", "counts", "stats")
    kinds = {"kind": pa.string(), "shard": pa.int32()} | {name: pa.binary() for name in binary}
    return pa.table({name: pa.array(values, type=kinds[name]) for name, values in _columns(rows).items()})


def _reduce_keys(bits: int, folder: str):
    """One shard of contexts or of words: sums by key, and the file. The totals of words go on."""

    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        keys, _, sums = _read(table)
        _save(folder, kind, shard, bits, keys, sums)
        stats = [len(keys), *sums.sum(axis=0).tolist(), *_count_classes(sums[:, 0]), int((sums[:, 0] >= 3).sum())]
        return _table([{"kind": f"t{kind}", "shard": shard, "grams": None, "counts": None, "stats": np.array(stats, dtype=np.int64).tobytes()}])

    return run


def _summed(rows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Sum of a small array per shard, and the shards: a row per shard, whatever the corpus."""
    found = rows.select("shard", "stats").collect()
    total = sum(np.frombuffer(bytes(row.stats), dtype=np.int64) for row in found) if found else np.zeros(16, dtype=np.int64)
    return total, sorted(row.shard for row in found)


def discounts(classes: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from how many counts are 1, 2, 3 and 4.
    Where a class is empty the rule has no value; half the count serves."""
    t1, t2, t3, t4 = (float(x) for x in classes)
    y = t1 / (t1 + 2 * t2) if t1 and t2 else 0.5
    found = [1 - 2 * y * t2 / t1 if t1 and t2 else 0.5, 2 - 3 * y * t3 / t2 if t2 and t3 else 1.0, 3 - 4 * y * t4 / t3 if t3 and t4 else 1.5]
    return np.array([0.0, *[min(max(d, 0.0), k) for k, d in enumerate(found, 1)]])


# ---- the model ----


def mounted(uri: str) -> str:
    """The shared folder as a path. The arrays are mapped into memory, so it has to be mounted."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{uri}: the folder in spark.checkpoint.dir must be a mounted path for memory-mapped models")
    return unquote(parsed.path)


class NgramModel:
    """Where the arrays are, and the few numbers that all tokens share."""

    def __init__(self, folder: str, order: int, bits: int):
        self.folder, self.order, self.bits = folder, order, bits
        self.shards: dict[str, set[int]] = {}
        self.discounts: dict[int, np.ndarray] = {}
        self.types = self.tokens = self.continuations = 0
        self.low_mass = 1.0
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _file(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        """Shards are read in turn, so the first files opened stay open and the others are opened each time."""
        if (kind, shard) in self._open:
            return self._open[kind, shard]
        found = _mapped(f"{self.folder}/{kind}/{shard}.arrays")
        if len(self._open) < OPEN_FILES:
            self._open[kind, shard] = found
        return found

    def _firsts(self) -> np.ndarray:
        if "firsts" not in self._open:
            self._open["firsts"] = np.load(f"{self.folder}/firsts.npy", mmap_mode="r")
        return self._open["firsts"]

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word hash; small numbers for frequent words. The start token
        has number 0, and a word not learned has the largest number there is, and count 0."""
        distinct, _, places = _distinct(words)
        found, counts = self._numbers_of(distinct)
        return found[places], counts[places]

    def _numbers_of(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.full(len(distinct), ~np.uint64(0))
        counts = np.zeros(len(distinct), dtype=np.int64)
        for shard, part in _cut(distinct, self.bits):
            if shard not in self.shards["v"]:
                continue
            at, there, own = self._find("v", shard, distinct[part])
            counts[part][there] = own[:, 0]
            found[part][there] = self._firsts()[_levels(own[:, 0]), shard] + self._file("v", shard)["nth"][at].astype(np.uint64)
        found[distinct == _START] = 0
        return found, counts

    def _find(self, kind: str, shard: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of those that are there, which ones are, their counts)."""
        file = self._file(kind, shard)
        at, there = _search(file["keys"], file["ends"], keys, self.bits)
        at = at[there]
        counts = file["counts"][at].astype(np.int64)
        large = np.flatnonzero((counts == _LARGE).any(axis=1))
        if len(large):
            counts[large] = file["large"][np.searchsorted(file["places"], at[large].astype(np.uint64))]
        return at, there, counts

    def look_up(self, kind: str, keys: np.ndarray, width: int = 0) -> np.ndarray:
        """Counts by key, 0 where there is none."""
        distinct, _, places = _distinct(keys)
        return self._of_distinct(kind, distinct, width)[places]

    def _of_distinct(self, kind: str, distinct: np.ndarray, width: int = 0) -> np.ndarray:
        """Counts of different keys in order; they are read shard after shard."""
        found = np.zeros((len(distinct), width) if width else len(distinct), dtype=np.int64)
        for shard, part in _cut(distinct, self.bits):
            if shard not in self.shards.get(kind, ()):
                continue
            _, there, counts = self._find(kind, shard, distinct[part])
            found[part][there] = counts if width else counts[:, 0]
        return found

    def score(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability after the words before it, count) of each of the word hashes of `token_hashes`; those of
        start tokens mean nothing. Each different n-gram is looked up and worked out once."""
        uniform = 1.0 / (self.types + 1)
        distinct, _, places = _distinct(words)
        numbers, raw = self._numbers_of(distinct)
        raw = raw[places]
        # Words not learned have one number and so one key.
        keys, _, own = _distinct(_keys_of_columns([numbers]))
        numbers, places = numbers[places], own[places]
        adjusted = self._of_distinct("w", keys)
        chance = (adjusted - self.discounts[1][np.minimum(adjusted, 3)]) / max(self.continuations, 1) + self.low_mass * uniform
        for order in range(2, self.order + 1):
            # What is kept for an n-gram's words but the last, which are an n-gram of the order below.
            context = self._of_distinct(f"c{order}", keys, 4)
            total = np.maximum(context[:, 0], 1)
            rest = np.where(context[:, 0] > 0, context[:, 1:] @ self.discounts[order][1:] / total, 1.0)
            last = len(numbers) - order + 1
            keys, at, own = _distinct(_keys_of_columns([numbers[k : k + last] for k in range(order)]))
            before, after = places[at], places[at + 1]
            counts = self._of_distinct(f"g{order}", keys)
            chance = (counts - self.discounts[order][np.minimum(counts, 3)]) / total[before] + rest[before] * chance[after]
            places = own
        logs = np.zeros(len(words))
        logs[self.order - 1 :] = np.log10(chance)[places]
        return logs, raw


@contextmanager
def _shuffles_released(spark: SparkSession):
    """Spark deletes each job's shuffle files when it ends: all these jobs' results are written out."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _number_words(docs: DataFrame, model: NgramModel) -> None:
    """Count all words, and give them numbers by level of count, then shard, then hash."""
    counted = counted_words(docs, model.bits).groupBy("shard").applyInArrow(_reduce_words(model.bits, model.folder), ROWS)
    sizes = np.zeros((65, 1 << model.bits), dtype=np.int64)
    for row in counted.select("shard", "stats").collect():
        stats = np.frombuffer(bytes(row.stats), dtype=np.int64)
        sizes[:, row.shard] = stats[:-1]
        model.tokens += int(stats[-1])
        model.shards.setdefault("v", set()).add(row.shard)
    model.shards.setdefault("v", set())
    model.types = int(sizes.sum())
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    os.makedirs(model.folder, exist_ok=True)
    np.save(f"{model.folder}/firsts.npy", (ends - sizes + 1).astype(np.uint64))


def learn(docs: DataFrame, order: int = ORDER) -> NgramModel:
    """From every row of `docs` (text). Null texts count as empty ones: an end token each."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (size // TEXT_PER_SHARD).bit_length())
    folder = mounted(work_dir(spark, "ngrams"))
    model = NgramModel(folder, order, bits)
    paths = []
    with _shuffles_released(spark):
        _number_words(docs, model)
        rows, spent = counted_chunks(docs, model), None
        for level in range(order, 1, -1):
            paths.append(work_dir(spark, "ngram-rows"))
            reduced = rows.groupBy("shard").applyInArrow(_reduce_grams(level, bits, folder), ROWS)
            reduced.write.partitionBy("kind").parquet(paths[-1])
            if spent:
                remove(spark, spent)
            made = spark.read.schema(ROWS).parquet(paths[-1])
            classes, model.shards[f"g{level}"] = _summed(made.filter(F.col("kind") == f"t{level}"))
            model.discounts[level] = discounts(classes[:4])
            contexts = made.filter(F.col("kind") == f"c{level}")
            _, model.shards[f"c{level}"] = _summed(contexts.groupBy("kind", "shard").applyInArrow(_reduce_keys(bits, folder), ROWS))
            remove(spark, f"{paths[-1]}/kind=c{level}")
            rows, spent = made.filter(F.col("kind") == f"g{level - 1}"), f"{paths[-1]}/kind=g{level - 1}"
        words = spark.read.schema(ROWS).parquet(paths[0]).filter("kind = 'w'")
        for path in paths[1:]:
            words = words.unionByName(spark.read.schema(ROWS).parquet(path).filter("kind = 'w'"))
        found, model.shards["w"] = _summed(words.groupBy("kind", "shard").applyInArrow(_reduce_keys(bits, folder), ROWS))
    for path in paths:
        remove(spark, path)
    model.shards = {kind: set(shards) for kind, shards in model.shards.items()}
    model.continuations = int(found[1])
    model.discounts[1] = discounts(found[2:6])
    if model.continuations:
        held_back = found[2] * model.discounts[1][1] + found[3] * model.discounts[1][2] + found[6] * model.discounts[1][3]
        model.low_mass = float(held_back / model.continuations)
    return model


def score_texts(docs: DataFrame, model: NgramModel) -> DataFrame:
    """(rest, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of
    `docs` (text, anything else); `rest` holds the other columns as a struct.

    base_score is that of single words smoothed by a tenth of a count. Null, empty and wordless texts
    are one end token. A model of no text gives every token the same chance, 1. An empty table gives
    an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [F.col(name) for name in docs.columns if name != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), batches.text_bytes().alias("text"))

    def step(source):
        model = shared.value
        order = model.order
        for batch in batches.pieces(source, DOCS_SCORED, "text", BYTES_SCORED):
            hashed = []
            for part in batches.pieces([batch], DOCS_IN_HAND, "text", BYTES_IN_HAND):
                hashed.append(token_hashes([batches.words_of(text) for text in part.column("text").to_pylist()], order))
            words, full = (np.concatenate(parts) for parts in zip(*hashed))
            logs, raw = model.score(words)
            # Start tokens stand first in each text, and count for nothing.
            own = np.ones(len(words), dtype=bool)
            own[((np.cumsum(full) - full)[:, None] + np.arange(order - 1)).ravel()] = False
            owner = np.repeat(np.arange(len(full)), full - order + 1)
            logs, raw = logs[own], raw[own]
            base = np.log10((raw + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            rows, tokens = len(full), full - order + 1
            score = np.bincount(owner, logs, minlength=rows)
            yield {
                "rest": batch.column("rest"),
                "n_tokens": tokens,
                "n_known": np.bincount(owner, raw > 0, minlength=rows).astype(np.int64),
                "train_tokens": np.full(rows, model.tokens, dtype=np.int64),
                "base_score": np.bincount(owner, base, minlength=rows),
                "score": score,
                "perplexity": 10 ** (-score / tokens),
            }

    added = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return batches.with_fields(packed, ["rest"], step, added)
