"""Lines found in many documents, dropped from all but the document with the largest id.

Keys of lines are hashed to 128 bits. (hash, document, position) rows are range-partitioned and
sorted by hash, document from the largest down, and position, so a line found everywhere is
cut over many tasks. Each task streams its rows and sees every run of a hash begin with the
document that keeps it. A run torn at the edge of a task is left open; the few open hashes
(two per task at most) are settled afterwards. What comes back is a compressed bitmap of
lines to keep for each document that loses any, no text.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from minutary.llm import batches
from minutary.session import settle

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
_DROP, _OPEN, _FULL = 0, 1, 2
_NO_DOC = int(np.iinfo(np.int64).min)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without white space at its ends and in lower case (A-Z); None if too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars:
        return None
    # Bytes 10xxxxxx continue a code point.
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) for each line with a key."""

    def step(source):
        for batch in batches.pieces(source):
            digests, sizes, places = [], [], []
            for text in batch.column("text").to_pylist():
                before = len(digests)
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(pos)
                sizes.append(len(digests) - before)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield {
                "h1": halves[:, 0],
                "h2": halves[:, 1],
                "doc_id": batch.column("doc_id").take(owner),
                "text_hash": batch.column("text_hash").take(owner),
                "pos": np.array(places, dtype=np.int32),
            }

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), batches.text_bytes().alias("text"))
    return batches.map_arrow(narrow, step, "h1 long, h2 long, doc_id long, text_hash long, pos int")


def _stream_runs(source, min_docs: int):
    """Rows in order of (h1, h2, doc_id from the largest, pos), with a state.

    _DROP: this line goes. _OPEN: its run began or may go on in another task. _FULL: not
    a line, but says that the run at this task's end has documents enough already.
    """
    names = ["h1", "h2", "doc_id", "text_hash", "pos"]
    first_key = None  # the run at the task's start
    held = None  # rows of the current run while it has too few documents to decide
    full = None  # (h1, h2, largest document) of the current run once it has enough

    def out(rows, state):
        marks = np.full(len(rows["pos"]), state, dtype=np.int8)
        known = rows["doc_id"] == _NO_DOC
        masked = {name: rows[name] for name in names} | {"state": marks}
        return masked | {"doc_id": np.ma.masked_array(rows["doc_id"], known)}

    for batch in source:
        rows = {name: batch.column(name) for name in names}
        rows["doc_id"] = rows["doc_id"].fill_null(_NO_DOC)
        rows = {name: values.to_numpy() for name, values in rows.items()}
        if held is not None:
            rows = {name: np.concatenate([held[name], rows[name]]) for name in names}
            held = None
        total = len(rows["pos"])
        if not total:
            continue
        if first_key is None:
            first_key = (rows["h1"][0], rows["h2"][0])
        starts = batches.run_starts(rows["h1"], rows["h2"])
        run = np.zeros(total, dtype=np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        new_doc = np.zeros(total, dtype=np.int64)
        new_doc[batches.run_starts(rows["h1"], rows["h2"], rows["doc_id"])] = 1
        nth = np.cumsum(new_doc)
        nth -= nth[starts][run]  # 0 in the run's first document, 1 in the next
        ends = np.append(starts[1:], total)
        enough = nth[ends - 1] + 1 >= min_docs
        gone = (nth > 0) & enough[run]
        if full is not None and full[:2] == (rows["h1"][0], rows["h2"][0]):
            gone[: ends[0]] = rows["doc_id"][: ends[0]] != full[2]
            enough[0] = True
        is_open = np.zeros(total, dtype=bool)
        if first_key == (rows["h1"][0], rows["h2"][0]):
            is_open[: ends[0]] = True
        last = slice(int(starts[-1]), total)
        if first_key != (rows["h1"][-1], rows["h2"][-1]):
            key = (rows["h1"][-1], rows["h2"][-1])
            if not enough[-1]:
                held = {name: rows[name][last] for name in names}
            elif full is None or full[:2] != key:
                full = (*key, rows["doc_id"][last][0])
        gone &= ~is_open
        for chosen, state in ((gone, _DROP), (is_open, _OPEN)):
            if chosen.any():
                yield out({name: rows[name][chosen] for name in names}, state)
    if held is not None:
        yield out(held, _OPEN)
    elif full is not None and full[:2] == (rows["h1"][-1], rows["h2"][-1]):
        marker = {"h1": full[0], "h2": full[1], "doc_id": full[2], "text_hash": 0, "pos": -1}
        yield out({name: np.array([value], dtype=np.int32 if name == "pos" else np.int64) for name, value in marker.items()}, _FULL)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, pos) of each line that goes."""
    hashed = settle(line_hashes(docs, min_chars))
    order = ["h1", "h2", F.desc_nulls_last("doc_id"), "pos"]
    placed = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "h1 long, h2 long, doc_id long, text_hash long, pos int, state byte"
    marked = settle(batches.map_arrow(placed, lambda source: _stream_runs(source, min_docs), schema))
    torn = marked.filter(F.col("state") != _DROP)
    # Two hashes per task at most, so a table as small as the number of tasks.
    edges = (
        torn.groupBy("h1", "h2")
        .agg(
            (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("_docs"),
            F.max("doc_id").alias("_keeper"),
            F.max(F.col("state") == _FULL).alias("_full"),
        )
        .filter(F.col("_full") | (F.col("_docs") >= min_docs))
    )
    # The keeper is the largest id, and null only if no line of the run has one.
    settled = torn.filter(F.col("state") == _OPEN).join(F.broadcast(edges), ["h1", "h2"])
    closed = settled.filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    columns = ["doc_id", "text_hash", "pos"]
    return marked.filter(F.col("state") == _DROP).select(*columns).unionByName(closed.select(*columns))


def _pack(positions: np.ndarray) -> bytes:
    keep = np.ones((int(positions.max()) // 8 + 1) * 8, dtype=np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, keep) for the documents that lose lines.

    `keep` is a zlib-compressed bitmap, first line in the highest bit, that ends with the byte
    of the last dropped line; lines beyond it stay. `text_hash` is Spark's xxhash64 of the
    text and tells rows with one doc_id apart.
    """

    def step(source):
        for batch in source:
            packed = [_pack(np.asarray(each)) for each in batch.column("gone").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "keep": packed}

    # One document's lines, each once however often its row is repeated: never more than the document itself.
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    return batches.map_arrow(gone, step, "doc_id long, text_hash long, keep binary")


def lines_left(text: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """Lines left by a bitmap of `keep_bitmaps` (None: all), and their number before."""
    lines = text.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8)).tolist()
    return [line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :], len(lines)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(rest, text, n_lines, n_dropped): `rest` holds the other columns of `docs` as a struct,
    `text` the lines left, joined, as bytes; null texts give empty ones."""
    others = [F.col(name) for name in docs.columns if name != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), batches.text_bytes().alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    joined = packed.join(bitmaps, same, "left").select("rest", "text", "keep")

    def step(source):
        for batch in batches.pieces(source):
            texts, keeps = batch.column("text").to_pylist(), batch.column("keep").to_pylist()
            left = [lines_left(text, keep) for text, keep in zip(texts, keeps)]
            counts = np.array([total for _, total in left], dtype=np.int64)
            yield {
                "rest": batch.column("rest"),
                "text": [b"\n".join(lines) for lines, _ in left],
                "n_lines": counts,
                "n_dropped": counts - np.array([len(lines) for lines, _ in left], dtype=np.int64),
            }

    added = T.StructType.fromDDL("n_lines long, n_dropped long")
    schema = T.StructType(joined.select("rest", "text").schema.fields + added.fields)
    return batches.map_arrow(joined, step, schema)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(rest, text, n_lines, n_dropped) for every row of `docs` (doc_id, text, anything else).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at
    least `min_chars` code points in at least `min_docs` documents lose all lines but those in
    the largest doc_id that holds them. Null and empty texts are one empty line. Rows with
    equal doc_ids count as one document and are each returned; null doc_ids count as one
    document with the smallest id. An empty table gives an empty one.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
