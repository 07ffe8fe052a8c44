"""Exact repeats of 13 or more words across documents, by fixed-block anchors.

Every document is cut into non-overlapping blocks of seven words: the reference
index. Each run of 13 words holds exactly one such block of the document it
starts in, so every repeat of 13 words shows itself when all rolling windows of
seven words probe the index. Hits are extended to both sides to the 13-word
windows around them; overlapping windows that recur in an earlier document form
the maximal exact repeats, which are removed.

Pairs of documents are never made. Documents are dealt to parts by a hash, each
part sends one sorted list of block hashes per bucket, and a bucket answers with
the hashes that are anchored in some document and occur in another one too. The
13-word windows around hits then meet in the same way under a 96-bit key, and a
bucket answers with the smallest document id of a window. A passage that a third
of all documents share is one entry per part, whatever its documents do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens.llm.packed import found, pack_sorted, unpack_sorted
from buzzlens.llm.words import Words, kept_texts, split_words, window_hashes

BLOCK = 7
WINDOW = 2 * BLOCK - 1
LOW = np.uint64(0xFFFFFFFF)
SLICE = 4 << 20  # bytes of text a task has split into words at one time
NO_ID = np.iinfo(np.int64).max  # stands for a null id: later than every other document

_LISTS = "bucket int, part int, hashes binary"
_KEYS = "bucket int, part int, keys binary, more binary, docs binary, spread binary"


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(table: pa.Table) -> Iterator[pa.Table]:
    """The documents of a part in groups of about ``SLICE`` bytes of text."""
    size = pc.fill_null(pc.binary_length(table["text"].cast(pa.large_binary())), 0)
    group = (np.cumsum(size.to_numpy()) - 1) // SLICE if table.num_rows else np.zeros(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), table.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield table.slice(a, b - a)


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash and the 32 bits that tell hashes of a bucket apart."""
    return hashes % np.uint64(buckets), (hashes // np.uint64(buckets)) & LOW


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First positions of runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _anchor_lists(table: pa.Table, part: int, buckets: int) -> Iterator[dict]:
    """Per bucket the block hashes of one part, each with two marks.

    Mark 1: it is an aligned block of some document here. Mark 2: it occurs more
    than once here.
    """
    values = [np.zeros(0, np.uint64)]
    for some in _slices(table):
        words = split_words(some["text"])
        start = words.window_starts(BLOCK)
        bucket, rest = _split(window_hashes(words.hashes(), start, BLOCK), buckets)
        aligned = (start - words.first[words.doc[start]]) % BLOCK == 0
        values.append((bucket << np.uint64(34)) | (rest << np.uint64(2)) | aligned.astype(np.uint64))
    value = np.concatenate(values)
    values.clear()
    value.sort()
    runs = _runs(value >> np.uint64(2))
    if not len(runs):
        return
    last = np.append(runs[1:], len(value)) - 1
    value = value[last] | ((last > runs).astype(np.uint64) << np.uint64(1))
    bounds = np.searchsorted(value, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(34))
    for b in np.flatnonzero(np.diff(bounds)):
        mine = value[bounds[b] : bounds[b + 1]] & np.uint64(2**34 - 1)
        yield {"bucket": int(b), "part": part, "hashes": pack_sorted(mine)}


def _shared(table: pa.Table) -> Iterator[dict]:
    """For one bucket: to each part its hashes that are anchored somewhere and occur twice."""
    lists = [unpack_sorted(x.as_py()) for x in table["hashes"]]
    owner = np.repeat(np.arange(len(lists), dtype=np.uint64), [len(x) for x in lists])
    # 32 bits of hash, two marks and the list: one number each, sorted without a payload.
    value = np.sort((np.concatenate(lists) << np.uint64(30)) | owner)
    marks, owner = (value >> np.uint64(30)) & np.uint64(3), value & np.uint64(2**30 - 1)
    rest = value >> np.uint64(32)
    runs = _runs(rest)
    size = np.diff(np.append(runs, len(value)))
    marked = np.bitwise_or.reduceat(marks, runs)
    shared = ((marked & np.uint64(1)) > 0) & ((marked > 1) | (size > 1))
    chosen = np.repeat(shared, size)
    rest, owner = rest[chosen], owner[chosen]
    order = np.argsort(owner, kind="stable")  # hashes stay ascending for each owner
    rest, owner = rest[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(lists) + 1, dtype=np.uint64))
    bucket, parts = table["bucket"][0].as_py(), table["part"].to_pylist()
    for k in np.flatnonzero(np.diff(bounds)):
        mine = rest[bounds[k] : bounds[k + 1]]
        yield {"bucket": bucket, "part": parts[k], "hashes": pack_sorted(mine)}


def _known(shared: pa.Table) -> np.ndarray:
    """The shared block hashes of a part, ascending, under their bucket."""
    lists = [
        unpack_sorted(h.as_py()) | (np.uint64(b.as_py()) << np.uint64(32))
        for b, h in zip(shared["bucket"], shared["hashes"])
    ]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *lists]))


def _near_hits(words: Words, hashed: np.ndarray, known: np.ndarray, buckets: int) -> np.ndarray:
    """Start words of the 13-word windows around a block hit."""
    start = words.window_starts(BLOCK)
    bucket, rest = _split(window_hashes(hashed, start, BLOCK), buckets)
    hit = found(rest | (bucket << np.uint64(32)), known) >= 0
    # A hit at word i lies in the windows that start at i - 6 .. i.
    hits = np.zeros(len(words.start) + WINDOW - BLOCK + 1, np.int32)
    hits[start[hit]] = 1
    total = np.concatenate([[0], np.cumsum(hits)])
    near = total[WINDOW - BLOCK + 1 :] > total[: -(WINDOW - BLOCK + 1)]
    near = near[: len(words.start)]
    starts = words.window_starts(WINDOW)
    return starts[near[starts]]


def _window_keys(hashed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each 13-word window that starts at one of ``at``."""
    return window_hashes(hashed, at, WINDOW), window_hashes(hashed, at, WINDOW, 1) & LOW


def _grouped(key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, first positions of equal keys in it, key of each input."""
    order = np.lexsort((more, key))
    runs = _runs(key[order], more[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    return order, runs, place


def _window_lists(table: pa.Table, shared: pa.Table, part: int, buckets: int) -> Iterator[dict]:
    """Per bucket the windows around hits with the first and last document here."""
    known, found_here = _known(shared), []
    for some in _slices(table):
        words = split_words(some["text"])
        hashed = words.hashes()
        at = _near_hits(words, hashed, known, buckets)
        found_here.append((*_window_keys(hashed, at), _ids(some["doc_id"])[words.doc[at]]))
    if not sum(len(x[0]) for x in found_here):
        return
    key, more, doc = (np.concatenate(x) for x in zip(*found_here))
    order, runs, _ = _grouped(key, more)
    first, last = np.minimum.reduceat(doc[order], runs), np.maximum.reduceat(doc[order], runs)
    key, more = key[order[runs]], more[order[runs]]
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        mine = order[bounds[b] : bounds[b + 1]]
        yield _key_row(int(b), part, key[mine], more[mine], first[mine], last[mine])


def _key_row(bucket: int, part: int, key, more, first, last) -> dict:
    """Keys in ascending order, with their other 32 bits, first and last document."""
    return {
        "bucket": bucket,
        "part": part,
        "keys": pack_sorted(key),
        "more": more.astype("<u4").tobytes(),
        "docs": first.astype("<i8").tobytes(),
        "spread": (last - first).astype("<i8").tobytes(),
    }


def _read_keys(table: pa.Table):
    """Keys, other bits, first and last document, and row of the table."""
    keys = [unpack_sorted(x.as_py()) for x in table["keys"]]
    row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    more = np.frombuffer(b"".join(table["more"].to_pylist()), "<u4").astype(np.uint64)
    first = np.frombuffer(b"".join(table["docs"].to_pylist()), "<i8")
    last = first + np.frombuffer(b"".join(table["spread"].to_pylist()), "<i8")
    return key, more, first, last, row


def _earliest(table: pa.Table) -> Iterator[dict]:
    """For one bucket: to each part its windows that an earlier document has too."""
    key, more, first, last, row = _read_keys(table)
    order, runs, place = _grouped(key, more)
    least = np.minimum.reduceat(first[order], runs)[place]
    later = np.flatnonzero(least < last)
    bounds = np.searchsorted(row[later], np.arange(table.num_rows + 1))
    bucket, parts = table["bucket"][0].as_py(), table["part"].to_pylist()
    for k in np.flatnonzero(np.diff(bounds)):
        mine = later[bounds[k] : bounds[k + 1]]
        yield _key_row(bucket, parts[k], key[mine], more[mine], least[mine], least[mine])


def _cut(table: pa.Table, earliest: pa.Table) -> Iterator[pa.Table]:
    """The documents of one part without words that repeat an earlier document."""
    key, more, least, _, _ = _read_keys(earliest)
    order = np.argsort(key, kind="stable")
    key, more, least = key[order], more[order], least[order]
    for some in _slices(table):
        yield _cut_slice(some, key, more, least)


def _cut_slice(table: pa.Table, key: np.ndarray, more: np.ndarray, least: np.ndarray) -> pa.Table:
    words, ids = split_words(table["text"]), _ids(table["doc_id"])
    hashed, at = words.hashes(), words.window_starts(WINDOW)
    asked = window_hashes(hashed, at, WINDOW)
    hit = found(asked, key) >= 0
    at, asked = at[hit], asked[hit]
    # Windows whose first 64 bits are known meet the table under all 96 bits.
    _, runs, place = _grouped(
        np.concatenate([key, asked]),
        np.concatenate([more, window_hashes(hashed, at, WINDOW, 1) & LOW]),
    )
    earlier = np.full(len(runs), NO_ID)
    earlier[place[: len(key)]] = least
    repeated = at[earlier[place[len(key) :]] < ids[words.doc[at]]]
    marks = np.zeros(len(words.start) + 1, np.int32)
    marks[repeated] += 1
    marks[repeated + WINDOW] -= 1
    removed = np.cumsum(marks[:-1]) > 0
    # Spans of removed words, counted from each document's first word.
    same = words.doc[1:] == words.doc[:-1]
    joined = removed[1:] & removed[:-1] & same
    begin = np.flatnonzero(removed & ~np.concatenate([[False], joined])[: len(removed)])
    finish = np.flatnonzero(removed & ~np.concatenate([joined, [False]])[: len(removed)]) + 1
    owner = words.doc[begin]
    bounds = np.searchsorted(owner, np.arange(table.num_rows + 1)).astype(np.int32)
    span = pa.StructArray.from_arrays(
        [
            pa.array(begin - words.first[owner], pa.int64()),
            pa.array(finish - words.first[owner], pa.int64()),
        ],
        ["first", "after"],
    )
    total = np.concatenate([[0], np.cumsum(removed)])[words.first]
    return pa.table(
        {
            "row": table["row"],
            "text": kept_texts(words, ~removed).cast(pa.large_string()).cast(pa.string()),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(np.diff(total), pa.int64()),
            "repeats": pa.ListArray.from_arrays(pa.array(bounds), span),
        }
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """``docs`` without the words of every 13-word window that an earlier document has too.

    Windows are judged on the given texts: a window counts if the same words in
    the same order start anywhere in a document with a smaller id. Returns all
    columns, with the kept words joined by one space as text, and ``n_words``,
    ``n_removed`` and ``repeats`` (removed spans as first word and word after),
    which replace columns of those names.

    A null text has no words and becomes empty. A null id counts as larger than
    any other. Rows with equal ids count as one document and keep each other's
    words. Fewer than 13 words are always kept. No rows give no rows.
    ``parts`` is the number of parts the documents are dealt to, by default
    ``spark.sql.shuffle.partitions``; memory per task is about ten times a part.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = ("n_words", "n_removed", "repeats")
    others = [c for c in docs.columns if c != text_col and c not in added]
    dealt = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).cast("int").alias("part"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
    ).repartition(n, "part")
    # All three readings of ``dealt`` take the same columns, so that one shuffle serves them.
    def rows(found_rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist(list(found_rows), schema=schema)

    lists = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary())])
    keys = pa.schema(
        [("bucket", pa.int32()), ("part", pa.int32())]
        + [(c, pa.binary()) for c in ("keys", "more", "docs", "spread")]
    )

    def anchors(key, table):
        return rows(_anchor_lists(table, key[0].as_py(), n), lists)

    def probe(key, table):
        return rows(_shared(table), lists)

    def windows(key, left, right):
        return rows(_window_lists(left, right, key[0].as_py(), n), keys)

    def earliest(key, table):
        return rows(_earliest(table), keys)

    def cut(key, left, right):
        return pa.concat_tables(_cut(left, right))

    shared = (
        dealt.groupBy("part").applyInArrow(anchors, _LISTS)
        .groupBy("bucket").applyInArrow(probe, _LISTS)
    )
    answers = (
        dealt.groupBy("part")
        .cogroup(shared.groupBy("part"))
        .applyInArrow(windows, _KEYS)
        .groupBy("bucket")
        .applyInArrow(earliest, _KEYS)
    )
    result = dealt.schema["row"].dataType.simpleString()
    cut_rows = (
        dealt.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(
            cut,
            f"row {result}, text string, n_words bigint, n_removed bigint, "
            "repeats array<struct<first: bigint, after: bigint>>",
        )
    )
    chosen = [
        F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
        if c not in added
    ]
    return cut_rows.select(*chosen, *added)
