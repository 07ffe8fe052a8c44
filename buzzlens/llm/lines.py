"""Line dedup by pairwise alignment.

Two documents overlap when they share a run: consecutive lines with ``BLOCK_CHARS``
characters or more. Every line starts and ends a shortest such run, whose hash is
its key; a common block of that length, whatever its lines look like, is made of
such runs. For each key the documents that hold it are paired with the first one,
which reaches every holder and grows with their number, not with its square: what
a later pair shares beyond that has keys, and first holders, of its own. A
patience diff aligns the shared runs of a pair, and aligned runs go from the later
document. Only shared runs travel, never the lines of a whole document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.llm.words import Words, mixed, powers, text_buffers
from buzzlens.session import shared_dir

BLOCK_CHARS = 40  # a common block with fewer characters stays
SPACES = " \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES.encode())] = True
ROLL = 0x2545F4914F6CDD1D  # odd: it has an inverse modulo 2 ** 64


def _unique_places(items: list[int], low: int, high: int) -> dict[int, int]:
    """Place of each value that occurs once in ``items[low:high]``."""
    places: dict[int, int] = {}
    twice = set()
    for k in range(low, high):
        if items[k] in places:
            twice.add(items[k])
        places[items[k]] = k
    return {x: k for x, k in places.items() if x not in twice}


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that rise on both sides; ``pairs`` rise on the first."""
    tails: list[int] = []  # second places
    ends: list[int] = []  # pair that ends the best run of each length
    before: list[int] = []
    for k, (_, second) in enumerate(pairs):
        at = bisect_left(tails, second)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [second]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists by patience diff, rising on both sides.

    Common beginnings and endings are aligned, then the longest rising run of
    items that are unique on both sides; the stretches between are done alike.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(first), 0, len(second))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and first[a] == second[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and first[a_end - 1] == second[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        mine, theirs = _unique_places(first, a, a_end), _unique_places(second, b, b_end)
        shared = [(k, theirs[x]) for x, k in mine.items() if x in theirs]
        anchors = _longest_rise(sorted(shared))
        if not anchors:
            continue
        # Each stretch starts at an anchor, which its common beginning takes in.
        edges = [(a, b), *anchors, (a_end, b_end)]
        todo += [(p[0], q[0], p[1], q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(out)


def split_lines(column: pa.Array | pa.ChunkedArray) -> Words:
    """Lines with a word of each text, without white space at their ends."""
    data, offsets = text_buffers(column)
    solid = np.flatnonzero(~_BLANK[data])
    # A line starts at the first solid byte after a line end or the start of a text.
    line = np.concatenate([[0], np.cumsum(data == 10)])
    doc = np.searchsorted(offsets, solid, "right") - 1
    where = line[solid]
    first = np.ones(len(solid), bool)
    first[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    start = solid[at]
    end = solid[np.append(at[1:], len(solid)) - 1] + 1 if len(at) else start
    return Words(data, offsets, start, end, doc[at], np.searchsorted(doc[at], np.arange(len(offsets))))


def run_keys(lines: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first line and number of lines of every shortest run with ``least`` characters."""
    n = len(lines.start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Characters are bytes that do not continue one.
    chars = np.concatenate([[0], np.cumsum((lines.data & 0xC0) != 0x80)])
    total = np.concatenate([[0], np.cumsum(chars[lines.end] - chars[lines.start])])
    low, high = lines.first[lines.doc], lines.first[lines.doc + 1]
    place = np.arange(n)
    until = np.searchsorted(total, total[:-1] + least)  # the run from each line
    since = np.searchsorted(total, total[1:] - least, "right") - 1  # the run to each line
    starts = np.concatenate([place[until <= high], since[(since >= low) & (total[1:] >= least)]])
    ends = np.concatenate([until[until <= high], place[(since >= low) & (total[1:] >= least)] + 1])
    runs = np.unique(starts * (n + 1) + ends)
    starts, ends = runs // (n + 1), runs % (n + 1)
    rolls, back = powers(np.uint64(ROLL), n + 1), powers(np.uint64(pow(ROLL, -1, 2**64)), n + 1)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.hashes() * rolls[:-1])])
    key = mixed((summed[ends] - summed[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return key, starts, ends - starts


def _postings(docs: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """``id``, ``hash``, ``key``, ``size``, ``places``: every run of every document, once each."""
    rows = docs.filter(F.col(f"`{id_col}`").isNotNull() & text.isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = split_lines(batch.column("text"))
            key, start, size = run_keys(lines, least)
            doc = lines.doc[start]
            order = np.lexsort((start, key, doc))
            key, start, size, doc = key[order], start[order], size[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(key)).astype(np.int32)),
                pa.array((start - lines.first[doc]).astype(np.int32)),
            )
            owner = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(owner), batch.column("hash").take(owner),
                    pa.array(key[first].view(np.int64)), pa.array(size[first].astype(np.int32)), places,
                ],
                ["id", "hash", "key", "size", "places"],
            )

    return rows.mapInArrow(task, f"id {kind}, hash bigint, key bigint, size int, places array<int>")


def shared_runs(docs: DataFrame, id_col: str, text: Column, least: int) -> DataFrame:
    """``earlier``, ``later``, ``key``, ``size`` and both sides' places of all runs that pairs share."""
    postings = _postings(docs, id_col, text, least).select(
        F.struct("id", "hash").alias("doc"), "key", "size", "places"
    )
    # A run's holders are counted and the first one kept by each task before the shuffle. With the
    # result checkpointed, both sides of the join are shuffled for it alone, and Spark may split the
    # holders of a very common run over many tasks.
    shared_dir(docs.sparkSession)
    holder = F.min(F.struct("doc", "places")).alias("first")
    firsts = postings.groupBy("key").agg(holder, F.count("*").alias("n")).filter("n > 1").drop("n").checkpoint()
    both = postings.join(firsts, "key").filter(F.col("first.doc") < F.col("doc"))
    return both.select(
        F.col("first.doc").alias("earlier"), F.col("doc").alias("later"), "key", "size",
        F.col("first.places").alias("theirs"), F.col("places").alias("ours"),
    )


def aligned_lines(theirs: list[tuple[int, int]], ours: list[tuple[int, int]], sizes: dict[int, int]) -> set[int]:
    """Lines of our document in runs that a patience diff aligns; runs are ``(place, key)``."""
    theirs, ours = sorted(theirs), sorted(ours)
    out: set[int] = set()
    for _, k in align([key for _, key in theirs], [key for _, key in ours]):
        place, key = ours[k]
        out.update(range(place, place + sizes[key]))
    return out


def remove_common_blocks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without line blocks that an earlier, overlapping document has too.

    A block has ``block_chars`` characters at least, in lines next to each other.
    Lines are compared without white space at their ends; lines without a word
    are not compared, stay, and part no block. Texts are judged as they came in,
    whole, however long. Returns all columns with the kept lines as text, and
    ``n_lines`` and ``n_removed_lines``, which replace columns of those names.

    The earlier document is the one with the smaller id (then the smaller text
    hash). A row with a null id is left as it is; a null text has no line and
    stays null. Rows with equal id and text are one document: what goes from one
    goes from all. No rows give no rows. A block that stands in another order in
    both documents may be left, as alignments do not cross. Lines are compared
    by 64-bit hashes.
    """
    added = ("n_lines", "n_removed_lines")
    others = [c for c in docs.columns if c not in added]
    text = F.col(f"`{text_col}`").cast("string")
    runs = shared_runs(docs, id_col, text, block_chars)
    kind = runs.schema["later"].dataType.simpleString()
    # One row per document that shares a run; each of its runs is there once, with its first holder.
    # Repeated rows are one document: tasks drop their runs before the shuffle.
    grouped = runs.groupBy("later").agg(F.collect_set(F.struct("earlier", "key", "size", "theirs", "ours")).alias("runs"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for k in range(batch.num_rows):
                pairs: dict[tuple, tuple[list, list, dict]] = {}
                for run in batch.column("runs")[k].as_py():
                    theirs, ours, sizes = pairs.setdefault(tuple(run["earlier"].values()), ([], [], {}))
                    theirs += [(p, run["key"]) for p in run["theirs"]]
                    ours += [(p, run["key"]) for p in run["ours"]]
                    sizes[run["key"]] = run["size"]
                found = set().union(*(aligned_lines(*pair) for pair in pairs.values()))
                places.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("later"), pa.array(places, pa.list_(pa.int32()))], ["later", "places"]
            )

    removed = (
        grouped.mapInArrow(aligned, f"later {kind}, places array<int>")
        .filter(F.size("places") > 0)
        .select(F.col("later.id").alias("_id"), F.col("later.hash").alias("_hash"), "places")
    )
    # A document is found again by its id; its text hash tells apart others with that id.
    matched = (
        docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
        .withColumn("_hash2", F.xxhash64(F.col(f"c{others.index(text_col)}").cast("string")))
    )
    joined = matched.join(
        removed,
        (F.col(f"c{others.index(id_col)}") == F.col("_id")) & (F.col("_hash2") == F.col("_hash")),
        "left",
    ).select(*[f"c{k}" for k in range(len(others))], "places")
    at = others.index(text_col)
    schema = joined.drop("places").select("*", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("m"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for value, places in zip(batch.column(at).to_pylist(), batch.column("places").to_pylist()):
                drop, out, k = set(places or ()), [], 0
                for line in (value or "").split("\n"):
                    if line.strip(" \t\n\x0b\x0c\r"):
                        if k not in drop:
                            out.append(line)
                        k += 1
                    else:
                        out.append(line)
                texts.append("\n".join(out) if drop else value)
                totals.append(k)
                gone.append(len(drop))
            columns = [batch.column(k) for k in range(len(others))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                [*(f"c{k}" for k in range(len(others))), "n", "m"],
            )

    result = joined.mapInArrow(kept, schema.schema)
    return result.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(others)],
        F.col("n").alias("n_lines"),
        F.col("m").alias("n_removed_lines"),
    )
