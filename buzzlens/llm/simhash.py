"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints are cut into segments. Two fingerprints within the distance agree
in some segment up to ``distance // segments`` bits, so every fingerprint enters
one table per segment under its own value and looks up all values in the small
Hamming ball around it. What a lookup fetches is compared in full. Equal
fingerprints are one entry, and a task reports links as trees, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzlens.llm.graph import components
from buzzlens.session import shared_dir

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
SEED = 42
BITS = 64
BLOCK = 20_000  # entries of one table slot that a task compares with each other
TASK_ROWS = 2_000_000  # table rows and lookups of a task
PAIRS = 1 << 18  # comparisons made at once


def fingerprint(text: str | None, size: int) -> int:
    """SimHash of the word shingles of a text, as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    hashes = np.array(
        [
            xxhash.xxh64_intdigest(line[a:b], SEED)
            for a, b in zip(starts[: 1 - size].tolist(), stops[size - 1 :].tolist())
        ],
        "<u8",
    )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, name: str = "fingerprint"
) -> DataFrame:
    """``docs`` with the 64-bit fingerprint of each text as a (signed) bigint.

    Words are runs without ASCII white space, A-Z in lower case; fewer words
    than ``shingle`` are one shingle; no words (or null) give zero.
    """
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(0).cast("bigint")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.int64())], [*batch.schema.names, name]
            )

    return kept.mapInArrow(task, schema)


def _segments(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _balls(width: int, radius: int) -> list[int]:
    """Numbers of ``width`` bits with one to ``radius`` bits set."""
    return [
        sum(1 << bit for bit in bits)
        for k in range(1, radius + 1)
        for bits in combinations(range(width), k)
    ]


class _Forest:
    """Trees over numbers 0 .. n - 1, with array-wide root lookups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                return root
            root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the ends of all pairs in one tree."""
        while True:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            self.parent[high] = low  # of several lows any one holds; the rest follow in the next turn


def _matches(slot: np.ndarray, value: np.ndarray, probe: np.ndarray, distance: int):
    """Tree edges between values that a slot brings together and that are near each other."""
    values, index = np.unique(value, return_inverse=True)
    order = np.lexsort((probe, slot))
    slot, probe, index = slot[order], probe[order], index[order]
    entries = np.flatnonzero(~probe)
    table = slot[entries]
    low = np.searchsorted(table, slot, "left")
    high = np.searchsorted(table, slot, "right")
    # An entry meets the entries after it in its slot, a probe all entries of its slot.
    place = np.cumsum(~probe)
    low = np.where(probe, low, place)
    count = high - low
    forest = _Forest(len(values))
    asking = np.flatnonzero(count > 0)
    count, low = count[asking], low[asking]
    total = np.concatenate([[0], np.cumsum(count)])
    for begin in range(0, int(total[-1]), PAIRS):
        end = min(begin + PAIRS, int(total[-1]))
        pair = np.arange(begin, end)
        row = np.searchsorted(total, pair, "right") - 1
        a = index[asking[row]]
        b = index[entries[low[row] + pair - total[row]]]
        apart = forest.roots(a) != forest.roots(b)
        a, b = a[apart], b[apart]
        near = np.bitwise_count(values[a] ^ values[b]) <= distance
        forest.link(a[near], b[near])
    root = forest.roots(np.arange(len(values)))
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def links(values: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints within ``distance`` bits of each other.

    ``values`` has one distinct bigint column ``fingerprint``. Only enough edges
    for the same components are returned. Slots with more than ``BLOCK``
    entries are dealt out as pairs of blocks, so that no task meets them whole.
    """
    value = F.col("fingerprint")

    def table(k: int, low: int, width: int) -> tuple[Column, Column]:
        """A fingerprint's own row in table ``k``, and its lookups."""
        key = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1))
        near = F.array(*[F.lit(m).cast("bigint") for m in _balls(width, distance // segments)])
        # Of two neighbours the one with the smaller key asks.
        asked = F.filter(F.transform(near, lambda m: key.bitwiseXOR(m)), lambda x: x > key)

        def row(x: Column, probe: bool) -> Column:
            slot = F.shiftleft(F.lit(k).cast("bigint"), 50) + x
            return F.struct(slot.alias("slot"), F.lit(probe).alias("probe"))

        return F.array(row(key, False)), F.transform(asked, lambda x: row(x, True))

    rows = [table(k, low, width) for k, (low, width) in enumerate(_segments(segments))]
    entries = values.select(value, F.explode(F.concat(*[r[0] for r in rows])).alias("s"))
    everything = values.select(value, F.explode(F.concat(*[x for r in rows for x in r])).alias("s"))
    crowded = (
        entries.groupBy("s.slot").count().filter(F.col("count") > BLOCK)
        .select("slot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )  # at most a BLOCK-th of the entries
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.least(x, mine) * F.col("blocks") + F.greatest(x, mine),
    )
    dealt = (
        everything.select("fingerprint", "s.slot", "s.probe")
        .join(crowded, "slot", "left")
        .withColumn("block", F.explode(F.coalesce(meetings, F.array(F.lit(0)))))
        .select("slot", "block", "fingerprint", "probe")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        slot = table["slot"].to_numpy().astype(np.int64)
        block = table["block"].to_numpy().astype(np.int64)
        if block.any():
            _, slot = np.unique(np.stack([slot, block]), axis=1, return_inverse=True)
        a, b = _matches(
            slot,
            table["fingerprint"].to_numpy().astype(np.int64).view(np.uint64),
            table["probe"].to_numpy(zero_copy_only=False).astype(bool),
            distance,
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"]
        )

    # A task holds its rows as arrays, so their number decides how many tasks there are. A
    # fingerprint has its own row in each table and asks for half of its ball there.
    per_value = sum(1 + len(_balls(width, distance // segments)) // 2 for _, width in _segments(segments))
    least = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-values.count() * per_value // TASK_ROWS))
    return dealt.repartition(n, "slot", "block").mapInArrow(task, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id of all documents reachable over links.
    Texts without words have fingerprint zero and are linked like any others.
    Repeated rows appear repeatedly. A null id never is a component id unless
    its component has no other. No rows give no rows.

    Fingerprints are checkpointed in the shared folder and read from there.
    """
    marked, groups = _grouped(docs, id_col, text_col, shingle, distance, segments)
    return marked.join(groups, "fingerprint").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, segments: int
) -> tuple[DataFrame, DataFrame]:
    """``id``, ``hash`` of the text and ``fingerprint`` of all rows; ``root`` and ``component_id`` of each fingerprint."""
    shared_dir(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    marked = fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), "text", shingle)
    marked = marked.select("id", F.xxhash64("text").alias("hash"), "fingerprint").checkpoint()
    values = marked.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(links(values.select("fingerprint"), distance, segments))
    rooted = values.join(roots, values["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, rooted.join(least, "root").select("fingerprint", "root", "component_id")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, then text hash.

    Null ids come after all others. Ids tell nothing about being a copy: rows of
    one id, or of none, that are in no common group all stay. Of rows equal in id
    and text the one with the smallest hash of all columns stays, so a repeated
    run keeps the same rows. Null and empty texts are one group. Columns may have
    any names; no rows give no rows.
    """
    marked, groups = _grouped(docs, id_col, text_col, shingle, distance, segments)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    first = marked.join(groups, "fingerprint").groupBy("root").agg(F.min(order).alias("row"))
    stay = first.select(F.col("row.id").alias("stay_id"), F.col("row.hash").alias("stay_hash"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    names = rows.columns
    own = F.col(names[docs.columns.index(id_col)])
    hashed = rows.withColumn("hash", F.xxhash64(F.col(names[docs.columns.index(text_col)]).cast("string")))
    kept = hashed.join(stay, own.eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left_semi")
    # Spark cuts each group of equal rows to one row per task before the shuffle.
    copies = Window.partitionBy(own, "hash").orderBy(F.xxhash64(*names))
    one = kept.withColumn("copy", F.row_number().over(copies)).filter("copy = 1")
    return one.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
