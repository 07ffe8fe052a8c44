"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. For an anchor ``a``
and a row ``x`` the angle between them lies, for each reference, between the
difference of their stored angles and their sum (or its supplement to a full
turn). The tightest of these bounds give an interval of the cosine, and with the
norms an interval of the score, widened so that rounding never cuts a true
score off. Only rows whose interval meets a window of scores that the anchor
still wants are scored, in exact integers.

Rows are stored in slices, one row of a table each. Anchors are asked in blocks
that are broadcast; a task keeps what it has found for an anchor over all its
slices, which narrows the windows as it goes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzlens.session import scratch_path

REFERENCES = 8  # reference directions
SAMPLE = 2048  # rows they are chosen from; any directions give right results
SLICE_BYTES = 4 << 20  # of the integers of a slice
SLICE_ROWS = 2048
BLOCK_BYTES = 4 << 20  # of the integers of a block of anchors
BLOCK_ROWS = 1024
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
SCALE = 256
ANGLE_SLACK = 1e-6  # far above the error of an arc cosine in doubles, near 0 too
EXACT = 2.0**52  # doubles add integers exactly below twice this
LARGEST = 2.0**62  # scores have to fit 64 bits
NO_ID = np.iinfo(np.int64).max

SLICES = "uids binary, ids binary, labels binary, norms binary, angles binary, vectors binary, n int, dims int"


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector has no direction and stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None], norms


def _angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit, norms = _unit(vectors)
    return np.arccos(np.clip(unit @ references.T, -1.0, 1.0)), norms


def _padded(lists: list[np.ndarray], dims: int) -> np.ndarray:
    """One row per list; missing components at the end are zero."""
    out = np.zeros((len(lists), dims))
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


def usable(label: Column, vector: Column) -> Column:
    """Rows with a label and a vector whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return label.isNotNull() & vector.isNotNull() & ~bad


def reference_directions(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Directions that lie far apart: the mean, then ever the row furthest from all chosen."""
    unit, norms = _unit(sample)
    unit = unit[norms > 0]
    chosen = [unit.sum(axis=0)] if len(unit) else []
    while chosen and len(chosen) < n + 1:
        so_far, lengths = _unit(np.array(chosen))
        nearest = (unit @ so_far[lengths > 0].T).max(axis=1) if (lengths > 0).any() else np.zeros(len(unit))
        chosen.append(unit[int(np.argmin(nearest))])
    found, lengths = _unit(np.array(chosen)) if chosen else (np.zeros((0, sample.shape[1])), np.zeros(0))
    found = found[lengths > 0][:n]
    return found if len(found) else np.eye(1, sample.shape[1])


def store(
    rows: DataFrame,
    path: str,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> None:
    """Write the slices of ``rows`` to ``path``: integer vectors, norms and angles.

    A component becomes the floor of ``scale`` times it. Rows without a label or
    with a null, a non-finite or no vector are left out. Shorter vectors count as
    filled up with zeros. Every row is one of its own, whatever its id; other
    columns are not read. No rows give no slices. A vector whose square exceeds
    62 bits is an error, as its scores would not fit their type.

    Nothing is shuffled. The reference directions come from the ``SAMPLE`` rows
    with the smallest hashes.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    kept = (
        rows.select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            F.col(f"`{label_col}`").cast("bigint").alias("label"),
            vector.alias("vector"),
        )
        .filter(usable(F.col("label"), F.col("vector")))
    )
    dims = max(kept.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    some = kept.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).select("vector").toArrow()
    sample = _padded([np.floor(scale * np.array(v)) for v in some["vector"].to_pylist()], dims)
    sent = spark.sparkContext.broadcast(pickle.dumps(reference_directions(sample)))

    def sliced(uids: np.ndarray, ids: pa.Array, labels: pa.Array, lists: list[np.ndarray]) -> pa.RecordBatch:
        vectors = np.floor(scale * _padded(lists, dims))
        angles, norms = _angles(vectors, pickle.loads(sent.value))
        if len(norms) and norms.max() ** 2 > LARGEST:
            raise OverflowError("a vector is too long for 64-bit scores")
        values = {
            "uids": uids, "ids": np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64),
            "labels": np.asarray(labels, np.int64), "norms": norms, "angles": angles, "vectors": vectors.astype(np.int64),
        }
        row = {k: pa.array([v.tobytes()], pa.binary()) for k, v in values.items()}
        return pa.RecordBatch.from_pydict(row | {"n": pa.array([len(uids)], pa.int32()), "dims": pa.array([dims], pa.int32())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are told apart by their place; it is written once and read from then on.
        uid = TaskContext.get().partitionId() << 40
        size = max(1, min(SLICE_ROWS, SLICE_BYTES // (8 * dims)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                column = part.column(2)
                ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                lists = [flat[a:b] for a, b in zip(ends, ends[1:])]
                yield sliced(np.arange(uid, uid + part.num_rows), part.column(0), part.column(1), lists)
                uid += part.num_rows

    kept.mapInArrow(task, SLICES).write.parquet(path)


class _Rows:
    """A slice read back."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        for name in ("uids", "ids", "labels"):
            setattr(self, name, np.frombuffer(row[name], np.int64))
        self.norms = np.frombuffer(row["norms"])
        self.angles = np.frombuffer(row["angles"]).reshape(n, -1)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, dims)

    def take(self, at: np.ndarray) -> "_Rows":
        out = object.__new__(_Rows)
        for name, values in vars(self).items():
            setattr(out, name, values[at])
        return out

    @staticmethod
    def joined(parts: list["_Rows"]) -> "_Rows":
        out = object.__new__(_Rows)
        for name in vars(parts[0]):
            setattr(out, name, np.concatenate([vars(p)[name] for p in parts]))
        return out


def score_bounds(anchors: _Rows, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (down) with each row (across)."""
    shape = (len(anchors.ids), len(rows.ids))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for r in range(anchors.angles.shape[1]):
        a, x = anchors.angles[:, r, None], rows.angles[None, :, r]
        np.maximum(near, np.abs(a - x), out=near)
        both = a + x
        np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
    size = anchors.norms[:, None] * rows.norms[None, :]
    slack = 1 + 1e-9 * size
    high = size * np.cos(np.maximum(near - ANGLE_SLACK, 0)) + slack
    low = size * np.cos(np.minimum(far + ANGLE_SLACK, np.pi)) - slack
    return low, high


def scores(anchors: _Rows, rows: _Rows, wanted: np.ndarray) -> np.ndarray:
    """Integer scores of the ``wanted`` pairs, 0 elsewhere."""
    out = np.zeros(wanted.shape, np.int64)
    down, across = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(down):
        return out
    a, x = anchors.vectors[down], rows.vectors[across]
    if wanted.sum() * 4 < len(down) * len(across):  # few pairs: score them one by one
        i, j = np.nonzero(wanted)
        for k in range(0, len(i), 65_536):
            s = slice(k, k + 65_536)
            out[i[s], j[s]] = np.einsum("ij,ij->i", anchors.vectors[i[s]], rows.vectors[j[s]])
        return out
    # Products of doubles are exact while no partial sum can leave 53 bits.
    exact = anchors.norms[down].max() * rows.norms[across].max() < EXACT
    found = (a.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else a @ x.T
    out[np.ix_(down, across)] = found
    return np.where(wanted, out, 0)


class _Best:
    """The first ``k`` rows of each group so far, by descending score, then id, then place."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = np.zeros(0, np.int64)
        self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, np.iinfo(np.int64).min)  # a score below this changes nothing

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        if not len(group):
            return
        columns = [np.concatenate(p) for p in zip((self.group, self.score, self.id, self.uid), (group, score, ids, uids))]
        order = np.lexsort((columns[3], columns[2], -columns[1], columns[0]))
        group = columns[0][order]
        first = np.searchsorted(group, group)
        order = order[np.arange(len(group)) - first < self.k]
        self.group, self.score, self.id, self.uid = (c[order] for c in columns)
        groups, starts, counts = np.unique(self.group, return_index=True, return_counts=True)
        full = counts == self.k
        self.least[groups[full]] = self.score[starts[full] + self.k - 1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.group, pa.int32()), pa.array(self.score), pa.array(self.id), pa.array(self.uid)],
            ["part", "score", "id", "uid"],
        )


FOUND = "part int, score bigint, id bigint, uid bigint"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield _Rows(batch.slice(at, 1).to_pylist()[0])


def _tops(values: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Wanted pairs that reach their line's ``k``-th greatest wanted value."""
    if values.shape[1] > k:
        masked = np.where(wanted, values, np.iinfo(np.int64).min)
        least = np.partition(masked, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
        wanted = wanted & (values >= least[:, None])
    return np.nonzero(wanted)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("part").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    spark: SparkSession,
    slices: str,
    anchor_step: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Anchors are the stored rows whose id is divisible by ``anchor_step``; a null
    id is none. A score is the integer inner product with the anchor; higher
    ones come first, ties by smaller id (null last), then by the rows' places.
    An anchor's positives are its first ``positives`` other rows of its label; a
    repeated row is another row. For each positive the first ``negatives`` rows
    of other labels with a score from ``low`` to ``high`` percent of the
    positive's are returned.

    Two passes over the slices per block of anchors, nothing of them shuffled;
    results of a block are written before the next one starts.
    """
    path = scratch_path(spark, "negatives")
    stored = spark.read.schema(SLICES).parquet(slices)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            at = np.flatnonzero((rows.ids % anchor_step == 0) & (rows.ids != NO_ID))
            dims = rows.vectors.shape[1]
            size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
            for k in range(0, len(at), size):
                some = rows.take(at[k : k + size])
                row = {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in vars(some).items()}
                yield pa.RecordBatch.from_pydict(
                    row | {"n": pa.array([len(some.ids)], pa.int32()), "dims": pa.array([dims], pa.int32())}
                ).select([c.split()[0] for c in SLICES.split(", ")])

    stored.mapInArrow(picked, SLICES).write.parquet(f"{path}/anchors")
    groups = spark.read.schema(SLICES).parquet(f"{path}/anchors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{path}/found/block=-1")
    for number, anchors in enumerate(_blocks(groups)):
        _block(spark, stored, anchors, positives, negatives, low, high).write.parquet(f"{path}/found/block={number}")
    return spark.read.schema(schema).parquet(f"{path}/found/*")


def _blocks(groups: DataFrame) -> Iterator[_Rows]:
    """Anchors put together to blocks; the driver holds one block and one partition of anchors."""
    held: list[_Rows] = []
    size = 0
    for row in groups.toLocalIterator():
        more = _Rows(row.asDict())
        if held and (size + len(more.ids) > BLOCK_ROWS or (size + len(more.ids)) * more.vectors.shape[1] * 8 > BLOCK_BYTES):
            yield _Rows.joined(held)
            held, size = [], 0
        held.append(more)
        size += len(more.ids)
    if held:
        yield _Rows.joined(held)


def _block(
    spark: SparkSession, stored: DataFrame, anchors: _Rows, positives: int, negatives: int, low: int, high: int
) -> DataFrame:
    """Hard negatives of one block of anchors."""
    sent = spark.sparkContext.broadcast(pickle.dumps(anchors))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = pickle.loads(sent.value)
        best = _Best(len(anchors.ids), positives)
        for rows in _slices(batches):
            wanted = anchors.labels[:, None] == rows.labels[None, :]
            wanted &= anchors.uids[:, None] != rows.uids[None, :]
            wanted &= score_bounds(anchors, rows)[1] >= best.least[:, None]
            values = scores(anchors, rows, wanted)
            i, j = _tops(values, wanted & (values >= best.least[:, None]), positives)
            best.add(i, values[i, j], rows.ids[j], rows.uids[j])
        yield best.batch()

    # A few rows for each anchor of the block.
    kept = _ranked(stored.mapInArrow(near, FOUND), positives).orderBy("part", "rank").collect()
    anchor = np.array([r["part"] for r in kept], np.int64)
    positive = np.array([r["score"] for r in kept], np.int64)
    floor = -(-low * positive // 100)  # of the scores that fit, rounded up
    ceiling = high * positive // 100
    windows = spark.sparkContext.broadcast(pickle.dumps((anchor, floor, ceiling)))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = pickle.loads(sent.value)
        anchor, floor, ceiling = pickle.loads(windows.value)
        best = _Best(len(anchor), negatives)
        for rows in _slices(batches):
            under, over = score_bounds(anchors, rows)
            other = anchors.labels[:, None] != rows.labels[None, :]
            wanted = np.zeros(other.shape, bool)
            rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
            lines = [np.flatnonzero((rank == p) & (floor <= ceiling)) for p in range(positives)]
            for w in lines:  # one window of each anchor at a time
                least = np.maximum(floor, best.least)[w, None]
                wanted[anchor[w]] |= (under[anchor[w]] <= ceiling[w, None]) & (over[anchor[w]] >= least)
            wanted &= other
            values = scores(anchors, rows, wanted)
            for w in lines:
                own, least = values[anchor[w]], np.maximum(floor, best.least)[w, None]
                inside = wanted[anchor[w]] & (own >= least) & (own <= ceiling[w, None])
                i, j = _tops(own, inside, negatives)
                best.add(w[i], own[i, j], rows.ids[j], rows.uids[j])
        yield best.batch()

    def named(ids: np.ndarray) -> list[int | None]:
        return [None if i == NO_ID else int(i) for i in ids]

    pairs = [
        (w, a, p, r["score"])
        for w, (a, p, r) in enumerate(zip(named(anchors.ids[anchor]), named(np.array([r["id"] for r in kept], np.int64)), kept))
    ]
    described = spark.createDataFrame(pairs, "part int, anchor_id bigint, positive_id bigint, positive_score bigint")
    found = _ranked(stored.mapInArrow(hard, FOUND), negatives)
    return found.join(F.broadcast(described), "part").select(
        "anchor_id", "positive_id", "rank",
        F.nullif("id", F.lit(NO_ID)).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
