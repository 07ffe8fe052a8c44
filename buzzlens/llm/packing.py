"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Every task packs the documents of its own input split as they come. A document
longer than a window fills whole windows first. The rest goes to the fill level
for which the sum of squared numbers of partially filled windows grows least;
those numbers are kept in one array with a slot per level. At most ``OPEN``
windows are open at a time: when they are, a document that fits none of them
whole is cut, and its first tokens close a window of the level that lowers the
sum most. When the documents of the split are used up, the few windows still
open are closed by moving (and cutting) what lies in the emptiest ones into the
gaps of the fullest, so that a task pads one window at most. Nothing is shuffled,
and a lost task packs the same documents in the same way when it is run again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from buzzlens.llm.bpe import Vocabulary, load, settled_rows

LENGTH = 2048
END_ID = 1
OPEN = 128  # windows of a task that are partially filled
FAR = np.int64(2**40)
ROWS = 4096  # pieces in one result batch


class Packer:
    """Windows of ``length`` tokens filled by the sum-of-squares rule."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length = length
        self.most = most
        self.open = 0  # windows in ``windows``
        # Slot k is fill level ``length - k``, so that the first smallest is the fullest.
        self.open_gain = np.full(length + 1, FAR)  # 1 - 2 * windows: taking one away
        self.open_gain[length] = 0  # a new window takes none away
        self.fill_cost = np.ones(length + 1, np.int64)  # 1 + 2 * windows: adding one
        self.fill_cost[0] = 0  # a full window is not partially filled
        self.windows: dict[int, list[list]] = {}

    def _changed(self, level: int) -> None:
        n = len(self.windows[level])
        slot = self.length - level
        self.fill_cost[slot] = 1 + 2 * n
        self.open_gain[slot] = 1 - 2 * n if n else FAR

    def place(self, size: int, item, start: int = 0) -> list[list]:
        """Put an item of ``size`` tokens; the windows that are full now, as (item, start, size).

        Of levels that cost the same the fullest is taken.
        """
        done: list[list] = []
        n = self.length
        while True:
            cost = self.open_gain[size:] + self.fill_cost[: n + 1 - size]
            if self.open == self.most:
                cost = cost[:-1]  # no new window
            at = int(np.argmin(cost)) if len(cost) else -1
            if at >= 0 and cost[at] < FAR // 2:
                break
            # It fits no window whole: close one with its first tokens.
            gap = 1 + int(np.argmin(self.open_gain[1:size]))
            window = self.windows[n - gap].pop()
            self._changed(n - gap)
            self.open -= 1
            window.append((item, start, gap))
            done.append(window)
            size, start = size - gap, start + gap
        level = n - size - at
        window = []
        if level:
            window = self.windows[level].pop()
            self._changed(level)
        window.append((item, start, size))
        if level + size == n:
            self.open -= bool(level)
            return [*done, window]
        self.open += not level
        self.windows.setdefault(level + size, []).append(window)
        self._changed(level + size)
        return done

    def close(self) -> Iterator[list]:
        """The open windows, all but one filled to the end."""
        levels = sorted(self.windows, reverse=True)
        left = [[level, window] for level in levels for window in self.windows[level]]
        full, empty = 0, len(left) - 1
        while full < empty:
            gap = self.length - left[full][0]
            if gap == 0:
                full += 1
                continue
            item, start, size = left[empty][1].pop()
            moved = min(gap, size)
            if moved < size:
                left[empty][1].append((item, start, size - moved))
            left[full][1].append((item, start + size - moved, moved))
            left[full][0] += moved
            left[empty][0] -= moved
            if not left[empty][1]:
                empty -= 1
        for _, window in left:
            if window:
                yield window


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``length`` tokens.

    A document is the ids of its text by the tokenizer file ``path`` and then
    ``end_id``. Returns ``id_col``, ``start`` (ids of the document before the
    piece), ``length``, ``ids`` (packed little-endian unsigned 32-bit integers),
    ``doc_tokens``, ``sequence_id`` and ``offset`` (place in the sequence). Every
    id lies in one piece; offsets of a sequence are gapless from 0.

    A null or empty text is a document of one id. Repeated rows and null ids are
    packed like any others; other columns are not returned. No rows give no
    rows. A long text is encoded whole. A task keeps the tokens of ``OPEN``
    windows, ``length`` at most each, and pads one window in all: less than
    ``length`` tokens of its split. Ties go to the fullest window.
    """
    content = load(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(id_col, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(content.value)
        end = array("I", [end_id]).tobytes()
        packer, rows = Packer(length), []
        base = TaskContext.get().partitionId() << 36
        sequence, schema = 0, None

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, first, ids, total), start, size in window:
                raw = ids[4 * start : 4 * (start + size)]
                rows.append((doc, first + start, size, raw, total, base + sequence, offset))
                offset += size
            sequence += 1

        def batch_of(some: list) -> pa.RecordBatch:
            columns = list(zip(*some)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for batch in batches:
            schema = schema or pa.schema(
                [(id_col, batch.schema.field(0).type)]
                + [(c, pa.int64()) for c in ("start", "length")]
                + [("ids", pa.binary())]
                + [(c, pa.int64()) for c in ("doc_tokens", "sequence_id", "offset")]
            )
            column = batch.column(1).cast(pa.string())
            for doc, text, settled in zip(
                batch.column(0).to_pylist(), column.to_pylist(), settled_rows(column)
            ):
                ids = vocabulary.encode(text or "", bool(settled)) + end
                total = len(ids) // 4
                whole = total // length * length
                for start in range(0, whole, length):
                    emit([((doc, 0, ids, total), start, length)])
                if whole < total:
                    item = (doc, whole, ids[4 * whole :], total)
                    for window in packer.place(total - whole, item):
                        emit(window)
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows.clear()
        for window in packer.close():
            emit(window)
        for k in range(0, len(rows), ROWS):
            yield batch_of(rows[k : k + ROWS])

    return narrow.mapInArrow(
        task,
        f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
