"""Token-id files: documents as range-coded blocks of ids, in ascending id order.

A written table has one row per stripe: whole documents in order, about
``STRIPE`` ids of them, coded by ``idcoder`` in independent blocks with check
sums. Its columns:

* ``part``, ``stripe``: ascending order of the stripes;
* ``before``: ids of the same part before this stripe, ``n_ids``: its own;
* ``doc_ids``, ``lengths``: its documents and the number of ids of each;
* ``data``: the blocks.

Parquet only holds these rows, so that they are written and committed by Spark's
own writers on any file system; ``data`` is not compressed again.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzlens.llm import idcoder
from buzzlens.llm.bpe import _byte_symbols, load

STRIPE = 1 << 20  # ids of a stripe; a longer document has a stripe of its own
PART_BYTES = 22 << 20  # text of a part
PARTS = 100_000  # most parts; their sums are broadcast
SLICE = 4 << 20  # bytes of text tokenised at once
CACHED = 250_000  # words a task remembers between slices
SCHEMA = "part int, stripe int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"

# Fixed value: how the lower-casing word vocabulary splits texts. Its words do not depend on
# what stands beyond a space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# A word of these letters is one piece of the vocabulary, whatever follows. A mark after one
# starts another piece, so the two can be taken apart.
PLAIN = re.compile("[a-zà-öø-ÿ]+").fullmatch
MARKED = r"([a-zà-öø-ÿ])([.,;:!?])(\s|$)"


class Tokens:
    """Ids of texts by the tokenizers library, words encoded once where the vocabulary allows it."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        # Settings of the file that pad or cut texts are not part of the vocabulary.
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(content)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (steps[0].get("pattern") or {}).get("Regex") == WORD_SPLIT
        self.symbols = {b: c for c, b in _byte_symbols().items()}
        self.model = self.library.model
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of ``words``."""
        rest = []
        for word in words:
            if PLAIN(word):
                symbols = word if word.isascii() else "".join(map(self.symbols.__getitem__, word.encode()))
                self.known[word] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
            else:
                rest.append(word)
        self.known.update(zip(rest, self._encoded(rest)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text."""
        if not self.by_word:
            found = self._encoded(texts.to_pylist())
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)
        texts = texts.cast(pa.large_string())
        # Special tokens are found before letters are lower-cased.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARKED, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        missing = [w for w in words if w not in self.known]
        if len(self.known) + len(missing) > CACHED:
            self.known.clear()
            missing = words
        self._learn(missing)
        known = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, known), np.int32, len(known)) >> 2
        flat = np.frombuffer(b"".join(known), np.uint32)
        index = coded.indices.to_numpy(zero_copy_only=False)
        size_at = size[index]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size_at, dtype=np.int32)])
        shift = (np.cumsum(size, dtype=np.int32) - size)[index] - ends[:-1]
        place = np.arange(ends[-1], dtype=np.int32) + np.repeat(shift, size_at)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return flat[place], np.diff(ends[offsets]).astype(np.int64)


def _give_back() -> None:
    """Return what Arrow has freed to the system; its pool would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about ``SLICE`` bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= SLICE:
            table = pa.Table.from_batches(held).combine_chunks()
            yield table.column(0).combine_chunks(), table.column(1).combine_chunks()
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table.column(0).combine_chunks(), table.column(1).combine_chunks()


class _Stripes:
    """Stripes of one part, coded as many blocks at a time as the coder takes."""

    def __init__(self, part: int):
        self.part, self.stripe, self.before = part, 0, 0
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, docs: list, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs += docs
        self.lengths.append(lengths)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= idcoder.LANES * idcoder.BLOCK:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        """Rows of all stripes held; documents without ids go with their neighbours."""
        lengths = np.concatenate([*self.lengths, np.zeros(0, np.int64)])
        ids = np.concatenate([*self.ids, np.zeros(0, np.uint32)])
        self.lengths, self.ids, self.held = [], [], 0  # not kept twice while they are coded
        ends = np.cumsum(lengths)
        cuts, start = [0], 0  # documents at which stripes start
        while cuts[-1] < len(lengths):
            last = int(np.searchsorted(ends, start + STRIPE))
            cuts.append(min(max(last, cuts[-1]) + 1, len(lengths)))
            start = int(ends[cuts[-1] - 1])
        starts = np.concatenate([[0], ends])[cuts]
        data = idcoder.encode(ids, starts)
        n = len(data)
        rows = {
            "part": pa.array([self.part] * n, pa.int32()),
            "stripe": pa.array(range(self.stripe, self.stripe + n), pa.int32()),
            "before": pa.array(self.before + starts[:-1], pa.int64()),
            "n_ids": pa.array(np.diff(starts), pa.int64()),
            "doc_ids": pa.array([self.docs[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64())),
            "lengths": pa.array([lengths[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64())),
            "data": pa.array(data, pa.binary()),
        }
        self.stripe += n
        self.before += int(ends[-1]) if len(ends) else 0
        self.docs = []
        return pa.RecordBatch.from_pydict(rows)


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
    part_bytes: int = PART_BYTES,
) -> None:
    """Write the ids of ``docs`` to ``path``, which must not exist yet.

    ``tokenizer`` names a file of the tokenizers library; ids equal those of
    ``encode(text, add_special_tokens=False)`` and ``end_id`` follows each
    document. A null text is empty. Documents are in ascending order of
    ``id_col`` (an integer), null ids first, rows of one id by the hash of their
    text; repeated rows are written each. Other columns are not stored. A table
    without rows gives files without stripes.

    Texts are shuffled once, by ranges of (id, hash); sizes are summed over all
    texts before. A task holds one slice of texts and one group of blocks,
    however long its part; a single text is held whole.
    """
    content = load(docs.sparkSession, tokenizer)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(PARTS, max(1, -(-size // part_bytes)))
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "id", "hash").sortWithinPartitions("id", "hash").select("id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stripes = Tokens(content.value), _Stripes(TaskContext.get().partitionId())
        for ids, texts in _slices(batches):
            found, lengths = tokens.encode(texts)
            if end_id is not None:
                found = np.insert(found, np.cumsum(lengths), np.uint32(end_id))
                lengths = lengths + 1
            ids = ids.to_pylist()
            del texts
            _give_back()
            yield from stripes.add(ids, found, lengths)
        if stripes.docs:
            yield stripes.flush()

    stored = ordered.mapInArrow(task, SCHEMA)
    stored.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files at ``path``: ``id_col``, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before and ``ids`` are packed
    little-endian unsigned 32-bit integers. A block whose check sum is wrong is
    an error. Only the sums of the parts (``PARTS`` at most) meet in one place.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    placed = stored.join(F.broadcast(shifts), "part").select(
        (F.col("shift") + F.col("before")).alias("start"), "n_ids", "doc_ids", "lengths", "data"
    )

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        columns = [table.column(c).to_pylist() for c in ("start", "doc_ids", "lengths")]
        for start, docs, lengths, ids in zip(*columns, idcoder.decode(table.column("data").to_pylist())):
            ends = np.cumsum(lengths)
            if len(ids) != ends[-1]:
                raise ValueError("a stripe has lost blocks")
            offsets = np.concatenate([[0], ends]) * 4
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(docs), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(start + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    packed.cast(pa.binary()),
                ],
                ["id", "start", "n_tokens", "ids"],
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(batch.slice(k, 1))
                size += held[-1].column("n_ids")[0].as_py()
                if size >= idcoder.LANES * idcoder.BLOCK:
                    yield from rows(held)
                    held, size = [], 0
                    _give_back()
        if held:
            yield from rows(held)
        held = []
        _give_back()

    found = placed.mapInArrow(task, "id bigint, start bigint, n_tokens bigint, ids binary")
    return found.withColumnRenamed("id", id_col)
