"""Ranked lexical search by the Best Position Algorithm.

An index row is a shard: a few thousand documents with, for every term, a list
of documents in descending order of the term's impact on them. A shard answers
an item by reading the lists of its terms from the top, a stretch of each at a
time (sorted access). A document met in one list is looked up in all others at
once (direct access), which gives its score and its position in each. The best
position of a list is the end of the unbroken run of seen positions from its
top; direct accesses push it beyond the last position read. No unseen document
can score more than the impacts just below the best positions add up to, so a
shard is done once that sum is strictly below the k-th best score known so far.

Impacts are built from the statistics of all documents, so the best k of all
shards together are the best k of the corpus.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzlens.llm.words import Words, split_words, text_buffers
from buzzlens.session import scratch_path

TOP = 10
SHARD_DOCS = 4096  # documents of a shard; their numbers take 12 bits
SHARD_BYTES = 8 << 20  # text of a shard; a longer text is a shard of its own
BLOCK_PAIRS = 16_384  # (item, term) pairs answered in one pass over the index
FIRST_READ = 16  # positions of each list read first; each further stretch is twice as long
NO_ID = np.iinfo(np.int64).max

# Bytes that end a term become a space and A-Z become a-z; bytes of other characters stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32

INDEX = "total bigint, ids array<bigint>, terms binary, first binary, docs binary, impacts binary"


def _terms(column: pa.Array | pa.ChunkedArray) -> Words:
    """Terms of each text: runs of ASCII letters and digits and of all other characters."""
    data, offsets = text_buffers(column)
    folded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(FOLD[data])]
    )
    return split_words(folded)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ..``, ``size[0]`` numbers, then those of the next."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all documents with their repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = 0
        for batch in batches:
            counts = _terms(batch.column(0)).counts
            held += int((counts > 0).sum())
            total += int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [held], "l": [total]})

    sums = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(task, "n bigint, l bigint")
    row = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return row[0], row[1]


def _shard(ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One index row; documents are numbered by ascending id, null ids last."""
    order = pa.compute.sort_indices(ids, null_placement="at_end")
    ids, words = ids.take(order), _terms(texts.take(order))
    term = words.hashes()
    by_term = np.argsort(term, kind="stable")  # documents ascend within a term
    term, doc = term[by_term], words.doc[by_term]
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(term)))
    doc, number = doc[first], (np.cumsum(new_term) - 1)[first]
    m = 100 - 75 + 75 * words.counts[doc] * n_docs // max(n_terms, 1)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)  # below 2 ** 20
    key = (number << 32) | ((2**20 - 1 - impact) << 12) | doc
    key.sort()
    starts = np.searchsorted(key >> 32, np.arange(new_term.sum() + 1))
    values = {
        "total": pa.array([n_docs], pa.int64()),
        "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
        "terms": pa.array([term[new_term].tobytes()], pa.binary()),
        "first": pa.array([starts.astype(np.int32).tobytes()], pa.binary()),
        "docs": pa.array([(key & 4095).astype(np.uint16).tobytes()], pa.binary()),
        "impacts": pa.array([(2**20 - 1 - (key >> 12 & (2**20 - 1))).astype(np.int32).tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(values)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of ``docs`` to ``path``, which must not exist yet.

    Every row is a document of its own, whatever its id (an integer or null);
    null and empty texts have no term. Other columns are not read. No rows give
    an index without shards. Documents stay in their input splits: nothing is
    shuffled, and a task holds one shard. Texts are read twice, for the
    statistics and for the lists. Terms are kept as 64-bit hashes.
    """
    n_docs, n_terms = corpus_size(docs, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return _shard(*(pa.concat_arrays(c.chunks) for c in table.columns), n_docs, n_terms)

        for batch in batches:
            size_of = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy()
            at = 0
            while at < batch.num_rows:
                # As many rows as fit, at least one.
                room = np.searchsorted(np.cumsum(size_of[at:]), SHARD_BYTES - size, "right")
                take = int(min(room, SHARD_DOCS - rows, batch.num_rows - at)) or (0 if held else 1)
                if take:
                    held.append(batch.slice(at, take))
                    rows, size, at = rows + take, size + int(size_of[at : at + take].sum()), at + take
                if at < batch.num_rows or rows == SHARD_DOCS:
                    yield shard()
                    held, rows, size = [], 0, 0
        if held:
            yield shard()

    chosen = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen.mapInArrow(task, INDEX).write.parquet(path)


class _Shard:
    """One index row made ready for the terms of a block of items."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        terms = np.frombuffer(row["terms"], np.uint64)
        first = np.frombuffer(row["first"], np.int32)
        self.docs = np.frombuffer(row["docs"], np.uint16)
        self.impacts = np.frombuffer(row["impacts"], np.int32)
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        at = np.searchsorted(terms, vocabulary)
        at[at == len(terms)] = 0
        known = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        # Start and length of the list of each term of the vocabulary; absent terms have length 0.
        self.start = np.where(known, first[at] if len(terms) else 0, 0).astype(np.int64)
        self.size = np.where(known, first[at + 1] - first[at] if len(terms) else 0, 0).astype(np.int64)
        # Position of every document in the list of every known term, for direct access.
        rows = np.flatnonzero(self.size)
        self.row = np.full(len(vocabulary), -1)
        self.row[rows] = np.arange(len(rows))
        self.position = np.full((len(rows), len(self.ids)), -1, np.int16)
        place = _runs(self.start[rows], self.size[rows])
        depth = _runs(np.zeros(len(rows), np.int64), self.size[rows])
        self.position[np.repeat(np.arange(len(rows)), self.size[rows]), self.docs[place]] = depth


def best_positions(shard: _Shard, term: np.ndarray, factor: np.ndarray, k: int, floor: int):
    """Documents of ``shard`` and scores, among them all of its best ``k`` that reach ``floor``.

    ``term`` numbers the vocabulary, ``factor`` is what one unit of impact of
    each term adds to the score.
    """
    some = (shard.size[term] > 0) & (factor > 0)
    term, factor = term[some], factor[some]
    if not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, size = shard.start[term], shard.size[term]
    row = shard.row[term][:, None]
    lists = np.arange(len(term))
    seen = np.zeros((len(term), int(size.max()) + 1), bool)  # positions
    met = np.zeros(len(shard.ids), bool)  # documents
    found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    best, read, step = np.zeros(len(term), np.int64), 0, FIRST_READ
    least = floor
    while True:
        below = np.where(best < size, shard.impacts[start + np.minimum(best, size - 1)], 0)
        bound = int(below @ factor)
        if bound == 0 or bound < least:
            break
        stretch = np.clip(size - read, 0, step)
        docs = shard.docs[_runs(start + np.minimum(read, size), stretch)]
        new = np.flatnonzero(np.bincount(docs[~met[docs]], minlength=1))
        read, step = read + step, 2 * step
        if len(new):
            met[new] = True
            position = shard.position[row, new].astype(np.int64)
            held = position >= 0
            gained = np.where(held, shard.impacts[start[:, None] + np.maximum(position, 0)], 0)
            at_list, at_new = np.nonzero(held)
            seen[at_list, position[at_list, at_new]] = True
            found.append(new)
            scores.append(factor @ gained.astype(np.int64))
            every = np.concatenate(scores)
            if len(every) >= k:
                least = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
        # The first position that is not seen; the row's last place never is.
        best = np.argmin(seen, axis=1)
        best = np.where(seen[lists, best], size, best)
    docs, every = np.concatenate(found), np.concatenate(scores)
    kept = (every >= least) & (every > 0)
    return docs[kept], every[kept]


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``terms``, ``repeats``, ``pairs`` of each distinct row of (id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _terms(batch.column(1))
            term = words.hashes()
            terms, repeats, pairs = [], [], []
            for a, b in zip(words.first, words.first[1:]):
                distinct, times = np.unique(term[a:b], return_counts=True)
                terms.append(distinct.tobytes())
                repeats.append(times.astype(np.int64).tobytes())
                pairs.append(len(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(terms, pa.binary()), pa.array(repeats, pa.binary()), pa.array(pairs, pa.int64())],
                ["item", "terms", "repeats", "pairs"],
            )

    chosen = items.select(
        F.col(f"`{id_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    return chosen.distinct().mapInArrow(task, "item bigint, terms binary, repeats binary, pairs bigint")


def _blocks(asked: DataFrame) -> tuple[DataFrame, int]:
    """``asked`` with a ``block`` each, so that a block has ``BLOCK_PAIRS`` pairs or one row."""
    total = asked.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_PAIRS))
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item", "terms", "repeats"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum("pairs").alias("p"), F.countDistinct("item", "terms", "repeats").alias("r"))
        if not sizes.filter((F.col("p") > BLOCK_PAIRS) & (F.col("r") > 1)).limit(1).count():
            return dealt, n
        n *= 2


def search(
    spark: SparkSession,
    index: str,
    items: DataFrame,
    k: int = TOP,
    item_col: str = "item_id",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``item_col``, ``rank``, ``id_col``, ``score``: the ``k`` best documents for each item.

    ``index`` was written by ``build``. Only scores above 0 count; equal scores
    go by ascending document id, null ids last. Rows of ``items`` that are equal
    in id and text are one item; rows of one id with other texts are ranked each
    by itself. A null or empty text has no term and no result. Other columns of
    ``items`` are not read.

    Items are answered in blocks of ``BLOCK_PAIRS`` (item, term) pairs (an item
    with more is a block of its own), which are broadcast; each block is one
    pass over the index without a shuffle of it. A task keeps the best ``k`` of
    an item over all its shards, so a later shard has to beat them.
    """
    path = scratch_path(spark, "ranked")
    asked_path = f"{path}/items"
    _item_terms(items, item_col, text_col).write.parquet(asked_path)
    asked, n_blocks = _blocks(spark.read.parquet(asked_path))
    shards = spark.read.schema(INDEX).parquet(index)
    total = shards.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    for block in range(n_blocks):
        rows = asked.filter(F.col("block") == block).select("item", "terms", "repeats").collect()
        _answers(spark, shards, total, rows, k).write.parquet(f"{path}/found/block={block}")
    found = spark.read.schema("block int, number int, item bigint, doc bigint, score bigint").parquet(f"{path}/found")
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _answers(spark: SparkSession, shards: DataFrame, total: int, rows: list, k: int) -> DataFrame:
    """The best ``k`` of each task for the items of one block."""
    terms = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
    wanted = spark.sparkContext.broadcast(vocabulary.tobytes())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.frombuffer(wanted.value, np.uint64)
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, first in zip(*(batch.column(c).to_pylist() for c in ("terms", "first"))):
                held, size = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(first, np.int32))
                if len(held):
                    at = np.minimum(np.searchsorted(held, vocabulary), len(held) - 1)
                    df += np.where(held[at] == vocabulary, size[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], ["term", "df"])

    counted = shards.select("terms", "first").mapInArrow(frequencies, "term int, df bigint")
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in counted.groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    asked = []
    for row, own in zip(rows, terms):
        at = np.searchsorted(vocabulary, own)
        asked.append((row["item"], at, weight[at] * np.frombuffer(row["repeats"], np.int64)))
    sent = spark.sparkContext.broadcast(pickle.dumps(asked))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.frombuffer(wanted.value, np.uint64)
        asked = pickle.loads(sent.value)
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)  # scores and ids
        for batch in batches:
            for at in range(batch.num_rows):
                shard = _Shard(batch.slice(at, 1).to_pylist()[0], vocabulary)
                for i, (_, term, factor) in enumerate(asked):
                    scores, ids = top[i]
                    floor = int(scores[-1]) if len(scores) == k else 0
                    docs, fresh = best_positions(shard, term, factor, k, floor)
                    if len(docs):
                        scores, ids = np.concatenate([scores, fresh]), np.concatenate([ids, shard.ids[docs]])
                        kept = np.lexsort((ids, -scores))[:k]
                        top[i] = scores[kept], ids[kept]
        size = [len(scores) for scores, _ in top]
        ids = np.concatenate([*(ids for _, ids in top), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(asked)), size), pa.int32()),
                pa.array([asked[i][0] for i, n in enumerate(size) for _ in range(n)], pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == NO_ID),
                pa.array(np.concatenate([*(s for s, _ in top), np.zeros(0, np.int64)]), pa.int64()),
            ],
            ["number", "item", "doc", "score"],
        )

    return shards.select("ids", "terms", "first", "docs", "impacts").mapInArrow(
        task, "number int, item bigint, doc bigint, score bigint"
    )
