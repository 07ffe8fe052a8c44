"""Document quality by co-training of two views.

One classifier reads the text (byte pairs and repetition), the other one the
page's metadata (source, language, length). Both start from the same labelled
rows. In every round each scores all unlabelled documents, and those it is surest
of become labelled rows of the other one; rounds end early when neither has any
to give. A last step on labelled rows kept aside calibrates both views and weighs
them, and the result scores every document.

The classifiers are fitted on the driver, from at most ``LABELLED`` labelled rows,
picked by a hash of their id, and from what the views teach each other, at most
``TAUGHT`` documents of each class per view and round. These are picked by Spark
from all unlabelled rows; there is no smaller pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens.llm.words import mixed, split_words, text_buffers, window_hashes
from buzzlens.session import scratch_path

LABELLED = 4_000
ROUNDS = 3
SURE = 0.9  # probability from which a view teaches the other one
TAUGHT = 400  # documents of each class that a view teaches per round
PAIRS = 1 << 16
WIDTH = PAIRS + 2  # byte pairs, share of repeated words, share of repeated 5-word windows
META = 1 << 12
CHUNK = 4 << 20  # bytes of text handled at once


@dataclass
class Rows:
    """Sparse rows: the entries of row ``k`` lie at ``first[k]:first[k + 1]``."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * weights[self.index])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def take(self, rows: np.ndarray) -> "Rows":
        size = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[rows], size)
        return Rows(first, self.index[at], self.value[at])

    @staticmethod
    def join(parts: list["Rows"]) -> "Rows":
        size = np.concatenate([np.diff(p.first) for p in parts])
        first = np.concatenate([[0], np.cumsum(size)])
        return Rows(first, np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]))


def _repeated(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of each document's keys that it has more than once."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc, same, n) / np.maximum(np.bincount(doc, minlength=n), 1)


def text_rows(column: pa.Array) -> Rows:
    """Text view of each row; a text is read in slices, so that memory stays bounded."""
    data, offsets = text_buffers(column)
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[last]]
        at = offsets[row : last + 1] - offsets[row]
        owner = np.repeat(np.arange(row, last), np.diff(at))
        if len(part) > 1:
            inside = owner[1:] == owner[:-1]
            pair = (part[:-1].astype(np.int64) << 8 | part[1:]) | owner[:-1] << 16
            key, count = np.unique(pair[inside], return_counts=True)
            keys.append(key)
            counts.append(count)
        row = last
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    value = np.log1p(np.concatenate([np.zeros(0), *counts]))
    n = len(offsets) - 1
    owner, index = key >> 16, key & (PAIRS - 1)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value = value / np.maximum(norm[owner], 1e-12)
    words = split_words(column)
    hashed, at = words.hashes(), words.window_starts(5)
    extra = [
        _repeated(hashed, words.doc, n),
        _repeated(window_hashes(hashed, at, 5), words.doc[at], n),
    ]
    owner = np.concatenate([owner, np.arange(n), np.arange(n)])
    index = np.concatenate([index, np.full(n, PAIRS), np.full(n, PAIRS + 1)])
    value = np.concatenate([value, *extra])
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n + 1))
    return Rows(first, index[order].astype(np.int32), value[order].astype(np.float32))


def meta_rows(source: list, lang: list, chars: list) -> Rows:
    """Metadata view: source, language, both together and the length in powers of two, hashed."""
    names = [
        (f"source:{x}", f"lang:{y}", f"both:{x}:{y}", f"size:{int(c).bit_length() if c is not None else None}")
        for x, y, c in zip(source, lang, chars)
    ]
    hashed = np.array([hash_name(x) for row in names for x in row], np.uint64)
    index = (mixed(hashed) % np.uint64(META)).astype(np.int32)
    n = len(chars)
    return Rows(np.arange(n + 1) * 4, index, np.full(4 * n, 0.5, np.float32))


def hash_name(name: str) -> int:
    """64 bits of a name, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(name.encode("utf-8", "replace"))


def fit(rows: Rows, label: np.ndarray, width: int, steps: int = 80, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic regression, by adaptive gradient steps."""
    weights, squares = np.zeros(width + 1), np.full(width + 1, 1e-8)
    n = max(1, len(label))
    balance = np.where(label > 0, n / max(1, 2 * (label > 0).sum()), n / max(1, 2 * (label == 0).sum()))
    owner = np.repeat(np.arange(len(label)), np.diff(rows.first))
    for _ in range(steps):
        error = (sigmoid(rows.dot(weights[:-1]) + weights[-1]) - label) * balance / n
        slope = np.bincount(rows.index, rows.value * error[owner], width) + decay * weights[:-1]
        slope = np.append(slope, error.sum())
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    mix: np.ndarray  # weights of both views' logits, and a constant

    def logits(self, text: Rows, meta: Rows) -> np.ndarray:
        return np.stack(
            [text.dot(self.text[:-1]) + self.text[-1], meta.dot(self.meta[:-1]) + self.meta[-1]], 1
        )

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(logits @ self.mix[:2] + self.mix[2])


def calibrated(weights: list[np.ndarray], text: Rows, meta: Rows, label: np.ndarray) -> Model:
    """The model of both views, weighed by labelled rows that neither has learned from."""
    model = Model(weights[0], weights[1], np.array([1.0, 0.0, 0.0]))
    if len(set(label.tolist())) == 2:
        logits = np.clip(model.logits(text, meta), -10, 10)
        dense = Rows(np.arange(len(label) + 1) * 2, np.tile([0, 1], len(label)), logits.reshape(-1))
        model.mix = fit(dense, label.astype(float), 2, decay=0.0)
    return model


def _views(batch) -> tuple[Rows, Rows]:
    column = lambda name: batch.column(name).to_pylist()
    return text_rows(batch.column("text")), meta_rows(column("source"), column("lang"), column("n_chars"))


VIEWS = "id bigint, hash bigint, ti array<int>, tv array<float>, mi array<int>, mv array<float>"


@dataclass
class Sample:
    """Rows on the driver: both views of documents, and their ids."""

    ids: np.ndarray
    views: tuple[Rows, Rows]

    @classmethod
    def of(cls, docs: DataFrame) -> "Sample":
        """Both views of all rows of ``docs`` (``id``, ``hash`` and the columns they are made from), by id."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = []
                for view in _views(batch):
                    first = pa.array(view.first.astype(np.int32))
                    columns += [pa.ListArray.from_arrays(first, pa.array(view.index)),
                                pa.ListArray.from_arrays(first, pa.array(view.value))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("hash"), *columns], ["id", "hash", "ti", "tv", "mi", "mv"]
                )

        table = docs.mapInArrow(task, VIEWS).toArrow().sort_by([("id", "ascending"), ("hash", "ascending")]).combine_chunks()

        def gathered(index: str, value: str) -> Rows:
            if not table.num_rows:
                return Rows(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
            lists = table[index].combine_chunks()
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            return Rows(first, lists.flatten().to_numpy(), table[value].combine_chunks().flatten().to_numpy())

        return cls(table["id"].to_numpy(), (gathered("ti", "tv"), gathered("mi", "mv")))


def _sure(rows: DataFrame, weights: list[np.ndarray], path: str) -> list[dict[tuple[int, int], int]]:
    """What each view teaches: the documents of each class it is surest of, of all ``rows``.

    All rows are scored by both views in one pass; the scores are written.
    """
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                pa.array(sigmoid(view.dot(w[:-1]) + w[-1])) for view, w in zip(_views(batch), sent.value)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *found], ["id", "hash", "p0", "p1"])

    schema = "id bigint, hash bigint, p0 double, p1 double"
    rows.mapInArrow(task, schema).write.parquet(path)
    scored = rows.sparkSession.read.schema(schema).parquet(path)
    out: list[dict[tuple[int, int], int]] = []
    for p in ("p0", "p1"):
        taught: dict[tuple[int, int], int] = {}
        for value, surest, least in ((1, F.desc(p), F.col(p) >= SURE), (0, F.asc(p), F.col(p) <= 1 - SURE)):
            best = scored.filter(least).select("id", "hash", p).orderBy(surest, "id", "hash").limit(TAUGHT)
            taught |= {(r["id"], r["hash"]): value for r in best.collect()}
        out.append(taught)
    return out


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", rounds: int = ROUNDS
) -> Model:
    """Model from a bounded sample of labelled rows and from all unlabelled ones.

    Rows with a null id, label or text teach nothing; of several labels of an id
    the greatest counts, and each row with that id teaches it; rows equal in id
    and text are taught once. Other columns of ``docs`` are not read. Long texts
    are read whole, slice by slice. Without any label, or any row, all weights
    are zero and every score is one half. ``rounds=0`` leaves both views with
    the labelled rows alone.
    """
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(target).cast("int").alias("label")).dropna()
    sample = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    label_of = {r["id"]: r["label"] for r in sample.collect()}
    used = docs.select(  # others may have any names
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64("text").alias("hash"), "text", "source", "lang", "n_chars"
    ).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    known = docs.sparkSession.createDataFrame([(i,) for i in label_of], "id bigint")  # LABELLED rows at most
    first = Sample.of(used.join(F.broadcast(known), "id", "left_semi"))
    if not len(first.ids):
        return Model(np.zeros(WIDTH + 1), np.zeros(META + 1), np.zeros(3))
    label = np.array([label_of[i] for i in first.ids.tolist()])
    aside = mixed(first.ids.astype(np.uint64)) % np.uint64(5) == 0
    start = np.flatnonzero(~aside)
    # What each view learns from: views of documents and their labels.
    lessons = [([view.take(start)], [label[start].astype(float)]) for view in first.views]
    widths = (WIDTH, META)

    def fitted() -> list[np.ndarray]:
        return [fit(Rows.join(rows), np.concatenate(marks), width) for (rows, marks), width in zip(lessons, widths)]

    weights = fitted()
    free = used.join(F.broadcast(known), "id", "left_anti")
    done: list[set[tuple[int, int]]] = [set(), set()]  # what each view was taught
    for turn in range(rounds):
        taught = _sure(free, weights, scratch_path(docs.sparkSession, f"cotraining-{turn}"))
        news = [{k: v for k, v in taught[1 - view].items() if k not in done[view]} for view in (0, 1)]
        if not any(news):
            break
        keys = sorted({k for some in news for k in some})  # 4 * TAUGHT at most
        wanted = docs.sparkSession.createDataFrame(keys, "id bigint, hash bigint")
        rows = used.join(F.broadcast(wanted), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
        found = Sample.of(rows)
        for view in (0, 1):
            at = np.array([k for k, key in enumerate(keys) if key in news[view]], np.int64)
            lessons[view][0].append(found.views[view].take(at))
            lessons[view][1].append(np.array([news[view][keys[k]] for k in at.tolist()], float))
            done[view] |= set(news[view])
        weights = fitted()
    kept = np.flatnonzero(aside)
    return calibrated(weights, *(view.take(kept) for view in first.views), label[kept])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``text_score``, ``meta_score``, ``score`` and ``kept`` for every row of ``docs``.

    Needs columns ``text``, ``source``, ``lang`` and ``n_chars``; nulls there are
    values like any others (a null text is empty). Other columns are not
    returned. Rows are independent of each other and nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.text, model.meta, model.mix))
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            logits = model.logits(*_views(batch))
            scores = model.score(logits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *(pa.array(sigmoid(logits[:, k])) for k in (0, 1)),
                 pa.array(scores), pa.array(scores >= 0.5)],
                [id_col, "text_score", "meta_score", "score", "kept"],
            )

    return docs.select(id_col, "text", "source", "lang", "n_chars").mapInArrow(
        task, f"`{id_col}` {kind}, text_score double, meta_score double, score double, kept boolean"
    )
