"""Language identification as inference of a mixture.

Character trigrams are counted per language over all labelled documents. A
document is a mixture of languages: the likelihood of each word under each
language comes from its trigrams, and expectation-maximisation estimates the
proportions. The language set is the one with the best likelihood less a
penalty per language; the prediction is its most frequent member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # trigram hash buckets
LANGUAGES = 256  # more languages than this are refused: the model is broadcast
SMOOTHING = 0.5
ROUNDS = 6  # of expectation-maximisation
MIN_SHARE = 0.02  # a smaller share is no language of the document
UNKNOWN = "und"
CHUNK = 1 << 20  # characters handled at once
SPACE = 32


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _slices(text: str) -> Iterator[str]:
    """A text in pieces of about ``CHUNK`` characters that end between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _chunks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts in groups of about ``CHUNK`` characters; a longer one comes alone, slice by slice."""
    group, size = [], 0
    for k, text in enumerate(texts):
        if group and size + len(text) > 2 * CHUNK:
            yield group
            group, size = [], 0
        if len(text) > CHUNK:
            yield from ([(k, part)] for part in _slices(text))
        else:
            group.append((k, text))
            size += len(text)
    if group:
        yield group


def trigrams(group: list[tuple[int, str]], letter: np.ndarray):
    """Bucket, word and text of every trigram of a group of texts.

    Letters are lower-cased, everything else is a space; a trigram holds a
    letter, and its word is the one its middle or first letter belongs to.
    """
    joined = " \n ".join(text.lower() for _, text in group) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letter[np.minimum(codes, 0x10FFFF)]
    # Line breaks inside texts are spaces: texts are told apart by their lengths.
    lengths = np.array([len(text.lower()) + 3 for _, text in group])
    owner = np.repeat(np.arange(len(group)), lengths)[: len(codes)]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    code = np.where(is_letter, codes, SPACE)[keep].astype(np.uint32)
    letter_kept, owner = is_letter[keep], owner[keep]
    code = np.concatenate([[SPACE], code]).astype(np.uint32)
    word = np.cumsum(~letter_kept)
    if len(code) < 3:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mixed = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (
        code[2:] * np.uint32(0xC2B2AE3D)
    )
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    # The middle character of trigram i is kept character i; it must be a letter.
    middle = letter_kept[:-1]
    return (mixed >> np.uint32(16))[middle], word[:-1][middle], owner[:-1][middle]


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, never learned from."""
    hashed = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(hashed, F.lit(4)) == 2


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``bucket``, ``n``: trigram counts over all rows with a text and a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).dropna()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, totals = letters(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for group in _chunks(batch.column("text").to_pylist()):
                bucket, _, owner = trigrams(group, letter)
                names = [langs[k] for k, _ in group]
                known = {name: i for i, name in enumerate(sorted(set(names)))}
                of = np.array([known[n] for n in names], np.int64)
                for name, i in known.items():
                    found = np.bincount(bucket[of[owner] == i], minlength=BUCKETS)
                    totals[name] = totals.get(name, 0) + found
        for name, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())],
                ["lang", "bucket", "n"],
            )

    found = rows.mapInArrow(task, "lang string, bucket int, n bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram bucket under each of them.

    The model has ``BUCKETS`` numbers per language, whatever the corpus size.
    """
    table = counts(docs, text_col, lang_col).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {LANGUAGES} are supported")
    place = {name: k for k, name in enumerate(names)}
    total = np.full((BUCKETS, max(1, len(names))), SMOOTHING)
    columns = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    total[table["bucket"].to_numpy(), columns] += table["n"].to_numpy()
    return names, np.log(total / total.sum(axis=0)).astype(np.float32)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0) if len(first) else values[:0]


def mixtures(word_logs: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = 1.0):
    """Shares of the languages in each document, zero outside the chosen language set.

    ``word_logs`` has the log-likelihood of each word under each language;
    ``doc`` (ascending) is the document of each word. Sets grow by falling share;
    a set of k languages costs ``penalty * k * log(words)``.
    """
    n, k = word_logs.shape
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    present = doc[first]
    size = np.diff(np.append(first, n))
    top = word_logs.max(axis=1, keepdims=True)
    ratio = np.exp(word_logs - top)
    base = _sums(top[:, 0].astype(np.float64), first)

    def estimate(share: np.ndarray, rounds: int, rows, starts, sizes):
        """Shares after some rounds, and the log-likelihood above ``base`` before the last."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        for _ in range(rounds):
            weighted = ratio[rows] * share[of]
            total = weighted.sum(axis=1, keepdims=True)
            share = _sums(weighted / np.maximum(total, 1e-30), starts) / sizes[:, None]
        return share, _sums(np.log(np.maximum(total[:, 0], 1e-30)).astype(np.float64), starts)

    everything = np.arange(n)
    share, _ = estimate(np.full((len(first), k), 1.0 / k), ROUNDS, everything, first, size)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros((len(first), k))
    best[np.arange(len(first)), order[:, 0]] = 1.0
    single = np.take_along_axis(_sums(word_logs.astype(np.float64), first), order[:, :1], 1)[:, 0]
    score = single - penalty * np.log(size + 1.0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None, :], 1)
    for m in range(2, k + 1):
        tried = np.flatnonzero(np.take_along_axis(share, order[:, m - 1 : m], 1)[:, 0] >= MIN_SHARE)
        if not len(tried):
            break
        rows = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in tried])
        starts = np.concatenate([[0], np.cumsum(size[tried])[:-1]])
        some = np.where(rank[tried] < m, share[tried], 0.0)
        some /= some.sum(axis=1, keepdims=True)
        some, gain = estimate(some, 3, rows, starts, size[tried])
        value = base[tried] + gain - penalty * m * np.log(size[tried] + 1.0)
        better = value > score[tried]
        score[tried[better]] = value[better]
        best[tried[better]] = some[better]
    out = np.zeros((n_docs, k))
    out[present] = best
    return out


def _shares(texts: list[str], letter: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Language shares of each text, one mixture per text however long it is."""
    shares = np.zeros((len(texts), logs.shape[1]))
    parts: list[np.ndarray] = []  # word likelihoods of a text that comes in slices
    groups = list(_chunks(texts))
    for group, after in zip(groups, [*groups[1:], []]):
        bucket, word, owner = trigrams(group, letter)
        begin = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        if len(bucket):
            word_logs, doc = np.add.reduceat(logs[bucket], begin, axis=0), owner[begin]
        else:
            word_logs, doc = np.zeros((0, logs.shape[1]), logs.dtype), np.zeros(0, np.int64)
        first = group[0][0]
        if len(group) == 1:
            parts.append(word_logs)
            if after and after[0][0] == first:
                continue
            word_logs, parts = np.concatenate(parts), []
            doc = np.zeros(len(word_logs), np.int64)
        if len(word_logs):
            shares[[k for k, _ in group]] = mixtures(word_logs, doc, len(group))
    return shares


def identify(
    docs: DataFrame, names: list[str], logs: np.ndarray, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share) and ``languages`` (the chosen set).

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Equal shares go to the first language by name. A text is one mixture
    at any length; a task holds one number per word and language of it. Columns
    of those names are replaced; rows are independent of each other and nothing
    is shuffled.
    """
    kept = docs.drop("lang_pred", "score", "languages")
    model = docs.sparkSession.sparkContext.broadcast((names, logs))
    schema = kept.select(
        "*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.array(F.lit("")).alias("languages")
    ).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        letter = letters()
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).cast(pa.string()).to_pylist()]
            if names and texts:
                shares = _shares(texts, letter, logs)
            else:
                shares = np.zeros((len(texts), max(1, len(names))))
            top = shares.argmax(axis=1)
            score = np.clip(shares[np.arange(len(texts)), top], 0.0, 1.0)
            sets = [[names[j] for j in np.flatnonzero(row > 0)] for row in shares]
            pred = [names[t] if s > 0 else UNKNOWN for t, s in zip(top, score)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string()))],
                [*batch.schema.names, "lang_pred", "score", "languages"],
            )

    return kept.mapInArrow(task, schema)
