"""BPE encoding and decoding by tree concatenation.

A text is cut into special tokens and, after normalisation, into pieces as the
tokenizer file says; pieces are encoded once and looked up afterwards. A long
piece is encoded as a tree: both halves by themselves, then a window of tokens
around the join is encoded anew and grows until its outermost tokens are those
of the halves. Two tokens side by side never depend on tokens further away, so
agreement at both edges makes the concatenation the exact encoding.

Documents with an unsplit stretch of ``LONG`` bytes or more are cut into blocks
that Spark encodes in parallel; the blocks are then joined in the same way.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens.llm.words import text_buffers
from buzzlens.session import shared_dir

LEAF = 256  # bytes that are encoded at once
LONG = 32_768  # unsplit bytes from which a text is encoded by several tasks
CACHED = 300_000  # pieces a task remembers
# Below this code point every Unicode version agrees on letters and numbers; texts
# beyond it are split by the tokenizers library itself.
SETTLED = 0x540
SETTLED_LEAD = 0xD5  # first byte of U+0540 and of everything above, in UTF-8
END = b"\xff"  # stands for the end of a word; no UTF-8 text has this byte

SPACE = r"\t-\r \x85\xa0"


def _category(kind: str) -> str:
    """A character class of all settled code points of one general category."""
    points = [c for c in range(SETTLED) if unicodedata.category(chr(c))[0] == kind]
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


LETTER, NUMBER = _category("L"), _category("N")
SHORT = "'(?:s|t|re|ve|m|ll|d)"
# The two published splitting rules, alternatives in an order of equal meaning.
BYTE_PIECES = (
    f" ?[{LETTER}]+| ?[{NUMBER}]+|{SHORT}| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PIECES = f"[{LETTER}]+|[{NUMBER}]|{SHORT}|[^{SPACE}{LETTER}{NUMBER}]+"


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers JSON file.

    Two kinds are known: pieces with their leading space (no end-of-word
    suffix), and lower-cased words with an end-of-word suffix.
    """

    def __init__(self, content: bytes):
        import tiktoken

        self.content = content
        spec = json.loads(content)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.end = END if suffix else b""
        self.names = {i: name for name, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: name for name, i in self.special.items()}
        symbols = _byte_symbols()
        ranks = {}
        for name, i in model["vocab"].items():
            if name in self.special:
                continue
            ended = bool(suffix) and name.endswith(suffix)
            core = name[: -len(suffix)] if ended else name
            ranks[bytes(symbols[c] for c in core) + END * ended] = i
        self.bytes_of = {i: raw for raw, i in ranks.items()}
        encoding = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self._leaf = encoding._core_bpe.encode_single_piece
        self._pieces = re.compile(WORD_PIECES if suffix else BYTE_PIECES).findall
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._spaces = re.compile(f"[{SPACE}]+")
        self._symbols = symbols
        self._library = None
        self.cache = _Cache(self)

    # Splitting

    def library(self):
        """The tokenizers library's own object, for its splitting and normalisation."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content.decode())
        return self._library

    def split(self, text: str, settled: bool) -> list[str]:
        """Pieces of a text without special tokens."""
        if settled:
            if self.end:
                text = self._spaces.sub(" ", unicodedata.normalize("NFC", text))
                text = text.replace("Σ", "σ").lower()
            return self._pieces(text)
        library = self.library()
        if library.normalizer is not None:
            text = library.normalizer.normalize_str(text)
        return [
            bytes(map(self._symbols.__getitem__, piece)).decode()
            for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)
        ]

    def stretches(self, text: str) -> list[str]:
        """The text cut around special tokens; every second item is one."""
        return self._specials.split(text) if "<|" in text else [text]

    # Encoding

    def encode(self, text: str, settled: bool | None = None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if settled is None:
            settled = all(ord(c) < SETTLED for c in text)
        out = []
        for k, stretch in enumerate(self.stretches(text)):
            if k % 2:
                out.append(array("I", [self.special[stretch]]).tobytes())
            else:
                out += map(self.cache.__getitem__, self.split(stretch, settled))
        return b"".join(out)

    def tree(self, raw: bytes) -> list[int]:
        """Ids of one piece, given as bytes with its end mark."""
        if len(raw) <= LEAF:
            return self._leaf(raw)
        half = len(raw) // 2
        return self.join(self.tree(raw[:half]), self.tree(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two adjoining encoded stretches of one piece taken together."""
        size = 2
        while True:
            low, high = max(0, len(left) - size), min(len(right), size)
            window = b"".join(map(self.bytes_of.__getitem__, left[low:] + right[:high]))
            middle = self._leaf(window)
            agrees_left = low == 0 or middle[0] == left[low]
            agrees_right = high == len(right) or middle[-1] == right[high - 1]
            if agrees_left and agrees_right:
                return left[:low] + middle + right[high:]
            size *= 2

    # Decoding

    def decode(self, ids: bytes) -> str:
        """Text of packed ids: words with their suffix joined by spaces, or the bytes as text."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.end:
            return " ".join(map(self.names.__getitem__, numbers))
        special = {i: name.encode() for name, i in self.special.items()}
        raw = b"".join(self.bytes_of.get(i) or special[i] for i in numbers)
        return raw.decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids of each piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        v = self.vocabulary
        raw = piece.encode() + v.end
        if len(raw) > LEAF:  # long pieces hardly return
            return array("I", v.tree(raw)).tobytes()
        if len(self) >= CACHED:
            self.clear()
        ids = self[piece] = array("I", v._leaf(raw)).tobytes()
        return ids


def settled_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each text has settled code points only."""
    data, offsets = text_buffers(column)
    beyond = np.concatenate([[0], np.cumsum(data >= SETTLED_LEAD, dtype=np.int32)])
    return np.diff(beyond[offsets]) == 0


def load(spark: SparkSession, path: str):
    """The tokenizer file at ``path`` on the driver (a few MB), sent to the executors once."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = [values if f.name == name else batch.column(f.name) for f in batch.schema]
    names = batch.schema.names
    if name not in names:
        columns, names = [*columns, values], [*names, name]
    return pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: token ids as packed little-endian unsigned 32-bit integers.

    ``path`` names a byte-level BPE file of the tokenizers library; ids equal
    those of ``encode(text, add_special_tokens=False)``. Null and empty texts
    give no ids. An existing ``ids_col`` is replaced. Rows are independent, so
    repeated rows and extra columns do no harm. Only documents with an unsplit
    stretch of ``LONG`` bytes are shuffled.
    """
    content = load(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.drop(ids_col)
    unsplit = (F.octet_length(text) >= LONG) & text.rlike(f"\\S{{{LONG // 4},}}+")
    schema = kept.withColumn(ids_col, F.lit(b"")).schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(content.value)
        for batch in batches:
            column = batch.column(text_col).cast(pa.string())
            ids = [
                vocabulary.encode(t or "", bool(s))
                for t, s in zip(column.to_pylist(), settled_rows(column))
            ]
            yield _with_column(batch, ids_col, pa.array(ids, pa.binary()))

    ordinary = kept.filter(~unsplit).mapInArrow(whole, schema)
    return ordinary.unionByName(_encode_unsplit(kept.filter(unsplit), content, text_col, ids_col))


def _encode_unsplit(docs: DataFrame, content, text_col: str, ids_col: str) -> DataFrame:
    """Ids of documents with long unsplit stretches, encoded block by block."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Checkpointed: the numbers are read twice and must be the same ones.
    shared_dir(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), row).checkpoint()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece's blocks (raw bytes) or of short pieces taken together (ids)."""
        vocabulary = Vocabulary(content.value)
        for batch in batches:
            texts = pa.array([r[text_col] for r in batch.column("row").to_pylist()], pa.string())
            for uid, text, settled in zip(
                batch.column("uid").to_pylist(), texts.to_pylist(), settled_rows(texts)
            ):
                rows = []
                for k, stretch in enumerate(vocabulary.stretches(text)):
                    if k % 2:
                        rows.append((len(rows), None, vocabulary.encode(stretch)))
                        continue
                    for piece in vocabulary.split(stretch, bool(settled)):
                        raw = piece.encode() + vocabulary.end
                        if len(raw) < LONG:
                            ids = vocabulary.cache[piece]
                            if rows and rows[-1][1] is None:
                                rows[-1] = (rows[-1][0], None, rows[-1][2] + ids)
                            else:
                                rows.append((len(rows), None, ids))
                        else:
                            item = len(rows)
                            rows += [
                                (item, raw[at : at + LONG // 2], None)
                                for at in range(0, len(raw), LONG // 2)
                            ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uid] * len(rows), pa.int64()),
                        pa.array(range(len(rows)), pa.int32()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["uid", "place", "item", "raw", "ids"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(content.value)
        for batch in batches:
            ids = [
                i if raw is None else array("I", vocabulary.tree(raw)).tobytes()
                for raw, i in zip(batch.column("raw").to_pylist(), batch.column("ids").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("uid", "place", "item")] + [pa.array(ids, pa.binary())],
                ["uid", "place", "item", "ids"],
            )

    def joined(key, table):
        vocabulary = Vocabulary(content.value)
        table = table.sort_by("place")
        items: dict[int, list[list[int]]] = {}
        for item, ids in zip(table["item"].to_pylist(), table["ids"].to_pylist()):
            items.setdefault(item, []).append(np.frombuffer(ids, "<u4").tolist())
        out = []
        for parts in items.values():
            while len(parts) > 1:  # neighbours, level by level
                parts = [
                    vocabulary.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k]
                    for k in range(0, len(parts), 2)
                ]
            out.append(array("I", parts[0]).tobytes())
        return pa.table({"uid": [key[0].as_py()], "ids": pa.array([b"".join(out)], pa.binary())})

    kinds = "uid bigint, place int, item int"
    ids = (
        keyed.mapInArrow(cut, f"{kinds}, raw binary, ids binary")
        .repartition("uid", "place")
        .mapInArrow(leaves, f"{kinds}, ids binary")
        .groupBy("uid")
        .applyInArrow(joined, "uid bigint, ids binary")
    )
    together = keyed.join(ids, "uid", "left")
    return together.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce("ids", F.lit(b"")).alias(ids_col),
    )


def decode(
    rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded"
) -> DataFrame:
    """``rows`` with ``text_col``: the text of packed ids, special tokens included.

    Equal to the library's ``decode(ids, skip_special_tokens=False)``. Null ids
    give an empty text; an existing ``text_col`` is replaced. An id outside the
    vocabulary is an error.
    """
    content = load(rows.sparkSession, path)
    kept = rows.drop(text_col)
    schema = kept.withColumn(text_col, F.lit("")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(content.value)
        for batch in batches:
            out = [vocabulary.decode(x or b"") for x in batch.column(ids_col).to_pylist()]
            yield _with_column(batch, text_col, pa.array(out, pa.string()))

    return kept.mapInArrow(texts, schema)
