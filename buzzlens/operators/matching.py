"""Dictionary match: every occurrence of every alias keyword in every text.

A keyword matches anywhere in the text, case counts, and overlapping hits all
count: ``aa`` occurs three times in ``aaaa``. Two aliases with one keyword give
two hits.

The plan, all in the JVM:

1. cut a text into pieces of ``PIECE`` start positions, each reaching a few
   characters into the next; texts are first cut into sections when a keyword
   is longer than a piece, so that no step scans far;
2. explode the start positions and look up the first two characters (one, for
   keywords of one character) in the broadcast heads of the dictionary, which
   drops most positions and tells which anchor lengths are worth a look;
3. join the first 1, 2, 4 or 8 characters (the anchor) with the dictionary and
   keep candidates whose whole keyword is there.

Both joins use 64-bit hashes as keys; the comparison of the whole keyword makes
the result exact. The work per position does not depend on the size of the
dictionary. A small dictionary is broadcast and nothing is shuffled before the
partly counted (document, entity) pairs. Of a large one only the anchors are
broadcast, the longest ones cut until they are few enough, with the lengths of
the keywords behind them. What they let through is cut to these lengths. A first
run over the texts so finds the keywords that occur, which mostly are few enough
to be broadcast; if not, the cuts are counted per document, and the counts meet
the keywords in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.functions.text import full_text
from buzzlens.operators.keyed import BROADCAST_ROWS, broadcast_if_small, fits_broadcast
from buzzlens.session import shared_dir

ANCHOR_LENGTHS = (1, 2, 4, 8)
HEAD_LENGTH = 2
GATE_LENGTHS = (8, 7, 6, 5, 4)  # to which anchors of 8 are cut
FEW = 8  # keywords of one anchor and length that are told apart before they are counted
PIECE = 64
BROADCAST_CHARS = 64_000_000


@dataclass(frozen=True)
class _Dictionary:
    rows: DataFrame  # entity_id, keyword, word_anchor_len, anchor_key
    heads: DataFrame  # word_head_len, head_key, anchor_lens
    head_lengths: list[int]
    longest: int
    size: int
    chars: int


def _key(text: str, length: str | int) -> Column:
    """Hash of the first ``length`` characters together with that length.

    The length keeps a text cut short by the end of the document from meeting a
    shorter entry.
    """
    return F.expr(f"xxhash64(substring({text}, 1, {length}), {length})")


def _anchor_len(length: Column) -> Column:
    """Length of the anchor of a keyword with ``length`` characters."""
    anchor_len = F.lit(None).cast("int")
    for n in ANCHOR_LENGTHS:
        anchor_len = F.when(length >= n, n).otherwise(anchor_len)
    return anchor_len


def _prepare(aliases: DataFrame) -> _Dictionary:
    """Anchors and heads of the keywords; one aggregate reads the sizes."""
    words = (
        aliases.filter(F.col("keyword") != "")
        .select("entity_id", "keyword", _anchor_len(F.length("keyword")).alias("word_anchor_len"))
        .withColumn("word_head_len", F.least(F.col("word_anchor_len"), F.lit(HEAD_LENGTH)))
    )
    heads = words.groupBy("word_head_len", _key("keyword", "word_head_len").alias("head_key")).agg(
        F.collect_set("word_anchor_len").alias("anchor_lens")  # at most four values
    )
    facts = words.agg(
        F.count("*").alias("size"),
        F.coalesce(F.sum(F.length("keyword")), F.lit(0)).alias("chars"),
        F.coalesce(F.max(F.length("keyword")), F.lit(1)).alias("longest"),
        F.sort_array(F.collect_set("word_head_len")).alias("head_lengths"),
    ).first()
    rows = words.select(
        "entity_id",
        "keyword",
        "word_anchor_len",
        _key("keyword", "word_anchor_len").alias("anchor_key"),
    )
    return _Dictionary(
        rows,
        heads,
        facts["head_lengths"] or [1],
        facts["longest"],
        facts["size"],
        facts["chars"],
    )


def _pieces(text: Column, starts: int, overlap: int) -> Column:
    """Overlapping pieces of a text: ``starts`` start positions and ``overlap`` more."""
    pattern = f"(?s)(?=(.{{1,{starts + overlap}}})).{{1,{starts}}}"
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _positions(documents: DataFrame, text: Column, names: list[str], longest: int) -> DataFrame:
    """``(*names, section, at, window)``: every start position of every text.

    The text from the position on, as far as any keyword reaches, starts at
    character ``at`` of ``section``; ``window`` is the start of it.
    """
    reach = max(ANCHOR_LENGTHS)
    if longest <= PIECE:
        cut = documents.select(*names, F.explode(_pieces(text, PIECE, max(longest, reach) - 1)).alias("section"))
        pieces = cut.select("*", F.lit(0).alias("_start"), F.col("section").alias("_piece"))
    else:
        count = -(-longest // PIECE)  # pieces of a section that start in it
        cut = documents.select(*names, F.explode(_pieces(text, count * PIECE, longest - 1)).alias("section"))
        pieces = cut.select("*", F.posexplode(_pieces(F.col("section"), PIECE, reach - 1)).alias("_k", "_piece"))
        pieces = pieces.filter(F.col("_k") < count).withColumn("_start", F.col("_k") * PIECE)
    places = F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("_piece")))
    return pieces.select("*", F.explode(places).alias("_pos")).select(
        *names,
        "section",
        (F.col("_start") + F.col("_pos")).alias("at"),
        F.expr(f"substring(_piece, _pos, {reach})").alias("window"),
    )


def _probes(documents: DataFrame, words: _Dictionary, heads: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """``(*names, section, at, window, anchor_len)``: what the heads let through."""
    head_lengths = F.array(*[F.lit(n) for n in words.head_lengths])
    return (
        _positions(documents, text, names, words.longest)
        .withColumn("head_len", F.explode(head_lengths))
        .withColumn("head_key", _key("window", "head_len"))
        .join(heads, "head_key")
        # Written as a difference so that the hash alone stays the join key.
        .filter(F.col("head_len") - F.col("word_head_len") == 0)
        .select(*names, "section", "at", "window", F.explode("anchor_lens").alias("anchor_len"))
    )


def _small_hits(documents: DataFrame, words: _Dictionary, text: Column, names: list[str]) -> DataFrame:
    """``keyword_hits`` with a dictionary that is broadcast."""
    probes = _probes(documents, words, F.broadcast(words.heads), text, names)
    joined = probes.withColumn("anchor_key", _key("window", "anchor_len")).join(F.broadcast(words.rows), "anchor_key")
    found = F.expr(
        "if(word_anchor_len < 8, substring(window, 1, length(keyword)), "
        "substring(section, at, length(keyword)))"
    )
    exact = (F.col("anchor_len") - F.col("word_anchor_len") == 0) & (found == F.col("keyword"))
    return joined.filter(exact).select(*names, "entity_id", "keyword")


def _small_counts(documents: DataFrame, words: _Dictionary, text: Column, names: list[str]) -> DataFrame:
    """``keyword_counts`` with a dictionary that is broadcast.

    Each keyword is matched and counted once, however many entities list it; these
    are added after the exchange.
    """
    once = replace(words, rows=words.rows.drop("entity_id").distinct().withColumn("entity_id", F.lit(None)))
    counted = _small_hits(documents, once, text, names).groupBy(*names, "keyword").agg(F.count("*").alias("places"))
    listed = words.rows.groupBy("entity_id", "keyword").agg(F.count("*").alias("times"))
    return counted.join(F.broadcast(listed), "keyword").select(
        *names, "entity_id", "keyword", (F.col("places") * F.col("times")).alias("hits")
    )


def _gate_key(text: str, anchor_len: str, cut: int) -> Column:
    return F.expr(f"xxhash64(substring({text}, 1, least({anchor_len}, {cut})), {anchor_len})")


def _gate(words: DataFrame, cut: int) -> DataFrame:
    """``(gate_key, keyword_len, hashes)``: lengths of the keywords behind each anchor.

    Anchors have at most ``cut`` characters. ``hashes`` are those of the keywords,
    null where they are more than ``FEW``.
    """
    hashes = F.collect_set(F.xxhash64("keyword"))
    return words.groupBy(
        _gate_key("keyword", "word_anchor_len", cut).alias("gate_key"), F.length("keyword").alias("keyword_len")
    ).agg(F.when(F.size(hashes) <= FEW, hashes).alias("hashes"))


def _found(documents: DataFrame, words: _Dictionary, text: Column, names: list[str]) -> DataFrame:
    """``(*names, found)``: every place where a text may be a keyword of a large dictionary.

    When even the shortest gate is too large to broadcast, its join is left to
    Spark. A keyword's length tells its anchor's, so no place is cut twice to
    the same text.
    """
    heads = F.broadcast(words.heads) if fits_broadcast(words.heads) else words.heads
    for cut in GATE_LENGTHS:
        gate = _gate(words.rows, cut)
        if fits_broadcast(gate):
            gate = F.broadcast(gate)
            break
    cuts = (
        _probes(documents, words, heads, text, names)
        .withColumn("gate_key", _gate_key("window", "anchor_len", cut))
        .join(gate, "gate_key")
        .filter(_anchor_len(F.col("keyword_len")) - F.col("anchor_len") == 0)
    )
    found = F.expr(
        "if(anchor_len < 8, substring(window, 1, keyword_len), substring(section, at, keyword_len))"
    )
    return (
        cuts.select(*names, "keyword_len", "hashes", found.alias("found"))
        .filter(F.length("found") == F.col("keyword_len"))  # not cut short by the end of the text
        .filter(F.col("hashes").isNull() | F.array_contains("hashes", F.xxhash64("found")))
        .select(*names, "found")
    )


def _large_counts(documents: DataFrame, words: _Dictionary, text: Column, names: list[str]) -> DataFrame:
    """``keyword_counts`` with a dictionary that is not broadcast."""
    counted = _found(documents, words, text, names).groupBy(*names, "found").agg(F.count("*").alias("places"))
    listed = words.rows.groupBy("entity_id", "keyword").agg(F.count("*").alias("times"))
    joined = counted.withColumn("anchor_key", F.xxhash64("found")).join(
        listed.withColumn("anchor_key", F.xxhash64("keyword")), "anchor_key"
    )
    # Not written as an equality, so that the hash alone stays the join key.
    same = F.startswith("found", "keyword") & (F.length("found") - F.length("keyword") == 0)
    return joined.filter(same).select(
        *names, "entity_id", "keyword", (F.col("places") * F.col("times")).alias("hits")
    )


def _is_small(words: _Dictionary, max_broadcast_rows: int) -> bool:
    return words.size <= max_broadcast_rows and words.chars <= BROADCAST_CHARS


def occurring(
    documents: DataFrame, aliases: DataFrame, text: Column | None = None, max_broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``aliases`` as they are if they can be broadcast, else those whose keyword occurs in a text.

    The latter are found in a run over the texts of its own, which shuffles each
    text found once per task, and checkpointed in the shared folder: mostly few
    enough to be broadcast then, which is cheaper than to shuffle the hits. The
    texts found are checkpointed before they meet the aliases: Spark joins each
    part of a union by itself, and would read the documents again for each.
    """
    words = _prepare(aliases)
    if max_broadcast_rows == 0 or _is_small(words, max_broadcast_rows):
        return aliases
    shared_dir(documents.sparkSession)
    text = full_text(F.col("title"), F.col("content")) if text is None else text
    found = _found(documents, words, text, []).distinct().withColumnRenamed("found", "keyword").checkpoint()
    return aliases.join(broadcast_if_small(found), "keyword", "left_semi").select("entity_id", "keyword").checkpoint()


def _matching(documents, aliases, text, max_broadcast_rows) -> tuple[_Dictionary, Column, bool]:
    """The dictionary left to match, the text, and whether the dictionary is broadcast."""
    words = _prepare(occurring(documents, aliases, text, max_broadcast_rows))
    text = full_text(F.col("title"), F.col("content")) if text is None else text
    return words, text, _is_small(words, max_broadcast_rows)


def keyword_hits(
    documents: DataFrame,
    aliases: DataFrame,
    text: Column | None = None,
    keys: tuple[str, ...] = ("document_id",),
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row ``(*keys, entity_id, keyword)`` per occurrence.

    ``text`` defaults to title, blank, content. ``keys`` are carried along, so
    whatever the caller groups by later needs no join. Runs one aggregate over
    the dictionary. Of a dictionary above ``max_broadcast_rows`` rows or
    ``BROADCAST_CHARS`` characters, ``occurring`` first keeps what the texts hold
    (not at 0 rows, where that cannot help); if that is above them too, it is
    joined by a shuffle, and AQE splits hot keywords there.
    """
    words, text, small = _matching(documents, aliases, text, max_broadcast_rows)
    if small:
        return _small_hits(documents, words, text, list(keys))
    rows = _large_counts(documents, words, text, list(keys))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hits")))
    return rows.select(*keys, "entity_id", "keyword", each.alias("_hit")).drop("_hit")


def keyword_counts(
    documents: DataFrame,
    aliases: DataFrame,
    text: Column | None = None,
    keys: tuple[str, ...] = ("document_id",),
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``keyword_hits`` counted: one row ``(*keys, entity_id, keyword, hits)`` per keyword found."""
    words, text, small = _matching(documents, aliases, text, max_broadcast_rows)
    return (_small_counts if small else _large_counts)(documents, words, text, list(keys))


def entity_counts(hits: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Hits per entity and document; all aliases of an entity add up."""
    return hits.groupBy(*keys, "entity_id").agg(F.count("*").alias("mention_count"))


def with_stock_code(counts: DataFrame, entities: DataFrame) -> DataFrame:
    """Add the entity's stock code, NULL where it has none or is unknown."""
    codes = broadcast_if_small(entities.select("entity_id", "stock_code"))
    return counts.join(codes, "entity_id", "left")


def coded_counts(
    documents: DataFrame, aliases: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("document_id",)
) -> DataFrame:
    """``entity_counts`` of documents ``with_stock_code``; of many entities only those found are looked up."""
    listed = occurring(documents, aliases)
    if listed is not aliases:
        entities = entities.join(listed.select("entity_id").distinct(), "entity_id", "left_semi")
    return with_stock_code(entity_counts(keyword_hits(documents, listed, keys=keys), keys), entities)


def match_counts(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct entities per document, 0 where nothing matched.

    ``counts`` has one row per (document, entity), so counting rows is exact.
    """
    every = documents.select("document_id", F.lit(None).cast("bigint").alias("entity_id"))
    return (
        every.unionByName(counts.select("document_id", "entity_id"))
        .groupBy("document_id")
        .agg(F.count("entity_id").alias("entity_match_count"))
    )


def mark_processed(documents: DataFrame, counts: DataFrame, now) -> DataFrame:
    """Status rows of matched documents: processed at ``now``, not yet probed."""
    return match_counts(documents, counts).select(
        "document_id",
        F.lit(now).cast("timestamp").alias("processed_at"),
        F.col("entity_match_count").cast("int").alias("entity_match_count"),
        F.lit(None).cast("timestamp").alias("probed_at"),
    )
