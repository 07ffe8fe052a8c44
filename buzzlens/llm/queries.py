"""Named queries of the operators in this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens.llm import bpe, cotraining, idfiles, language, lines, negatives, packing, pages, ranked, rules, search, simhash, substrings
from buzzlens.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Texts are long: batches of this many rows keep a Python worker's memory small.
BATCH_ROWS = 500


def query(function: Query) -> Query:
    """Register ``function`` under its name."""
    QUERIES[function.__name__] = function
    return function


def tokenizer(name: str) -> str:
    """Path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, directory: str) -> DataFrame:
    pieces = packing.pack(read(spark, directory, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op2_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


SQL["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g
), covered AS (
  SELECT doc_id, list(DISTINCT i + k) AS places
  FROM (SELECT doc_id, i, unnest(range(13)) AS k
        FROM windows JOIN firsts USING (g) WHERE least < doc_id)
  GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN ws ELSE
         [ws[p] FOR p IN range(1, len(ws) + 1) IF NOT list_contains(places, p)] END, ' '), ''))
         AS kept_sha256
FROM w LEFT JOIN covered USING (doc_id)
"""


@query
def op10_bpe(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "text")
    path = tokenizer("word_bpe_49k.json")
    rows = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, directory, "documents"))


@query
def op3_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "text")
    return rules.ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"),
        (rules.passes(rules.BASE) & rules.passes(rules.STRICT)).alias("kept"),
        "failures",
    )


SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
), windows AS (
  SELECT doc_id, i, ws[i:i + 4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM windows JOIN twice USING (doc_id, g))
  GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(text, '\P{Lu}', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_lines > 1 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
FROM f
"""


@query
def op7_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    names, logs = language.learn(docs.filter(~language.held_out()))
    return language.identify(docs.select("doc_id", "text"), names, logs).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op5_html_text(spark: SparkSession, directory: str) -> DataFrame:
    return pages.extract(read(spark, directory, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


@query
def op6_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "text")
    return lines.remove_common_blocks(docs).select(
        "doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op9_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    model = cotraining.train(docs, read(spark, directory, "labels"))
    return cotraining.score(docs, model)


@query
def op4_bm25_search(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents").select("doc_id", "text")
    return search.search(docs, docs.filter("doc_id % 20 = 0"))


@query
def op13_id_files(spark: SparkSession, directory: str) -> DataFrame:
    path = scratch_path(spark, "id-files")
    idfiles.write(read(spark, directory, "documents"), path, tokenizer("word_bpe_49k.json"))
    return idfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op11_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    path = scratch_path(spark, "ranked-index")
    ranked.build(read(spark, directory, "documents"), path)
    return ranked.search(spark, path, read(spark, directory, "benchmark"))


SQL["op11_ranked_search"] = r"""
WITH terms AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), sizes AS (SELECT r, doc_id, count(*) AS n FROM terms GROUP BY r, doc_id
), corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes
), tfs AS (SELECT r, t, count(*) AS tf FROM terms GROUP BY r, t
), dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM dfs, corpus
), asked AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark)
  GROUP BY item_id, t
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) //
    (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN sizes USING (r), corpus
  GROUP BY item_id, r, doc_id
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM numbered WHERE rank <= 10
"""


@query
def op12_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, directory, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    path = scratch_path(spark, "slices")
    negatives.store(rows, path)
    return negatives.mine(spark, path)


SQL["op12_hard_negatives"] = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, embedding,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
), kept AS (
  SELECT r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM rows
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, x.r AS xr, x.vec_id, a.label = x.label AS same,
         CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM kept a JOIN kept x ON a.r <> x.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS p FROM pairs WHERE same)
  WHERE p <= 5
), fitting AS (
  SELECT n.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
         p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.xr ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON p.ar = n.ar AND NOT n.same
  WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM fitting WHERE rank <= 10
"""
