"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; policies are masks over those bits and can be changed,
versioned and compared later without reading a text again. Only DataFrame
functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5

# A rule fails where its condition on the measurements holds; bit = place in this table.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines > 1 AND 10 * n_dup_lines > 3 * n_lines",
    "upper_case": "2 * n_upper > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


@dataclass(frozen=True)
class Policy:
    """A named version: documents that fail any of ``rules`` go."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(RULES))
POLICIES = (BASE, Policy("1", (*BASE.rules, "symbols", "repeated_lines")), STRICT)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in one text.

    Windows are compared by a 64-bit hash. Sorting brings equal ones together;
    the union of their places is then added up from left to right.
    """
    last = F.size(words) - WINDOW

    def at(i: Column, k: int) -> Column:
        return F.get(words, i + F.lit(k))

    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def union(s: Column) -> Column:
            twins = F.filter(
                s,
                lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            )
            places = F.sort_array(F.transform(twins, lambda x: x["i"]))
            return F.aggregate(
                places,
                F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).alias("n")),
                lambda total, p: F.struct(
                    p.alias("before"), (total["n"] + F.least(F.lit(WINDOW), p - total["before"])).alias("n")
                ),
                lambda total: total["n"],
            )

        # Most texts repeat nothing, which needs no sort to find out.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ranked, union))

    return F.when(last < 0, F.lit(0)).otherwise(_let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of the measurements of a text; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        )

    return F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the measurements and ``failures``, a bit per failed rule.

    A null or empty text has no words and fails ``few_words``. Columns of ``docs``
    named like a measurement or ``failures`` are replaced. Rows are independent:
    repeated rows appear repeatedly, no rows give no rows. Nothing is shuffled.
    """
    others = [c for c in docs.columns if c not in (text_col, "failures", *MEASURES)]
    measured = docs.select(
        *[F.col(f"`{c}`") for c in others], measures(F.col(text_col).cast("string")).alias("_m")
    )
    flat = measured.select(
        *[F.col(f"`{c}`") for c in others],
        "_m.w.*", "_m.l.*", "_m.n_symbols", "_m.n_upper",
    )
    bits = [
        F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0))
        for k, condition in enumerate(RULES.values())
    ]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return flat.select(*[F.col(f"`{c}`") for c in others], *MEASURES, failures.cast("bigint").alias("failures"))


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents dropped, failing the rule, and dropped by it alone.

    One pass counts documents per bitmask (at most 2 ** rules rows); everything
    else is bit arithmetic on those counts.
    """
    counts = rows.groupBy("failures").agg(F.count("*").alias("n"))
    names = list(RULES)
    grid = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.lit(r).alias("rule"),
                     F.lit(p.mask).alias("mask"), F.lit(1 << names.index(r)).alias("bit"))
            for p in policies
            for r in p.rules
        ]
    )
    failed = F.col("failures").bitwiseAND(F.col("g.mask"))
    return (
        counts.withColumn("g", F.explode(grid))
        .groupBy("g.policy", "g.rule")
        .agg(
            F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("dropped"),
            F.sum(F.when(failed.bitwiseAND(F.col("g.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(failed == F.col("g.bit"), F.col("n")).otherwise(0)).alias("dropped_alone"),
        )
    )
