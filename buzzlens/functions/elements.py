"""Elements of mark-up, nested ones included, found by one pass over the tags in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that have no end tag.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
KEPT, END = "-", "/"  # marks of a piece outside, and of the end tag that closes a marked element
_CUT = "\u0000"  # no page has this character


def pieces(html: Column) -> Column:
    """The text cut before every tag; each piece but the first starts with one."""
    return F.split(html, r"(?=</?[A-Za-z])")


def marks(tags: Column, kinds: Mapping[str, str]) -> Column:
    """What each piece is part of, as ``[{piece, mark}]``.

    ``kinds`` maps a lower-case letter to the pattern of a start tag. A piece
    with such a tag gets the letter in upper case, what its element holds gets
    the letter itself and its end tag ``END``; all others are ``KEPT``. Only
    tags of the element's own name are counted, so elements of that name may be
    nested; one that is never closed goes to the end. Marked elements within
    marked elements are part of the outer one.
    """

    def described(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
        alone = piece.rlike(rf"(?i)^<(?:{VOID})\b") | piece.rlike("^<[^>]*/>")
        turn = F.when(piece.startswith("</"), -1).when((tag == "") | alone, 0).otherwise(1)
        kind = F.coalesce(*[F.when(piece.rlike(p), F.lit(k)) for k, p in kinds.items()], F.lit(""))
        return F.struct(tag.alias("tag"), turn.alias("turn"), kind.alias("kind"))

    def step(state: Column, piece: Column) -> Column:
        inside = state["depth"] > 0
        starts = ~inside & (piece["kind"] != "") & (piece["turn"] == 1)
        depth = (
            F.when(inside & (piece["tag"] == state["tag"]), state["depth"] + piece["turn"])
            .when(inside, state["depth"])
            .otherwise(F.when(starts, 1).otherwise(0))
        )
        mark = (
            F.when(starts, F.upper(piece["kind"]))
            .when(inside & (depth == 0), F.lit(END))
            .when(inside, state["kind"])
            .otherwise(F.lit(KEPT))
        )
        return F.struct(
            depth.alias("depth"),
            F.when(inside, state["tag"]).otherwise(piece["tag"]).alias("tag"),
            F.when(inside, state["kind"]).otherwise(piece["kind"]).alias("kind"),
            F.concat(state["marks"], mark).alias("marks"),
        )

    empty = F.lit("")
    start = F.struct(
        F.lit(0).alias("depth"), empty.alias("tag"), empty.alias("kind"), empty.alias("marks")
    )
    letters = F.split(F.aggregate(F.transform(tags, described), start, step)["marks"], "")
    return F.arrays_zip(tags.alias("piece"), letters.alias("mark"))


def outside(marked: Column) -> Column:
    """The text without the marked elements."""
    after_end = lambda p: F.regexp_replace(p["piece"], "^[^>]*>?", "")
    kept = F.transform(
        marked,
        lambda p: F.when(p["mark"] == KEPT, p["piece"]).when(p["mark"] == END, after_end(p)).otherwise(""),
    )
    return F.array_join(kept, "")


def within(marked: Column, kind: str) -> Column:
    """The marked elements of one kind, each as a text without its end tag."""
    parts = F.transform(
        marked,
        lambda p: F.when(p["mark"] == kind.upper(), F.concat(F.lit(_CUT), p["piece"]))
        .when(p["mark"] == kind, p["piece"])
        .otherwise(""),
    )
    found = F.split(F.array_join(parts, ""), _CUT)
    return F.slice(found, F.lit(2), F.size(found))
