"""Text and mark-up columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from buzzlens.schemas import MAX_LENGTHS


def strip_space(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, line ends included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# A tag starts with a name: a lone "<" is text.
TAGS = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>"


def strip_tags(html: Column) -> Column:
    """Inner text of a fragment: comments and tags removed, entities kept."""
    return F.regexp_replace(html, TAGS, "")


def decode_entities(text: Column) -> Column:
    """Replace named and numeric character references in one pass.

    The text is cut before every ``&``, so ``&amp;lt;`` gives ``&lt;`` and is
    not decoded twice. Unknown names stay as they are.
    """
    common = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "nbsp": 160, "apos": 39}
    names = {**common, **name2codepoint}
    named = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])

    def piece(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(ref, r"^#(\d+)$", 1)
        hexits = F.regexp_extract(ref, r"^#[xX](.+)$", 1)
        code = F.coalesce(
            F.try_element_at(named, ref),
            digits.try_cast("int"),
            F.conv(F.nullif(hexits, F.lit("")), 16, 10).try_cast("int"),
        )
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.substr(part, F.length(ref) + 3)
        return F.when((ref != "") & valid, F.concat(char, rest)).otherwise(part)

    pieces = F.transform(F.split(text, "(?=&)"), piece)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def full_text(title: Column, content: Column) -> Column:
    """Title, one blank, content: the text that is matched and embedded."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def news_id(url: Column) -> Column:
    """``cnyes_<n>`` from a ``/id/<n>`` address, else the whole address."""
    number = F.regexp_extract(url, r"/id/(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("cnyes_"), number)).otherwise(url)


def file_stem(path: Column) -> Column:
    """Last path part without its last extension: ``/b/M.1.A.html`` to ``M.1.A``."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def first_word(text: Column) -> Column:
    """Text before the first blank: the account in ``account (nick name)``."""
    return F.split_part(text, F.lit(" "), F.lit(1))


def too_long(columns: list[str]) -> Column:
    """Name of the first column whose text exceeds its limit, else NULL."""
    return F.coalesce(
        *[F.when(F.length(c) > MAX_LENGTHS[c], F.lit(f"{c} too long")) for c in columns]
    )
