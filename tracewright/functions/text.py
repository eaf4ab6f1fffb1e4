"""Text normalisers and identifier patterns as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _plain_letters() -> dict[str, str]:
    """Lower-case Latin letters whose compatibility decomposition has marks or several letters, with what is left of it."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and plain != c:
            out[c] = plain
    return out


_LETTERS = _plain_letters()
_SINGLE = {c: p for c, p in _LETTERS.items() if len(p) == 1}


def fold(c: Column) -> Column:
    """Lower case without Latin diacritics (letters with no decomposition, such as ł, stay) and without marks of their own."""
    out = F.translate(F.lower(c), "".join(_SINGLE), "".join(_SINGLE.values()))
    for letter, plain in _LETTERS.items():
        if letter not in _SINGLE:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, "[\u0300-\u036f]", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[ _-]", "")


def words_only(c: Column) -> Column:
    """Lower-case letters, digits and white space."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", "")


def alnum_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


# fixed values: how messages name a wire
EDGE_MENTION = r"(?i)e+d+g+e\s*[-_ ]?\s*(\d+)"
POINT_MENTION = r"(?i)(?:odcinek|punkt)\s*(?:nr|numer)?\s*[-_#: ]?\s*(\d+)"


def mentions(text: Column) -> Column:
    """Distinct wire ids `edgeN` a message names."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(EDGE_MENTION), F.lit(1)), F.regexp_extract_all(text, F.lit(POINT_MENTION), F.lit(1))
    )
    return F.array_distinct(F.transform(found, lambda d: F.concat(F.lit("edge"), d)))


DATED_HEADING = r"(?m)(?=^#{2,3}\s*\d{4}-\d{2}-\d{2}\b)"


def dated_sections(text: Column) -> Column:
    """Sections of a log as `(pos, day, body)` sorted by date; text before the first dated heading has no day."""
    cut = F.split(text, DATED_HEADING)
    rows = F.transform(
        cut,
        lambda s, i: F.struct(
            F.try_to_date(F.nullif(F.regexp_extract(s, r"^#{2,3}\s*(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))).alias("day"),
            i.alias("pos"), s.alias("body"),
        ),
    )
    return F.array_sort(F.filter(rows, lambda r: F.trim(r["body"]) != ""))
