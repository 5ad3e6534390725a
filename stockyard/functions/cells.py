"""Column expressions for text cells: missing values, trimming, artefacts of spreadsheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that count as missing, compared exactly.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Words that are blank in a cell, in any case.
BLANK_WORDS = ("nan", "none", "<na>", "nat")
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, as a lambda's variable; a column is worked out each time that it is named,
    as soon as a filter on the result is pushed below the projection."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, the ASCII separators U+001C to U+001F included."""
    return F.regexp_replace(c, _EDGE, "")


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin(*MISSING)


def null_if_missing(c: Column) -> Column:
    return F.when(~is_missing(c), c)


def clean(c: Column) -> Column:
    """Trimmed text; "" for what is missing or a blank word; whole numbers without their ".0"."""
    text = strip(c)
    whole = F.regexp_extract(text, r"^(\p{Nd}+)\.0$", 1)
    return F.when(is_missing(c) | F.lower(text).isin(*BLANK_WORDS), "").when(whole != "", whole).otherwise(text)


def shortened(c: Column, n: int, mark: str = "...") -> Column:
    """The first n characters and a mark, if there are more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def is_artifact_name(name: str) -> bool:
    text = name.strip()
    return not text or text.lower().startswith("unnamed:")


def contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def hits(c: Column, parts) -> Column:
    """How many of the parts occur."""
    out = F.lit(0)
    for p in parts:
        out = out + c.contains(p).cast("int")
    return out
