"""Vendor names and the identifiers that hide in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it: Unicode white space and the four separators.
_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def clean_name(c: Column | str) -> Column:
    """Strip, take off one pair of quotes, drop a trailing _CE suffix, strip; null if nothing is left."""
    whole = strip(_text(c))
    quoted = (F.length(whole) >= 2) & whole.startswith('"') & whole.endswith('"')
    bare = F.when(quoted, whole.substr(F.lit(2), F.length(whole) - 2)).otherwise(whole)
    return F.nullif(strip(F.regexp_replace(bare, r"_CE[\p{Nd}_]+(?=\n?\z)", "")), F.lit(""))


def extract_id(c: Column | str) -> Column:
    """The identifier after the vocabulary's prefix, else one that stands alone with 5 to 7 digits, else null."""
    text = _text(c)
    prefixed = F.regexp_extract(text, r"HMDB:(HMDB\p{Nd}+)", 1)
    alone = F.regexp_extract(text, r"(?U)\b(HMDB\p{Nd}{5,7})\b", 1)
    return F.coalesce(F.nullif(prefixed, F.lit("")), F.nullif(alone, F.lit("")))
