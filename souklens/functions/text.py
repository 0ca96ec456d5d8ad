"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: What is not visible in a page, in the order in which it goes.
INVISIBLE = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def visible_text(html: Column) -> Column:
    for pattern in INVISIBLE:
        html = F.regexp_replace(html, pattern, " ")
    return html


def whole_number(text: Column) -> Column:
    """The integer that a reply consists of, white space aside; null for anything else, 1.0 and 1_0 included."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)\s*$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def last_segment(name: str) -> str:
    return name.rsplit(".", 1)[-1]
