"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain(url: Column) -> Column:
    """The host in lower case without user, port and one leading "www."; null for null.

    "http://" is assumed unless the url starts with http:// or https:// in lower case; a url without a host gives its scheme.
    """
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("http://"), url))
    place = F.regexp_replace(F.regexp_extract(full, "^https?://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.when(F.contains(place, F.lit("[")), F.regexp_extract(place, r"\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, "^[^:]*", 0)))
    return F.regexp_replace(F.when(host == "", F.regexp_extract(full, "^https?", 0)).otherwise(host), r"^www\.", "")


def in_country(url: Column, code: Column) -> Column:
    """True if the url has "." and the country's code, or ".com", anywhere in it."""
    small = F.lower(url)
    return F.contains(small, F.concat(F.lit("."), F.lower(code))) | F.contains(small, F.lit(".com"))
