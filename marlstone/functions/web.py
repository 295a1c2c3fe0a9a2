"""Column expressions on addresses, symbols and moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only say where a visitor came from.
CAMPAIGN = r"^(utm_[a-z_]+|gclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"


def clean(c: Column) -> Column:
    """The text without white space around it, '' for null."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def symbol(c: Column) -> Column:
    return F.upper(clean(c))


def page(c: Column) -> Column:
    """The page an address leads to: host in lower case, without scheme, `www.`, anchor, campaign parameters and last slash."""
    url = F.regexp_replace(F.regexp_replace(clean(c), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    whole = F.regexp_extract(url, r"^([^/?]*)([^?]*)(?:\?(.*))?$", 0)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(CAMPAIGN))), "&")
    return F.when(whole == "", "").otherwise(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def moment(c: Column) -> Column:
    """Moment of a date string in ISO spellings; without zone it is UTC; null if it can't be read."""
    text = clean(c)
    zoned = F.when(text.rlike(r"(Z|z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d"), text).when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d"), F.concat(text, F.lit("Z"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
    return zoned.try_cast("timestamp")
