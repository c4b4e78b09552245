"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track readers.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")


def canonical(url: Column) -> Column:
    """Lower-case scheme and authority, path at least ``/``, sorted raw query without tracking, no fragment; null for other schemes."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?]*)", 1))
    path = F.regexp_extract(u, r"^[^:/?#]+://[^/?]*([^?]*)", 1)
    query = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING))
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))
    return F.when(scheme.isin("http", "https") & (authority != ""), whole)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))


def path_dates(url: Column) -> Column:
    """Dates ``/YYYY/MM/DD/`` in a path; a date's closing slash may not open the next."""
    return F.regexp_extract_all(url, F.lit(r"/(20\d{2}/\d{2}/\d{2})(?:/|$)"), F.lit(1))
