"""How strongly two headlines hold together, from the words they share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import STOPWORDS

# Words of formats, which count as stop words here too; words too general to hold two headlines together.
FORMAT_WORDS = "analysis briefing check explainer fact focus here live old opinion photo photos picture pictures takeaway takeaways thing things update updates video watch year".split()
GENERIC = (
    "administration advice america american americans case cases cells city claim claims concern concerns crisis decision district day dead deadly death deaths executive government health issue issues killed killing kills letter man memorial media open order people plan plans policy president probe program proposal researchers review school scientists social story warning warnings war weekend"
).split()
# Labels that may stand, even repeatedly, before a headline.
LABELS = r"fact\s+focus|fact\s+check|explainer|analysis|opinion|live\s+updates?|in\s+pictures|photos?|video|watch|what\s+to\s+know|things\s+to\s+know|\d+\s+(?:big\s+)?takeaways?"
_LABEL = rf"(?i)^\s*(?:(?:{LABELS})\s*(?::|--|-|\.)?\s*)+"


def words(headline: Column) -> Column:
    """Distinct structs of a word in lower case and whether it is an anchor (a number, an acronym, a name) and not generic."""
    raw = F.regexp_extract_all(F.regexp_replace(headline, _LABEL, ""), F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    keep = F.filter(raw, lambda w: ~F.lower(w).isin(*STOPWORDS, *FORMAT_WORDS) & ((F.length(w) >= 3) | ((F.length(w) >= 2) & (w.rlike(r"^[A-Z]+$") | w.rlike(r"[0-9]")))))
    return F.array_distinct(F.transform(keep, lambda w: F.struct(F.lower(w).alias("w"), (w.rlike(r"^[A-Z]|[0-9]") & ~F.lower(w).isin(*GENERIC)).alias("anchor"))))


def strength(a: Column, b: Column) -> Column:
    """2 for three shared words that aren't all generic; 1 for two with two anchors, or one anchor and another word that isn't generic; else 0."""
    plain = lambda x: F.array_distinct(F.transform(x, lambda s: s["w"]))
    anchors = lambda x: F.array_distinct(F.transform(F.filter(x, lambda s: s["anchor"]), lambda s: s["w"]))
    shared = F.array_intersect(plain(a), plain(b))
    special = F.size(F.filter(shared, lambda w: ~w.isin(*GENERIC)))
    anchor = F.size(F.array_intersect(anchors(a), anchors(b)))
    return strength_of(F.size(shared), special, anchor)


def strength_of(n: Column, special: Column, anchor: Column) -> Column:
    """The strength from the number of shared words, of those that aren't generic, and of anchors."""
    return F.when((n < 2) | (special == 0), 0).when(n >= 3, 2).when((anchor >= 2) | ((anchor == 1) & (special == 2)), 1).otherwise(0)
