"""Text functions as column expressions. Tokens are ASCII, so accents split words; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in titles, keywords and slugs.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my myself no nor not of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would you your yours yourself yourselves "
    "news says said amid report reports according u s us"
).split()


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def title_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))


def normalised_title(text: Column) -> Column:
    return F.array_join(title_words(text), " ")


def keyword_tokens(text: Column) -> Column:
    """Words of four and more signs that begin with a letter, without stopwords; repeats and order stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9-]{3,})"), F.lit(1)), lambda w: ~w.isin(*STOPWORDS))


def title_tokens(text: Column) -> Column:
    """The distinct words of a title that may match another title."""
    return F.array_distinct(F.filter(title_words(text), lambda w: ~w.isin(*STOPWORDS)))


def summary_fallback(text: Column, limit: int = 300) -> Column:
    """A short text as it is, a long one cut at the last blank in its second half, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    head = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(F.length(head) > limit // 2, head).otherwise(cut), F.lit("…")))


def bounded(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word."""
    return F.when(F.length(text) <= limit, text).otherwise(F.rtrim(F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")))


def short_label(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def sanitize_id(text: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(safe == "", "unknown").otherwise(safe)


def slug(text: Column, words: int = 8) -> Column:
    kept = F.slice(F.filter(title_words(text), lambda w: ~w.isin(*STOPWORDS)), 1, words)
    return F.when(F.size(kept) == 0, "story").otherwise(F.array_join(kept, "-"))


def base_slug(event_id: Column) -> Column:
    """An event's name without the date before and the number behind."""
    return F.regexp_replace(F.regexp_replace(event_id, r"^\d{4}-\d{2}-\d{2}-", ""), r"-\d+$", "")


def publisher(source_name: Column) -> Column:
    return F.substring_index(source_name, " - ", 1)


def quality(text: Column, summary: Column) -> Column:
    """Whether a feed's text is only its summary again."""
    n, s = F.coalesce(F.length(text), F.lit(0)), F.coalesce(F.length(summary), F.lit(0))
    return F.when(n < 600, "short").when(F.coalesce(text == summary, F.lit(False)), "equal").when(n <= s + 200, "little_more").otherwise("full")
