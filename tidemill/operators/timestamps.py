"""Mixed timestamp texts to one UTC instant (problem 3).

An ordered cascade of anchored patterns rewrites a text to its parts, the parts are checked
strictly, and what the text leaves out is taken from the feed: the order of day and month in
all-numeric dates, and the zone of a local time. Everything is built from column expressions.

Policy
------
* An offset, ``Z`` or a zone abbreviation in the text settles the instant. ``-0000`` means UTC.
* A local time is read in the feed's zone. One that occurs twice there (``ambiguous``) or never
  (``nonexistent``) gives no instant.
* A weekday that contradicts the date, a day the month lacks, an hour of 24 or a 13 p.m. gives none.
* Digits finer than microseconds are cut off; missing seconds are 0; two-digit years are 1970-2069.

Defined results: null, empty and blank texts are ``missing``; a text without date and time of day
(``yesterday``, ``13 March``, ``2024-01-18``, ``02:49``, ``n/a``) is ``unknown``; a local time whose feed
is absent or has an invalid zone is ``unknown``. Rows are neither added nor lost, repeated rows
give repeated results, and very long texts simply match no pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names of the feeds' languages, in calendar order.
MONTHS = {
    1: "jan january janvier januar jänner enero ene janeiro января январь янв",
    2: "feb february février févr fevrier februar febrero fevereiro fev февраля февраль фев",
    3: "mar march mars märz maerz mrz marzo março marco марта март",
    4: "apr april avril avr abril abr апреля апрель апр",
    5: "may mai mayo maio мая май",
    6: "jun june juin juni junio junho июня июнь июн",
    7: "jul july juillet juil juli julio julho июля июль июл",
    8: "aug august août aout agosto ago августа август авг",
    9: "sep sept september septembre septiembre setembro set сентября сентябрь сен",
    10: "oct october octobre oktober okt octubre outubro out октября октябрь окт",
    11: "nov november novembre noviembre novembro ноября ноябрь ноя",
    12: "dec december décembre decembre dezember dez diciembre dic dezembro декабря декабрь дек",
}
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Abbreviations that mean another offset in the feeds of some zones.
LOCAL_ZONES = {("IST", "Asia/Kolkata"): 330, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("CST", "Asia/Shanghai"): 480, ("CST", "Asia/Taipei"): 480}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
_ZONE = r"(Z|[A-Za-z]{2,5}|(?:GMT|UTC)?[+-]\d{2}:?\d{2})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?"
_AMPM = r"(?: ?([AaPp])\.?[Mm]\.?(?![\p{L}]))?"
_NAME = r"(\p{L}{3,10})\.?"

#: (name, anchored pattern, parts as year|month|day|hour|minute|second|fraction|a or p|zone|weekday)
CASCADE = (
    ("iso", rf"^(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})[Tt ]{_CLOCK} ?{_ZONE}$", "$1|$3|$4|$5|$6|$7|$8||$9|"),
    ("compact", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|||$7|"),
    ("day_month_name", rf"^(?:(\p{{L}}{{2,10}})\.?,? )?(\d{{1,2}})\.?(?: de)? {_NAME}(?: de)? (\d{{4}}|\d{{2}}),?(?: (?:à|às|a las|um|в|at|as))? (\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,18}}))?)?{_AMPM}(?: Uhr)? ?{_ZONE}$", "$4|$3|$2|$5|$6|$7|$8|$9|$10|$1"),
    ("clock_date", rf"^(\p{{L}}{{3}}) {_NAME} (\d{{1,2}}) (\d{{4}}) {_CLOCK} {_ZONE}(?: \([^)]*\))?$", "$4|$2|$3|$5|$6|$7|$8||$9|$1"),
    ("month_name_day", rf"^{_NAME} (\d{{1,2}}), (\d{{4}}),?(?: at)? {_CLOCK}{_AMPM} ?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
)
_NUMERIC = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}),? {_CLOCK}{_AMPM} ?{_ZONE}$"
_EPOCH = r"^\d{10}(\d{3}){0,3}$"
_DAY_US = 86_400_000_000


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _zone_offset_us(at_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at_us), zone)) - at_us


def _valid_zone(zone: Column) -> Column:
    from zoneinfo import available_timezones

    known = sorted(z for z in available_timezones() if "/" in z or z == "UTC")
    return F.when(zone.isin(known) & ~zone.startswith("posix/") & ~zone.startswith("right/"), zone)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _result(status: str, us: Column | None = None) -> Column:
    return F.struct((F.lit(None) if us is None else us).cast("bigint").alias("us"), F.lit(status).alias("status"))


def _pattern(t: Column, order: Column) -> Column:
    out = F.when(t.isNull() | (t == ""), None)
    for name, regex, _ in CASCADE:
        out = out.when(t.rlike(regex), name)
    return out.when(t.rlike(_NUMERIC) & order.isin("DMY", "MDY"), "numeric").when(t.rlike(_EPOCH), "epoch")


def _parts(t: Column, p: Column, order: Column) -> Column:
    numeric = F.when(order == "MDY", F.regexp_replace(t, _NUMERIC, "$4|$1|$3|$5|$6|$7|$8|$9|$10|")).otherwise(F.regexp_replace(t, _NUMERIC, "$4|$3|$1|$5|$6|$7|$8|$9|$10|"))
    out = F.when(p == "numeric", numeric)
    for name, regex, to in CASCADE:
        out = out.when(p == name, F.regexp_replace(t, regex, to))
    return F.split(out, r"\|", -1)


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def _fields(s: Column) -> Column:
    """The parts as checked numbers; a field that can't be is null."""
    names = {n: m for m, line in MONTHS.items() for n in line.split()}
    month = F.coalesce(_number(s[1]), _lookup(names, F.lower(s[1])))
    year = F.when(F.length(s[0]) == 2, _number(s[0]) + F.when(_number(s[0]) < 70, 2000).otherwise(1900)).otherwise(_number(s[0]))
    hour, half = _number(s[3]), F.lower(s[7])
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(_number(s[2]).cast("string"), 2, "0"))
    return F.struct(
        F.when(month.isNotNull() & (year > 0), date.try_cast("date")).alias("date"),
        F.when(half == "", F.when(hour <= 23, hour)).otherwise(F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).alias("hour"),
        _number(s[4]).alias("minute"),
        F.coalesce(_number(s[5]), F.lit(0)).alias("second"),
        F.rpad(F.substring(s[6], 1, 6), 6, "0").cast("int").alias("micros"),
        F.regexp_replace(F.upper(s[8]), r"^(GMT|UTC)(?=[+-])", "").alias("zone"),
        F.substring(F.lower(s[9]), 1, 3).alias("weekday"),
    )


def _local_us(f: Column) -> Column:
    """Microseconds of the wall clock as if it were UTC; null if a field fails."""
    us = F.unix_date(f["date"]).cast("bigint") * _DAY_US + (f["hour"] * 3600 + f["minute"] * 60 + f["second"]).cast("bigint") * 1_000_000 + f["micros"]
    weekday_ok = ~f["weekday"].isin(*WEEKDAYS) | (F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(f["date"])) == f["weekday"])
    return F.when((f["minute"] <= 59) & (f["second"] <= 59) & weekday_ok, us)


def _offset_minutes(name: Column, zone: Column) -> Column:
    """Of an offset or abbreviation in the text; null if it has no one meaning."""
    digits = F.regexp_replace(name, r"[^0-9]", "")
    hours, minutes = _number(F.substring(digits, 1, 2)), _number(F.substring(digits, 3, 2))
    numeric = F.when(name.rlike(r"^[+-]") & (hours <= 18) & (minutes <= 59), (hours * 60 + minutes) * F.when(name.startswith("-"), -1).otherwise(1))
    own = _lookup({f"{a} {z}": m for (a, z), m in LOCAL_ZONES.items()}, F.concat_ws(" ", name, zone))
    return F.coalesce(numeric, own, _lookup(ZONES, name))


def _in_zone(local: Column, zone: Column) -> Column:
    """The offsets a day before and after are those around any change; a local time has an instant for each that leads back to it."""
    back = lambda u: u + _zone_offset_us(u, zone) == local
    tried = F.array(local - _zone_offset_us(local - _DAY_US, zone), local - _zone_offset_us(local + _DAY_US, zone))
    return _let(F.filter(F.array_distinct(tried), back), lambda us: F.when(F.size(us) == 1, _result("ok", us[0])).when(F.size(us) == 0, _result("nonexistent")).otherwise(_result("ambiguous")))


def _resolve(f: Column, zone: Column) -> Column:
    def of(local: Column) -> Column:
        shifted = _let(_offset_minutes(f["zone"], zone), lambda m: F.when(m.isNull(), _result("unknown")).otherwise(_result("ok", local - m.cast("bigint") * 60_000_000)))
        return F.when(local.isNull(), _result("invalid")).when(f["zone"] != "", shifted).when(zone.isNull(), _result("unknown")).otherwise(_in_zone(local, zone))

    return _let(_local_us(f), of)


def instant(text: Column, zone: Column, order: Column) -> Column:
    """struct(us bigint, status string, pattern string) of a timestamp text; us is microseconds since 1970 UTC.

    ``zone`` is an IANA name, ``order`` ``DMY`` or ``MDY``. status: ok, missing, unknown, invalid, ambiguous, nonexistent.
    """

    def of(t: Column, z: Column, p: Column) -> Column:
        epoch = F.rpad(F.substring(t, 1, 16), 16, "0").try_cast("bigint")
        parsed = _let(_parts(t, p, order), lambda s: _let(_fields(s), lambda f: _resolve(f, z)))
        r = F.when(t.isNull() | (t == ""), _result("missing")).when(p.isNull(), _result("unknown")).when(p == "epoch", _result("ok", epoch)).otherwise(parsed)
        return _let(r, lambda x: F.struct(x["us"].alias("us"), x["status"].alias("status"), p.alias("pattern")))

    clean = F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " "))
    return _let(clean, lambda t: _let(_valid_zone(zone), lambda z: _let(_pattern(t, order), lambda p: of(t, z, p))))


def feed_defaults(feeds: DataFrame) -> DataFrame:
    """source_id with the zone and date order of its feed; of repeated rows the one updated last counts."""
    pick = lambda k: F.get_json_object("config_json", f"$.{k}")
    best = F.max_by(F.struct(pick("time_zone").alias("time_zone"), pick("date_order").alias("date_order")), F.struct("updated_at", "config_json"))
    return feeds.filter("source_id is not null").groupBy("source_id").agg(best.alias("d")).select("source_id", "d.time_zone", "d.date_order")


def normalise_published(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every row of articles with its instant, or null, and ``publish_date_estimated`` as it came."""
    rows = articles.select("ingest_seq", "article_id", "source_id", "published_at", "publish_date_estimated")
    rows = rows.join(feed_defaults(feeds), "source_id", "left")
    at = instant(F.col("published_at"), F.col("time_zone"), F.col("date_order"))
    out = rows.withColumn("at", at)
    return out.select("ingest_seq", "article_id", "published_at", "publish_date_estimated", F.col("at.us").alias("published_us"), F.timestamp_micros("at.us").alias("published_ts"), F.col("at.status").alias("published_status"), F.col("at.pattern").alias("published_pattern"))
