"""Queries over states in time: selections, windows to run, lifecycles, revisions, caches, reports and the order of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import text, times
from tidemill.operators import grouping, matching, mutations
from tidemill.plans import articles as base
from tidemill.session import table

query, first_articles = base.query, base.first_articles
_TS = "CAST(replace(replace({0}, 'T', ' '), 'Z', '') AS TIMESTAMP)"

# Spellings of "no id"; phrases of a page that wants a subscription, the first of which counts.
NULL_IDS = ("null", "none", "nil", "n/a", "na", "unknown")
PAYWALL = ("subscribe to continue", "subscription required", "sign in to continue", "create a free account", "already a subscriber", "metered paywall")


# --- scalar rules


@query(f"""SELECT ingest_seq, CASE WHEN lower(trim(language)) IN ({", ".join(f"'{x}'" for x in NULL_IDS)}) OR trim(language) = '' THEN NULL ELSE trim(language) END AS language,
  CASE WHEN lower(trim(content_type)) IN ({", ".join(f"'{x}'" for x in NULL_IDS)}) OR trim(content_type) = '' THEN NULL ELSE trim(content_type) END AS content_type FROM articles""")
def c_null_ids(spark: SparkSession, d: str) -> DataFrame:
    """Values that spell out that there is none become null."""
    known = lambda c: F.when(~F.lower(F.trim(c)).isin(*NULL_IDS) & (F.trim(c) != ""), F.trim(c)).alias(c)
    return table(spark, d, "articles").select("ingest_seq", known("language"), known("content_type"))


_PHRASE = " ".join(f"WHEN contains(lower(t.content_text), '{p}') THEN 'text:{p}'" for p in PAYWALL)


@query(f"""WITH {base._FIRST}, s AS (SELECT t.article_id, lower(coalesce(json_extract_string(f.config_json, '$.content_hints.paywall'), 'unknown')) AS hint, TRY_CAST(json_extract_string(a.collection_json, '$.http_status') AS INTEGER) AS code, CASE {_PHRASE} END AS phrase
  FROM article_texts t LEFT JOIN first a USING (article_id) LEFT JOIN feeds f ON f.source_id = t.source_id),
l AS (SELECT article_id, hint, code, list_filter([CASE WHEN hint IN ('metered', 'hard', 'subscription') THEN 'source_paywall_hint:' || hint END, CASE WHEN code IN (401, 402, 403) THEN 'http_status:' || code END, phrase], lambda x: x IS NOT NULL) AS signals FROM s)
SELECT article_id, signals, CASE WHEN code IN (401, 402, 403) OR hint = 'hard' THEN 'confirmed' WHEN len(signals) > 0 THEN 'suspected' ELSE 'none' END AS status FROM l""")
def c_paywall(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text stands behind a paywall, by its source's hint, the response status and the first phrase in the text."""
    a = first_articles(spark, d, "collection_json").select("article_id", F.get_json_object("collection_json", "$.http_status").try_cast("int").alias("code"))
    f = table(spark, d, "feeds").select("source_id", F.lower(F.coalesce(F.get_json_object("config_json", "$.content_hints.paywall"), F.lit("unknown"))).alias("hint"))
    t = table(spark, d, "article_texts").select("article_id", "source_id", F.lower("content_text").alias("t")).join(a, "article_id", "left").join(f, "source_id", "left")
    hint, refused = F.coalesce("hint", F.lit("unknown")), F.coalesce(F.col("code").isin(401, 402, 403), F.lit(False))
    phrase = F.coalesce(*(F.when(F.contains("t", F.lit(p)), F.lit(f"text:{p}")) for p in PAYWALL))
    signals = F.array_compact(F.array(F.when(hint.isin("metered", "hard", "subscription"), F.concat(F.lit("source_paywall_hint:"), hint)), F.when(refused, F.concat(F.lit("http_status:"), F.col("code").cast("string"))), phrase))
    return t.select("article_id", signals.alias("signals"), F.when(refused | (hint == "hard"), "confirmed").when(F.size(signals) > 0, "suspected").otherwise("none").alias("status"))


@query("""WITH s AS (SELECT article_id, digest_impact.global AS g, digest_impact.category AS c FROM article_digests WHERE digest_impact IS NOT NULL)
SELECT article_id, CASE WHEN g IS NULL OR isnan(g) OR isinf(g) THEN 0.0 ELSE least(greatest(g, 0.0), 1.0) END AS clamped, CASE WHEN c < 0 OR c > 100 THEN NULL WHEN c > 10 THEN round(c / 100, 3) WHEN c > 1 THEN round(c / 10, 3) ELSE round(c, 3) END AS normalised FROM s""")
def i_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores held within 0 and 1 (what is no number counts 0), and scores on scales of 10 or 100 brought to 1 (null beyond)."""
    g, c = F.col("digest_impact.global"), F.col("digest_impact.category")
    odd = g.isNull() | F.isnan(g) | (F.abs(g) == float("inf"))
    scaled = F.when((c < 0) | (c > 100), None).when(c > 10, F.round(c / 100, 3)).when(c > 1, F.round(c / 10, 3)).otherwise(F.round(c, 3))
    return table(spark, d, "article_digests").filter("digest_impact is not null").select("article_id", F.when(odd, 0.0).otherwise(F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))).alias("clamped"), scaled.alias("normalised"))


@query("SELECT ingest_seq, replace(substring(fetched_at, 1, 10), '-', '/') || '/' || article_id || '.json' AS path FROM articles WHERE article_id IS NOT NULL")
def i_article_path(spark: SparkSession, d: str) -> DataFrame:
    """Where an article's document lies, by the day of its collection."""
    at = F.date_format(times.instant(F.col("fetched_at")), "yyyy/MM/dd")
    return table(spark, d, "articles").filter("article_id is not null").select("ingest_seq", F.concat(at, F.lit("/"), "article_id", F.lit(".json")).alias("path"))


@query(f"""WITH {base._FIRST}, p AS (SELECT event_id, split_part(source_name, ' - ', 1) AS name, min(ingest_seq) AS s FROM first WHERE event_id IS NOT NULL AND source_name IS NOT NULL GROUP BY ALL),
l AS (SELECT event_id, list(name ORDER BY s) AS names FROM p GROUP BY 1)
SELECT event_id, array_to_string(names[1:2], ', ') || CASE WHEN len(names) > 2 THEN ' +' || (len(names) - 2) ELSE '' END AS label, CAST(least(greatest(len(names), 1), 5) AS INTEGER) AS shade FROM l""")
def i_publisher_label(spark: SparkSession, d: str) -> DataFrame:
    """The first two publishers of an event and how many more there are, and its shade level; one entry a publisher, so lists are short."""
    a = first_articles(spark, d, "event_id", "source_name").filter("event_id is not null and source_name is not null")
    p = a.groupBy("event_id", text.publisher(F.col("source_name")).alias("name")).agg(F.min("ingest_seq").alias("s"))
    l = p.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("s", "name"))).alias("l"))  # noqa: E741
    n = F.size("l")
    label = F.concat(F.array_join(F.slice("l.name", 1, 2), ", "), F.when(n > 2, F.concat(F.lit(" +"), (n - 2).cast("string"))).otherwise(F.lit("")))
    return l.select("event_id", label.alias("label"), F.least(F.greatest(n, F.lit(1)), F.lit(5)).alias("shade"))


# --- selections


@query(f"""WITH {base._LAST} SELECT article_id, source_id, fetched_at FROM last WHERE aggregation_status = 'pending' AND digest_status = 'completed' AND fetched_at >= '2024-03-01T00:00:00Z' AND fetched_at < '2025-06-01T00:00:00Z' ORDER BY fetched_at DESC, article_id LIMIT 200""")
def c_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest digested articles of a half-open range that no event has yet."""
    a = mutations.latest_rows(table(spark, d, "articles").filter("article_id is not null").select("article_id", "ingest_seq", "source_id", "fetched_at", "aggregation_status", "digest_status"), "article_id", "ingest_seq")
    a = a.filter("aggregation_status = 'pending' and digest_status = 'completed' and fetched_at >= '2024-03-01T00:00:00Z' and fetched_at < '2025-06-01T00:00:00Z'")
    return a.select("article_id", "source_id", "fetched_at").orderBy(F.desc("fetched_at"), "article_id").limit(200)


@query("""WITH r AS (SELECT event_a, event_b, count(*) AS attempts, max(reviewed_at) AS last_at, max(event_a_updated_at) AS seen FROM deduplication_reviews WHERE should_merge IS NULL GROUP BY 1, 2), u AS (SELECT event_a, event_b, max(event_a_updated_at) AS now FROM deduplication_reviews GROUP BY 1, 2)
SELECT event_a, event_b, attempts, CASE WHEN attempts >= 2 AND seen = now THEN 'deferred' WHEN seen <> now THEN 'changed' ELSE 'retry' END AS next_step FROM r JOIN u USING (event_a, event_b)""")
def c_deferred_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose review failed: put off after two attempts, unless the event has changed since."""
    r, none = table(spark, d, "deduplication_reviews"), F.col("should_merge").isNull()
    g = r.groupBy("event_a", "event_b").agg(F.count(F.when(none, 1)).alias("attempts"), F.max(F.when(none, F.col("event_a_updated_at"))).alias("seen"), F.max("event_a_updated_at").alias("now"))
    step = F.when((F.col("attempts") >= 2) & (F.col("seen") == F.col("now")), "deferred").when(F.col("seen") != F.col("now"), "changed").otherwise("retry")
    return g.filter("attempts > 0 and event_a is not null and event_b is not null").select("event_a", "event_b", "attempts", step.alias("next_step"))


@query(f"""WITH {base._FIRST}, o AS (SELECT coalesce(f.default_category, 'none') AS category, a.article_id, a.ingest_seq FROM first a JOIN feeds f USING (source_id) WHERE a.digest_status <> 'completed')
SELECT category, article_id, CAST(row_number() OVER (PARTITION BY category ORDER BY ingest_seq DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY category) - least(20, count(*) OVER (PARTITION BY category)) AS deferred FROM o QUALIFY place <= 20""")
def g_head_and_deferred(spark: SparkSession, d: str) -> DataFrame:
    """The 20 newest open articles of every category, and how many wait behind them."""
    f = table(spark, d, "feeds").select("source_id", F.coalesce("default_category", F.lit("none")).alias("category"))
    o = first_articles(spark, d, "source_id", "digest_status").filter("digest_status != 'completed'").join(f, "source_id")
    n = o.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return grouping.top_per_group(o, "category", [F.desc("ingest_seq")], 20).join(n, "category").select("category", "article_id", "place", F.greatest(F.col("n") - 20, F.lit(0)).alias("deferred"))


# --- windows and lifecycles


@query(f"""WITH r AS (SELECT epoch({_TS.format("fetched_at")})::BIGINT AS s, event_id FROM articles), w AS (SELECT s // 10800 * 10800 AS b, event_id FROM r UNION ALL SELECT s // 10800 * 10800 - 10800, event_id FROM r WHERE s % 10800 < 3600),
g AS (SELECT b, count(*) - count(event_id) AS unassigned FROM w GROUP BY 1) SELECT b AS window_start, unassigned FROM g WHERE unassigned > 0 OR b = (SELECT max(b) FROM g)""")
def j_windows_to_run(spark: SparkSession, d: str) -> DataFrame:
    """Hopping windows in which an article has no event yet, and the latest one in any case."""
    from tidemill.operators import windows

    a = table(spark, d, "articles").select(times.instant(F.col("fetched_at")).alias("ts"), "event_id")
    g = windows.hopping(a, "ts").groupBy(F.unix_seconds("window_start").alias("window_start")).agg(F.sum(F.col("event_id").isNull().cast("bigint")).alias("unassigned"))
    last = a.agg(F.floor(F.unix_seconds(F.max("ts")) / 10800) * 10800).first()[0]
    return g.filter((F.col("unassigned") > 0) | (F.col("window_start") == (last or 0)))


@query(f"""WITH b AS (SELECT source_id, min(epoch({_TS.format("fetched_at")}))::BIGINT AS lo, max(epoch({_TS.format("fetched_at")}))::BIGINT AS hi FROM articles WHERE event_id IS NULL AND source_id IS NOT NULL GROUP BY 1)
SELECT source_id, greatest(lo, hi // 86400 * 86400 - 172800) // 10800 * 10800 AS range_start, (hi + 10799) // 10800 * 10800 AS range_end FROM b""")
def j_default_range(spark: SparkSession, d: str) -> DataFrame:
    """The range a source's next run covers: from two days before the midnight of its last open article, in whole steps."""
    s = F.unix_seconds(times.instant(F.col("fetched_at")))
    b = table(spark, d, "articles").filter("event_id is null and source_id is not null").groupBy("source_id").agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    whole = lambda c, n: (F.floor(c / n) * n).cast("bigint")
    return b.select("source_id", whole(F.greatest(F.col("lo"), whole(F.col("hi"), 86400) - 172800), 10800).alias("range_start"), whole(F.col("hi") + 10799, 10800).alias("range_end"))


def event_state(last: Column, now: Column) -> Column:
    """Archived after 30 days, which is looked at first, stale after 48 hours, else active."""
    age = F.unix_seconds(now) - F.unix_seconds(last)
    return F.when(age > 30 * 86400, "archived").when(age > 48 * 3600, "stale").otherwise("active")


_STATES = f"""now AS (SELECT max({_TS.format("fetched_at")}) AS t FROM articles), st AS (SELECT event_id, count(*) AS members, max({_TS.format("fetched_at")}) AS last_at FROM articles WHERE event_id IS NOT NULL GROUP BY 1),
states AS (SELECT event_id, members, CASE WHEN epoch(t) - epoch(last_at) > 2592000 THEN 'archived' WHEN epoch(t) - epoch(last_at) > 172800 THEN 'stale' ELSE 'active' END AS state FROM st, now)"""


def event_states(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("event_id", times.instant(F.col("fetched_at")).alias("at"))
    now = a.agg(F.max("at")).first()[0]
    g = a.filter("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("members"), F.max("at").alias("last"))
    return g.select("event_id", "members", event_state(F.col("last"), F.lit(now).cast("timestamp")).alias("state"))


@query(f"WITH {_STATES} SELECT event_id, members, state FROM states")
def j_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The state of every event by its last article."""
    return event_states(spark, d)


@query(f"WITH {base._FIRST}, {_STATES} SELECT a.article_id, a.event_id, s.state FROM first a JOIN states s USING (event_id) WHERE s.state <> 'archived'")
def d_active_articles(spark: SparkSession, d: str) -> DataFrame:
    return first_articles(spark, d, "event_id").join(event_states(spark, d).filter("state != 'archived'"), "event_id").select("article_id", "event_id", "state")


@query(f"WITH {base._FIRST}, {_STATES} SELECT a.article_id, a.event_id FROM first a LEFT JOIN states s USING (event_id) WHERE a.fetched_at < '2025-01-01T00:00:00Z' AND (a.is_filtered = 1 OR s.state = 'archived')")
def d_removable(spark: SparkSession, d: str) -> DataFrame:
    """Articles before a cutoff that are filtered or whose event is archived; those without an event stay in the left join."""
    a = first_articles(spark, d, "event_id", "fetched_at", "is_filtered").filter("fetched_at < '2025-01-01T00:00:00Z'").join(event_states(spark, d), "event_id", "left")
    return a.filter("is_filtered = 1 or state = 'archived'").select("article_id", "event_id")


@query(f"WITH {_STATES} SELECT DISTINCT a.event_id, s.state FROM articles a LEFT JOIN states s USING (event_id) WHERE a.event_id IS NOT NULL AND a.fetched_at >= '2024-06-01T00:00:00Z' AND a.fetched_at < '2024-09-01T00:00:00Z'")
def d_events_in_range(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "articles").filter("event_id is not null and fetched_at >= '2024-06-01T00:00:00Z' and fetched_at < '2024-09-01T00:00:00Z'").select("event_id").distinct()
    return ids.join(event_states(spark, d), "event_id", "left").select("event_id", "state")


@query("""WITH a AS (SELECT DISTINCT event_id, article_id FROM articles WHERE event_id IS NOT NULL), g AS (SELECT DISTINCT event_id, article_id FROM article_digests WHERE event_id IS NOT NULL), b AS (SELECT coalesce(a.event_id, g.event_id) AS event_id, count(a.article_id) AS now, count(g.article_id) AS noted, count(*) AS every FROM a FULL JOIN g ON a.event_id = g.event_id AND a.article_id = g.article_id GROUP BY 1)
SELECT event_id, CASE WHEN now = 0 THEN 'delete' WHEN now <> every OR noted <> every THEN 'recompute' ELSE 'keep' END AS step FROM b""")
def j_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of an event as noted, given the members it has now."""
    pair = lambda t, flag: table(spark, d, t).filter("event_id is not null").select("event_id", "article_id").distinct().withColumn(flag, F.lit(1))
    b = pair("articles", "a").join(pair("article_digests", "g"), ["event_id", "article_id"], "full_outer").groupBy("event_id").agg(F.count("a").alias("now"), F.count("g").alias("noted"), F.count(F.lit(1)).alias("every"))
    return b.select("event_id", F.when(F.col("now") == 0, "delete").when((F.col("now") != F.col("every")) | (F.col("noted") != F.col("every")), "recompute").otherwise("keep").alias("step"))


@query("""WITH o AS (SELECT ingest_seq, article_id, published_at, digest_status, fetched_at, lag(ingest_seq) OVER w AS prev, lag(published_at) OVER w AS p, lag(digest_status) OVER w AS s, first_value(fetched_at) OVER w AS created_at FROM articles WHERE article_id IS NOT NULL WINDOW w AS (PARTITION BY article_id ORDER BY ingest_seq))
SELECT ingest_seq, article_id, sum(CASE WHEN prev IS NULL OR p IS DISTINCT FROM published_at OR s IS DISTINCT FROM digest_status THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY ingest_seq)::BIGINT AS revision, created_at FROM o""")
def j_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The revision of every delivered row: one more only if something that matters changed; the time of creation stays."""
    w = Window.partitionBy("article_id").orderBy("ingest_seq")
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(w))
    a = table(spark, d, "articles").filter("article_id is not null").select("ingest_seq", "article_id", "published_at", "digest_status", "fetched_at")
    o = a.withColumn("new", (F.lag("ingest_seq").over(w).isNull() | ~same("published_at") | ~same("digest_status")).cast("bigint"))
    return o.select("ingest_seq", "article_id", F.sum("new").over(w).alias("revision"), F.first("fetched_at").over(w).alias("created_at"))


@query("""WITH c AS (SELECT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b, * FROM deduplication_reviews WHERE event_a <> event_b AND should_merge IS NOT NULL AND reviewed_at >= '2024-06-01T00:00:00Z')
SELECT a, b, prompt_version, max(reviewed_at) AS reviewed_at, count(*) AS replaced FROM c GROUP BY ALL""")
def b_cache_prune(spark: SparkSession, d: str) -> DataFrame:
    """A cache of judgements: the last one of a pair and version stands, those before the cutoff are gone."""
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b and should_merge is not null and reviewed_at >= '2024-06-01T00:00:00Z'")
    return r.groupBy(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b"), "prompt_version").agg(F.max("reviewed_at").alias("reviewed_at"), F.count(F.lit(1)).alias("replaced"))


@query("""WITH o AS (SELECT article_id, arg_min(sha256(headline || coalesce(summary, '')), ingest_seq) AS before, arg_max(sha256(headline || coalesce(summary, '')), ingest_seq) AS after, count(*) AS n FROM articles WHERE article_id IS NOT NULL AND headline IS NOT NULL GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'once' WHEN before = after THEN 'same' ELSE 'changed' END AS kind, count(*) AS articles FROM o GROUP BY 1""")
def h_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What has become of the articles between their first and their last delivery."""
    h = F.sha2(F.concat("headline", F.coalesce("summary", F.lit(""))), 256)
    o = table(spark, d, "articles").filter("article_id is not null and headline is not null").groupBy("article_id").agg(F.min_by(h, "ingest_seq").alias("x"), F.max_by(h, "ingest_seq").alias("y"), F.count(F.lit(1)).alias("n"))
    return o.groupBy(F.when(F.col("n") == 1, "once").when(F.col("x") == F.col("y"), "same").otherwise("changed").alias("kind")).agg(F.count(F.lit(1)).alias("articles"))


@query("""WITH m AS (SELECT max(ingest_seq) // 2 AS b FROM articles) SELECT source_id, count(DISTINCT article_id) AS new_articles FROM articles, m WHERE ingest_seq > b AND article_id IS NOT NULL AND source_id IS NOT NULL AND article_id NOT IN (SELECT article_id FROM articles, m WHERE ingest_seq <= b AND article_id IS NOT NULL) GROUP BY 1""")
def h_new_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the later half of the rows that the earlier half doesn't know, by source."""
    a = table(spark, d, "articles").filter("article_id is not null").select("ingest_seq", "article_id", "source_id")
    half = F.lit((a.agg(F.max("ingest_seq")).first()[0] or 0) // 2)
    later = a.filter((F.col("ingest_seq") > half) & F.col("source_id").isNotNull())
    known = a.filter(F.col("ingest_seq") <= half).select("article_id")
    return later.join(known, "article_id", "left_anti").groupBy("source_id").agg(F.countDistinct("article_id").alias("new_articles"))


# --- reports


@query("""WITH w AS (SELECT model, CASE WHEN reviewed_at >= '2025-01-01T00:00:00Z' THEN 'later' ELSE 'earlier' END AS part, confidence, should_merge FROM deduplication_reviews WHERE reviewed_at >= '2024-07-01T00:00:00Z' AND reviewed_at < '2025-07-04T00:00:00Z'),
g AS (SELECT model, count(*) FILTER (WHERE part = 'earlier') AS earlier, count(*) FILTER (WHERE part = 'later') AS later, count(*) FILTER (WHERE confidence IS NULL) AS without FROM w GROUP BY 1)
SELECT model, earlier, later, later - earlier AS difference, without, CASE WHEN later < earlier THEN 'less' WHEN later > earlier THEN 'more' ELSE 'equal' END AS verdict FROM g""")
def e_window_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two equal windows of calls side by side, in one aggregation."""
    r = table(spark, d, "deduplication_reviews").filter("reviewed_at >= '2024-07-01T00:00:00Z' and reviewed_at < '2025-07-04T00:00:00Z'")
    late = F.col("reviewed_at") >= "2025-01-01T00:00:00Z"
    g = r.groupBy("model").agg(F.count(F.when(~late, 1)).alias("earlier"), F.count(F.when(late, 1)).alias("later"), F.count(F.when(F.col("confidence").isNull(), 1)).alias("without"))
    return g.select("model", "earlier", "later", (F.col("later") - F.col("earlier")).alias("difference"), "without", F.when(F.col("later") < F.col("earlier"), "less").when(F.col("later") > F.col("earlier"), "more").otherwise("equal").alias("verdict"))


@query("SELECT digest_status, aggregation_status, is_filtered, count(*) AS rows_waiting, min(fetched_at) AS oldest FROM articles GROUP BY ALL")
def e_backlog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").groupBy("digest_status", "aggregation_status", "is_filtered").agg(F.count(F.lit(1)).alias("rows_waiting"), F.min("fetched_at").alias("oldest"))


@query("SELECT article_id, count(*) AS failures, max(collection_run_id) AS last_run FROM articles WHERE digest_status = 'failed' AND article_id IS NOT NULL GROUP BY 1")
def e_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").filter("digest_status = 'failed' and article_id is not null").groupBy("article_id").agg(F.count(F.lit(1)).alias("failures"), F.max("collection_run_id").alias("last_run"))


@query("""WITH m AS (SELECT max(started_at) AS t FROM pipeline_runs) SELECT stage AS subject, 'freshness' AS what, CASE WHEN max(CASE WHEN status = 'completed' THEN finished_at END) >= max(t) THEN 'ok' WHEN count(CASE WHEN status = 'completed' THEN 1 END) = 0 THEN 'failed' ELSE 'late' END AS outcome FROM pipeline_runs, m GROUP BY stage
UNION ALL SELECT run_id, 'run', 'failed' FROM pipeline_runs WHERE status <> 'completed' OR finished_at IS NULL
UNION ALL SELECT source_id, 'backlog', 'late' FROM articles WHERE digest_status = 'pending' AND source_id IS NOT NULL GROUP BY source_id HAVING count(*) >= 10""")
def k_health(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a healthy state: freshness of every stage, runs that didn't finish, sources with a backlog."""
    r = table(spark, d, "pipeline_runs")
    done = F.max(F.when(F.col("status") == "completed", F.col("finished_at")))
    last = r.agg(F.max("started_at")).first()[0]
    fresh = r.groupBy("stage").agg(done.alias("done")).select(F.col("stage").alias("subject"), F.lit("freshness").alias("what"), F.when(F.col("done") >= F.lit(last), "ok").when(F.col("done").isNull(), "failed").otherwise("late").alias("outcome"))
    runs = r.filter("status != 'completed' or finished_at is null").select(F.col("run_id").alias("subject"), F.lit("run").alias("what"), F.lit("failed").alias("outcome"))
    late = table(spark, d, "articles").filter("digest_status = 'pending' and source_id is not null").groupBy("source_id").count().filter("count >= 10")
    return fresh.union(runs).union(late.select("source_id", F.lit("backlog"), F.lit("late")))


# --- order of candidate pairs

_ORDERED = """p AS (SELECT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b, max(CASE WHEN should_merge = 1 THEN 2 WHEN should_merge IS NULL THEN 1 ELSE 0 END) AS priority, max(greatest(event_a_updated_at, event_b_updated_at)) AS updated_at FROM deduplication_reviews WHERE event_a <> event_b GROUP BY 1, 2)"""


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b")
    rank = F.when(F.col("should_merge") == 1, 2).when(F.col("should_merge").isNull(), 1).otherwise(0)
    return r.groupBy(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b")).agg(F.max(rank).alias("priority"), F.max(F.greatest("event_a_updated_at", "event_b_updated_at")).alias("updated_at"))


@query(f"WITH {_ORDERED} SELECT a, b, priority, updated_at FROM p ORDER BY priority DESC, updated_at DESC, a DESC, b DESC LIMIT 300")
def f_pair_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 candidate pairs: by priority, the later change, then the names, all descending."""
    return candidate_pairs(spark, d).orderBy(F.desc("priority"), F.desc("updated_at"), F.desc("a"), F.desc("b")).limit(300)


@query()
def m_disjoint_round(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that a first greedy round takes from all candidates in that order, no event twice."""
    pairs = candidate_pairs(spark, d)
    # An order as one comparable value: structs compare field by field; the smallest comes first.
    down = lambda c: F.translate(c, "0123456789", "9876543210")  # noqa: E731 - times of equal form, so later ones come first
    rank = F.struct((-F.col("priority")).alias("p"), down("updated_at").alias("u"), F.col("a").alias("x"), F.col("b").alias("y"))
    return matching.disjoint_round(pairs.withColumn("rank", rank), "a", "b", "rank").select("a", "b", "priority", "updated_at")
