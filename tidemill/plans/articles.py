"""Queries over articles, texts and digests: text and URL functions, identity, deduplicating joins, keywords and pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text, times, urls
from tidemill.operators import grouping, matching, mutations, windows
from tidemill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN (" + _STOP + "))"
_FIRST = "first AS (SELECT * FROM articles WHERE article_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingest_seq) = 1)"
_LAST = "last AS (SELECT * FROM articles WHERE article_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ingest_seq DESC) = 1)"


def first_articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return mutations.first_rows(table(spark, d, "articles").select("article_id", "ingest_seq", *columns), "article_id", "ingest_seq")


# --- scalar functions over whole tables


@query("SELECT ingest_seq, array_to_string(regexp_extract_all(lower(headline), '[a-z0-9]+'), ' ') AS title, trim(regexp_replace(headline, '[\\s\\x{a0}]+', ' ', 'g')) AS clean FROM articles")
def i_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("ingest_seq", text.normalised_title(F.col("headline")).alias("title"), text.collapse(F.col("headline")).alias("clean"))


@query(f"SELECT ingest_seq, CASE WHEN len({_WORDS.format('headline')}) = 0 THEN 'story' ELSE array_to_string(({_WORDS.format('headline')})[1:8], '-') END AS slug, regexp_replace(regexp_replace(event_id, '^\\d{{4}}-\\d{{2}}-\\d{{2}}-', ''), '-\\d+$', '') AS base FROM articles")
def i_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("ingest_seq", text.slug(F.col("headline")).alias("slug"), text.base_slug(F.col("event_id")).alias("base"))


@query("""SELECT ingest_seq,
  CASE WHEN length(summary) <= 80 THEN summary ELSE rtrim(regexp_replace(substring(summary, 1, 80), ' [^ ]*$', '')) END AS bounded,
  CASE WHEN length(headline) <= 60 THEN headline ELSE substring(headline, 1, 57) || '...' END AS label,
  CASE WHEN length(summary) <= 300 THEN summary ELSE (CASE WHEN length(regexp_replace(substring(summary, 1, 300), ' [^ ]*$', '')) > 150 THEN regexp_replace(substring(summary, 1, 300), ' [^ ]*$', '') ELSE substring(summary, 1, 300) END) || '…' END AS teaser
FROM articles""")
def i_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("ingest_seq", text.bounded(F.col("summary"), 80).alias("bounded"), text.short_label(F.col("headline"), 60).alias("label"), text.summary_fallback(F.col("summary"), 300).alias("teaser"))


@query("""SELECT ingest_seq, CASE WHEN regexp_replace(regexp_replace(guid, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(guid, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') END AS safe,
  split_part(source_name, ' - ', 1) AS publisher, lower(substring(language, 1, 2)) AS language FROM articles""")
def i_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("ingest_seq", text.sanitize_id(F.col("guid")).alias("safe"), text.publisher(F.col("source_name")).alias("publisher"), F.lower(F.substring("language", 1, 2)).alias("language"))


@query(r"""WITH p AS (SELECT ingest_seq, regexp_replace(trim(url), '#.*$', '') AS u FROM articles), q AS (
  SELECT ingest_seq, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[^:/?#]+://([^/?]*)', 1)) AS authority, regexp_extract(u, '^[^:/?#]+://[^/?]*([^?]*)', 1) AS path,
    list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND regexp_extract(x, '^([^=]*)', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS items FROM p)
SELECT ingest_seq, CASE WHEN scheme IN ('http', 'https') AND authority <> '' THEN scheme || '://' || authority || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(items) > 0 THEN '?' || array_to_string(list_sort(items), '&') ELSE '' END END AS canonical,
  lower(regexp_extract(u, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, regexp_extract_all(u, '/(20\d{2}/\d{2}/\d{2})(?:/|$)', 1) AS path_dates FROM q""")
def i_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "articles").select("ingest_seq", urls.canonical(u).alias("canonical"), urls.host(u).alias("host"), urls.path_dates(u).alias("path_dates"))


@query(f"""WITH {_FIRST} SELECT article_id, sha256(canonical_url) AS url_hash, sha256(lower(headline)) AS headline_hash, CASE WHEN summary <> '' THEN sha256(lower(summary)) END AS summary_hash,
  sha256(coalesce(canonical_url, source_id || ':' || guid, source_id || ':' || url || ':' || headline || ':' || coalesce(published_at, ''))) AS identity FROM first""")
def i_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "canonical_url", "headline", "summary", "source_id", "guid", "url", "published_at")
    join = lambda *c: F.when(F.concat(*c).isNotNull(), F.concat_ws(":", *c))
    own = F.coalesce("canonical_url", join("source_id", "guid"), F.concat_ws(":", "source_id", "url", "headline", F.coalesce("published_at", F.lit(""))))
    return a.select("article_id", F.sha2("canonical_url", 256).alias("url_hash"), F.sha2(F.lower("headline"), 256).alias("headline_hash"), F.when(F.col("summary") != "", F.sha2(F.lower("summary"), 256)).alias("summary_hash"), F.sha2(own, 256).alias("identity"))


@query("""SELECT t.article_id, CASE WHEN coalesce(length(content_text), 0) < 600 THEN 'short' WHEN content_text = summary THEN 'equal' WHEN length(content_text) <= coalesce(length(summary), 0) + 200 THEN 'little_more' ELSE 'full' END AS feed_text
FROM article_texts t LEFT JOIN (SELECT article_id, arg_min(coalesce(summary, ''), ingest_seq) AS summary FROM articles GROUP BY 1) a USING (article_id) WHERE extractor = 'feed'""")
def c_feed_text(spark: SparkSession, d: str) -> DataFrame:
    s = first_articles(spark, d, "summary").select("article_id", F.coalesce("summary", F.lit("")).alias("summary"))
    t = table(spark, d, "article_texts").filter("extractor = 'feed'").select("article_id", "content_text")
    return t.join(s, "article_id", "left").select("article_id", text.quality(F.col("content_text"), F.col("summary")).alias("feed_text"))


# --- time


@query("SELECT ingest_seq, epoch(CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT // 10800 * 10800 AS bucket, substring(fetched_at, 1, 10) AS day FROM articles")
def i_buckets(spark: SparkSession, d: str) -> DataFrame:
    at = times.instant(F.col("fetched_at"))
    return table(spark, d, "articles").select("ingest_seq", F.unix_seconds(times.floor_hours(at, 3)).alias("bucket"), F.date_format(at, "yyyy-MM-dd").alias("day"))


@query("""WITH r AS (SELECT epoch(CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT AS s, source_id FROM articles), w AS (
  SELECT s // 10800 * 10800 AS b, s, source_id FROM r UNION ALL SELECT s // 10800 * 10800 - 10800, s, source_id FROM r WHERE s % 10800 < 3600)
SELECT b AS window_start, b + 14400 AS window_end, count(*) AS articles, count(DISTINCT source_id) AS sources FROM w GROUP BY ALL""")
def j_hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select(times.instant(F.col("fetched_at")).alias("ts"), "source_id")
    w = windows.hopping(a, "ts").groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source_id").alias("sources"))
    return w.withColumn("window_start", F.unix_seconds("window_start")).withColumn("window_end", F.unix_seconds("window_end"))


@query("""WITH r AS (SELECT DISTINCT epoch(CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT // 10800 * 10800 AS b FROM articles WHERE event_id IS NULL) SELECT b AS window_start, b + 14400 AS window_end FROM r""")
def j_sparse_plan(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select(times.instant(F.col("fetched_at")).alias("ts"), "event_id")
    return windows.sparse_plan(a, "ts", "event_id is null").select(F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"))


@query("SELECT source_id, min(fetched_at) AS earliest, max(fetched_at) AS latest, count(*) AS open_rows FROM articles WHERE event_id IS NULL GROUP BY source_id")
def e_time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").filter("event_id is null").groupBy("source_id").agg(F.min("fetched_at").alias("earliest"), F.max("fetched_at").alias("latest"), F.count(F.lit(1)).alias("open_rows"))


@query("""WITH m AS (SELECT max(ingest_seq) // 2 AS b FROM articles) SELECT collection_run_id, count(*) AS articles, sum(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unassigned FROM articles, m WHERE ingest_seq <= b GROUP BY 1""")
def j_snapshot_boundary(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles")
    limit = a.agg(F.floor(F.max("ingest_seq") / 2).alias("b")).first()["b"] or 0
    return a.filter(F.col("ingest_seq") <= limit).groupBy("collection_run_id").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.col("event_id").isNull().cast("bigint")).alias("unassigned"))


@query("""SELECT ingest_seq, CASE WHEN digest_status = 'pending' AND fetched_at < '2024-06-01T00:00:00Z' THEN 'expired' WHEN digest_status = 'failed' AND fetched_at >= '2024-06-01T00:00:00Z' THEN 'restored' END AS next_state FROM articles""")
def j_horizon(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("ingest_seq", times.instant(F.col("fetched_at")).alias("ts"), "digest_status")
    return windows.horizon_split(a, "ts", "2024-06-01 00:00:00", "digest_status = 'pending'", "digest_status = 'failed'").select("ingest_seq", "next_state")


# --- writes


@query(f"WITH {_FIRST} SELECT article_id, ingest_seq, source_id, headline, fetched_at FROM first")
def b_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "ingest_seq", "source_id", "headline", "fetched_at")
    earlier, later = rows.filter("ingest_seq <= 1000"), rows.filter("ingest_seq > 1000")
    return mutations.insert_or_ignore(mutations.first_rows(earlier, "article_id", "ingest_seq"), later, "article_id", "ingest_seq")


@query(f"WITH {_FIRST}, {_LAST} SELECT l.article_id, coalesce(l.published_at, f.published_at) AS published_at, coalesce(l.digest_status, f.digest_status) AS digest_status, f.fetched_at FROM last l JOIN first f USING (article_id)")
def b_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("article_id", "ingest_seq", "published_at", "digest_status", "fetched_at")
    old = mutations.first_rows(rows, "article_id", "ingest_seq").select("article_id", "published_at", "digest_status", "fetched_at")
    return mutations.upsert(old, rows, "article_id", "ingest_seq", keep=("fetched_at",))


@query("SELECT ingest_seq, CASE WHEN a.event_id IS NULL THEN g.event_id ELSE a.event_id END AS event_id, CASE WHEN a.event_id IS NULL AND g.event_id IS NOT NULL THEN 1 ELSE 0 END AS changed FROM articles a LEFT JOIN article_digests g USING (article_id)")
def b_guarded_assign(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "article_digests").select("article_id", F.col("event_id").alias("suggested"))
    a = table(spark, d, "articles").select("article_id", "ingest_seq", "event_id").join(g, "article_id", "left")
    return mutations.guarded_update(a, F.col("event_id").isNull(), "event_id", F.col("suggested")).select("ingest_seq", "event_id", "changed")


@query("SELECT article_id, content_hash FROM article_fingerprints WHERE article_id NOT IN (SELECT article_id FROM articles WHERE is_filtered = 1)")
def b_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "is_filtered")
    _, children = mutations.delete_cascade(a, {"prints": table(spark, d, "article_fingerprints")}, "article_id", a.filter("is_filtered = 1"))
    return children["prints"].select("article_id", "content_hash")


_LOSERS = """link AS (SELECT greatest(event_a, event_b) AS loser, min(least(event_a, event_b)) AS winner FROM deduplication_reviews WHERE should_merge = 1 AND event_a <> event_b GROUP BY 1),
walk AS (SELECT loser, winner FROM link UNION ALL SELECT w.loser, l.winner FROM walk w JOIN link l ON w.winner = l.loser), m AS (SELECT loser, min(winner) AS winner FROM walk GROUP BY 1)"""


def merge_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every event that lost a merge with the winner at the end of its chain."""
    r = table(spark, d, "deduplication_reviews").filter("should_merge = 1 and event_a != event_b")
    m = r.groupBy(F.greatest("event_a", "event_b").alias("loser")).agg(F.min(F.least("event_a", "event_b")).alias("winner"))
    return mutations.follow_chains(m, "loser", "winner")


@query(f"WITH RECURSIVE {_LOSERS} SELECT article_id, coalesce(winner, event_id) AS event_id FROM article_digests LEFT JOIN m ON event_id = loser")
def b_merge_losers(spark: SparkSession, d: str) -> DataFrame:
    m = merge_chains(spark, d)
    return mutations.repoint(table(spark, d, "article_digests").select("article_id", "event_id"), "event_id", m, "loser", "winner").select("article_id", "event_id")


@query(f"WITH RECURSIVE {_LOSERS} SELECT event_id, count(*) AS members FROM article_digests WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT loser FROM m) GROUP BY 1")
def b_events_left(spark: SparkSession, d: str) -> DataFrame:
    """The events that are left when the losers are deleted."""
    e = table(spark, d, "article_digests").filter("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("members"))
    return e.join(merge_chains(spark, d), F.col("event_id") == F.col("loser"), "left_anti")


# --- joins


@query(f"""WITH {_FIRST}, done AS (SELECT f.article_id, f.ingest_seq, p.content_hash, p.canonical_url_hash FROM first f JOIN article_fingerprints p USING (article_id) WHERE f.digest_status = 'completed'),
c AS (SELECT content_hash, arg_min(article_id, ingest_seq) AS donor FROM done WHERE content_hash IS NOT NULL GROUP BY 1), u AS (SELECT canonical_url_hash, arg_min(article_id, ingest_seq) AS donor FROM done WHERE canonical_url_hash IS NOT NULL GROUP BY 1)
SELECT f.article_id, coalesce(c.donor, u.donor) AS donor FROM first f LEFT JOIN article_fingerprints p USING (article_id) LEFT JOIN c USING (content_hash) LEFT JOIN u ON u.canonical_url_hash = p.canonical_url_hash WHERE f.digest_status <> 'completed'""")
def d_reuse_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Articles without a digest with the finished one that has the same text, else the same address."""
    f = first_articles(spark, d, "digest_status").join(table(spark, d, "article_fingerprints"), "article_id", "left")
    done = f.filter("digest_status = 'completed'")
    donor = lambda h, n: done.filter(F.col(h).isNotNull()).groupBy(h).agg(F.min_by("article_id", "ingest_seq").alias(n))
    out = f.filter("digest_status != 'completed'").join(donor("content_hash", "c"), "content_hash", "left").join(donor("canonical_url_hash", "u"), "canonical_url_hash", "left")
    return out.select("article_id", F.coalesce("c", "u").alias("donor"))


@query(f"""WITH {_FIRST}, k AS (SELECT article_id, ingest_seq, 'u' || url AS key FROM first UNION SELECT article_id, ingest_seq, 'u' || canonical_url FROM first UNION SELECT article_id, ingest_seq, 'g' || source_id || ' ' || guid FROM first), m AS (SELECT key, min(ingest_seq) AS s FROM k WHERE key IS NOT NULL GROUP BY 1)
SELECT k.article_id, min(m.s) AS first_seq FROM k JOIN m USING (key) GROUP BY k.article_id HAVING min(m.s) < min(k.ingest_seq)""")
def d_identity_match(spark: SparkSession, d: str) -> DataFrame:
    """The earliest row with the same url, canonical url (either with either) or entry; a disjunction as a union of equi joins."""
    a = first_articles(spark, d, "url", "canonical_url", "source_id", "guid")
    keys = F.array_compact(F.array(F.concat(F.lit("u"), "url"), F.concat(F.lit("u"), "canonical_url"), F.concat(F.lit("g"), "source_id", F.lit(" "), "guid")))
    k = a.select("article_id", "ingest_seq", F.explode(F.array_distinct(keys)).alias("key"))
    m = k.groupBy("key").agg(F.min("ingest_seq").alias("s"))
    return k.join(m, "key").groupBy("article_id").agg(F.min("s").alias("first_seq"), F.min("ingest_seq").alias("own")).filter("first_seq < own").select("article_id", "first_seq")


@query(f"""WITH {_FIRST} SELECT f.event_id, list(headline ORDER BY ingest_seq) AS headlines, list(CASE WHEN length(s) > 300 THEN substring(s, 1, 300) || '...' ELSE s END ORDER BY ingest_seq) AS summaries
FROM (SELECT f.*, coalesce(g.digest_summary, f.summary, '') AS s FROM first f LEFT JOIN article_digests g USING (article_id)) f WHERE f.event_id IS NOT NULL GROUP BY f.event_id""")
def d_event_members(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "headline", "summary").filter("event_id is not null")
    g = table(spark, d, "article_digests").select("article_id", "digest_summary")
    s = F.coalesce("digest_summary", "summary", F.lit(""))
    rows = a.join(g, "article_id", "left").withColumn("s", F.when(F.length(s) > 300, F.concat(F.substring(s, 1, 300), F.lit("..."))).otherwise(s))
    listed = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "headline", "s"))).alias("m"))
    return listed.select("event_id", F.col("m.headline").alias("headlines"), F.col("m.s").alias("summaries"))


@query("""SELECT a.source_id, coalesce(nullif(split_part(f.source_name, ' - ', 1), ''), nullif(split_part(a.source_name, ' - ', 1), ''), 'unknown') AS publisher, coalesce(f.default_category, 'none') AS category, count(*) AS articles FROM articles a LEFT JOIN feeds f USING (source_id) GROUP BY ALL""")
def d_publisher_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("source_id", "source_name").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, d, "feeds").select("source_id", F.col("source_name").alias("feed_name"), "default_category")
    name = lambda c: F.nullif(text.publisher(F.col(c)), F.lit(""))
    out = a.join(f, "source_id", "left").select("source_id", F.coalesce(name("feed_name"), name("source_name"), F.lit("unknown")).alias("publisher"), F.coalesce("default_category", F.lit("none")).alias("category"), "n")
    return out.groupBy("source_id", "publisher", "category").agg(F.sum("n").alias("articles"))


@query("""WITH r AS (SELECT max(collection_run_id) AS run FROM articles), a AS (SELECT DISTINCT source_id FROM articles, r WHERE collection_run_id = run AND source_id IS NOT NULL), f AS (SELECT source_id FROM feeds WHERE enabled = 1)
SELECT source_id, 'silent' AS side FROM f WHERE source_id NOT IN (SELECT source_id FROM a) UNION ALL SELECT source_id, 'not enabled' FROM a WHERE source_id NOT IN (SELECT source_id FROM f)""")
def h_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """Enabled feeds against the sources of the last run."""
    a = table(spark, d, "articles")
    last = a.agg(F.max("collection_run_id").alias("run")).first()["run"]
    seen = a.filter((F.col("collection_run_id") == last) & F.col("source_id").isNotNull()).select("source_id").distinct()
    f = table(spark, d, "feeds").filter("enabled = 1").select("source_id")
    return f.join(seen, "source_id", "left_anti").withColumn("side", F.lit("silent")).union(seen.join(f, "source_id", "left_anti").withColumn("side", F.lit("not enabled")))


@query("""SELECT t.article_id, count(*) AS facts, sum(CASE WHEN contains(trim(regexp_replace(content_text, '\\s+', ' ', 'g')), trim(regexp_replace(fact, '\\s+', ' ', 'g'))) THEN 1 ELSE 0 END)::BIGINT AS supported
FROM (SELECT article_id, unnest(digest_key_facts) AS fact FROM article_digests) q JOIN article_texts t USING (article_id) WHERE fact IS NOT NULL GROUP BY 1""")
def d_quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Key facts of a digest that stand word for word in the article's text."""
    q = table(spark, d, "article_digests").select("article_id", F.filter("digest_key_facts", lambda x: x.isNotNull()).alias("facts")).filter("size(facts) > 0")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    t = table(spark, d, "article_texts").select("article_id", flat(F.col("content_text")).alias("t"))
    return q.join(t, "article_id").select("article_id", F.size("facts").cast("bigint").alias("facts"), F.size(F.filter("facts", lambda x: F.contains("t", flat(x)))).cast("bigint").alias("supported"))


# --- keywords and pairs

_KEYWORDS = f"""{_FIRST}, tok AS (SELECT event_id, ingest_seq, list_filter(regexp_extract_all(lower(concat_ws(' ', headline, summary)), '[a-z][a-z0-9-]{{3,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM first WHERE event_id IS NOT NULL),
one AS (SELECT event_id, ingest_seq, unnest(ws) AS keyword, generate_subscripts(ws, 1) - 1 AS pos FROM tok), cnt AS (SELECT event_id, keyword, count(*) AS n, min(ingest_seq * 100000 + pos) AS p FROM one GROUP BY ALL)"""


@query(f"WITH {_KEYWORDS} SELECT event_id, keyword, n, CAST(row_number() OVER (PARTITION BY event_id ORDER BY n DESC, p, keyword) AS INTEGER) AS rank FROM cnt QUALIFY rank <= 12")
def e_keywords_top12(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "headline", "summary").filter("event_id is not null")
    tokens = a.select("event_id", "ingest_seq", F.posexplode(text.keyword_tokens(F.concat_ws(" ", "headline", "summary"))).alias("pos", "keyword"))
    counted = tokens.groupBy("event_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ingest_seq") * 100000 + F.col("pos")).alias("p"))
    return grouping.top_per_group(counted, "event_id", [F.desc("n"), F.col("p"), F.col("keyword")], 12, "rank").select("event_id", "keyword", "n", "rank")


_TITLES = f"""{_FIRST}, ev AS (SELECT event_id, arg_min(headline, (length(headline) < 20, length(headline), ingest_seq)) AS title FROM first WHERE event_id IS NOT NULL AND headline IS NOT NULL GROUP BY 1),
tok AS (SELECT event_id, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))) AS ws FROM ev), one AS (SELECT event_id, unnest(ws) AS w, len(ws) AS n FROM tok)"""


def event_titles(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "headline").filter("event_id is not null")
    return grouping.titles(a, "event_id", "headline", "ingest_seq")


@query(f"WITH {_TITLES} SELECT event_id, title FROM ev")
def e_event_titles(spark: SparkSession, d: str) -> DataFrame:
    return event_titles(spark, d)


@query(f"WITH {_TITLES} SELECT x.event_id AS a, y.event_id AS b, CAST(count(*) AS INTEGER) AS shared FROM one x JOIN one y ON x.w = y.w AND x.event_id < y.event_id GROUP BY x.event_id, y.event_id, x.n, y.n HAVING count(*) >= 4 OR (count(*) >= 3 AND least(x.n, y.n) <= 4)")
def d_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.title_pairs(event_titles(spark, d), "event_id", "title")


_SLUG = f"CASE WHEN len({_WORDS.format('title')}) = 0 THEN 'story' ELSE array_to_string(({_WORDS.format('title')})[1:3], '-') END"


@query(f"WITH {_TITLES}, e AS (SELECT event_id, {_SLUG} AS slug FROM ev) SELECT slug, count(*) AS events, min(event_id) AS first_event FROM e GROUP BY slug HAVING count(*) > 1")
def d_slug_classes(spark: SparkSession, d: str) -> DataFrame:
    """Events whose titles begin with the same three words of a slug: classes with their first member instead of all pairs."""
    e = event_titles(spark, d).select("event_id", F.substring_index(text.slug(F.col("title")), "-", 3).alias("slug"))
    return e.groupBy("slug").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event")).filter("events > 1")


@query(f"""WITH {_TITLES}, t AS (SELECT x.event_id AS a, y.event_id AS b, 4 AS priority FROM one x JOIN one y ON x.w = y.w AND x.event_id < y.event_id GROUP BY x.event_id, y.event_id, x.n, y.n HAVING count(*) >= 4 OR (count(*) >= 3 AND least(x.n, y.n) <= 4)),
r AS (SELECT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b, 3 AS priority FROM deduplication_reviews WHERE event_a <> event_b)
SELECT a, b, max(priority) AS priority, count(*) AS reasons FROM (SELECT * FROM t UNION ALL SELECT DISTINCT * FROM r) GROUP BY ALL""")
def h_candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of all sources, each once with its highest priority."""
    titles = event_titles(spark, d)
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b").select(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b")).distinct()
    t = matching.title_pairs(titles, "event_id", "title", known=r).select("a", "b", F.lit(4).alias("priority"), F.when(F.col("known"), 2).otherwise(1).cast("bigint").alias("reasons"))
    # The reviewed pairs are few: whether their titles match too is told from the titles, so that the matching pairs needn't move.
    w = lambda k: titles.select(F.col("event_id").alias(k), text.title_tokens(F.col("title")).alias(f"w{k}"))
    rest = r.join(w("a"), "a", "left").join(w("b"), "b", "left").filter(~F.coalesce(matching.titles_match(F.col("wa"), F.col("wb")), F.lit(False)))
    return t.unionByName(rest.select("a", "b", F.lit(3).alias("priority"), F.lit(1).cast("bigint").alias("reasons")))


@query("""WITH c AS (SELECT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b, prompt_version, should_merge, reviewed_at FROM deduplication_reviews WHERE event_a <> event_b)
SELECT a, b, prompt_version, arg_max(coalesce(should_merge, -1), (reviewed_at, coalesce(should_merge, -1))) AS should_merge, count(*) AS reviews FROM c GROUP BY ALL""")
def m_cached_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The last judgement of every pair, whichever way round it was written, and prompt version; -1 for a failed one."""
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b").withColumn("m", F.coalesce("should_merge", F.lit(-1)))
    return r.groupBy(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b"), "prompt_version").agg(F.max_by("m", F.struct("reviewed_at", "m")).alias("should_merge"), F.count(F.lit(1)).alias("reviews"))


# --- aggregations, rankings, sets


@query(f"WITH {_FIRST} SELECT event_id, count(DISTINCT split_part(source_name, ' - ', 1)) AS publishers, count(*) AS articles, min(fetched_at) AS earliest FROM first WHERE event_id IS NOT NULL AND is_filtered = 0 GROUP BY 1")
def e_event_publishers(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "source_name", "is_filtered", "fetched_at").filter("event_id is not null and is_filtered = 0")
    return a.groupBy("event_id").agg(F.countDistinct(text.publisher(F.col("source_name"))).alias("publishers"), F.count(F.lit(1)).alias("articles"), F.min("fetched_at").alias("earliest"))


@query(f"""WITH {_FIRST}, p AS (SELECT event_id, split_part(source_name, ' - ', 1) AS publisher, count(*) AS n FROM first WHERE event_id IS NOT NULL GROUP BY ALL)
SELECT event_id, count(*) AS publishers, sum(n)::BIGINT AS articles, sum(least(greatest(n - 1, 0), 2))::BIGINT AS angles, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS multi_angle, round(count(*) + 0.5 * sum(least(greatest(n - 1, 0), 2)), 2) AS score FROM p GROUP BY 1""")
def e_source_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "source_name").filter("event_id is not null").select("event_id", text.publisher(F.col("source_name")).alias("publisher"), "article_id")
    return grouping.coverage(a, "event_id", "publisher", "article_id")


@query(f"""WITH {_FIRST}, c AS (SELECT event_id, f.default_category AS category, count(*) AS n, min(ingest_seq) AS s FROM first a JOIN feeds f USING (source_id) WHERE event_id IS NOT NULL AND f.default_category IS NOT NULL GROUP BY ALL)
SELECT event_id, category, n FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, s) = 1""")
def e_majority_category(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feeds").select("source_id", F.col("default_category").alias("category"))
    a = first_articles(spark, d, "event_id", "source_id").filter("event_id is not null").join(f, "source_id")
    return grouping.majority(a, "event_id", "category", "ingest_seq")


@query("""WITH g AS (SELECT article_id, event_id FROM article_digests WHERE event_id IS NOT NULL), a AS (SELECT article_id, arg_max(event_id, ingest_seq) AS event_id FROM articles WHERE event_id IS NOT NULL GROUP BY 1),
l AS (SELECT coalesce(sum(n * (n - 1) / 2), 0)::BIGINT AS p FROM (SELECT count(*) AS n FROM g GROUP BY event_id)), r AS (SELECT coalesce(sum(n * (n - 1) / 2), 0)::BIGINT AS p FROM (SELECT count(*) AS n FROM a GROUP BY event_id)), s AS (SELECT coalesce(sum(n * (n - 1) / 2), 0)::BIGINT AS p FROM (SELECT count(*) AS n FROM g JOIN a USING (article_id) GROUP BY g.event_id, a.event_id))
SELECT l.p AS left_pairs, r.p AS right_pairs, s.p AS shared_pairs, CASE WHEN l.p + r.p - s.p = 0 THEN 1.0 ELSE round(s.p::DOUBLE / (l.p + r.p - s.p), 4) END AS jaccard FROM l, r, s""")
def e_grouping_agreement(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "article_digests").filter("event_id is not null").select("article_id", "event_id")
    a = mutations.latest_rows(table(spark, d, "articles").filter("event_id is not null").select("article_id", "event_id", "ingest_seq"), "article_id", "ingest_seq").select("article_id", "event_id")
    return grouping.grouping_agreement(g, a, "article_id", "event_id")


@query("""SELECT collection_run_id, source_id, count(*) AS seen, count(DISTINCT article_id) AS articles, sum(CASE WHEN digest_status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(publish_date_estimated)::BIGINT AS estimated FROM articles GROUP BY ALL""")
def e_run_source_stats(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("collection_run_id", "source_id")
    return a.agg(F.count(F.lit(1)).alias("seen"), F.countDistinct("article_id").alias("articles"), F.sum((F.col("digest_status") == "failed").cast("bigint")).alias("failed"), F.sum(F.col("publish_date_estimated").cast("bigint")).alias("estimated"))


@query("""WITH m AS (SELECT max(CAST(replace(replace(reviewed_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) - INTERVAL 2160 HOUR AS since FROM deduplication_reviews),
u AS (SELECT 'deduplication' AS stage, model, prompt_version, should_merge, confidence, substring(reviewed_at, 1, 10) AS day FROM deduplication_reviews, m WHERE CAST(replace(replace(reviewed_at, 'T', ' '), 'Z', '') AS TIMESTAMP) >= since)
SELECT stage, model, prompt_version, count(*) AS calls, count(*) - count(should_merge) AS failed, coalesce(sum(should_merge), 0)::BIGINT AS positive, round(sum(coalesce(confidence, 0)), 3) AS confidence, count(DISTINCT day) AS days FROM u GROUP BY GROUPING SETS ((stage, model, prompt_version), ())""")
def e_usage_report(spark: SparkSession, d: str) -> DataFrame:
    """Calls by stage, model and prompt version in the last 2,160 hours before the latest one, and their totals (nulls)."""
    r = table(spark, d, "deduplication_reviews").withColumn("at", times.instant(F.col("reviewed_at")))
    last = r.agg(F.max("at").alias("at")).first()["at"]
    u = r.filter(F.col("at") >= F.lit(last) - F.expr("INTERVAL 2160 HOURS")).select(F.lit("deduplication").alias("stage"), "model", "prompt_version", "should_merge", "confidence", F.substring("reviewed_at", 1, 10).alias("day"))
    sums = F.count(F.lit(1)).alias("calls"), F.sum(F.col("should_merge").isNull().cast("bigint")).alias("failed"), F.coalesce(F.sum(F.col("should_merge").cast("bigint")), F.lit(0)).alias("positive"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 3).alias("confidence"), F.countDistinct("day").alias("days")
    return u.groupingSets([["stage", "model", "prompt_version"], []], "stage", "model", "prompt_version").agg(*sums)


@query("SELECT stage, run_id, status, started_at, coalesce(TRY_CAST(json_extract_string(stats_json, '$.articles_seen') AS BIGINT), 0) AS seen FROM pipeline_runs QUALIFY row_number() OVER (PARTITION BY stage ORDER BY started_at DESC, run_id DESC) = 1")
def f_latest_per_stage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "pipeline_runs").withColumn("o", F.struct("started_at", "run_id"))
    out = mutations.latest_rows(r, "stage", "o")
    return out.select("stage", "run_id", "status", "started_at", F.coalesce(F.get_json_object("stats_json", "$.articles_seen").try_cast("bigint"), F.lit(0)).alias("seen"))


@query(f"""WITH {_FIRST}, g AS (SELECT f.source_id, f.article_id, f.ingest_seq, d.digest_impact.category AS impact FROM first f JOIN article_digests d USING (article_id) WHERE d.digest_impact.category IS NOT NULL)
SELECT source_id, article_id, impact, CAST(row_number() OVER (PARTITION BY source_id ORDER BY impact DESC, ingest_seq) AS INTEGER) AS place FROM g QUALIFY place <= 5""")
def f_top_per_source(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "article_digests").select("article_id", F.col("digest_impact.category").alias("impact")).filter("impact is not null")
    a = first_articles(spark, d, "source_id").join(g, "article_id")
    return grouping.top_per_group(a, "source_id", [F.desc("impact"), F.col("ingest_seq")], 5).select("source_id", "article_id", "impact", "place")


@query(f"""WITH {_FIRST}, r AS (SELECT event_id, article_id, ingest_seq, row_number() OVER (PARTITION BY event_id, split_part(source_name, ' - ', 1) ORDER BY ingest_seq DESC) > 1 AS again FROM first WHERE event_id IS NOT NULL)
SELECT event_id, article_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY again, ingest_seq DESC) AS INTEGER) AS place FROM r QUALIFY place <= 8""")
def f_publisher_diverse(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "event_id", "source_name").filter("event_id is not null").withColumn("publisher", text.publisher(F.col("source_name")))
    return grouping.diverse(a, "event_id", "publisher", [F.desc("ingest_seq")], 8).select("event_id", "article_id", "place")


@query(f"""WITH {_FIRST}, b AS (SELECT coalesce(nullif(split_part(source_id, '-', -1), ''), 'none') AS bucket, ingest_seq, article_id FROM first), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ingest_seq) AS i, count(*) OVER (PARTITION BY bucket) AS c FROM b)
SELECT article_id, CAST(ceil(i / 50.0) AS INTEGER) AS batch, CASE WHEN c > 50 THEN bucket || '-' || CAST(ceil(i / 50.0) AS INTEGER) ELSE bucket END AS batch_name FROM n""")
def m_batches(spark: SparkSession, d: str) -> DataFrame:
    a = first_articles(spark, d, "source_id").withColumn("bucket", F.coalesce(F.nullif(F.substring_index("source_id", "-", -1), F.lit("")), F.lit("none")))
    return grouping.batches(a, "bucket", "ingest_seq", 50).select("article_id", "batch", "batch_name")


@query(f"""WITH {_FIRST}, k AS (SELECT f.article_id, f.ingest_seq, coalesce('content:' || p.content_hash, 'url:' || p.canonical_url_hash) AS fp FROM first f LEFT JOIN article_fingerprints p USING (article_id)), c AS (SELECT fp, arg_min(article_id, ingest_seq) AS original FROM k WHERE fp IS NOT NULL GROUP BY 1)
SELECT article_id, coalesce(original, article_id) AS original, CASE WHEN coalesce(original, article_id) <> article_id THEN 1 ELSE 0 END AS reprint FROM k LEFT JOIN c USING (fp)""")
def m_reprints(spark: SparkSession, d: str) -> DataFrame:
    """The first article of every fingerprint stands for its reprints."""
    p = table(spark, d, "article_fingerprints").select("article_id", F.coalesce(F.concat(F.lit("content:"), "content_hash"), F.concat(F.lit("url:"), "canonical_url_hash")).alias("fp"))
    k = first_articles(spark, d).join(p, "article_id", "left")
    c = k.filter("fp is not null").groupBy("fp").agg(F.min_by("article_id", "ingest_seq").alias("original"))
    out = k.join(c, "fp", "left").select("article_id", F.coalesce("original", "article_id").alias("original"))
    return out.withColumn("reprint", (F.col("original") != F.col("article_id")).cast("int"))


@query("WITH r AS (SELECT user_id, substring(event_type, 1, 4) || (event_id % 97) AS item, max(epoch_us(ts) // 1000) AS read_ms FROM events GROUP BY 1, 2) SELECT user_id, item, read_ms FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY read_ms DESC, item) <= 20")
def j_read_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.concat(F.substring("event_type", 1, 4), F.col("event_id") % 97).alias("item"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return grouping.merge_reads(e, "user_id", "item", "ms", 20).select("user_id", "item", "read_ms")


@query(f"""WITH {_TITLES}, g AS (SELECT coalesce(f.default_category, 'none') AS category, a.event_id, count(*) AS n, min(a.fetched_at) AS created FROM first a JOIN feeds f USING (source_id) WHERE a.event_id IS NOT NULL GROUP BY ALL)
SELECT category, event_id, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, created, event_id) AS INTEGER) AS place FROM g QUALIFY place <= 6""")
def f_anchor_events(spark: SparkSession, d: str) -> DataFrame:
    """The six largest events of every category: by articles, then the older one, then the name."""
    f = table(spark, d, "feeds").select("source_id", F.coalesce("default_category", F.lit("none")).alias("category"))
    a = first_articles(spark, d, "event_id", "source_id", "fetched_at").filter("event_id is not null").join(f, "source_id")
    g = a.groupBy("category", "event_id").agg(F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("created"))
    return grouping.top_per_group(g, "category", [F.desc("n"), F.col("created"), F.col("event_id")], 6).select("category", "event_id", "n", "place")


@query(f"""WITH {_FIRST}, n AS (SELECT event_id, count(*) AS n, min(fetched_at) AS created FROM first WHERE event_id IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b FROM deduplication_reviews WHERE should_merge = 1 AND event_a <> event_b)
SELECT a, b, CASE WHEN x.n <> y.n THEN CASE WHEN x.n > y.n THEN a ELSE b END WHEN x.created <> y.created THEN CASE WHEN x.created < y.created THEN a ELSE b END WHEN length(a) <= length(b) THEN a ELSE b END AS winner FROM p JOIN n x ON x.event_id = a JOIN n y ON y.event_id = b""")
def f_merge_winner(spark: SparkSession, d: str) -> DataFrame:
    """Of two events to be merged the one that stays: more articles, then older, then the shorter name, then the first."""
    n = first_articles(spark, d, "event_id", "fetched_at").filter("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("created"))
    r = table(spark, d, "deduplication_reviews").filter("should_merge = 1 and event_a != event_b").select(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b")).distinct()
    x, y = (n.select(F.col("event_id").alias(k), F.struct((-F.col("n")).alias("n"), "created", F.length("event_id").alias("l"), F.col("event_id").alias("e")).alias(f"r{k}")) for k in ("a", "b"))
    return r.join(x, "a").join(y, "b").select("a", "b", F.least("ra", "rb")["e"].alias("winner"))


@query(f"""WITH {_FIRST} SELECT article_id, substring(content_text, 1, 200) AS excerpt, CASE WHEN f.fetched_at < '2025-01-01T00:00:00Z' AND f.is_filtered = 1 THEN NULL ELSE length(content_text) END AS kept_chars FROM article_texts t LEFT JOIN first f USING (article_id)""")
def j_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Texts of filtered articles older than the limit give way to an excerpt."""
    f = first_articles(spark, d, "fetched_at", "is_filtered").select("article_id", "fetched_at", "is_filtered")
    t = table(spark, d, "article_texts").select("article_id", "content_text").join(f, "article_id", "left")
    old = F.coalesce((F.col("fetched_at") < "2025-01-01T00:00:00Z") & (F.col("is_filtered") == 1), F.lit(False))
    return t.select("article_id", F.substring("content_text", 1, 200).alias("excerpt"), F.when(~old, F.length("content_text").cast("bigint")).alias("kept_chars"))


@query("""WITH p AS (SELECT DISTINCT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b FROM deduplication_reviews WHERE event_a <> event_b AND should_merge = 1), q AS (SELECT DISTINCT least(event_a, event_b) AS a, greatest(event_a, event_b) AS b FROM deduplication_reviews WHERE event_a <> event_b AND should_merge = 0)
SELECT 'both' AS kind, count(*) AS pairs FROM (SELECT * FROM p INTERSECT SELECT * FROM q) UNION ALL SELECT 'only_yes', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT 'only_no', count(*) FROM (SELECT * FROM q EXCEPT SELECT * FROM p) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM p UNION SELECT * FROM q)""")
def h_pair_sets(spark: SparkSession, d: str) -> DataFrame:
    """Set algebra over judged pairs in one aggregation of flags."""
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b and should_merge is not null")
    flags = r.groupBy(F.least("event_a", "event_b").alias("a"), F.greatest("event_a", "event_b").alias("b")).agg(F.max(F.col("should_merge") == 1).alias("yes"), F.max(F.col("should_merge") == 0).alias("no"))
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("yes") & F.col("no"), "both").when(F.col("yes"), "only_yes").otherwise("only_no")))
    counted = flags.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(k,) for k in ("both", "only_yes", "only_no", "all")], "kind string")
    return every.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("pairs"))


@query("""SELECT article_id AS key, 'no article' AS rule FROM article_texts WHERE article_id NOT IN (SELECT article_id FROM articles WHERE article_id IS NOT NULL)
UNION ALL SELECT article_id, 'no fingerprint' FROM (SELECT DISTINCT article_id FROM articles) WHERE article_id NOT IN (SELECT article_id FROM article_fingerprints WHERE content_hash IS NOT NULL)
UNION ALL SELECT run_id, 'not finished' FROM pipeline_runs WHERE finished_at IS NULL UNION ALL SELECT CAST(ingest_seq AS VARCHAR), 'unknown feed' FROM articles WHERE source_id NOT IN (SELECT source_id FROM feeds)
UNION ALL SELECT article_id, 'impact out of range' FROM article_digests WHERE digest_impact.global NOT BETWEEN 0 AND 1 UNION ALL SELECT article_id, 'empty summary' FROM article_digests WHERE digest_key_facts IS NOT NULL AND coalesce(trim(digest_summary), '') = ''""")
def k_violations(spark: SparkSession, d: str) -> DataFrame:
    """One row for every broken rule of the tables."""
    t = {n: table(spark, d, n) for n in ("articles", "article_texts", "article_fingerprints", "article_digests", "pipeline_runs", "feeds")}
    rule = lambda df, key, name: df.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("rule"))
    ids = t["articles"].select("article_id").distinct()
    out = rule(t["article_texts"].join(ids, "article_id", "left_anti"), "article_id", "no article")
    for more in (
        rule(ids.join(t["article_fingerprints"].filter("content_hash is not null"), "article_id", "left_anti"), "article_id", "no fingerprint"),
        rule(t["pipeline_runs"].filter("finished_at is null"), "run_id", "not finished"),
        rule(t["articles"].filter("source_id is not null").join(t["feeds"], "source_id", "left_anti"), "ingest_seq", "unknown feed"),
        rule(t["article_digests"].filter("digest_impact.global not between 0 and 1"), "article_id", "impact out of range"),
        rule(t["article_digests"].filter("digest_key_facts is not null and coalesce(trim(digest_summary), '') = ''"), "article_id", "empty summary"),
    ):
        out = out.unionByName(more)
    return out
