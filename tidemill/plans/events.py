"""Queries over events: their keywords, pairs, pools, checks and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import cohesion, passages, text, times
from tidemill.operators import grouping, matching
from tidemill.plans import articles as base
from tidemill.session import table

query, first_articles = base.query, base.first_articles
_TOP = f"{base._KEYWORDS}, top AS (SELECT event_id, keyword, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, p, keyword) AS rank FROM cnt QUALIFY rank <= 12)"


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return base.QUERIES["e_keywords_top12"](spark, d)


# The share of a category's events from which a keyword tells nothing apart, with the least number of events that
# must have it and that there must be; the keywords of an event that are compared; those that two events must share.
HOT_SHARE, HOT_LEAST, HOT_EVENTS, KEYWORDS, OVERLAP = 0.2, 4, 8, 6, 2

_CATEGORY = f"""{_TOP}, cc AS (SELECT event_id, f.default_category AS category, count(*) AS n, min(ingest_seq) AS s FROM first a JOIN feeds f USING (source_id) WHERE event_id IS NOT NULL AND f.default_category IS NOT NULL GROUP BY ALL),
cat AS (SELECT event_id, category FROM cc QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, s) = 1),
evc AS (SELECT t.event_id, coalesce(category, 'none') AS category FROM (SELECT DISTINCT event_id FROM top) t LEFT JOIN cat USING (event_id)), m AS (SELECT category, count(*) AS m FROM evc GROUP BY 1),
hot AS (SELECT category, keyword, count(*) AS events FROM top JOIN evc USING (event_id) JOIN m USING (category) GROUP BY category, keyword, m HAVING m >= {HOT_EVENTS} AND count(*) >= greatest({HOT_LEAST}, floor(CAST({HOT_SHARE} AS DOUBLE) * m))),
six AS (SELECT event_id, category, keyword, rank FROM top JOIN evc USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.category = evc.category AND h.keyword = top.keyword) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY rank) <= {KEYWORDS})"""


def categorised_keywords(spark: SparkSession, d: str) -> DataFrame:
    """event_id, category (that of most of its articles), keyword, rank."""
    top = top_keywords(spark, d).select("event_id", "keyword", "rank")
    own = base.QUERIES["e_majority_category"](spark, d).select("event_id", "category")
    return top.join(own, "event_id", "left").withColumn("category", F.coalesce("category", F.lit("none")))


def hot_keywords(top: DataFrame) -> DataFrame:
    """category, keyword, events: keywords that so many events of a category share that they tell nothing apart."""
    n = top.groupBy("category").agg(F.countDistinct("event_id").alias("m"))
    shared = top.groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("events")).join(n, "category")
    return shared.filter((F.col("m") >= HOT_EVENTS) & (F.col("events") >= F.greatest(F.lit(HOT_LEAST), F.floor(HOT_SHARE * F.col("m"))))).select("category", "keyword", "events")


def filtered_keywords(spark: SparkSession, d: str) -> DataFrame:
    """event_id, category, keyword, rank of an event's first keywords that aren't hot in its category."""
    top = categorised_keywords(spark, d)
    kept = top.join(hot_keywords(top).select("category", "keyword"), ["category", "keyword"], "left_anti")
    return grouping.top_per_group(kept, "event_id", [F.col("rank")], KEYWORDS, "place").select("event_id", "category", "keyword", "rank")


@query(f"WITH {_CATEGORY} SELECT category, keyword, events FROM hot")
def e_dynamic_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return hot_keywords(categorised_keywords(spark, d))


@query(f"WITH {_CATEGORY} SELECT event_id, list(keyword ORDER BY rank) AS keywords FROM six GROUP BY event_id")
def e_filtered_keywords(spark: SparkSession, d: str) -> DataFrame:
    kept = filtered_keywords(spark, d).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    return kept.select("event_id", F.col("k.keyword").alias("keywords"))


@query(f"WITH {_CATEGORY} SELECT x.event_id AS a, y.event_id AS b, CAST(count(*) AS INTEGER) AS shared FROM six x JOIN six y ON x.keyword = y.keyword AND x.category = y.category AND x.event_id < y.event_id GROUP BY ALL HAVING count(*) >= {OVERLAP}")
def d_keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Events of a category that share two of their six keywords; a keyword that is hot there is none of them, so no group is large."""
    k = filtered_keywords(spark, d).groupBy("event_id").agg(F.collect_set(F.concat_ws(" ", "category", "keyword")).alias("k"))
    return matching.token_pairs(k, "event_id", "k", OVERLAP).select("a", "b", "shared")


_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_COHESION = f"""{base._TITLES}, raw AS (SELECT event_id, unnest(regexp_extract_all(regexp_replace(title, '(?i)^\\s*(?:(?:{cohesion.LABELS.replace(chr(92), chr(92) * 2)})\\s*(?::|--|-|\\.)?\\s*)+', ''), '[A-Za-z0-9]+')) AS r FROM ev),
word AS (SELECT event_id, lower(r) AS w, bool_or(regexp_matches(r, '^[A-Z]|[0-9]') AND lower(r) NOT IN ({_LIST(cohesion.GENERIC)})) AS anchor FROM raw
  WHERE lower(r) NOT IN ({_LIST(text.STOPWORDS)}, {_LIST(cohesion.FORMAT_WORDS)}) AND (length(r) >= 3 OR (length(r) >= 2 AND regexp_matches(r, '^[A-Z]+$|[0-9]'))) GROUP BY ALL),
pair AS (SELECT x.event_id AS a, y.event_id AS b, count(*) AS n, count(*) FILTER (WHERE x.w NOT IN ({_LIST(cohesion.GENERIC)})) AS special, count(*) FILTER (WHERE x.anchor AND y.anchor) AS anchors FROM word x JOIN word y ON x.w = y.w AND x.event_id < y.event_id GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {_COHESION}, s AS (SELECT a, b, CASE WHEN special = 0 THEN 0 WHEN n >= 3 THEN 2 WHEN anchors >= 2 OR (anchors = 1 AND special = 2) THEN 1 ELSE 0 END AS strength FROM pair) SELECT a, b, strength FROM s WHERE strength > 0".replace("\\\\", "\\"))
def d_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Event pairs whose titles hold together, with the strength; they meet by the words of their titles and don't move as pairs."""
    w = base.event_titles(spark, d).select("event_id", cohesion.words(F.col("title")).alias("w"))
    only = lambda f: F.array_distinct(F.transform(F.filter("w", f), lambda x: x["w"]))
    t = w.select("event_id", F.array_distinct(F.col("w.w")).alias("t"), only(lambda x: x["anchor"]).alias("anchors"), only(lambda x: x["w"].isin(*cohesion.GENERIC)).alias("generic"))
    sets = matching.numbered(t, "event_id", "t", "anchors", "generic")
    # Two words hold nothing together unless an anchor of both is among them.
    may = matching.enough_bits(3) | (matching.common_bits("anchors") > 0)
    met = matching.meet(sets, sets, 2, may & (F.col("l_k") < F.col("r_k")))
    both = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y))).otherwise(0)
    n = F.size("shared")
    strength = cohesion.strength_of(n, n - both("shared", "l_generic"), both("l_anchors", "r_anchors"))
    return met.select(F.col("l_k").alias("a"), F.col("r_k").alias("b"), F.explode(F.array(strength)).alias("strength")).filter("strength > 0")


@query(f"""WITH {base._FIRST}, p AS (SELECT coalesce(f.default_category, 'none') AS category, a.event_id, split_part(a.source_name, ' - ', 1) AS publisher FROM first a JOIN feeds f USING (source_id) WHERE event_id IS NOT NULL),
pool AS (SELECT category, count(DISTINCT publisher) AS pool FROM p GROUP BY 1), e AS (SELECT category, event_id, count(DISTINCT publisher) AS n FROM p GROUP BY ALL)
SELECT event_id, category, n AS publishers, pool, round(least(1.0, n::DOUBLE / pool), 4) AS ratio FROM e JOIN pool USING (category)""")
def e_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Which share of a category's publishers carry an event."""
    f = table(spark, d, "feeds").select("source_id", F.coalesce("default_category", F.lit("none")).alias("category"))
    p = first_articles(spark, d, "event_id", "source_id", "source_name").filter("event_id is not null").join(f, "source_id").select("category", "event_id", text.publisher(F.col("source_name")).alias("publisher"))
    pool = p.groupBy("category").agg(F.countDistinct("publisher").alias("pool"))
    e = p.groupBy("category", "event_id").agg(F.countDistinct("publisher").alias("publishers"))
    return e.join(pool, "category").select("event_id", "category", "publishers", "pool", F.round(F.least(F.lit(1.0), F.col("publishers") / F.col("pool")), 4).alias("ratio"))


@query("""WITH a AS (SELECT event_id, count(*) AS n FROM (SELECT event_a AS event_id FROM deduplication_reviews WHERE event_a <> event_b UNION ALL SELECT event_b FROM deduplication_reviews WHERE event_a <> event_b) GROUP BY 1), b AS (SELECT DISTINCT event_id FROM article_digests WHERE event_id IS NOT NULL)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'missing' WHEN b.event_id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem FROM a FULL JOIN b USING (event_id) WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.n > 1""")
def h_cover_check(spark: SparkSession, d: str) -> DataFrame:
    """Events that the reviews don't cover exactly once, and reviewed ones that no article carries."""
    r = table(spark, d, "deduplication_reviews").filter("event_a != event_b")
    a = r.select(F.explode(F.array("event_a", "event_b")).alias("event_id")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "article_digests").filter("event_id is not null").select("event_id", F.lit(1).alias("known")).distinct()
    return a.join(b, "event_id", "full_outer").filter("n is null or known is null or n > 1").select("event_id", F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").otherwise("repeated").alias("problem"))


@query("""WITH e AS (SELECT DISTINCT event_id FROM article_digests WHERE event_id IS NOT NULL), h AS (SELECT event_id, sha256(event_id) AS s FROM e), d AS (SELECT event_id, substring(s, 1, k) AS prefix, k FROM h, range(0, 9) t(k)), c AS (SELECT prefix, k FROM d GROUP BY ALL HAVING count(*) <= 34)
SELECT event_id, arg_min(d.prefix, d.k) AS chunk FROM d JOIN c ON d.prefix = c.prefix AND d.k = c.k GROUP BY event_id""")
def m_hash_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Events in chunks of at most 34, by the shortest prefix of their hash under which no more lie; stable as events come and go."""
    e = table(spark, d, "article_digests").filter("event_id is not null").select("event_id").distinct().withColumn("s", F.sha2("event_id", 256))
    p = e.select("event_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct(k.alias("k"), F.expr("s").substr(F.lit(1), k).alias("prefix")))).alias("x")).select("event_id", "x.k", "x.prefix")
    small = p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n <= 34").select("prefix")
    return p.join(small, "prefix").groupBy("event_id").agg(F.min_by("prefix", "k").alias("chunk"))


@query("""WITH g AS (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, article_id FROM article_digests WHERE event_id IS NOT NULL) GROUP BY 1), a AS (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, article_id FROM articles WHERE event_id IS NOT NULL) GROUP BY 1),
s AS (SELECT event_id, count(*) AS n FROM (SELECT event_id, article_id FROM article_digests WHERE event_id IS NOT NULL INTERSECT SELECT event_id, article_id FROM articles WHERE event_id IS NOT NULL) GROUP BY 1)
SELECT event_id, CASE WHEN g.n = a.n AND a.n = s.n THEN 1 ELSE 0 END AS unchanged FROM g FULL JOIN a USING (event_id) LEFT JOIN s USING (event_id)""")
def m_unchanged_members(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event has the same members in both tables; sets are compared by their counts, not collected."""
    pair = lambda t, flag: table(spark, d, t).filter("event_id is not null").select("event_id", "article_id").distinct().withColumn(flag, F.lit(1))
    both = pair("article_digests", "g").join(pair("articles", "a"), ["event_id", "article_id"], "full_outer")
    return both.groupBy("event_id").agg(F.min(F.when(F.col("g").isNotNull() & F.col("a").isNotNull(), 1).otherwise(0)).alias("unchanged"))


@query(f"""WITH {base._FIRST} SELECT f.article_id, f.event_id, f.fetched_at, CASE WHEN d.digest_summary IS NULL THEN 1 ELSE 0 END AS context_only FROM first f LEFT JOIN article_digests d USING (article_id) WHERE f.fetched_at > '2024-06-01T00:00:00Z' AND f.fetched_at <= '2024-06-15T00:00:00Z' AND f.is_filtered = 0""")
def d_brief_window(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a half-open interval, its start left out and its end taken in."""
    at = times.instant(F.col("fetched_at"))
    a = first_articles(spark, d, "event_id", "fetched_at", "is_filtered").filter((at > F.lit("2024-06-01 00:00:00").cast("timestamp")) & (at <= F.lit("2024-06-15 00:00:00").cast("timestamp")) & (F.col("is_filtered") == 0))
    g = table(spark, d, "article_digests").select("article_id", "digest_summary")
    return a.join(g, "article_id", "left").select("article_id", "event_id", "fetched_at", F.col("digest_summary").isNull().cast("int").alias("context_only"))


@query("""SELECT r.run_id, r.status, coalesce(TRY_CAST(json_extract_string(stats_json, '$.articles_seen') AS BIGINT), 0) AS seen, count(a.ingest_seq) AS rows_delivered, sum(CASE WHEN a.digest_status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed FROM pipeline_runs r LEFT JOIN articles a ON a.collection_run_id = r.run_id GROUP BY ALL""")
def e_run_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """What a run reports against what it delivered; articles are added up before they meet the runs."""
    a = table(spark, d, "articles").groupBy(F.col("collection_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("digest_status") == "failed").cast("bigint")).alias("f"))
    r = table(spark, d, "pipeline_runs").join(a, "run_id", "left")
    return r.select("run_id", "status", F.coalesce(F.get_json_object("stats_json", "$.articles_seen").try_cast("bigint"), F.lit(0)).alias("seen"), F.coalesce("n", F.lit(0)).alias("rows_delivered"), F.coalesce("f", F.lit(0)).alias("failed"))


@query(f"""WITH {base._FIRST}, o AS (SELECT event_id, article_id, ingest_seq, lag(ingest_seq) OVER (PARTITION BY event_id ORDER BY ingest_seq) AS prev FROM first WHERE event_id IS NOT NULL) SELECT event_id, count(*) AS members, max(ingest_seq - prev) AS widest_gap FROM o GROUP BY 1""")
def e_member_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The widest gap in arrival between members of an event that follow each other."""
    from pyspark.sql import Window

    a = first_articles(spark, d, "event_id").filter("event_id is not null")
    o = a.withColumn("prev", F.lag("ingest_seq").over(Window.partitionBy("event_id").orderBy("ingest_seq")))
    return o.groupBy("event_id").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("ingest_seq") - F.col("prev")).alias("widest_gap"))


@query("""WITH c AS (SELECT c_nationkey, o_orderpriority, sum(o_totalprice) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT n_name, o_orderpriority, round(total, 2) AS total, orders, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY total DESC, n_name) AS INTEGER) AS place FROM c JOIN nation ON c_nationkey = n_nationkey QUALIFY place <= 3""")
def f_star_top_nations(spark: SparkSession, d: str) -> DataFrame:
    """A star join with a ranking: the customers' side is small and the orders are added up before the nation's name joins."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy("c_nationkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("t"), F.count(F.lit(1)).alias("orders")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return grouping.top_per_group(c, "o_orderpriority", [F.desc("t"), F.col("n_name")], 3).select("n_name", "o_orderpriority", F.round("t", 2).alias("total"), "orders", "place")


@query()
def i_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of every article's text that can be quoted as evidence."""
    return passages.explode_passages(table(spark, d, "article_texts").select("article_id", "content_text"), "article_id", "content_text")
