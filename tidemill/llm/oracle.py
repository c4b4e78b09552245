"""SQL for the queries that SQL can express, as DuckDB runs it."""

_LINES = r"""
lines AS (
  SELECT article_id, source_id, i AS line_no, regexp_replace(lower(string_split(content_text, chr(10))[i]), '[^\p{L}]+', '', 'g') AS k, string_split(content_text, chr(10))[i] AS line
  FROM article_texts, LATERAL (SELECT unnest(range(1, len(string_split(content_text, chr(10))) + 1)) AS i)
),
df AS (SELECT source_id, k, count(DISTINCT article_id) AS n FROM lines WHERE k <> '' GROUP BY ALL),
total AS (SELECT source_id, count(*) AS m FROM article_texts GROUP BY ALL),
hot AS (SELECT source_id, k FROM df JOIN total USING (source_id) WHERE n >= 3 AND n >= 0.02 * m)
"""
_GROUPS = """
edges AS (
  SELECT event_a AS u, event_b AS v FROM deduplication_reviews WHERE should_merge = 1 AND event_a <> event_b
  UNION SELECT event_b, event_a FROM deduplication_reviews WHERE should_merge = 1 AND event_a <> event_b
),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
found AS (SELECT u AS event_id, least(u, min(v)) AS group_id FROM reach GROUP BY u)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_LINES} SELECT article_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN hot USING (source_id, k)",
    "p1_cleaned": f"""WITH {_LINES}, kept AS (
  SELECT article_id, source_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE hot.k IS NULL) AS rest, CAST(count(hot.k) AS INTEGER) AS lines_removed
  FROM lines LEFT JOIN hot USING (source_id, k) GROUP BY ALL)
SELECT article_id, source_id, coalesce(rest, '') AS content_text, lines_removed FROM kept""",
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT event_id, group_id FROM found",
    "p4_groups": f"""WITH RECURSIVE {_GROUPS}, named AS (
  SELECT event_a AS event_id FROM deduplication_reviews UNION SELECT event_b FROM deduplication_reviews
  UNION SELECT event_id FROM articles UNION SELECT event_id FROM article_digests)
SELECT event_id, coalesce(group_id, event_id) AS group_id FROM named LEFT JOIN found USING (event_id) WHERE event_id IS NOT NULL""",
}
