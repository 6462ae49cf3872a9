"""Register of named queries: the Spark callable, the DuckDB SQL it must equal, and what it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTER: dict[str, Query] = {}

#: The mapping of sources.catalog, in SQL.
VIEWS = {
    "records": """SELECT event_id AS id, user_id, (['luogu','leetcode','nowcoder','codeforces','atcoder'])[CAST(user_id % 5 + 1 AS INTEGER)] AS platform, event_id % 97 AS problem_id,
  ts AS submit_time, CAST(ts AS DATE) AS stat_date, CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'click' THEN 'WA' WHEN 'view' THEN 'TLE' WHEN 'error' THEN 'RE' WHEN 'signup' THEN 'CE' ELSE 'OTHER' END AS verdict,
  least(10.0::DOUBLE, 1 + value / 50) AS difficulty, CASE WHEN event_id % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN event_id % 6 <= 2 THEN list_distinct(['tag_' || (k % 20), 'tag_' || (k % 20 * 7 % 20), 'tag_' || (k % 20 * 3 % 20)]) WHEN event_id % 6 = 3 THEN list_distinct(['tag_' || (k % 20), 'tag_' || (k % 20 * 7 % 20)]) ELSE ['tag_' || (k % 20)] END AS tags, event_id % 3 = 0 AS first_ac, CAST(event_id % 4 AS INTEGER) AS retries FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "allproblems": """SELECT doc_id AS id, (['luogu','leetcode','nowcoder','codeforces','atcoder'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS source_platform, 'P' || doc_id AS source_id, left(text, 40) AS title,
  CAST(n_chars % 3500 AS DOUBLE) AS difficulty, CASE WHEN doc_id % 20 = doc_id * 7 % 20 THEN ['tag_' || (doc_id % 20)] ELSE ['tag_' || (doc_id % 20), 'tag_' || (doc_id * 7 % 20)] END AS tags,
  text AS content, lang, source, n_chars, to_timestamp(1704067200 + doc_id * 60) AT TIME ZONE 'UTC' AS created_at, CASE WHEN doc_id % 17 = 0 THEN to_timestamp(1704067200 + doc_id * 61) AT TIME ZONE 'UTC' END AS deleted_at FROM documents""",
    "problems": "SELECT * FROM allproblems WHERE deleted_at IS NULL",
    "users": """SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'observed' ELSE 'user' END AS role,
  CASE WHEN c_custkey % 4 <> 0 THEN 'nick' || c_custkey END AS nickname, c_mktsegment AS department, c_acctbal AS rating, c_custkey % 13 = 0 AS deleted, c_nationkey AS nation FROM customer""",
    "solutions": """SELECT l_orderkey AS problem_id, l_linenumber AS solution_index, l_partkey AS author, 'part ' || (l_partkey % 50) || ' ' || l_returnflag || ' ' || l_linestatus AS content, l_shipdate AS created_at, l_quantity AS votes FROM lineitem""",
    "ranked": "SELECT *, verdict = 'OK' AND sum(CASE WHEN verdict = 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, problem_id ORDER BY submit_time, id ROWS UNBOUNDED PRECEDING) = 1 AS is_first FROM records",
    "stats": """SELECT user_id, platform, stat_date, count(*) AS submit_count, count(*) FILTER (verdict = 'OK') AS ac_count, count(*) FILTER (verdict = 'WA') AS wa_count, count(*) FILTER (verdict = 'TLE') AS tle_count,
  count(*) FILTER (verdict NOT IN ('OK','WA','TLE')) AS other_count, count(*) FILTER (is_first) AS new_problems_solved, max(difficulty) AS hardest_difficulty, avg(difficulty) AS avg_difficulty FROM ranked GROUP BY user_id, platform, stat_date""",
}
_NEEDS = {"problems": ["allproblems"], "ranked": ["records"], "stats": ["records", "ranked"]}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names put before it."""
    import re

    used: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            used += [x for x in [*_NEEDS.get(name, []), name] if x not in used]
    if not used:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def query(name: str, covers: str, sql: str | None = None):
    def put(f):
        REGISTER[name] = Query(f, with_views(sql) if sql else None, covers)
        return f

    return put

