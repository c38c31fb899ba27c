"""The mapping of `devpulse.testmap` in SQL, as common table expressions."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "users": """
        SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name AS github_login,
               n_nationkey % 5 <> 0 AS has_token, n_nationkey AS n
        FROM nation""",
    "repositories": """
        SELECT c_custkey AS repo_id, CAST(c_nationkey AS BIGINT) AS user_id,
               c_custkey + 1000000000 AS github_repo_id,
               lower(c_mktsegment) || '/' || c_name AS full_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Python' WHEN 'BUILDING' THEN 'TypeScript'
                    WHEN 'FURNITURE' THEN 'Go' WHEN 'HOUSEHOLD' THEN 'COBOL' END AS primary_language,
               c_acctbal > 0 AS is_active,
               CASE WHEN c_custkey % 10 <> 0
                    THEN CAST(DATE '2001-01-01' + CAST(c_custkey % 200 AS INTEGER) AS TIMESTAMP) END AS last_synced_at,
               CAST(DATE '2001-01-01' + CAST(c_custkey * 37 % 200 AS INTEGER) AS TIMESTAMP) AS updated_at
        FROM customer""",
    "commits": """
        SELECT o_orderkey AS commit_id, o_custkey AS repo_id, md5(CAST(o_orderkey AS VARCHAR)) AS github_commit_sha,
               o_orderpriority AS message, o_orderdate AS committed_at,
               CAST(floor(o_totalprice) AS BIGINT) AS additions,
               CAST(floor(o_totalprice) AS BIGINT) % 97 AS deletions,
               coalesce(n_files, 0) AS changed_files
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_files FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "pull_requests": """
        SELECT o_orderkey AS pr_id, o_custkey AS repo_id, o_orderkey + 500000000 AS github_pr_id,
               o_orderkey % 1000 + 1 AS github_pr_number, o_orderpriority AS title,
               CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
               CAST(floor(o_totalprice) AS BIGINT) AS additions,
               CAST(floor(o_totalprice) AS BIGINT) % 97 AS deletions,
               o_orderdate AS pr_created_at,
               CASE WHEN o_orderstatus = 'F'
                    THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 10 AS INTEGER) AS TIMESTAMP) END AS merged_at
        FROM orders""",
    "ev": """
        SELECT *, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "event_commits": """
        SELECT event_id AS commit_id, user_id AS repo_id, 'c' || event_id AS message, ts AS committed_at,
               CAST(floor(value) AS BIGINT) AS additions, k AS deletions
        FROM ev WHERE event_type IN ('view', 'click')""",
    "event_prs": """
        SELECT event_id AS pr_id, user_id AS repo_id, 'pr ' || event_id AS title,
               CASE WHEN k % 2 = 0 THEN 'open' ELSE 'closed' END AS state,
               CAST(floor(value) AS BIGINT) AS additions, k AS deletions, ts AS pr_created_at,
               CASE WHEN k % 2 = 1 THEN CAST(CAST(ts AS DATE) + CAST(k % 3 AS INTEGER) AS TIMESTAMP) END AS merged_at
        FROM ev WHERE event_type = 'purchase'""",
    "analyses": """
        SELECT event_id AS analysis_id,
               CASE WHEN event_id % 30 = 0 THEN 'monthly_summary' WHEN event_id % 10 = 0 THEN 'weekly_summary'
                    ELSE 'commit' END AS source_type,
               CASE WHEN event_id % 10 = 0 THEN CAST(c_nationkey AS BIGINT) ELSE event_id END AS source_id,
               user_id AS repo_id, k,
               CASE WHEN k % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['t' || k % 7, 't' || k % 5] END AS tech_tags,
               event_type AS work_category, event_type || '-' || event_id AS summary,
               value / 100.0 AS complexity_score, ts AS analyzed_at
        FROM ev JOIN customer ON c_custkey = user_id""",
    "sync_jobs": """
        SELECT event_id AS job_id, k % 25 AS user_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS repo_id,
               CASE WHEN event_id % 4 = 0 THEN 'scheduled_sync' ELSE 'manual_sync' END AS job_type,
               CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'running'
                    WHEN 'signup' THEN 'pending' ELSE 'failed' END AS status,
               k AS items_fetched, ts AS created_at
        FROM ev""",
    "daily": """
        SELECT CAST(committed_at AS DATE) AS commit_date, repo_id, user_id, full_name, primary_language,
               count(commit_id) AS commit_count,
               CAST(coalesce(sum(additions), 0) AS BIGINT) AS total_additions,
               CAST(coalesce(sum(deletions), 0) AS BIGINT) AS total_deletions,
               CAST(coalesce(sum(changed_files), 0) AS BIGINT) AS total_changed_files
        FROM commits JOIN repositories USING (repo_id) GROUP BY ALL""",
    "event_daily": """
        SELECT CAST(committed_at AS DATE) AS commit_date, repo_id, user_id, count(*) AS commit_count
        FROM event_commits JOIN repositories USING (repo_id) GROUP BY ALL""",
    "weekly_tags": """
        SELECT CAST(date_trunc('week', analyzed_at) AS DATE) AS week_start, repo_id, user_id, tech_tag,
               count(*) AS tag_count
        FROM (SELECT analyzed_at, repo_id, unnest(tech_tags) AS tech_tag FROM analyses) JOIN repositories USING (repo_id)
        GROUP BY ALL""",
    "categories": """
        SELECT CAST(analyzed_at AS DATE) AS analysis_date, repo_id, user_id, work_category, count(*) AS category_count
        FROM analyses JOIN repositories USING (repo_id) GROUP BY ALL""",
    "hourly": """
        SELECT user_id, CAST(moment AS DATE) AS activity_date, CAST(isodow(CAST(moment AS DATE)) - 1 AS INTEGER) AS day_of_week,
               CAST(hour(moment) AS INTEGER) AS hour_of_day, CAST(sum(c) AS BIGINT) AS commit_count,
               CAST(sum(p) AS BIGINT) AS pr_count, CAST(sum(a) AS BIGINT) AS additions, CAST(sum(d) AS BIGINT) AS deletions
        FROM (SELECT repo_id, committed_at AS moment, 1 AS c, 0 AS p, additions AS a, deletions AS d FROM event_commits
              UNION ALL SELECT repo_id, pr_created_at, 0, 1, 0, 0 FROM event_prs) JOIN repositories USING (repo_id)
        GROUP BY ALL""",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    views = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed]
    own = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if own.startswith(head):
            return head + ",\n".join([*views, own[len(head):]])
    return ("WITH " + ",\n".join(views) + "\n" + own) if views else own


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def round1(x: str) -> str:
    """Nearest tenth of a double on its exact binary value, ties to even."""
    mag = f"abs({x})"
    frac = f"({mag} - floor({mag}))"
    q = f"floor({frac} * 10)"
    hi = f"(floor({frac} * 67108864) / 67108864)"
    side = f"(({hi} * 20 - ({q} * 2 + 1)) + ({frac} - {hi}) * 20)"
    tenths = f"(floor({mag}) * 10 + {q})"
    up = f"(CASE WHEN {side} > 0 OR ({side} = 0 AND {tenths} % 2 = 1) THEN 1 ELSE 0 END)"
    sign = f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END)"
    return f"(({tenths} + {up}) / CAST(10 AS DOUBLE) * {sign} + 0)"


def pct1(part: str, total: str) -> str:
    ratio = f"(CAST({part} AS DOUBLE) / NULLIF(CAST({total} AS DOUBLE), 0) * 100)"
    return f"coalesce({round1(ratio)}, CAST(0 AS DOUBLE))"


def pct_change1(current: str, previous: str) -> str:
    ratio = f"(CAST({current} - {previous} AS DOUBLE) / CASE WHEN {previous} > 0 THEN CAST({previous} AS DOUBLE) END * 100)"
    return round1(ratio)


def lookup(key: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"
