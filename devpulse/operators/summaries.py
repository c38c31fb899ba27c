"""Weekly and monthly summaries for every (user, period).

Facts are grouped per (repository, period) first and meet the repository table
as rollup rows.  Lists inside a row are bounded (by default 10 tags, 3 summaries, 5
categories); the same lists without a bound are long relations instead of arrays
(`weekly_technologies`, `weekly_achievements`, `month_categories`,
`monthly_active_repos`, evidence without a limit), which no task sorts as a whole.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.functions.timeops import (
    closed_period_filter,
    first_of_month,
    period_filter,
    spine,
    week_of,
    week_starts,
)
from devpulse.operators.filters import active
from devpulse.operators.ranking import top_k
from devpulse.schemas import GENERATED_SUMMARY, MONTH_NARRATIVE, WEEK_HIGHLIGHT


def _count() -> Column:
    return F.count(F.lit(1))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long")


def _commit_analyses(analyses: DataFrame) -> DataFrame:
    return analyses.filter(F.col("source_type") == "commit")


def _by_user(per_repo: DataFrame, repos: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Re-aggregate per-repository rows to their user."""
    return per_repo.join(repos.select("repo_id", "user_id"), "repo_id").groupBy("user_id", *keys).agg(*aggs)


def _label_counts(labels: DataFrame, repos: DataFrame, period: str, label: str) -> DataFrame:
    per_repo = labels.groupBy("repo_id", period, label).agg(_count().alias("n"))
    return _by_user(per_repo, repos, [period, label], F.sum("n").alias("n"))


def _top_labels(counts: DataFrame, period: str, label: str, k: int, name: str) -> DataFrame:
    """The k most frequent labels per (user, period) as an ordered array."""
    kept = top_k(counts, ["user_id", period], [F.desc("n"), F.asc(label)], k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", label)))
    return kept.groupBy("user_id", period).agg(F.transform(ordered, lambda e: e[label]).alias(name))


def _period_metrics(
    commits: DataFrame, merged_or_created: DataFrame | None, analyses: DataFrame, repos: DataFrame, period: str
) -> DataFrame:
    """Commit count, pull-request count and newest analysis in one aggregation.

    Inputs carry ``(repo_id, period)``, analyses also ``analyzed_at``.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    no_time = F.lit(None).cast("timestamp")
    facts = commits.select(
        "repo_id", period, one.alias("commits"), none.alias("prs"), no_time.alias("analyzed_at")
    ).unionByName(
        analyses.select("repo_id", period, none.alias("commits"), none.alias("prs"), "analyzed_at")
    )
    if merged_or_created is not None:
        facts = facts.unionByName(
            merged_or_created.select(
                "repo_id", period, none.alias("commits"), one.alias("prs"), no_time.alias("analyzed_at")
            )
        )
    aggs = [
        F.sum("commits").alias("commits"),
        F.sum("prs").alias("prs"),
        F.max("analyzed_at").alias("analyzed_at"),
    ]
    return _by_user(facts.groupBy("repo_id", period).agg(*aggs), repos, [period], *aggs)


def weekly_summary(
    users: DataFrame,
    commits: DataFrame,
    pull_requests: DataFrame,
    analyses: DataFrame,
    repos: DataFrame,
    week_start: date,
    count: int = 1,
    tags_kept: int = 10,
    achievements_kept: int = 3,
) -> DataFrame:
    """Computed summaries of ``count`` weeks ending with ``week_start``'s.

    Weeks start on the weekday given; pull requests count when merged; tags and
    achievements come from commit analyses, ``generated_at`` from all analyses.
    ``tags_kept`` and ``achievements_kept`` bound the two lists.
    """
    first, end = week_start - timedelta(weeks=count - 1), week_start + timedelta(days=7)

    def in_weeks(df: DataFrame, ts: str, stored_by: bool = True) -> DataFrame:
        kept = period_filter(df, ts, first, end, partitioned_by=stored_by)
        return kept.withColumn("week_start", week_of(ts, week_start, count))

    analyzed = in_weeks(analyses, "analyzed_at")
    metrics = _period_metrics(
        in_weeks(commits, "committed_at"),
        in_weeks(pull_requests, "merged_at", stored_by=False),
        analyzed,
        repos,
        "week_start",
    )
    from_commits = _commit_analyses(analyzed)
    technologies = _top_labels(_tag_counts(from_commits, repos), "week_start", "tag", tags_kept, "technologies_used")
    return (
        spine(users, week_starts(week_start, count), "week_start")
        .join(metrics, ["user_id", "week_start"], "left")
        .join(technologies, ["user_id", "week_start"], "left")
        .join(_latest_summaries(from_commits, repos, achievements_kept), ["user_id", "week_start"], "left")
        .select(
            "user_id",
            "week_start",
            F.date_add("week_start", 6).alias("week_end"),
            _zero("commits").alias("total_commits"),
            _zero("prs").alias("total_prs_merged"),
            _week_highlight(_zero("commits"), _zero("prs")).alias("highlight"),
            F.coalesce("key_achievements", F.array().cast("array<string>")).alias("key_achievements"),
            F.coalesce("technologies_used", F.array().cast("array<string>")).alias("technologies_used"),
            F.col("analyzed_at").alias("generated_at"),
        )
    )


def _tag_counts(from_commits: DataFrame, repos: DataFrame) -> DataFrame:
    labels = from_commits.select("repo_id", "week_start", F.explode("tech_tags").alias("tag"))
    return _label_counts(labels, repos, "week_start", "tag")


def _analyses_of_weeks(analyses: DataFrame, week_start: date, count: int) -> DataFrame:
    first, end = week_start - timedelta(weeks=count - 1), week_start + timedelta(days=7)
    kept = period_filter(_commit_analyses(analyses), "analyzed_at", first, end)
    return kept.withColumn("week_start", week_of("analyzed_at", week_start, count))


def weekly_technologies(analyses: DataFrame, repos: DataFrame, week_start: date, count: int = 1) -> DataFrame:
    """All tags of each (user, week) with their counts, one row each."""
    return _tag_counts(_analyses_of_weeks(analyses, week_start, count), repos).withColumnRenamed("n", "tag_count")


def weekly_achievements(analyses: DataFrame, repos: DataFrame, week_start: date, count: int = 1) -> DataFrame:
    """All summaries of each (user, week), one row each; newest first by ``analyzed_at, analysis_id``."""
    rows = _analyses_of_weeks(analyses, week_start, count).select("repo_id", "week_start", "analyzed_at", "analysis_id", "summary")
    return rows.join(repos.select("repo_id", "user_id"), "repo_id").select("user_id", "week_start", "analyzed_at", "analysis_id", "summary")


def _latest_summaries(from_commits: DataFrame, repos: DataFrame, k: int) -> DataFrame:
    """The k newest analysis summaries per (user, week)."""
    newest = [F.desc("analyzed_at"), F.asc("analysis_id")]
    rows = from_commits.select("repo_id", "week_start", "analyzed_at", "analysis_id", "summary")
    # k per repository are enough to find k per user, and keep the join small
    per_repo = top_k(rows, ["repo_id", "week_start"], newest, k).drop("rank")
    kept = top_k(per_repo.join(repos.select("repo_id", "user_id"), "repo_id"), ["user_id", "week_start"], newest, k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "summary")))
    return kept.groupBy("user_id", "week_start").agg(
        F.transform(ordered, lambda e: e["summary"]).alias("key_achievements")
    )


def _week_highlight(commits: Column, prs: Column) -> Column:
    busy, quiet = WEEK_HIGHLIGHT
    return F.when(commits > 0, F.format_string(busy, commits, prs)).otherwise(F.lit(quiet))


def _in_months(df: DataFrame, ts: str, month: date, count: int) -> DataFrame:
    kept = period_filter(df, ts, first_of_month(month, count - 1), first_of_month(month, -1))
    return kept.withColumn("month_start", F.trunc(F.to_date(ts), "month"))


def _months(month: date, count: int) -> list[date]:
    return [first_of_month(month, i) for i in range(count)]


def monthly_active_repos(commits: DataFrame, repos: DataFrame, month: date, count: int = 1) -> DataFrame:
    """Names of the repositories with commits, per (user, month).

    One row per repository; order by ``commit_count`` descending to list them.
    """
    per_repo = _in_months(commits, "committed_at", month, count).groupBy("repo_id", "month_start").agg(
        _count().alias("n")
    )
    return (
        per_repo.join(repos.select("repo_id", "user_id", "full_name"), "repo_id")
        .groupBy("user_id", "month_start", "full_name")
        .agg(F.sum("n").alias("commit_count"))
    )


def monthly_summary(
    users: DataFrame,
    commits: DataFrame,
    analyses: DataFrame,
    repos: DataFrame,
    month: date,
    count: int = 1,
    areas_kept: int = 5,
) -> DataFrame:
    """Computed summaries of ``count`` months ending with ``month``'s.

    ``areas_kept`` bounds the list of growth areas.
    """
    named = monthly_active_repos(commits, repos, month, count)
    activity = named.groupBy("user_id", "month_start").agg(
        F.sum("commit_count").alias("commits"), _count().alias("repos")
    )
    analyzed = _in_months(analyses, "analyzed_at", month, count)
    latest = _by_user(
        analyzed.groupBy("repo_id", "month_start").agg(F.max("analyzed_at").alias("analyzed_at")),
        repos,
        ["month_start"],
        F.max("analyzed_at").alias("analyzed_at"),
    )
    growth = _top_labels(
        _label_counts(_commit_analyses(analyzed), repos, "month_start", "work_category"),
        "month_start",
        "work_category",
        areas_kept,
        "growth_areas",
    )
    year, month_no = F.year("month_start"), F.month("month_start")
    busy, quiet = MONTH_NARRATIVE
    return (
        spine(users, _months(month, count), "month_start")
        .join(activity, ["user_id", "month_start"], "left")
        .join(latest, ["user_id", "month_start"], "left")
        .join(growth, ["user_id", "month_start"], "left")
        .select(
            "user_id",
            year.alias("year"),
            month_no.alias("month"),
            _zero("commits").alias("total_commits"),
            _zero("repos").alias("active_repo_count"),
            F.when(_zero("commits") > 0, F.format_string(busy, year, month_no, _zero("commits"), _zero("repos")))
            .otherwise(F.format_string(quiet, year, month_no))
            .alias("narrative"),
            F.coalesce("growth_areas", F.array().cast("array<string>")).alias("growth_areas"),
            F.col("analyzed_at").alias("generated_at"),
        )
    )


def month_stats(
    users: DataFrame,
    commits: DataFrame,
    pull_requests: DataFrame,
    analyses: DataFrame,
    repos: DataFrame,
    month: date,
    count: int = 1,
    with_breakdown: bool = False,
) -> DataFrame:
    """Month figures over active repositories.

    ``with_breakdown`` adds the published category -> count map.  Its size is that
    of the label vocabulary; where labels are free text, take the rows of
    `month_categories` instead.
    """
    tracked = active(repos)
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    names = ["commits", "prs", "additions", "deletions", "analyses"]

    def fact(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("repo_id", "month_start", *[given.get(n, zero).cast("long").alias(n) for n in names])

    analyzed = _commit_analyses(_in_months(analyses, "analyzed_at", month, count))
    facts = (
        fact(
            _in_months(commits, "committed_at", month, count),
            commits=one,
            additions=F.col("additions"),
            deletions=F.col("deletions"),
        )
        .unionByName(fact(_in_months(pull_requests, "pr_created_at", month, count), prs=one))
        .unionByName(fact(analyzed, analyses=one))
    )
    sums = [F.sum(n).alias(n) for n in names]
    totals = _by_user(facts.groupBy("repo_id", "month_start").agg(*sums), tracked, ["month_start"], *sums)
    out = spine(users, _months(month, count), "month_start").join(totals, ["user_id", "month_start"], "left")
    figures = [F.year("month_start").alias("year"), F.month("month_start").alias("month"), *[_zero(n).alias(f"total_{n}") for n in names]]
    if not with_breakdown:
        return out.select("user_id", *figures)
    pairs = F.array_sort(F.collect_list(F.struct("work_category", "n")))
    categories = (
        _label_counts(analyzed, tracked, "month_start", "work_category")
        .groupBy("user_id", "month_start")
        .agg(F.map_from_entries(pairs).alias("category_breakdown"))
    )
    none = F.create_map().cast("map<string,bigint>")
    whole = out.join(categories, ["user_id", "month_start"], "left")
    return whole.select("user_id", *figures, F.coalesce("category_breakdown", none).alias("category_breakdown"))


def month_categories(analyses: DataFrame, repos: DataFrame, month: date, count: int = 1) -> DataFrame:
    """Analyses per (user, month, category) over active repositories, one row each."""
    analyzed = _commit_analyses(_in_months(analyses, "analyzed_at", month, count))
    counts = _label_counts(analyzed, active(repos), "month_start", "work_category")
    return counts.select("user_id", "month_start", "work_category", F.col("n").alias("analyses"))


# --- Evidence for generated summaries (C9, C11) ------------------------------


def _newest_per_week(
    facts: DataFrame, ts: str, tie: str, repos: DataFrame, week_start: date, count: int, limit: int | None, columns: list[str]
) -> DataFrame:
    last_day = week_start + timedelta(days=6)
    kept = closed_period_filter(facts, ts, week_start - timedelta(weeks=count - 1), last_day)
    rows = kept.select("repo_id", *dict.fromkeys([ts, tie, *columns])).withColumn("week_start", week_of(ts, week_start, count))
    newest = [F.desc(ts), F.asc(tie)]
    # so many per repository are enough to find so many per user, and keep the join small
    if limit is not None:
        rows = top_k(rows, ["repo_id", "week_start"], newest, limit).drop("rank")
    rows = rows.join(active(repos).select("repo_id", "user_id", F.col("full_name").alias("repo_name")), "repo_id")
    if limit is None:
        return rows.withColumn("rank", F.lit(None).cast("int"))
    return top_k(rows, ["user_id", "week_start"], newest, limit)


def evidence_commits(
    commits: DataFrame, repos: DataFrame, week_start: date, count: int = 1, limit: int | None = 100
) -> DataFrame:
    """The newest commits of each (user, week), active repositories only.

    Without a limit all of them, and without a rank: to number a busy week, one task
    would have to sort it.  This holds for the other kinds of evidence as well.
    """
    columns = ["message", "additions", "deletions", "committed_at"]
    rows = _newest_per_week(commits, "committed_at", "commit_id", repos, week_start, count, limit, columns)
    return rows.select(
        "user_id",
        "week_start",
        "rank",
        F.coalesce("message", F.lit("")).alias("message"),
        "repo_name",
        "additions",
        "deletions",
        "committed_at",
    )


def evidence_pull_requests(
    pull_requests: DataFrame, repos: DataFrame, week_start: date, count: int = 1, limit: int | None = 50
) -> DataFrame:
    """The newest pull requests by creation."""
    columns = ["title", "state", "additions", "deletions"]
    rows = _newest_per_week(pull_requests, "pr_created_at", "pr_id", repos, week_start, count, limit, columns)
    return rows.select(
        "user_id",
        "week_start",
        "rank",
        F.coalesce("title", F.lit("")).alias("title"),
        "repo_name",
        "state",
        "additions",
        "deletions",
    )


def evidence_analyses(
    analyses: DataFrame, repos: DataFrame, week_start: date, count: int = 1, limit: int | None = 100
) -> DataFrame:
    """The newest commit analyses."""
    columns = ["summary", "work_category", "tech_tags", "complexity_score"]
    rows = _newest_per_week(
        _commit_analyses(analyses), "analyzed_at", "analysis_id", repos, week_start, count, limit, columns
    )
    return rows.select(
        "user_id",
        "week_start",
        "rank",
        "summary",
        "work_category",
        "tech_tags",
        F.col("complexity_score").cast("double").alias("complexity_score"),
    )


def weekly_summaries_of_month(analyses: DataFrame, repos: DataFrame, month: date, count: int = 1) -> DataFrame:
    """C11: generated weekly summaries *analyzed* in the month; order by analyzed_at."""
    weekly = _in_months(analyses, "analyzed_at", month, count).filter(
        (F.col("source_type") == "weekly_summary") & F.col("raw_response").isNotNull()
    )
    return weekly.join(active(repos).select("repo_id", "user_id"), "repo_id").select(
        "user_id", "month_start", "analyzed_at", "analysis_id", "raw_response"
    )


# --- Stored summaries (W4, C10) ----------------------------------------------


def _generated(analyses: DataFrame, repos: DataFrame, source_type: str, keep: int | None) -> DataFrame:
    """The generated summaries, parsed; with ``keep`` only so many newest per user."""
    stored = analyses.filter(F.col("source_type") == source_type).select(
        F.col("source_id").alias("user_id"), "repo_id", "analyzed_at", "analysis_id", "summary", "raw_response"
    )
    owned = stored.join(active(repos).select("repo_id", "user_id"), ["repo_id", "user_id"], "left_semi")
    newest = owned
    if keep is not None:
        newest = top_k(owned, ["user_id"], [F.desc("analyzed_at"), F.asc("analysis_id")], keep)
    return newest.withColumn("raw", F.from_json("raw_response", GENERATED_SUMMARY))


def _first_match(generated: DataFrame, keys: list[str]) -> DataFrame:
    """Of several summaries of one period the newest one counts."""
    fields = F.struct("analyzed_at", "summary", "raw")
    newest = F.struct((-F.unix_micros("analyzed_at")).alias("age"), "analysis_id")
    return generated.groupBy("user_id", *keys).agg(F.min_by(fields, newest).alias("gen"))


def _or_default(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def resolve_weekly(computed: DataFrame, analyses: DataFrame, repos: DataFrame, keep: int | None = None) -> DataFrame:
    """The stored summary of a week where there is one, else the computed.

    ``keep`` looks only at so many newest stored summaries of each user.
    """
    generated = _generated(analyses, repos, "weekly_summary", keep).withColumn(
        "week_start", F.try_to_date(F.col("raw.week_start"), "yyyy-MM-dd")
    )
    empty = F.array().cast("array<string>")

    def pick(name: str, value: Column) -> Column:
        return F.when(F.col("gen").isNotNull(), value).otherwise(F.col(name)).alias(name)

    raw = F.col("gen.raw")
    joined = computed.join(_first_match(generated, ["week_start"]), ["user_id", "week_start"], "left")
    return joined.select(
        "user_id",
        "week_start",
        "week_end",
        pick("total_commits", _or_default(raw["commits_count"], F.lit(0))),
        pick("total_prs_merged", _or_default(raw["prs_count"], F.lit(0))),
        pick("highlight", _or_default(raw["highlight"], F.col("gen.summary"))),
        pick("key_achievements", _or_default(raw["key_achievements"], empty)),
        pick("technologies_used", _or_default(raw["technologies_used"], empty)),
        pick("generated_at", F.col("gen.analyzed_at")),
        F.when(F.col("gen").isNotNull(), "generated").otherwise("computed").alias("origin"),
    )


def resolve_monthly(computed: DataFrame, analyses: DataFrame, repos: DataFrame, keep: int | None = None) -> DataFrame:
    """As `resolve_weekly`; a stored month lists *all* active repositories."""
    generated = _generated(analyses, repos, "monthly_summary", keep).withColumns(
        {"year": F.col("raw.year"), "month": F.col("raw.month")}
    )
    tracked = active(repos).groupBy("user_id").agg(_count().alias("_tracked"))

    def pick(name: str, value: Column) -> Column:
        return F.when(F.col("gen").isNotNull(), value).otherwise(F.col(name)).alias(name)

    raw = F.col("gen.raw")
    joined = computed.join(_first_match(generated, ["year", "month"]), ["user_id", "year", "month"], "left").join(
        tracked, "user_id", "left"
    )
    return joined.select(
        "user_id",
        "year",
        "month",
        pick("total_commits", _or_default(raw["month_stats"]["total_commits"], F.lit(0))),
        pick("active_repo_count", _zero("_tracked")),
        pick("narrative", _or_default(raw["narrative"], F.col("gen.summary"))),
        pick("growth_areas", _or_default(raw["growth_areas"], F.array().cast("array<string>"))),
        pick("generated_at", F.col("gen.analyzed_at")),
        F.when(F.col("gen").isNotNull(), "generated").otherwise("computed").alias("origin"),
    )


def resolved_month_repos(resolved: DataFrame, computed_repos: DataFrame, repos: DataFrame) -> DataFrame:
    """The repository names that go with `resolve_monthly`, one per row.

    Stored months list every active repository, computed ones those with commits.
    """
    months = resolved.select("user_id", "year", "month", "origin")
    with_commits = computed_repos.select(
        "user_id", F.year("month_start").alias("year"), F.month("month_start").alias("month"), "full_name"
    )
    keys = ["user_id", "year", "month"]
    computed = with_commits.join(months.filter(F.col("origin") == "computed"), keys).select(
        *keys, "full_name", "origin"
    )
    generated = months.filter(F.col("origin") == "generated").join(
        active(repos).select("user_id", "full_name"), "user_id"
    )
    return computed.unionByName(generated.select(*keys, "full_name", "origin"))
