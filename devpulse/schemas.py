"""Entity schemas and fixed value tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_TS, _D = T.TimestampType(), T.DateType()


def _struct(*fields: tuple) -> T.StructType:
    """Fields are ``(name, type)`` or ``(name, type, nullable)``; default is NOT NULL."""
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else False) for f in fields])


CHANGED_FILE = _struct(
    ("filename", _S, True), ("status", _S, True), ("additions", _I, True), ("deletions", _I, True), ("patch", _S, True)
)
COMMIT_RAW = _struct(
    ("stats", T.MapType(_S, _I), True),
    ("files", T.ArrayType(CHANGED_FILE), True),
    ("diff", _S, True),
)
PULL_REQUEST_RAW = _struct(
    ("labels", T.ArrayType(_S), True), ("user", _S, True), ("head_ref", _S, True), ("base_ref", _S, True)
)
TECH_ANALYSIS = _struct(
    ("domain", _S, True),
    ("domain_detail", _S, True),
    ("frameworks", T.ArrayType(_S), True),
    ("tools", T.ArrayType(_S), True),
    ("infrastructure", T.ArrayType(_S), True),
    ("project_type", _S, True),
    ("analyzed_at", _S, True),
)
GENERATED_SUMMARY = _struct(
    ("type", _S, True),
    ("week_start", _S, True),
    ("week_end", _S, True),
    ("highlight", _S, True),
    ("key_achievements", T.ArrayType(_S), True),
    ("technologies_used", T.ArrayType(_S), True),
    ("suggestions", _S, True),
    ("focus_areas", T.ArrayType(_S), True),
    ("commits_count", _L, True),
    ("prs_count", _L, True),
    ("year", _I, True),
    ("month", _I, True),
    ("narrative", _S, True),
    ("growth_areas", T.ArrayType(_S), True),
    ("monthly_highlights", _S, True),
    ("month_stats", _struct(("total_commits", _L, True)), True),
)
ERROR_DETAIL = _struct(("type", _S, True), ("message", _S, True), ("repo_full_name", _S, True))
PROFILE = _struct(("sync_interval_hours", _I, True), ("gemini_analysis_enabled", _B, True), ("timezone", _S, True))

# Stored entities. Open-ended documents stay JSON text: repo_metadata,
# analyses.raw_response, users.profile_data. Secrets are never loaded.
ENTITIES: dict[str, T.StructType] = {
    "users": _struct(
        ("user_id", _L),
        ("github_user_id", _L, True),
        ("github_login", _S),
        ("display_name", _S, True),
        ("has_token", _B),
        ("profile_data", _S, True),
    ),
    "repositories": _struct(
        ("repo_id", _L),
        ("user_id", _L),
        ("github_repo_id", _L),
        ("full_name", _S),
        ("description", _S, True),
        ("primary_language", _S, True),
        ("is_private", _B),
        ("is_active", _B),
        ("repo_metadata", _S, True),
        ("last_synced_at", _TS, True),
        ("created_at", _TS),
        ("updated_at", _TS),
    ),
    "commits": _struct(
        ("commit_id", _L),
        ("repo_id", _L),
        ("github_commit_sha", _S),
        ("message", _S, True),
        ("committed_at", _TS),
        ("additions", _I),
        ("deletions", _I),
        ("changed_files", _I),
        ("raw_data", COMMIT_RAW, True),
        ("created_at", _TS, True),
    ),
    "pull_requests": _struct(
        ("pr_id", _L),
        ("repo_id", _L),
        ("github_pr_id", _L),
        ("github_pr_number", _I),
        ("title", _S, True),
        ("state", _S),
        ("additions", _I),
        ("deletions", _I),
        ("changed_files", _I),
        ("pr_created_at", _TS),
        ("pr_closed_at", _TS, True),
        ("merged_at", _TS, True),
        ("raw_data", PULL_REQUEST_RAW, True),
        ("created_at", _TS, True),
    ),
    "analyses": _struct(
        ("analysis_id", _L),
        ("source_type", _S),
        ("source_id", _L),
        ("repo_id", _L),
        ("tech_tags", T.ArrayType(_S)),
        ("work_category", _S),
        ("summary", _S),
        ("complexity_score", T.DecimalType(3, 1), True),
        ("raw_response", _S, True),
        ("analyzed_at", _TS),
        ("created_at", _TS, True),
    ),
    "hourly_activity": _struct(
        ("user_id", _L),
        ("activity_date", _D),
        ("day_of_week", T.ShortType()),
        ("hour_of_day", T.ShortType()),
        ("commit_count", _L),
        ("pr_count", _L),
        ("additions", _L),
        ("deletions", _L),
    ),
    "sync_jobs": _struct(
        ("job_id", _L),
        ("user_id", _L),
        ("repo_id", _L, True),
        ("job_type", _S),
        ("status", _S),
        ("started_at", _TS, True),
        ("completed_at", _TS, True),
        ("items_fetched", _I),
        ("error_detail", ERROR_DETAIL, True),
        ("created_at", _TS),
    ),
}

# Month-partitioned entities and the timestamp their partitions are cut from.
MONTH_RANGE = (date(2024, 1, 1), date(2028, 1, 1))
PARTITION_TIMESTAMP = {"commits": "committed_at", "pull_requests": "pr_created_at", "analyses": "analyzed_at"}

# Landed payloads, as the forge sends them, inside an envelope that says which
# repository they belong to and in which order they were fetched.
_FILES = T.ArrayType(CHANGED_FILE)
_DATED = _struct(("date", _S, True))
COMMIT_PAYLOAD = _struct(
    ("sha", _S, True),
    (
        "commit",
        _struct(("message", _S, True), ("committer", _DATED, True), ("author", _DATED, True)),
        True,
    ),
    ("author", _struct(("login", _S, True)), True),
    # every key of the object is kept
    ("stats", T.MapType(_S, _I), True),
    ("files", _FILES, True),
)
_REF = _struct(("ref", _S, True))
PULL_REQUEST_PAYLOAD = _struct(
    ("id", _L, True),
    ("number", _I, True),
    ("title", _S, True),
    ("state", _S, True),
    ("additions", _I, True),
    ("deletions", _I, True),
    ("changed_files", _I, True),
    ("created_at", _S, True),
    ("closed_at", _S, True),
    ("merged_at", _S, True),
    ("labels", T.ArrayType(_struct(("name", _S, True))), True),
    ("user", _struct(("login", _S, True)), True),
    ("head", _REF, True),
    ("base", _REF, True),
)
REPOSITORY_PAYLOAD = _struct(
    ("id", _L, True),
    ("full_name", _S, True),
    ("description", _S, True),
    ("language", _S, True),
    ("private", _B, True),
    ("fork", _B, True),
    ("pushed_at", _S, True),
    ("stargazers_count", _L, True),
)
LANGUAGE_BYTES = T.MapType(_S, _L)


def envelope(payload: T.DataType) -> T.StructType:
    return _struct(("repo_id", _L, True), ("seq", _L, True), ("payload", payload, True))


# --- Fixed values -----------------------------------------------------------

SOURCE_TYPES = ["commit", "pull_request", "weekly_summary", "monthly_summary"]
JOB_STATUSES = ["pending", "running", "completed", "failed"]

MANIFEST_NAMES = [
    "package.json",
    "requirements.txt",
    "pyproject.toml",
    "Cargo.toml",
    "go.mod",
    "Gemfile",
    "pom.xml",
    "build.gradle",
    "build.gradle.kts",
    "composer.json",
    "pubspec.yaml",
    "mix.exs",
    "Package.swift",
    "CMakeLists.txt",
    "Dockerfile",
    "docker-compose.yml",
]

LANGUAGE_COLORS = {
    "Python": "#3572A5",
    "JavaScript": "#f1e05a",
    "TypeScript": "#3178c6",
    "Java": "#b07219",
    "Go": "#00ADD8",
    "Rust": "#dea584",
    "C": "#555555",
    "C++": "#f34b7d",
    "C#": "#178600",
    "Ruby": "#701516",
    "PHP": "#4F5D95",
    "Swift": "#F05138",
    "Kotlin": "#A97BFF",
    "Scala": "#c22d40",
    "Dart": "#00B4AB",
    "Shell": "#89e051",
    "HTML": "#e34c26",
    "CSS": "#563d7c",
    "Vue": "#41b883",
    "Svelte": "#ff3e00",
    "Lua": "#000080",
    "R": "#198CE7",
    "Elixir": "#6e4a7e",
    "Haskell": "#5e5086",
    "Clojure": "#db5855",
    "Zig": "#ec915c",
    "Nim": "#ffc200",
    "OCaml": "#3be133",
    "Jupyter Notebook": "#DA5B0B",
}
DEFAULT_COLOR = "#8b8b8b"
UNKNOWN_LANGUAGE = "Unknown"

CATEGORY_COLORS = {
    "feature": "#3fb950",
    "bugfix": "#f85149",
    "refactor": "#58a6ff",
    "docs": "#d29922",
    "test": "#a371f7",
    "ci": "#f778ba",
    "style": "#79c0ff",
    "performance": "#ffa657",
    "security": "#ff7b72",
    "dependency": "#8b949e",
    "other": "#8b949e",
}

DOMAIN_COLORS = {
    "web_frontend": "#3178c6",
    "web_backend": "#3572A5",
    "mobile": "#F05138",
    "data_science": "#DA5B0B",
    "machine_learning": "#ff6f00",
    "devops": "#00ADD8",
    "cli_tool": "#89e051",
    "library": "#A97BFF",
    "game": "#db5855",
    "iot": "#178600",
    "general": "#8b8b8b",
}
DOMAIN_LABELS = {
    "web_frontend": "Web Frontend",
    "web_backend": "Web Backend",
    "mobile": "Mobile",
    "data_science": "Data Science",
    "machine_learning": "ML / AI",
    "devops": "DevOps",
    "cli_tool": "CLI Tool",
    "library": "Library",
    "game": "Game",
    "iot": "IoT",
    "general": "General",
}
NOT_ANALYZED_LABEL = "Not Analyzed"

HEAT_COLORS = ["#161b22", "#0e4429", "#006d32", "#26a641", "#39d353"]

# Sentence formats of the computed summaries: with activity / without.
WEEK_HIGHLIGHT = ("%d件のコミットと%d件のPRマージを実施", "この週のアクティビティはありません")
MONTH_NARRATIVE = (
    "%d年%d月は%d件のコミットを行い、%d個のリポジトリで活動しました。",
    "%d年%d月のアクティビティはありません。",
)

DEFAULT_SYNC_INTERVAL_HOURS = 6
DEFAULT_TIMEZONE = "Asia/Tokyo"
