from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from devpulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def repos(spark):
    """User 1 has repositories 1-3 (3 inactive), user 2 repository 4."""
    return spark.createDataFrame(
        [
            (1, 1, "a/one", "Go", True),
            (2, 1, "a/two", "Go", True),
            (3, 1, "a/three", "C", False),
            (4, 2, "b/four", None, True),
        ],
        "repo_id long, user_id long, full_name string, primary_language string, is_active boolean",
    )


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [str(v) for v in r])
