from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from devpulse.functions.diff import DIFF_BUDGET, TRUNCATION_MARKER, assemble_diff, truncate_diff
from devpulse.schemas import COMMIT_RAW


def cut(spark, texts, max_chars):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.o for r in truncate_diff(df, "t", "o", max_chars).orderBy("i").collect()]


def expected(text, budget):
    """Brute force: try every number of leading sections."""
    if len(text) <= budget:
        return text
    starts = [m.start() for m in re.finditer(r"(?m)^(?:diff --git |--- a/)", text)]
    bounds = sorted({0, *starts, len(text)})
    sections = [text[a:b] for a, b in zip(bounds, bounds[1:]) if text[a:b].strip()]
    room = budget - len(TRUNCATION_MARKER)
    best = 0
    while best < len(sections) and len("".join(sections[: best + 1])) <= room:
        best += 1
    if best == 0:
        return text[:room] + TRUNCATION_MARKER
    head = "".join(sections[:best])
    return head + TRUNCATION_MARKER if len(head) < len(text) else head


def test_exact_budget_is_unchanged(spark):
    text = "--- a/x\n" + "y" * (DIFF_BUDGET - 8)
    assert cut(spark, [text], DIFF_BUDGET) == [text]


def test_first_section_over_budget_is_cut_hard(spark):
    text = "--- a/x\n" + "y" * DIFF_BUDGET
    (got,) = cut(spark, [text], DIFF_BUDGET)
    assert len(got) == DIFF_BUDGET and got.endswith(TRUNCATION_MARKER)


def test_small_section_after_a_misfit_is_dropped_too(spark):
    parts = ["--- a/1\n" + "a" * 100 + "\n", "--- a/2\n" + "b" * 300 + "\n", "--- a/3\nc\n"]
    assert cut(spark, ["".join(parts)], 250) == [parts[0] + TRUNCATION_MARKER]


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(3)
    pieces = ["--- a/f\n", "diff --git a b\n", "\n", "   \n", "\r", "é", "x" * 20, "\x1f\n", " --- a/no", " ", "\x85"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for budget in (80, 150, 400):
        assert cut(spark, texts, budget) == [expected(t, budget) for t in texts]


def test_budget_must_leave_room_for_the_marker(spark):
    with pytest.raises(ValueError):
        cut(spark, ["x"], 10)


def raw(files=None, diff=None):
    return ({"additions": 1, "deletions": 1}, files, diff)


def test_assembly(spark):
    file = ("f.py", "added", 1, 0, "+x")
    cases = [
        raw([file], "stored"),
        raw([file, (None, None, 1, 0, "+y"), ("empty", "added", 0, 0, ""), ("none", "added", 0, 0, None)], ""),
        raw([], None),
        raw(None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, raw {COMMIT_RAW.simpleString()}")
    got = [r.d for r in df.orderBy("i").select(assemble_diff(F.col("raw")).alias("d")).collect()]
    built = "\n".join(
        ["--- a/f.py", "+++ b/f.py", "Status: added", "+x", "", "--- a/unknown", "+++ b/unknown", "Status: modified", "+y", ""]
    )
    assert got == ["stored", built, "", ""]
