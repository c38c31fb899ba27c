from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import ranking


def jobs(spark, n, users=2):
    start = datetime(2024, 1, 1)
    data = [(u, i, start + timedelta(hours=7 * (i % 40)) if i % 9 else None) for u in range(users) for i in range(n)]
    return spark.createDataFrame(data, "user_id long, id long, at timestamp")


def order():
    return [F.desc("at"), F.asc("id")]


def levels():
    return [(F.to_date("at"), False), (F.col("at"), False), (F.floor(F.col("id") / 50), True)]


def expected(data, page, per_page):
    out = []
    for user in {r.user_id for r in data}:
        mine = [r for r in data if r.user_id == user]
        mine.sort(key=lambda r: (r.at is None, -(r.at.timestamp() if r.at else 0), r.id))
        out += [(user, r.id, i + 1) for i, r in enumerate(mine)][(page - 1) * per_page : page * per_page]
    return sorted(out, key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize("page", [1, 2, 7, 13])
def test_pages_by_either_path(spark, page):
    df = jobs(spark, 125)
    data = df.collect()
    shallow = ranking.paginate(df, order(), page, 10)
    deep = ranking.paginate(df, order(), page, 10, levels=levels())
    columns = ["user_id", "id", "position"]
    assert rows(shallow, *columns) == rows(deep, *columns) == expected(data, page, 10)


def test_totals_and_page_past_the_end(spark):
    df = jobs(spark, 41, users=1)
    last = ranking.paginate(df, order(), 3, 20).collect()
    assert [(r.total, r.total_pages) for r in last] == [(41, 3)]
    assert ranking.paginate(df, order(), 4, 20).count() == 0
    assert ranking.paginate(df.limit(0), order()).count() == 0
    groups = spark.createDataFrame([(0,), (9,)], "user_id long")
    assert rows(ranking.page_totals(df, 20, groups=groups)) == [(0, 41, 3), (9, 0, 0)]


@pytest.mark.parametrize(("page", "per_page"), [(0, 10), (1, 0), (1, 101)])
def test_page_arguments(spark, page, per_page):
    with pytest.raises(ValueError):
        ranking.paginate(jobs(spark, 1), order(), page, per_page)


def test_a_group_is_limited_before_the_shuffle(spark):
    plan = ranking.top_k(jobs(spark, 10), ["user_id"], order(), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
