"""Queries beside their SQL."""

from __future__ import annotations

import pytest

from compare import compare, connect
from devpulse.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_to_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) is None


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
