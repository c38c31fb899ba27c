"""A copy of the test tables in which single keys hold a third of all rows.

    python tools/skewed.py <sf_dir> <target_dir>
"""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# per table: the columns that get one value on every third row
HOT = {
    "customer": {"c_nationkey": "CAST(3 AS INTEGER)"},
    "orders": {"o_custkey": "CAST(7 AS BIGINT)", "o_orderdate": "TIMESTAMP '2001-07-15'"},
    "lineitem": {"l_orderkey": "CAST(11 AS BIGINT)"},
    "events": {"user_id": "CAST(5 AS BIGINT)", "ts": "TIMESTAMP '2024-01-24 10:00:00'"},
    "documents": {"text": "(SELECT max(text) FROM src)"},
}


def write_skewed(source: str, target: str) -> None:
    Path(target).mkdir(parents=True, exist_ok=True)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW src AS SELECT *, file_row_number AS rn FROM read_parquet('{source}/{table}.parquet', file_row_number = true)")
        names = [d[0] for d in con.execute("SELECT * FROM src LIMIT 0").description if d[0] not in ("rn", "file_row_number")]
        hot = HOT.get(table, {})
        columns = [f"CASE WHEN rn % 3 = 0 THEN {hot[n]} ELSE {n} END AS {n}" if n in hot else n for n in names]
        con.execute(f"COPY (SELECT {', '.join(columns)} FROM src) TO '{target}/{table}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    write_skewed(*sys.argv[1:3])
