"""Documents with everything odd in them."""

from __future__ import annotations

import pytest

LONG = " ".join(f"w{i * i % 9973}" for i in range(60_000))
COPY = "the quick brown fox jumps over the lazy dog and then runs far away from all the other animals in the wood"

#: null ids and texts, empty and blank texts, repeated rows, ids with two texts, a very long text, ties
ODD_TEXTS = [
    (1, COPY),
    (2, COPY),
    (2, COPY),
    (3, COPY + " today"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (None, COPY),
    (None, None),
    (7, LONG),
    (8, "one"),
    (9, "ONE"),
    (9, "another text under the same id"),
    (10, "été ÉTÉ naïve 漢字 \x00 \x1f \u00a0 a"),
    (11, "a " * 500),
    (12, COPY.upper()),
]

#: columns that have the names of results and of helpers
CLASHING = "found string, score string, key long, digest string, weight string, component string, kept long, block long, spans string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t) if t else None, *[None] * len(names)) for k, (i, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [str(v) for v in r])
