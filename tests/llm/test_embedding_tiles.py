from __future__ import annotations

from collections import Counter

import numpy as np

from devpulse.llm import embedding_dedup


def test_no_group_grows_with_its_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rows = [(cell, i < homes, f"{cell}-{i}".encode(), 1, b"", b"") for cell, homes, members in ((1, 150, 230), (2, 7, 9), (3, 0, 40)) for i in range(members)]
    tiles = embedding_dedup._tiles(spark.createDataFrame(rows, embedding_dedup._DEALT)).collect()
    held: dict = {}
    for r in tiles:
        held.setdefault((r.cell, r.block, r.part), []).append(r)
    assert max(map(len, held.values())) <= 2 * 2 * embedding_dedup.BLOCK  # hashing fills blocks unevenly
    met = Counter()
    for (cell, _, _), some in held.items():
        met.update((cell, bytes(a.digest), bytes(b.digest)) for a in some if a.role & 1 for b in some if b.role & 2)
    want = {(a[0], a[2], b[2]) for a in rows if a[1] for b in rows if a[0] == b[0]}
    assert set(met) == want and set(met.values()) == {1}


def test_links_of_one_tight_cluster(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(4)
    vectors = np.vstack([rng.normal(size=16) + rng.normal(scale=0.33, size=(300, 16)), rng.normal(size=(60, 16))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(vectors))] == want
