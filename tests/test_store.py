"""Several writers of one store, commits of several tables, and the lookup of keys."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import upsert
from devpulse.plans import files, incremental, store
from devpulse.sources.tables import month_of

SCHEMA = "repo_id long, github_commit_sha string, commit_id long, message string, committed_at timestamp, additions int, deletions int, changed_files int, raw_data string"


def commits(spark, *entries, additions=1):
    """Commits from (sha, month) pairs."""
    return spark.createDataFrame(
        [(1, sha, abs(hash(sha)) % 10**9, sha, datetime(2024, month, 5), additions, 0, 0, None) for sha, month in entries], SCHEMA
    )


def add(tx, df, months=()):
    tx.write(df, month_of("committed_at"), replaced=months, keys=upsert.COMMITS.keys)


def put(root, df, months=()):
    store.commit(df, root, "committed_at", months, keys=upsert.COMMITS.keys)


def stored(spark, root):
    return rows(store.read(spark, root), "github_commit_sha", "additions")


def test_both_writers_keep_their_rows(spark, tmp_path):
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1)))
    slow = store.Transaction(spark, root)
    add(slow, commits(spark, ("b", 1), ("c", 2)))
    put(root, commits(spark, ("d", 1), ("e", 3)))  # from start to end while the other is at work
    slow.commit()
    assert stored(spark, root) == [(x, 1) for x in "abcde"]


def test_writers_of_different_months_do_not_disturb_each_other(spark, tmp_path):
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1), ("b", 2)))
    slow = store.Transaction(spark, root)
    january = slow.read(values=["2024-01"]).drop("year_month").withColumn("additions", F.lit(7))
    add(slow, january, ["2024-01"])
    put(root, commits(spark, ("b", 2), additions=9), ["2024-02"])
    slow.commit()
    assert stored(spark, root) == [("a", 7), ("b", 9)]


@pytest.mark.parametrize("other", ["adds", "replaces", "empties"])
def test_two_writers_of_one_month_give_an_error_and_no_loss(spark, tmp_path, other):
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1), ("b", 2)))
    slow = store.Transaction(spark, root)
    add(slow, slow.read(values=["2024-01"]).drop("year_month").withColumn("additions", F.lit(7)), ["2024-01"])
    if other == "empties":
        put(root, commits(spark), ["2024-01"])
    else:
        put(root, commits(spark, ("d", 1)), ["2024-01"] if other == "replaces" else ())
    before = stored(spark, root)
    with pytest.raises(store.Conflict, match="2024-01"):
        slow.commit()
    assert stored(spark, root) == before == {"adds": [("a", 1), ("b", 1), ("d", 1)], "replaces": [("b", 1), ("d", 1)], "empties": [("b", 1)]}[other]
    # nothing of the loser is left
    used = {e.folder for e in store.Transaction(spark, root).entries}
    first = {n for n in files.child_names(spark, f"{root}/data")} - used
    assert all(n.startswith("version-00000001") for n in first)


def test_a_read_month_counts_even_if_it_is_not_written(spark, tmp_path):
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1)))
    slow = store.Transaction(spark, root)
    add(slow, slow.read(values=["2024-01"]).drop("year_month").withColumn("committed_at", F.lit(datetime(2024, 6, 1))))
    put(root, commits(spark, ("b", 1)))
    with pytest.raises(store.Conflict):
        slow.commit()


def test_compaction_beside_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for sha in "abc":
        put(root, commits(spark, (sha, 1)))
    # a writer that read and replaces the month which is compacted meanwhile
    slow = store.Transaction(spark, root)
    add(slow, slow.read(values=["2024-01"]).drop("year_month").withColumn("additions", F.lit(7)), ["2024-01"])
    assert store.compact(spark, root, "committed_at", 2) == ["2024-01"]
    slow.commit()
    assert stored(spark, root) == [(x, 7) for x in "abc"]
    # a compaction during which rows arrive leaves the month alone
    for sha in "de":
        put(root, commits(spark, (sha, 1)))
    real = store.Transaction.commit

    def late(tx):
        monkeypatch.undo()
        put(root, commits(spark, ("f", 1)))
        return real(tx)

    monkeypatch.setattr(store.Transaction, "commit", late)
    assert store.compact(spark, root, "committed_at", 2) == []
    assert [s for s, _ in stored(spark, root)] == list("abcdef")
    assert store.compact(spark, root, "committed_at", 2) == ["2024-01"]
    assert {e.keys for e in store.Transaction(spark, root).parts()} == {"repo_id,github_commit_sha"}


def test_many_writers_at_once(spark, tmp_path):
    root, failed = str(tmp_path), []

    def work(i):
        try:
            for j in range(3):
                put(root, commits(spark, (f"{i}-{j}", 1 + j)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert stored(spark, root) == sorted((f"{i}-{j}", 1) for i in range(5) for j in range(3))
    assert store._newest(spark, root)[0] == 15


def test_a_merge_starts_anew_when_another_writer_was_faster(spark, tmp_path, monkeypatch):
    """Both bring the same new key; it must not be stored twice."""
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1)))
    real = store.Transaction.commit

    def overtaken(tx):
        monkeypatch.undo()
        incremental.merge_monthly(spark, root, commits(spark, ("new", 2), ("a", 1), additions=5).withColumn("seq", F.lit(0)), upsert.COMMITS).release()
        return real(tx)

    monkeypatch.setattr(store.Transaction, "commit", overtaken)
    batch = commits(spark, ("new", 3), ("other", 3), additions=8).withColumn("seq", F.lit(0))
    merged = incremental.merge_monthly(spark, root, batch, upsert.COMMITS)
    assert merged.rewritten_months == ["2024-02"]
    assert stored(spark, root) == [("a", 5), ("new", 8), ("other", 8)]
    monkeypatch.setattr(store.Transaction, "commit", lambda tx: (_ for _ in ()).throw(store.Conflict("always")))
    with pytest.raises(store.Conflict):
        incremental.merge_monthly(spark, root, batch, upsert.COMMITS)


def test_a_name_is_given_once(spark, tmp_path):
    """On a local disk by a link, elsewhere by a rename that does not replace."""
    mounts = spark._jsc.hadoopConfiguration()
    mounts.set("fs.viewfs.mounttable.shop.link./in", f"file://{tmp_path}")
    for i, path in enumerate((f"{tmp_path}/one", f"file://{tmp_path}/two", "viewfs://shop/in/three")):
        assert files.write_new(spark, path, "é\nfirst")
        assert not files.write_new(spark, path, "second")
        assert files.read_text(spark, path) == "é\nfirst"
    assert sorted(n for n in files.child_names(spark, str(tmp_path)) if not n.endswith(".crc")) == ["one", "three", "two"]


def test_several_tables_switch_together(spark, tmp_path):
    root = str(tmp_path)
    names = spark.createDataFrame([(i, f"r{i}") for i in range(9)], "repo_id long, full_name string")
    bucket = F.format_string("%02x", F.pmod(F.xxhash64("repo_id"), F.lit(4)))

    def work(tx, additions):
        tx.write(commits(spark, ("a", 1), ("b", 2), additions=additions), month_of("committed_at"), "commits", None)
        assert tx.read("commits").count() == 2  # its own rows
        tx.write(names.withColumn("n", F.lit(additions)), bucket, "names", None, column="bucket")
        if additions == 2:
            raise OSError("lost")

    store.attempt(spark, root, lambda tx: work(tx, 1))
    with pytest.raises(OSError):
        store.attempt(spark, root, lambda tx: work(tx, 2))
    assert rows(store.read(spark, root, table="commits"), "additions") == [(1,), (1,)]
    some = store.Transaction(spark, root).parts("names", column="bucket")
    assert {e.part.partition("=")[0] for e in some} == {"bucket"} and 1 < len(some) <= 4
    assert rows(store.read(spark, root, table="names", column="bucket"), "n", "full_name") == sorted((1, f"r{i}") for i in range(9))
    store.attempt(spark, root, lambda tx: work(tx, 3))
    assert rows(store.read(spark, root, table="commits"), "additions") == [(3,), (3,)]
    # what the lost run left goes once it is old enough; the newest version stays whole
    store.expire(spark, root, 1, abandoned_seconds=-10)
    assert len(files.child_names(spark, f"{root}/data")) == 2
    assert rows(store.read(spark, root, table="names", column="bucket"), "n") == [(3,)] * 9
    with pytest.raises(FileNotFoundError):
        store.read(spark, root, table="unknown")


def merge(spark, root, *entries, additions=5, **kw):
    batch = commits(spark, *entries, additions=additions).withColumn("seq", F.lit(0))
    merged = incremental.merge_monthly(spark, root, batch, upsert.COMMITS, **kw)
    merged.release()
    return merged.opened_folders, merged.stored_folders, merged.rewritten_months


def test_a_lookup_opens_only_folders_that_hold_a_key(spark, tmp_path):
    root = str(tmp_path)
    old = [(f"{month}-{i}", month) for month in range(1, 13) for i in range(20)]
    assert merge(spark, root, *old, additions=1) == (0, 0, [])
    assert merge(spark, root, *[(f"new-{i}", 1 + i % 12) for i in range(30)]) == (0, 12, [])
    # one key that is stored in May under another date, and new ones
    assert merge(spark, root, ("5-3", 9), ("newer", 2)) == (1, 24, ["2024-05"])
    expected = {sha: 1 for sha, _ in old} | {f"new-{i}": 5 for i in range(30)} | {"5-3": 5, "newer": 5}
    assert stored(spark, root) == sorted(expected.items())
    # only the months of the batch are searched: the key is not found and comes in again
    assert merge(spark, root, ("5-3", 9), trust_dates=True)[0] == 0
    assert merge(spark, root) == (0, 25, [])


def test_folders_without_hashes_and_equal_hashes_are_searched(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.commit(commits(spark, ("a", 1), ("b", 2)), root, "committed_at")
    assert merge(spark, root, ("a", 3)) == (2, 2, ["2024-01"])
    assert merge(spark, root, ("x", 4)) == (1, 2, [])  # January has been written with hashes
    monkeypatch.setattr(store, "key_hash", lambda keys: F.lit(1).cast("long"))
    assert merge(spark, f"{root}/equal", ("p", 1), ("q", 2)) == (0, 0, [])
    assert merge(spark, f"{root}/equal", ("r", 1), ("p", 2), additions=6) == (2, 2, ["2024-01"])
    assert stored(spark, f"{root}/equal") == [("p", 6), ("q", 5), ("r", 6)]


def test_unknown_lists_are_left_alone(spark, tmp_path):
    root = str(tmp_path)
    put(root, commits(spark, ("a", 1)))
    (tmp_path / "lists" / f"version-00000002").mkdir()
    (tmp_path / "lists" / f".version-00000003-{uuid.uuid4().hex}").write_text("half")
    put(root, commits(spark, ("b", 1)))
    assert stored(spark, root) == [("a", 1), ("b", 1)]


def test_a_merge_collects_no_records_on_the_driver(spark, tmp_path, monkeypatch):
    """Whole records may be far larger than their packed files, so they are not broadcast however small these are."""
    plans = []

    def kept(*args):
        found = upsert.updated_rows(*args)
        plans.append(found._jdf.queryExecution().sparkPlan().toString())
        return found

    monkeypatch.setattr(incremental, "updated_rows", kept)
    for additions in (1, 2):
        batch = commits(spark, ("a", 1), ("b", 2), additions=additions).withColumn("seq", F.lit(0))
        incremental.merge_monthly(spark, f"{tmp_path}/t", batch, upsert.COMMITS).release()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert rows(store.read(spark, f"{tmp_path}/t"), "additions") == [(2,), (2,)]


def test_only_records_of_repeated_keys_are_brought_together(spark, tmp_path, monkeypatch):
    collapsed, staged = [], []
    collapse, stage = incremental.collapse_marked, files.staged

    def kept(records, *args):
        collapsed.append(rows(records, "github_commit_sha", "additions"))
        return collapse(records, *args)

    def named(df, name, *args):
        staged.append(name)
        return stage(df, name, *args)

    monkeypatch.setattr(incremental, "collapse_marked", kept)
    monkeypatch.setattr(files, "staged", named)
    undecided = []
    keep = lambda records: undecided.append(rows(records, "github_commit_sha", "additions"))
    some = commits(spark, ("a", 1), ("b", 2), ("c", 2)).withColumn("seq", F.lit(1))
    batch = some.unionByName(commits(spark, ("a", 3), additions=7).withColumn("seq", F.lit(2))).unionByName(
        commits(spark, ("b", 2), additions=8).withColumn("seq", F.lit(1))
    )
    nameless = F.when(F.col("github_commit_sha") != "c", F.col("github_commit_sha"))
    batch = batch.unionByName(batch.filter("github_commit_sha = 'c'").withColumn("github_commit_sha", nameless)).unionByName(
        batch.filter("github_commit_sha = 'c'").withColumns({"github_commit_sha": nameless, "additions": F.lit(9), "seq": F.lit(2)})
    )
    merged = incremental.merge_monthly(spark, f"{tmp_path}/t", batch, upsert.COMMITS, undecided=keep)
    assert collapsed == [[(None, 1), (None, 9), ("a", 1), ("a", 7), ("b", 1), ("b", 8)]]
    assert undecided == [[("b", 1), ("b", 8)]]
    assert {r[0] for r in rows(merged.touched, "github_commit_sha")} == {"a", "c", None}
    merged.release()
    assert rows(store.read(spark, f"{tmp_path}/t"), "github_commit_sha", "additions", "year_month") == rows(
        spark.createDataFrame([("a", 7, "2024-01"), ("c", 1, "2024-02"), (None, 9, "2024-02")], "s string, n int, m string")
    )
    # a batch of new keys that come once is neither aggregated nor joined
    assert "found" not in staged
    incremental.merge_monthly(spark, f"{tmp_path}/t", commits(spark, ("d", 1)).withColumn("seq", F.lit(0)), upsert.COMMITS, undecided=keep).release()
    assert len(collapsed) == 1 and undecided[1:] == [[]] and "found" not in staged
