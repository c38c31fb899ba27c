"""MinHash near-duplicates with an LSH forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.llm.columns import unused
from devpulse.llm.graph import components, splittable
from devpulse.plans.files import delete, staged

SHINGLE = 5
#: links have at least this Jaccard similarity, as a fraction of whole numbers
SIMILARITY = (75, 100)
#: hash functions, and sorted orders of them; order t starts with value t * PERMUTATIONS / TREES
PERMUTATIONS, TREES = 64, 16
#: values that neighbours share at least, and values that an order sorts by
LEAST_DEPTH, DEPTH = 2, 8
#: a region that holds more documents is searched at a greater depth
REGION = 64
#: beyond the depth of the order: sorted neighbours compared on either side in the first pass
NEIGHBOURS = 12
#: pairs of which a smaller share of hash values agrees are not confirmed (five standard deviations below the limit)
LEAST_AGREEMENT = 0.48

_SALTS = words.mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
_FACTORS = words.mixed(np.arange(PERMUTATIONS + 1, 2 * PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; all words as one if they are fewer."""
    found = words.split(texts, words.LOWER)
    h = words.hashes(found.vocab)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    bounds = found.offsets.tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield np.unique(words.shingle_hashes(h[a:b], min(size, b - a))) if b > a else h[:0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit minima for each set; all ones for an empty set."""
    out = np.full((len(sets), PERMUTATIONS), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    joined = np.concatenate([sets[i] for i in full])
    starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
    for k in range(PERMUTATIONS):
        values = (((joined ^ _SALTS[k]) * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(values, starts)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        sets = list(shingle_sets(batch["text"]))
        signed = signatures(sets)
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                # big-endian, so that binary columns sort as the numbers do
                "signature": pa.array([row.astype(">u4").tobytes() for row in signed], pa.binary()),
            }
        )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (equal for equal shingle sets, null for empty ones) and signature."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(_described, "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def _regions(paths: np.ndarray, groups: np.ndarray | None, start: int, end: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, depth) of runs of sorted paths that share a prefix: no deeper than it takes to hold REGION rows.

    With groups, more rows are held if they have no more partners in other groups
    than REGION rows have.  A run that stays larger has a depth of DEPTH + 1.
    """
    n = end - start
    if n <= REGION or (groups is not None and _partners(groups[start:end]) <= REGION * n // 2):
        yield start, end, depth
    elif depth >= paths.shape[1]:
        yield start, end, DEPTH + 1
    else:
        for a, b in _runs(paths, start, end, depth):
            yield from _regions(paths, groups, a, b, depth + 1)


def _runs(paths: np.ndarray, start: int, end: int, depth: int) -> Iterator[tuple[int, int]]:
    """Runs of equal values at a depth."""
    cuts = (np.flatnonzero(paths[start + 1 : end, depth] != paths[start : end - 1, depth]) + start + 1).tolist()
    return zip([start, *cuts], [*cuts, end])


def _partners(groups: np.ndarray) -> int:
    """Pairs of different groups."""
    n = np.unique(groups, return_counts=True)[1]
    return int(len(groups) ** 2 - (n * n).sum()) // 2


def _across(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs of different groups, each once and in order."""
    found, code, n = np.unique(groups, return_inverse=True, return_counts=True)
    rare = code != n.argmax()
    i, j = np.nonzero(groups[rare][:, None] != groups)
    i = np.flatnonzero(rare)[i]
    once = ~rare[j] | (i < j)
    return np.minimum(i, j)[once], np.maximum(i, j)[once]


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=-1)


def _candidates(paths: np.ndarray, sketches: np.ndarray, groups: np.ndarray | None, regions: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Index pairs of one region of least depth: the best partner of each row, or, with groups, all partners of other groups."""
    n = len(paths)
    pairs: dict[tuple[int, int], float] = {}

    def add(i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        share = _agreement(sketches[i], sketches[j])
        near = share >= LEAST_AGREEMENT
        for p, q, s in zip(i[near].tolist(), j[near].tolist(), share[near].tolist()):
            pairs[(p, q)] = s

    for a, b, depth in regions:
        if depth <= DEPTH and b - a > 1:
            i, j = np.triu_indices(b - a, 1) if groups is None else _across(groups[a:b])
            add(i + a, j + a)
    if groups is not None:
        yield from pairs
        return
    if n > REGION:  # neighbours with the longest common prefix, whatever their region
        for step in range(1, NEIGHBOURS + 1):
            i = np.arange(n - step)
            add(i, i + step)
    best: dict[int, tuple[float, int]] = {}
    for (i, j), share in pairs.items():
        for p, q in ((i, j), (j, i)):
            if p not in best or (-share, q) < (-best[p][0], best[p][1]):
                best[p] = (share, q)
    yield from {(min(p, q), max(p, q)) for p, (_, q) in best.items()}


#: rows of one region of least depth held at a time; neighbouring pieces overlap
_HELD_ROWS = 4096


_SEARCHED = "a binary, b binary, cut long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, path, sketch, digest and perhaps group) to candidate pairs of digests.

    With groups, a region of least depth is searched only if it is small enough to be
    searched as a whole and lies in one task.  Of another each row gives (digest, null, 1)
    instead: such classes are joined exactly, at a cost in proportion to what they share.
    """
    held: list[tuple] = []
    found: set[tuple[bytes, bytes]] = set()
    cut: list[bytes] = []

    def search(whole: bool, stay: int) -> None:
        """Compares the rows held, which are a whole region of least depth or a part of one, and lets all but the last go."""
        if not held:
            return
        paths = np.frombuffer(b"".join(r[1] for r in held), dtype=">u4").reshape(len(held), DEPTH)
        sketches = np.frombuffer(b"".join(r[2] for r in held), dtype=np.uint8).reshape(len(held), PERMUTATIONS)
        codes = {g: i for i, g in enumerate({r[4] for r in held})}
        groups = np.array([codes[r[4]] for r in held]) if held[0][4] is not None else None
        regions = list(_regions(paths, groups, 0, len(held), LEAST_DEPTH))
        gone = len(held) - stay
        if groups is None or (whole and regions[0][2] == LEAST_DEPTH):
            for i, j in _candidates(paths, sketches, groups, regions):
                x, y = held[i][3], held[j][3]
                found.add((x, y) if x < y else (y, x))
        else:
            cut.extend(r[3] for r in held[:gone])
        del held[:gone]

    def flushed() -> pa.RecordBatch:
        a, b = [p[0] for p in found] + cut, [p[1] for p in found] + [None] * len(cut)
        n = [0] * len(found) + [1] * len(cut)
        found.clear()
        cut.clear()
        return pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "cut": pa.array(n, pa.int64())})

    key = None
    open_start = True  # the region may begin in another task
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("tree", "path", "sketch", "digest", "group")]
        for row in zip(*columns):
            at = (row[0], row[1][: 4 * LEAST_DEPTH])
            if at != key or len(held) >= _HELD_ROWS:
                search(whole=not open_start and at != key, stay=REGION if at == key else 0)
                open_start = at == key or key is None
                key = at
            held.append(row)
        if len(found) + len(cut) > 100_000:
            yield flushed()
    search(whole=False, stay=0)  # the region may go on in another task
    yield flushed()
    words.release()


def _sorted_orders(classes: DataFrame) -> DataFrame:
    """Each signature once for each tree, sorted by the values with which the tree begins."""
    width = 4 * PERMUTATIONS // TREES
    twice = F.concat("signature", "signature")
    path = F.substring(twice, F.col("tree") * width + 1, F.lit(4 * DEPTH))
    rows = classes.select("digest", "group", "signature", "sketch", F.explode(F.lit(list(range(TREES)))).alias("tree"))
    return rows.select("tree", path.alias("path"), "sketch", "digest", "group").repartitionByRange("tree", "path").sortWithinPartitions("tree", "path", "digest")


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch["signature"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, 4 * PERMUTATIONS)
        yield pa.record_batch({"digest": batch["digest"], "signature": batch["signature"], "sketch": pa.array([r[3::4].tobytes() for r in rows], pa.binary())})


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


#: 64-bit words of an odd sketch
ODD_WORDS = 8


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 512 parts of the hash space: whether the set has an odd number of shingles there.

    Each shingle that only one of two sets has changes one bit, so sketches differ in no
    more bits than the sets do in shingles.
    """
    part = (shingles >> np.uint64(64 - 9)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=64 * ODD_WORDS).astype(np.uint8) & 1).view(np.int64)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        sets = list(shingle_sets(batch["text"]))
        yield pa.record_batch(
            {
                "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                "odd": pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())),
            }
        )


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, shingles, odd sketch) of the wanted classes, made again from the text of each class's first document."""
    ids = classes.join(wanted, "digest", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_set_rows, "digest binary, shingles array<long>, odd array<long>")
    return sets.dropDuplicates(["digest"])  # a document may stand in several rows


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of digests (a, b) whose whole shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    sets = _sets(wanted, classes, docs)
    left = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("s")), "a")
    both = left.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    least, of = SIMILARITY
    return both.where(of * shared >= least * (F.size("s") + F.size("t") - shared)).select("a", "b")


#: shingles are counted in 2^COUNT_BITS parts of the hash space: 8 MB, whatever the corpus
COUNT_BITS = 20


def _part(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_part(_flat(batch["shingles"])), minlength=len(counts))
    parts = np.flatnonzero(counts)
    yield pa.record_batch({"part": pa.array(parts), "n": pa.array(counts[parts])})


def part_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles the sets hold in each part of the hash space."""
    found = sets.select("shingles").mapInArrow(_part_rows, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[found["part"].to_numpy()] = found["n"].to_numpy()
    return counts


def _firsts(counts: Broadcast):
    """The first shingles of each set that another set can hold: no similar sets lack a common one among them.

    ``alone`` more come before them, and those below place ``indexed`` are enough for the smaller set of a pair.
    """
    least, of = SIMILARITY

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.concatenate(([0], np.cumsum(batch["shingles"].value_lengths().to_numpy(zero_copy_only=False))))
            flat = _flat(batch["shingles"])
            many = counts.value[_part(flat)]
            sizes, alone, indexed, tokens = [], [], [], []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                n, order = b - a, np.lexsort((flat[a:b], many[a:b]))
                skipped = int((many[a:b] == 1).sum())
                sizes.append(n)
                alone.append(skipped)
                indexed.append(n + 1 + (-2 * least * n) // (of + least))
                tokens.append(flat[a:b][order[skipped : n + 1 + (-least * n) // of]].view(np.int64))
            yield pa.record_batch(
                {
                    **{c: batch[c] for c in ("digest", "group", "odd")},
                    **{c: pa.array(v, pa.int64()) for c, v in (("n", sizes), ("alone", alone), ("indexed", indexed))},
                    "tokens": pa.array(tokens, pa.list_(pa.int64())),
                }
            )

    return firsts


def prefix_pairs(marked: DataFrame, classes: DataFrame, docs: DataFrame, scratch: list[str]) -> DataFrame:
    """All pairs of digests (a, b) of the marked classes (digest, group) that can be similar enough, but for those of one group.

    Shingles are ordered by how many the sets hold in the same one of 2^20 parts of
    the hash space: nearly by how rare they are, and from one array of fixed size, so
    that no shingle is joined for it.  Similar sets share one of their first: the
    smaller set among its n - ceil(2t / (1 + t) n) + 1 first, the larger among its n
    - ceil(t n) + 1 first, and after the first that they share enough must be left
    of both; that holds in any order.  A shingle alone in its part or in one group
    only joins nothing; of the others, its largest group meets only the rest.  A pair
    is made only if the odd sketches differ in no more bits than the sets may in
    shingles, which no similar pair exceeds: of documents with a common part
    that is large but not large enough, few pairs are.

    What is staged on the way is added to ``scratch``, for the caller to delete.
    """
    spark, (least, of) = classes.sparkSession, SIMILARITY

    def kept(df: DataFrame, name: str) -> DataFrame:
        found, path = staged(df, name)
        scratch.append(path)
        return found

    sets = kept(_sets(marked, classes, docs).join(marked, "digest"), "sets")
    counts = spark.sparkContext.broadcast(part_counts(sets))
    firsts = "digest binary, group binary, odd array<long>, n long, alone long, indexed long, tokens array<long>"
    rows = sets.mapInArrow(_firsts(counts), firsts).select("digest", "group", "odd", "n", "alone", "indexed", F.posexplode("tokens").alias("pos", "token"))
    at = F.col("alone") + F.col("pos")
    rows = kept(rows.select("digest", "group", "n", "odd", "token", at.alias("at"), (at < F.col("indexed")).alias("indexed")), "prefixes")

    sizes = rows.groupBy("token", "group").agg(F.count("*").alias("rows"))
    top = sizes.groupBy("token").agg(F.max_by("group", F.struct("rows", "group")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    rows = kept(rows.join(splittable(top.drop("groups")), "token").withColumn("in_top", F.col("group") == F.col("top")).drop("top"), "prefixes")
    x, y = rows.where("indexed").alias("x"), rows.alias("y")
    smaller = "(x.n < y.n OR x.n = y.n AND x.digest < y.digest)"
    enough = f"{of + least} * least(x.n - x.at, y.n - y.at) >= {least} * (x.n + y.n)"
    differing = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(ODD_WORDS))
    alike = f"{of + least} * ({differing}) <= {of - least} * (x.n + y.n)"
    match = F.expr(f"x.token = y.token AND x.group <> y.group AND {smaller} AND {of} * x.n >= {least} * y.n AND {enough} AND {alike}")
    parts = [x.where("NOT x.in_top").join(y, match), x.where("x.in_top").join(y.where("NOT y.in_top"), match)]
    a, b = F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")
    return parts[0].select(a, b).union(parts[1].select(a, b)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Words stand between ASCII white space, A-Z lower-cased; a document's set
    holds its distinct shingles of five words, or all its words as one if they
    are fewer.  Documents with a Jaccard similarity of 0.75 or more are linked;
    a component's id is the smallest doc_id in it, and that document is kept.

    Documents with equal sets are one class, and classes are searched once: each
    of 16 orders of the MinHash signatures is sorted over the cluster; documents
    that share the first two values or more are a region, a region with too many
    documents is cut at a greater depth, and sorted neighbours are compared
    besides.  The first pass confirms each document's best partners on whole
    sets; the second all candidates that are still in different components, so
    that a large group costs its links and not its pairs.  Classes of which a
    region in any order was too large for that, or cut by the end of a task, are
    joined exactly on their rarest shingles (``prefix_pairs``).  So a link at the
    limit is missed with a chance below 1 in 100,000 (no common region in 16
    orders, or a signature five standard deviations off), whatever the documents
    have in common.

    Null, empty and blank texts have an empty set and are linked with nothing; a
    row with a null doc_id is linked with nothing and kept, with a null
    component.  Rows that repeat count as copies of each other: all rows of a
    component's smallest doc_id are kept.  Rows that share a doc_id but not a
    text are compared as different documents.  An empty table gives no rows.
    """
    return _grouped(docs, doc_id, text).drop("text_hash")


def _in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the component of each digest as its group."""
    of = groups.select(F.col("node").alias("digest"), F.col("component").alias("group"))
    return rows.join(of, "digest", "left").withColumn("group", F.coalesce("group", "digest"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    spark, scratch = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        found, path = staged(df, name)
        scratch.append(path)
        return found

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = kept(described(plain), "signatures")
    linked = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"))
    classes = kept(classes, "classes")
    sketched = classes.select("digest", "signature").mapInArrow(_low_bytes, "digest binary, signature binary, sketch binary")
    best = _sorted_orders(sketched.withColumn("group", F.lit(None).cast("binary"))).mapInArrow(_search, _SEARCHED).select("a", "b").distinct()
    first = kept(best, "pairs")
    links = kept(confirmed(first, classes, plain), "confirmed")
    groups = kept(components(links), "groups")

    searched = _sorted_orders(_in_groups(sketched, groups)).mapInArrow(_search, _SEARCHED).distinct()
    searched = kept(searched.join(first, ["a", "b"], "left_anti"), "pairs")
    rest = searched.where("b IS NOT NULL").select("a", "b")
    links = links.union(kept(confirmed(rest, classes, plain), "confirmed"))
    groups = kept(components(links), "groups")

    hard = searched.where("b IS NULL")
    if not hard.isEmpty():
        marked = kept(_in_groups(hard.select(F.col("a").alias("digest")), groups), "marked")
        exact = prefix_pairs(marked, classes, plain, scratch).join(rest.union(first), ["a", "b"], "left_anti")
        exact = kept(exact, "pairs")
        groups = kept(components(links.union(kept(confirmed(exact, classes, plain), "confirmed"))), "groups")

    named = classes.join(groups.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.select("digest", "first_id", F.coalesce("component", "digest").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.join(splittable(least), "component").select("digest", "component_id")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = rows.join(ids, "digest", "left").select("doc_id", "text_hash", "n_shingles", known.alias("component_id"))
    out, _ = staged(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "grouped")
    for path in scratch:  # all that is left is a few numbers a row
        delete(spark, path)
    return out


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, and one row of it.

    Other cases: see ``near_duplicates``.
    """
    rows = _grouped(docs, doc_id, text).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "kept")
    names = unused(docs, "_doc_id", "_text_hash")
    gone = rows.where("NOT kept").distinct()
    again = rows.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1")

    def key(d: DataFrame) -> DataFrame:
        return d.select("doc_id", "text_hash").toDF(*names)

    marked = docs.withColumns(dict(zip(names, (F.col(doc_id).cast("long"), F.xxhash64(F.col(text))))))
    stay = marked.join(key(gone), names, "left_anti")
    single = stay.join(key(again), names, "left_anti")
    repeated = stay.join(key(again), names, "left_semi").dropDuplicates(names)
    return single.union(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
