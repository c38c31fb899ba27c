"""Removal of passages that already stand earlier in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.llm.automaton import SuffixAutomaton
from devpulse.llm.columns import set_aside
from devpulse.llm.spans import united, without
from devpulse.plans.files import delete, staged

WINDOW = 20
#: an anchor is a run of so many words
ANCHOR = 6
#: an anchor with more occurrences is dealt out window by window
HOT = 2000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + size] for each i."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


class _Text:
    """One batch of texts as words, with the anchor of each window.

    A window's anchor is the least hash of the ANCHOR-word runs in it, so equal
    windows have equal anchors wherever they stand, and neighbours mostly share theirs.
    """

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.window = window
        self.words = words.split(texts)
        self.hash_of = words.hashes(self.words.vocab)
        self.inside = window - min(ANCHOR, window) + 1  # runs in a window

    def doc(self, i: int) -> np.ndarray:
        return self.words.ids[self.words.offsets[i] : self.words.offsets[i + 1]]

    def spelled(self, ids: np.ndarray) -> bytes:
        vocab = self.words.vocab
        return b" ".join([vocab[k] for k in ids.tolist()])

    def runs(self, ids: np.ndarray) -> np.ndarray:
        return words.shingle_hashes(self.hash_of[ids], min(ANCHOR, self.window))

    def window_anchors(self, ids: np.ndarray) -> np.ndarray:
        return _sliding(self.runs(ids), self.inside, np.minimum)

    def chosen(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs that are the anchor of some window, by their hashes, and in how many places each stands."""
        runs = self.runs(ids)
        least = _sliding(runs, self.inside, np.minimum)
        edge = np.zeros(self.inside - 1, np.uint64)
        most = _sliding(np.concatenate((edge, least, edge)), self.inside, np.maximum)
        return np.unique(runs[runs == most], return_counts=True)


def _version(spelled: bytes) -> int:
    return int.from_bytes(hashlib.sha256(spelled).digest()[:8], "big", signed=True)


def _described(window: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            texts = _Text(batch["text"], window)
            docs = [texts.doc(i) for i in range(batch.num_rows)]
            digests = [hashlib.sha256(texts.spelled(d)) for d in docs]
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            chosen = [texts.chosen(d) if len(d) >= window else none for d in docs]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_words": pa.array([len(d) for d in docs], pa.int64()),
                    "digest": pa.array([d.hexdigest() for d in digests]),
                    "version": pa.array([int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests], pa.int64()),
                    "anchors": pa.array([a.view(np.int64) for a, _ in chosen], pa.list_(pa.int64())),
                    "times": pa.array([n for _, n in chosen], pa.list_(pa.int32())),
                }
            )

    return describe


_SEGMENT = "key long, segment binary, doc_id long, version long, start int"


def _segments(window: int):
    """Rows (doc_id, text, anchors, hot) to the passages whose windows have one of these anchors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 4 << 20):
            texts = _Text(batch["text"], window)
            out: list[tuple] = []
            for i, (doc_id, anchors, hot) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", "anchors", "hot")))):
                ids = texts.doc(i)
                if len(ids) < window:
                    continue
                known = dict(zip(anchors, hot))
                at = texts.window_anchors(ids).view(np.int64)
                wanted = np.isin(at, np.fromiter(known, np.int64, len(known)))
                breaks = np.concatenate(([True], at[1:] != at[:-1], [True]))
                starts = np.flatnonzero(breaks)
                version = _version(texts.spelled(ids))
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    if not wanted[a]:
                        continue
                    anchor = int(at[a])
                    if known[anchor]:
                        single = words.shingle_hashes(texts.hash_of[ids[a : b - 1 + window]], window).view(np.int64)
                        out += [(int(k), texts.spelled(ids[w : w + window]), doc_id, version, w) for w, k in enumerate(single, a)]
                    else:
                        out.append((anchor, texts.spelled(ids[a : b - 1 + window]), doc_id, version, a))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "segment", "doc_id", "version", "start"])

    return cut


_VERDICT = "key long, segment binary, doc_id long, version long, start int, repeated array<int>"


def _matched(window: int):
    """First occurrences sorted by key and place to the windows of each that stand earlier.

    The segments of one key are a reference shard: an automaton takes them in the
    order of the corpus and tells, word by word, the longest run met before.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton = None, SuffixAutomaton()
        for batch in batches:
            repeated = []
            for k, segment in zip(batch["key"].to_pylist(), batch["segment"].to_pylist()):
                if k != key:
                    key, automaton = k, SuffixAutomaton()
                lengths = automaton.add(segment.split())
                repeated.append([i - window + 1 for i, n in enumerate(lengths) if n >= window])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("key", "segment", "doc_id", "version", "start")), pa.array(repeated, pa.list_(pa.int32()))],
                ["key", "segment", "doc_id", "version", "start", "repeated"],
            )
        words.release()

    return match


def repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, digest, version and spans for each row of ``docs``.

    Words stand between ASCII white space and count unchanged.  ``spans`` are the
    ranges [start, end) of words covered by windows of ``window`` words that also
    start earlier: in a document with a smaller doc_id, or earlier in the same
    one.  ``digest`` is the SHA-256 of the words joined by one space.

    Every window is looked for in the whole corpus.  Whole copies of a text are
    found by their digest.  In the rest, windows with equal words share an
    anchor, the least hash of the six-word runs in them; anchors that occur once
    are left aside.  Passages under the others are dealt out by anchor, equal
    passages are combined, and each anchor's passages pass through a suffix
    automaton in corpus order.  An anchor with many occurrences is dealt out by
    whole windows, so that no key gathers more passages than a task can hold.

    Null, empty and short texts have no windows.  A row with a null doc_id is
    compared with nothing.  Equal rows have equal spans and do not repeat each
    other; rows that share a doc_id but not a text are ordered by a hash of the
    text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, n_words long, digest string, version long, anchors array<long>, times array<int>"
    described, described_at = staged(plain.mapInArrow(_described(window), kind), "anchors")
    long_enough = described.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long_enough.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = described.drop("anchors", "times").join(first, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    rows, _ = staged(marked.drop("first_id"), "rows")

    firsts = first.select("digest", F.col("first_id").alias("doc_id"))
    found = long_enough.join(firsts, ["digest", "doc_id"], "left_semi")
    places = found.select("doc_id", F.explode(F.arrays_zip("anchors", "times")).alias("at")).select("doc_id", F.col("at.anchors").alias("anchor"), "at.times")
    often = places.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot"))
    # written down, so that the join below has two shuffled sides and a frequent anchor can be split
    often, often_at = staged(often, "often")
    wanted = places.drop("times").join(often, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "hot")).alias("at"))
    wanted, wanted_at = staged(wanted.select("doc_id", F.col("at.anchor").alias("anchors"), F.col("at.hot").alias("hot")), "wanted")
    delete(spark, described_at)
    delete(spark, often_at)

    segments, segments_at = staged(plain.join(wanted, "doc_id").mapInArrow(_segments(window), _SEGMENT), "segments")
    earliest = segments.groupBy("key", "segment").agg(F.min(F.struct("doc_id", "version", "start")).alias("at"))
    earliest = earliest.select("key", "segment", "at.*").repartition("key").sortWithinPartitions("key", "doc_id", "version", "start")
    verdicts = earliest.mapInArrow(_matched(window), _VERDICT)
    told = verdicts.select("key", F.xxhash64("segment").alias("of"), F.struct("doc_id", "version", "start").alias("first"), "repeated")
    own = segments.select("key", F.xxhash64("segment").alias("of"), "doc_id", "version", "start", F.size(F.split(F.col("segment").cast("string"), " ")).alias("n"))
    at = F.struct("doc_id", "version", "start")
    every = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n")).alias("end")))
    some = F.transform("repeated", lambda i: F.struct((F.col("start") + i).alias("start"), (F.col("start") + i + window).alias("end")))
    met = own.join(told, ["key", "of"]).select("doc_id", "version", F.when(at == F.col("first"), some).otherwise(every).alias("parts"))
    met = met.where(F.size("parts") > 0).groupBy("doc_id", "version").agg(F.flatten(F.collect_list("parts")).alias("spans"))
    spans, _ = staged(met.mapInArrow(_united, f"doc_id long, version long, spans {_SPANS}"), "spans")
    delete(spark, segments_at)
    delete(spark, wanted_at)

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast(_SPANS)
    out = rows.join(spans, ["doc_id", "version"], "left")
    chosen = F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none))
    return out.select("doc_id", "n_words", "digest", "version", chosen.alias("spans"))


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in united((s["start"], s["end"]) for s in row)] for row in batch["spans"].to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(spans, kind)], ["doc_id", "version", "spans"])


def n_removed(spans: str = "spans"):
    """The number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _kept_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        texts = words.split(batch["text"])
        out = []
        for i, (doc_id, version, spans) in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", "version", "spans")))):
            own = [texts.vocab[k] for k in texts.ids[texts.offsets[i] : texts.offsets[i + 1]].tolist()]
            if _version(b" ".join(own)) != version:
                continue  # another text under the same id
            for s in reversed(spans):
                del own[s["start"] : s["end"]]
            out.append((doc_id, version, hashlib.sha256(b" ".join(own)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "version", "kept_sha256"])


def kept_digests(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the SHA-256 of the kept words joined by one space.

    ``passages`` is what ``repeated_passages`` found in ``docs``.  Only texts
    that lose some words but not all are read again.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = passages.withColumn("n_removed", n_removed())
    partly = counted.where((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))).select("doc_id", "version", "spans")
    kept = plain.join(partly.distinct(), "doc_id").mapInArrow(_kept_digests, "doc_id long, version long, kept_sha256 string").distinct()
    rest = F.when(F.col("n_removed") == 0, F.col("digest")).otherwise(F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)))
    out = counted.join(kept, ["doc_id", "version"], "left")
    return out.select("doc_id", "n_words", "n_removed", rest.alias("kept_sha256"))


def remove_repeated(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages that stand earlier in the corpus.

    Spans go with what stands between their words; the rest of a text stays as
    it is.  Documents of which no word is left go; those that had none stay.  A
    column ``n_chars`` is brought up to date.  Other cases: see ``repeated_passages``.
    """
    return set_aside(docs, ("_doc_id", "_of", "_cut"), lambda docs: _removed(docs, window, doc_id, text))


def _removed(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    found = repeated_passages(docs, window, doc_id, text).where(F.size("spans") > 0)
    gone = n_removed() == F.col("n_words")
    # a document's texts under one id, each with its spans
    of = found.select(F.col("doc_id").alias("_doc_id"), F.struct("version", "spans", gone.alias("gone")).alias("_of")).distinct()
    of = of.groupBy("_doc_id").agg(F.collect_list("_of").alias("_of"))
    joined = docs.join(of, F.col(doc_id).cast("long") == F.col("_doc_id"), "left")
    cut = F.pandas_udf(_cut_any, "string")
    lost = F.col("_of").isNotNull()
    out = joined.withColumn("_cut", F.when(lost, cut(F.col(text), F.col("_of"))).otherwise(F.col(text)))
    out = out.where(~lost | F.col("_cut").isNotNull()).withColumn(text, F.col("_cut"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _cut_any(texts: pd.Series, of: pd.Series) -> pd.Series:
    """Each text without its spans; null where no word is left."""
    out = []
    for text, found in zip(texts, of):
        if text is not None and found is not None:
            version = _version(b" ".join(text.encode().split()))
            for one in found:
                if one["version"] == version:
                    text = None if one["gone"] else without(text, [(s["start"], s["end"]) for s in one["spans"]], WORD)
        out.append(text)
    return pd.Series(out, dtype=object)
