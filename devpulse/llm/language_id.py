"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.llm.columns import set_aside
from devpulse.plans.files import delete, staged

#: n-grams kept of a language and of a document
PROFILE_SIZE = 300
#: the profiles are broadcast: at most so many languages
MOST_LANGUAGES = 2000
UNKNOWN = "und"
#: the share of documents of a known language that may score too low for it
MOST_LOST = 0.001
#: different scores that a language and extent must have before any score is too low for it
LEAST_SCORES = 30
#: labelled rows are scored by profiles of the other folds
FOLDS = 3
#: scores are counted in so many steps
_STEPS = 10_000
#: bytes of text taken apart at a time; a hundred times as many of memory
_SLICE = 2 << 20

#: an n-gram is a number: the code points of its letters, 21 bits each, zeros after a shorter one
_BITS = np.uint64(21)
_BLANK = np.uint64(32)
_LONE_BLANK = int(_BLANK << (_BITS + _BITS))


def gram_text(gram: int) -> str:
    """The letters of an n-gram."""
    return "".join(chr(c) for c in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


class Grams:
    """The 1-, 2- and 3-grams of each text of a batch: of words, that is runs of lower-cased letters, with a blank on both sides."""

    def __init__(self, texts: pa.Array) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        is_letter = np.zeros(0x110000, bool)
        is_letter[points] = True
        met = np.flatnonzero(is_letter)
        is_letter[met] = [chr(c).isalpha() for c in met.tolist()]
        # a blank before each text and after the last; other than letters become blanks
        line = np.full(len(points) + len(sizes) + 1, _BLANK, dtype=np.uint64)
        place = np.arange(len(points)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
        line[place] = np.where(is_letter[points], points, 32)
        kept = np.ones(len(line), bool)
        kept[1:] = (line[1:] != _BLANK) | (line[:-1] != _BLANK)  # runs of blanks are one
        self.bounds = (np.cumsum(kept) - 1)[np.concatenate(([0], np.cumsum(sizes + 1)))].tolist()
        line = line[kept]
        self.one = line << (_BITS + _BITS)
        self.two = self.one[:-1] | (line[1:] << _BITS)
        self.three = self.two[:-1] | line[2:]
        self.three[line[1:-1] == _BLANK] = 0  # no n-gram spans two words

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        """All n-grams of text i, with 0 and lone blanks among them."""
        a, b = self.bounds[i], self.bounds[i + 1]
        return np.concatenate((self.one[a + 1 : b], self.two[a:b], self.three[a : max(a, b - 1)]))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, how often each stands), without 0 and lone blanks."""
    grams = np.sort(grams)
    at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate((at, [len(grams)])))
    found = grams[at]
    real = (found != 0) & (found != _LONE_BLANK)
    return found[real], n[real]


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties in the order of a hash."""
    found, n = counted(grams)
    if len(found) > size:
        near = n >= np.partition(n, len(n) - size)[len(n) - size]
        found, n = found[near], n[near]
    return found[np.lexsort((words.mixed(found), -n))[:size]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text", _SLICE):
        grams = Grams(batch["text"])
        of: dict[tuple[str, int | None], list[np.ndarray]] = {}
        for i, key in enumerate(zip(batch["lang"].to_pylist(), batch["fold"].to_pylist())):
            of.setdefault(key, []).append(grams.of(i))
        for (lang, fold), parts in of.items():
            found, n = counted(np.concatenate(parts))
            keys = {"lang": pa.array([lang] * len(found), pa.string()), "fold": pa.array([fold] * len(found), pa.int32())}
            yield pa.record_batch({**keys, "gram": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})


def _labelled(docs: DataFrame, text: str, lang: str, fold: Column) -> DataFrame:
    taught = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return taught.select(F.col(lang).cast("string").alias("lang"), fold.cast("int").alias("fold"), F.col(text).alias("text"))


def _counts(labelled: DataFrame) -> DataFrame:
    return labelled.mapInArrow(_gram_counts, "lang string, fold int, gram long, n long")


def _most_frequent(counts: DataFrame, size: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select(*by, "gram", "rank")


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """One row per language and rank: lang, gram (see ``gram_text``), rank (0 for the most frequent n-gram).

    Counts cover whole texts of all rows.  Rows with a null text or language
    teach nothing.
    """
    counts = _counts(_labelled(docs, text, lang, F.lit(0))).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _most_frequent(counts, size, "lang")


def _profiles_by_fold(labelled: DataFrame, size: int) -> DataFrame:
    """Profiles of all rows (``without`` is -1), and of all rows but those of one fold (``without`` is the fold), from one count."""
    of_fold = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n_{f}") for f in range(FOLDS)]
    counts = _counts(labelled).groupBy("lang", "gram").agg(F.sum("n").alias("n_all"), *of_fold)
    others = [F.struct(F.lit(f).alias("without"), (F.col("n_all") - F.col(f"n_{f}")).alias("n")) for f in range(FOLDS)]
    views = F.array(F.struct(F.lit(-1).alias("without"), F.col("n_all").alias("n")), *others)
    return _most_frequent(counts.select("lang", "gram", F.inline(views)).where(F.col("n") > 0), size, "without", "lang")


class _Profiles:
    """The profiles as one table of ranks: a row for each n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.uint64))
        # the last row stands for n-grams in no profile
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), column[lang]] = rank

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The language at the least out-of-place distance, and 1 less that distance as a share of the largest."""
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[np.where(self.grams[at] == grams, at, -1)]
        places = np.abs(ranks - np.arange(len(grams), dtype=np.int32)[:, None])
        places[ranks < 0] = self.size
        away = places.sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.size * len(grams))


def _extent(n: int) -> int:
    """The class of a document by how many n-grams are compared: 1 to 3, 4 to 15, 16 to 63, 64 to 255 and so on."""
    return (n.bit_length() + 1) // 2


def _judged(docs: DataFrame, learned: DataFrame, text: str, size: int, least: Mapping[tuple[str, int], float] | None = None) -> DataFrame:
    """``docs`` plus ``_found``: what ``identify`` finds, the extent, and the least steps that a score of the language and extent should have."""
    rows = [tuple(r) for r in learned.limit(size * MOST_LANGUAGES + 1).collect()]
    if len(rows) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their profiles are too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast((_Profiles(rows, size), dict(least or {})))

    @F.pandas_udf("lang_pred string, score double, extent int, least double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        (known, steps), out = sent.value, []
        column = pa.record_batch({"text": pa.array(texts, type=pa.large_string(), from_pandas=True)})
        for part in words.slices([column], "text", _SLICE):
            grams = Grams(part["text"])
            for i in range(len(grams)):
                top = ranked(grams.of(i), size)
                found = known.nearest(top) if len(top) and known.langs else (UNKNOWN, 0.0)
                extent = _extent(len(top))
                out.append((*found, extent, steps.get((found[0], extent), 0.0)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "extent", "least"])

    return docs.withColumn("_found", nearest(F.col(text)))


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """The columns of ``docs`` plus ``lang_pred`` and ``score`` (0 to 1).

    ``learned`` is what ``profiles`` returns for the same size; it is broadcast
    (``size`` rows for each of at most ``MOST_LANGUAGES`` languages).  A
    document's most frequent 1- to 3-grams are compared rank by rank with each
    profile; the least sum of out-of-place distances wins, ties go to the
    language that sorts first.  The score is 1 less the share of the largest
    possible distance.

    A text that is null, empty or without any letter, and any text when nothing
    was learned, gives ``und`` with score 0.  Rows are judged one by one: repeated
    rows get equal results, an empty table none.  Columns named ``lang_pred`` or
    ``score`` are replaced.
    """
    found = _judged(docs, learned, text, size)
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def _fold(of: str, folds: int) -> Column:
    return F.crc32(F.col(of).cast("string")) % folds


def held_out(of: str, folds: int, fold: int):
    """True for the rows of one fold, by the CRC of the id as text; a null id is in none."""
    return F.coalesce(_fold(of, folds) == fold, F.lit(False))


def _score_counts(judged: DataFrame) -> DataFrame:
    """How many rows of each language, extent and step had their language found."""
    right = F.when(F.col("_found.lang_pred") == F.col("lang"), True)  # a filter on it would take the texts apart twice
    group = [F.col("lang"), F.col("_found.extent").alias("extent"), F.floor(F.col("_found.score") * _STEPS).alias("step")]
    return judged.groupBy(*group).agg(F.count(right).alias("n")).where(F.col("n") > 0)


def _least_steps(judged: DataFrame) -> dict[tuple[str, int], float]:
    """For each language and extent the steps that all but ``MOST_LOST`` of its rows have, from labelled rows with ``_found``.

    Only rows whose language was found count.  With too few different scores to
    meet that share, the distance from the middle to the lowest is drawn out as
    far as the share lies from the middle of a normal distribution; with fewer
    than ``LEAST_SCORES`` there is no entry.
    """
    counts = _score_counts(judged)
    all_steps = Window.partitionBy("lang", "extent")
    told = counts.withColumns({"upto": F.sum("n").over(all_steps.orderBy("step")), "n": F.sum("n").over(all_steps)})
    found = told.groupBy("lang", "extent").agg(
        F.count("*").alias("different"),
        F.min("step").alias("lowest"),
        F.min(F.when(F.col("upto") >= F.floor((F.col("n") + 1) * MOST_LOST), F.col("step"))).alias("kept"),
        F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("step"))).alias("middle"),
    )
    least = {}
    for r in found.where(F.col("different") >= LEAST_SCORES).collect():
        lowest_share = 1 / (r.different + 1)
        if lowest_share <= MOST_LOST:
            least[r.lang, r.extent] = float(r.kept)
        else:
            normal = NormalDist()
            least[r.lang, r.extent] = r.middle - (r.middle - r.lowest) * normal.inv_cdf(MOST_LOST) / normal.inv_cdf(lowest_share)
    return least


def drop_unknown(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least_score: float = 0.0) -> DataFrame:
    """``docs`` without the documents of no known language.

    The known languages are those of all labelled rows.  A document goes when it
    is ``und``, when it shares no n-gram with a language, when its score is below
    ``least_score``, and when its score is too low for a document of the language
    nearest to it: below what all but ``MOST_LOST`` of the labelled rows of that
    language with about as many n-grams have.  For this each labelled row is
    scored by profiles that were learned without its fold.

    A language and extent of fewer than ``LEAST_SCORES`` different scores has no
    such bound: too few rows tell what is too low.
    """

    def kept(docs: DataFrame) -> DataFrame:
        labelled = _labelled(docs, text, lang, _fold(doc_id, FOLDS))
        learned, path = staged(_profiles_by_fold(labelled, PROFILE_SIZE), "language_profiles")

        def without(fold: int) -> DataFrame:
            return learned.where(F.col("without") == fold).drop("without")

        scored = [_judged(labelled.where(F.col("fold") == f), without(f), "text", PROFILE_SIZE) for f in range(FOLDS)]
        found = _judged(docs, without(-1), text, PROFILE_SIZE, _least_steps(reduce(DataFrame.unionAll, scored)))
        delete(docs.sparkSession, path)
        score = F.col("_found.score")
        known = (F.col("_found.lang_pred") != UNKNOWN) & (score > 0) & (score >= least_score) & (score * _STEPS >= F.col("_found.least"))
        return found.where(known).select(*(F.col(f"`{c}`") for c in docs.columns))

    return set_aside(docs, ("_found",), kept)
