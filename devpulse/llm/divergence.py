"""Source divergence audit (operator 13): how the words of a source differ from those of the others of its language.

Method: length-bucketed packing.  A task cuts a few MB of text at a time into terms;
terms of at most 8 bytes become one uint64, of at most 16 bytes two, and are
radix-sorted by 16 bits at a time; longer ones go to one byte-sorted bucket for each
power of two of their length.  Runs of equal terms are counted in numpy.  Spark adds
the counts up, keeps the terms of each language, and compares sources in tiles: a
task gets the shares of some hundred terms in at most two blocks of sources.

A document is a row, so a repeated `doc_id` counts each time.  A null text has no term;
a null language or source counts as ''.  An empty table gives no row.  Other columns of the
input are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.plans.files import staged

#: a term stands in at least so many documents of its language
LEAST_DOCS = 30
#: terms of a group that the report names
TERMS = 50
#: added to each count, and the scale of a share
PRIOR, SCALE = 5, 1_000_000_000
#: terms, and sources of each side, that one task compares at a time
TILE_TERMS, TILE_SOURCES = 128, 256
#: text taken apart at a time
SLICE_BYTES = 8 << 20

_COUNTS = "lang string, source string, term string, n long, docs long"
_LETTER = np.array([b >= 128 or 65 <= (b & ~32) <= 90 for b in range(256)])


def _order(keys: Iterable[np.ndarray]) -> np.ndarray:
    """A stable order by several unsigned keys, the least significant first: a radix sort by 16 bits.

    numpy sorts 16-bit values by radix.  Digits that are equal everywhere are passed over.
    """
    order = None
    for key in keys:
        for shift in range(0, key.itemsize * 8, 16):
            digit = ((key >> key.dtype.type(shift)) & key.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() == digit.max():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order if order is not None else np.arange(len(key))


def _runs(different: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted terms: where each run begins, its length, and its number of documents."""
    first = np.flatnonzero(np.concatenate(([True], different)))
    new_doc = np.concatenate(([True], different | (docs[1:] != docs[:-1])))
    return first, np.diff(np.append(first, len(docs))), np.add.reduceat(new_doc.astype(np.int64), first)


def _changes(*keys: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def _counted(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of texts ``data[starts[i]:starts[i + 1]]``, in one part for each bucket."""
    letter = _LETTER[data]
    bounds = starts[1:-1][starts[1:-1] < len(data)]
    before, after = np.roll(letter, 1), np.roll(letter, -1)
    before[:1] = after[-1:] = False
    before[bounds] = False
    after[bounds[bounds > 0] - 1] = False
    begin, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    size = end - begin
    doc = np.searchsorted(starts, begin, side="right") - 1
    # the bucket's width is a power of two of at least 8
    width = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    padded = np.concatenate((words.LOWER[data], np.zeros(int(width.max(initial=8)), np.uint8)))
    for wide in np.unique(width).tolist():
        mine = width == wide
        at, many, of = begin[mine], size[mine], doc[mine]
        spelled = np.lib.stride_tricks.sliding_window_view(padded, wide)[at]
        spelled *= np.arange(wide) < many[:, None]
        g = group[of]
        if wide <= 16:
            packed = [np.ascontiguousarray(spelled[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in range(0, wide, 8)]
            order = _order([*reversed(packed), g])
            packed, g, of = [w[order] for w in packed], g[order], of[order]
            first, n, docs = _runs(_changes(g, *packed), of)
            text = np.stack([w[first] for w in packed], axis=1).astype(">u8").view(f"S{wide}").ravel()
        else:
            text = np.ascontiguousarray(spelled).view(f"S{wide}").ravel()
            order = np.argsort(text, kind="stable")
            order = order[_order([g[order]])]
            text, g, of = text[order], g[order], of[order]
            first, n, docs = _runs(_changes(g, text), of)
            text = text[first]
        yield g[first], text.tolist(), n, docs


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, source and term; each group also has a row with the empty term."""
    for batch in words.slices(batches, "text", SLICE_BYTES):
        groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        pairs = {}
        group = np.array([pairs.setdefault((x["lang"], x["source"]), len(pairs)) for x in groups.to_pylist()], np.uint32)
        names = list(pairs)
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        parts = [(np.arange(len(names)), [b""] * len(names), np.zeros(len(names), np.int64), np.bincount(group))]
        if len(data):
            parts += _counted(data, starts - starts[0], group)
        for of, terms, n, docs in parts:
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(of)) for i in (0, 1))
            term = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group.

    A group's row with the empty term has its number of documents.
    """
    none = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counts = docs.select(*none).mapInArrow(_count_terms, _COUNTS)
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in whole numbers of 38 digits."""
    return F.expr(
        f"1L + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0))"
    )


def _tile(rows: pa.Table) -> pa.Table:
    """Of some terms: the summed differences of each two sources, one of each block, and how many terms there were."""
    known = rows.filter(pc.is_valid(rows["term"]))
    sources = rows.filter(pc.is_null(rows["term"])).sort_by("no")
    no, base, name = sources["no"].to_numpy(), sources["base"].to_numpy(), sources["source"]
    terms = known["term"].combine_chunks().dictionary_encode()
    share = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    share[np.searchsorted(no, known["no"].to_numpy()), terms.indices.to_numpy(zero_copy_only=False)] = known["p"].to_numpy()
    block = sources["block"].to_numpy()
    left, right, value = [], [], []
    for i in range(int((block == block[0]).sum())):
        # of two blocks each pair has one source of either; of one block each pair comes once
        others = np.flatnonzero(block != block[0]) if block[-1] != block[0] else np.arange(i + 1, len(no))
        left.append(np.full(len(others), i))
        right.append(others)
        value.append(np.abs(share[others] - share[i]).sum(axis=1))
    left, right = np.concatenate(left), np.concatenate(right)
    n = len(left)
    return pa.table(
        {
            "lang": pa.array([rows["lang"][0].as_py()] * n, pa.string()),
            "a": name.take(pa.array(left)),
            "b": name.take(pa.array(right)),
            "met": pa.array(np.concatenate(value), pa.int64()),
            "seen": pa.array(np.full(n, len(terms.dictionary)), pa.int64()),
            "gap": pa.array(np.abs(base[left] - base[right]), pa.int64()),
            "terms": pa.array([rows["terms"][0].as_py()] * n, pa.int64()),
        }
    )


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of each two sources of a language, a before b.

    Each block of terms meets once for each two blocks of sources.  What neither source
    has differs by their bases, and is added as one product for each pair.
    """
    blocks = F.expr(f"greatest(1L, (terms + {TILE_TERMS - 1}) div {TILE_TERMS})")
    marks = groups.select("lang", "source", "no", "terms", "sources", "base", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("part"))
    rows = (
        shares.select("lang", "source", "no", "terms", "sources", "base", F.pmod(F.xxhash64("term"), blocks).alias("part"), "term", "p")
        .unionByName(marks, allowMissingColumns=True)
        .withColumns({"block": F.expr(f"no div {TILE_SOURCES}"), "other": F.explode(F.expr(f"sequence(0L, (sources - 1) div {TILE_SOURCES})"))})
        .withColumns({"u": F.least("block", "other"), "v": F.greatest("block", "other")})
        .select("lang", "part", "u", "v", "no", "block", "source", "base", "terms", "term", "p")
    )
    tiles = rows.groupBy("lang", "part", "u", "v").applyInArrow(
        _tile, "lang string, a string, b string, met long, seen long, gap long, terms long"
    )
    unseen = (F.max("terms") - F.sum("seen")) * F.max("gap")
    return tiles.groupBy("lang", "a", "b").agg((F.sum("met") + unseen).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    ``pair``: every other source of the language and the summed differences of shares over
    all kept terms (0 in a language that keeps none).  ``term``: the kept terms that the
    source uses, with a larger share than its language, up to rank ``most_terms``.  Equal
    values rank by item.  Shares are whole numbers; nothing is rounded on the way.
    """
    together = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns(
        {
            "lang_n": F.sum("n").over(together),
            "lang_docs": F.sum("docs").over(together),
            "is_first": F.min("source").over(together) == F.col("source"),
        }
    )
    kept, _ = staged(counts.where((F.col("lang_docs") >= least_docs) | (F.col("term") == "")).drop("lang_docs", "docs"), "kept_terms")
    totals = kept.groupBy("lang").agg(
        F.count_if(F.col("is_first") & (F.col("term") != "")).alias("terms"),
        F.sum("n").alias("lang_total"),
        F.count_if(F.col("term") == "").alias("sources"),
    )
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    base = F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = sums.join(totals, "lang").withColumns({"base": base, "no": number})
    shares = (
        kept.where("term != ''")
        .join(groups, ["lang", "source"])
        .withColumns({"p": _share("n", "total", "terms"), "q": _share("lang_n", "lang_total", "terms")})
    )

    both = F.expr("explode(array(named_struct('source', a, 'item', b), named_struct('source', b, 'item', a)))")
    pairs = _pairs(shares, groups).select("lang", both.alias("of"), "value").select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))
