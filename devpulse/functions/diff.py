"""Diff text from stored commit data and its cut to a size budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker text, section heads and file defaults of the diff format.
TRUNCATION_MARKER = "\n\n[truncated: remaining files omitted due to size limit]"
DEFAULT_FILENAME = "unknown"
DEFAULT_STATUS = "modified"
DIFF_BUDGET = 30_000

# Fixed value: where a section starts.  `d` restricts line starts to "\n"; without
# it "\r" would also start a section.
_SECTION_START = "(?md)(?=^diff --git |^--- a/)"
# Everything that counts as white space, including the separators U+001C-U+001F.
_VISIBLE = r"(?U)[^\s\x{1c}-\x{1f}]"


def file_block(f: Column) -> Column:
    """One changed file as header lines, patch and a closing empty line."""
    name = F.coalesce(f["filename"], F.lit(DEFAULT_FILENAME))
    status = F.coalesce(f["status"], F.lit(DEFAULT_STATUS))
    return F.concat(
        F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\nStatus: "), status, F.lit("\n"), f["patch"], F.lit("\n")
    )


def assemble_diff(raw_data: Column) -> Column:
    """The stored diff if there is one, else one block per patched file."""
    with_patch = F.filter(raw_data["files"], lambda f: F.coalesce(F.length(f["patch"]), F.lit(0)) > 0)
    built = F.array_join(F.transform(with_patch, file_block), "\n")
    return F.coalesce(F.nullif(raw_data["diff"], F.lit("")), built, F.lit(""))


def truncate_diff(df: DataFrame, source: str, target: str, max_chars: int = DIFF_BUDGET) -> DataFrame:
    """Keep leading whole sections within the budget, then mark the cut.

    The fold carries only lengths: it counts how many leading sections fit and
    stops for good at the first one that does not.  Sections and count are
    separate projections so that each text is split and folded once.
    """
    room = max_chars - len(TRUNCATION_MARKER)
    if room <= 0:
        raise ValueError("max_chars must exceed the length of the truncation marker")
    text = F.col(source)
    sections = F.filter(F.split(text, _SECTION_START), lambda s: s.rlike(_VISIBLE))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(acc: Column, section: Column) -> Column:
        size = F.length(section).cast("long")
        fits = acc["open"] & (acc["used"] + size <= F.lit(room))
        return F.struct(
            (acc["used"] + F.when(fits, size).otherwise(F.lit(0).cast("long"))).alias("used"),
            (acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"),
            fits.alias("open"),
        )

    kept = F.aggregate(F.col("_sections"), start, step, lambda acc: acc["kept"])
    head = F.array_join(F.slice(F.col("_sections"), F.lit(1), F.col("_kept")), "")
    marked = F.concat(F.col("_head"), F.when(F.length("_head") < F.length(text), F.lit(TRUNCATION_MARKER)).otherwise(""))
    hard_cut = F.concat(F.substring(text, 1, room), F.lit(TRUNCATION_MARKER))
    return (
        # short texts need no sections at all
        df.withColumn("_sections", F.when(F.length(text) > max_chars, sections))
        .withColumn("_kept", kept)
        .withColumn("_head", head)
        .withColumn(
            target,
            F.when(F.col("_sections").isNull(), text).when(F.col("_kept") == 0, hard_cut).otherwise(marked),
        )
        .drop("_sections", "_kept", "_head")
    )
