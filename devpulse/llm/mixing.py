"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.plans.files import delete, staged

#: rounds of fitting at most, and the largest relative difference to a target at which it ends
ROUNDS, CLOSE = 25, 1e-3
#: share of all tokens to sample
KEPT_SHARE = 0.5
_SEED = 8
_WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: str = "text") -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def topic(text: str = "text") -> Column:
    """A coarse kind of text by plain signs of its layout."""
    c = F.col(text)
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty")
        .when(F.regexp_count(c, F.lit(r" \| ")) >= 5, "table")
        .when(c.rlike(r"(?i)licen[cs]e|copyright"), "notice")
        .when(c.rlike(r"\S@\S|https?://"), "contact")
        .when(F.regexp_count(c, F.lit(r"\n")) * 400 >= F.length(c), "lines")
        .otherwise("prose")
    )


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal."""
    renamed = right.select(*(F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns))
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    return left.join(renamed, same).drop(*(f"_{k}" for k in keys))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to a power of the present ones; 0 makes all values equal."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("n"))
    whole = _total(sums)
    return sums.select(dimension, (F.col("n") / F.lit(whole) if whole else F.lit(0.0)).alias("share"))


def _total(df: DataFrame) -> float:
    """The sum of ``n``; one number reaches the driver."""
    return float(df.agg(F.sum("n")).first()[0] or 0)


def _fitted_to(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    """Weights scaled so that the dimension's sums are the target's; ``off`` gathers the largest difference met."""
    sums = cells.groupBy(dimension).agg(F.sum(F.col("n") * F.col("weight")).alias("now"))
    factor = _joined(sums, target, [dimension]).select(dimension, F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("factor"))
    out = _joined(cells, factor, [dimension])
    off = F.greatest(F.col("off"), F.abs(F.col("factor") - 1))
    return out.withColumns({"off": off, "weight": F.col("weight") * F.col("factor")}).drop("factor")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``cells`` with ``weight``: weighted tokens meet the target share of every value of every dimension.

    ``cells`` has the dimensions and ``n``, the tokens; ``targets`` maps each
    dimension to its values and their ``share``.  Dimensions are fitted in turn;
    after each round the cells are written to the shared folder, and fitting ends
    when no sum had to change by more than ``close``.  Weighted tokens add up to
    1.  Values without a target, and cells without tokens, get weight 0.
    """
    spark = cells.sparkSession
    whole = _total(cells)
    now, path = staged(cells.withColumn("weight", F.lit(1 / whole if whole else 0.0)), "cells")
    fixed = {d: staged(t, "target")[0] for d, t in targets.items()}
    for _ in range(rounds):
        step = now.withColumn("off", F.lit(0.0))
        for dimension, target in fixed.items():
            step = _fitted_to(step, dimension, target)
        fresh, fresh_path = staged(step, "cells")
        delete(spark, path)
        path, now = fresh_path, fresh.drop("off")
        off = fresh.where("weight > 0").agg(F.max("off")).first()[0]
        if off is None or off <= close:
            break
    return now


def rate(cells: DataFrame, kept_share: float = KEPT_SHARE) -> float:
    """The factor with which min(1, factor * relative weight) keeps the wanted share of tokens, found by water filling.

    The relative weight of a cell is its weight over the mean.  Only sums reach the driver.
    """
    whole = _total(cells)
    wanted, factor = kept_share * whole, kept_share
    for _ in range(60):
        relative = F.col("weight") * F.lit(whole)
        full = F.col("n").cast("double") * (factor * relative >= 1).cast("double")
        part = F.col("n") * relative * (factor * relative < 1).cast("double")
        capped, open_tokens = cells.agg(F.sum(full), F.sum(part)).first()
        if not open_tokens or capped >= wanted:
            break
        better = (wanted - capped) / open_tokens
        if better <= factor * (1 + 1e-9):
            break
        factor = better
    return factor


def mixed(
    docs: DataFrame,
    powers: Mapping[str, float],
    kept_share: float = KEPT_SHARE,
    doc_id: str = "doc_id",
    tokens: str = "n_tokens",
) -> DataFrame:
    """The columns of ``docs`` plus ``weight``, ``probability`` and ``sampled``.

    ``powers`` names the dimensions, which are columns of ``docs``, and for each
    the power to which its values' shares of tokens are tempered to give the
    target (1 leaves them, 0 makes them equal).  Documents are summed up into
    cells first, so that a hot source is one row from each task; the cells are
    raked, and their weights joined to the documents.

    A document is sampled with min(1, r * weight * tokens of the table), where r
    keeps ``kept_share`` of all tokens in expectation; the draw is a hash of the
    doc_id, so that it repeats, and copies of a row are drawn together.

    A null is a value of a dimension like others.  Documents without tokens have
    weight and probability of their cell; a cell without any token has 0.  An
    empty table gives no rows.  Columns named like a result are replaced.
    """
    keys = list(powers)
    results = ("weight", "probability", "sampled")
    plain = docs.drop(*results)
    cells, _ = staged(plain.groupBy(*keys).agg(F.sum(tokens).alias("n")), "cells")
    weighted = rake(cells, {d: tempered(cells, d, p) for d, p in powers.items()})
    factor = rate(weighted, kept_share)
    chance = F.least(F.lit(1.0), F.col("weight") * F.lit(_total(weighted)) * F.lit(float(factor)))
    drawn = F.pmod(F.xxhash64(F.col(doc_id), F.lit(_SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = _joined(plain, weighted.drop("n"), keys).withColumn("probability", chance)
    return out.withColumn("sampled", drawn < F.col("probability"))
