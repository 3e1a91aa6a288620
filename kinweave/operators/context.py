"""Scores of a pair in the context of its rivals, all by windows over ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import logit


def _view(p: Column, keys: list[str], tie: str, suffix: str) -> dict[str, Column]:
    """Rank, gap to the best, group size and margin among the rows with the same keys."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.desc("p"), tie)
    rn = F.row_number().over(order)
    best = F.max("p").over(group)
    second = F.coalesce(F.nth_value("p", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return {
        f"ctx_rank_{suffix}": rn,
        f"ctx_gap_{suffix}": best - p,
        f"ctx_n_{suffix}": F.count("*").over(group),
        f"ctx_margin_{suffix}": F.when(rn == 1, p - second).otherwise(p - best),
    }


def context_features(scored: DataFrame, reverse: bool = True, extra: list[str] | None = None) -> DataFrame:
    """scored(s1_id, src, tgt_id, p) with the context columns.

    By query record and source, by query record, by target (only if reverse: it needs every query record's pairs),
    and the best score of the other source, null without one.  extra: further columns of every partition.
    """
    more = extra or []
    p = F.col("p")
    entity = Window.partitionBy("s1_id", *more)
    best = {s: F.max(F.when(F.col("src") == s, p)).over(entity) for s in (2, 3)}
    columns = _view(p, ["s1_id", "src", *more], "tgt_id", "es") | {
        "ctx_sum_e": F.sum("p").over(entity),
        "ctx_n_hi_e": F.sum(F.when(p > 0.5, 1).otherwise(0)).over(entity),
        "ctx_other_src_max": F.when(F.col("src") == 2, best[3]).otherwise(best[2]),
    }
    if reverse:
        columns |= _view(p, ["src", "tgt_id", *more], "s1_id", "rev")
    return scored.withColumns(columns)


def with_logit(scored: DataFrame) -> DataFrame:
    return scored.withColumn("logit_p", logit(F.col("p")))
