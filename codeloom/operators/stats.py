"""Paired-experiment statistics over benchmark runs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import scalars as X


def blocks(runs: DataFrame, arms: list[str]) -> DataFrame:
    """``block_id, state, missing``: matched (all arms, none excluded), excluded or incomplete. runs: ``block_id, arm_id, excluded``."""
    wanted = F.array(*[F.lit(a) for a in sorted(arms)])
    by = runs.where(F.col("arm_id").isin(arms)).groupBy("block_id").agg(F.array_sort(F.collect_set("arm_id")).alias("present"), F.bool_or(F.coalesce("excluded", F.lit(False))).alias("bad"))
    missing = F.array_except(wanted, F.col("present"))
    return by.select("block_id", F.when(F.col("bad"), "excluded").when(F.size(missing) > 0, "incomplete").otherwise("matched").alias("state"), F.array_join(missing, ",").alias("missing"))


def arm_stats(runs: DataFrame) -> DataFrame:
    """Per arm: runs, success rate, medians (the middle pair is averaged, null isn't 0), null counts."""
    return runs.groupBy("arm_id").agg(
        F.count("*").alias("n_runs"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.median("tokens").alias("median_tokens"),
        F.median("wall_ms").alias("median_wall_ms"),
        F.count_if(F.col("tokens").isNull()).alias("n_null_tokens"),
    )


def pairs(runs: DataFrame, arms: list[str]) -> DataFrame:
    """``block_id, treatment, baseline, token_diff, success_diff`` for all pairs of arms in matched blocks."""
    matched = blocks(runs, arms).where("state = 'matched'").select("block_id")
    kept = runs.join(matched, "block_id", "left_semi")
    wide = kept.groupBy("block_id").pivot("arm_id", arms).agg(F.first("tokens").alias("tokens"), F.first(F.col("success").cast("int")).alias("success"))
    rows = [
        F.struct(F.lit(t).alias("treatment"), F.lit(b).alias("baseline"), (F.col(f"`{t}_tokens`") - F.col(f"`{b}_tokens`")).cast("double").alias("token_diff"), (F.col(f"`{t}_success`") - F.col(f"`{b}_success`")).cast("double").alias("success_diff"))
        for b, t in combinations(arms, 2)
    ]
    return wide.select("block_id", F.explode(F.array(*rows)).alias("p")).select("block_id", "p.*")


def claims(pairs_: DataFrame) -> DataFrame:
    """Per pair of arms: median and mean difference, and what may be claimed from so many blocks."""
    n = F.count("*")
    gate = F.when(n >= S.CLAIM_PUBLISH, "publish").when(n >= S.CLAIM_DECIDE, "decide").otherwise("none")
    return pairs_.groupBy("treatment", "baseline").agg(n.alias("n_blocks"), F.median("token_diff").alias("median_token_diff"), F.avg("success_diff").alias("mean_success_diff"), gate.alias("claim"))


def bootstrap(diffs: DataFrame, *, iterations: int = 10_000, seed: int = 12345, first_draw: int = 0) -> DataFrame:
    """``low, high, estimate`` of the mean by paired bootstrap. diffs: ``at`` (0-based, dense) and ``value``.

    Draw k of the generator depends on seed and k only, so all resamples are drawn in parallel and met with their values
    by one equi-join.
    """
    n = diffs.count()
    if n == 0:
        return diffs.sparkSession.createDataFrame([], "low double, high double, estimate double")
    draws = diffs.sparkSession.range(iterations * n).select((F.col("id") / n).cast("long").alias("round"), F.floor(X.mulberry32(F.lit(seed), F.col("id") + 1 + first_draw) * n).cast("long").alias("at"))
    means = draws.join(diffs.select(F.col("at").cast("long").alias("at"), "value"), "at").groupBy("round").agg(F.avg("value").alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return ends.crossJoin(diffs.agg(F.avg("value").alias("estimate")))  # one row each
