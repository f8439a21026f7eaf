"""Problem 6: per source, the score cutoff that keeps a target fraction of its records.

Distributed quickselect. Each partition reports, per source, how many of its still open scores
lie above, at and below the pivot, with the median of either side; the weighted median of the
partition medians is the next pivot. The counts discard one side of each source, until the pivot
is the score of the target rank. Nothing but these small reports is ever shuffled, whatever share
of the rows a source holds.

Counted are records with a score in [0, 1] and a label; each key counts once. Sources match their
target null-safely; a source without target, or without counted records, has no cutoff. A target
fraction of 0 or less keeps the ties of the best score; above 1 it keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table

STATE_ROWS = 100_000  # sources whose state may pass through the driver, at under 100 bytes each
_REPORT = "g string, n_above long, n_at long, med_above double, med_below double, n_below long"


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each source in this partition: counts around its pivot, and medians of both sides.

    Rows come as (g, score, lo, hi, pivot); only scores strictly inside (lo, hi) are open.
    """
    held: dict[int, list[np.ndarray]] = {}
    state: dict[int, tuple] = {}
    for pdf in batches:
        for g, part in pdf.groupby("g"):
            state.setdefault(g, tuple(part[["lo", "hi", "pivot"]].iloc[0]))
            held.setdefault(g, []).append(part["score"].to_numpy())
    rows = []
    for g, parts in held.items():
        lo, hi, pivot = state[g]
        x = np.concatenate(parts)
        x = x[(x > lo) & (x < hi)]
        if not len(x):
            continue
        above, below = x[x > pivot], x[x < pivot]
        mid = lambda a: float(np.partition(a, len(a) // 2)[len(a) // 2]) if len(a) else None
        rows.append((g, len(above), len(x) - len(above) - len(below), mid(above), mid(below), len(below)))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")])


def _weighted_median(value: str, weight: str) -> F.Column:
    """The value at which the running weight reaches half, over the partitions' reports of a source."""
    pairs = F.array_sort(F.filter(F.collect_list(F.struct(F.col(value).alias("v"), F.col(weight).alias("w"))), lambda p: p["v"].isNotNull()))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + p["w"])
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(pairs, start, lambda a, p: F.struct(F.when(a["v"].isNull() & ((a["s"] + p["w"]) * 2 >= total), p["v"]).otherwise(a["v"]).alias("v"), (a["s"] + p["w"]).alias("s")))["v"]


def quickselect_cutoffs(scores: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, cutoff): for each source g, its score of rank `k` from the top (1-based).

    `scores`: g, score in [0, 1]. `ranks`: g, k with 1 <= k <= records of g. Each round discards
    at least a quarter of a source's open records, so rounds grow with the logarithm of the rows.
    """
    # open interval (lo, hi) holds the answer; `over` counts records at or above hi
    state = ranks.select("g", "k", F.lit(-1.0).alias("lo"), F.lit(2.0).alias("hi"), F.lit(0.5).alias("pivot"), F.lit(0).cast("long").alias("over"), F.lit(None).cast("double").alias("cutoff"))
    if ranks.count() > STATE_ROWS:
        return _rounds_apart(scores, state)
    spark, schema = scores.sparkSession, state.schema
    rows, done = state.collect(), []
    while rows:
        rows = _round(scores, F.broadcast(spark.createDataFrame(rows, schema))).collect()  # at most STATE_ROWS rows, as checked
        done += [(r["g"], r["cutoff"]) for r in rows if r["cutoff"] is not None]
        rows = [r for r in rows if r["cutoff"] is None]
    return spark.createDataFrame(done, "g string, cutoff double")


def _rounds_apart(scores: DataFrame, state: DataFrame) -> DataFrame:
    """The same rounds for more sources than the driver should hold; states stay in the shared folder."""
    state, done = cut_lineage(state), None
    while not state.isEmpty():
        stepped = cut_lineage(_round(scores, state))
        settled = stepped.where("cutoff is not null").select("g", "cutoff")
        done = settled if done is None else done.unionByName(settled)
        state = stepped.where("cutoff is null")
    return done if done is not None else state.select("g", "cutoff")


def _round(scores: DataFrame, state: DataFrame) -> DataFrame:
    """One round: reports of all partitions, merged, and each source's interval halved about."""
    open_ = scores.join(state.select("g", "lo", "hi", "pivot"), "g").where((F.col("score") > F.col("lo")) & (F.col("score") < F.col("hi")))
    reports = open_.mapInPandas(_report, _REPORT)  # closed scores and settled sources never reach Python
    merged = reports.groupBy("g").agg(
        F.sum("n_above").alias("a"), F.sum("n_at").alias("e"), _weighted_median("med_above", "n_above").alias("next_above"), _weighted_median("med_below", "n_below").alias("next_below")
    )
    r = F.col("k") - F.col("over")
    up, down = r <= F.col("a"), r > F.col("a") + F.col("e")
    return state.join(merged, "g").select(
        "g",
        "k",
        F.when(up, F.col("pivot")).otherwise(F.col("lo")).alias("lo"),
        F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
        F.when(up, F.col("next_above")).otherwise(F.col("next_below")).alias("pivot"),
        F.when(down, F.col("over") + F.col("a") + F.col("e")).otherwise(F.col("over")).alias("over"),
        F.when(~up & ~down, F.col("pivot")).alias("cutoff"),
    )


def _source() -> F.Column:
    """One exact key for a source; a null part is a value of its own."""
    return F.to_json(F.struct("dataset", "category"))


def counted_records(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counted records with their source g, sources with g and target)."""
    sources = targets.where("target_fraction is not null").groupBy("dataset", "category").agg(F.max("target_fraction").alias("target_fraction")).withColumn("g", _source())
    s = F.col("best_reranker_score")
    counted = records.where(s.between(0.0, 1.0) & ~F.isnan(s) & F.col("is_unanswerable").isNotNull() & F.col("question_id").isNotNull()).select("question_id", _source().alias("g"), s.alias("score"))
    counted = counted.groupBy("question_id").agg(F.min(F.struct("g", "score")).alias("x")).select("question_id", "x.*")
    return counted.join(sources.select("g"), "g", "left_semi"), sources


def _select(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, groups = counted_records(table(spark, sf_dir, "reranker_calibration"), table(spark, sf_dir, "keep_targets"))
    records = cut_lineage(records)
    sizes = records.groupBy("g").agg(F.count("*").alias("n_counted"))
    k = F.least(F.col("n_counted"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("target_fraction") * F.col("n_counted") - F.lit(1e-9))))
    ranks = groups.join(sizes, "g").withColumn("k", k)
    return records, ranks, quickselect_cutoffs(records.select("g", "score"), ranks)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records kept."""
    records, _, cutoffs = _select(spark, sf_dir)
    return records.join(cutoffs, "g").where("score >= cutoff").select("question_id")


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: for each source its cutoff, target, counted and kept records."""
    records, ranks, cut = _select(spark, sf_dir)
    kept = records.join(cut, "g").groupBy("g", "cutoff").agg(F.sum((F.col("score") >= F.col("cutoff")).cast("long")).alias("n_kept"))
    return kept.join(ranks, "g").select("dataset", "category", "target_fraction", "cutoff", "n_counted", "n_kept")


_COUNTED = """WITH counted AS (
  SELECT DISTINCT question_id, dataset, category, best_reranker_score AS score FROM reranker_calibration
  WHERE best_reranker_score BETWEEN 0 AND 1 AND NOT isnan(best_reranker_score) AND is_unanswerable IS NOT NULL),
ranked AS (
  SELECT c.*, t.target_fraction, count(*) OVER g AS n_counted,
    count(*) OVER (PARTITION BY c.dataset, c.category ORDER BY c.score DESC RANGE UNBOUNDED PRECEDING) AS at_or_above
  FROM counted c JOIN keep_targets t ON c.dataset IS NOT DISTINCT FROM t.dataset AND c.category IS NOT DISTINCT FROM t.category
  WINDOW g AS (PARTITION BY c.dataset, c.category)),
cut AS (
  SELECT dataset, category, target_fraction, n_counted, max(score) AS cutoff FROM ranked
  WHERE at_or_above >= target_fraction * n_counted - 1e-9 GROUP BY ALL)
"""
QUERIES = {"p6_found": found, "p6_cutoffs": cutoffs}
ORACLES = {
    "p6_found": _COUNTED + "SELECT r.question_id FROM ranked r JOIN cut ON r.dataset IS NOT DISTINCT FROM cut.dataset AND r.category IS NOT DISTINCT FROM cut.category WHERE r.score >= cut.cutoff",
    "p6_cutoffs": _COUNTED
    + "SELECT cut.dataset, cut.category, cut.target_fraction, cut.cutoff, cut.n_counted, count(*) AS n_kept FROM cut JOIN ranked r ON r.dataset IS NOT DISTINCT FROM cut.dataset AND r.category IS NOT DISTINCT FROM cut.category AND r.score >= cut.cutoff GROUP BY ALL",
}
