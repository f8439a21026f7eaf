"""Ranking, refusal and grounding metrics with confidence intervals.

Metrics are null, never NaN, where they are undefined: no gold for hit and nDCG, no hits for
precision. A gold list that is null counts as empty.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..session import cut_lineage

# fixed values: French phrases that mark an answer as a refusal
REFUSAL_PHRASES = [
    "ne permettent pas de répondre", "ne peux pas répondre", "ne peut pas répondre", "ne pouvons pas répondre", "ne suis pas en mesure", "n'est pas présente", "n'est pas présent",
    "n'est pas directement", "pas directement liée", "pas directement lié", "pas dans le contexte", "pas dans le corpus", "pas dans les documents", "ne correspond pas", "ne traite pas de",
    "ne traite pas des", "ne contient pas", "aucun document", "documents fournis ne", "je ne dispose pas", "hors du champ", "ne fait pas partie", "information non disponible", "pas d'information", "ne semble pas",
]
REFUSAL_MESSAGE = "No reliable answer can be found in the course excerpts."


def is_refusal(answer: Column, message: str = REFUSAL_MESSAGE) -> Column:
    """The exact message, or a refusing phrase in an answer of under 500 characters; null is none."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    some = F.lit(False)
    for p in REFUSAL_PHRASES:
        some = some | F.contains(F.lower(t), F.lit(p))
    return (t == message) | ((F.length(t) < 500) & some)


def relevance(gold: Column, hit: Column) -> Column:
    """Largest share of words that a hit has in common with a gold passage, both given as sets of
    words; make the sets once per text, before texts meet."""
    return F.coalesce(F.array_max(F.transform(F.coalesce(gold, F.array().cast("array<array<string>>")), lambda g: T.overlap_ratio(g, hit))), F.lit(0.0))


def gold_words(gold: Column) -> Column:
    return F.transform(F.coalesce(gold, F.array().cast("array<string>")), lambda g: T.word_set(g))


def ranking(hits: DataFrame, k: int = 4, config: EngineConfig = DEFAULT) -> DataFrame:
    """(qid, hit, rr, precision, ndcg) from (qid, rank, relevance, n_gold); one row a question."""
    rel = F.col("relevance") >= config.relevance_threshold
    ideal = Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank")
    r = hits.withColumn("rel", rel).withColumn("_i", F.row_number().over(ideal))
    gain = lambda at: F.when(at <= k, F.col("relevance") / F.log2(at + 1.0)).otherwise(0.0)
    m = r.groupBy("qid").agg(
        F.max("n_gold").alias("n_gold"),
        F.max(F.when(F.col("rel") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("hit"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.sum((F.col("rel") & (F.col("rank") <= k)).cast("int")).alias("good"),
        F.count("*").alias("n"),
        F.sum(gain(F.col("rank"))).alias("dcg"),
        F.sum(gain(F.col("_i"))).alias("idcg"),
    )
    has = F.col("n_gold") > 0
    return m.select(
        "qid",
        F.when(has, F.col("hit")).alias("hit"),
        F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(has, F.col("good") / F.least(F.lit(k), F.col("n"))).alias("precision"),
        F.when(has, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
    )


def confusion(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of (wanted, made); ratios are null where undefined."""
    c = lambda cond: F.sum(F.coalesce(cond.cast("long"), F.lit(0).cast("long")))
    w, m = F.col("wanted"), F.col("made")
    g = flags.groupBy(*(by or [])).agg(c(w & m).alias("tp"), c(~w & m).alias("fp"), c(w & ~m).alias("fn"), c(~w & ~m).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    g = g.withColumn("precision", p).withColumn("recall", r)
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def bootstrap(scores: DataFrame, resamples: int = 1000, ci: float = 0.95, seed: int = 42, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Percentile bootstrap of each group's mean from (*by, score): (*by, lower, upper, mean, n).

    Poisson weights: in each resample a score counts Poisson(1) times, so c equal scores count
    Poisson(c) times. The draws of a value are seeded by the group and the value, whatever task
    makes them; tasks send sums of their draws, and no task sees all values of a group. Nulls and
    NaN are left out; fewer than two scores give the mean for all three figures.
    """
    import numpy as np

    keys = list(by)
    hist = cut_lineage(scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*keys, F.round("score", 6).alias("v")).agg(F.count("*").alias("c")))  # read twice
    seeded = hist.withColumn("g", F.xxhash64(*keys)).withColumn("seed", F.xxhash64(*keys, "v", F.lit(seed)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, v, c, x in zip(pdf["g"], pdf["v"], pdf["c"], pdf["seed"]):
                times = np.random.default_rng(int(x) % 2**63).poisson(c, resamples)
                sums.setdefault(g, np.zeros((2, resamples)))
                sums[g] += np.stack([times * v, times])
        rows = [(g, i, s[0, i], s[1, i]) for g, s in sums.items() for i in range(resamples)]
        yield pd.DataFrame(rows, columns=["g", "i", "s", "t"])

    draws = seeded.select("g", "v", "c", "seed").mapInPandas(draw, "g long, i int, s double, t double").groupBy("g", "i").agg((F.sum("s") / F.nullif(F.sum("t"), F.lit(0.0))).alias("m"))
    ordered = draws.where("m is not null").groupBy("g").agg(F.sort_array(F.collect_list("m")).alias("m"))  # `resamples` numbers a group
    a = (1 - ci) / 2
    at = lambda share: F.get("m", F.least(F.size("m") - 1, F.floor(F.lit(share) * F.size("m")).cast("int")))
    means = seeded.groupBy(*keys, "g").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    some = F.col("n") >= 2
    return means.join(ordered, "g").select(*keys, F.when(some, at(a)).otherwise(F.col("mean")).alias("lower"), F.when(some, at(1 - a)).otherwise(F.col("mean")).alias("upper"), "mean", "n")


def bootstrap_sequential(scores: list[float], resamples: int = 1000, ci: float = 0.95, seed: int = 42) -> tuple[float | None, float | None, float | None]:
    """The same interval drawn score by score with the standard generator, for short lists whose
    figures must repeat exactly."""
    if not scores:
        return None, None, None
    mean = sum(scores) / len(scores)
    if len(scores) < 2:
        return mean, mean, mean
    rng = random.Random(seed)
    means = sorted(sum(scores[rng.randrange(len(scores))] for _ in scores) / len(scores) for _ in range(resamples))
    a = (1 - ci) / 2
    return means[int(a * resamples)], means[int((1 - a) * resamples)], mean


STOP_WORDS = "les des une est que qui dans pour sur avec par pas plus sont aux ces ses son ont the and for are was with that this from not but you all can has have what how why who when which".split()


def keywords(text: Column) -> Column:
    """Distinct words of three letters or more that aren't stop words."""
    return F.array_except(T.word_set(text, 3), F.array(*[F.lit(w) for w in STOP_WORDS]))


def lexical_overlap(question: Column, context: Column) -> Column:
    """Share of the question's keywords that the context has; null without keywords."""
    q = keywords(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, keywords(context))) / F.size(q))


RANGES = 256  # ranges of scores that are accumulated apart


def calibrate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of best accuracy, refusing below it; of equal ones the lowest.

    `scored`: score, unanswerable. Counts are aggregated per distinct score, the distinct scores are
    cut into ranges at their quantiles, and what lies below a score is the sum of the ranges below
    plus a sum within its range; so no task takes all scores of a group. Null and NaN scores or
    labels don't count.
    """
    by = by or []
    s = scored.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("unanswerable").isNotNull())
    u = F.col("unanswerable").cast("long")
    d = cut_lineage(s.groupBy(*by, "score").agg(F.sum(u).alias("u"), F.sum(1 - u).alias("a")))
    cuts = d.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<double>")
    d = d.withColumn("range", F.size(F.filter(cuts, lambda x: x <= F.col("score"))))
    apart = d.groupBy(*by, "range").agg(F.sum("u").alias("ru"), F.sum("a").alias("ra"))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = apart.select(*by, "range", F.coalesce(F.sum("ru").over(below), F.lit(0)).alias("bu"), F.coalesce(F.sum("ra").over(below), F.lit(0)).alias("ba"), F.sum("ru").over(whole).alias("tu"), F.sum("ra").over(whole).alias("ta"))
    before = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    within = d.withColumn("wu", F.coalesce(F.sum("u").over(before), F.lit(0))).withColumn("wa", F.coalesce(F.sum("a").over(before), F.lit(0)))
    same = reduce(lambda x, y: x & y, [F.col(f"w.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "range"]])
    acc = within.alias("w").join(starts.alias("s"), same).select(*[F.col(f"w.{c}") for c in by], "score", ((F.col("bu") + F.col("wu") + F.col("ta") - F.col("ba") - F.col("wa")) / (F.col("tu") + F.col("ta"))).alias("accuracy"))
    best = F.max_by(F.struct("score", "accuracy"), F.struct(F.col("accuracy"), -F.col("score")))
    return acc.groupBy(*by).agg(best.alias("b")).where("b is not null").select(*by, F.col("b.score").alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def top_scores(hits: DataFrame, goldens: DataFrame, first: bool = False) -> DataFrame:
    """(qid, score, unanswerable): what `calibrate` needs, from retrieved hits (qid, rank, score) and test items
    (qid, category). Items without a category or without hits are left out. The score is the best of
    the hits, as the gate reads it, or with `first` that of the first hit."""
    best = hits.where(F.col("score").isNotNull()).groupBy("qid").agg((F.min_by("score", "rank") if first else F.max("score")).alias("score"))
    return goldens.where(F.col("category").isNotNull()).join(best, "qid").select("qid", "score", (F.col("category") == "unanswerable").alias("unanswerable"))


def gate(hits: DataFrame, queries: DataFrame, threshold: float, active: bool = True) -> DataFrame:
    """(qid, top_score, refuse): refuse without hits, or if the best of all hits is below the
    threshold. With scores of another kind (`active` false) only missing hits refuse."""
    top = hits.groupBy("qid").agg(F.max("score").alias("top_score"), F.count("*").alias("n"))
    j = queries.select("qid").join(top, "qid", "left")
    below = F.coalesce(F.col("top_score") < threshold, F.lit(False)) & F.lit(active)
    return j.select("qid", "top_score", (F.col("n").isNull() | below).alias("refuse"))
