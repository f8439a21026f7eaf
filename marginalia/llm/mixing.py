"""Problem 8: a mixture of sources with target shares of the total size.

Efraimidis-Spirakis sampling. Every document draws an exponential key whose rate is its quality
weight; documents of a source in order of their keys are a weighted sample without replacement.
The total is the largest for which no source needs more than its allowed repeats: complete epochs
of a source come first, then the documents whose running token sum stays within the rest.

The order within a source is cut into buckets by the logarithm of the key, `STEPS` a factor e. Whatever
the weights, a bucket then holds at most 1 / (e STEPS) of a source's documents, 0.15 %. Bucket sums are
aggregated before anything moves, so a running sum is the sum of earlier buckets plus a sum within
one bucket, and a source with a third of all documents is spread over as many tasks as any other.
Documents are whole, so the prefix stops short of the budget where the next one is too long. The
gap is filled by the next `FILL` documents in order that fit it, and by the one that comes nearest.

Sources without tokens can't contribute; the others keep their shares in proportion. Documents
without tokens are left out. Each document counts once; repeated rows of a source's weight count
once; shares that are null or not above 0, and repeats below 1, leave a source out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from .tokens import token_sizes

STEPS = 256  # buckets a factor e of the key
FILL = 256  # documents of a source, next in order, that may fill the gap its prefix leaves


def quality() -> F.Column:
    """A document's weight in (0, 1]: share of letters and marks of prose, less for very short
    texts and for texts of long repeated runs."""
    n = F.greatest(F.length("text"), F.lit(1))
    kept = F.length(F.regexp_replace("text", r"[^\p{L}\p{M}\p{Zs}.,;:!?。，、]", "")) / n
    return F.greatest(F.lit(0.05), kept * (1 - F.exp(-n / 200.0)))


def exponential_keys(docs: DataFrame, seed: int) -> DataFrame:
    """`u`: a uniform number from the document's id, `key`: exponential with rate `weight`."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double")
    u = (bits + 0.5) / float(2**53)
    return docs.withColumn("key", -F.log(u) / F.col("weight"))


def mix(docs: DataFrame, weights: DataFrame, seed: int = 7) -> DataFrame:
    """(source, doc_id, tokens, copies) of the mixture. `docs`: doc_id, source, tokens, weight."""
    weights = weights.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    docs = exponential_keys(docs.where("tokens > 0"), seed)
    docs = docs.withColumn("bucket", F.floor(F.log("key") * STEPS).cast("int"))  # keys are above 0 and finite, as is their number of buckets
    docs = docs.join(weights.select("source"), "source", "left_semi")
    sums = cut_lineage(docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")))  # a few thousand rows a source
    totals = sums.groupBy("source").agg(F.sum("t").alias("have")).join(weights, "source")
    # the largest total that every source can serve
    most = totals.agg(F.min(F.col("repeats") * F.col("have") / F.col("share")).alias("total"))
    plan = totals.withColumn("total", F.lit(most.first()["total"]).cast("double"))
    plan = plan.withColumn("budget", F.least(F.col("share") * F.col("total"), (F.col("repeats") * F.col("have")).cast("double")))
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("have") + F.lit(1e-12))).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("have")))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).join(plan.select("source", "epochs", "rest", "repeats"), "source").select("source", "bucket", "before", "epochs", "rest", "repeats")
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = docs.withColumn("within", within).join(starts, ["source", "bucket"])
    upto = F.col("before") + F.col("within")
    run = cut_lineage(run.withColumn("drawn", (upto <= F.col("rest")) & (F.col("epochs") < F.col("repeats"))))
    # the gap that whole documents leave
    open_ = run.where((F.col("epochs") < F.col("repeats")) & (F.col("rest") > 0))
    gaps = open_.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("tokens"))), F.lit(0))).alias("gap"))
    near = open_.where(~F.col("drawn")).join(gaps, "source").where(F.col("tokens") < 2 * F.col("gap"))
    order = F.row_number().over(Window.partitionBy("source").orderBy("key", "doc_id"))  # each task keeps its first FILL before they meet
    filled = near.withColumn("place", order).where(F.col("place") <= FILL).groupBy("source").applyInPandas(_fill, "source string, doc_id long")
    taken = F.col("drawn") | F.col("filled")
    marked = run.join(filled.withColumn("filled", F.lit(True)), ["source", "doc_id"], "left").fillna(False, ["filled"])
    return marked.select("source", "doc_id", "tokens", (F.col("epochs") + taken.cast("long")).alias("copies")).where("copies > 0")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's next documents in order as long as they fit its gap, and then the one that comes nearest."""
    pdf = pdf.sort_values("place", kind="stable")
    gap = float(pdf["gap"].iloc[0])
    taken: list[int] = []
    left: list[tuple[float, int]] = []
    for doc, tokens in zip(pdf["doc_id"], pdf["tokens"]):
        if tokens <= gap:
            taken.append(doc)
            gap -= tokens
        else:
            left.append((tokens, doc))
    if left:
        tokens, doc = min(left, key=lambda x: abs(gap - x[0]))
        if abs(gap - tokens) < gap:
            taken.append(doc)
    return pd.DataFrame({"source": pdf["source"].iloc[0], "doc_id": pd.Series(taken, dtype="int64")})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null and text is not null")
    wanted = table(spark, sf_dir, "source_weights").where("source is not null").select("source").distinct()
    docs = docs.join(wanted, "source", "left_semi").select("doc_id", "source", "text").withColumn("weight", quality())
    sized = token_sizes(docs, ["doc_id", "source", "weight"])
    return cut_lineage(sized.groupBy("doc_id").agg(F.min(F.struct("source", "weight", "tokens")).alias("x")).select("doc_id", "x.*"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return mix(_documents(spark, sf_dir), table(spark, sf_dir, "source_weights"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached beside the shares asked for."""
    m = mixture(spark, sf_dir).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    weights = table(spark, sf_dir, "source_weights").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    return weights.join(m, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_copies"]).withColumn("actual_share", F.col("n_tokens") / total)


QUERIES = {"p8_mixture": mixture, "p8_report": report}
ORACLES: dict[str, str] = {}
