"""Test items: reading with aliases, sampling, categories, synthesis of unanswerable ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


BUCKET_ITEMS = 2_000  # test items a bucket holds on average


def category(contexts: Column) -> Column:
    return F.when(F.size(contexts) > 1, "multi_passage").otherwise("single_passage")


def sample(items: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n items, the same for a seed whatever the partitions."""
    return items.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first(items: DataFrame, n: int | None) -> DataFrame:
    """The first n items in the order of the file; all without n."""
    return items if n is None else items.orderBy("idx").limit(n)


def unanswerable(items: DataFrame, reference: str, seed: int = 42) -> DataFrame:
    """Each question with the context of the next question in a fixed shuffled order, of another
    source; the reference says that there is no answer.

    Order is made in buckets of hashes and a bucket's last takes its first, so no task sees more
    than a bucket; their number grows with the items. Questions without a partner of another source
    are left out.
    """
    b = F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(max(1, -(-items.count() // BUCKET_ITEMS))))
    w = Window.partitionBy("_b").orderBy(F.xxhash64("qid", F.lit(seed)), "qid")
    other = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    m = items.withColumn("_b", b).select("qid", "question", "source", other("context").alias("context"), other("source").alias("from_source"))
    return m.where(~F.col("from_source").eqNullSafe(F.col("source"))).select("qid", "question", "context", F.lit(reference).alias("ground_truth"), F.lit("unanswerable").alias("category"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Test items of a JSON file: a list, or an object that holds one under `goldens` or `data`;
    the fields have several names. An unreadable file gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.goldens", "array<variant>"), F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = raw.select(F.posexplode(listed).alias("idx", "x"))
    text = lambda *names: T.non_empty(*[F.try_variant_get("x", f"$.{n}", "string") for n in names])
    several = lambda *names: F.coalesce(*[F.try_variant_get("x", f"$.{n}", "array<string>") for n in names], F.array().cast("array<string>"))
    return each.select("idx", text("question", "input").alias("question"), text("ground_truth", "expected_output", "answer").alias("reference"), several("contexts", "context", "retrieval_context").alias("gold_context"), text("category", "additional_metadata.category").alias("category")).orderBy("idx")


Writer = Callable[[DataFrame], DataFrame]


def first_sentence(groups: DataFrame) -> DataFrame:
    """The offline question writer: (group_id, question, ground_truth), what the first sentence of a group's
    first context says. It isn't equal to a model."""
    sentence = F.regexp_extract(F.trim(F.get("contexts", 0)), r"(?s)^(.+?[.!?…。！？])(?:\s|$)", 1)
    return groups.select("group_id", F.concat(F.lit("What is said here: "), sentence).alias("question"), sentence.alias("ground_truth")).where("ground_truth <> ''")


def generate(chunks: DataFrame, n: int, least: int = 1, most: int = 1, writer: Writer = first_sentence, buffer: int = 3, seed: int = 42) -> DataFrame:
    """At most n test items (question, ground_truth, contexts, category) from chunks (source, parent_id,
    child_no, text).

    Documents are drawn by seeded hashes, `buffer` times as many as items; a document gives groups of
    `least` to `most` chunks in a row, one if there are documents enough, and the writer one question a
    group. What is over is cut off in the order of the hashes. Single passages are groups of one
    chunk, multiple ones of two or three.
    """
    wanted = n * buffer
    docs = chunks.where("source is not null").select("source").distinct()
    drawn = docs.orderBy(F.xxhash64("source", F.lit(seed)), "source").limit(wanted)
    n_docs = drawn.count()
    if not n_docs:
        raise ValueError("no documents to draw from")
    each = -(-wanted // n_docs)
    size = F.lit(least) + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(most - least + 1))
    w = Window.partitionBy("source").orderBy("parent_id", "child_no")
    placed = chunks.join(drawn, "source").withColumn("size", size).withColumn("i", F.row_number().over(w) - 1).withColumn("g", F.floor(F.col("i") / F.col("size")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    groups = placed.where(F.col("g") < each).groupBy("source", "g", "size").agg(ordered.alias("contexts")).where(F.size("contexts") == F.col("size"))
    groups = groups.select(F.xxhash64("source", "g").alias("group_id"), F.xxhash64("source", "g", F.lit(seed)).alias("h"), "contexts")
    written = writer(groups.select("group_id", "contexts")).join(groups, "group_id")
    return written.orderBy("h", "group_id").limit(n).select("question", "ground_truth", "contexts", category(F.col("contexts")).alias("category"))


def single_passage(chunks: DataFrame, n: int = 20, writer: Writer = first_sentence, seed: int = 42) -> DataFrame:
    return generate(chunks, n, 1, 1, writer, seed=seed)


def multi_passage(chunks: DataFrame, n: int = 20, writer: Writer = first_sentence, seed: int = 42) -> DataFrame:
    return generate(chunks, n, 2, 3, writer, seed=seed)


def drift_candidates(chunks: DataFrame, n: int = 10, writer: Writer = first_sentence, seed: int = 42) -> DataFrame:
    """Questions whose context is to be replaced by `unanswerable`; they need no reference."""
    return generate(chunks, n, 1, 3, writer, seed=seed).withColumn("ground_truth", F.lit(None).cast("string"))
