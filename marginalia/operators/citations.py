"""Citation labels, context blocks and the citations found in an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NOTHING_FOUND = "(no relevant document was found)"


def label(source_type: str = "source_type", source: str = "source", source_id: str = "source_id", source_url: str = "source_url", title: str = "title", section: str = "section") -> Column:
    """`pdf · name · §section` or `web · site · « title » · §section`; a title that repeats its
    section is left out, and so is a section that is null or blank."""
    kind = T.non_empty(F.col(source_type), F.lit("web"))
    head = F.coalesce(F.trim(section), F.lit(""))
    name = F.coalesce(F.trim(title), F.lit(""))
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    pdf = F.concat(F.lit("pdf · "), T.non_empty(F.col(source_id), F.concat(F.coalesce(source, F.lit("document")), F.lit(".pdf"))))
    site = T.non_empty(F.regexp_extract(F.coalesce(source_url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("?"))
    web = F.concat(kind, F.lit(" · "), site, F.when((name != "") & (bare(name) != bare(head)), F.concat(F.lit(" · « "), name, F.lit(" »"))).otherwise(F.lit("")))
    return F.concat(F.when(kind == "pdf", pdf).otherwise(web), F.when(head != "", F.concat(F.lit(" · §"), head)).otherwise(F.lit("")))


def context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, context): the labelled texts of a question's hits by rank; at most a handful a question."""
    block = F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    got = hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("context"))
    return queries.select("qid").join(got, "qid", "left").select("qid", F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"))


def analysis(answers: DataFrame) -> DataFrame:
    """Numbered citations of an answer against its documents: (qid, cited, uncited, rate).

    `answers`: qid, answer, n_documents. Numbers out of range don't count; the rate is null
    without documents.
    """
    numbers = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(?i)\[DOC\s*([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    all_ = F.when(F.col("n_documents") > 0, F.sequence(F.lit(1), F.col("n_documents").cast("int"))).otherwise(F.array().cast("array<int>"))
    a = answers.select("qid", F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("n_documents"))))).alias("cited"), all_.alias("all"))
    return a.select("qid", "cited", F.array_except("all", "cited").alias("uncited"), F.when(F.size("all") > 0, F.round(F.size("cited") / F.size("all"), 2)).alias("rate"))


def top_sources(labelled: DataFrame, k: int = 3) -> DataFrame:
    """(qid, sources): the labels of a question's first k hits by rank, one a line, each once."""
    w = Window.partitionBy("qid", "label").orderBy("rank")
    once = labelled.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    first = once.withColumn("_p", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("_p") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_p", F.concat(F.lit("- "), F.col("label")).alias("l"))))
    return first.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("sources"))
