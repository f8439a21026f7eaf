"""Queries over the search operators. Questions are those of rag_results whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, metrics
from ..operators import retrieval as R
from ..session import table
from . import sql as Q


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "rag_results").where("result_id % 20 = 0 and query is not null").select(F.col("result_id").alias("qid"), F.col("query").alias("question"))
    return q.dropDuplicates(["qid"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "children").select("child_id", "parent_id", "text", "source_type").dropDuplicates(["child_id"])


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parents").select("parent_id", "source", "source_type", "section", "source_url", "title", "source_id", "text").dropDuplicates(["parent_id"])


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, q = chunks(spark, d), questions(spark, d)
    return c, q, R.cosine_topk(c, q), R.bm25_topk(c, q)


def term_stats(spark, d):
    c = chunks(spark, d)
    return R.term_stats(c).select("term", "df", F.round("idf", 6).alias("idf"))


def postings(spark, d):
    return R.postings(chunks(spark, d)).select("child_id", "term", "tf", "dl")


def doc_lengths(spark, d):
    from ..functions import text as T

    return chunks(spark, d).select("child_id", T.word_count(F.col("text")).alias("dl"))


def bm25(spark, d):
    return R.bm25_topk(chunks(spark, d), questions(spark, d)).select("qid", "child_id", "score", "rank")


def bm25_filtered(spark, d):
    return R.bm25_topk(chunks(spark, d), questions(spark, d), source_type="pdf").select("qid", "child_id", "score", "rank")


def cosine(spark, d):
    return R.cosine_topk(chunks(spark, d), questions(spark, d)).select("qid", "child_id", "score", "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def dense(spark, d):
    v = _vectors(spark, d)
    return R.vector_topk(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")).select("qid", "vec_id", "score", "rank")


def dense_filtered(spark, d):
    v = _vectors(spark, d)
    return R.vector_topk(v.where("label = 3"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10).select("qid", "vec_id", "score", "rank")


def rrf_fusion(spark, d):
    c, _, dense_, sparse = _lists(spark, d)
    return R.rrf(dense_, sparse, c).select("qid", "parent_id", "child_id", "score", "rank")


def rrf_alpha_sweep(spark, d):
    c, _, dense_, sparse = _lists(spark, d)
    return R.rrf_sweep(dense_, sparse, c, [0.2, 0.5, 0.8], 10).select("qid", "child_id", "score", "rank", "alpha")


def merge_dedup(spark, d):
    c, _, dense_, sparse = _lists(spark, d)
    return R.merge_dedup(dense_, sparse, c)


def child_to_parent(spark, d):
    c, q = chunks(spark, d), questions(spark, d)
    found = R.bm25_topk(c, q).join(c.select("child_id", "parent_id"), "child_id")
    return R.to_parents(found, sections(spark, d)).select("qid", "rank", "parent_id", "score", "child_rank")


def sub_queries(spark, d):
    r = table(spark, d, "rag_results").withColumn("qid", F.col("result_id")).dropDuplicates(["result_id"])
    return R.sub_queries(r)


def round_robin(spark, d):
    r = table(spark, d, "rag_results").where("result_id % 20 = 0").withColumn("qid", F.col("result_id")).dropDuplicates(["result_id"])
    parts = R.sub_queries(r).withColumn("part", F.xxhash64("qid", "q_idx"))
    c = chunks(spark, d)
    found = R.bm25_topk(c, parts.select(F.col("part").alias("qid"), "question"), 10).join(c.select("child_id", "parent_id"), "child_id")
    per = R.to_parents(found, sections(spark, d)).withColumnRenamed("qid", "part").join(parts.select("part", "qid", "q_idx"), "part").select("qid", "q_idx", "rank", "parent_id", "score")
    return R.round_robin(per)


def _mode(mode: str):
    def run(spark, d):
        found = R.retrieve(chunks(spark, d), sections(spark, d), questions(spark, d), mode)
        return found.select("qid", "rank", "parent_id", "score", citations.label().alias("label"))

    run.__name__ = f"retrieve_{mode}"
    return run


def engine(spark, d):
    """The same as `retrieve_rerank`, asked of an engine that keeps its index."""
    e = R.Engine(chunks(spark, d), sections(spark, d))
    return e.retrieve(questions(spark, d)).select("qid", "rank", "parent_id", "score")


def top_sources(spark, d):
    found = R.retrieve(chunks(spark, d), sections(spark, d), questions(spark, d), "hybrid")
    return citations.top_sources(found.select("qid", "rank", citations.label().alias("label")))


def gate_retrieved(spark, d):
    q = questions(spark, d)
    found = R.retrieve(chunks(spark, d), sections(spark, d), q, "hybrid_rerank")
    return metrics.gate(found.select("qid", "score"), q, 0.5)


QUERIES = {
    "term_stats": term_stats,
    "postings": postings,
    "doc_lengths": doc_lengths,
    "bm25_topk": bm25,
    "bm25_topk_filtered": bm25_filtered,
    "cosine_topk": cosine,
    "dense_topk": dense,
    "dense_topk_filtered": dense_filtered,
    "rrf_fusion": rrf_fusion,
    "rrf_alpha_sweep": rrf_alpha_sweep,
    "merge_dedup": merge_dedup,
    "child_to_parent": child_to_parent,
    "sub_queries": sub_queries,
    "round_robin": round_robin,
    "engine_rerank": engine,
    "top_sources": top_sources,
    "retrieve_dense": _mode("dense"),
    "retrieve_hybrid": _mode("hybrid"),
    "retrieve_rerank": _mode("hybrid_rerank"),
    "gate_retrieved": gate_retrieved,
}

_VEC = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank
FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id """
_SUBS = f"""WITH r AS (SELECT DISTINCT ON (result_id) result_id AS qid, query, rewritten_query, sub_queries FROM rag_results WHERE FILTER),
l AS (SELECT qid, list_concat([coalesce(nullif(rewritten_query, ''), nullif(query, ''))], coalesce(sub_queries, [])) AS p FROM r),
e AS (SELECT qid, unnest(p) AS question, generate_subscripts(p, 1) AS pos FROM l),
s AS (SELECT qid, pos, question FROM e WHERE trim(question) <> '' QUALIFY row_number() OVER (PARTITION BY qid, lower(trim(question)) ORDER BY pos) = 1),
subs AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS q_idx, question FROM s)
"""


def _retrieved(source: str, select: str = f"SELECT qid, rank, parent_id, score, {Q.LABEL} AS label FROM lifted") -> str:
    ranks = {"cosk": ", cand AS (SELECT qid, parent_id, score, rank FROM cosk JOIN c USING (child_id) WHERE rank <= 18)", "fused": "", "reranked": ""}[source]
    top = {"cosk": "", "fused": Q.fused(0.6, 18), "reranked": Q.fused(0.6, 40) + Q.RERANKED}[source]
    return Q.SEARCH + top + ranks + Q.lifted("cand" if source == "cosk" else source) + select


_ROUND = Q.SEARCH.replace(
    "SELECT DISTINCT result_id AS qid, query AS question FROM rag_results WHERE result_id % 20 = 0",
    "SELECT qid * 100 + q_idx AS qid, question FROM (" + _SUBS.replace("FILTER", "result_id % 20 = 0") + " SELECT * FROM subs)",
)
ORACLES = {
    "term_stats": Q.SEARCH + "SELECT term, df, round(idf, 6) AS idf FROM stats",
    "postings": Q.SEARCH + "SELECT child_id, term, tf, dl FROM post",
    "doc_lengths": Q.SEARCH + "SELECT child_id, len(t) AS dl FROM tok",
    "bm25_topk": Q.SEARCH + "SELECT qid, child_id, score, rank FROM bmk",
    "bm25_topk_filtered": Q.SEARCH + "SELECT qid, child_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, child_id) AS rank FROM bm JOIN c USING (child_id) WHERE source_type = 'pdf' QUALIFY rank <= 20",
    "cosine_topk": Q.SEARCH + "SELECT qid, child_id, score, rank FROM cosk",
    "dense_topk": _VEC + "QUALIFY rank <= 20",
    "dense_topk_filtered": _VEC + "AND v.label = 3 QUALIFY rank <= 10",
    "rrf_fusion": Q.SEARCH + Q.fused(0.6, 40) + "SELECT qid, parent_id, child_id, score, rank FROM fused",
    "rrf_alpha_sweep": Q.SEARCH
    + "".join(Q.fused(a, 10, f"f{i}") for i, a in enumerate((0.2, 0.5, 0.8)))
    + " UNION ALL ".join(f"SELECT qid, child_id, score, rank, {a}::DOUBLE AS alpha FROM f{i}" for i, a in enumerate((0.2, 0.5, 0.8))),
    "merge_dedup": Q.SEARCH
    + """, b AS (SELECT *, 0 AS src FROM cosk UNION ALL SELECT *, 1 FROM bmk), j AS (SELECT b.*, parent_id, text FROM b JOIN c USING (child_id)),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, parent_id, text ORDER BY src, rank) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY src, rank) AS position, child_id, parent_id, score FROM k""",
    "child_to_parent": Q.SEARCH + ", cand AS (SELECT qid, parent_id, score, rank FROM bmk JOIN c USING (child_id))" + Q.lifted("cand") + "SELECT qid, rank, parent_id, score, child_rank FROM lifted",
    "sub_queries": _SUBS.replace("FILTER", "true") + "SELECT qid, q_idx, question FROM subs",
    "round_robin": _ROUND
    + ", cand AS (SELECT qid, parent_id, score, rank FROM bmk JOIN c USING (child_id) WHERE rank <= 10)"
    + Q.lifted("cand")
    + """, per AS (SELECT qid // 100 AS qid, qid % 100 AS q_idx, rank, parent_id, score FROM lifted),
once AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank, q_idx) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, q_idx) AS position, parent_id, q_idx, score FROM once QUALIFY position <= 4""",
    "retrieve_dense": _retrieved("cosk"),
    "retrieve_hybrid": _retrieved("fused"),
    "retrieve_rerank": _retrieved("reranked"),
    "engine_rerank": _retrieved("reranked", "SELECT qid, rank, parent_id, score FROM lifted"),
    "top_sources": _retrieved("fused", f"""SELECT qid, string_agg('- ' || label, chr(10) ORDER BY rank) AS sources FROM (SELECT qid, rank, label FROM
 (SELECT qid, label, min(rank) AS rank FROM (SELECT qid, rank, {Q.LABEL} AS label FROM lifted) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 3) GROUP BY qid"""),
    "gate_retrieved": _retrieved("reranked", "SELECT q.qid, max(score) AS top_score, (count(score) = 0 OR max(score) < 0.5) AS refuse FROM q LEFT JOIN lifted USING (qid) GROUP BY q.qid"),
}
