"""Sparse and dense search, fusion, reranking and the lift from chunks to sections.

Everything works on whole batches of questions. Lists carry (qid, child_id, score, rank); ranks
break ties by identifier, on scores rounded to six decimals, so results don't depend on the order
in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..session import cut_lineage, spread
from . import providers

QUERIES_A_SLICE = 20_000  # questions whose inverted list is sent at once


def ranked(lists: DataFrame, k: int, by: tuple[str, ...] = ("qid",), item: str = "child_id", score: str = "score") -> DataFrame:
    """The k best of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.col(item))
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- index -----------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str = "child_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl): one row a term of a text."""
    t = docs.select(key, T.tokens(F.col(text)).alias("_t"))
    return t.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of a whole corpus: (term, df, idf) and the mean length."""

    terms: DataFrame
    n: int
    mean_length: float


def statistics(docs: DataFrame, config: EngineConfig = DEFAULT) -> Statistics:
    """The statistics of all texts, written once; searches read them again and again.

    The negative weights of very common terms are raised to a share of the mean weight.
    """
    t = docs.select(T.tokens(F.col("text")).alias("t"))
    n, mean_length = t.agg(F.count("*"), F.avg(F.size("t"))).first()
    df = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = cut_lineage(df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0]
    floor = config.bm25_epsilon * (mean if mean is not None else 0.0)
    return Statistics(raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")), n, float(mean_length or 1.0))


def term_stats(docs: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(term, df, idf) of all texts."""
    return statistics(docs, config).terms


def _query_slices(queries: DataFrame, most: int) -> Iterator[list]:
    """The questions (qid, question, t) in lists of about `most`, each collected by itself."""
    q = queries.select(F.col("qid").cast("long").alias("qid"), T.tokens(F.col("question")).alias("t")).where(F.size("t") > 0)
    n = -(-q.count() // most)
    for i in range(n):
        yield (q if n == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)).collect()


def _best(parts: list[pd.DataFrame], k: int, key: str) -> pd.DataFrame:
    """The k best rows of each question among several lists."""
    return pd.concat(parts, ignore_index=True).sort_values(["qid", "score", key], ascending=[True, False, True], kind="stable").groupby("qid", sort=False).head(k)


@dataclass
class _Asked:
    """A slice of questions as an inverted list: for each term the questions that ask it, and how often."""

    qids: np.ndarray
    terms: list[str]
    lens: np.ndarray
    starts: np.ndarray
    q_of: np.ndarray
    times: np.ndarray
    weights: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, rows: list) -> _Asked:
        terms: dict[str, dict[int, int]] = {}
        for i, r in enumerate(rows):
            for w in r["t"]:
                at = terms.setdefault(w, {})
                at[i] = at.get(i, 0) + 1
        lens = np.array([len(x) for x in terms.values()], dtype=np.int64)
        q_of = np.array([i for x in terms.values() for i in x], dtype=np.int64)
        times = np.array([n for x in terms.values() for n in x.values()], dtype=np.float64)
        return cls(np.array([r["qid"] for r in rows], dtype=np.int64), list(terms), lens, np.cumsum(lens) - lens, q_of, times, np.ones(len(terms)), np.sqrt(np.bincount(q_of, times * times, minlength=len(rows))))


def _matches(texts: pd.Series, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the asked terms in texts of tokens with single blanks between, and each text's
    number of tokens and length of its vector of counts."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = lists.flatten()
    of = np.repeat(np.arange(len(texts)), sizes)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    blank = np.asarray(pc.equal(coded.dictionary, ""), dtype=bool)
    term = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, terms), -1), dtype=np.int64)
    pair, count = np.unique(of[~blank[codes]] * max(1, len(blank)) + codes[~blank[codes]], return_counts=True)
    text, code = np.divmod(pair, max(1, len(blank)))
    length = np.sqrt(np.bincount(text, count.astype(np.float64) ** 2, minlength=len(texts)))
    tokens = np.bincount(text, count, minlength=len(texts))
    met = term[code] >= 0
    return text[met], term[code][met], count[met], tokens, length


def _sparse_topk(docs: DataFrame, queries: DataFrame, k: int, key: str, stats: Statistics | None, config: EngineConfig) -> DataFrame:
    """The k best texts of each question by summed term weights: BM25 with `stats`, else the cosine of counts.

    The join of terms with questions is a sparse product inside the tasks: a slice of questions is
    sent as an inverted list, whose size is bounded by the slice; a task meets its texts with it in
    blocks and keeps k rows a question. So neither matches nor scores are ever shuffled, and a
    term that every text has costs no hot key.
    """
    schema = f"qid long, {key} string, score double"
    texts = spread(docs.where(F.col("text").isNotNull()).select(F.col(key).alias("k"), F.array_join(T.tokens(F.col("text")), " ").alias("t")))
    out = None
    k1, b = config.bm25_k1, config.bm25_b
    mean_length = stats.mean_length if stats else 1.0
    bm25 = stats is not None
    for rows in _query_slices(queries, QUERIES_A_SLICE):
        asked = _Asked.of(rows)
        if stats is not None:
            at = {w: i for i, w in enumerate(asked.terms)}
            for r in stats.terms.join(docs.sparkSession.createDataFrame([(w,) for w in at], "term string"), "term").select("term", "idf").collect():  # terms of the slice
                asked.weights[at[r["term"]]] = r["idf"]
        sent = docs.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            a = sent.value
            n_q, terms = len(a.qids), pa.array(a.terms, pa.large_string())
            per_block = max(1, min(1000, 4_000_000 // max(1, n_q)))
            best: pd.DataFrame | None = None
            for pdf in batches:
                keys, all_texts = pdf["k"].to_numpy(), pdf["t"]
                parts: list[pd.DataFrame] = [] if best is None else [best]
                for lo in range(0, len(keys), per_block):
                    block = all_texts.iloc[lo : lo + per_block]
                    text, term, count, tokens, length = _matches(block, terms)
                    if not len(text):
                        continue
                    n = count.astype(np.float64)
                    w = a.weights[term] * n * (k1 + 1) / (n + k1 * (1 - b + b * tokens[text] / mean_length)) if bm25 else n / length[text]
                    reps = a.lens[term]
                    at = np.repeat(a.starts[term] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
                    flat = a.q_of[at] * len(block) + np.repeat(text, reps)
                    score = np.bincount(flat, np.repeat(w, reps) * a.times[at], minlength=n_q * len(block)).reshape(n_q, len(block))
                    met = np.zeros(n_q * len(block), dtype=bool)
                    met[flat] = True
                    score = np.where(met.reshape(score.shape), np.round(score if bm25 else score / a.norms[:, None], 6), -np.inf)
                    least = np.partition(score, -k, axis=1)[:, -k] if len(block) > k else np.full(n_q, -np.inf)
                    row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))  # with all ties of the last
                    parts.append(pd.DataFrame({"qid": a.qids[row], key: keys[lo + col], "score": score[row, col]}))
                if parts:
                    best = _best(parts, k, key)
            yield best if best is not None else pd.DataFrame({"qid": [], key: [], "score": []}).astype({"qid": "int64", key: "object", "score": "float64"})

        hits = texts.mapInPandas(run, schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema + ", rank int")
    return ranked(out, k, item=key)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT, key: str = "child_id", source_type: str | None = None, stats: Statistics | None = None) -> DataFrame:
    """Okapi scores of every text that shares a term with a question; the k best of each.

    `queries`: qid, question; a term asked twice counts twice. Statistics always cover all texts;
    `source_type` only filters the results.
    """
    pool = docs if source_type is None else docs.where(F.col("source_type") == source_type)
    return _sparse_topk(pool, queries, k or config.bm25_k, key, stats or statistics(docs, config), config)


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT, key: str = "child_id") -> DataFrame:
    """The offline dense channel: cosine of term counts."""
    return _sparse_topk(docs, queries, k or config.dense_k, key, None, config)


# ---- dense vectors ---------------------------------------------------------------------------


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", embedding: str = "embedding", exclude_self: bool = True, config: EngineConfig = DEFAULT) -> DataFrame:
    """Exact cosine neighbours (qid, key, score, rank) of each query vector.

    Queries are sent to the executors in slices checked to fit `broadcast_bytes`; each slice is one
    pass over the vectors. A task keeps only its k best of each query, so what is shuffled is k
    rows a query and task. Null vectors, and vectors without length, match nothing.
    """
    queries = queries.where(F.col(embedding).isNotNull()).select("qid", F.col(embedding).alias("q"))
    dim = queries.agg(F.max(F.size("q")).alias("d")).first()["d"]
    schema = f"qid long, {key} long, score double"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    per_slice = max(1, config.broadcast_bytes // (8 * dim))
    n_slices = -(-queries.count() // per_slice)
    found = None
    for s in range(max(1, n_slices)):
        part = queries if n_slices <= 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_slices)) == s)
        rows = part.collect()  # at most about per_slice rows
        ids = np.array([r["qid"] for r in rows], dtype=np.int64)
        q = np.array([r["q"] for r in rows], dtype=np.float64).reshape(len(rows), dim)
        length = np.sqrt((q * q).sum(axis=1))
        q, ids = q[length > 0] / length[length > 0, None], ids[length > 0]
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def near(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                pdf = pdf[pdf["e"].notna()]
                if not len(pdf) or not len(ids):
                    continue
                v = np.stack([np.asarray(x, dtype=np.float64) for x in pdf["e"]])
                norm = np.sqrt((v * v).sum(axis=1))
                v, keys = v[norm > 0] / norm[norm > 0, None], pdf["k"].to_numpy()[norm > 0]
                parts = [] if best is None else [best]
                for lo in range(0, len(ids), 1024):
                    sims = np.round(q[lo : lo + 1024] @ v.T, 6)
                    if exclude_self:
                        sims[ids[lo : lo + 1024, None] == keys[None, :]] = -np.inf
                    least = np.partition(sims, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(sims), -np.inf)
                    row, col = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))  # with all ties of the last
                    parts.append(pd.DataFrame({"qid": ids[lo + row], key: keys[col], "score": sims[row, col]}))
                best = _best(parts, k, key)
            yield best if best is not None else pd.DataFrame({"qid": [], key: [], "score": []}).astype({"qid": "int64", key: "int64", "score": "float64"})

        hits = spread(vectors).select(F.col(key).cast("long").alias("k"), F.col(embedding).alias("e")).mapInPandas(near, schema)
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, k, item=key)


# ---- fusion ----------------------------------------------------------------------------------


def _fused(dense: DataFrame, sparse: DataFrame, identity: DataFrame, alphas: list[float], config: EngineConfig, key: str) -> DataFrame:
    """(qid, parent_id, text, key, score0, score1…): a score for each weight of the dense list, from one join."""
    term = lambda df, weights: df.select("qid", key, *[(F.lit(w) / (config.rrf_k + F.col("rank"))).alias(f"x{i}") for i, w in enumerate(weights)])
    both = term(dense, alphas).unionByName(term(sparse, [1 - a for a in alphas])).join(identity.select(key, "parent_id", "text"), key)
    return both.groupBy("qid", "parent_id", "text").agg(*[F.round(F.sum(f"x{i}"), 9).alias(f"score{i}") for i in range(len(alphas))], F.min(key).alias(key))


def rrf(dense: DataFrame, sparse: DataFrame, identity: DataFrame, top: int = 40, alpha: float | None = None, config: EngineConfig = DEFAULT, key: str = "child_id") -> DataFrame:
    """Weighted reciprocal-rank fusion (qid, parent_id, text, child_id, score, rank).

    `identity` gives parent_id and text of each chunk: equal texts of one section fuse into one
    candidate and add up, within a list as well.
    """
    fused = _fused(dense, sparse, identity, [config.rrf_alpha if alpha is None else alpha], config, key)
    return ranked(fused.withColumnRenamed("score0", "score"), top, item=key)


def rrf_sweep(dense: DataFrame, sparse: DataFrame, identity: DataFrame, alphas: list[float], top: int = 40, config: EngineConfig = DEFAULT, key: str = "child_id") -> DataFrame:
    """`rrf` by several weights at once (alpha, qid, parent_id, child_id, score, rank): the lists are made and joined once."""
    fused = _fused(dense, sparse, identity, alphas, config, key)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"score{i}").alias("score")) for i, a in enumerate(alphas)]))
    return ranked(fused.select("qid", "parent_id", key, each.alias("x")).select("x.alpha", "qid", "parent_id", key, "x.score"), top, by=("qid", "alpha"), item=key)


def merge_dedup(first: DataFrame, second: DataFrame, identity: DataFrame, key: str = "child_id") -> DataFrame:
    """Two lists one after the other; of equal (parent_id, text) the first stays."""
    both = first.select("qid", key, "score", "rank", F.lit(0).alias("src")).unionByName(second.select("qid", key, "score", "rank", F.lit(1).alias("src")))
    both = both.join(identity.select(key, "parent_id", "text"), key)
    w = Window.partitionBy("qid", "parent_id", "text").orderBy("src", "rank")
    kept = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    order = Window.partitionBy("qid").orderBy("src", "rank")
    return kept.withColumn("position", F.row_number().over(order)).select("qid", "position", key, "parent_id", "score")


def lexical_scores(question: Column, text: Column) -> Column:
    """The offline pair scorer in [0, 1]: share of the question's words that the text has."""
    q, d = T.word_set(question, 3), T.word_set(text, 3)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)).cast("double") / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, queries: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT, scorer=lexical_scores) -> DataFrame:
    """The best candidates by pair score; equal scores keep the order they had.

    `scorer` is a column function, or a `PairScorer`; one that isn't available, and pairs it can't
    score, keep the order of fusion.
    """
    c = candidates.where(F.col("rank") <= config.rerank_candidates).withColumnRenamed("rank", "before")
    asked = c.join(queries.select("qid", "question"), "qid")
    if callable(scorer):
        scored = asked.withColumn("score", F.round(scorer(F.col("question"), F.col("text")), 6))
        order = [F.desc("score"), "before"]
    elif not scorer.available:
        scored, order = asked, ["before"]
    else:
        pairs = providers.score_pairs(asked, scorer)
        scored = pairs.withColumn("score", F.coalesce(F.round("pair_score", 6), "score"))
        order = [F.desc_nulls_last("pair_score"), "before"]
    w = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (k or config.final_children)).drop("question", "before", "pair_score")


def to_parents(candidates: DataFrame, parents: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks lifted to their sections: the first chunk of a section gives its score; k sections.

    Chunks whose section is missing are dropped. `candidates`: qid, parent_id, rank, score.
    """
    w = Window.partitionBy("qid", "parent_id").orderBy("rank")
    first = candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("qid", "parent_id", "score", F.col("rank").alias("child_rank"))
    lifted = first.join(parents.select("parent_id", *[c for c in ("source", "source_type", "section", "source_url", "title", "source_id") if c in parents.columns]), "parent_id")
    order = Window.partitionBy("qid").orderBy("child_rank", "parent_id")
    return lifted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (k or config.final_parents))


def round_robin(lists: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Position by position over the lists of a question's parts; a section once; k sections.

    `lists`: qid, q_idx, rank, parent_id, score.
    """
    w = Window.partitionBy("qid", "parent_id").orderBy("rank", "q_idx")
    once = lists.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    order = Window.partitionBy("qid").orderBy("rank", "q_idx")
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= (k or config.final_parents)).select("qid", "position", "parent_id", "q_idx", "score")


def sub_queries(results: DataFrame) -> DataFrame:
    """(qid, q_idx, question): the rewritten question first, then parts that differ from those before."""
    parts = F.concat(F.array(T.non_empty(F.col("rewritten_query"), F.col("query"))), F.coalesce("sub_queries", F.array().cast("array<string>")))
    each = results.select("qid", F.posexplode(parts).alias("pos", "question")).where(F.trim("question") != "")
    w = Window.partitionBy("qid", F.lower(F.trim("question"))).orderBy("pos")
    kept = each.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return kept.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("pos")) - 1).alias("q_idx"), "question")


def retrieve(children: DataFrame, parents: DataFrame, queries: DataFrame, mode: str = "hybrid_rerank", k: int | None = None, source_type: str | None = None, config: EngineConfig = DEFAULT, stats: Statistics | None = None, scorer=lexical_scores) -> DataFrame:
    """Sections for each question in one of the modes dense, hybrid and hybrid_rerank."""
    if mode not in ("dense", "hybrid", "hybrid_rerank"):
        raise ValueError(f"unknown mode {mode}")
    pool = children if source_type is None else children.where(F.col("source_type") == source_type)
    dense = cosine_topk(pool, queries, config=config)
    if mode == "dense":
        found = dense.join(children.select("child_id", "parent_id", "text"), "child_id")
        final = found.where(F.col("rank") <= config.final_children)
    else:
        sparse = bm25_topk(children, queries, config=config, source_type=source_type, stats=stats)
        top = config.final_children if mode == "hybrid" else config.rerank_candidates
        final = rrf(dense, sparse, children, top, config=config)
        if mode == "hybrid_rerank":
            final = rerank(final, queries, config=config, scorer=scorer)
    return to_parents(final, parents, k, config)


class Engine:
    """An index that is counted once and asked many times.

    Chunks and sections stay the tables they are, read by columns as each search needs them; the
    term statistics are written once, before the first search that needs them.
    """

    def __init__(self, children: DataFrame, parents: DataFrame, config: EngineConfig = DEFAULT, scorer=lexical_scores) -> None:
        self.children, self.parents, self.config, self.scorer = children, parents, config, scorer

    @cached_property
    def stats(self) -> Statistics:
        return statistics(self.children, self.config)

    def retrieve(self, queries: DataFrame, mode: str = "hybrid_rerank", k: int | None = None, source_type: str | None = None) -> DataFrame:
        stats = None if mode == "dense" else self.stats
        return retrieve(self.children, self.parents, queries, mode, k, source_type, self.config, stats, self.scorer)
