"""Queries over refusal, grounding, ranking and calibration, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, goldens, metrics, reports
from ..session import table
from . import pipeline
from . import sql as Q


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_results").where("result_id is not null").dropDuplicates(["result_id"])


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_unanswerable_only").where("item_id is not null").dropDuplicates(["item_id"])


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parents").dropDuplicates(["parent_id"])


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select(F.col("result_id").alias("qid"), F.posexplode("hits").alias("p", "h")).select("qid", (F.col("p") + 1).alias("rank"), "h.parent_id", "h.source", F.col("h.dist").alias("score"))


def refusal_flags(spark, d):
    return _results(spark, d).select("result_id", metrics.is_refusal(F.col("answer")).alias("is_refusal"))


def refusal_confusion(spark, d):
    f = _items(spark, d).select("category", F.col("ground_truth"), (F.col("category") == "unanswerable").alias("wanted")).withColumn("made", metrics.is_refusal(F.col("ground_truth")))
    return metrics.confusion(f.where("category is not null"))


def relevance(spark, d):
    # texts and sets of words are many times what the files' sizes let Spark expect, so they may not be sent through the
    # driver; texts are shuffled, which are smaller than their words
    texts = _parents(spark, d).select("parent_id", "text").hint("merge")
    gold = _results(spark, d).select(F.col("result_id").alias("qid"), metrics.gold_words(F.col("contexts")).alias("gold")).hint("merge")
    h = _hits(spark, d).select("qid", "rank", "parent_id").join(texts, "parent_id").join(gold, "qid").select("qid", "rank", T.word_set(F.col("text")).alias("hit"), "gold")
    return h.select("qid", "rank", F.round(metrics.relevance(F.col("gold"), F.col("hit")), 6).alias("relevance"), F.size("gold").alias("n_gold"))


def ranking(spark, d):
    m = metrics.ranking(relevance(spark, d))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("hit", "rr", "precision", "ndcg")])


def category_report(spark, d):
    i = _items(spark, d).withColumn("refused", metrics.is_refusal(F.col("ground_truth")))
    return i.rollup("category").agg(F.grouping("category").cast("int").alias("level"), F.count("*").alias("n"), F.sum(F.col("refused").cast("int")).alias("n_refused"), F.count_distinct("question").alias("n_questions"))


def _scored(spark, d):
    r = table(spark, d, "reranker_calibration").where("question_id is not null").dropDuplicates(["question_id"])
    return r.select("dataset", "retrieval_mode", "category", F.col("best_reranker_score").alias("score"), F.col("is_unanswerable").alias("unanswerable"))


def calibrate(spark, d):
    return metrics.calibrate(_scored(spark, d), ["dataset", "retrieval_mode"])


def calibration_stats(spark, d):
    s = _scored(spark, d).where("score is not null and not isnan(score) and unanswerable is not null")
    w = Window.partitionBy("dataset", "unanswerable").orderBy("score")
    n = F.count("*").over(Window.partitionBy("dataset", "unanswerable"))
    ordered = s.groupBy("dataset", "unanswerable", "score").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(w)
    total = F.sum("c").over(Window.partitionBy("dataset", "unanswerable"))
    med = ordered.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") > F.floor(F.col("total") / 2))
    return med.groupBy("dataset", "unanswerable").agg(F.min("score").alias("upper_median"), F.first("total").alias("n"))


def gate_m1(spark, d):
    q = _results(spark, d).select(F.col("result_id").alias("qid"))
    return metrics.gate(_hits(spark, d).select("qid", "score"), q, 0.1119)


def hit_stats(spark, d):
    h = _hits(spark, d)
    return h.groupBy("qid").agg(
        F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score") - F.min("score"), 6).alias("score_range"), F.min_by("score", "rank").alias("top_score"),
        F.count_distinct("parent_id").alias("n_parents"), F.count_distinct("source").alias("n_sources"),
    )


def source_summary(spark, d):
    h = _hits(spark, d).join(_parents(spark, d).select("parent_id", "source_type"), "parent_id")
    c = h.groupBy("qid", F.coalesce("source_type", F.lit("?")).alias("t")).agg(F.count("*").alias("n"))
    return c.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("t", F.lit(" ×"), F.col("n").cast("string")))), ", ").alias("source_types"))


def keywords(spark, d):
    return _results(spark, d).select("result_id", F.array_join(F.array_sort(metrics.keywords(F.col("query"))), " ").alias("keywords"))


def lexical_overlap(spark, d):
    return _results(spark, d).select("result_id", F.round(metrics.lexical_overlap(F.col("query"), F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n")), 6).alias("overlap"))


def citation_report(spark, d):
    r = _results(spark, d).select(F.col("result_id").alias("qid"), "answer", F.size(F.coalesce("hits", F.array().cast("array<struct<parent_id:string,source:string,dist:double>>"))).alias("n_documents"))
    a = citations.analysis(r)
    return a.select("qid", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), F.array_join(F.transform("uncited", lambda x: x.cast("string")), ",").alias("uncited"), "rate")


def citation_labels(spark, d):
    return _parents(spark, d).select("parent_id", citations.label().alias("label"))


def contexts(spark, d):
    p = _parents(spark, d).select("parent_id", "text", citations.label().alias("label"))
    return citations.context(_hits(spark, d).join(p, "parent_id"), _results(spark, d).select(F.col("result_id").alias("qid")))


def set_operations(spark, d):
    r = _results(spark, d)
    q, a = T.word_set(F.col("query")), T.word_set(F.col("answer"))
    return r.select("result_id", F.size(F.array_intersect(q, a)).alias("n_shared"), F.size(F.array_union(q, a)).alias("n_all"), F.size(F.array_except(q, a)).alias("n_missing"), F.round(T.overlap_ratio(q, a), 6).alias("overlap"))


def truncation(spark, d):
    return _results(spark, d).select("result_id", T.truncated(F.col("answer"), 60).alias("short"))


def bootstrap(spark, d):
    r = ranking(spark, d)
    s = r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("score")) for c in ("hit", "rr", "precision", "ndcg")])).alias("x")).select("x.*")
    return metrics.bootstrap(s)


def golden_sample(spark, d):
    return goldens.sample(_items(spark, d).select("item_id", "question", "category"), 50, "item_id")


def unanswerable_synthesis(spark, d):
    r = _results(spark, d).select(F.col("result_id").alias("qid"), F.col("query").alias("question"), F.get("hits", 0)["source"].alias("source"), F.get("contexts", 0).alias("context"))
    return goldens.unanswerable(r, "The course does not cover this.")


def golden_categories(spark, d):
    return _results(spark, d).select("result_id", goldens.category(F.coalesce("contexts", F.array().cast("array<string>"))).alias("category"))


def per_answer(spark, d):
    """The four levels of the report of each stored answer, side by side."""
    r = _results(spark, d).withColumnRenamed("result_id", "qid")
    verdicts = r.select("qid", F.when(F.col("qid") % 3 < 2, F.col("qid") % 3 == 0).alias("grounded"))
    p = reports.per_answer(r, _parents(spark, d), verdicts)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    levels = [("pipeline", x) for x in "n_sub_queries n_contexts n_sections refused answer_length score_top score_mean score_min score_max score_range refused_by_gate refused_by_judge".split()]
    levels += [("judge", "verdict")] + [("retrieval", x) for x in "overlap n_keywords n_matched source_types n_titles n_chars".split()]
    counts = ("n_keywords", "n_matched", "n_titles", "n_chars")
    return p.select("qid", *[(F.coalesce(f"{a}.{b}", F.lit(-1)) if b in counts else F.col(f"{a}.{b}")).alias(b) for a, b in levels], listed(F.col("citations.cited")).alias("cited"), listed(F.col("citations.uncited")).alias("uncited"), F.array_join("citations.sources", ",").alias("sources"), F.col("citations.rate").alias("rate"))


def grounding(spark, d):
    r = _results(spark, d)
    return reports.grounding(r.select(F.col("result_id").alias("qid"), "answer", "contexts", F.col("query").alias("reference")))


def _goldens(spark, d):
    """Stored questions as test items, each in the category of the test item with its number."""
    i = _items(spark, d).select(F.col("item_id").alias("result_id"), "category")
    return _results(spark, d).join(i, "result_id", "left").select(F.col("result_id").alias("qid"), F.col("contexts").alias("gold_context"), "category", "answer")


def _read_hits(spark, d):
    return _hits(spark, d).join(_parents(spark, d).select("parent_id", "text"), "parent_id").select("qid", "rank", "text")


def _grades(g):
    return g.select("qid", F.when(F.col("qid") % 4 > 0, (F.col("qid") % 5 + 1) / 5.0).alias("correctness"))


def evaluation_report(spark, d):
    g = _goldens(spark, d)
    return pipeline.evaluate(g, g.drop("answer"), _read_hits(spark, d), grades=_grades(g))


def evaluation_intervals(spark, d):
    g = _goldens(spark, d)
    return pipeline.evaluate(g, g.drop("answer"), _read_hits(spark, d), grades=_grades(g), intervals=True)


def calibration_scores(spark, d):
    return metrics.top_scores(_hits(spark, d), _goldens(spark, d))


def calibrated_from_hits(spark, d):
    return metrics.calibrate(calibration_scores(spark, d))


def golden_generation(spark, d):
    c = table(spark, d, "children").select("source", "parent_id", "child_no", "text").where("text is not null").dropDuplicates(["parent_id", "child_no"])
    return goldens.single_passage(c).unionByName(goldens.multi_passage(c))


QUERIES = {
    "per_answer_report": per_answer,
    "grounding_proxies": grounding,
    "evaluation_report": evaluation_report,
    "evaluation_intervals": evaluation_intervals,
    "calibration_scores": calibration_scores,
    "calibrated_from_hits": calibrated_from_hits,
    "golden_generation": golden_generation,
    "refusal_flags": refusal_flags,
    "refusal_confusion": refusal_confusion,
    "overlap_relevance": relevance,
    "ranking_metrics": ranking,
    "category_report": category_report,
    "calibrate_threshold": calibrate,
    "calibration_medians": calibration_stats,
    "gate_m1": gate_m1,
    "hit_stats": hit_stats,
    "source_summary": source_summary,
    "keywords": keywords,
    "lexical_overlap": lexical_overlap,
    "citations": citation_report,
    "citation_labels": citation_labels,
    "format_context": contexts,
    "set_operations": set_operations,
    "truncated_answers": truncation,
    "bootstrap_ci": bootstrap,
    "golden_sample": golden_sample,
    "unanswerable_synthesis": unanswerable_synthesis,
    "golden_categories": golden_categories,
}

_R = "WITH r AS (SELECT DISTINCT ON (result_id) * FROM rag_results WHERE result_id IS NOT NULL)"
_I = "WITH i AS (SELECT DISTINCT ON (item_id) * FROM test_unanswerable_only WHERE item_id IS NOT NULL)"
_H = _R + ", h AS (SELECT result_id AS qid, generate_subscripts(hits, 1) AS rank, unnest(hits, recursive := true) FROM r), p AS (SELECT DISTINCT ON (parent_id) * FROM parents)"


def _refuses(c: str) -> str:
    any_ = " OR ".join("contains(lower(trim(coalesce({0}, ''))), '{1}')".format(c, p.replace("'", "''")) for p in metrics.REFUSAL_PHRASES)
    return f"(trim(coalesce({c}, '')) = '{metrics.REFUSAL_MESSAGE}' OR (length(trim(coalesce({c}, ''))) < 500 AND ({any_})))"


_STOP = "[" + ",".join(f"'{w}'" for w in metrics.STOP_WORDS) + "]"


def _keys(c: str) -> str:
    return f"list_filter({Q.words(c, 3)}, lambda x: NOT list_contains({_STOP}, x))"


_REL = _H + f""", t AS (SELECT qid, rank, text, coalesce(contexts, []) AS gold FROM h JOIN p USING (parent_id) JOIN r ON r.result_id = h.qid),
w AS (SELECT qid, rank, {Q.words('text')} AS hw, gold FROM t),
rel AS (SELECT qid, rank, round(coalesce(list_max(list_transform(gold, lambda g: {Q.overlap(Q.words('g'), 'hw')})), 0), 6) AS relevance, len(gold) AS n_gold FROM w)"""
_SC = "WITH s AS (SELECT DISTINCT ON (question_id) dataset, retrieval_mode, best_reranker_score AS score, is_unanswerable AS u FROM reranker_calibration WHERE question_id IS NOT NULL), g AS (SELECT * FROM s WHERE score IS NOT NULL AND NOT isnan(score) AND u IS NOT NULL)"
_SENT = r"list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')"
_GOLD = _REL + ", i AS (SELECT DISTINCT ON (item_id) item_id, category FROM test_unanswerable_only WHERE item_id IS NOT NULL), gold AS (SELECT result_id AS qid, category, answer FROM r LEFT JOIN i ON i.item_id = r.result_id)"
_TOP = _H + ", i AS (SELECT DISTINCT ON (item_id) item_id, category FROM test_unanswerable_only WHERE item_id IS NOT NULL), top AS (SELECT qid, max(dist) AS score, any_value(category) = 'unanswerable' AS unanswerable FROM h JOIN i ON i.item_id = h.qid WHERE dist IS NOT NULL AND category IS NOT NULL GROUP BY qid)"
_METRICS = """, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank) AS i FROM rel JOIN gold USING (qid) WHERE category IS DISTINCT FROM 'unanswerable'),
m AS (SELECT qid, max(n_gold) AS n_gold, max(CASE WHEN relevance >= 0.4 AND rank <= 4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit, min(CASE WHEN relevance >= 0.4 THEN rank END) AS first, count(*) FILTER (relevance >= 0.4 AND rank <= 4) AS good, count(*) AS n,
 sum(CASE WHEN rank <= 4 THEN relevance / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 4 THEN relevance / log2(i + 1.0) ELSE 0 END) AS idcg FROM k GROUP BY qid),
x AS (SELECT qid, CASE WHEN n_gold > 0 THEN hit END AS hit, CASE WHEN n_gold > 0 THEN coalesce(1.0::DOUBLE / first, 0) END AS mrr, CASE WHEN n_gold > 0 THEN good / least(4, n) END AS precision, CASE WHEN n_gold > 0 THEN CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END END AS ndcg FROM m)"""
ORACLES = {
    "per_answer_report": _H
    + rf""", s AS (SELECT result_id AS qid, list_filter(list_transform(coalesce(hits, []), lambda x: x.dist), lambda x: x IS NOT NULL) AS sc, coalesce(hits, []) AS hs, coalesce(contexts, []) AS cx, coalesce(answer, '') AS an, coalesce(refused, false) AS ref, query, sub_queries FROM r),
g AS (SELECT *, (len(hs) = 0 OR coalesce(list_max(sc) < 0.1119, false)) AS gate, CASE WHEN qid % 3 < 2 THEN qid % 3 = 0 END AS ok, {_keys('query')} AS kw, {Q.words("array_to_string(cx, ' ')", 3)} AS cw,
 list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(an, '(?i)\[DOC\s*([0-9]{{1,6}})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND len(hs)))) AS c FROM s),
t AS (SELECT qid, string_agg(k || ' ×' || n, ', ' ORDER BY k || ' ×' || n) AS source_types FROM (SELECT qid, coalesce(p.source_type, '?') AS k, count(*) AS n FROM h JOIN p USING (parent_id) GROUP BY ALL) GROUP BY qid),
u AS (SELECT qid, count(DISTINCT section) FILTER (section <> '') AS n_titles FROM h JOIN p USING (parent_id) GROUP BY qid)
SELECT qid, coalesce(len(sub_queries), 0) AS n_sub_queries, len(cx) AS n_contexts, len(list_distinct(list_transform(hs, lambda x: x.parent_id))) AS n_sections, ref AS refused, length(an) AS answer_length,
 round(sc[1], 3) AS score_top, round(list_avg(sc), 3) AS score_mean, round(list_min(sc), 3) AS score_min, round(list_max(sc), 3) AS score_max, round(list_max(sc) - list_min(sc), 3) AS score_range, ref AND gate AS refused_by_gate, ref AND NOT gate AS refused_by_judge,
 CASE WHEN ref THEN 'refused' WHEN ok IS NULL THEN 'not judged' WHEN ok THEN 'grounded' ELSE 'ungrounded' END AS verdict,
 CASE WHEN len(cx) > 0 THEN round(CASE WHEN len(kw) > 0 THEN len(list_intersect(kw, cw)) / len(kw) ELSE 0 END, 3) END AS overlap, CASE WHEN len(cx) > 0 THEN len(kw) ELSE -1 END AS n_keywords, CASE WHEN len(cx) > 0 THEN len(list_intersect(kw, cw)) ELSE -1 END AS n_matched,
 CASE WHEN len(cx) > 0 THEN coalesce(source_types, '') END AS source_types, CASE WHEN len(cx) > 0 THEN coalesce(n_titles, 0) ELSE -1 END AS n_titles, CASE WHEN len(cx) > 0 THEN coalesce(list_sum(list_transform(cx, lambda x: length(x)))::BIGINT, 0) ELSE -1 END AS n_chars,
 CASE WHEN an <> '' AND len(hs) > 0 THEN array_to_string(c, ',') END AS cited, CASE WHEN an <> '' AND len(hs) > 0 THEN array_to_string(list_filter(range(1, len(hs) + 1), lambda x: NOT list_contains(c, x)), ',') END AS uncited,
 CASE WHEN an <> '' AND len(hs) > 0 THEN array_to_string(list_transform(c, lambda x: CASE WHEN length(hs[x].source) > 30 THEN left(hs[x].source, 27) || '...' ELSE coalesce(nullif(hs[x].source, ''), CASE WHEN hs[x].source IS NULL THEN '?' ELSE '(empty)' END) END), ',') END AS sources,
 CASE WHEN an <> '' AND len(hs) > 0 THEN round(len(c) / len(hs), 2) END AS rate FROM g LEFT JOIN t USING (qid) LEFT JOIN u USING (qid)""",
    "grounding_proxies": _R
    + f""", a AS (SELECT result_id AS qid, list_filter(list_transform({_SENT}, lambda s: {Q.words('s')}), lambda w: len(w) > 0) AS told, list_transform(coalesce(contexts, []), lambda c: {Q.words('c')}) AS rd, {Q.words('query')} AS wanted FROM r),
g AS (SELECT *, list_transform(rd, lambda c: CASE WHEN {Q.overlap('wanted', 'c')} >= 0.4 THEN 1 ELSE 0 END) AS good, list_filter(told, lambda s: len(list_filter(rd, lambda c: len(list_intersect(s, c)) >= 0.5 * len(s))) > 0) AS held FROM a)
SELECT qid, CASE WHEN len(told) > 0 THEN round(len(held) / len(told), 6) END AS faithfulness, CASE WHEN len(good) > 0 THEN round(CASE WHEN list_sum(good) > 0 THEN list_sum(list_transform(good, lambda x, i: x * list_sum(good[1:i]) / i)) / list_sum(good) ELSE 0 END, 6) END AS context_precision FROM g""",
    "evaluation_report": _GOLD
    + _METRICS
    + f""", f AS (SELECT gold.qid, category, category = 'unanswerable' AS wanted, {_refuses('answer')} AS made, hit, mrr, precision, ndcg, CASE WHEN category IS DISTINCT FROM 'unanswerable' AND gold.qid % 4 > 0 THEN (gold.qid % 5 + 1) / 5.0::DOUBLE END AS correctness FROM gold LEFT JOIN x ON x.qid = gold.qid)
SELECT category, grouping(category)::INT AS level, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(correctness), 6) AS correctness,
 count(*) FILTER (category IS NOT NULL AND wanted AND made) AS tp, count(*) FILTER (category IS NOT NULL AND NOT wanted AND made) AS fp, count(*) FILTER (category IS NOT NULL AND wanted AND NOT made) AS fn, count(*) FILTER (category IS NOT NULL AND NOT wanted AND NOT made) AS tn,
 round(avg(CASE WHEN category IS NOT NULL THEN (wanted = made)::INT END), 6) AS refusal_correctness FROM f GROUP BY ROLLUP (category)""",
    "calibration_scores": _TOP + " SELECT * FROM top",
    "calibrated_from_hits": _TOP
    + """, d AS (SELECT score, count(*) FILTER (unanswerable) AS u, count(*) FILTER (NOT unanswerable) AS a FROM top WHERE NOT isnan(score) GROUP BY score),
x AS (SELECT score, (coalesce(sum(u) OVER b, 0) + sum(a) OVER () - coalesce(sum(a) OVER b, 0)) / (sum(u) OVER () + sum(a) OVER ()) AS accuracy FROM d WINDOW b AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT score AS threshold, accuracy FROM x QUALIFY row_number() OVER (ORDER BY accuracy DESC, score) = 1""",
    "refusal_flags": _R + f" SELECT result_id, {_refuses('answer')} AS is_refusal FROM r",
    "refusal_confusion": _I
    + f""", f AS (SELECT category = 'unanswerable' AS w, {_refuses('ground_truth')} AS m FROM i WHERE category IS NOT NULL),
c AS (SELECT count(*) FILTER (w AND m) AS tp, count(*) FILTER (NOT w AND m) AS fp, count(*) FILTER (w AND NOT m) AS fn, count(*) FILTER (NOT w AND NOT m) AS tn FROM f),
x AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM x""",
    "overlap_relevance": _REL + " SELECT * FROM rel",
    "ranking_metrics": _REL
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank) AS i FROM rel),
m AS (SELECT qid, max(n_gold) AS n_gold, max(CASE WHEN relevance >= 0.4 AND rank <= 4 THEN 1.0 ELSE 0.0 END) AS hit, min(CASE WHEN relevance >= 0.4 THEN rank END) AS first, count(*) FILTER (relevance >= 0.4 AND rank <= 4) AS good, count(*) AS n,
 sum(CASE WHEN rank <= 4 THEN relevance / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 4 THEN relevance / log2(i + 1.0) ELSE 0 END) AS idcg FROM k GROUP BY qid)
SELECT qid, CASE WHEN n_gold > 0 THEN hit::DOUBLE END AS hit, CASE WHEN n_gold > 0 THEN round(coalesce(1.0::DOUBLE / first, 0), 6) END AS rr, CASE WHEN n_gold > 0 THEN round(good / least(4, n), 6) END AS precision,
 CASE WHEN n_gold > 0 THEN round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) END AS ndcg FROM m""",
    "category_report": _I + f" SELECT category, grouping(category)::INT AS level, count(*) AS n, count(*) FILTER ({_refuses('ground_truth')}) AS n_refused, count(DISTINCT question) AS n_questions FROM i GROUP BY ROLLUP (category)",
    "calibrate_threshold": _SC
    + """, d AS (SELECT dataset, retrieval_mode, score, count(*) FILTER (u) AS u, count(*) FILTER (NOT u) AS a FROM g GROUP BY ALL),
x AS (SELECT *, (coalesce(sum(u) OVER b, 0) + sum(a) OVER w - coalesce(sum(a) OVER b, 0)) / (sum(u) OVER w + sum(a) OVER w) AS accuracy FROM d
 WINDOW b AS (PARTITION BY dataset, retrieval_mode ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY dataset, retrieval_mode))
SELECT dataset, retrieval_mode, score AS threshold, accuracy FROM x QUALIFY row_number() OVER (PARTITION BY dataset, retrieval_mode ORDER BY accuracy DESC, score) = 1""",
    "calibration_medians": _SC
    + ", o AS (SELECT dataset, u, score, row_number() OVER (PARTITION BY dataset, u ORDER BY score) AS i, count(*) OVER (PARTITION BY dataset, u) AS n FROM g) SELECT dataset, u AS unanswerable, score AS upper_median, n FROM o WHERE i = n // 2 + 1",
    "gate_m1": _R + " SELECT result_id AS qid, list_max(list_transform(hits, lambda x: x.dist)) AS top_score, (coalesce(len(hits), 0) = 0 OR coalesce(list_max(list_transform(hits, lambda x: x.dist)) < 0.1119, false)) AS refuse FROM r",
    "hit_stats": _H + " SELECT qid, max(dist) AS max_score, min(dist) AS min_score, round(avg(dist), 6) AS mean_score, round(max(dist) - min(dist), 6) AS score_range, arg_min(dist, rank) AS top_score, count(DISTINCT parent_id) AS n_parents, count(DISTINCT source) AS n_sources FROM h GROUP BY qid",
    "source_summary": _H + ", c AS (SELECT qid, coalesce(p.source_type, '?') AS t, count(*) AS n FROM h JOIN p USING (parent_id) GROUP BY ALL) SELECT qid, string_agg(t || ' ×' || n, ', ' ORDER BY t || ' ×' || n) AS source_types FROM c GROUP BY qid",
    "keywords": _R + f" SELECT result_id, array_to_string(list_sort({_keys('query')}), ' ') AS keywords FROM r",
    "lexical_overlap": _R + f""" SELECT result_id, CASE WHEN len({_keys('query')}) > 0 THEN round(len(list_intersect({_keys('query')}, {_keys("array_to_string(coalesce(contexts, []), chr(10))")})) / len({_keys('query')}), 6) END AS overlap FROM r""",
    "citations": _R
    + r""", n AS (SELECT result_id AS qid, coalesce(len(hits), 0) AS k, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(answer, ''), '(?i)\[DOC\s*([0-9]{1,6})\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND coalesce(len(hits), 0)))) AS c FROM r)
SELECT qid, array_to_string(c, ',') AS cited, array_to_string(list_filter(range(1, k + 1), lambda x: NOT list_contains(c, x)), ',') AS uncited, CASE WHEN k > 0 THEN round(len(c) / k, 2) END AS rate FROM n""",
    "citation_labels": f"WITH p AS (SELECT DISTINCT ON (parent_id) * FROM parents) SELECT parent_id, {Q.LABEL} AS label FROM p",
    "format_context": _H
    + f", l AS (SELECT parent_id, text, {Q.LABEL} AS label FROM p), g AS (SELECT qid, string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN l USING (parent_id) GROUP BY qid) SELECT r.result_id AS qid, coalesce(context, '{citations.NOTHING_FOUND}') AS context FROM r LEFT JOIN g ON g.qid = r.result_id",
    "set_operations": _R
    + f", w AS (SELECT result_id, {Q.words('query')} AS q, {Q.words('answer')} AS a FROM r) SELECT result_id, len(list_intersect(q, a)) AS n_shared, len(list_distinct(list_concat(q, a))) AS n_all, len(q) - len(list_intersect(q, a)) AS n_missing, round({Q.overlap('q', 'a')}, 6) AS overlap FROM w",
    "truncated_answers": _R + " SELECT result_id, CASE WHEN coalesce(length(answer), 0) = 0 THEN '(empty)' WHEN length(answer) > 60 THEN left(answer, 57) || '...' ELSE answer END AS short FROM r",
    "golden_categories": _R + " SELECT result_id, CASE WHEN coalesce(len(contexts), 0) > 1 THEN 'multi_passage' ELSE 'single_passage' END AS category FROM r",
}
