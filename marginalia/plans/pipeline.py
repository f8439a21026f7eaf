"""Questions to answers, in stages over whole batches.

Rows that a gate turns away leave before the costly stage and come back with the refusal; only the
rest reaches the models. Every stage is a DataFrame, so each may be cached, written or inspected.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import citations, metrics, providers, replies
from ..operators import retrieval as R
from ..session import cut_lineage

ANSWERER = "Answer from the labelled excerpts alone, cite the label of each excerpt you use, and say so if they don't hold the answer."
VERIFIER = "Judge whether each statement of the answer is found in the excerpts. End with VERDICT: ANCRÉ or VERDICT: HORS-CONTEXTE."
REWRITER = 'Rewrite the question so that it stands alone and split it if it asks several things. Reply with JSON: {"rewritten": "...", "sub_queries": []}.'


def _with_history(prompts: DataFrame, history: DataFrame | None) -> DataFrame:
    """Prompts (qid, prompt) after what was said before (qid, history), where something was."""
    if history is None:
        return prompts
    told = F.coalesce(F.concat(F.nullif(F.trim("history"), F.lit("")), F.lit("\n\n")), F.lit(""))
    return prompts.join(history.select("qid", "history"), "qid", "left").select("qid", F.concat(told, F.col("prompt")).alias("prompt"))


def rewrite(questions: DataFrame, model: providers.ChatModel | None = None, history: DataFrame | None = None) -> DataFrame:
    """(qid, query, rewritten_query, sub_queries). Without a model, or where it fails, the question itself."""
    if model is None:
        return questions.select("qid", F.col("question").alias("query"), F.col("question").alias("rewritten_query"), F.array().cast("array<string>").alias("sub_queries"))
    raw = providers.complete(_with_history(questions.select("qid", F.col("question").alias("prompt")), history), "qid", model, REWRITER)
    got = questions.join(raw, "qid", "left").withColumn("r", replies.rewritten(F.col("reply"), F.col("question")))
    return got.select("qid", F.col("question").alias("query"), F.col("r.rewritten").alias("rewritten_query"), F.col("r.sub_queries").alias("sub_queries"))


def search(asked: DataFrame, children: DataFrame, parents: DataFrame, mode: str = "hybrid_rerank", k: int | None = None, config: EngineConfig = DEFAULT, stats: R.Statistics | None = None) -> DataFrame:
    """Hits (qid, rank, parent_id, score) of all parts of each question, taken in turn."""
    parts = R.sub_queries(asked).withColumn("part", F.xxhash64("qid", "q_idx"))
    found = R.retrieve(children, parents, parts.select(F.col("part").alias("qid"), "question"), mode, k, config=config, stats=stats)
    lists = found.withColumnRenamed("qid", "part").join(parts.select("part", "qid", "q_idx"), "part").select("qid", "q_idx", "rank", "parent_id", "score")
    return R.round_robin(lists, k, config).select("qid", F.col("position").alias("rank"), "parent_id", "score")


def collect_scores(goldens: DataFrame, children: DataFrame, parents: DataFrame, mode: str = "hybrid_rerank", rewriter: providers.ChatModel | None = None, k: int | None = None, first: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """(qid, score, unanswerable) of test items (qid, question, category), by retrieval alone, as the gate will
    see it; `metrics.calibrate` gives the threshold. With `first` the first hit's score counts instead
    of the best."""
    asked = rewrite(goldens.where("category is not null").select("qid", "question"), rewriter)
    return metrics.top_scores(search(asked, children, parents, mode, k, config), goldens, first)


def answer(questions: DataFrame, children: DataFrame, parents: DataFrame, chat: providers.ChatModel, mode: str = "hybrid_rerank", judge: providers.ChatModel | None = None, rewriter: providers.ChatModel | None = None, threshold: float | None = None, history: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(qid, query, rewritten_query, sub_queries, contexts, answer, refused) of each question.

    The score gate acts only on rerank scores, which alone are on the threshold's scale. `history`
    (qid, history) is what was said before, for the rewriting and the answer.
    """
    asked = rewrite(questions, rewriter, history)
    hits = search(asked, children, parents, mode, config=config)
    labelled = hits.join(parents, "parent_id").withColumn("label", citations.label())
    q = asked.select("qid", F.col("query").alias("question"))
    passed = metrics.gate(hits, q, config.refusal_threshold if threshold is None else threshold, active=mode == "hybrid_rerank")
    context = citations.context(labelled, q)
    prompt = asked.join(context, "qid").join(passed, "qid").where("not refuse").select("qid", F.concat("query", F.lit("\n\n"), F.col("context")).alias("prompt"))
    drafted = providers.complete(_with_history(prompt, history), "qid", chat, ANSWERER)
    if judge is not None:
        check = drafted.join(prompt, "qid").select("qid", F.concat("prompt", F.lit("\n\nANSWER:\n"), F.coalesce("reply", F.lit(""))).alias("prompt"))
        verdict = providers.complete(check, "qid", judge, VERIFIER).select("qid", replies.grounded(F.col("reply")).alias("ok"))
        drafted = drafted.join(verdict, "qid").select("qid", F.when(F.col("ok"), F.col("reply")).alias("reply"))
    texts = labelled.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c")).select("qid", F.transform("c", lambda x: x["text"]).alias("contexts"))
    out = asked.join(texts, "qid", "left").join(drafted, "qid", "left")
    return out.select("qid", "query", "rewritten_query", "sub_queries", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), F.coalesce("reply", F.lit(metrics.REFUSAL_MESSAGE)).alias("answer"), F.col("reply").isNull().alias("refused"))


def answer_stream(question: str, context: str, chat: providers.HttpChat, history: str = "") -> Iterator[str]:
    """The parts of one answer as the model gives them, for a terminal; no judge looks over it."""
    return chat.stream(ANSWERER, "\n\n".join(x for x in (history, question, context) if x))


METRICS = ("hit", "mrr", "precision", "ndcg", "correctness")


def per_item(answers: DataFrame, goldens: DataFrame, hits: DataFrame, k: int = 4, grades: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(qid, category, wanted, made, hit, mrr, precision, ndcg, correctness) of each test item.

    `answers`: qid, answer. `goldens`: qid, gold_context, category. `hits`: qid, rank, text. `grades`:
    qid, correctness. Unanswerable items have no ranking metrics and no grade.
    """
    wanted = F.col("category") == "unanswerable"
    j = goldens.join(answers.select("qid", "answer"), "qid").withColumn("made", metrics.is_refusal(F.col("answer"))).withColumn("wanted", wanted)
    gold = goldens.where(F.coalesce(~wanted, F.lit(True))).select("qid", metrics.gold_words(F.col("gold_context")).alias("gold"))
    scored = hits.select("qid", "rank", T.word_set(F.col("text")).alias("hit")).join(gold, "qid")
    r = metrics.ranking(scored.select("qid", "rank", metrics.relevance(F.col("gold"), F.col("hit")).alias("relevance"), F.size("gold").alias("n_gold")), k, config)
    j = j.join(r, "qid", "left")
    j = j.withColumn("correctness", F.lit(None).cast("double")) if grades is None else j.join(grades.select("qid", F.nanvl("correctness", F.lit(None).cast("double")).alias("correctness")), "qid", "left")
    return j.select("qid", "category", "wanted", "made", "hit", F.col("rr").alias("mrr"), "precision", "ndcg", F.when(F.coalesce(~F.col("wanted"), F.lit(True)), F.col("correctness")).alias("correctness"))


def evaluate(answers: DataFrame, goldens: DataFrame, hits: DataFrame, k: int = 4, grades: DataFrame | None = None, intervals: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """One report row a category and one for all (category null, level 1).

    Items without a category count for ranking alone; unanswerable ones for refusals alone. With
    `intervals`, the bounds of each metric's mean at 95 %, rounded to four places.
    """
    items = per_item(answers, goldens, hits, k, grades, config)
    if intervals:
        items = cut_lineage(items)
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0).cast("long")))
    known, right = F.col("category").isNotNull(), F.col("wanted") == F.col("made")
    report = items.rollup("category").agg(
        F.grouping("category").cast("int").alias("level"), F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS],
        count(known & F.col("wanted") & F.col("made")).alias("tp"), count(known & ~F.col("wanted") & F.col("made")).alias("fp"), count(known & F.col("wanted") & ~F.col("made")).alias("fn"), count(known & ~F.col("wanted") & ~F.col("made")).alias("tn"),
        F.round(F.avg(F.when(known, right.cast("int"))), 6).alias("refusal_correctness"),
    )
    if not intervals:
        return report
    each = items.select("category", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("x")).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "category", "x.*")
    each = each.withColumn("category", F.when(F.col("level") == 0, F.col("category")))
    bounds = metrics.bootstrap(each, by=("level", "category", "metric"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.round(c, 4))).alias(f"{m}_{c}")
    wide = bounds.groupBy("level", "category").agg(*[of(m, c) for m in METRICS for c in ("lower", "upper")])
    r, w = report.alias("r"), wide.alias("w")
    return r.join(w, F.col("r.level").eqNullSafe(F.col("w.level")) & F.col("r.category").eqNullSafe(F.col("w.category")), "left").select("r.*", *[f"w.{m}_{c}" for m in METRICS for c in ("lower", "upper")])


GRADER = "Compare the answer with the reference and reply with one digit from 1 (wrong) to 5 (the same in substance)."


def correctness(saved: DataFrame, judge: providers.ChatModel) -> DataFrame:
    """(qid, correctness) of saved answers (qid, reference, answer) by a judge; null where it fails or gives no
    digit. It runs on a table of answers, so a judge can be tried again without answering again."""
    prompt = saved.select("qid", F.concat(F.lit("REFERENCE:\n"), F.coalesce("reference", F.lit("")), F.lit("\n\nANSWER:\n"), F.coalesce("answer", F.lit(""))).alias("prompt"))
    return providers.complete(prompt, "qid", judge, GRADER).select("qid", replies.grade(F.col("reply")).alias("correctness"))


def agreement(judged: DataFrame, human: DataFrame) -> DataFrame:
    """How near a judge comes to people: (n, mean_difference, mean_distance, within, r) of two tables
    (qid, correctness), joined by question; `within` is the share at most one grade apart."""
    j = judged.select("qid", F.col("correctness").alias("a")).join(human.select("qid", F.col("correctness").alias("b")), "qid").where("a is not null and b is not null")
    apart = F.abs(F.col("a") - F.col("b"))
    return j.agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"), F.avg(apart).alias("mean_distance"), F.avg((apart <= 0.2 + 1e-9).cast("int")).alias("within"), F.corr("a", "b").alias("r"))


def ingest(documents: DataFrame, embedder: providers.Embedder | None = None, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(parents, children, vectors) of normalised documents; one narrow stage up to the vectors."""
    from ..operators import chunking

    parents, children = chunking.chunk(documents, config)
    return parents, children, None if embedder is None else providers.embed(children, "child_id", "embed_text", embedder)
