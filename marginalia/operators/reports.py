"""What can be said of one answer: how it came about, its judge, what was retrieved, what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from . import citations, metrics

NO_HITS = "array<struct<parent_id:string,source:string,dist:double>>"


def per_answer(results: DataFrame, sections: DataFrame, verdicts: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(qid, pipeline, judge, retrieval, citations): four structs for each answer.

    `results`: qid, query, rewritten_query, sub_queries, hits (parent_id, source, dist), contexts,
    answer, refused. `sections`: parent_id, source_type, section. `verdicts`: qid, grounded.

    `retrieval` is null without contexts, `citations` without an answer or hits, scores without
    hits. An answer that was refused with hits good enough was refused by the judge.
    """
    hits = F.coalesce("hits", F.array().cast(NO_HITS))
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    r = results.withColumn("hits", hits).withColumn("contexts", contexts).withColumn("answer", F.coalesce("answer", F.lit("")))
    scores = F.filter(F.transform("hits", lambda h: h["dist"]), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    scored = lambda c: F.when(F.size(scores) > 0, F.round(c, 3))
    refused = F.coalesce("refused", F.lit(False))
    by_gate = (F.size("hits") == 0) | F.coalesce(F.array_max(scores) < config.refusal_threshold, F.lit(False))
    pipeline = F.struct(
        "rewritten_query",
        F.coalesce(F.size("sub_queries"), F.lit(0)).alias("n_sub_queries"),
        F.size("contexts").alias("n_contexts"),
        F.size(F.array_distinct(F.filter(F.transform("hits", lambda h: h["parent_id"]), lambda x: x.isNotNull()))).alias("n_sections"),
        refused.alias("refused"),
        F.length("answer").alias("answer_length"),
        scored(F.get(scores, 0)).alias("score_top"),
        scored(mean).alias("score_mean"),
        scored(F.array_min(scores)).alias("score_min"),
        scored(F.array_max(scores)).alias("score_max"),
        scored(F.array_max(scores) - F.array_min(scores)).alias("score_range"),
        (refused & by_gate).alias("refused_by_gate"),
        (refused & ~by_gate).alias("refused_by_judge"),
    )
    asked, found = metrics.keywords(F.col("query")), T.word_set(F.array_join("contexts", " "), 3)
    each = r.select("qid", F.explode("hits").alias("h")).select("qid", "h.parent_id").join(sections.select("parent_id", "source_type", "section"), "parent_id")
    kinds = each.groupBy("qid", F.coalesce("source_type", F.lit("?")).alias("t")).agg(F.count("*").alias("n"), F.collect_set("section").alias("s"))
    per = kinds.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("t", F.lit(" ×"), F.col("n").cast("string")))), ", ").alias("source_types"), F.size(F.array_distinct(F.filter(F.flatten(F.collect_list("s")), lambda x: x != ""))).alias("n_titles"))
    retrieval = F.when(
        F.size("contexts") > 0,
        F.struct(
            F.round(F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, found)) / F.size(asked)).otherwise(0.0), 3).alias("overlap"),
            F.size(asked).alias("n_keywords"),
            F.size(F.array_intersect(asked, found)).alias("n_matched"),
            F.coalesce("source_types", F.lit("")).alias("source_types"),
            F.coalesce("n_titles", F.lit(0)).alias("n_titles"),
            F.aggregate("contexts", F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0))).alias("n_chars"),
        ),
    )
    cites = citations.analysis(r.select("qid", "answer", F.size("hits").alias("n_documents"))).withColumnRenamed("rate", "cited_rate")
    cited = F.when(
        (F.col("answer") != "") & (F.size("hits") > 0),
        F.struct("cited", "uncited", F.col("cited_rate").alias("rate"), F.transform("cited", lambda i: T.truncated(F.coalesce(F.get("hits", i - 1)["source"], F.lit("?")), 30)).alias("sources")),
    )
    verdict = F.col("grounded") if verdicts is not None else F.lit(None).cast("boolean")
    judge = F.struct(F.when(refused, "refused").when(verdict.isNull(), "not judged").when(verdict, "grounded").otherwise("ungrounded").alias("verdict"), F.when(~refused, verdict).alias("grounded"))
    j = r.join(per, "qid", "left").join(cites, "qid", "left")
    j = j if verdicts is None else j.join(verdicts.select("qid", "grounded"), "qid", "left")
    return j.select("qid", pipeline.alias("pipeline"), judge.alias("judge"), retrieval.alias("retrieval"), cited.alias("citations"))


def _line(name: str, value: object) -> str:
    return f"  {name:<14} {'–' if value is None or value == '' else value}"


def as_text(report: dict) -> str:
    """A row of `per_answer` as lines to be read; levels that are null are left out."""
    p, judge, found, cited = (report.get(k) for k in ("pipeline", "judge", "retrieval", "citations"))
    out = ["Answer"]
    out += [_line("rewritten", T.cut(p["rewritten_query"], 60)), _line("parts", p["n_sub_queries"]), _line("contexts", p["n_contexts"]), _line("sections", p["n_sections"]), _line("length", p["answer_length"])]
    if p["score_top"] is not None:
        out.append(_line("scores", f"first {p['score_top']}, mean {p['score_mean']}, {p['score_min']} to {p['score_max']}"))
    if p["refused"]:
        out.append(_line("refused by", "gate" if p["refused_by_gate"] else "judge"))
    out += ["Judge", _line("verdict", judge["verdict"])]
    if found is not None:
        out += ["Retrieval", _line("words found", f"{found['n_matched']} of {found['n_keywords']} ({found['overlap']:.0%})"), _line("sources", found["source_types"]), _line("titles", found["n_titles"]), _line("characters", found["n_chars"])]
    if cited is not None:
        listed = ", ".join(f"{i} {s}" for i, s in zip(cited["cited"], cited["sources"]))
        out += ["Citations", _line("cited", listed), _line("uncited", ", ".join(map(str, cited["uncited"]))), _line("rate", cited["rate"])]
    return "\n".join(out)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), F.trim), lambda x: x != "")


def grounding(answers: DataFrame, config: EngineConfig = DEFAULT, share: float = 0.5) -> DataFrame:
    """(qid, faithfulness, context_precision) of (qid, answer, contexts, reference), by words alone: stand-ins for
    a judge library, not equal to one.

    Faithfulness is the share of the answer's sentences at least half of whose words some context
    has; context precision the mean precision at the ranks of contexts that share words with the
    reference. Both are null where nothing can be counted.
    """
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    a = answers.select("qid", F.transform(sentences(F.col("answer")), lambda s: T.word_set(s)).alias("said"), F.transform(contexts, lambda c: T.word_set(c)).alias("read"), T.word_set(F.col("reference")).alias("wanted"))
    told = F.filter("said", lambda s: F.size(s) > 0)
    held = F.filter(told, lambda s: F.exists("read", lambda c: F.size(F.array_intersect(s, c)) >= share * F.size(s)))
    a = a.select("qid", F.when(F.size(told) > 0, F.size(held) / F.size(told)).alias("faithfulness"), F.transform("read", lambda c: (T.overlap_ratio(F.col("wanted"), c) >= config.relevance_threshold).cast("int")).alias("good"))
    upto = F.transform("good", lambda g, i: g * F.aggregate(F.slice("good", 1, i + 1), F.lit(0), lambda x, y: x + y) / (i + 1))
    total = F.aggregate("good", F.lit(0), lambda x, y: x + y)
    return a.select("qid", F.round("faithfulness", 6).alias("faithfulness"), F.round(F.when(F.size("good") > 0, F.when(total > 0, F.aggregate(upto, F.lit(0.0), lambda x, y: x + y) / total).otherwise(0.0)), 6).alias("context_precision"))
