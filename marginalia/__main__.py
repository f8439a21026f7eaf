"""Commands for one machine or a cluster: `python -m marginalia COMMAND …`.

normalize FOLDER OUT · ingest FOLDER INDEX · stats INDEX · search INDEX QUESTION · chat INDEX ·
evaluate INDEX ITEMS · calibrate INDEX ITEMS · crawl SEED OUT
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunking, citations, conversation, goldens, links, metrics, providers, reports
from .operators import retrieval as R
from .plans import pipeline
from .session import cut_lineage, local_session, ship_package
from .sources import corpus


def _model(args: argparse.Namespace) -> providers.ChatModel:
    return providers.HttpChat(args.url, args.model) if args.url else providers.OfflineChat()


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return corpus.read_index(spark, path), corpus.read_sections(spark, path)


def _items(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    items = goldens.read(spark, args.items)
    return goldens.first(items, args.limit).withColumnRenamed("idx", "qid")


def normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    corpus.normalize_folder(spark, args.folder, args.out).groupBy("source_type", F.col("error").isNull().alias("ok")).count().show()


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = corpus.documents(corpus.markdown_files(spark, args.folder))
    parents, children, _ = pipeline.ingest(docs.where("error is null"))
    corpus.write_index(children, args.index, reset=not args.append)
    corpus.write_sections(parents, args.index, reset=not args.append)
    docs.where("error is not null").select("source", "error").show(truncate=False)


def stats(spark: SparkSession, args: argparse.Namespace) -> None:
    chunking.statistics(_index(spark, args.index)[0]).show()


def _hits(spark: SparkSession, children: DataFrame, parents: DataFrame, question: str, mode: str) -> DataFrame:
    q = spark.createDataFrame([(0, question)], "qid long, question string")
    return R.retrieve(children, parents, q, mode).withColumn("label", citations.label())


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    _hits(spark, *_index(spark, args.index), args.question, args.mode).select("rank", "score", "label").orderBy("rank").show(truncate=False)


def chat(spark: SparkSession, args: argparse.Namespace, ask: Callable[[str], str] = input, put: Callable[[str], object] = sys.stdout.write) -> None:
    """Questions until an empty line, with memory, sources and a report of each answer."""
    children, parents = _index(spark, args.index)
    model = _model(args)
    memory = conversation.Memory(summarise=conversation.summariser(model) if args.url else None)
    while question := ask("> ").strip():
        q = spark.createDataFrame([(0, question)], "qid long, question string")
        told = spark.createDataFrame([(0, memory.history())], "qid long, history string")
        got = pipeline.answer(q, children, parents, model, args.mode, rewriter=model if args.url else None, history=told).first()
        put(got["answer"] + "\n")
        labelled = _hits(spark, children, parents, got["rewritten_query"], args.mode).select("qid", "rank", "label", "parent_id", "source", "score")
        put("".join(r["sources"] + "\n" for r in citations.top_sources(labelled).collect()))
        if args.report:
            hits = labelled.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parent_id", "source", F.col("score").alias("dist")))), lambda h: F.struct(h["parent_id"], h["source"], h["dist"])).alias("hits"))
            result = spark.createDataFrame([got], "qid long, query string, rewritten_query string, sub_queries array<string>, contexts array<string>, answer string, refused boolean")
            put(reports.as_text(reports.per_answer(result.join(hits, "qid", "left"), parents).first().asDict(recursive=True)) + "\n")
        memory.add("student", question)
        memory.add("tutor", got["answer"])
        memory.compress()


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    children, parents = _index(spark, args.index)
    items = _items(spark, args)
    answers = cut_lineage(pipeline.answer(items.select("qid", "question"), children, parents, _model(args), args.mode))
    hits = answers.select("qid", F.posexplode("contexts").alias("p", "text")).select("qid", (F.col("p") + 1).alias("rank"), "text")
    grades = pipeline.correctness(answers.join(items.select("qid", "reference"), "qid"), _model(args)) if args.url else None
    report = cut_lineage(pipeline.evaluate(answers, items.select("qid", "gold_context", "category"), hits, grades=grades, intervals=True))
    report.orderBy(F.desc("level"), "category").show(truncate=False, vertical=True)
    if args.history:
        corpus.append_run(report, args.history, args.items, {"mode": args.mode})


def calibrate(spark: SparkSession, args: argparse.Namespace) -> None:
    scores = pipeline.collect_scores(_items(spark, args).select("qid", "question", "category"), *_index(spark, args.index), args.mode)
    metrics.calibrate(scores).show()


def crawl(spark: SparkSession, args: argparse.Namespace) -> None:
    found = links.crawl(spark.createDataFrame([(args.seed,)], "url string"), links.fetcher(delay=args.delay), args.pages, args.include, agent=None if args.no_robots else "marginalia")
    pages = found.where("content").select(F.xxhash64("url").alias("page_id"), "url", "html")
    print(corpus.save_pages(corpus.pages_to_documents(pages), args.out), "pages")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    mode = {"default": "hybrid_rerank", "choices": ["dense", "hybrid", "hybrid_rerank"]}
    for name, run, words in (("normalize", normalize, "folder out"), ("ingest", ingest, "folder index"), ("stats", stats, "index"), ("search", search, "index question"), ("chat", chat, "index"), ("evaluate", evaluate, "index items"), ("calibrate", calibrate, "index items"), ("crawl", crawl, "seed out")):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for w in words.split():
            c.add_argument(w)
        if name in ("search", "chat", "evaluate", "calibrate"):
            c.add_argument("--mode", **mode)
        if name in ("chat", "evaluate"):
            c.add_argument("--url", help="address of a chat model; without it the offline stand-in answers")
            c.add_argument("--model", default="default")
        if name in ("evaluate", "calibrate"):
            c.add_argument("--limit", type=int, help="the first items alone")
    sub.choices["ingest"].add_argument("--append", action="store_true")
    sub.choices["chat"].add_argument("--report", action="store_true")
    sub.choices["evaluate"].add_argument("--history", help="folder of the run history")
    for flag, kind, value in (("--pages", int, 100), ("--delay", float, 1.0), ("--include", str, None)):
        sub.choices["crawl"].add_argument(flag, type=kind, default=value)
    sub.choices["crawl"].add_argument("--no-robots", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship_package(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
