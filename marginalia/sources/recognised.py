"""Pages read by a recogniser: from files to regions, and from regions to markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as Y
from ..operators import normalize as N
from ..operators.providers import with_retries

REGION = "array<struct<id:bigint,box:array<double>,text:string>>"
PAGES = f"source_id string, page int, text string, figures {REGION}, captions {REGION}, error string"


class PageReader(Protocol):
    """Reads one file: for each page its number, text, figures and captions (id, box, text)."""

    def read(self, content: bytes) -> list[dict]: ...


class FigureReader(Protocol):
    """Describes one figure of a page from its box; the label is that of its part of a plate."""

    def describe(self, source_id: str, page: int, box: list[float], label: str, caption: str) -> str: ...


def recognise(spark: SparkSession, path: str, reader: PageReader, glob: str = "*.pdf") -> DataFrame:
    """Pages of files by a recogniser; a file that fails is one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["source_id"], pdf["content"]):
                try:
                    rows += [(name, p["page"], p.get("text"), p.get("figures", []), p.get("captions", []), None) for p in with_retries(lambda c=content: reader.read(c), 2)]
                except Exception as e:
                    rows.append((name, None, None, [], [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["source_id", "page", "text", "figures", "captions", "error"]).astype({"page": "Int32"})

    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_id"), "content").mapInPandas(run, PAGES)


def regions(pages: DataFrame) -> DataFrame:
    """What a recogniser gave: (kind, n, n_pages, without_box, without_text) of its regions."""
    each = lambda kind: pages.select(F.lit(kind).alias("kind"), "source_id", "page", F.explode(kind).alias("r"))
    both = each("figures").unionByName(each("captions"))
    bare = F.coalesce(F.trim("r.text"), F.lit("")) == ""
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source_id", "page").alias("n_pages"), F.count_if(F.coalesce(F.size("r.box"), F.lit(0)) < 4).alias("without_box"), F.count_if(bare).alias("without_text"))


def described(panels: DataFrame, reader: FigureReader) -> DataFrame:
    """(page_id, cluster, description): the parts of a plate by one call each, in order; a failing call is
    tried once more and then leaves its part out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append(with_retries(lambda r=r: reader.describe(r.source_id, int(r.page), list(r.box), r.label, r.caption), 2))
                except Exception:
                    out.append(None)
            yield pdf[["page_id", "cluster", "ordinal"]].assign(label=pdf["label"], description=out)

    parts = panels.mapInPandas(run, "page_id long, cluster int, ordinal long, label string, description string").where("description is not null")
    line = F.when(F.col("label") != "", F.concat("label", F.lit(": "), F.col("description"))).otherwise(F.col("description"))
    return parts.groupBy("page_id", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "\n").alias("description"))


def to_documents(pages: DataFrame, reader: FigureReader | None = None, clean: Callable = Y.clean_caption) -> DataFrame:
    """(source_id, markdown): pages in order after their marks, with front-matter; each plate of figures
    stands as a block in place of its caption line."""
    p = pages.where("error is null").withColumn("page_id", F.xxhash64("source_id", "page"))
    figures = p.select("page_id", F.explode("figures").alias("r")).select("page_id", F.col("r.id").alias("fig_id"), "r.box", F.col("r.id").alias("ordinal"))
    small = p.select("page_id", F.explode("captions").alias("r")).select("page_id", F.col("r.id").alias("cap_id"), "r.box", clean(F.col("r.text")).alias("text"))
    clusters = Y.cluster_figures(figures)
    placed = clusters.join(figures, ["page_id", "fig_id"])
    bands = placed.groupBy("page_id", "cluster").agg(F.min(F.col("box")[1]).alias("top"), F.max(F.col("box")[3]).alias("bottom"))
    inside = Y.captions_in_band(bands, small).join(small, ["page_id", "cap_id"])
    plates = inside.groupBy("page_id", "cluster").agg(F.collect_list("text").alias("labels"))
    lines = p.select("page_id", F.posexplode(Y.caption_lines(F.col("text"))).alias("position", "caption"))
    blocks = Y.match_by_order(bands.select("page_id", "cluster"), lines).join(plates, ["page_id", "cluster"], "left").withColumn("kind", Y.route(F.col("labels")))
    if reader is None:
        told = blocks.select("page_id", "cluster", F.array_join(F.coalesce("labels", F.array().cast("array<string>")), "\n").alias("description"))
    else:
        pairs = Y.pair_captions(placed.select("page_id", "fig_id", "box", "ordinal"), small).join(small.select("page_id", "cap_id", "text"), ["page_id", "cap_id"], "left")
        panels = placed.join(pairs.select("page_id", "fig_id", "text"), ["page_id", "fig_id"]).join(blocks.select("page_id", "cluster", "caption", "kind"), ["page_id", "cluster"]).join(p.select("page_id", "source_id", "page"), "page_id")
        label = F.when(F.col("kind") == "composite", F.coalesce("text", F.lit(""))).otherwise("")
        told = described(panels.select("page_id", "cluster", "ordinal", "source_id", "page", "box", label.alias("label"), F.coalesce("caption", F.lit("")).alias("caption")), reader)
    made = blocks.join(told, ["page_id", "cluster"], "left").select("page_id", "cluster", "caption", Y.figure_block(F.col("caption"), F.col("description")).alias("block"))
    per_page = made.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "caption", "block"))).alias("b"))  # one page's plates
    put = F.aggregate(F.coalesce("b", F.array().cast("array<struct<cluster:int,caption:string,block:string>>")), F.coalesce("text", F.lit("")), lambda t, b: Y.insert_figure(t, b["caption"], b["block"]))
    body = Y.assemble(p.join(per_page, "page_id", "left").select("source_id", "page", put.alias("text")))
    counted = p.groupBy("source_id").agg(F.count("*").cast("string").alias("n"))
    meta = F.create_map(F.lit("source_id"), F.col("source_id"), F.lit("page_count"), F.col("n"))
    return body.join(counted, "source_id").select("source_id", F.concat(N.render_front_matter(meta, F.lit("pdf"), F.regexp_replace("source_id", r"\.[^.]+$", "")), F.lit("\n"), F.col("markdown")).alias("markdown"))
