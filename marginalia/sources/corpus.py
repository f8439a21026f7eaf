"""Markdown folders, HTML files, index tables and run histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import html as H
from ..operators import links as L
from ..operators import normalize as N
from ..functions import text as T


class NotIndexed(RuntimeError):
    """The index was read before it was written."""


def _stem(path: F.Column) -> F.Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\+", "%2B")), r"\.[^.]+$", "")


def markdown_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, source, raw) of every *.md under a folder, or of one file."""
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), _stem(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("raw"))


def html_files(spark: SparkSession, path: str, canonical: str | None = None) -> DataFrame:
    """(page_id, url, html) of HTML files; bytes that aren't UTF-8 are replaced, never fatal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), (F.lit(canonical) if canonical else F.col("path")).alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def documents(files: DataFrame) -> DataFrame:
    """Normalised documents (doc_key, source, source_type, source_url, title, source_id, body, error).

    A file without front-matter is read as `pdf`; one whose text is null or blank gets an error and
    no body, so it can be set aside without failing the rest.
    """
    meta = N.front_matter(F.col("raw"))
    f = files.withColumn("meta", meta).withColumn("has_meta", F.col("raw").rlike(r"\A---\s*\n"))
    kind = F.when(F.col("has_meta"), N.source_type(F.col("meta"), F.col("raw"))).otherwise("pdf")
    blank = F.col("raw").isNull() | (F.trim(F.coalesce("raw", F.lit(""))) == "")
    get = lambda k: F.nullif(F.col("meta").getItem(k), F.lit(""))
    return f.select(
        F.col("source").alias("doc_key"), "source", kind.alias("source_type"), get("source_url").alias("source_url"), get("title").alias("title"), get("source_id").alias("source_id"),
        F.when(~blank, N.normalize_body(N.body(F.col("raw")))).alias("body"), F.when(blank, F.lit("empty file")).alias("error"),
    )


def pages_to_documents(pages: DataFrame, cleaned: bool = True) -> DataFrame:
    """Web pages extracted, cleaned and shaped like `documents`; keyed by page, so addresses that
    share their last parts stay apart."""
    d = H.extract(pages)
    body = N.clean_web(F.col("markdown")) if cleaned else F.col("markdown")
    title = F.col("metadata").getItem("title")
    return d.select(
        F.col("page_id").cast("string").alias("doc_key"), L.slug(F.col("url"), title).alias("source"), F.lit("web").alias("source_type"), F.col("url").alias("source_url"), title.alias("title"),
        F.lit(None).cast("string").alias("source_id"), body.alias("body"), F.col("error").alias("error"),
    )


def rendered(docs: DataFrame) -> DataFrame:
    """(source, file): documents as markdown files with front-matter."""
    meta = F.map_filter(F.create_map(*[x for k in ("source_url", "title", "source_id") for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
    return docs.where("body is not null").select("source", F.concat(N.render_front_matter(meta, F.col("source_type"), F.col("source")), F.lit("\n"), F.col("body")).alias("file"))


def page(spark: SparkSession, url: str | None = None, file: str | None = None, canonical: str | None = None, fetch=L.fetch_page) -> DataFrame:
    """One page as a document like those of `pages_to_documents`: a local file, or else an address that is
    fetched. One of them must be given."""
    if file is not None:
        return pages_to_documents(html_files(spark, file, canonical or url))
    if url is None:
        raise ValueError("give an address or a file")
    return pages_to_documents(spark.createDataFrame([(0, canonical or url, fetch(url))], "page_id long, url string, html string"))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (source, file) as `source`.md into a folder that all executors reach; how many were written.
    A file that a repeated task writes again is the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        target.create_dir(at, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["source"], pdf["file"]):
                with target.open_output_stream(f"{at}/{name}.md") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("source", "file").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def normalize_folder(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Every *.md of a folder, not of those below it, normalised into another folder: (source, source_type,
    error), with an error instead of a file where one can't be read."""
    docs = documents(markdown_files(spark, path, recursive=False))
    write_files(rendered(docs), folder)
    return docs.select("source", "source_type", "error")


def save_pages(docs: DataFrame, folder: str) -> int:
    """Web documents as files named after their addresses."""
    return write_files(rendered(docs.where("error is null")), folder)


def write_index(children: DataFrame, path: str, reset: bool = True, vectors: DataFrame | None = None) -> None:
    """The search index as a table, with `vectors` (child_id, embedding) if given; a missing page is -1, as
    the index has no nulls."""
    rows = children if vectors is None else children.join(vectors, "child_id", "left")
    rows.withColumn("page", F.coalesce("page", F.lit(-1))).write.mode("overwrite" if reset else "append").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise NotIndexed(f"nothing is indexed at {path}") from e
        raise


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; `NotIndexed` where there is none. Other failures stay what they are."""
    return _read(spark, path)


def sections_path(index: str) -> str:
    """Where an index keeps its sections: beside it."""
    return index.rstrip("/") + "_sections"


def write_sections(parents: DataFrame, index: str, reset: bool = True) -> None:
    parents.write.mode("overwrite" if reset else "append").parquet(sections_path(index))


def read_sections(spark: SparkSession, index: str) -> DataFrame:
    return _read(spark, sections_path(index))


def append_run(report: DataFrame, path: str, dataset: str, config: dict[str, str]) -> None:
    """A report as one more line of a run history."""
    cfg = F.to_json(F.create_map(*[x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(str(v)))])) if config else F.lit("{}")
    body = report.agg(F.to_json(F.collect_list(F.struct("*"))).alias("report"))  # a report has a handful of rows
    body.select(F.current_timestamp().cast("string").alias("timestamp"), F.lit(dataset).alias("dataset_path"), cfg.alias("config"), "report").coalesce(1).write.mode("append").json(path)


def first_filled(*columns: F.Column) -> F.Column:
    return T.non_empty(*columns)
