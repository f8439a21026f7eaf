"""Streams: files into the index as they arrive, and conversations with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig
from ..operators import chunking
from ..operators.conversation import Memory
from ..sources import corpus


def ingest(spark: SparkSession, folder: str, children_path: str, parents_path: str, checkpoint: str, config: EngineConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """New markdown files are normalised, chunked and appended. Each batch is written under its
    number, so a batch that is repeated after a failure replaces itself."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").schema("value string").load(folder)
    raw = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("source"), F.col("value").alias("raw"))

    def write(batch: DataFrame, n: int) -> None:
        parents, children = chunking.chunk(corpus.documents(batch).where("error is null"), config)
        parents.write.mode("overwrite").parquet(f"{parents_path}/batch={n}")
        children.write.mode("overwrite").parquet(f"{children_path}/batch={n}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "summary string, turns array<struct<role:string,text:string>>, n int"
OUT = "conv_id long, n_turns int, n_kept int, summary string, history string"


def remember(turns: DataFrame, window: int = 6, config: EngineConfig = DEFAULT) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) to the memory after each batch; the same rules
    as the batch operator, with state that never exceeds twice the window and one summary."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memory(window, config.summary_words)
        n = 0
        if state.exists:
            m.summary, held, n = state.get
            m.turns = [(t["role"], t["text"]) if isinstance(t, dict) else (t[0], t[1]) for t in held]
        for _, r in pd.concat(list(batches)).sort_values("turn", kind="stable").iterrows():
            m.add(r["role"], r["text"])
            n += 1
            if r["role"] == "tutor":
                m.compress()
        state.update((m.summary, [{"role": a, "text": b} for a, b in m.turns], n))
        yield pd.DataFrame([(key[0], n, len(m.turns), m.summary, m.history(config.history_tokens))], columns=["conv_id", "n_turns", "n_kept", "summary", "history"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
