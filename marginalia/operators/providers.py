"""Models behind small protocols, with deterministic offline stand-ins.

The stand-ins make every pipeline run without a network; they aren't equal in quality to models
and say so in their names.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class PairScorer(Protocol):
    available: bool

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class ChatModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class OfflineEmbedder:
    """Hashed bag of words, unit length; a text without words has no vector."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n else None)
        return out


class OfflineChat:
    """Answers with the sentence of the context that shares most words with the question."""

    def complete(self, system: str, user: str) -> str:
        question, _, context = user.partition("\n\n")
        asked = set(question.lower().split())
        sentences = [s.strip() for s in context.replace("\n", " ").split(". ") if s.strip()]
        return max(sentences, key=lambda s: (len(asked & set(s.lower().split())), -len(s)), default="")


def with_retries(call: Callable[[], object], tries: int = 3, wait: float = 1.0) -> object:
    """The result of a call, tried again with doubling waits; the last failure is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(wait * 2**i)
    return None


def embed(texts: DataFrame, key: str, text: str, provider: Embedder, batch: int = 16) -> DataFrame:
    """(key, embedding). Each distinct text is embedded once; a batch that fails is halved until
    the failing text stands alone, which gets no vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def several(part: list[str]) -> list[list[float] | None]:
            try:
                return provider.embed(part)
            except Exception:
                if len(part) == 1:
                    return [None]
                mid = len(part) // 2
                return several(part[:mid]) + several(part[mid:])

        for pdf in batches:
            values = pdf["_t"].tolist()
            yield pdf.assign(embedding=[e for i in range(0, len(values), batch) for e in several(values[i : i + batch])])

    some = F.coalesce(F.trim(F.col(text)), F.lit("")) != ""
    hashed = texts.where(some).select(key, F.sha2(F.col(text), 256).alias("_h"), F.col(text).alias("_t"))
    distinct = hashed.groupBy("_h").agg(F.first("_t").alias("_t")).mapInPandas(run, "_h string, _t string, embedding array<double>")
    blank = texts.where(~some).select(key, F.lit(None).cast("array<double>").alias("embedding"))  # not one hot key of all blank texts
    return hashed.select(key, "_h").join(distinct.select("_h", "embedding"), "_h").select(key, "embedding").unionByName(blank)


def score_pairs(asked: DataFrame, scorer: PairScorer, batch: int = 32) -> DataFrame:
    """`asked` (question, text, …) with `pair_score`; null where a batch fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def several(part: list[tuple[str, str]]) -> list[float | None]:
            try:
                return list(scorer.score(part))
            except Exception:
                return [None] * len(part)

        for pdf in batches:
            pairs = list(zip(pdf["question"], pdf["text"]))
            yield pdf.assign(pair_score=pd.array([x for i in range(0, len(pairs), batch) for x in several(pairs[i : i + batch])], dtype="Float64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in asked.dtypes) + ", pair_score double"
    return asked.mapInPandas(run, schema)


class Unavailable:
    """A scorer that couldn't be loaded; reranking then keeps the order of fusion."""

    available = False

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        raise RuntimeError("no scorer is loaded")


def load_scorer(make: Callable[[], PairScorer], purge: Callable[[], None] | None = None, tries: int = 3, wait: float = 3.0) -> PairScorer:
    """The scorer that `make` gives, tried again with doubling waits, after `purge` has removed what an
    earlier try may have left broken; `Unavailable` if none succeeds."""
    for i in range(tries):
        try:
            return make()
        except Exception:
            if purge is not None:
                purge()
            if i < tries - 1:
                time.sleep(wait * 2**i)
    return Unavailable()


class ModelMissing(RuntimeError):
    """The server doesn't have the model."""


class HttpChat:
    """A chat model behind an HTTP address that takes and gives JSON, one object a line when it streams."""

    def __init__(self, url: str, model: str, temperature: float = 0.2, most_tokens: int = 900, context: int = 24_576, keep: str = "30m", timeout: float = 600.0) -> None:
        self.url, self.model, self.timeout = url, model, timeout
        self.options = {"temperature": temperature, "num_predict": most_tokens, "num_ctx": context}
        self.keep = keep

    def _open(self, system: str, user: str, stream: bool):
        import json
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "stream": stream, "keep_alive": self.keep, "options": self.options}
        try:
            return urlopen(Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout)
        except HTTPError as e:
            if e.code == 404:
                raise ModelMissing(f"{self.url} has no model {self.model}") from e
            raise

    def complete(self, system: str, user: str) -> str:
        import json

        with self._open(system, user, False) as r:
            return (json.load(r).get("message") or {}).get("content", "").strip()

    def stream(self, system: str, user: str) -> Iterator[str]:
        import json

        with self._open(system, user, True) as r:
            for line in r:
                if line.strip():
                    part = json.loads(line)
                    if text := (part.get("message") or {}).get("content"):
                        yield text
                    if part.get("done"):
                        return


def options(path: str) -> dict[str, object]:
    """A provider's settings from a YAML file, nested keys joined by dots; an empty file has none."""
    import yaml

    def flat(at: str, v: object) -> Iterator[tuple[str, object]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from flat(f"{at}.{k}" if at else str(k), x)
        else:
            yield at, v

    with open(path, encoding="utf-8") as f:
        return dict(flat("", yaml.safe_load(f) or {}))


def complete(prompts: DataFrame, key: str, provider: ChatModel, system: str) -> DataFrame:
    """(key, reply) of prompts (key, prompt); a failed call gives null, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> str | None:
            try:
                return provider.complete(system, p)
            except Exception:
                return None

        for pdf in batches:
            yield pdf.assign(reply=[one(p) for p in pdf["prompt"]]).drop(columns=["prompt"])

    schema = f"`{key}` {dict(prompts.dtypes)[key]}, reply string"
    return prompts.select(key, "prompt").mapInPandas(run, schema)
