"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LONGEST = 200_000  # characters after which a text is cut at the next place where tokens can't cross
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")  # before a blank between letters, where the pattern starts a new piece


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """A byte-level BPE encoder from a file of ranks; by default the public one for many languages."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str | None = None) -> int:
    """Tokens of a text; 0 for a null or empty one."""
    if not text:
        return 0
    encode = encoder(path).encode_ordinary
    if len(text) <= LONGEST:
        return len(encode(text))
    total, at = 0, 0
    while at < len(text):  # a text without such a place is encoded as a whole
        m = _CUT.search(text, at + LONGEST) if at + LONGEST < len(text) else None
        end = m.start() if m else len(text)
        total += len(encode(text[at:end]))
        at = end
    return total


def token_sizes(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """`keep` columns of the documents and `tokens`, the size of their `text`."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(tokens=[count_tokens(t, path) for t in pdf["text"]])

    return spread(docs.select(*keep, F.col("text"))).mapInPandas(run, schema)
