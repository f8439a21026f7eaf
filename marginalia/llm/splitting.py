"""Problem 4: oversized items cut at natural boundaries, with a fixed overlap.

Lexical-cohesion segmentation. A text is read as units (blocks, sentences, lines); at each gap
between units the similarity of the words before and after gives a cohesion curve, whose valleys
mark changes of topic. Each piece ends at the deepest valley of its size window, which reaches from
half the limit to the limit (all of it where that half has no natural cut). A unit that
can't fit alone is cut at the next finer boundary: line, blank, and only last between characters.

Rows: an item is oversized if its text is longer than `max_chars` in code points. A null or empty
text is never oversized; an item field without a row in the limits isn't looked at; a repeated
key counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sql import SPACE
from ..session import spread, table
from .structure import atomic_blocks

_SENTENCE_GAP = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+|(?<=[。！？｡])[」』”）]*\s*|\n+")
_RUN = re.compile(r"[^\s.!?…。！？]+")
_WORD = re.compile(r"\w{4,}")
_BLANK = re.compile(r"\s+")
BLOCK = 4  # units on each side of a gap that are compared
PIECES = "item_field string, item_key string, piece_no int, n_pieces int, start_char int, end_char int, boundary string, unbreakable boolean, piece string"


def has_unbreakable(text: str, limit: int) -> bool:
    """True if one unit of the text alone is longer than the limit."""
    if len(text) <= limit:
        return False
    if any(b - a > limit for a, b, _ in atomic_blocks(text)):
        return True
    return any(m.end() - m.start() > limit for m in _RUN.finditer(text))


def gaps(text: str) -> list[tuple[int, int]]:
    """(position, rank) of natural cuts, in order: 3 paragraph or block, 2 sentence or line.

    Inside an atomic block there are none.
    """
    found: dict[int, int] = {}
    at = 0
    blocks = atomic_blocks(text)
    for a, b, _ in [*blocks, (len(text), len(text), "")]:
        for m in _SENTENCE_GAP.finditer(text, at, a):
            if at < m.end() < len(text):
                found[m.end()] = 3 if "\n\n" in m.group() else 2
        for p in (a, b):
            if 0 < p < len(text):
                found[p] = 3
        at = b
    return sorted(found.items())


def cohesion_depths(text: str, cuts: list[int]) -> list[float]:
    """Depth of the cohesion valley at each cut: how far similarity falls below the peaks around it."""
    edges = [0, *cuts, len(text)]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    # one forward pass keeps both blocks' counts; each unit enters and leaves each block once
    left: Counter = Counter()
    right: Counter = Counter()
    for bag in bags[1 : 1 + BLOCK]:
        right.update(bag)
    sims = []
    for i in range(1, len(bags)):
        left.update(bags[i - 1])
        if i - 1 - BLOCK >= 0:
            left.subtract(bags[i - 1 - BLOCK])
        if i > 1:
            right.subtract(bags[i - 1])
            if i - 1 + BLOCK < len(bags):
                right.update(bags[i - 1 + BLOCK])
        dot = sum(n * right[w] for w, n in left.items() if n)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
    if not sims:
        return []
    up = sims[:]  # highest similarity reached climbing left, then right
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            up[i] = up[i - 1]
    down = sims[:]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            down[i] = down[i + 1]
    return [u + d - 2 * s for u, d, s in zip(up, down, sims)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Spans (start, end, boundary) of pieces of at most `limit` characters, each starting exactly
    `overlap` characters before the end of the one before (fewer only if the limit is no larger).

    The deepest natural cut between half the limit and the limit wins; without one there, the deepest
    before it; else the last line break, else the last blank, else the limit itself.
    """
    if len(text) <= limit:
        return [(0, len(text), "end")]
    overlap = max(0, min(overlap, limit - 1))
    ranked = gaps(text)
    cuts = [p for p, _ in ranked]
    depths = cohesion_depths(text, cuts)
    pieces: list[tuple[int, int, str]] = []
    start, k = 0, 0
    while True:
        if len(text) - start <= limit:
            pieces.append((start, len(text), "end"))
            return pieces
        first, last = start + overlap + 1, start + limit
        while k < len(cuts) and cuts[k] < first:
            k += 1
        j = k
        while j < len(cuts) and cuts[j] <= last:
            j += 1
        window = range(k, j)
        late = [i for i in window if cuts[i] >= start + limit // 2] or list(window)
        if late:
            best = max(late, key=lambda i: (depths[i] + (0.25 if ranked[i][1] == 3 else 0.0), cuts[i]))
            end, kind = cuts[best], "paragraph" if ranked[best][1] == 3 else "sentence"
        elif (at := text.rfind("\n", first, last)) >= 0:
            end, kind = at + 1, "line"
        else:
            stops = [m.end() for m in _BLANK.finditer(text, first, last)]
            end, kind = (stops[-1], "blank") if stops else (last, "characters")
        pieces.append((start, end, kind))
        start = end - overlap


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            spans = split_text(r.body, r.max_chars, r.overlap_chars)
            hard = has_unbreakable(r.own, r.max_chars)
            rows += [(r.item_field, r.item_key, i, len(spans), a, b, kind, hard, r.body[a:b]) for i, (a, b, kind) in enumerate(spans)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every oversized item.

    `items`: item_field, item_key, body, own (the part whose units count as unbreakable). Only
    oversized items leave the JVM; they are spread by key, so one field or source may hold all.
    """
    limits = limits.select("item_field", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    large = items.join(limits, "item_field").where(F.length("body") > F.col("max_chars")).select("item_field", "item_key", "body", F.coalesce("own", F.lit("")).alias("own"), "max_chars", "overlap_chars")
    # a repeated item gives the same pieces again, which are dropped by their numbers
    return spread(large).mapInPandas(_split_batches, PIECES).dropDuplicates(["item_field", "item_key", "piece_no"])


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three item fields as one relation; children are read once for both of theirs."""
    s = lambda f, body: F.struct(F.lit(f).alias("item_field"), F.col("child_id").alias("item_key"), F.col(body).alias("body"), F.col("text").alias("own"))
    children = table(spark, sf_dir, "children").select(F.explode(F.array(s("children.text", "text"), s("children.embed_text", "embed_text"))).alias("x")).select("x.*")
    parents = table(spark, sf_dir, "parents").select(F.lit("parents.text").alias("item_field"), F.col("parent_id").alias("item_key"), F.col("text").alias("body"), F.col("text").alias("own"))
    return children.unionByName(parents)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized items."""
    return split_items(items_of(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each oversized item, and one more if a unit alone is over the limit."""
    kinds = F.when(F.col("unbreakable"), F.array(F.lit("oversize"), F.lit("unbreakable"))).otherwise(F.array(F.lit("oversize")))
    return pieces(spark, sf_dir).where("piece_no = 0").select("item_field", "item_key", F.explode(kinds).alias("case_kind"))


def piece_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by item field and kind of boundary."""
    return pieces(spark, sf_dir).groupBy("item_field", "boundary").agg(F.count("*").alias("n_pieces"), F.max(F.length("piece")).alias("longest"), F.min(F.length("piece")).alias("shortest"))


QUERIES = {"p4_found": found, "p4_pieces": pieces, "p4_piece_report": piece_report}
_BLOCK = r"(?:(?ms)^[ \t]{0,3}```[^\n]*\n.*?(?:^[ \t]{0,3}```+[ \t]*$|\z))|(?:(?ms)^[ \t]{0,3}~~~[^\n]*\n.*?(?:^[ \t]{0,3}~~~+[ \t]*$|\z))|(?:(?s)\$\$.*?\$\$)|(?:(?ms)^[ \t]*--- \[FIGURE\] ---[ \t]*$.*?^[ \t]*--- \[/FIGURE\] ---[ \t]*$)|(?:(?m)^[ \t]*\|[^\n]*\n[ \t]*\|[^\n]*(?:\n[ \t]*\|[^\n]*)*)"
_LONGEST = "coalesce(list_max(list_transform(regexp_extract_all(own, '{}'), lambda x: length(x))), 0)"
ORACLES = {
    "p4_found": f"""WITH items AS (SELECT 'children.text' AS item_field, child_id AS item_key, text AS body, text AS own FROM children UNION ALL SELECT 'children.embed_text', child_id, embed_text, text FROM children UNION ALL SELECT 'parents.text', parent_id, text, text FROM parents),
big AS (SELECT DISTINCT item_field, item_key, coalesce(own, '') AS own, max_chars FROM items JOIN size_limits USING (item_field) WHERE length(body) > max_chars),
kinds AS (SELECT item_field, item_key, length(own) > max_chars AND greatest({_LONGEST.format(_BLOCK)}, {_LONGEST.format('[^.!?…。！？' + SPACE[1:-1] + ']+')}) > max_chars AS unbreakable FROM big)
SELECT item_field, item_key, 'oversize' AS case_kind FROM kinds UNION ALL SELECT item_field, item_key, 'unbreakable' FROM kinds WHERE unbreakable""",
}
