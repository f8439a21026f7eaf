"""Normalisation of raw markdown into the corpus' conventions, as column functions.

Each step takes and gives a column; null stays null. Steps are safe to repeat. `$` in a
replacement is a group, so literal dollars are escaped.

The regular expressions of the steps, and the order of the steps, are fixed values: they state the
conventions of the corpus and the marks of older ones, and must stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..functions import text as T
from .html import table_to_markdown

FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"


@F.pandas_udf(MapType(StringType(), StringType()))
def _yaml_map(block: pd.Series) -> pd.Series:
    import yaml

    def one(t):
        if not t:
            return {}
        try:
            got = yaml.safe_load(t)
        except Exception:  # a broken block is no metadata
            return {}
        return {str(k): None if v is None else str(v) for k, v in got.items()} if isinstance(got, dict) else {}

    return block.map(one)


def front_matter(raw: Column) -> Column:
    """The metadata of a file; empty without a block or with one that can't be read."""
    return _yaml_map(F.regexp_extract(F.coalesce(raw, F.lit("")), FRONT_MATTER, 1))


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONT_MATTER, "")


def source_type(meta: Column, raw: Column) -> Column:
    """`pdf` or `web`: stated, else by an old comment or a page mark."""
    stated = meta.getItem("source_type")
    marked = raw.rlike(r"(?md)^<!--\s*source:\s*\S+\s*\|.*-->\s*\n?") | raw.rlike(r"(?imd)^<!--\s*(?:loc\s+)?page[=\s]")
    return F.when(stated.isin("pdf", "web"), stated).when(marked, F.lit("pdf")).otherwise(F.lit("web"))


def render_front_matter(meta: Column, kind: Column, source: Column) -> Column:
    """A block with one JSON scalar a key; `source_type` is set and `source` filled in."""
    full = F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin("source_type")), F.create_map(F.lit("source_type"), kind), F.when(F.map_contains_key(meta, "source"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("source"), source)))
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(v, F.lit("")), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    lines = F.transform(F.map_entries(full), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def unify_pages(t: Column) -> Column:
    return F.regexp_replace(t, r"(?imd)^<!--\s*page\s+(\d+)\s*-->\s*$", "<!-- loc page=$1 -->")


def unify_figures(t: Column) -> Column:
    return F.regexp_replace(t, r"(?is)---\s*\[INTERPRETATION DE LA FIGURE\]\s*---\s*\n\s*(.*?)\s*---\s*\[FIN INTERPRETATION\]\s*---", "--- [FIGURE] ---\n$1\n--- [/FIGURE] ---")


@F.pandas_udf(StringType())
def _tables(t: pd.Series) -> pd.Series:
    import re

    pattern = re.compile(r"<table\b.*?</table>", re.S | re.I)
    return t.map(lambda x: x if x is None else pattern.sub(lambda m: table_to_markdown(m.group()), x))


def unify_tables(t: Column) -> Column:
    """HTML tables as pipe tables; only texts that have one go through Python."""
    return F.when(F.contains(F.lower(t), F.lit("<table")), _tables(t)).otherwise(t)


def heading_level(number: Column, sub_index: Column) -> Column:
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 2
    return F.least(F.lit(6), depth + sub_index.cast("int"))


def unify_headers(t: Column) -> Column:
    """Numbered lines as headings; not those of a table of contents, which end in a figure."""
    old = r"^(\d+(?:\.\d+)*)-(?:\.(\d+))?\s+(\S.*)$"

    def one(line: Column) -> Column:
        number = F.regexp_extract(line, old, 1)
        level = heading_level(number, F.regexp_extract(line, old, 2) != "")
        is_old = line.rlike(old) & ~line.rlike(r"\d\s*$") & ~line.rlike(r"^#{1,6}\s+\S")
        return F.when(is_old, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(line))).otherwise(line)

    return F.array_join(F.transform(F.split(t, "\n"), one), "\n")


def strip_orphan_pipes(t: Column) -> Column:
    return F.regexp_replace(t, r"(?md)^[ \t]*\|[ \t]*$\n?", "")


def _ends(t: Column) -> Column:
    return F.concat(F.regexp_replace(t, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))


def tidy(t: Column) -> Column:
    """Composed, no blanks at line ends, at most one empty line, one line end at the end."""
    t = F.regexp_replace(T.composed(t), r"[ \t]+\n", "\n")
    return _ends(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize_body(t: Column) -> Column:
    for step in (unify_pages, unify_figures, unify_tables, unify_headers, strip_orphan_pipes, tidy):
        t = step(t)
    return t


def galleries_to_captions(t: Column) -> Column:
    """Rows of images with a caption row become one caption line."""
    import re

    pattern = re.compile(r"(?:^!\[[^\]]*\]\([^)]*\)\s*\|?\s*\n)+^\|(.+)\|\s*$", re.M)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        caption = lambda m: "*(figure — " + " ; ".join(c.strip() for c in m.group(1).split("|") if c.strip()) + ")*\n"
        return s.map(lambda x: x if x is None else pattern.sub(caption, x))

    return F.when(t.rlike(r"(?md)^!\[[^\]]*\]\([^)]*\)\s*\|?\s*\n"), run(t)).otherwise(t)


def drop_images(t: Column) -> Column:
    return F.regexp_replace(t, r"!\[([^\]]*)\]\(([^)]*)\)", "")


def links_to_text(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<!!)\[([^\]]+)\]\([^)]*\)", "$1")


def drop_emojis(t: Column) -> Column:
    t = F.regexp_replace(t, r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}]+", "")
    return F.replace(t, F.lit("  "), F.lit(" "))


# fixed values: macros of the courses and what they stand for
MACROS = {r"\vx": r"\mathbf{x}", r"\vy": r"\mathbf{y}", r"\vz": r"\mathbf{z}", r"\mX": r"\mathbf{X}", r"\mY": r"\mathbf{Y}", r"\mW": r"\mathbf{W}"}


def unify_math(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    t = F.regexp_replace(t, r"(?s)\\\((.*?)\\\)", r"\$$1\$")
    for macro, meaning in MACROS.items():
        t = F.replace(t, F.lit(macro), F.lit(meaning))
    return t


def drop_exercises(t: Column) -> Column:
    """Sections of exercises, up to the next heading or the end."""
    return F.regexp_replace(t, r"(?imsd)^#+\s*[\d.]*\s*(?:Exercises?|Problems?)\s*\n.*?(?=^#+\s|\z)", "")


def squeeze_blanks(t: Column) -> Column:
    t = F.regexp_replace(T.composed(t), r"[ \t]+", " ")
    return _ends(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_web(t: Column, exercises: bool = False) -> Column:
    """The web cleaner's steps in order; exercises are dropped unless kept."""
    for step in (galleries_to_captions, drop_images, unify_math, links_to_text, drop_emojis):
        t = step(t)
    return squeeze_blanks(t if exercises else drop_exercises(t))
