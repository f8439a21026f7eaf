"""What can be read off a model's reply: rewritten queries, verdicts, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rewritten(raw: Column, original: Column) -> Column:
    """struct(rewritten, sub_queries) from the JSON in a reply; anything missing, of another type or
    empty falls back to the original question and no parts."""
    j = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.nullif(j, F.lit("")))
    is_text = F.schema_of_variant(F.try_variant_get(v, "$.rewritten", "variant")) == "STRING"
    text = F.when(is_text, F.try_variant_get(v, "$.rewritten", "string"))
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.sub_queries", "variant")).startswith("ARRAY<")
    raw_list = F.when(is_list, F.try_variant_get(v, "$.sub_queries", "array<string>"))
    parts = F.filter(F.coalesce(raw_list, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.struct(F.coalesce(F.nullif(F.trim(text), F.lit("")), original).alias("rewritten"), parts.alias("sub_queries"))


def grounded(raw: Column) -> Column:
    """A judge's verdict: the first `VERDICT: …`; else the last line that opens with one; else true."""
    stated = F.upper(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?i)VERDICT\s*:\s*(ANCR|HORS)", 1))
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.upper(F.trim(x))), lambda x: x.startswith("ANCR") | x.startswith("HORS"))
    last = F.try_element_at(lines, F.lit(-1))
    return F.when(stated == "ANCR", True).when(stated == "HORS", False).otherwise(F.coalesce(last.startswith("ANCR"), F.lit(True)))


def grade(raw: Column) -> Column:
    """The first digit from 1 to 5 of a reply as a share of 5; null without one."""
    d = F.regexp_extract(F.coalesce(raw, F.lit("")), "[1-5]", 0)
    return F.when(d != "", d.cast("int") / 5.0)
