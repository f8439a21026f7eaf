"""Column functions on text that behave alike in every operator.

Words follow Unicode in Spark's regular expressions only where said so; blanks include the
non-breaking ones. Lengths and cuts count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"(?U)\s+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between blanks, none of them empty; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda x: x != "")


def word_set(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of at least `least` letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0)))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(word_count(text) * F.lit(1.3).cast("double")).cast("int")


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared words over the smaller of two word sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared / least).otherwise(F.lit(0.0))


def non_empty(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def cut(text: str | None, n: int) -> str:
    """`truncated` for a string at hand."""
    return "(empty)" if not text else text if len(text) <= n else text[: n - 3] + "..."


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last three dots if cut; `(empty)` for nothing."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("(empty)")).when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which the JVM functions lack; texts already composed pass unchanged."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC; only texts with combining marks pay the trip to Python."""
    return F.when(text.rlike(r"\p{M}|[\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAFF}]"), nfc(text)).otherwise(text)
