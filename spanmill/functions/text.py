"""Record clean-up and text keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ESCAPE = r"\\u[0-9a-fA-F]{4}"


def null_sentinel(x: Column, *sentinels: str) -> Column:
    """Null where the text is one of the sentinels (``null`` by default)."""
    return F.when(~x.isin(*(sentinels or ("null",))), x)


def clean_sentinels(df: DataFrame, sentinel: str = "null") -> DataFrame:
    """The literal text ``null`` of any string column becomes null."""
    return df.select(*(F.nullif(F.col(f"`{n}`"), F.lit(sentinel)).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def clock_minutes(clock: Column) -> Column:
    """``MM:SS`` or ``MM:SS.mmm`` as minutes."""
    parts = F.split(clock, ":")
    return F.get(parts, 0).cast("double") + F.get(parts, 1).cast("double") / 60.0


def int_or_null(x: Column) -> Column:
    return x.try_cast("int")


def card_minute(x: Column) -> Column:
    """Minute of a card; 0, empty and ``null`` mean none."""
    return F.nullif(x.try_cast("int"), F.lit(0))


def profile_key(player: Column, competition: Column) -> Column:
    return F.format_string("wy-%d-c-%d", player, competition)


def has_escape(x: Column) -> Column:
    """Whether a literal \\uXXXX is left in the text."""
    return x.rlike(ESCAPE)


def search_text(x: Column) -> Column:
    """Lower-case, trimmed, without accents (NFKD, combining marks removed)."""
    return _search_text(x)


def decode_escapes(x: Column) -> Column:
    """Literal \\uXXXX sequences as the characters they name."""
    return _decode_escapes(x)


@F.pandas_udf(StringType())
def _search_text(x: pd.Series) -> pd.Series:
    def one(v):
        if v is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).lower().strip()

    return x.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _decode_escapes(x: pd.Series) -> pd.Series:
    return x.map(lambda v: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), v), na_action="ignore")


def natural_key(column: Column) -> Column:
    """Sort key by which 'a2' comes before 'a10': each run of digits without its leading zeros, led
    by its length; other runs folded to lower case."""
    parts = F.regexp_extract_all(F.lower(column), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")
