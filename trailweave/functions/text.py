"""Text column helpers."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Id prefixes that are removed, in this order, and texts that mean "no value".
ID_PREFIXES = ("foursquare:", "schema:", "wd:")
NULL_TEXTS = ("", "nan", "none", "null")


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def normalize_field(c: Column) -> Column:
    out = F.trim(c)
    for p in ID_PREFIXES:
        out = strip_prefix(out, p)
    return F.trim(out)


def clean_id(c: Column, prefix: str = "foursquare:") -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed != "", strip_prefix(trimmed, prefix))


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; the JVM's functions have none."""
    return texts.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


def norm_text(c: Column) -> Column:
    """Trim, lower-case, decompose (NFKD), drop diacritics, collapse blanks. Only texts beyond ASCII are passed to Python."""
    lowered = F.lower(F.trim(c))
    odd = F.when(lowered.rlike(r"[^\x00-\x7F]"), lowered)
    return F.regexp_replace(F.coalesce(_without_marks(odd), lowered), r"\s+", " ")


def null_like(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(~F.lower(trimmed).isin(*NULL_TEXTS), trimmed)


def empty_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
