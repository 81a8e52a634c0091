"""Size-bounded context records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import tokens_estimate, truncate_to_tokens

#: How many rows of each collection a context holds.
READ_CAPS = {"weights": 30, "labs": 50, "observations": 30, "notes": 20, "facts": 50, "domain": 50}
MAX_MATCHES, MATCH_TOKENS, EXTRA_TOKENS = 5, 1200, 1000


def capped(lists: dict[str, int]) -> dict[str, Column]:
    """The first n items of each list column, and a map of how many were left out, without zeros."""
    over = {c: F.greatest(F.size(c) - n, F.lit(0)) for c, n in lists.items()}
    omitted = F.map_filter(F.create_map(*(x for c in lists for x in (F.lit(c), over[c]))), lambda _, v: v > 0)
    return {**{c: F.slice(c, 1, n) for c, n in lists.items()}, "omitted": omitted}


def budget(df: DataFrame, lists: dict[str, int], extra: str | None = None, matches: str | None = None) -> DataFrame:
    """Cap the lists, shorten the extra text and the matches, and report tokens before and after."""
    body = lambda cols: tokens_estimate(F.to_json(F.struct(*cols)))
    names = [*lists, *([extra] if extra else []), *([matches] if matches else [])]
    raw = df.withColumn("raw_tokens", body([F.col(c) for c in names]))
    out = raw.withColumns(capped(lists))
    if extra:
        out = out.withColumn(extra, truncate_to_tokens(F.nullif(F.trim(extra), F.lit("")), EXTRA_TOKENS))
    if matches:
        out = out.withColumn(matches, F.transform(F.slice(matches, 1, MAX_MATCHES), lambda m: truncate_to_tokens(m, MATCH_TOKENS)))
    out = out.withColumn("budgeted_tokens", body([F.col(c) for c in names]))
    saved = F.col("raw_tokens") - F.col("budgeted_tokens")
    return out.withColumns({"saved_tokens": saved, "saved_percent": F.bround(F.try_divide(saved.cast("double"), F.col("raw_tokens").cast("double")) * 100, 1)})
