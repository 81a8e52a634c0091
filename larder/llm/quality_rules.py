"""Quality rules with adaptive thresholds, in SQL functions only.

Every text gets word and line measures. A few hard rules, the base, reject at once. All
other limits are learnt from the texts that pass the base: for each (language, source)
and each ratio a quantile sketch is kept, a histogram over logarithmic buckets (value
GROWTH ** b), so a quantile is right within a factor of GROWTH and sketches merge by
adding counts, in any order, with the same result. A document is rejected where a ratio
lies beyond the fence of its group: MID plus FENCE spreads, where LOW and MID are lower
quantiles, which stay those of good texts while up to half of a group's are bad, and a
spread is what lies between them, a sketch bucket, and one event's share of a text of the
group's median length (one symbol, one line, the shortest repetition), so it is never 0. No limit is a
constant. A group's fence is averaged with its language's, and that with the corpus's, as
if these were PRIOR_ROWS rows of its own: a small group leans on the larger one, without
a switch.

Defined cases: a null text has no words and fails the base rules; null languages and
sources are groups of their own; a group whose texts all fail the base needs no fence;
repeated rows and ids are judged each for itself; a value on the fence passes; long texts
are measured whole; an empty table gives no rows; other columns pass through untouched
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Width of a sketch bucket, the quantiles and spreads of a fence, and the weight in rows of what a group leans on.
GROWTH = 1.01
LOW, MID, FENCE = 0.1, 0.4, 12.0
PRIOR_ROWS = 100.0
#: Ratios judged by adaptive thresholds: what they are shares of, and the size of one event in it.
RATIOS = {"symbol_ratio": ("chars", 1.0), "dup_line_ratio": ("words", 1.0), "repeat_ratio": ("words", 4.0), "mean_word": ("words", 1.0), "upper_ratio": ("chars", 1.0)}

SYMBOLS = "#*$%&|<>"
_BLANK = "[\\x20\\x09-\\x0D]+"
_VISIBLE = "[^\\x20\\x09-\\x0D]"


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _windows(w: Column) -> Column:
    """64-bit hashes of all runs of three words."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    first, second, third = F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n)
    return F.transform(F.arrays_zip(first.alias("a"), second.alias("b"), third.alias("c")), lambda z: F.xxhash64(z["a"], z["b"], z["c"]))


def _covered(windows: Column) -> Column:
    """Words within windows that occur twice or more: a repeated window at p covers p, p + 1 and p + 2."""
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = _let(
        numbered,
        lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"]))),
    )
    places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    gaps = _let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, g: a + g))
    return gaps


def repeat_words(w: Column) -> Column:
    """Words in three-word windows found twice or more in the text, first included."""
    counted = _let(_windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(counted)


def measured(text_col: Column) -> Column:
    """A struct of the measures of the whole text."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_VISIBLE))
    return F.struct(
        _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, _BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )


def with_measures(df: DataFrame, text_col: str, lang_col: str, source_col: str, whole: bool) -> DataFrame:
    """The measures as columns beside lang and source, and, in a struct `row`, the row's own columns (all, or all but the text), so that no name can clash."""
    own = [c for c in df.columns if whole or c != text_col]
    col = lambda c: F.col(f"`{c}`")
    row = F.struct(*map(col, own)).alias("row") if own else F.lit(None).alias("row")
    out = df.select(row, col(lang_col).alias("lang"), col(source_col).alias("source"), measured(col(text_col)).alias("m"))
    n, repeats = F.col("m.w.n_words"), F.col("m.w.n_repeat_words")
    base = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    return out.select("row", "lang", "source", n.alias("n_words"), "m.word_chars", "m.n_symbols", "m.n_dup_lines", repeats.alias("n_repeat_words"), "m.n_upper", base.alias("base_failed"))


def ratios() -> dict[str, Column]:
    """The judged ratios from the measures; null without words."""
    n, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / n,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
        "upper_ratio": F.col("n_upper") / chars,
    }


def sketch(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Mergeable quantile sketches: (keys, measure, bucket, n). The bucket of 0 is null."""
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()))).alias("r"))
    value = F.col("r.value")
    bucket = F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(GROWTH)))).cast("long")
    return rows.filter(value.isNotNull()).groupBy(*keys, F.col("r.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys from those of finer ones."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, low, mid, median) from sketches."""
    by = [*keys, "measure"]
    rising = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketches.withColumn("upto", F.sum("n").over(rising)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    value = F.coalesce(F.pow(F.lit(GROWTH), F.col("bucket") - 0.5), F.lit(0.0))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), value))
    return ranked.groupBy(*by).agg(F.max("total").alias("rows"), at(LOW).alias("low"), at(MID).alias("mid"), at(0.5).alias("median"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: rows and a fence for each ratio, from the sketches of the ratios and of the sizes that they are shares of."""
    of = lambda measure, what: F.max(F.when(F.col("measure") == measure, F.col(what)))
    one = {k: of(k, "mid") + FENCE * (GROWTH * of(k, "mid") - of(k, "low") + event / of(size, "median")) for k, (size, event) in RATIOS.items()}
    return quantiles(sketches, keys).groupBy(*keys).agg(F.max("rows").alias("rows"), *(v.alias(k) for k, v in one.items()))


def _leaning(k: str, other: str) -> Column:
    """The fence of ratio `k`, averaged with that of a larger group by rows."""
    return ((F.col("rows") * F.col(k) + PRIOR_ROWS * F.col(other)) / (F.col("rows") + PRIOR_ROWS)).alias(k)


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each (lang, source) with texts that pass the base: a fence for each ratio."""
    values = ratios() | {"words": F.col("n_words"), "chars": F.col("word_chars")}
    own = staged(sketch(rows.filter(~F.col("base_failed")), ["lang", "source"], values), "quality-sketches")
    named = lambda df, prefix: df.select(*(c for c in df.columns if c not in RATIOS and c != "rows"), *(F.col(k).alias(prefix + k) for k in RATIOS))
    corpus = named(fences(merge_sketches(own, []), []), "corpus_")  # one row
    by_lang = fences(merge_sketches(own, ["lang"]), ["lang"]).join(F.broadcast(corpus)).select("lang", "rows", *(_leaning(k, "corpus_" + k) for k in RATIOS))
    by_lang = named(by_lang.withColumnRenamed("lang", "of"), "lang_")
    found = fences(own, ["lang", "source"]).join(by_lang, F.col("lang").eqNullSafe(F.col("of")))
    return found.select("lang", "source", *(_leaning(k, "lang_" + k).alias("fence_" + k) for k in RATIOS))


def judged(rows: DataFrame) -> DataFrame:
    """Add kept to staged rows with measures. The thresholds are written first, so Spark broadcasts them only if their measured size allows."""
    limits = staged(thresholds(rows).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "quality-limits")
    found = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    beyond = F.lit(False)
    for k, ratio in ratios().items():
        beyond = beyond | F.coalesce(ratio > F.col("fence_" + k), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~beyond).select(*rows.columns, "kept")


def rule_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, measures, base_failed, kept) of every row. Texts are read once and never shuffled."""
    rows = df.select(id_col, text_col, lang_col, source_col)
    rows = judged(staged(with_measures(rows, text_col, lang_col, source_col, whole=False), "quality-measures"))
    return rows.select(F.col("row").getField(id_col).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "kept")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows whose texts pass, with their columns as they were."""
    rows = judged(staged(with_measures(df, text_col, lang_col, source_col, whole=True), "quality-rows"))
    return rows.filter("kept").select(*(F.col("row").getField(c).alias(c) for c in df.columns))
