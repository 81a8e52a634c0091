"""Sentences that tell of feeding orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(x: Column) -> Column:
    """A number without closing zeros, six digits at most."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1.0))))).cast("int")
    text = F.when(digits >= 5, F.format_string("%.5f", x)).when(digits == 4, F.format_string("%.4f", x)).when(digits == 3, F.format_string("%.3f", x)).when(digits == 2, F.format_string("%.2f", x)).when(digits == 1, F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x))
    return F.when(x.isNotNull(), F.regexp_replace(text, r"(\.\d*?)0+$|\.$", "$1")).cast("string")


def _text(*parts) -> Column:
    """Joined parts; null as soon as one is."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _or_none(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def nutrition_summary(kcal: Column, protein_g: Column, fluids_ml: Column, has_flush: Column, has_supplement: Column) -> Column:
    """What feed, flush and supplement give together."""
    sources = F.concat_ws(" + ", F.lit("TF"), F.when(has_flush, "FWF"), F.when(has_supplement, "Protein supplement"))
    verb = F.when(has_flush | has_supplement, "are").otherwise("is")
    trimmed = lambda x: F.regexp_replace(short(x.cast("double")), r"\.$", "")
    return _text(sources, " ", verb, " providing res with ", trimmed(kcal), " kcal, ", trimmed(protein_g), " g PRO and ", trimmed(fluids_ml), " mls fluids.")


def bolus_order(formula: Column, per_bolus_ml: Column, route: Column, feeds: Column, total_ml: Column, flush_side_ml: Column, flush_total_ml: Column) -> Column:
    order = _text("Enteral feeding ", formula, " ", per_bolus_ml, " ml via ", F.upper(route), " ", feeds, " times daily. AND every day shift document total volume infused in 24 hrs (", total_ml, " ml).")
    flush = _text(" FWF ", flush_side_ml, " ml before and after each bolus to provide TV ", flush_total_ml, " mls.")
    return F.when(per_bolus_ml.isNull() | route.isNull(), "Incomplete bolus tube-feed results.").otherwise(F.concat(order, _or_none(flush)))


def continuous_order(formula: Column, rate: Column, route: Column, start_time: Column, total_ml: Column, starting_rate: Column, increase: Column, flush_rate: Column, flush_total_ml: Column) -> Column:
    order = _text("Rec ", formula, " @ ", rate, " ml/hr via ", F.upper(route), " up at ", start_time, ". ")
    slow = F.when(starting_rate < rate, _text("START AT ", starting_rate, " ML/HR. INCREASE BY ", increase, " ML EVERY HOUR UNTIL ", rate, "ML/HR. "))
    told = _text("AND every day shift document total volume infused in 24 hrs (", total_ml, " ml).")
    flush = _text(" FWF @ ", flush_rate, " ml/hr to provide TV ", flush_total_ml, " mls.")
    return F.when(rate.isNull() | route.isNull() | start_time.isNull(), "Incomplete continuous tube-feed results.").otherwise(F.concat(order, _or_none(slow), told, _or_none(flush)))
