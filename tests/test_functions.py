import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.functions import dates, nutrition, text

L = F.lit


def day(s):
    return L(s).cast("date")


def test_energy_kernels(one):
    assert one(x=nutrition.mifflin(180, 70, L("m"), 30)) == 2141.34
    assert one(x=nutrition.mifflin(150, 65, L("f"), 25, 1.5)) == 2141.51
    assert one(x=nutrition.ideal_weight(L("m"), 66)) == 142
    assert one(x=nutrition.ideal_weight(L("f"), 58)) == 90
    assert one(x=nutrition.adjusted_ideal_weight(220, L(142))) == 161.5
    assert one(x=nutrition.scaled_range(100, F.struct(L(0.8).alias("low"), L(1.2).alias("high")))).asDict() == {"low": 80, "high": 120}


@pytest.mark.parametrize(("value", "age", "name"), [(18.49, 40, "UNDERWEIGHT"), (18.5, 40, "NORMAL"), (25.0, 40, "OVERWEIGHT"), (40.0, 40, "MORBIDLY_OBESE"), (21.9, 70, "UNDERWEIGHT"), (28.0, 65, "OVERWEIGHT")])
def test_bmi_categories(one, value, age, name):
    assert one(x=nutrition.bmi_category(L(value), L(age))) == name


def test_amputation_truncates(one):
    assert one(x=nutrition.amputation_bmi(150.0, 66, 16.0)) == one(x=nutrition.bmi(178, 66))


def test_parenteral_example(one):
    got = one(**nutrition.parenteral_nutrition(1800.0, L(None).cast("double"), 12.0, 200.0, 50.0, L("piggyback"), 20.0, 250.0, 60.0))
    assert (got["rate_ml_hr"], got["dextrose_g_day"], got["amino_acid_g_day"], got["total_kcal_day"], got["total_fluid_ml_day"], got["gir_mg_kg_min"]) == (150, 360, 90, 2084, 2050, 8.33)
    none = L(None).cast("double")
    got = one(**nutrition.parenteral_nutrition(none, 75.0, 16.0, none, none, L("included"), none, 200.0, none))
    assert (got["total_volume_ml"], got["total_fluid_ml_day"], got["total_kcal_day"]) == (1200, 1200, None)
    assert one(x=nutrition.parenteral_schedule(1000.0, 100.0, 12.0))["status"] == "conflict"
    assert one(x=nutrition.parenteral_schedule(1000.0, 20.0, none))["status"] == "over 24 hours"
    assert one(x=nutrition.lipid_rate(250.0, none, 10.0))["rate"] == 25


def test_tube_feed(one):
    totals = nutrition.feed_totals(1800, 2000, 375, 17.0, 180.0, 250)
    got = one(**totals)
    assert got["total_volume_ml"] == 1300 and got["kcal_per_day"] == 1950 and got["protein_per_day_g"] == 88.4
    assert got["fluids_per_day_ml"] == 936.0 and got["flush_volume_ml"] == 1000
    assert one(**nutrition.continuous_feed(1300, 1000, 20, 200)) == {"rate_ml_per_hr": 65, "flush_rate_ml_per_hr": 50, "starting_rate_ml_per_hr": 65}
    assert one(**nutrition.bolus_feed(1300, 1000, 5)) == {"volume_per_bolus_ml": 260, "flush_per_side_ml": 100}
    assert one(x=nutrition.round_hundred(L(1250))) == 1200  # half to even


def test_documented_feed(one):
    none = L(None).cast("double")
    assert one(x=nutrition.documented_feed(L("bolus"), none, none, 240.0, 5, 30.0, none)).asDict() == {"status": "computed", "volume_ml": 1200, "flush_ml": 150}
    assert one(x=nutrition.documented_feed(L(None).cast("string"), 50.0, none, none, none, none, none))["status"].startswith("continuous")


@pytest.mark.parametrize(("latest", "previous", "label"), [("2026-09-01", "2026-07-28", "1 month"), ("2026-09-01", "2026-07-16", "2 months"), ("2026-09-01", "2026-08-25", "<1 month")])
def test_elapsed(one, latest, previous, label):
    assert one(x=dates.elapsed_label(day(latest), day(previous))) == label


def test_windows(one):
    assert one(x=dates.change_window(day("2026-02-28"), day("2026-01-31"))) == 1  # clamped to the month's end
    assert one(x=dates.change_window(day("2026-08-01"), day("2026-01-31"))) is None
    assert one(x=dates.significant(L(1), L(-5.0))) and not one(x=dates.significant(L(1), L(-4.99)))
    assert one(x=dates.significant(L(3), L(7.5))) and one(x=dates.significant(L(6), L(-10.0)))


def test_dates(one):
    assert one(x=dates.completed_years(day("2000-02-29"), day("2023-02-28"))) == 22
    assert one(x=dates.parse_date(L("Jan 5, 2026"))) == dt.date(2026, 1, 5)
    assert one(x=dates.parse_date(L("someday"))) is None
    assert one(x=dates.parse_time(L("1:05 pm"))) == 13 * 3600 + 300
    assert one(x=dates.range_end(L("Report,1/25/2026 - 1/26/2026"))) == dt.date(2026, 1, 26)
    assert one(x=dates.zoned(L("2026-01-01 00:00:00").cast("timestamp"), L("XYZ"))) is None
    assert [one(x=dates.twelve_hour(L(h), L(pm))) for h, pm in ((12, False), (12, True), (1, True))] == [0, 12, 13]


def test_text(one):
    assert one(x=text.fold(L("  Groß\t  STRASSE "))) == "gross strasse"
    assert one(x=text.collapse_or_null(L(" \n "))) is None
    assert one(f=text.first_name(L("Sample, Ada M")), l=text.last_name(L("Van Sample, Ada M"))) == {"f": "Ada", "l": "Van Sample"}
    assert one(f=text.first_name(L("Ada")), l=text.last_name(L("Ada"))) == {"f": "Ada", "l": ""}
    assert one(x=text.plain_number(L(140.50))) == "140.5" and one(x=text.plain_number(L(100))) == "100"
    assert one(x=text.text_union(L("Cleanse"), L("Cleanse and dress"))) == "Cleanse and dress"
    assert one(x=text.text_union(L("a"), L("b"))) == "a\nb"
    assert one(x=text.optional_value(L(" NaN "))) is None and one(x=text.whole_number(L("x"))) is None
    assert one(x=text.alias_or_slug(L("Low-Fat  Diet"), text.DIET_ALIASES)) == "low_fat_diet"
    assert one(x=text.first_of(L("b then a"), ["a", "b"])) == "b" and one(x=text.first_of(L("zz"), ["a"])) is None
    assert one(x=text.tokens_estimate(L("ééé"))) == 2
    assert one(x=text.sex_code(L(" Female "))) == "f" and one(x=text.sex_code(L("?"))) is None
    assert one(x=text.name_tokens(L("Sample, Ada"))) == ["ada", "sample"]
    assert one(x=text.mime_type(L("a/b.CSV"))) == "text/csv"


def test_truncation_keeps_code_points(one):
    got = one(x=text.truncate_to_tokens(L("é" * 200), 20))
    assert got.endswith("\n[truncated]") and len(got.encode()) <= 60 and got.startswith("é")
    assert one(x=text.truncate_to_tokens(L("short"), 20)) == "short"


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁne  X",), (None,)], "s string").select(text.compatible("s").alias("s")).collect()
    assert [r["s"] for r in rows] == ["fine x", None]
