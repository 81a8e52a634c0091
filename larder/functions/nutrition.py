"""Nutrition arithmetic as column expressions.

Every function takes columns (or literals) and returns a column, so the same code runs
in batch, in SQL views and in micro-batches, inside generated code. Rounding is half to
even throughout; ranges truncate. What would be an error becomes a status.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of clinical practice: bounds of the categories, by the upper end of each.
BMI_BOUNDS = {"adult": (18.5, 25.0, 30.0, 40.0), "older": (22.0, 28.0, 30.0, 40.0)}
BMI_CATEGORIES = ("UNDERWEIGHT", "NORMAL", "OVERWEIGHT", "OBESE", "MORBIDLY_OBESE")
OLDER_FROM = 65
CALORIE_FACTORS = {"lose": (20, 25), "maintain": (25, 30), "gain": (30, 35)}
PROTEIN_FACTORS = {False: (1.0, 1.2), True: (1.2, 1.5)}
WEIGHT_BASIS = {"CBW": "Current Body Weight", "IBW": "Ideal Body Weight", "AIBW": "Ideal Body Weight Adjusted for Obesity"}
DEXTROSE_KCAL_PER_G, AMINO_ACID_KCAL_PER_G = 3.4, 4.0
LIPID_KCAL_PER_ML = {10.0: 1.1, 20.0: 2.0, 30.0: 3.0}
SCHEDULE_TOLERANCE, DOCUMENTED_TOLERANCE = 0.01, 0.05

Num = Column | float | int


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def to_kg(lb: Num) -> Column:
    return F.bround(col(lb) / 2.2, 2)


def to_cm(inches: Num) -> Column:
    return F.bround(col(inches) * 2.54, 2)


def to_meters(inches: Num) -> Column:
    return F.bround(col(inches) * 0.0254, 2)


def bmi(weight_lb: Num, height_in: Num) -> Column:
    """Kilograms over metres squared, both already rounded."""
    m = to_meters(height_in)
    return F.bround(F.try_divide(to_kg(weight_lb), m * m), 2)


def bmi_category(value: Num, age: Num) -> Column:
    """Lower bounds belong to a category, upper bounds do not; people of 65 and over have bounds of their own."""
    value, age = col(value), col(age)

    def chain(bounds):
        out = F.when(value < 0, None)
        for limit, name in zip(bounds, BMI_CATEGORIES):
            out = out.when(value < limit, name)
        return out.when(value.isNotNull(), BMI_CATEGORIES[-1])

    return F.when(age >= OLDER_FROM, chain(BMI_BOUNDS["older"])).otherwise(chain(BMI_BOUNDS["adult"]))


def ideal_weight(sex: Num, height_in: Num) -> Column:
    """Hamwi: a base at five feet and a step for each inch above or below."""
    over = col(height_in) - 60
    return F.when(col(sex) == "f", 100 + 5 * over).when(col(sex) == "m", 106 + 6 * over)


def adjusted_ideal_weight(weight_lb: Num, ideal_lb: Num) -> Column:
    return col(ideal_lb) + 0.25 * (col(weight_lb) - col(ideal_lb))


def whole(x: Column) -> Column:
    """Truncation toward zero."""
    return x.cast("long")


def amputation_bmi(weight_lb: Num, height_in: Num, percent: Num) -> Column:
    return bmi(whole(col(weight_lb) / (1 - col(percent) / 100)), height_in)


def amputation_share(weight: Num, percent: Num) -> Column:
    """An ideal weight, adjusted or not, without the lost limb."""
    return col(weight) * (1 - col(percent) / 100)


def mifflin(weight_lb: Num, height_in: Num, sex: Num, age: Num, activity: Num = 1.2) -> Column:
    base = 10 * to_kg(weight_lb) + 6.25 * to_cm(height_in) - 5 * col(age)
    return F.bround(col(activity) * (base + F.when(col(sex) == "m", 5).when(col(sex) == "f", -161)), 2)


def weight_basis(category: Column) -> Column:
    return F.when(category.isin("UNDERWEIGHT", "NORMAL"), WEIGHT_BASIS["CBW"]).when(category == "OVERWEIGHT", WEIGHT_BASIS["IBW"]).when(category.isNotNull(), WEIGHT_BASIS["AIBW"])


def basis_weight(basis: Column, current: Column, ideal: Column, adjusted: Column) -> Column:
    return F.when(basis == WEIGHT_BASIS["CBW"], current).when(basis == WEIGHT_BASIS["IBW"], ideal).when(basis == WEIGHT_BASIS["AIBW"], adjusted)


def _pair(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))


def calorie_factor(goal: Num) -> Column:
    """Kilocalories for each kilogram; millilitres of fluid use the same pair."""
    out = F.when(col(goal).isNull(), _pair(F.lit(25), F.lit(30)))
    for name, (low, high) in CALORIE_FACTORS.items():
        out = out.when(col(goal) == name, _pair(F.lit(low), F.lit(high)))
    return out


def protein_factor(dialysis: Num) -> Column:
    on, off = PROTEIN_FACTORS[True], PROTEIN_FACTORS[False]
    return F.when(col(dialysis), _pair(F.lit(on[0]), F.lit(on[1]))).otherwise(_pair(F.lit(off[0]), F.lit(off[1])))


def scaled_range(kg: Num, factor: Column) -> Column:
    """(int(kg * low), int(kg * high))."""
    return _pair(whole(col(kg) * factor["low"]), whole(col(kg) * factor["high"]))


def needs_profile(weight_lb: Num, height_in: Num, sex: Num, age: Num, goal: Num = "maintain", dialysis: Num = False, activity: Num = 1.2, amputation_percent: Num | None = None) -> dict[str, Column]:
    """All derived measures of a person, by name. Without a factor of one's own the goal's and dialysis's defaults hold."""
    goal = F.lit(goal) if isinstance(goal, str) and goal in CALORIE_FACTORS else col(goal)
    plain = bmi(weight_lb, height_in)
    value = plain if amputation_percent is None else F.when(col(amputation_percent).isNotNull(), amputation_bmi(weight_lb, height_in, amputation_percent)).otherwise(plain)
    category = bmi_category(value, age)
    ideal = ideal_weight(sex, height_in)
    adjusted = adjusted_ideal_weight(weight_lb, ideal)
    basis = weight_basis(category)
    used = basis_weight(basis, col(weight_lb).cast("double"), ideal.cast("double"), adjusted.cast("double"))
    kg, kcal, protein = to_kg(used), calorie_factor(goal), protein_factor(dialysis)
    return {
        "bmi": value, "bmi_category": category, "ideal_weight_lb": ideal, "adjusted_weight_lb": adjusted, "weight_basis": basis, "calculation_weight_lb": used, "calculation_weight_kg": kg,
        "calories_kcal_day": scaled_range(kg, kcal), "protein_g_day": scaled_range(kg, protein), "fluids_ml_day": scaled_range(kg, kcal), "mifflin_kcal_day": mifflin(weight_lb, height_in, sex, age, activity),
    }


def missing_inputs(inputs: dict[str, Column]) -> Column:
    """Names of the inputs that are null, in order."""
    return F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in inputs.items())), lambda x: x.isNotNull())


def needs_gate(conflict: Column, missing: Column, result: Column) -> Column:
    """A conflict or a missing input leaves the needs uncomputed, and says why."""
    state = F.when(conflict, "conflict").when(F.size(missing) > 0, "missing").otherwise("computed")
    return F.struct(state.alias("status"), missing.alias("missing"), F.when(state == "computed", result).alias("result"))


def round_hundred(x: Num) -> Column:
    return F.bround(col(x).cast("double") / 100).cast("long") * 100


def nearest_five(x: Num) -> Column:
    return (5 * F.bround(col(x) / 5)).cast("long")


def up_to_five(x: Num) -> Column:
    return (5 * F.ceil(col(x) / 5)).cast("long")


def caloric_density(kcal: Num, serving: Num) -> Column:
    return F.try_divide(col(kcal).cast("double"), col(serving).cast("double"))


def feed_totals(energy_low: Num, energy_high: Num, kcal: Num, protein: Num, water: Num, serving: Num, fluid_target: Num | None = None, flush_target: Num | None = None) -> dict[str, Column]:
    """Daily volume of a formula for the mean energy need, what it delivers, and the water to add. The nutrient amounts are those of one serving."""
    mean = F.floor((col(energy_low) + col(energy_high)) / 2)
    volume = round_hundred(F.try_divide(mean.cast("double"), caloric_density(kcal, serving)))
    times = F.try_divide(volume.cast("double"), col(serving).cast("double"))
    kcal_day = F.bround(col(kcal) * times).cast("long")
    protein_day, water_day = F.bround(col(protein) * times, 1), F.bround(col(water) * times, 1)
    target = kcal_day.cast("double") if fluid_target is None else F.coalesce(col(fluid_target).cast("double"), kcal_day.cast("double"))
    flush = round_hundred(F.greatest(target - water_day, F.lit(0.0)))
    if flush_target is not None:
        flush = F.coalesce(col(flush_target).cast("long"), flush)
    return {"total_volume_ml": volume, "kcal_per_day": kcal_day, "protein_per_day_g": protein_day, "fluids_per_day_ml": water_day, "flush_volume_ml": flush, "total_fluids_per_day_ml": F.bround(water_day + flush, 1)}


def continuous_feed(volume: Num, flush: Num, hours: Num, starting_rate: Num | None = None) -> dict[str, Column]:
    rate = nearest_five(F.try_divide(col(volume).cast("double"), col(hours).cast("double")))
    out = {"rate_ml_per_hr": rate, "flush_rate_ml_per_hr": F.when(col(flush) > 0, up_to_five(F.try_divide(col(flush).cast("double"), col(hours).cast("double"))))}
    if starting_rate is not None:
        out["starting_rate_ml_per_hr"] = F.when(col(starting_rate).isNotNull(), F.least(col(starting_rate).cast("long"), rate))
    return out


def bolus_feed(volume: Num, flush: Num, feeds: Num) -> dict[str, Column]:
    per_side = up_to_five(F.try_divide(col(flush).cast("double"), (col(feeds) * 2).cast("double")))
    return {"volume_per_bolus_ml": F.bround(F.try_divide(col(volume).cast("double"), col(feeds).cast("double"))).cast("long"), "flush_per_side_ml": F.when(col(flush) > 0, per_side)}


def documented_feed(method: Num, rate: Num, hours: Num, bolus_volume: Num, boluses: Num, flush_ml: Num, flush_hours: Num) -> Column:
    """Volume and flush water of a documented feeding order: struct(status, volume_ml, flush_ml)."""
    bolus = F.coalesce(col(method) == "bolus", F.lit(False))
    volume = F.when(bolus, col(bolus_volume) * col(boluses)).otherwise(col(rate) * col(hours))
    water = F.when(col(flush_ml).isNull(), F.lit(0.0)).when(col(flush_hours).isNotNull(), col(flush_ml) * F.try_divide(F.lit(24.0), col(flush_hours))).when(bolus & (col(boluses) > 0), col(flush_ml) * col(boluses))
    status = (
        F.when(bolus & volume.isNull(), "bolus needs volume and feeds a day")
        .when(volume.isNull(), "continuous feeding needs rate and hours a day")
        .when(water.isNull(), "flush volume without frequency")
        .otherwise("computed")
    )
    ok = status == "computed"
    return F.struct(status.alias("status"), F.when(ok, F.bround(volume, 1)).alias("volume_ml"), F.when(ok, F.bround(water, 1)).alias("flush_ml"))


def parenteral_schedule(volume: Num, rate: Num, hours: Num) -> Column:
    """struct(status, volume, rate, hours), the missing one of the three derived from the others."""
    v, r, h = (col(x).cast("double") for x in (volume, rate, hours))
    expected = r * h
    status = F.when(F.abs(expected - v) / v > SCHEDULE_TOLERANCE, "conflict").when(h.isNull() & (F.try_divide(v, r) > 24), "over 24 hours").otherwise("ok")
    ok = status == "ok"
    return F.struct(
        status.alias("status"),
        F.when(ok, F.coalesce(v, expected)).alias("volume"),
        F.when(ok, F.coalesce(r, F.try_divide(v, h))).alias("rate"),
        F.when(ok, F.coalesce(h, F.try_divide(v, r))).alias("hours"),
    )


def parenteral_nutrition(
    volume: Num, rate: Num, hours: Num, dextrose_g_l: Num, amino_g_l: Num, lipid_delivery: Num, lipid_percent: Num, lipid_volume: Num, weight_kg: Num, documented_protein: Num | None = None, documented_kcal: Num | None = None
) -> dict[str, Column]:
    """What a prescription delivers in a day. Sums are null where a part is unknown; warnings list what does not agree."""
    plan = parenteral_schedule(volume, rate, hours)
    litres = plan["volume"] / 1000
    dextrose, amino = col(dextrose_g_l) * litres, col(amino_g_l) * litres
    delivery = col(lipid_delivery)
    none, unknown = F.coalesce(delivery == "none", F.lit(False)), delivery.isNull() | (delivery == "unknown")
    lipid_g = F.when(none, 0.0).otherwise(col(lipid_volume) * col(lipid_percent) / 100)
    per_ml = F.lit(None).cast("double")
    for percent, kcal in LIPID_KCAL_PER_ML.items():
        per_ml = F.when(col(lipid_percent) == percent, kcal).otherwise(per_ml)
    lipid_kcal = F.when(none, 0.0).otherwise(col(lipid_volume) * per_ml)
    total = dextrose * DEXTROSE_KCAL_PER_G + amino * AMINO_ACID_KCAL_PER_G + lipid_kcal
    fluid = F.when((delivery == "piggyback") & col(lipid_volume).isNotNull(), plan["volume"] + col(lipid_volume)).when(~unknown, plan["volume"])
    out = {
        "schedule_status": plan["status"], "total_volume_ml": F.bround(plan["volume"], 2), "rate_ml_hr": F.bround(plan["rate"], 2), "hours_per_day": F.bround(plan["hours"], 2),
        "dextrose_g_day": F.bround(dextrose, 2), "amino_acid_g_day": F.bround(amino, 2), "dextrose_kcal_day": F.bround(dextrose * DEXTROSE_KCAL_PER_G, 2), "amino_acid_kcal_day": F.bround(amino * AMINO_ACID_KCAL_PER_G, 2),
        "lipid_g_day": F.bround(lipid_g, 2), "lipid_kcal_day": F.bround(lipid_kcal, 2), "total_kcal_day": F.bround(total, 2), "total_fluid_ml_day": F.bround(fluid, 2),
        "gir_mg_kg_min": F.bround(F.try_divide(dextrose * 1000, col(weight_kg) * plan["hours"] * 60), 2),
        "lipid_warning": F.coalesce(~none & lipid_g.isNotNull() & per_ml.isNull(), F.lit(False)),
    }
    for name, made, told in (("protein", amino, documented_protein), ("calories", total, documented_kcal)):
        if told is not None:
            out[f"{name}_differs"] = F.coalesce(F.abs(made - col(told)) / F.greatest(F.abs(col(told)), F.lit(1.0)) > DOCUMENTED_TOLERANCE, F.lit(False))
    return out


def lipid_rate(volume: Num, rate: Num, hours: Num) -> Column:
    """struct(status, rate): the documented rate, or volume over hours; a conflict beyond one percent."""
    v, r, h = (col(x).cast("double") for x in (volume, rate, hours))
    conflict = F.coalesce(F.abs(r * h - v) / v > SCHEDULE_TOLERANCE, F.lit(False))
    return F.struct(F.when(conflict, "conflict").otherwise("ok").alias("status"), F.when(~conflict, F.coalesce(r, F.try_divide(v, h))).alias("rate"))
