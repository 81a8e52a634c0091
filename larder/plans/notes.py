"""Progress notes written from the orders: an order is a note of its customer, its words follow from the order's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.operators import notes
from larder.plans.registry import query
from larder.sources.tables import read

TYPES = ["Nursing Note", "nursing  notes", "Order Note", "Orders - Administration Note", "Social Services", "Social Work Note", "MD Progress Note", "NP/PA Progress  Note", "Nutrition/Dietary Note", "Skilled Documentation", "Skin Check", "Activities Note", None]
TEXTS = [
    "Routine rounds completed", "PO  intake was poor at lunch", "Continue weekly weights", "Resident was hospitalized for acute care", "Medication administered", "Resident died at 0430, postmortal care given",
    "Patient was pronounced by the RN", "SW will help reinstate SNAP benefits", "Housing application remains pending", "Unable to learn how to check blood sugar", "Refused a scheduled dose", "Skin intact, no wounds",
    "The overweighted load was moved", "Pronounced  dead, funeral home called", "Food  insecurity noted", "Enjoyed bingo",
]
LASTS = ["Dickow", "Okafor", "Lund", "Reyes", "O'Neil", "Smith-Jones", "Marsh"]
FIRSTS = ["Denise", "Yong", "Ana Maria", "Theo", "Ruth"]
NAMED = ["", " Yong Okafor is a 81 - year-old male.", " Ana Maria Reyes is a n 80-year-old.", " Denise Dickow is a 79-year-old."]


def _list_sql(values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    return F.get(F.array(*(F.lit(v) for v in values)), at.cast("int"))


NOTES = f"""notes AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 > 0 THEN o_custkey::VARCHAR END AS identifier,
  CASE WHEN o_custkey % 11 > 0 THEN {_list_sql(LASTS)}[o_custkey % 7 + 1] || ', ' || {_list_sql(FIRSTS)}[o_custkey % 5 + 1] END AS person_name,
  CASE WHEN o_orderkey % 97 > 0 THEN o_orderdate END AS note_date, {_list_sql(TYPES)}[(o_orderkey * 5 + o_custkey) % 13 + 1] AS note_type,
  {_list_sql(TEXTS)}[(o_orderkey // 3 + o_custkey) % 16 + 1] || '.' || {_list_sql(NAMED)}[CASE WHEN o_orderkey % 6 = 0 THEN o_custkey % 4 ELSE 0 END + 1] AS note_text FROM orders)"""


def written(spark, sf):
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf, "orders").select(
        key, person, F.when(person % 10 > 0, person.cast("string")).alias("identifier"),
        F.when(person % 11 > 0, F.concat(_pick(LASTS, person % 7), F.lit(", "), _pick(FIRSTS, person % 5))).alias("person_name"),
        F.when(key % 97 > 0, F.col("o_orderdate")).alias("note_date"), _pick(TYPES, (key * 5 + person) % 13).alias("note_type"),
        F.concat(_pick(TEXTS, (F.floor(key / 3) + person) % 16), F.lit("."), _pick(NAMED, F.when(key % 6 == 0, person % 4).otherwise(0))).alias("note_text"),
    )


def _says_sql(terms, text="note_text"):
    """Whole words without look-around: this dialect has none."""
    return rf"regexp_matches({text}, '(?i)(^|\W)(?:{terms})($|\W)')"


_KIND = r"coalesce(trim(regexp_replace(lower(note_type), '\s+', ' ', 'g')), '')"
_NUTRITION = "(?:" + "|".join(t.replace(" ", r"\s+") for t in fixed.NUTRITION_TERMS) + ")(?:s|es)?"
_any = lambda words: "(" + " OR ".join(f"contains(kind, '{w}')" for w in words) + ")"
_in = lambda words: "kind IN (" + ", ".join(f"'{w}'" for w in words) + ")"
_ACTION = f"CASE WHEN ({_in(fixed.FILTERED_NOTES)} OR starts_with(kind, 'nursing')) AND NOT {_says_sql(_NUTRITION)} AND NOT {_says_sql(fixed.CRITICAL_EVENTS)} THEN 'filter' ELSE 'send' END"
KINDS = f"kinds AS (SELECT *, {_KIND} AS kind FROM notes)"


@query("q_note_actions", f"WITH {NOTES}, {KINDS} SELECT o_orderkey, {_ACTION} AS action, {_any(fixed.NUTRITION_NOTE_WORDS)} AS is_nutrition FROM kinds")
def note_actions(spark, sf):
    kind, text = F.col("note_type"), F.col("note_text")
    return written(spark, sf).select("o_orderkey", notes.action(kind, text).alias("action"), notes.is_nutrition_note(kind).alias("is_nutrition"))


_TOKENS = lambda name: f"regexp_extract_all(lower(CASE WHEN contains({name}, ',') THEN split_part({name}, ',', 2) || ' ' || split_part({name}, ',', 1) ELSE {name} END), '[a-z]+')"
_PATIENT = fixed.NAMED_PATIENT.replace("'", "''")
_ASSESSMENT = f"""WITH {NOTES}, {KINDS},
t AS (SELECT *, {_TOKENS("person_name")} AS own, regexp_extract_all(lower(regexp_extract(note_text, '{_PATIENT}', 1)), '[a-z]+') AS named FROM kinds),
c AS (SELECT *, CASE WHEN kind = '{fixed.ADMINISTRATION_NOTE}' THEN 'administration'
  WHEN len(named) >= 2 AND len(own) >= 2 AND (named[1] <> own[1] OR named[-1] <> own[-1]) THEN 'other_person'
  WHEN {_says_sql(fixed.CRITICAL_EVENTS)} THEN 'critical'
  WHEN {_in(fixed.ALWAYS_SENT_NOTES)} OR {_any(fixed.ASSESSMENT_NOTE_WORDS)} THEN 'type'
  WHEN starts_with(kind, 'social') THEN CASE WHEN {_says_sql(fixed.SOCIAL_TERMS)} THEN 'social' ELSE 'unrelated' END
  WHEN {_says_sql(fixed.CLINICAL_TERMS)} THEN 'clinical' ELSE 'unrelated' END AS choice FROM t)
SELECT o_orderkey, choice, choice IN ('critical', 'type', 'social', 'clinical') AS chosen FROM c"""


@query("q_assessment_notes", _ASSESSMENT)
def assessment_notes(spark, sf):
    choice = notes.assessment_choice(F.col("note_type"), F.col("note_text"), F.col("person_name"))
    return written(spark, sf).select("o_orderkey", choice.alias("choice")).withColumn("chosen", notes.is_chosen(F.col("choice")))


@query("q_identity_notes", f"WITH {NOTES} SELECT identifier, person_name, min(o_orderkey) AS o_orderkey FROM notes WHERE identifier IS NOT NULL OR person_name IS NOT NULL GROUP BY ALL")
def identity_notes(spark, sf):
    return notes.header_identities(written(spark, sf), [F.col("o_orderkey")]).select("identifier", "person_name", "o_orderkey")


#: Reports that hold the notes up to these days, each again those of the one before; a note's extraction fails in the rounds that this rule names.
ROUNDS = ("1995-01-01", "1997-01-01", "2100-01-01")
_FAILS = lambda k: f"(note_key + {k}) % 3 = 0"
_KEYED = "o_custkey * 100000 + year(o_orderdate) * 10 + {kind}"


def _work_sql() -> str:
    """The rounds in closed form: a note's first sent copy counts; it is tried in every round from its first until one does not fail."""
    first_round = "CASE " + " ".join(f"WHEN o_orderdate < TIMESTAMP '{day}' THEN {k}" for k, day in enumerate(ROUNDS)) + " END"
    tries = "CASE " + " ".join(f"WHEN since <= {k} AND NOT ({_FAILS(k)}) THEN {k} - since + 1" for k in range(len(ROUNDS))) + f" ELSE {len(ROUNDS)} - since END"
    done = " OR ".join(f"(since <= {k} AND NOT ({_FAILS(k)}))" for k in range(len(ROUNDS)))
    return f"""WITH {NOTES}, k AS (SELECT n.*, {_KIND} AS kind, o_orderdate, n.o_custkey * 100000 + year(o_orderdate) * 10 + n.o_orderkey % 2 AS note_key, {first_round} AS round FROM notes n JOIN orders USING (o_orderkey)),
s AS (SELECT *, {_ACTION} = 'send' AS sent FROM k),
f AS (SELECT note_key, since, undated FROM (SELECT note_key, list(note_date IS NOT NULL ORDER BY o_orderkey) AS dated, round FROM s WHERE sent GROUP BY note_key, round) x
  JOIN LATERAL (SELECT x.round AS since, NOT x.dated[1] AS undated) ON TRUE),
w AS (SELECT note_key, since FROM f WHERE NOT undated)
SELECT note_key, CASE WHEN {done} THEN 'extracted' ELSE 'failed' END AS status, {tries} AS attempts FROM w"""


@query("q_note_work", _work_sql())
def note_work(spark, sf):
    dates = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    key = (F.col("o_custkey") * 100000 + F.year("o_orderdate") * 10 + F.col("o_orderkey") % 2).alias("note_key")
    all_notes = written(spark, sf).join(dates, "o_orderkey").select("*", key)
    stored = spark.createDataFrame([], "note_key long, status string, attempts int")
    for k, day in enumerate(ROUNDS):
        work = notes.steps(all_notes.filter(F.col("o_orderdate") < day), stored, [F.col("o_orderkey")])
        # what an extraction would report of each note that it was given
        outcomes = work.filter("step = 'extract'").select("note_key", (~F.expr(_FAILS(k))).alias("ok"))
        stored = notes.settle(stored, work, outcomes)
    return stored.select("note_key", "status", F.col("attempts").cast("long").alias("attempts"))
