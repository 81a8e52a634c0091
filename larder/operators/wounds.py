"""Wounds from CSV reports, each once for its patient, number and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.functions.dates import range_end
from larder.functions.text import optional_value, whole_number
from larder.operators.merge import union_texts
from larder.operators.relational import required
from larder.sources.documents import after_header

TEXTS = ["assessment_note", "physician_orders", "physician_orders_notes"]
FIELDS = [c for c in fixed.WOUND_COLUMNS if c not in TEXTS]


def wound_rows(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, record, identifier, person_name, facility_name, observed_at, fields of wounds): the rows of wound reports that name a patient. A table without a day in the lines above it fails the job; a text without a table has no rows."""
    above = F.substring_index(F.col(text), fixed.WOUND_HEADER, 1)
    heads = texts.select(doc, text, range_end(above).cast("timestamp").alias("observed_at"), F.nullif(F.trim(F.regexp_extract(text, fixed.WOUND_FACILITY, 1)), F.lit("")).alias("facility_name"))
    headings = [fixed.WOUND_HEADER, "Name", *fixed.WOUND_COLUMNS.values()]
    rows = after_header(heads, doc, text, fixed.WOUND_HEADER, headings, ["observed_at", "facility_name"])
    # the test names a column of the rows too, so that it is not made of texts without a table
    rows = rows.filter(required(F.col("observed_at").isNotNull() | (F.col("record") < 0), "a wound report has no day"))
    cell = lambda heading: F.get("cells", F.lit(headings.index(heading)))
    fields = {c: optional_value(cell(h)) for c, h in fixed.WOUND_COLUMNS.items()}
    fields["weeks_in_treatment"] = whole_number(cell(fixed.WOUND_COLUMNS["weeks_in_treatment"])).cast("int")
    fields |= {c: F.coalesce(fields[c], F.lit("Unknown")) for c in ("wound_type", "location")}
    out = rows.select(doc, "record", optional_value(cell(fixed.WOUND_HEADER)).alias("identifier"), optional_value(cell("Name")).alias("person_name"), "facility_name", "observed_at", *(v.alias(c) for c, v in fields.items()))
    return out.filter("identifier IS NOT NULL")


def wound_report(texts: DataFrame, doc: str = "doc", text: str = "text", identifier: str | None = None) -> DataFrame:
    """`wound_rows`, all or one patient's, with the rows of one patient, wound number and day made one: the first cells known, the free texts united."""
    rows = wound_rows(texts, doc, text)
    if identifier and identifier.strip():
        rows = rows.filter(F.lower("identifier") == identifier.strip().lower())
    rows = rows.withColumns({"_who": F.lower("identifier"), "_which": F.lower("wound_number")})
    return union_texts(rows, [doc, "_who", "_which", "observed_at"], "record", TEXTS, ["identifier", "person_name", "facility_name", *FIELDS]).drop("_who", "_which")
