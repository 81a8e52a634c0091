"""Schemas of the relations that operators read and write, and their row rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = frozenset({"active", "inactive", "historical", "unknown"})
_CLINICAL = "id long, person_id long, created_at timestamp, extracted_fact_id long"
_STATEFUL = f"{_CLINICAL}, status string, observed_at timestamp, effective_at timestamp, discontinued_at timestamp, state_key string"

SCHEMAS = {
    "person": "id long, first_name string, last_name string, date_of_birth date, identifier string, facility_id long, sex string, height_in double",
    "facility": "id long, facility_identifier string, name string, normalized_name string",
    "document": "id long, checksum string, filename string, mime_type string, source_type string, uri string, facility_id long",
    "document_source": "id long, document_id long, source_page int, evidence_hash string",
    "extracted_fact": "id long, source_id long, fact_key string, type string, payload string, confidence double, extraction_method string, observed_at timestamp, effective_at timestamp",
    "person_progress_note": "id long, person_id long, note_key string, note_date timestamp, note_type string, author string, note_text string, extraction_status string",
    "person_assessment": "id long, person_id long, content string, content_hash string, status string, finalized_at timestamp, source_progress_note_id long",
    "person_weight": f"{_CLINICAL}, measured_at timestamp, weight_lb double, description string",
    "person_lab": f"{_CLINICAL}, name string, observed_at timestamp, result string, unit string, reference_range string, flag string",
    "person_edema": f"{_CLINICAL}, location string, observed_at timestamp, severity string",
    "person_wound": f"{_CLINICAL}, wound_number string, observed_at timestamp, wound_type string, location string, stage string, note string, orders string",
    "person_meal_intake": f"{_CLINICAL}, observed_at timestamp, meal string, percent double",
    "person_allergy": f"{_STATEFUL}, allergen string, no_known_allergies boolean",
    "person_diagnosis": f"{_STATEFUL}, diagnosis string, code string",
    "person_diet": f"{_STATEFUL}, diet_type string, texture string, liquid_consistency string, restrictions array<string>",
    "person_enteral_feeding": f"{_STATEFUL}, formula string, route string, feeding_method string, rate_ml_hr double, hours_per_day double, bolus_volume_ml double, boluses_per_day int, flush_ml double, flush_frequency_hours double",
    "person_parenteral_nutrition": f"{_STATEFUL}, access_route string, total_volume_ml double, rate_ml_hr double, hours_per_day double, dextrose_g_per_l double, amino_acid_g_per_l double, lipid_delivery string, lipid_concentration_percent double, lipid_total_volume_ml double",
    "person_fluid_plan": f"{_STATEFUL}, target_ml_day double, restriction_ml_day double",
    "person_supplement": f"{_STATEFUL}, product_name string, amount double, unit string, frequency string",
    "person_medication": f"{_STATEFUL}, name string, dose double, dose_unit string, route string, frequency string, indication string",
    "person_nutrition_goal": f"{_STATEFUL}, goal string, start_date date",
    "food": "id long, source_type string, source_id string, name string, brand string, category_id long, package_type string, serving_size double, serving_unit string",
    "nutrient": "id long, number string, name string, unit_name string",
    "food_nutrient": "food_id long, nutrient_id long, amount double",
    "food_sync_state": "source string, last_page int",
    "knowledge": "id long, knowledge_type string, file_hash string, title string",
    "knowledge_chunk": "id long, knowledge_id long, chunk_index int, content string, section_title string, source_page_start int, source_page_end int",
    "api_key": "id long, name string, key_hash string, active boolean, expires_at timestamp, permissions array<string>",
}

#: The columns by which rows of a relation are the same record.
NATURAL_KEYS = {
    "person_weight": ["person_id", "measured_at"],
    "person_lab": ["person_id", "name", "observed_at"],
    "person_edema": ["person_id", "location", "observed_at"],
    "person_wound": ["person_id", "wound_number", "observed_at"],
    "person_diet": ["person_id"],
    "document": ["checksum"],
    "document_source": ["document_id", "source_page", "evidence_hash"],
    "extracted_fact": ["source_id", "fact_key"],
    "person_progress_note": ["note_key"],
    "person_assessment": ["person_id", "content_hash"],
    "food": ["source_type", "source_id"],
    "food_sync_state": ["source"],
    "knowledge": ["knowledge_type", "file_hash"],
    "knowledge_chunk": ["knowledge_id", "chunk_index"],
    **{f"person_{t}": ["person_id", "state_key"] for t in ("allergy", "diagnosis", "enteral_feeding", "parenteral_nutrition", "fluid_plan", "supplement", "medication", "nutrition_goal")},
}

#: How a record that comes again is merged: columns overwritten, columns that only a known value overwrites, and whether an older one is dropped.
MERGE_POLICIES = {
    "person_weight": {"overwrite": ["weight_lb"], "fill": ["description"], "guard": False},
    "person_lab": {"overwrite": ["result"], "fill": ["unit", "reference_range", "flag"], "guard": False},
    "person_edema": {"overwrite": [], "fill": ["severity"], "guard": False},
    "person_diet": {"overwrite": ["diet_type", "texture", "liquid_consistency", "restrictions", "status"], "fill": [], "guard": True},
    "stateful": {"overwrite": [], "fill": ["status", "effective_at", "discontinued_at"], "guard": True},
}


def rules(relation: str) -> dict[str, Column]:
    """Row rules by name, for larder.operators.relational.split_valid."""
    out: dict[str, Column] = {}
    schema = SCHEMAS[relation]
    if "status string, observed_at" in schema:
        out["status"] = F.col("status").isin(*sorted(STATUSES))
    if relation == "person_allergy":
        out["one_of"] = F.col("allergen").isNotNull() != F.coalesce("no_known_allergies", F.lit(False))
    if relation == "knowledge_chunk":
        out["pages"] = (F.col("source_page_start") >= 1) & (F.col("source_page_end") >= F.col("source_page_start"))
    if relation == "extracted_fact":
        out["confidence"] = F.col("confidence").between(0, 1)
    if relation == "person_weight":
        out["positive"] = F.col("weight_lb") > 0
    return out
