"""Patterns, terms and tables that must be as they are for right results, in their natural order."""

NUMBER = r"\d+(?:\.\d+)?"

#: Fixed values of order texts: what the words of an order mean.
ORDER_TERMS = {
    "parenteral": r"(?i)\b(?:TPN|PPN|total\s+parenteral\s+nutrition|peripheral\s+parenteral\s+nutrition|parenteral\s+nutrition)\b",
    "fluid": r"(?i)\b(?:fluid\s+restriction|restrict(?:ed)?\s+(?:oral\s+)?fluids?|fluids?\s+restricted|fluid\s+(?:goal|target)|encourage\s+(?:oral\s+)?fluids?|FR\s*[:\-]?\s*\d+(?:\.\d+)?)\b",
    "fluid_target": r"(?i)\b(?:fluid\s+(?:goal|target)|encourage\s+(?:oral\s+)?fluids?)\b",
    "enteral": r"(?i)\b(?:tube\s*feed|enteral|PEG|G[- ]?tube|NG|NJ|J[- ]?tube|FWF|flush)\b",
    "diet": r"(?i)\b(?:NPO|nothing\s+by\s+mouth|regular|CCD|cardiac|NAS|renal|puree(?:d)?|ground|mechanical\s+soft|soft\s*(?:&|and)\s*bite[- ]sized|thin\s+liquids?|nectar[- ]thick|honey[- ]thick|2\s*g(?:m)?\s+Na|low\s+fat|low\s+cholesterol)\b",
    "supplement": r"(?i)\b(?:ensure(?:\s+plus|\s+clear)?|glucerna|nepro|(?:sugar[- ]free\s+)?health\s*shake|magic\s+cup|prostat|resource\s+2\.0|super\s+cereal)\b",
    "ancillary": r"(?i)\b(?:document\s+TV\s+infused|elevate\s+head\s+of\s+bed|flush\s+(?:GT|G[- ]?tube).+?medications?)\b",
}
ROUTES = {"BY MOUTH": "PO", "ORALLY": "PO", "RECTALLY": "PR", "TOPICALLY": "TOPICAL", "SUBCUTANEOUSLY": "SQ", "SC": "SQ", "G TUBE": "G-TUBE", "GT": "G-TUBE", "J TUBE": "J-TUBE"}
FREQUENCIES = [
    (r"(?i)\b(?:BID|TWICE\s+(?:DAILY|A\s+DAY)|TWO\s+TIMES\s+(?:DAILY|A\s+DAY))\b", "BID"),
    (r"(?i)\b(?:TID|THREE\s+TIMES\s+(?:DAILY|A\s+DAY))\b", "TID"),
    (r"(?i)\b(?:QID|FOUR\s+TIMES\s+(?:DAILY|A\s+DAY))\b", "QID"),
    (r"(?i)\bQHS\b", "QHS"),
    (r"(?i)\bQAM\b", "QAM"),
    (r"(?i)\bQPM\b", "QPM"),
    (r"(?i)\b(?:QD|DAILY|ONCE\s+DAILY|ONCE\s+A\s+DAY|ONE\s+TIME\s+(?:DAILY|A\s+DAY)|EVERY\s+DAY(?:\s+SHIFT)?)\b", "DAILY"),
    (r"(?i)\b(?:WITH\s+MEALS|WITH\s+EACH\s+MEAL)\b", "WITH MEALS"),
    (r"(?i)\b(?:Q\s*SHIFT|EVERY\s+SHIFT)\b", "EVERY SHIFT"),
]
UNITS = {"ml": "mL", "meq": "mEq", "iu": "IU"}
TEXTURES = [("pureed", "pureed"), ("puree", "pureed"), ("ground", "ground"), ("mechanical soft", "mechanical_soft"), ("soft & bite-sized", "soft_and_bite_sized"), ("soft and bite-sized", "soft_and_bite_sized")]
LIQUIDS = [("thin", "thin"), ("nectar", "mildly_thick"), ("honey", "moderately_thick")]
DIETS = ["regular", "ccd", "cardiac", "renal", "nas"]
RESTRICTIONS = [("2 gm na", "2_g_sodium"), ("2 g na", "2_g_sodium"), ("low fat", "low_fat"), ("low cholesterol", "low_cholesterol")]

#: How orders write doses, rates, volumes and times. Groups hold the values.
PATTERNS = {
    "strength": rf"(?i)^(.+?)\s+({NUMBER})\s*(mcg|mg|g|ml|meq|units?|iu|%)(?=\s|$|\()",
    "given": rf"(?i)=\s*({NUMBER})\s*(mcg|mg|g|ml|meq|units?|iu|%)(?=\s|[.,;]|$)",
    "indication": r"(?i)\bfor\s+(.+?)(?=\s+(?:give|apply|insert|record)\b|$)",
    "route": r"(?i)\b(PO|PEG|GT|G[- ]?TUBE|NG|NJ|J[- ]?TUBE|IV|IM|SQ|SC|SL|PR|BY\s+MOUTH|ORALLY|RECTALLY|TOPICALLY|SUBCUTANEOUSLY)\b",
    "interval": r"(?i)\b(?:Q\s*(\d+(?:\.\d+)?)\s*H(?:RS?)?|EVERY\s+(\d+(?:\.\d+)?)\s*(?:H|HR|HOUR)S?)\b",
    "as_needed": r"(?i)\b(?:PRN|AS\s+NEEDED)\b",
    "rate": rf"(?i)(?:@|at)\s*({NUMBER})\s*ml\s*/?\s*(?:hr|hour)",
    "hours": rf"(?i)(?:x|for|over)\s*({NUMBER})\s*(?:hr|hour)s?",
    "bolus": rf"(?i)({NUMBER})\s*ml\s+(?:bolus\s+)?(\d+)\s*(?:times?|x)\s*(?:daily|per\s+day)",
    "flush": rf"(?i)({NUMBER})\s*ml\s+(?:free\s+water\s+|water\s+)?(?:flush(?:es)?|FWF)\s*(?:every|q)\s*({NUMBER})\s*(?:h|hr|hour)s?",
    "total": rf"(?i)\b(?:TV|total\s+volume)(?:\s+of)?\s*({NUMBER})\s*mls?\b",
    "schedule": r"(?i)(\bup\s+at\s+.+?\bdown\s+until\s+.+?(?=\s+providing\b|$))",
    "cyclic": r"(?i)\bcyclic\b|\bup\s+at\s+.+?\bdown\s+until\b",
    "density": r"\b([1-2](?:\.\d+)?)\b",
    "amount": rf"(?i)\b({NUMBER})\s*(fl\s*oz|oz|ounces?|ml|milliliters?|packets?|cups?)\b",
    "volume": rf"(?i)\b({NUMBER})\s*(ml|milliliters?|cc|l|liters?)\b",
}

FORMULA = rf"(?i)^(.+?)\s*(?:@|at)\s*{NUMBER}\s*ml"
FORMULA_PREFIXES = (r"(?i)^(?:enteral\s+feed(?:ing)?(?:\s+order)?|tube\s*feed(?:ing)?|TF)\s*[:\-]?\s*", r"(?i)^(?:(?:one|1)\s+time\s+a\s+day|once\s+daily|daily)\s+", r"(?i)^provide\s+")

#: Laboratory reports: statuses of results that count, flags, what reads as a value, names and results that are none.
LAB_STATUSES = ("Final", "Corrected", "Preliminary")
LAB_FLAGS = ("A", "AA", "H", "HH", "L", "LL")
LAB_VALUE = r"(?i)^(?:[<>]=?)?\d+(?:\.\d+)?$|^\*$|^Invalid$"
LAB_IGNORED_NAMES = ("UNABLE TO OBTAIN", "REDRAW NOTE", "REDRAW CLOTTED REASON", "RESCHEDULE SPECIFIED TEST", "EXPIRED CONTAINER REC'D")
LAB_IGNORED_RESULTS = ("*", "invalid", "pending", "see", "see attachment")
LAB_HEADER = ("result", "unit", "ref", "flag", "status")
LAB_NAME_GAP = 10.0

#: Manuals: headings that close the text, entries of contents, page numbers, running lines and other marks.
REFERENCE_HEADING = r"(?i)^(?:selected\s+)?references(?:\s*:\s*[\w /&-]+)?$|^bibliography$"
CONTENTS_HEADING = r"(?i)^(?:table\s+of\s+)?contents$|^(?:subject\s+)?index$"
METADATA_HEADING = r"(?i)^(?:reviewers?|contributors?|acknowledg(?:e)?ments?|publication information|about this manual|copyright)$"
DOCUMENT_TITLE = r"(?i)^(?:nutrition care manual|diet manual)$"
CONTENTS_ENTRY = r"^.{3,}?\s*\.{2,}\s*\d+\s*$"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s+of\s+\d+)?$"
SUBSECTION_HEADING = r"(?i)^(?:definition|purpose|indications?|contraindications?|description|nutritional adequacy|recommendations?|implementation|foods? (?:allowed|recommended|not allowed|to avoid)|monitoring)(?:\s*:)?$"
CLINICAL_TOPIC = r"(?i)\b(?:diet|nutrition|feeding|malnutrition|dysphagia|liquid|iddsi|hydration|weight|diabetes|diabetic|renal|cardiac|guidance|guidelines|therapy|care)\b"
INLINE_METADATA = (r"(?i)(?:copyright|©|all rights reserved)", r"(?i)^(?:reviewed|prepared|contributed)\s+by\b", r"(?i)^(?:publication|release|revision|revised|published|last updated)\s+date\b")
RUNNING_TERMS = ("manual", "academy of nutrition and dietetics", "all rights reserved")
SMALL_WORDS = ("and", "for", "of", "the", "to")

#: Facts: the relation of each type, types whose state or observation has a key, and payload fields that are no part of either.
FACT_RELATIONS = {
    "clinical_fact": "person_clinical_fact", "allergy": "person_allergy", "appetite": "person_appetite_observation", "diagnosis": "person_diagnosis", "dialysis": "person_dialysis", "diet": "person_diet", "edema": "person_edema",
    "enteral_feeding": "person_enteral_feeding", "food_preference": "person_food_preference", "fluid_plan": "person_fluid_plan", "gi_observation": "person_gi_observation", "intake": "person_meal_intake", "lab": "person_lab",
    "medication": "person_medication", "misc_order": "person_misc_order", "oral_feeding_status": "person_oral_feeding_status", "parenteral_nutrition": "person_parenteral_nutrition", "supplement": "person_supplement",
    "weight": "person_weight", "nutrition_goal": "person_nutrition_goal", "wound": "person_wound",
}
STATEFUL_FACTS = ("allergy", "diagnosis", "dialysis", "diet", "enteral_feeding", "fluid_plan", "food_preference", "medication", "misc_order", "oral_feeding_status", "parenteral_nutrition", "supplement", "nutrition_goal")
OBSERVATION_FACTS = ("appetite", "gi_observation")
SOURCE_FIELDS = ("action", "source_category", "source_revision_date")
STATE_KEY_EXCLUDES = ("action", "discontinued_at", "effective_at", "instructions", "observed_at", "source_category", "source_revision_date", "status")

#: Fixed values of note routing: terms of nutrition, note types that always or only with such a term go on, words of types, and what the text of a note says.
NUTRITION_TERMS = (
    "weight", "appetite", "intake", "po intake", "diet", "supplement", "ensure", "glucerna", "prostat", "tube feed", "feeding", "peg", "npo", "refused", "declined", "nausea", "vomiting",
    "diarrhea", "constipation", "edema", "dehydration", "fluid", "sodium", "potassium", "bun", "creatinine", "gfr", "albumin", "a1c", "glucose", "wound", "pressure ulcer", "dialysis", "hospitalized",
)
ALWAYS_SENT_NOTES = ("md progress note", "nurse practitioner progress note", "nurse practioner progress note", "np/pa progress note")
FILTERED_NOTES = ("order note", "orders - administration note")
ADMINISTRATION_NOTE = "orders - administration note"
NUTRITION_NOTE_WORDS = ("dietary", "dietitian", "dietician", "nutrition")
ASSESSMENT_NOTE_WORDS = ("dietary", "dietitian", "dietician", "nutrition", "skilled documentation", "skin", "wound")
CLINICAL_TERMS = (
    r"weight|appetite|meal|po\s+intake|intake|diet|supplement|ensure|glucerna|prostat|tube\s+feed|feeding|peg|npo|chew(?:ing)?|swallow(?:ing)?|dysphagia|nausea|vomiting|diarrhea|constipation|edema|dehydration|"
    r"fluid\s+restriction|blood\s+sugar|glucose|hypoglyc(?:emia|emic)|hyperglyc(?:emia|emic)|wound|pressure\s+(?:ulcer|injury)|dialysis|hospitali[sz]ed"
)
SOCIAL_TERMS = r"food\s+insecurity|food\s+access|meal\s+(?:access|delivery|support)|grocer(?:y|ies)|snap|kitchen|home\s+delivered\s+meal"
CRITICAL_EVENTS = (
    r"death|died|deceased|expired|passed\s+away|pronounced\s+(?:dead|deceased)|pronounced\s+by\s+(?:(?:an?|the)\s+)?(?:rn|nurse|physician|doctor|md)|post\s*-?\s*mort(?:al|em)\s+care|funeral\s+home"
)
NAMED_PATIENT = r"\b([A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){1,3})\s+is\s+a(?:\s*n)?\s+\d{1,3}\s*-\s*year-old\b"

#: Fixed values of order listings: the category, status and dates that close an order, the line that names its person, what is page furniture, dates and times of a report, and lines that are no facility's name.
ORDER_CATEGORY = (
    r"\s*(Dietary\s*-\s*Diet|Dietary\s*-\s*Supplements|Dietary\s*-|Enteral\s*-\s*Feed|Enteral Feed|Pharmacy|Other|Laboratory|Diagnostic)\s+(Active|Inactive|Discontinued|Completed)\s+(\d{2}/\d{2}/\d{4})"
    r"(?:\s+(\d{2}/\d{2}/\d{4}))?(?:\s+([YN]))?"
)
ORDER_PERSON = r"^([^()\n]+,\s*[^()\n]+?)\s*\(([A-Z]{0,4}\d+)\)\s*(.*)$"
ORDER_FURNITURE = ("Order Listing Report", "Facility #:", "Date:", "Time:", "Resident:", "Resident :", "Resident Order", "Page ")
ORDER_COLUMNS = "Name Summary Category Status Date Last Order Date Reorder"
ORDER_TITLE = "Order Listing Report"
ACTIVE_SNAPSHOT = r"(?i)\bOrder\s+Status\s*:\s*Active\b"
REPORT_DATE = r"(?i)\bDate\s*:\s*(\d{1,2}/\d{1,2}/\d{4}|[A-Z]{3,9}\s+\d{1,2},\s+\d{4})\b"
REPORT_TIME = r"(?i)\bTime\s*:\s*(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?)(?:\s*([A-Z]{2,5}))?\b"
NO_FACILITY = ("Facility", "Time:", "Date:", "Resident:", "User:", "Laboratory:", "Reviewed By", "Latest Version")

#: Fixed values of wound reports: the column that begins the table, the report's days, its facility, and the columns by the field that each fills.
WOUND_HEADER = "Patient Number"
WOUND_FACILITY = r"(?m)^Facility:\s*([^,\r\n]+)"
WOUND_COLUMNS = {
    "wound_number": "Wnd #", "wound_type": "Wound Type", "location": "Wound Location", "weeks_in_treatment": "Weeks In Treatment", "progress": "Wound Progress", "stage": "Stage", "size": "Size (LxWxD) cm",
    "assessment_note": "Assessment Note", "physician_orders": "Physician Orders", "physician_orders_notes": "Physician Orders Notes",
}
#: Fixed values of food sources by the type that a service names.
FOOD_SOURCES = {"branded": "usda_branded", "foundation": "usda_foundation", "survey (fndds)": "usda_fndds", "sr legacy": "usda_sr_legacy"}

#: The fields of feeding and parenteral orders with the pattern, its group and the field's type; what words stand for in parenteral orders, the first that occurs.
_LIPID = r"(?i)\b(?:lipid|IVFE|intralipid)"
ENTERAL_FIELDS = {
    "rate_ml_hr": (PATTERNS["rate"], 1, "double"),
    "hours_per_day": (PATTERNS["hours"], 1, "double"),
    "bolus_volume_ml": (PATTERNS["bolus"], 1, "double"),
    "boluses_per_day": (PATTERNS["bolus"], 2, "int"),
    "flush_ml": (PATTERNS["flush"], 1, "double"),
    "flush_frequency_hours": (PATTERNS["flush"], 2, "double"),
    "flush_instructions": (PATTERNS["flush"], 0, "string"),
    "feeding_schedule": (PATTERNS["schedule"], 1, "string"),
}
PARENTERAL_FIELDS = {
    "access_description": (r"(?i)\b(PICC|CVC|central venous catheter|central line|peripheral IV|peripheral line)\b", 1, "string"),
    "total_volume_ml": (rf"(?i)\b(?:total\s+volume|TV)\s*(?:[:=]|of)?\s*({NUMBER})\s*mL\b", 1, "double"),
    "rate_ml_hr": (rf"(?i)\b(?:TPN|PPN|parenteral\s+nutrition).*?(?:@|at)\s*({NUMBER})\s*mL\s*/?\s*(?:hr|hour)", 1, "double"),
    "hours_per_day": (rf"(?i)\b(?:over|for|x)\s*({NUMBER})\s*(?:hr|hour)s?\b", 1, "double"),
    "dextrose_g_per_l": (rf"(?i)\b(?:dextrose|dex)\s*({NUMBER})\s*g\s*/\s*l\b", 1, "double"),
    "amino_acid_g_per_l": (rf"(?i)\b(?:amino\s+acids?|AA)\s*({NUMBER})\s*g\s*/\s*l\b", 1, "double"),
    "documented_protein_g": (rf"(?i)\bprotein\s*({NUMBER})\s*g\b", 1, "double"),
    "documented_calories_kcal": (rf"(?i)\b({NUMBER})\s*kcal\b", 1, "double"),
    "lipid_concentration_percent": (rf"{_LIPID}\s*({NUMBER})\s*%", 1, "double"),
    "lipid_total_volume_ml": (rf"{_LIPID}.*?\b({NUMBER})\s*mL\b", 1, "double"),
    "lipid_rate_ml_hr": (rf"{_LIPID}.*?(?:@|at)\s*({NUMBER})\s*mL\s*/?\s*(?:hr|hour)", 1, "double"),
    "lipid_run_time_hours": (rf"{_LIPID}.*?(?:over|for|x)\s*({NUMBER})\s*(?:hr|hour)s?\b", 1, "double"),
}
PARENTERAL_CHOICES = {
    "access_route": [("ppn|peripheral parenteral nutrition", "peripheral"), ("tpn|total parenteral nutrition|central venous|central line|picc|cvc", "central")],
    "formula_type": [("concentrated", "concentrated"), ("standard", "standard")],
    "lipid_delivery": [("piggyback", "piggyback"), ("3-in-1|3 in 1|total nutrient admixture", "included")],
}
