"""Text normalisation, identities and note rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Other names of diet types, textures and restrictions.
DIET_ALIASES = {"reg": "regular", "general": "regular", "house": "regular", "consistent carbohydrate": "ccd", "consistent carb": "ccd", "diabetic": "ccd", "nothing by mouth": "npo", "renal diet": "renal", "heart healthy": "cardiac", "low sodium": "sodium_restricted"}
TEXTURE_ALIASES = {"mech soft": "mechanical_soft", "mechanical": "mechanical_soft", "pureed": "puree", "ground": "ground", "reg": "regular"}
MIME_TYPES = {"pdf": "application/pdf", "csv": "text/csv", "txt": "text/plain"}


def collapse(x: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def collapse_or_null(x: Column) -> Column:
    return F.nullif(collapse(x), F.lit(""))


def fold(x: Column) -> Column:
    """Collapsed, without case; German sharp s folds to ss."""
    return F.replace(F.lower(collapse(x)), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def compatible(x: pd.Series) -> pd.Series:
    """NFKC, collapsed, lower case: Spark has no such normal form of its own."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).lower())


def first_name(full: Column) -> Column:
    """`Last, First M` gives First; one word is a first name; else the first word."""
    name = collapse(full)
    return F.when(name.contains(","), F.get(F.split(collapse(F.get(F.split(name, ",", 2), 1)), " "), 0)).otherwise(F.get(F.split(name, " "), 0))


def last_name(full: Column) -> Column:
    name = collapse(full)
    words = F.split(name, " ")
    return F.when(name.contains(","), collapse(F.get(F.split(name, ",", 2), 0))).when(F.size(words) == 1, "").otherwise(F.element_at(words, -1))


def name_tokens(full: Column) -> Column:
    """The letters-only words of a name, comma form put in order."""
    ordered = F.when(full.contains(","), F.concat_ws(" ", F.get(F.split(full, ",", 2), 1), F.get(F.split(full, ",", 2), 0))).otherwise(full)
    return F.regexp_extract_all(F.lower(ordered), F.lit("[a-z]+"), 0)


def sex_code(x: Column) -> Column:
    """f or m; null for anything else."""
    word = fold(x)
    return F.when(word.isin("f", "female"), "f").when(word.isin("m", "male"), "m")


def alias_or_slug(x: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a phrase, or the phrase with underscores."""
    phrase = collapse(F.regexp_replace(fold(x), "[-_/]+", " "))
    out = F.replace(phrase, F.lit(" "), F.lit("_"))
    for known, name in aliases.items():
        out = F.when(phrase == known, name).otherwise(out)
    return out


def plain_number(x: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")


def slug(x: Column) -> Column:
    return F.replace(F.replace(fold(x), F.lit(","), F.lit("")), F.lit(" "), F.lit("-"))


def text_union(old: Column, new: Column) -> Column:
    """Equal texts stay one, a text that contains the other stands for both, others follow each other on a new line; case does not count."""
    low_old, low_new = F.lower(F.trim(old)), F.lower(F.trim(new))
    return (
        F.when(old.isNull() | (F.trim(old) == ""), new)
        .when(new.isNull() | (F.trim(new) == ""), old)
        .when(low_old.contains(low_new), old)
        .when(low_new.contains(low_old), new)
        .otherwise(F.concat(old, F.lit("\n"), new))
    )


def optional_value(x: Column) -> Column:
    """Blank, nan, none and null cells are nulls."""
    value = F.trim(x)
    return F.when(~F.lower(value).isin("", "nan", "none", "null"), value)


def whole_number(x: Column) -> Column:
    return optional_value(x).try_cast("long")


def display_name(brand: Column, density: Column) -> Column:
    return F.upper(F.format_string("%s %.1f", brand, density))


def clean_note(x: Column) -> Column:
    """Without page marks and a closing electronic signature."""
    body = F.regexp_replace(x, r"(?im)^\s*page \d+( of \d+)?\s*$", "")
    return F.trim(F.regexp_replace(body, r"(?is)\s*electronically signed by.*$", ""))


def tokens_estimate(x: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(x) / 3).cast("long")


def truncate_to_tokens(x: Column, tokens: int, mark: str = "\n[truncated]") -> Column:
    """At most so many tokens by the estimate, mark included, cut between code points: whole characters are taken while their bytes fit. A budget below the mark's own bytes leaves the mark alone."""
    if tokens <= 0:
        raise ValueError("the number of tokens must be greater than 0")
    room = tokens * 3 - len(mark.encode())
    return F.when(F.octet_length(x) <= tokens * 3, x).otherwise(F.concat(_fit(x, max(room, 0)), F.lit(mark)))


def _fit(x: Column, room: int) -> Column:
    # a character has one to four bytes: the longest prefix is found by counting bytes of characters
    chars = F.filter(F.split(F.substring(x, 1, room), ""), lambda c: c != "")
    kept = F.aggregate(chars, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, c: F.struct(
        F.when(a["open"] & (a["used"] + F.octet_length(c) <= room), a["used"] + F.octet_length(c)).otherwise(a["used"]).alias("used"),
        F.when(a["open"] & (a["used"] + F.octet_length(c) <= room), a["n"] + 1).otherwise(a["n"]).alias("n"),
        (a["open"] & (a["used"] + F.octet_length(c) <= room)).alias("open"),
    ), lambda a: a["n"])
    return F.substring(x, F.lit(1), kept)


def suffix(path: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), F.lit("")))


def mime_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in MIME_TYPES.items():
        out = F.when(suffix(path) == ext, kind).otherwise(out)
    return out


def first_of(text: Column, terms: list[str]) -> Column:
    """The term that stands first in the text; of terms at one place the first listed; null without any."""
    found = F.array(*(F.struct(F.nullif(F.instr(F.lower(text), t), F.lit(0)).alias("at"), F.lit(k).alias("k"), F.lit(t).alias("term")) for k, t in enumerate(terms)))
    return F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))["term"]


def identity_hash(*parts: Column) -> Column:
    """SHA-256 of the folded parts; a null part is not an empty one."""
    return F.sha2(F.to_json(F.array(*(fold(p) for p in parts))), 256)


def content_hash(x: Column) -> Column:
    return F.sha2(collapse(x), 256)


def note_key(person: Column, day: Column, kind: Column, author: Column, body: Column) -> Column:
    """SHA-256 of who, when and the compatible forms of the texts, as a list, so that a null is no empty text and parts do not run together."""
    parts = F.array(person.cast("string"), F.date_format(day, "yyyy-MM-dd"), *(compatible(x) for x in (kind, author, body)))
    return F.sha2(F.to_json(parts), 256)
