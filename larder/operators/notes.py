"""Progress notes: which go on to extraction or assessment, whose they are, and what has become of each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder import fixed_values as fixed
from larder.functions.text import fold, name_tokens
from larder.operators.temporal import first_wins

#: Statuses with which a note is done.
DONE = ("extracted", "skipped")


def _says(text: Column, terms: str) -> Column:
    """Does a term occur as whole words, in any case?"""
    return F.coalesce(text.rlike(rf"(?iU)(?<!\w)(?:{terms})(?!\w)"), F.lit(False))


def _nutrition_terms() -> str:
    return "(?:" + "|".join(t.replace(" ", r"\s+") for t in fixed.NUTRITION_TERMS) + ")(?:s|es)?"


def kind_of(note_type: Column) -> Column:
    return F.coalesce(fold(note_type), F.lit(""))


def type_says(note_type: Column, words: Iterable[str]) -> Column:
    """Does the type hold one of the words, anywhere?"""
    kind = kind_of(note_type)
    out = F.lit(False)
    for w in words:
        out = out | kind.contains(w)
    return out


def is_nutrition_note(note_type: Column) -> Column:
    return type_says(note_type, fixed.NUTRITION_NOTE_WORDS)


def is_critical(text: Column) -> Column:
    return _says(text, fixed.CRITICAL_EVENTS)


def action(note_type: Column, text: Column) -> Column:
    """send or filter: nursing and order notes go on only if they name a term of nutrition or a critical event; other types always do."""
    kind = kind_of(note_type)
    guarded = (kind.isin(*fixed.FILTERED_NOTES) | kind.startswith("nursing")) & ~kind.isin(*fixed.ALWAYS_SENT_NOTES)
    return F.when(guarded & ~_says(text, _nutrition_terms()) & ~is_critical(text), "filter").otherwise("send")


def names_another(person_name: Column, text: Column) -> Column:
    """Does the text introduce a patient whose first and last names are not those of the header? A name of one word settles nothing."""
    named, source = name_tokens(F.regexp_extract(F.coalesce(text, F.lit("")), fixed.NAMED_PATIENT, 1)), name_tokens(person_name)
    ends = lambda tokens: F.struct(F.get(tokens, 0), F.element_at(tokens, -1))
    both = (F.size(named) >= 2) & (F.size(source) >= 2)
    return F.coalesce(F.when(both, ends(named) != ends(source)), F.lit(False))


def assessment_choice(note_type: Column, text: Column, person_name: Column) -> Column:
    """Why a note is chosen for an assessment (critical, type, social, clinical) or not (administration, other_person, unrelated). A critical event goes before all but another person's name; social notes count for access to food only."""
    kind = kind_of(note_type)
    return (
        F.when(kind == fixed.ADMINISTRATION_NOTE, "administration")
        .when(names_another(person_name, text), "other_person")
        .when(is_critical(text), "critical")
        .when(kind.isin(*fixed.ALWAYS_SENT_NOTES) | type_says(note_type, fixed.ASSESSMENT_NOTE_WORDS), "type")
        .when(kind.startswith("social"), F.when(_says(text, fixed.SOCIAL_TERMS), "social").otherwise("unrelated"))
        .when(_says(text, fixed.CLINICAL_TERMS), "clinical")
        .otherwise("unrelated")
    )


def is_chosen(choice: Column) -> Column:
    return choice.isin("critical", "type", "social", "clinical")


def header_identities(notes: DataFrame, order: list[Column], identifier: str = "identifier", name: str = "person_name") -> DataFrame:
    """One note for each identifier and name of the headers, the first; notes without either have no identity. Filtered notes count: their persons are resolved all the same."""
    known = (F.coalesce(F.col(identifier), F.lit("")) != "") | (F.coalesce(F.col(name), F.lit("")) != "")
    return first_wins(notes.filter(known), [identifier, name], order)


def steps(notes: DataFrame, stored: DataFrame, order: list[Column], key: str = "note_key", note_type: str = "note_type", text: str = "note_text", date: str = "note_date") -> DataFrame:
    """Each note with what to do next, `step`, and the status it has before that.

    filtered: its type and text are of no use; repeated: an earlier note has its key;
    done: extracted or skipped before; undated: new, but without a date; extract: new, or
    failed or left pending before. `stored` has key and status, one row for each key.
    """
    sent = action(F.col(note_type), F.col(text)) == "send"
    place = F.row_number().over(Window.partitionBy(key, "_sent").orderBy(*order))
    marked = notes.withColumn("_sent", sent).withColumn("_place", place).join(stored.select(key, F.col("status").alias("known_status")), key, "left")
    step = (
        F.when(~F.col("_sent"), "filtered")
        .when(F.col("_place") > 1, "repeated")
        .when(F.col("known_status").isin(*DONE), "done")
        .when(F.col("known_status").isNull() & F.col(date).isNull(), "undated")
        .otherwise("extract")
    )
    return marked.withColumn("step", step).drop("_sent", "_place")


def settle(stored: DataFrame, work: DataFrame, outcomes: DataFrame, key: str = "note_key") -> DataFrame:
    """The statuses (key, status, attempts) after a round of extraction: `work` are the rows of `steps` to extract, `outcomes` has key and ok; work without an outcome stays pending, one success is enough."""
    told = outcomes.groupBy(key).agg(F.max("ok").alias("ok"))
    tried = work.filter("step = 'extract'").select(key).join(told, key, "left").select(key, F.lit(1).alias("_tried"), "ok")
    status = F.when(F.col("ok"), "extracted").when(~F.col("ok"), "failed").when(F.col("_tried").isNotNull(), "pending").otherwise(F.col("status"))
    both = stored.select(key, "status", "attempts").join(tried, key, "full")
    return both.select(key, status.alias("status"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("_tried", F.lit(0))).alias("attempts"))


def identity_stream(notes: DataFrame, identifier: str = "identifier", name: str = "person_name") -> DataFrame:
    """The same identities over a stream, each once however many batches it comes in; state is one pair of strings an identity."""
    return notes.select(identifier, name).filter((F.coalesce(F.col(identifier), F.lit("")) != "") | (F.coalesce(F.col(name), F.lit("")) != "")).dropDuplicates([identifier, name])


WORK = "note_key string, note string, attempt int"
_STATE = "status string, attempts int"


def work_stream(events: DataFrame) -> DataFrame:
    """Notes to extract, from a stream of (note_key, note, ok): a note that arrived has ok null, an outcome of earlier work has it.

    The state of a key is its status and attempts. A new note is given out once; while
    its outcome is open it is pending and not given out again; after a failure it is when
    it arrives again, after a success never. Outcomes of a batch count before its notes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("new", 0)
        note = None
        for frame in frames:
            told = frame["ok"].dropna()
            if len(told) and status not in DONE:
                status = "extracted" if told.astype(bool).any() else "failed"
            arrived = frame.loc[frame["ok"].isna(), "note"]
            if note is None and len(arrived):
                note = arrived.iloc[0]
        give = note is not None and status in ("new", "failed")
        if give:
            status, attempts = "pending", attempts + 1
        state.update((status, attempts))
        yield pd.DataFrame({"note_key": [key[0]] * give, "note": [note] * give, "attempt": [attempts] * give})

    return events.select("note_key", "note", "ok").groupBy("note_key").applyInPandasWithState(step, WORK, _STATE, "append", GroupStateTimeout.NoTimeout)
