"""Reports of any kind in, facts of one shape out; imports that go on past a file that fails; manuals that are taken in once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import collapse, note_key
from larder.operators import chunking, extraction, labs, orders, wounds
from larder.operators.temporal import first_wins
from larder.sources.documents import lines_of, report_kind
from larder.sources.staging import written

#: Windows over texts of no known kind, in tokens.
UNKNOWN_SIZE, UNKNOWN_OVERLAP = 600, 25


def _facts(rows: DataFrame, kind: Column, page: str | Column, record: Column, person: str | Column, body: list[str]) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("doc", as_column(page).cast("int").alias("page"), record.cast("int").alias("record"), kind.alias("fact_type"), as_column(person).cast("string").alias("person_identifier"), F.to_json(F.struct(*body)).alias("body"))


def _weights(pages: DataFrame) -> DataFrame:
    known = extraction.report_header(pages)
    rows = extraction.weight_rows(known, ["doc", "page", "person_identifier"])
    once = orders.weight_facts(rows, "doc", "page", "person_identifier")
    return _facts(once, F.lit("weight"), "page", F.col("place"), "person_identifier", ["measured_at", "weight_lb", "description"])


def _notes(pages: DataFrame) -> DataFrame:
    lines = lines_of(pages, ["doc", "page"]).withColumn("_at", F.struct("page", "line_number"))
    return _facts(extraction.notes_of(lines, "doc", "_at"), F.lit("note"), F.lit(1), F.col("note"), F.lit(None), ["note_date", "note_type", "author", "note_text"])


def _labs(pages: DataFrame) -> DataFrame:
    found = F.filter(F.array(labs.result_of_line(F.col("line"))), lambda r: r.isNotNull())
    rows = lines_of(pages, ["doc", "page"]).select("doc", "page", "line_number", F.inline(found))
    return _facts(rows, F.lit("lab"), "page", F.col("line_number"), F.lit(None), ["name", "result", "unit", "reference_range"])


def _orders(pages: DataFrame) -> DataFrame:
    return _facts(orders.report_orders(pages, relaxed=True), F.col("fact_type"), "page", F.col("record"), "identifier", ["summary", "category", "status", "revision_date"])


def _wounds(pages: DataFrame) -> DataFrame:
    rows = wounds.wound_report(pages.filter("page = 1"))
    numbered = rows.withColumn("_n", F.lit(0))
    return _facts(numbered, F.lit("wound"), F.lit(1), F.col("_n"), "identifier", ["wound_number", "observed_at", *wounds.FIELDS[1:], *wounds.TEXTS])


def _unknown(pages: DataFrame) -> DataFrame:
    parts = chunking.chunks(pages, ["doc", "page"], chunking.word_tokens(F.col("text")), UNKNOWN_SIZE, UNKNOWN_OVERLAP)
    return _facts(parts, F.lit("text"), "page", F.col("chunk_index"), F.lit(None), ["content"])


READERS = {"weights": _weights, "notes": _notes, "labs": _labs, "orders": _orders, "wounds": _wounds, "unknown": _unknown}


def read_reports(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, kind, page, record, fact_type, person_identifier, body): the facts of reports of all kinds, each read by the reader of its kind, its fields as JSON in `body`.

    The first page tells the kind. Pages are written once, in one folder for each kind,
    so each reader scans its own pages only; texts of no known kind come back in windows.
    """
    given = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"))
    first = given.groupBy("doc").agg(report_kind(F.min_by(F.coalesce("text", F.lit("")), "page")).alias("kind"))
    sorted_out = written(given.join(first, "doc"), "reports", by="kind")
    parts = [reader(sorted_out.filter(F.col("kind") == kind).drop("kind")).withColumn("kind", F.lit(kind)) for kind, reader in READERS.items()]
    return reduce(DataFrame.unionByName, parts).select("doc", "kind", "page", "record", "fact_type", "person_identifier", "body")


def import_notes(files: DataFrame, pages: DataFrame, stored: DataFrame, author: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes to insert, failures): the notes of progress-note reports that are not stored yet.

    `files` has doc and name, `pages` doc, page and text, `stored` note_key. A file that is
    no pdf, has no page or is no report of notes becomes a row of failures with its reason; the others go on.
    """
    first = pages.groupBy("doc").agg(F.min_by(F.coalesce("text", F.lit("")), "page").alias("_first"))
    kind = report_kind(F.col("_first"))
    reason = F.when(~F.coalesce(F.lower("name").endswith(".pdf"), F.lit(False)), "not a pdf").when(F.col("_first").isNull(), "no pages").when(kind != "notes", "not a progress-note report")
    judged = files.join(first, "doc", "left").withColumn("reason", reason).drop("_first")
    good = pages.join(judged.filter("reason IS NULL").select("doc"), "doc", "left_semi")
    person = extraction.report_header(good.filter("page = 1")).select("doc", "person_identifier")
    lines = lines_of(good, ["doc", "page"]).withColumn("_at", F.struct("page", "line_number"))
    notes = extraction.notes_of(lines, "doc", "_at").join(person, "doc", "left")
    key = note_key(F.col("person_identifier"), F.col("note_date"), F.col("note_type"), F.col("author"), F.col("note_text"))
    new = first_wins(notes.withColumn("note_key", key), ["note_key"], [F.col("doc"), F.col("note")]).join(stored.select("note_key").distinct(), "note_key", "left_anti")
    return new, judged.filter("reason IS NOT NULL")


def knowledge_chunks(manuals: DataFrame, lines: DataFrame, stored: DataFrame, overwrite: bool = False, size: int = 600, overlap: int = 100) -> DataFrame:
    """(doc, chunk_index, section_title, source_page_start, source_page_end, n_tokens, content) of manuals that are to be stored.

    `manuals` has doc, knowledge_type and file_hash, `stored` the types and hashes taken in
    before: those are left out, unless `overwrite`, and of equal new ones the first. That
    is settled before any text is read. Sections of one title are windows of their own, numbered
    through the document, the text before the reference sections only.
    """
    once = first_wins(manuals, ["knowledge_type", "file_hash"], [F.col("doc")])
    if not overwrite:
        once = once.join(stored.select("knowledge_type", "file_hash").distinct(), ["knowledge_type", "file_hash"], "left_anti")
    wanted = lines.join(once.select("doc"), "doc", "left_semi")
    segments = extraction.content_segments(wanted)
    from pyspark.sql import Window

    place = Window.partitionBy("doc").orderBy("page_number", "line_number")
    starts = F.coalesce((~F.col("section_title").eqNullSafe(F.lag("section_title").over(place))).cast("int"), F.lit(1))
    section = segments.withColumn("_new", starts).withColumn("_section", F.sum("_new").over(place))
    whole = section.groupBy("doc", "_section").agg(
        F.first("section_title").alias("section_title"), F.min("page_number").alias("source_page_start"), F.max("page_number").alias("source_page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_number", "line"))), lambda x: x["line"]), "\n").alias("_text"),
    )
    keys = ["doc", "_section", "section_title", "source_page_start", "source_page_end"]
    parts = chunking.chunks(whole, keys, chunking.word_tokens(F.col("_text")), size, overlap, F.col("section_title"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("_section", "chunk_index")) - 1
    return parts.withColumn("chunk_index", number).drop("_section").select("doc", "chunk_index", "section_title", "source_page_start", "source_page_end", "n_tokens", "content")


def food_source(data_type: Column) -> Column:
    """A food's source by the type that its service names; null for types that are none."""
    from larder import fixed_values as fixed

    kind = F.lower(collapse(data_type))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in fixed.FOOD_SOURCES.items() for x in pair)), kind)


def checkpoint_source(source: Column) -> Column:
    """Where a sync's progress is kept: all of one service share the place of its foundation foods."""
    return F.when(source.startswith("usda"), "usda_foundation").otherwise(source)
