"""Order listing reports: their mode, time and facility, their orders with and without persons, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import fixed_values as fixed
from larder.functions import dates
from larder.functions.text import collapse, fold
from larder.operators.extraction import found, order_facts, order_status
from larder.operators.relational import required
from larder.operators.temporal import first_wins
from larder.sources.staging import written

DAY_FORMATS = ("M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def occurrences(text: Column, pattern: str) -> Column:
    """Every match of a pattern as struct(before, hit, start, end): the text since the match before it, and its place, counted from 0.

    The matches and the texts between them are two arrays of one scan each; places are
    the running sum of their lengths, so no row is exploded.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    item = "struct<before:string,hit:string,start:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("found"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.struct(pair["gap"].alias("before"), pair["hit"].alias("hit"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def report_mode(first_page: Column) -> Column:
    """active_snapshot where the report says that it lists active orders, else incremental."""
    return F.when(F.coalesce(first_page.rlike(fixed.ACTIVE_SNAPSHOT), F.lit(False)), "active_snapshot").otherwise("incremental")


def report_time(first_page: Column) -> Column:
    """When the report was made, in UTC: its date at its time in its zone, midnight without a time; null where the date, the time or the zone cannot be read."""
    day = dates.parse_date(collapse(found(first_page, fixed.REPORT_DATE)), DAY_FORMATS)
    clock = collapse(F.upper(found(first_page, fixed.REPORT_TIME)))
    seconds = F.when(clock.isNull(), 0).otherwise(dates.parse_time(clock, ("h:mm a", "h:mm:ss a", "H:mm", "H:mm:ss")))
    zone = F.upper(found(first_page, fixed.REPORT_TIME, 2))
    local = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    return F.when(zone.isNull() | zone.isin("UTC", "GMT") | zone.isin("AM", "PM"), local).otherwise(dates.zoned(local, zone))


def facility_name(text: Column, *titles: str) -> Column:
    """The line after a report's title, or the one before it, whichever is not itself page furniture; of several titles the first that has one."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).isin(*(t.lower() for t in titles)), i)), lambda i: i.isNotNull())
    furniture = lambda x: x.rlike("^(?:" + "|".join(fixed.NO_FACILITY) + ")")
    beside = F.flatten(F.transform(at, lambda i: F.array(F.get(lines, i + 1), F.when(i > 0, F.get(lines, i - 1)))))
    return F.get(F.filter(beside, lambda x: x.isNotNull() & ~furniture(x)), 0)


def order_parts(text: Column) -> Column:
    """struct(summary, category, status, revision_date) of an order's text; null without a category. What stands after the category belongs to the summary, but for the rest of a broken `Dietary - Supplements`."""
    pattern = fixed.ORDER_CATEGORY
    place = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_extract(text, pattern, 0)
    before, after = F.trim(F.substring(text, F.lit(1), place - 1)), F.trim(F.substring(text, place + F.length(hit), F.length(text)))
    category = collapse(F.regexp_extract(text, pattern, 1))
    broken = (category == "Dietary -") & after.endswith("Supplements")
    rest = F.when(broken, F.trim(F.regexp_replace(after, "Supplements$", ""))).otherwise(after)
    return F.when(place > 0, F.struct(
        F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(rest, F.lit(""))).alias("summary"), F.when(broken, "Dietary - Supplements").otherwise(category).alias("category"),
        F.regexp_extract(text, pattern, 2).alias("status"), dates.parse_date(F.regexp_extract(text, pattern, 3), DAY_FORMATS).alias("revision_date"),
    ))


def person_orders(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, record, person_name, identifier, parts): a line that names a person starts an order, further lines belong to it up to the page's end; texts without a category are no orders."""
    lines = pages.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("_at", "_raw")).withColumn("_line", F.trim("_raw"))
    furniture = F.col("_line").rlike("^(?:" + "|".join(fixed.ORDER_FURNITURE) + ")") | (F.col("_line") == fixed.ORDER_COLUMNS) | (F.col("_line") == "")
    person = F.col("_line").rlike(fixed.ORDER_PERSON)
    record = F.sum(person.cast("int")).over(Window.partitionBy(*keys).orderBy("_at"))
    body = lines.filter(~furniture).withColumn("record", record).filter("record > 0")
    part = lambda k: F.trim(F.regexp_extract("_line", fixed.ORDER_PERSON, k))
    own = F.when(person, part(3)).otherwise(F.col("_line"))
    whole = body.groupBy(*keys, "record").agg(
        F.min_by(part(1), "_at").alias("person_name"), F.min_by(part(2), "_at").alias("identifier"), F.array_sort(F.collect_list(F.struct("_at", own.alias("line")))).alias("_lines")
    )
    parts = order_parts(F.array_join(F.col("_lines.line"), " "))
    # a list of one or none, exploded: an order's text is read once, not again for the test
    return whole.select(*keys, "record", "person_name", "identifier", F.explode(F.filter(F.array(parts), lambda x: x.isNotNull())).alias("parts"))


def anonymous_orders(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The same for pages whose person column was taken out: an order is the text between two categories, without the table's header (all up to its last `Reorder`)."""
    each = pages.select(*keys, F.posexplode(occurrences(F.col(text), fixed.ORDER_CATEGORY)).alias("record", "m"))
    lines = F.filter(F.transform(F.split("m.before", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    header = F.coalesce(F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x) == "reorder", i)), lambda i: i.isNotNull())), F.lit(-1))
    summary = F.trim(F.array_join(F.filter(lines, lambda x, i: i > header), " "))
    part = lambda k: F.regexp_extract("m.hit", fixed.ORDER_CATEGORY, k)
    parts = F.struct(summary.alias("summary"), collapse(part(1)).alias("category"), part(2).alias("status"), dates.parse_date(part(3), DAY_FORMATS).alias("revision_date"))
    nobody = F.lit(None).cast("string")
    return each.select(*keys, (F.col("record") + 1).cast("long").alias("record"), nobody.alias("person_name"), nobody.alias("identifier"), parts.alias("parts")).filter("parts.summary <> ''")


def report_orders(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", relaxed: bool = False) -> DataFrame:
    """The facts of order listings, one row each: (doc, page, identifier, person_name, facility_name, report_mode, report_at, summary, category, status, revision_date, fact_type).

    An active snapshot without a readable date fails the job. With `relaxed`, pages on
    which no order has a person are read without persons; else such orders are left out. An order that comes again in
    its report, for the same person with the same type, words and revision, is taken once, from the first page.
    """
    first = pages.groupBy(doc).agg(F.min_by(text, page).alias("_first"))
    facts_of = first.select(doc, report_mode(F.col("_first")).alias("report_mode"), report_time(F.col("_first")).alias("report_at"), facility_name(F.col("_first"), fixed.ORDER_TITLE).alias("facility_name"))
    dated = required((F.col("report_mode") != "active_snapshot") | F.col("report_at").isNotNull(), "an active order snapshot needs a report date")
    found_orders = person_orders(pages, [doc, page], text)
    if relaxed:
        # read once: which pages have persons is asked of the same rows
        found_orders = written(found_orders, "orders")
        bare = pages.join(found_orders.select(doc, page).distinct(), [doc, page], "left_anti")
        found_orders = found_orders.unionByName(anonymous_orders(bare, [doc, page], text))
    rows = order_facts(found_orders.select(doc, page, "record", "person_name", "identifier", "parts.*")).withColumn("status", order_status(F.col("status")))
    same = {"_who": F.lower(F.coalesce("identifier", F.lit(""))), "_what": fold(F.col("summary"))}
    once = first_wins(rows.withColumns(same), [doc, "_who", "fact_type", "_what", "revision_date"], [F.col(page), F.col("record")]).drop(*same)
    return once.join(facts_of.filter(dated), doc)


def weight_facts(rows: DataFrame, doc: str, page: str, person: str = "person_id", place: str = "place") -> DataFrame:
    """Rows of weight reports once for each document, person and time, the first in reading order; rows of nobody count as one person's."""
    return first_wins(rows, [doc, person, "measured_at"], [F.col(page), F.col(place)])


def with_identity(rows: DataFrame, person: str, relaxed: bool = False) -> DataFrame:
    """Strict reading fails where a row's person is unknown; relaxed reading lets it pass."""
    return rows if relaxed else rows.filter(required(F.col(person).isNotNull(), "a report's row has no person"))
