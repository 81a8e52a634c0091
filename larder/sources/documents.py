"""Documents as pages, lines and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_UNKNOWN_BYTES = 10 * 1024 * 1024
#: What a report's first page says.
REPORT_MARKERS = {"weights": ["weights and vitals summary"], "notes": ["progress notes *new*"], "labs": ["lab results", "laboratory results"], "orders": ["order listing report"], "wounds": ["wound type tabular report"]}


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "txt", "csv")) -> DataFrame:
    """Files of a folder in order of their paths, with length, checksum and suffix."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return rows.withColumn("suffix", ext).filter(F.col("suffix").isin(*suffixes)).withColumn("checksum", F.concat(F.lit("sha256:"), F.sha2("content", 256))).orderBy("path")


def guarded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that an unknown format may be read from, the others with a reason)."""
    reason = F.when(F.col("suffix") != "pdf", "not a pdf").when(F.col("length") > MAX_UNKNOWN_BYTES, "too large")
    marked = rows.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def decoded(content: Column) -> Column:
    """UTF-8 text without a byte order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", "")


def document_text(pages: DataFrame, doc: str = "doc", number: str = "page_number", text: str = "text") -> DataFrame:
    """The non-empty pages of a document, in order, under each other."""
    ordered = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(number, text))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "\n").alias("text"))


def lines_of(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each line of each page, with its place."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_number", "line"))


def has_marker(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(m.lower()) for m in markers))


def dispatch(readers: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first reader whose test holds."""
    out = F.lit(otherwise)
    for name, test in reversed(readers):
        out = F.when(test, name).otherwise(out)
    return out


def report_kind(first_page: Column) -> Column:
    return dispatch([(name, F.coalesce(has_marker(first_page, m), F.lit(False))) for name, m in REPORT_MARKERS.items()], "unknown")


#: A cell: quoted, with doubled quotes and line breaks inside, or plain up to the next comma or line break. A quote that is never closed takes all the rest but a last line break. Every part is possessive, so that no cell is tried twice and none is too long.
_VALUE = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\n]*+|\z)|(?!")[^,\n]*+)'
#: A cell with what ends it, and a record: cells up to a line break outside quotes.
_CELL = rf"{_VALUE}(?:,|\n|\z)"
_RECORD = rf"(?:{_VALUE},)*+{_VALUE}(?:\n|\z)"


def _cell(token: Column) -> Column:
    """The value of a cell that comes with what ends it."""
    raw = F.when(token.endswith(",") | token.endswith("\n"), F.substring(token, F.lit(1), F.char_length(token) - 1)).otherwise(token)
    quoted = F.concat(F.replace(F.regexp_extract(raw, r'\A"([^"]*+(?:""[^"]*+)*+)"?', 1), F.lit('""'), F.lit('"')), F.regexp_extract(raw, r'\A"[^"]*+(?:""[^"]*+)*+"([\s\S]*)\z', 1))
    return F.when(raw.startswith('"'), quoted).otherwise(raw)


def csv_parsed(text: Column) -> Column:
    """The records of a CSV text as an array of (record, cells), in order; blank lines are none, but count.

    One pattern cuts the text into records and one a record into cells, all within the
    text's own row: nothing is parsed line by line, and no cell is shuffled.
    """
    unix = F.concat(F.regexp_replace(text, "\r\n?", "\n"), F.when(text.endswith("\n") | text.endswith("\r"), "").otherwise("\n"))
    tokens = lambda x, pattern: F.filter(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda t: t != "")
    records = F.transform(tokens(unix, _RECORD), lambda r, i: F.struct(i.alias("record"), F.transform(tokens(r, _CELL), _cell).alias("cells")))
    return F.filter(records, lambda r: (F.size(r["cells"]) > 1) | (F.get(r["cells"], F.lit(0)) != ""))


def csv_records(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, record, cells): the records of CSV texts, also where quoted cells hold line breaks, commas or doubled quotes; blank lines are none."""
    return texts.select(doc, F.inline(csv_parsed(F.col(text))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after_header(texts: DataFrame, doc: str, text: str, header: str, headings: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(doc, columns to keep, record, cells): the records of CSV texts after the first whose first cell is `header`; with `headings` the cells under these in that record, null where there are none; of equal headings the last counts."""

    def place(heads: Column, heading: Column) -> Column:
        return F.nullif(F.size(heads) - F.array_position(F.reverse(heads), heading).cast("int"), F.size(heads))

    def below(rows: Column, first: Column) -> Column:
        body = F.slice(rows, F.when(first > 0, first).otherwise(F.size(rows)) + 1, F.size(rows))
        if headings is None:
            return body
        heads = F.transform(F.get(rows, first - 1)["cells"], lambda c: F.trim(c))
        places = _let(heads, lambda h: F.transform(F.array(*map(F.lit, headings)), lambda x: place(h, x)))
        return _let(places, lambda at: F.transform(body, lambda r: F.struct(r["record"].alias("record"), F.transform(at, lambda k: F.get(r["cells"], k)).alias("cells"))))

    at_header = lambda rows: F.array_position(F.transform(rows, lambda r: F.trim(F.get(r["cells"], F.lit(0))) == header), True).cast("int")
    found = _let(csv_parsed(F.col(text)), lambda rows: _let(at_header(rows), lambda first: below(rows, first)))
    return texts.filter(F.col(doc).isNotNull()).select(doc, *(keep or ()), F.inline(found))


def csv_report(texts: DataFrame, doc: str, text: str, header: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV report after the record whose first cell is `header`; short rows are padded with empty cells."""
    body = after_header(texts, doc, text, header)
    return body.select(doc, F.col("record").alias("line_number"), *(F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit(""))).alias(c) for k, c in enumerate(columns)))


def unique_names(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Names made distinct without case: stem-2.ext for the second of a name, and so on."""
    place = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("place", place).withColumn("stored", F.when(F.col("place") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("place").cast("string"), ext))).drop("place")
