"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that are turned into Python objects at a time, so that a batch of long texts stays small in memory; a longer row comes alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own if Spark runs in this process alone; on a cluster an error, as no folder of one machine is safe there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="larder-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and a lost executor costs nothing already staged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Kept(dict):
    """What `make` gave for each key, made when first asked for; begun anew when the keys have grown beyond a number of characters, so that neither many keys nor long ones fill a worker."""

    def __init__(self, make: Callable, limit: int = 8 << 20):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key):
        if self.size > self.limit:
            self.clear()
            self.size = 0
        value = self[key] = self.make(key)
        self.size += len(key) + 16
        return value


class Cover:
    """Which places of a text given spans take; asked and added to in time that the number of spans hardly changes."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((z for _, z in spans), max))

    def meets(self, start: int, end: int) -> bool:
        """Does any span overlap start to end?"""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        """One more span, which meets none of those here."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def public_tokenizer(name: str) -> str:
    """Where the vocabulary file `name` lies on this machine (the package is installed on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(column: str, divisor: int) -> F.Column:
    """crc32 of an integer id written as text, modulo `divisor`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of text at most, longer rows alone."""
    sizes = np.full(batch.num_rows, 64, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: T.StructType,
    start: Callable[[], Callable[..., Iterable[tuple]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Arrow batches in, Arrow batches out, about `limit` bytes of texts in memory at a time.

    `start()` runs once per task and gives a function that takes the lists of the
    chosen columns' values for some rows and returns the output rows as tuples.
    """
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = start()
        for batch in batches:
            for part in slices(batch, limit):
                rows = list(handle(*(part.column(i).to_pylist() for i in range(part.num_columns))))
                cells = zip(*rows) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cells, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, start: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose value in `column` passes; all columns go through as they are, a few rows in memory at a time."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([bool(keep(v)) for v in part.column(at).to_pylist()], pa.bool_()))

    return _by_place(df, run)


def replace_texts(df: DataFrame, column: str, start: Callable[[], Callable[[str], str]]) -> DataFrame:
    """The rows with new texts in `column`; nulls stay nulls and all other columns go through as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = start()
        for batch in batches:
            for part in slices(batch):
                texts = pa.array([None if v is None else new(v) for v in part.column(at).to_pylist()], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([texts if j == at else part.column(j) for j in range(part.num_columns)], schema=part.schema)

    return _by_place(df, run)


def _by_place(df: DataFrame, run: Callable) -> DataFrame:
    """mapInArrow over all columns, whatever their names: it resolves them by name, so they go under plain ones."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return simple[kind.simpleString()]


def id_type(df: DataFrame, id_col: str) -> str:
    """The type of the ids, as they are: results carry it on."""
    return df.schema[id_col].dataType.simpleString()


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(ddl)
