"""Overlapping token windows over texts."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.relational import required

#: Characters of windows that a Python worker holds before it hands them on.
BODY_CHARS = 1 << 20


def word_tokens(text: Column) -> Column:
    """The default tokens: words between white space. Any column of token arrays may stand in."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Where windows begin: every size - overlap tokens. A window that ends exactly at the last token is the last one; else windows begin as long as there are tokens."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window has tokens, and its overlap is smaller than it")
    step, last = size - overlap, length - size
    upto = F.when((last >= 0) & (last % step == 0), last).otherwise(length - 1)
    return F.when(length > 0, F.sequence(F.lit(0), F.greatest(upto, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunks(df: DataFrame, keys: list[str], tokens: Column, size: int = 600, overlap: int = 100, title: Column | None = None) -> DataFrame:
    """One row for each window: keys, chunk_index, n_tokens and content, with the title before it unless it begins with it, without case."""
    rows = df.select(*keys, tokens.alias("_t"), (F.lit(None).cast("string") if title is None else title).alias("_title"))
    rows = rows.select(*keys, "_t", "_title", F.posexplode(window_starts(F.size("_t"), size, overlap)).alias("chunk_index", "_at"))
    part = F.slice("_t", F.col("_at") + 1, F.lit(size))
    body = F.array_join(part, " ")
    return rows.select(*keys, "chunk_index", F.size(part).alias("n_tokens"), titled(F.col("_title"), body).alias("content"))


def titled(title: Column, body: Column) -> Column:
    """The title before a chunk that does not begin with it, without case."""
    return F.when(title.isNull() | F.startswith(F.lower(body), F.lower(title)), body).otherwise(F.concat(title, F.lit("\n\n"), body))


@lru_cache(maxsize=2)
def _vocabulary(ranks: str, pattern: str):
    """The library's encoding by a local rank file, once for each Python worker."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=known, special_tokens={})


def vocabulary_windows(text: Column, ranks: str, pattern: str, size: int = 600, overlap: int = 100) -> Column:
    """array<struct<n_tokens, content>>: windows over the tokens of a vocabulary, whose rank file lies at `ranks` on every worker.

    Windows are cut by token offsets in the text's bytes; where a cut falls within a
    character, its halves read as replacement characters. Special strings are plain text; a null or empty text has no windows.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window has tokens, and its overlap is smaller than it")

    @F.pandas_udf("array<struct<n_tokens:int,content:string>>")
    def windows(texts: pd.Series) -> pd.Series:
        library = _vocabulary(ranks, pattern)
        return texts.map(lambda t: [{"n_tokens": n, "content": body} for n, body in _windows(library, t, size, overlap)])

    return windows(text)


def _windows(library, text: str | None, size: int, overlap: int):
    ids = library.encode_ordinary(text) if text else []
    for at in range(0, len(ids), size - overlap):
        if at and at == len(ids) - overlap:
            break  # the window before ended with the last token
        part = ids[at : at + size]
        yield len(part), library.decode_bytes(part).decode("utf-8", errors="replace")


def vocabulary_chunks(df: DataFrame, keys: list[str], text: str, ranks: str, pattern: str, size: int = 600, overlap: int = 100, title: Column | None = None) -> DataFrame:
    """`chunks` over the tokens of a vocabulary instead of words."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window has tokens, and its overlap is smaller than it")
    named = {f"_k{n}": F.col(k) for n, k in enumerate(keys)}
    own = df.select(*(c.alias(n) for n, c in named.items()), F.col(text).alias("_text"), (F.lit(None).cast("string") if title is None else title).alias("_title"))
    kept = [*named, "_title"]
    schema = T.StructType([*(own.schema[c] for c in kept), *T.StructType.fromDDL("chunk_index int, n_tokens int, body string")])

    def run(batches):
        library = _vocabulary(ranks, pattern)
        for batch in batches:
            rows, numbers, counts, bodies, weight = [], [], [], [], 0

            def put():
                found = batch.take(pa.array(rows, pa.int64()))
                arrays = [found.column(found.schema.get_field_index(c)) for c in kept]
                return pa.RecordBatch.from_arrays([*arrays, pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(bodies, pa.string())], names=[*kept, "chunk_index", "n_tokens", "body"])

            texts = batch.column(batch.schema.get_field_index("_text"))
            narrow, batch = batch, batch.drop_columns(["_text"])
            del narrow
            for at in range(len(texts)):
                for k, (n, body) in enumerate(_windows(library, texts[at].as_py(), size, overlap)):
                    rows.append(at), numbers.append(k), counts.append(n), bodies.append(body)
                    weight += len(body)
                    if weight > BODY_CHARS:
                        yield put()
                        rows, numbers, counts, bodies, weight = [], [], [], [], 0
            if rows:
                yield put()

    rows = own.mapInArrow(run, schema)
    return rows.select(*(F.col(n).alias(k) for n, k in zip(named, keys)), "chunk_index", "n_tokens", titled(F.col("_title"), F.col("body")).alias("content"))


def zip_vectors(df: DataFrame, chunk_list: str, vector_list: str, keys: list[str]) -> DataFrame:
    """Chunks with their vectors by position; lists of different lengths fail the job."""
    same = required(F.size(chunk_list) == F.size(vector_list), "chunks and vectors differ in number")
    return df.filter(same).select(*keys, F.posexplode(F.arrays_zip(F.col(chunk_list).alias("content"), F.col(vector_list).alias("embedding"))).alias("chunk_index", "_z")).select(*keys, "chunk_index", "_z.*")


def chunk_totals(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_chunks, n_tokens): how many windows each text gave, and their tokens with overlaps."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
