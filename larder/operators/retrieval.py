"""Cosine retrieval over vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_K = 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null for a vector of length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(df: DataFrame, vector: str, query: list[float], k: int, ties: list[str], keep: Column | None = None) -> DataFrame:
    """The k rows most similar to the query among those to keep; equal ones by `ties`. Each task keeps k rows, so no sort of the table."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}")
    rows = df if keep is None else df.filter(keep)
    target = F.array(*(F.lit(float(x)) for x in query))
    scored = rows.withColumn("similarity", cosine(F.col(vector), target)).filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.col("similarity").desc(), *ties).limit(k)


def batch_top_k(queries: DataFrame, df: DataFrame, query_id: str, query_vector: str, vector_id: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """The k most similar vectors for each of many queries.

    Queries are packed in blocks of about `block` vectors, one row each; every block row
    is paired with every slice of the table, a slice being a packed row of about `block`
    vectors too, so the product is of blocks, not of rows, and each task multiplies two
    matrices of bounded size. A second step keeps the best k of the slices.
    """
    asked = _packed(queries, query_id, query_vector, block).select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    slices = _packed(df, vector_id, vector, block)
    out = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

    def unit(batch, ids, vs):
        i, v = np.array(ids, np.int64), np.array(vs, float)
        length = np.linalg.norm(v, axis=1)
        return i[length > 0], v[length > 0] / length[length > 0, None]

    def best(batches):
        for batch in batches:
            for q_ids, q_vs, ids, vs in zip(*(c.to_pylist() for c in batch.columns)):
                (qi, qv), (vi, vv) = unit(batch, q_ids, q_vs), unit(batch, ids, vs)
                if not len(qi) or not len(vi):
                    continue
                s = qv @ vv.T
                rows = [(i, np.lexsort((vi, -np.round(row, 12)))[:k], row) for i, row in zip(qi, s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(t), i) for i, t, _ in rows])), pa.array(np.concatenate([vi[t] for _, t, _ in rows])), pa.array(np.concatenate([r[t] for _, t, r in rows]))], schema=out
                )

    pairs = slices.join(asked).select("q_ids", "q_vs", "ids", "vs")  # of blocks: rows / block on either side
    chosen = pairs.mapInArrow(best, "q bigint, id bigint, similarity double")
    w = Window.partitionBy("q").orderBy(F.round("similarity", 12).desc(), "id")
    return chosen.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _packed(df: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """Rows of about `block` ids and their vectors, packed within tasks, without a shuffle."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("vs", pa.list_(pa.list_(pa.float64())))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], schema.field(0).type), pa.array([part.column(1).to_pylist()], schema.field(1).type)], schema=schema)

    return df.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(run, "ids array<bigint>, vs array<array<double>>")


def _planes(bits: int, dims: int, seed: str) -> list[list[float]]:
    return [[int.from_bytes(hashlib.sha256(f"{seed}/{b}/{d}".encode()).digest()[:4], "big") / 2**31 - 1 for d in range(dims)] for b in range(bits)]


def hyperplane_buckets(df: DataFrame, vector: str, bits: int, dims: int, seed: str = "planes") -> DataFrame:
    """A bucket number from the signs of `bits` fixed random projections: rows that share a bucket are likely similar. An opt-in approximation; the exact scan stays the default."""
    bit = lambda p: F.when(dot(F.col(vector), F.array(*map(F.lit, p))) >= 0, 1).otherwise(0)
    bucket = F.lit(0)
    for p in _planes(bits, dims, seed):
        bucket = bucket * 2 + bit(p)
    return df.withColumn("bucket", bucket)


def probes(vector: Column, bits: int, dims: int, n: int, seed: str = "planes") -> Column:
    """The `n` buckets in which neighbours of a vector are likeliest, its own first: a bucket costs the distances to the planes that part it from the vector."""
    sides = F.array(*(dot(vector, F.array(*map(F.lit, p))) for p in _planes(bits, dims, seed)))

    def cost(bucket):
        each = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.struct(F.get(sides, k).alias("m"), (F.floor(bucket / F.pow(F.lit(2.0), F.lit(bits - 1) - k)).cast("int") % 2).alias("bit")))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + F.when((x["m"] >= 0).cast("int") != x["bit"], F.abs(x["m"])).otherwise(0.0))

    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(2**bits - 1)), lambda b: F.struct(cost(b).alias("cost"), b.alias("bucket"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["bucket"])


def probed_top_k(queries: DataFrame, df: DataFrame, query_id: str, query_vector: str, vector_id: str, vector: str, k: int, bits: int, dims: int, n_probes: int, seed: str = "planes") -> DataFrame:
    """(q, id, similarity, place): the k most similar vectors among those in the `n_probes` likeliest buckets of each query, exactly compared.

    A query meets the rows of its buckets by an equality join on the bucket, and tasks
    keep k of each query before the shuffle. How many of the true neighbours are found
    depends on the vectors; measure it with `recall`. With all 2^bits buckets it is exact.
    """
    if not 1 <= bits <= 12 or not 1 <= n_probes <= 2**bits:
        raise ValueError("from 1 to 12 bits, and from one probe to all buckets")
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("_qv")).withColumn("bucket", F.explode(probes(F.col("_qv"), bits, dims, n_probes, seed)))
    rows = hyperplane_buckets(df.select(F.col(vector_id).alias("id"), F.col(vector).alias("_v")), "_v", bits, dims, seed)
    scored = asked.join(rows, "bucket").select("q", "id", cosine(F.col("_qv"), F.col("_v")).alias("similarity")).filter("similarity IS NOT NULL")
    w = Window.partitionBy("q").orderBy(F.round("similarity", 12).desc(), "id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (q, id) that were found."""
    hit = exact.join(found.select("q", "id", F.lit(1).alias("_hit")), ["q", "id"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]
