"""Bottom-k document fingerprints.

The fingerprint of a text is the k smallest 64-bit hashes of its distinct word
shingles (a text of fewer words is one shingle). The fingerprint of a union is the k
smallest of the parts' hashes together, so parts of a document or of a corpus are
sketched apart and merged. From two fingerprints follow estimates of resemblance,
containment and the number of distinct shingles.

Defined cases: a null text is the empty text; a text without words has an empty
fingerprint, whose likeness to another empty one is 1 and to any other 0; ties of
doc_id are ordered by text; long texts are read whole; an empty table gives no rows;
other columns are ignored. A repeated doc_id keeps its rows in one range.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Kept, id_type, map_rows, schema_of, slices

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_TOP = float(1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words of a text; words met before are not hashed again."""

    def __init__(self):
        self.known = Kept(xxhash.xxh3_64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, repeats included; of the whole text where it is shorter."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    h = mixed(words[: n - size + 1] + np.uint64(size))
    for k in range(1, size):
        h = mixed(h ^ words[k : n - size + 1 + k])
    return h


def sketch(text: str, k: int = 128, size: int = 5) -> np.ndarray:
    """The k smallest distinct shingle hashes, rising."""
    return np.unique(shingle_hashes(word_hashes().of(text.encode().split()), size))[:k]


def merge(parts: list[np.ndarray], k: int = 128) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def distinct(s: np.ndarray, k: int = 128) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated Jaccard similarity of the shingle sets; exact where both are smaller than k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= k:  # smaller sketches are whole sets
        both = both[:k]
    common = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(common, both[-1], side="right")) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = 128) -> float:
    """Estimated share of a's shingles that b has: the intersection from the resemblance and the size of the union."""
    if not len(a):
        return 1.0
    if max(len(a), len(b)) < k:
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    union = distinct(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 128, size: int = 5) -> DataFrame:
    """(id, fingerprint, estimated distinct shingles) of every row. No shuffle."""

    def start():
        def rows(ids, texts):
            for i, t in zip(ids, texts):
                s = sketch(t or "", k, size)
                yield i, to_text(s), distinct(s, k)

        return rows

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, fingerprint string, n_shingles double"), start)


def merge_fingerprints(df: DataFrame, keys: list[str], k: int = 128, fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint for each key from those of its parts. A hot key is merged in two steps, hash buckets first, each step keeping k hashes of a group."""
    parts = df.select(*keys, F.pmod(F.xxhash64(fingerprint), F.lit(64)).alias("_salt"), F.explode_outer(_hashes(fingerprint)).alias("_h")).distinct()
    by_salt = Window.partitionBy(*keys, "_salt").orderBy("_h")
    few = parts.withColumn("_r", F.row_number().over(by_salt)).filter(F.col("_r") <= k + 1).select(*keys, "_h").distinct()  # one more for the null of an empty part
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))).filter(F.col("_r") <= k)
    merged = few.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("_all"))  # at most k hashes of a key
    return merged.select(*keys, F.base64(F.unhex(F.array_join(F.transform("_all", _swapped), ""))).alias(fingerprint))


def _swapped(h: F.Column) -> F.Column:
    """The hex of eight bytes in the other byte order."""
    return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))


def _hashes(column: str) -> F.Column:
    """A fingerprint's hashes as fixed-width hex of their big-endian bytes, so that text order is number order."""
    raw = F.hex(F.unbase64(column))
    n = F.floor(F.length(raw) / 16).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: _swapped(F.substring(raw, i * 16 + 1, F.lit(16))))).otherwise(F.array().cast("array<string>"))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts_below(column: str, cuts: list[int]) -> F.Column:
    """How many of the rising cuts are less than the column: a block of cuts first, then one within it."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    every = F.array(*map(F.lit, cuts))
    below = lambda cut: cut < F.col(column)
    block = F.size(F.filter(F.array(*map(F.lit, cuts[::step])), below))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(F.slice(every, (block - 1) * step + 1, F.lit(step)), below)))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 128, size: int = 5) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see `edited`.

    The document that follows is the next in falling id, the first after the last. Ids are
    dealt into ranges at approximate quantiles; each range is one sorted stream, and a copy
    of every range's first document ends the range before it. Texts are shuffled once.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("id", F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(100 * n))).first()[0]
    cuts = sorted(set(cuts or []))
    # null ids come last
    docs = docs.withColumn("part", F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - _cuts_below("id", cuts)).cast("int"))
    first = [r for r in docs.groupBy("part").agg(F.max("id").alias("id"), F.max(F.col("id").isNotNull()).alias("some")).orderBy("part").collect()]  # one row a range
    heads = [(r["id"], r["part"], first[j - 1]["part"]) for j, r in enumerate(first)]
    if heads:
        ends = spark.createDataFrame([(i, p, before) for i, p, before in heads], "head long, head_part int, part_before int")
        tails = docs.join(F.broadcast(ends), F.col("id").eqNullSafe(F.col("head")) & (F.col("part") == F.col("head_part")))  # a row for each range
        tails = tails.select("id", "text", F.col("part_before").alias("part"), F.lit(1).alias("tail"))
        docs = docs.select("id", "text", "part", F.lit(0).alias("tail")).unionByName(tails)
    else:
        docs = docs.withColumn("tail", F.lit(0))
    ordered = docs.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "text")
    schema = schema_of(f"{id_col} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    types = [("id", pa.int64()), ("n_chars", pa.int64()), ("e", pa.string()), ("f", pa.string()), ("g", pa.string()), ("x", pa.float64()), ("y", pa.float64())]
    arrow = pa.schema([(f.name, t) for f, (_, t) in zip(schema, types)])

    def run(batches):
        held = None  # the row whose follower has not come yet: (id, text, sketch, part)
        in_tail = None

        def made(follower, own):
            i, text, mine, _ = held
            other = edited(text, follower)
            its = sketch(other, k, size)
            return i, len(text), hashlib.sha256(other.encode()).hexdigest(), to_text(mine), to_text(its), resemblance(mine, its, k), resemblance(mine, own, k)

        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, text, p, tail in zip(*(part.column(c).to_pylist() for c in range(4))):
                    if tail and in_tail == p:
                        continue  # further rows of a repeated id: the first of them follows
                    own = sketch(text, k, size)
                    if held is not None and held[3] == p:
                        rows.append(made(text, own))
                    held, in_tail = (None, p) if tail else ((i, text, own, p), None)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return ordered.select("id", "text", "part", "tail").mapInArrow(run, schema)
