"""Vector best-fit packing of tokenised documents into fixed-size sequences.

A document is its token ids and an end id. A document longer than a sequence is cut
into full pieces; only its first piece may be shorter. Bins (sequences) have three
capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces go in by falling length; among the bins with room under every constraint the
one with the least weighted norm of what would remain (or the largest weighted dot
product of demand and room) takes the next piece.

Pieces of one length are alike, so the choice runs over classes: `length -> count` is
at most `capacity` numbers however large the corpus, and bins with equal room are one
class. The resulting plan says, for each length, which bins and offsets its first,
second, ... piece gets. Its size depends on the capacity only, and it goes to all tasks; 
Spark ranks the pieces of each length in hash buckets, so that no length, however
common, is ordered in one place.

Defined cases: a null text is the empty text (one piece, the end id alone); repeated
rows and ids are packed each for itself; ties in length are ranked by hash, id and piece;
a long text is encoded whole and cut; an empty table gives no rows; only the id and text
columns are read. By default the limits on documents and attention cost are so wide that
only tokens bind; they then weigh ties.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.bpe import byte_letters
from larder.llm.common import id_type, map_rows, public_tokenizer, schema_of, staged


class ByteEncoder:
    """Ids of whole texts for a byte-level BPE tokenizer .json whose ids rise with merge rank, by tiktoken, which gives the same ids as the tokenizers library at a third of its CPU time. Special strings in texts are their one id, as by default there."""

    #: Fixed value of this vocabulary: the pattern of its pre-tokenizer.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if i not in {t["id"] for t in spec["added_tokens"]}}
        self.library = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One for each Python worker, kept between tasks."""
    return ByteEncoder(path)


def pieces_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""

    def start():
        coder = byte_encoder(tokenizer or public_tokenizer("byte_bpe_50k.json"))
        end = end_id.to_bytes(4, "little")

        def rows(ids, texts):
            for i, t in zip(ids, texts):
                coded = coder.encode(t or "").astype("<u4").tobytes() + end
                n, at, piece = len(coded) // 4, 0, 0
                to = (n - 1) % capacity + 1
                while at < n:
                    yield i, piece, at, to - at, zlib.crc32(coded[4 * at : 4 * to])
                    at, to, piece = to, to + capacity, piece + 1

        return rows

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint"), start)


def best_fit_plan(
    histogram: dict[int, int],
    capacity: int = 1024,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "residual_norm",
) -> dict[str, np.ndarray]:
    """Which bin and offset each piece gets: rows (length, first rank, last rank + 1, first bin, offset).

    `histogram` counts the pieces of each length. Ranks of a length count from 0; the
    piece of rank r in a row goes to bin `first bin + r - first rank`.
    """
    caps = np.array([capacity, max_documents or capacity, max_attention or capacity**2], float)
    if max_attention and max((n * n for n in histogram), default=0) > max_attention:
        raise ValueError("a piece alone costs more attention than a sequence may")
    weight = np.array(weights, float)
    room = np.zeros((0, 3))  # what bins of each class have left
    bins: list[list[tuple[int, int]]] = []  # of each class: (first bin, bins)
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def most(left: np.ndarray, size: int) -> int:
        return int(min(left[0] // size, left[1], left[2] // (size * size)))

    def put(left: np.ndarray, runs: list[tuple[int, int]], size: int, each: int, rank: int) -> int:
        """Place `each` pieces in every bin of the runs; the next rank."""
        nonlocal room
        for first, n in runs:
            for layer in range(each):
                rows.append((size, rank, rank + n, first, int(capacity - left[0]) + layer * size))
                rank += n
        after = left - np.array([size, 1, size * size]) * each
        if after[0] > 0 and after[1] > 0 and after[2] > 0:
            same = np.flatnonzero((room == after).all(axis=1))
            if len(same):
                bins[same[0]].extend(runs)
            else:
                room = np.vstack([room, after])
                bins.append(list(runs))
        return rank

    for size in sorted(histogram, reverse=True):
        rank, total = 0, histogram[size]
        demand = np.array([size, 1, size * size], float)
        while rank < total:
            fits = np.flatnonzero((room >= demand).all(axis=1))
            if len(fits):
                if rule == "dot_product":
                    best = fits[np.argmax((room[fits] / caps * demand / caps) @ weight)]
                else:
                    best = fits[np.argmin((((room[fits] - demand) / caps) ** 2) @ weight)]
                left, runs = room[best].copy(), bins[best]
            else:
                left, runs, best = caps.copy(), None, None
            each = most(left, size)
            whole, rest = divmod(total - rank, each)
            if runs is None:
                runs = [(made, whole + (rest > 0))]
                made += whole + (rest > 0)
            else:
                room = np.delete(room, best, axis=0)
                bins.pop(best)
            filled, one, spare = _take(runs, whole, rest > 0)
            if filled:
                rank = put(left, filled, size, each, rank)
            if one:
                rank = put(left, one, size, rest, rank)
            if spare:
                room = np.vstack([room, left])
                bins.append(spare)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "high", "bin", "offset"), table.T)) | {"bins": np.array([made])}


def _take(runs: list[tuple[int, int]], n: int, one_more: bool) -> tuple[list, list, list]:
    """The first n bins of the runs, then one more if asked for, then what is left of them."""
    out: tuple[list, list, list] = ([], [], [])
    wants = [n, int(one_more), 1 << 62]
    for first, size in runs:
        for k in range(3):
            got = min(size, wants[k])
            if got:
                out[k].append((first, got))
                first, size, wants[k] = first + got, size - got, wants[k] - got
    return out


def rank_in_length(pieces: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Add `rank`, 0, 1, ... within each length, without bringing a length to one place: ranks within (length, hash bucket), and offsets from the counts of the earlier buckets."""
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_own", F.row_number().over(own))
        .join(sums, ["length", "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_own") - 1)
        .drop("_bucket", "_before", "_own")
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "residual_norm",
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece with its sequence and its offset there. Texts are tokenised once and never shuffled; pieces are 40 bytes each."""
    spark = df.sparkSession
    pieces = staged(pieces_of(df, id_col, text_col, capacity, end_id, tokenizer), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(best_fit_plan(histogram, capacity, max_documents, max_attention, rule=rule))
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = rank_in_length(pieces, [id_col, "piece", "ids_crc32"], buckets)
    columns = [id_col, "piece", "start", "length", "ids_crc32"]

    def start():
        p = plan.value
        key = p["length"] * (1 << 44) + p["low"]

        def rows(ids, piece, begin, length, crc, rank):
            n, r = np.asarray(length, np.int64), np.asarray(rank, np.int64)
            at = np.searchsorted(key, n * (1 << 44) + r, side="right") - 1
            sequence = p["bin"][at] + r - p["low"][at]
            return zip(ids, piece, begin, length, crc, sequence.tolist(), p["offset"][at].tolist())

        return rows

    return map_rows(ranked, [*columns, "rank"], schema_of(f"{id_col} {id_type(df, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"), start)
