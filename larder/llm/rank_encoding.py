"""Byte-level BPE by the tiktoken library with a local rank file.

The file holds one base64 token and its rank on each line. A text is split by the
vocabulary's pattern and every match is encoded for itself, so a long text may be cut
wherever no match can cross: there the library gets pieces of about CHUNK characters
and the parts' ids follow each other. Cuts are laid where a match must end whatever
comes before: before a white-space character that follows another character, and
between a letter and a digit or sign. A run without such a place (one word of millions
of letters) goes to the library whole; its time rises with n log n. Decoding looks up
the bytes of each id, so ids need not end at a character's border.

Defined cases: a null text is the empty text, without ids; special strings in texts are
plain text; repeated rows and ids are encoded each for itself; a null id stays null; an
empty table gives no rows; only the id and text (or ids) columns are read, so further
columns may have any names. An id that the vocabulary lacks is an error on decoding; null
ids (no list) decode to null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import id_type, map_rows, public_tokenizer, schema_of

#: Characters of a text that the library is given at a time, where it can be cut.
CHUNK = 1 << 16
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Where a match of the pattern always ends: its alternatives hold letters, digits, signs or white space, each without the others, but for one leading space and the apostrophe of a contraction.
SAFE = re.compile(
    r"(?<=\S)(?=[ \t\n\r])"
    r"|(?<=[A-Za-zà-öぁ-ゖァ-ヺ一-鿿])(?=[0-9!-/:-@、。])"
    r"|(?<=[0-9])(?=[A-Za-z!-/:-@、。])"
)


class RankCoder:
    """The library's encoding of texts of any length."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, piece by piece."""
        at = 0
        while len(text) - at > CHUNK:
            cut = SAFE.search(text, at + CHUNK)
            if not cut:
                break
            yield self.library.encode_to_numpy(text[at : cut.start()], disallowed_special=())
            at = cut.start()
        if at < len(text):
            yield self.library.encode_to_numpy(text[at:], disallowed_special=())

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> RankCoder:
    """One for each Python worker, kept between tasks."""
    return RankCoder(path, pattern)


def _coder(ranks: str | None, pattern: str | None) -> RankCoder:
    import public_tokenizers

    return coder(ranks or public_tokenizer(RANKS), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) of every text; `ranks` is the path of a rank file on every worker."""

    def start():
        c = _coder(ranks, pattern)

        def rows(keys, texts):
            for k, t in zip(keys, texts):
                yield k, [i for part in c.parts(t or "") for i in part.tolist()]

        return rows

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id", "text"], schema_of(f"id {id_type(df, id_col)}, ids array<int>"), start).toDF(id_col, "ids")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded): the bytes of every list of ids."""

    def start():
        c = _coder(ranks, pattern)
        return lambda keys, lists: ((k, None if ids is None else c.decode(ids)) for k, ids in zip(keys, lists))

    return map_rows(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), ["id", "ids"], schema_of(f"id {id_type(df, id_col)}, decoded binary"), start).toDF(id_col, "decoded")


def rank_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): of the ids in decimal, joined by commas, and of the bytes they decode to. A long text passes in parts, so its ids are never held at once."""

    def start():
        c = _coder(ranks, pattern)

        def rows(keys, texts):
            for k, t in zip(keys, texts):
                n, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
                for part in c.parts(t or ""):
                    ids = part.tolist()
                    ids_sha.update((("," if n else "") + ",".join([c.decimal[i] for i in ids])).encode())
                    decoded_sha.update(c.decode(ids))
                    n += len(ids)
                yield k, n, ids_sha.hexdigest(), decoded_sha.hexdigest()

        return rows

    schema = schema_of(f"id {id_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return map_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id", "text"], schema, start).withColumnRenamed("id", id_col)
