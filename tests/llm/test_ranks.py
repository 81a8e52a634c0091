"""Encoding by the rank file: against the library on whole texts, and against plain merging."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import rank_encoding

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
SPLIT = regex.compile(public_tokenizers.PATTERN)


def plain(text):
    """Each match alone; in each the pair of the lowest rank merges first, leftmost first."""
    out = []
    for match in SPLIT.finditer(text):
        parts = [bytes([b]) for b in match.group().encode()]
        while len(parts) > 1:
            rank, k = min((RANKS.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out += [RANKS[p] for p in parts]
    return out


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return [i for part in rank_encoding.coder(PATH, public_tokenizers.PATTERN).parts(text) for i in part.tolist()]


odd = st.text(alphabet=st.sampled_from(list("ab tT'sSrve\n\t\r  \x1c\x85éß漢字。ね😀.,!#1Σ٣<|>́")), max_size=80)


@settings(max_examples=200, deadline=None)
@given(odd)
def test_any_text_as_plain_merging(text):
    assert ids(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_cuts_everywhere_change_nothing(text):
    whole, rank_encoding.CHUNK = rank_encoding.CHUNK, 1
    try:
        assert ids(text) == plain(text)
    finally:
        rank_encoding.CHUNK = whole


def test_long_texts(library):
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("abcdefghié漢") for _ in range(rng.randrange(1, 12))) for _ in range(200_000))
    no_spaces = "".join(rng.choice(["abc", "12", "漢字", "。", "'s", "!?"]) for _ in range(400_000))
    for text in (prose, no_spaces, "word" * 300_000, " " * 500_000 + "x", "\n" * 300_000, "7" * 300_000):
        assert ids(text) == library.encode_ordinary(text)


def test_digests_and_round_trip(spark, docs, empty, library):
    want = {(i, t): library.encode_ordinary(t or "") for i, t in docs.select("doc_id", "text").collect()}
    coded = rank_encoding.encode(docs)
    assert coded.columns == ["doc_id", "ids"]
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in coded.collect()))) == sorted(repr((r.doc_id, want[r.doc_id, r.text])) for r in docs.select("doc_id", "text").collect())
    back = sorted(((r.doc_id or 0, bytes(r.decoded)) for r in rank_encoding.decode(coded).collect()))
    assert back == sorted((r.doc_id or 0, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rank_encoding.rank_digests(docs).collect())
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted((i or 0, len(want[i, t]), sha(",".join(map(str, want[i, t])).encode()), sha((t or "").encode())) for i, t in rows)
    assert rank_encoding.rank_digests(empty).count() == 0
    assert rank_encoding.decode(spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")).orderBy("doc_id").first().decoded is None
