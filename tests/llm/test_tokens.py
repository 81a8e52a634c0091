import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, packing, token_counts, trie_encoding

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
TEXTS = ["", "  ", "a  b\n\n c\t\td  ", "don't DON'T ''s x's", "<|endoftext|> hi <|startoftext|>there  <|endoftext|>", "ΑΣ ΣΑΣ ß İ ﬁ é \x1c\x1d x", "x" * 3000, "日本語テキスト漢字 テスト", " a b  　 c", "12345 6 7..!! ??", "trail \n", "a\x85b\x1fc", "😀😀 x😀", "aaaa" * 50 + " " + "ab" * 90]


@pytest.fixture(scope="module")
def word():
    t = Tokenizer.from_file(WORD)
    return t


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


odd = st.text(alphabet=st.sampled_from(list("ab tT'sS\n\t  éß漢😀.,!#1Σ<|>")), max_size=60)


def check_word(texts, library):
    for text, (coded, decoded) in zip(texts, trie_encoding.encoder(WORD).encode_batch(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(coded) // 4}I", coded)) == ids
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_trie_encoding_is_the_librarys(word):
    check_word(TEXTS, word)


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, max_size=4))
def test_trie_encoding_of_any_text(word, texts):
    check_word(texts, word)


def test_long_words_and_texts(word, byte):
    """A word of 200,000 letters, a run of as many symbols and digits, and a text of two million characters: as the library has them, in time that rises with the length alone."""
    import random

    rng = random.Random(2)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [run("abcdefghij", 200_000), run("abcXYZ0123456789+/=", 200_000), " ".join(run("abcdefg", rng.randrange(2, 9)) for _ in range(330_000))]
    check_word(texts, word)
    for t in texts:
        assert token_counts.counter(BYTE).state_map(t) == [("", "", len(byte.encode(t, add_special_tokens=False).ids))]


def plain_cuts(text, chunk):
    """Chunks of so many characters, and on to where white space follows a visible character."""
    white = lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f"
    out, at = [], 0
    while at < len(text):
        to = min(at + chunk, len(text))
        while to < len(text) and white(text[to]):
            to += 1
        while to < len(text) and not white(text[to]):
            to += 1
        out.append(text[at:to])
        at = to
    return out


@settings(max_examples=150, deadline=None)
@given(odd, st.integers(1, 9))
def test_counts_of_any_text_in_any_chunks(byte, text, chunk):
    """Maps compose to the library's count, whatever the chunks and the grouping."""
    n = len(byte.encode(text, add_special_tokens=False).ids)
    counter = token_counts.counter(BYTE)
    maps = [counter.state_map(p) for p in plain_cuts(text, chunk)] or [counter.state_map("")]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = token_counts.compose(left, m)
    for m in maps[-2::-1]:
        right = token_counts.compose(m, right)
    assert left == right == [(token_counts.START_KEY, token_counts.START_KEY, n)]


run_pieces = st.lists(st.sampled_from(["internationalization", "abc", "aaaaaa", "zq", "1234567", "'ll", "'s", "!?'", "漢字テスト", "ßéñ", " ", "\n\n", "<|endoftext|>", "endoftext", "x" * 40]), min_size=1, max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(run_pieces, st.integers(1, 12))
def test_maps_of_cuts_within_words_compose(byte, text, chunk):
    """Cuts within words: maps of several entries, composed from the left, from the right and in pairs, are the library's count."""
    counter = token_counts.counter(BYTE)
    pieces = list(counter.pieces(text, chunk))
    assert "".join(p for p, _, _ in pieces) == text
    maps = [counter.state_map(*p) for p in pieces]
    right, level = maps[-1], maps
    for m in maps[-2::-1]:
        right = token_counts.compose(m, right)
    while len(level) > 1:
        level = [token_counts.scanned(level[k : k + 2]) for k in range(0, len(level), 2)]
    n = len(byte.encode(text, add_special_tokens=False).ids)
    left = token_counts.scanned(maps)
    assert left == right == level[0] and left in ([("", "", n)], [])
    assert left or any(len(p) < 96 for p, _, _ in pieces)


def test_maps_within_a_word_have_several_entries(byte):
    counter, word = token_counts.counter(BYTE), "internationalizationofpneumonoultramicroscopic" * 4
    pieces = list(counter.pieces(word, 30))
    maps = [counter.state_map(*p) for p in pieces]
    assert len(maps) > 5 and all(on for _, _, on in pieces[:-1]) and all(len(m) > 1 for m in maps[1:]) and len(maps[0]) == 1
    assert token_counts.scanned(maps) == [("", "", len(byte.encode(word, add_special_tokens=False).ids))]
    assert token_counts.compose([("", "a", 1)], [("b", "", 2)]) == []  # a state that the second map lacks


def test_long_runs_are_dealt_to_tasks(spark, byte):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(n))
    texts = [letters(3_000_000), letters(40_000) + " and " + "7" * 30_000 + "!" * 20_000 + "'s", "short", "", "a" * 20_000 + "<|endoftext|>" + letters(20_000), "漢" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df).collect()}
    assert got == {k: (len(t.encode()), len(byte.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts)}


def test_a_state_that_no_map_has_is_counted_whole(spark, byte, monkeypatch):
    """Without characters before the cut, maps know no state: the text is counted in one piece."""
    monkeypatch.setattr(token_counts, "LEAD", 1)
    counter, word = token_counts.counter(BYTE), "internationalizationofpneumonoultramicroscopic" * 4
    assert any(token_counts.scanned([counter.state_map(*p) for p in counter.pieces(word, n)]) == [] for n in range(5, 40))


def test_spark_cuts_where_states_meet(spark):
    texts = [*TEXTS, "a b\x85c\u3000 d e" * 3, "x" * 50 + " " * 30 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chunk in (1, 3, 7):
        assert [r[0] for r in df.select(token_counts.cut(F.col("t"), chunk)).collect()] == [plain_cuts(t, chunk) for t in texts]


def test_counts_and_ids(byte):
    counter, coder = token_counts.counter(BYTE), packing.byte_encoder(BYTE)
    for text in TEXTS:
        ids = byte.encode(text, add_special_tokens=False).ids
        assert counter.state_map(text) == [("", "", len(ids))]
        assert coder.encode(text).tolist() == ids


def test_plain_merges_agree(byte):
    model = bpe.load(BYTE)
    for w in ("hello", "tokenization", "aaaaaaa", "é漢"):
        assert model.merge(tuple(model.bytes_to_symbols(w.encode()))) == byte.encode(w, add_special_tokens=False).ids


def test_encoding_queries(docs, empty, word, byte):
    rows = trie_encoding.encoding_digests(docs).collect()
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    want = []
    for i, t in texts:
        ids = word.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, *r[1:]) for r in rows) == sorted(want)
    for chunk in (100, token_counts.CHUNK_CHARS):
        counts = token_counts.token_counts(docs, chunk_chars=chunk).collect()
        check_counts(counts, texts, byte)
    full = trie_encoding.encode_documents(docs).filter("doc_id = 1").first()
    assert len(full["ids"]) % 4 == 0 and full["decoded"].startswith("river")
    assert trie_encoding.encoding_digests(empty).collect() == token_counts.token_counts(empty).collect() == []


def check_counts(counts, texts, byte):
    want = [(i, len(t.encode()), n := len(byte.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts]
    assert sorted((r["doc_id"] or -1, *r[1:]) for r in counts) == sorted(want)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at and 0 < length <= capacity
            at += length
        assert at <= capacity
    return bins


def test_packing(docs, empty, byte):
    rows = packing.pack(docs, capacity=64).collect()
    check_packing(rows, 64)
    assert packing.pack(empty).collect() == []
    want = []
    for d in docs.collect():
        ids = [*byte.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        for k, (a, z) in enumerate(zip([0, *range(first, len(ids), 64)], range(first, len(ids) + 1, 64))):
            want.append((d["doc_id"] or -1, k, a, z - a, zlib.crc32(struct.pack(f"<{z - a}I", *ids[a:z]))))
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in rows) == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12), st.sampled_from([None, 3]), st.sampled_from([None, 1700]), st.sampled_from(["residual_norm", "dot_product"]))
def test_plans_keep_every_limit(histogram, most, attention, rule):
    plan = packing.best_fit_plan(histogram, 40, most, attention, rule=rule)
    bins, ranks = {}, {}
    for size, low, high, first, offset in zip(*(plan[k].tolist() for k in ("length", "low", "high", "bin", "offset"))):
        for r in range(low, high):
            bins.setdefault(first + r - low, []).append((offset, size))
            ranks.setdefault(size, []).append(r)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    assert sorted(bins) == list(range(plan["bins"][0]))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= 40 and len(items) <= (most or 40) and sum(s * s for _, s in items) <= (attention or 1600)
    if most is None and attention is None and rule == "residual_norm":
        room = []  # one piece at a time
        for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [k for k, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= size
            else:
                room.append(40 - size)
        assert plan["bins"][0] <= len(room) + 1
