"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

The distinct words of a batch that are not known yet go into a trie: sorted, they are the
trie in depth-first order, and the branch that leads to the present node is a stack. For
each node the stack holds the last token of the node's prefix, so a prefix that thousands
of words share is encoded once, and a word's encoding is read back along its branch.
Encodings of words are kept between batches up to a number of bytes, and documents are
put together from them. A batch is bounded in bytes, whatever the lengths of its texts.

A null text counts as the empty text. Empty or all-blank texts give no ids and the hash
of nothing; an empty table gives no rows. Long texts and long words need time and memory
in proportion to their length. The encoding of a text is unique, so ties do not arise.
Repeated rows and repeated doc_ids each give their own row, and columns other than the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse
from struct import pack

import regex
from pyspark.sql import DataFrame

from larder.llm import bpe
from larder.llm.common import id_type, map_rows, public_tokenizer, schema_of

#: Fixed values of this vocabulary: its pre-tokenizer's pattern, the same for ASCII texts in lower case, and Unicode white space.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Characters that the pattern above takes for white space and Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Bytes of text encoded together, and of words whose encodings a Python worker keeps.
BATCH_BYTES = 4 << 20
KEEP_BYTES = 8 << 20


class TrieEncoder:
    """Encodes texts of a word-level BPE vocabulary."""

    def __init__(self, path: str):
        self.model = bpe.load(path)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.kept_bytes = 0
        names = sorted(self.model.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def words(self, text: str) -> list[str]:
        """The words of the normalised text: NFC, lower case letter by letter."""
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words not known yet; beyond the bound only the words of this batch are kept."""
        new: set[str] = set()
        for words in texts:
            new.update(filterfalse(self.known.__contains__, words))
        if not new:
            return
        if self.kept_bytes > KEEP_BYTES:
            still = set().union(*texts) - new
            self.known = {w: self.known[w] for w in still if w in self.known}
            self.kept_bytes = sum(map(len, still))
        self.walk(new)
        self.kept_bytes += sum(map(len, new))

    def walk(self, words: Iterable[str]) -> None:
        """Depth first through the trie of the words."""
        model, known = self.model, self.known
        step, ends, beside, fits, first, final, named, sizes = model.step, model.ends, model.beside, model.fits, model.first, model.final, model.strings, model.sizes
        nodes, last, before = [bpe.ROOT], [-1], b""
        for raw, word in sorted([(w.encode(), w) for w in words]):
            n = len(raw) - 1
            depth, most = 0, min(n, len(before))
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            del nodes[depth + 1 :], last[depth + 1 :]
            node = nodes[depth]
            for at in range(depth, n + 1):
                node = step[node][first[raw[at]] if at < n else final[raw[at]]]
                for token, size in ends[node]:
                    if size > at or (beside[last[at + 1 - size]][token] if token in beside[last[at + 1 - size]] else fits(last[at + 1 - size], token)):
                        break
                nodes.append(node)
                last.append(token)
            found, at = [], n + 1
            while at:
                found.append(last[at])
                at -= sizes[last[at]]
            found.reverse()
            known[word] = pack(f"<{len(found)}I", *found), " ".join([named[i] for i in found])
            nodes.pop()
            last.pop()
            before = raw[:n]

    def segments(self, text: str) -> list[str | list[str]]:
        """Runs of words, and the special tokens, as strings, that stand between them."""
        if self.special is None or not self.special.search(text):
            return [self.words(text)]
        return [p if p in self.model.specials else self.words(p) for p in self.special.split(text)]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        split = [self.segments(t) for t in texts]
        self.learn([words for parts in split for words in parts if isinstance(words, list)])
        known, specials = self.known, self.model.specials
        for parts in split:
            found = []
            for p in parts:
                found += [(specials[p].to_bytes(4, "little"), p)] if isinstance(p, str) else [known[w] for w in p]
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found])


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One for each Python worker, kept between tasks."""
    return TrieEncoder(path)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ids as little-endian unsigned 32-bit integers, decoded text) of every row. No shuffle."""

    def start():
        coder = encoder(tokenizer or public_tokenizer("word_bpe_49k.json"))
        return lambda ids, texts: [(i, *x) for i, x in zip(ids, coder.encode_batch([t or "" for t in texts]))]

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, ids binary, decoded string"), start, BATCH_BYTES)


def encoding_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Number of tokens and SHA-256 of ids and decoded text, without shipping either back to the JVM."""

    def start():
        coder = encoder(tokenizer or public_tokenizer("word_bpe_49k.json"))

        def rows(ids, texts):
            for i, (coded, decoded) in zip(ids, coder.encode_batch([t or "" for t in texts])):
                yield i, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return rows

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"), start, BATCH_BYTES)
