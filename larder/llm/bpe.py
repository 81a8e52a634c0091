"""Byte-pair vocabularies as automata over their base symbols.

An encoding is a BPE encoding exactly if every two neighbouring tokens are one, so
the last token of a prefix is the one vocabulary token that ends there and stands well
beside the last token of the prefix before it. The vocabulary tokens that end at a place
are read off an automaton over base symbols with failure links; its steps are found on
demand and kept.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import lru_cache

ROOT = 0
NEVER = 1 << 60
#: Answers about pairs of tokens that are kept.
KEEP_PAIRS = 2_000_000
_NO_MERGE = (NEVER, 0)


@lru_cache(maxsize=None)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Steps(dict):
    """Where each symbol leads from a node: to the longest beginning of a token that the text so far ends with."""

    __slots__ = ("model", "node")

    def __init__(self, model: BpeModel, node: int):
        self.model, self.node = model, node

    def __missing__(self, symbol: int) -> int:
        model, at = self.model, self.node
        while at and symbol not in model.children[at]:
            at = model.fail[at]
        to = self[symbol] = model.children[at].get(symbol, ROOT)
        return to


class BpeModel:
    """Ranks, base symbols and the prefix tree of a byte-level BPE vocabulary in a tokenizer .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + suffix] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.ranks[a, b] = rank, made
            parts.setdefault(made, (a, b))
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in {*self.first, *self.final}}
        for made, (a, b) in parts.items():  # merges are in the order in which their parts arise
            self.symbols[made] = self.symbols[a] + self.symbols[b]
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        self.split: dict[int, tuple[int, int, int]] = {}
        for i, symbols in self.symbols.items():
            if len(symbols) == 1 or self._made_of(i, symbols):
                node = ROOT
                for s in symbols:
                    node = self.children[node].setdefault(s, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.token.append(None)
                self.token[node] = i
        self.fail = [ROOT] * len(self.children)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.children)
        level, depth = [ROOT], 0
        while level:
            below = []
            for node in level:
                for symbol, to in self.children[node].items():
                    at = self.fail[node]
                    while at and symbol not in self.children[at]:
                        at = self.fail[at]
                    self.fail[to] = self.children[at].get(symbol, ROOT) if depth else ROOT
                    token = self.token[to]
                    self.ends[to] = (((token, depth + 1),) if token is not None else ()) + self.ends[self.fail[to]]
                    below.append(to)
            level, depth = below, depth + 1
        self.sizes = {i: len(x) for i, x in self.symbols.items()}
        self.step = [Steps(self, node) for node in range(len(self.children))]
        self._sides: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.beside: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._known = 0

    def _made_of(self, i: int, symbols: tuple[int, ...]) -> bool:
        """Is the token its own encoding? Its last merge is recorded as (left, right, rank)."""
        pair = tuple(self.merge(symbols, down_to=2))
        rank, made = self.ranks.get(pair, (NEVER, None))
        if made == i:
            self.split[i] = (*pair, rank)
        return made == i

    def merge(self, symbols: tuple[int, ...], down_to: int = 1) -> list[int]:
        """Plain BPE: while any neighbours merge, merge the pair of the lowest rank, leftmost first."""
        word = list(symbols)
        while len(word) > down_to:
            found = [self.ranks.get(p, _NO_MERGE) for p in zip(word, word[1:])]
            rank, made = min(found)
            if rank == NEVER:
                break
            k = found.index((rank, made))
            word[k : k + 2] = [made]
        return word

    def _side(self, token: int, right: bool) -> list[tuple[int, int]]:
        """What stands at the right or left edge of the token while it is merged: parts from the base symbol up, each with the rank of the merge that takes it in."""
        found = self._sides.get((token, right))
        if found is None:
            at, rank, found = token, NEVER, []
            while True:
                found.append((at, rank))
                if at not in self.split:
                    break
                rank, at = self.split[at][2], self.split[at][1 if right else 0]
            found.reverse()
            self._sides[token, right] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Do these tokens stand side by side in a BPE encoding? They do if no pair of parts that meet at their border while they are merged would merge first."""
        known = self.beside[left]
        answer = known.get(right)
        if answer is None:
            if self._known > KEEP_PAIRS:
                for pairs in self.beside.values():
                    pairs.clear()
                self._known = 0
            self._known += 1
            a, b = iter(self._side(left, True)), iter(self._side(right, False))
            (x, taken), (y, taking) = next(a), next(b)
            while True:
                rank = self.ranks.get((x, y), (NEVER, 0))[0]
                if rank < taken and rank <= taking and rank < NEVER:  # of equal ranks the leftmost pair goes first
                    answer = False
                    break
                if taken == taking == NEVER:
                    answer = True
                    break
                if taken <= taking:
                    x, taken = next(a)
                else:
                    y, taking = next(b)
            known[right] = answer
        return answer

    def bytes_to_symbols(self, word: bytes) -> list[int]:
        """The base symbols of a whole word; the last one carries the end-of-word mark if the vocabulary has one."""
        first = self.first
        out = [first[b] for b in word]
        out[-1] = self.final[word[-1]]
        return out


@lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)
