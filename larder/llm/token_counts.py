"""Token counts by a compiled finite-state transducer.

The byte-level BPE vocabulary is compiled, on demand, into a deterministic transducer: a
state says which vocabulary tokens may be under way and what the last token was before
each; a transition on a byte carries the change that it makes to the number of tokens.

Spark cuts every text into chunks of about CHUNK_CHARS characters, a row each. A chunk
becomes its state map, rows of (state before, state after, tokens between), and maps
compose to the map of a longer stretch, whatever their grouping. Where white space
follows a visible character every state becomes the start state, START, so cuts are laid
there as long as there are such places: then a map is the one entry of START, and a
text's maps are composed in the task that made them, without a shuffle.

A text with a run of CHUNK_CHARS characters without white space is cut within the run,
between letters or between digits, and its chunks are dealt to all tasks. A map then has
an entry for every state that can stand at its beginning: the states that the LEAD
characters before the cut lead to, from START at any of them. Tokens are short, so these
soon are few and hold the true one. Maps are composed in groups of FAN, then the groups.
Should the true state not be among a map's entries, the composition says so, and that
text is counted from its start in one piece.

A null text counts as the empty text: 0 bytes, 0 tokens. Rows are independent, so
repeated rows and ids give repeated results; an empty table gives no rows; counts are
unique, so ties do not arise; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import bpe
from larder.llm.common import id_type, map_rows, public_tokenizer, schema_of, staged

#: Fixed values of this vocabulary: the pattern of its pre-tokenizer and Unicode white space.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEFORE_WHITE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
#: A stretch starts where white space follows a visible character.
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CHUNK_CHARS = 16_384
#: A cut within a run: between letters, or digits, of which three stand before it, so that no contraction is parted.
WITHIN = regex.compile(r"(?<=\p{L}{3})(?=\p{L})|(?<=\p{N}{3})(?=\p{N})")
#: Characters before such a cut from which the states at it are found, and maps that are composed at a time.
LEAD, FAN = 96, 64
#: The start state, as a number and as maps name it.
START, START_KEY = 0, ""
#: Characters of stretches, and states, that a Python worker keeps; longer stretches are counted each time.
KEEP_CHARS = 8 << 20
LONGEST_KEPT = 64
KEEP_STATES = 300_000


class Transducer:
    """Lazily determinised: states are numbered as they are met."""

    def __init__(self, path: str):
        self.model = bpe.load(path)
        self.reset()

    def reset(self) -> None:
        start = ((bpe.ROOT, None, 0),)
        self.states, self.number = [start], {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the tokens that this byte adds (less than 0 where tokens grow together)."""
        known = self.steps[state].get(byte)
        if known is not None:
            return known
        model, symbol = self.model, self.model.first[byte]
        last, emitted, going = None, 0, []
        for at, before, ago in self.states[state]:
            to = model.children[at].get(symbol)
            if to is None:
                continue
            token = model.token[to]
            if last is None and token is not None and (before is None or model.fits(before, token)):
                last, emitted = token, ago + 1
            if model.children[to]:
                going.append((to, before, ago))
        entry = (*((to, before, ago - emitted) for to, before, ago in going), (bpe.ROOT, last, 0))
        to = self.number.get(entry)
        if to is None:
            to = self.number[entry] = len(self.states)
            self.states.append(entry)
            self.steps.append({})
        self.steps[state][byte] = to, emitted
        return to, emitted

    def key(self, state: int) -> str:
        """What a state is called outside this worker: its entries."""
        return START_KEY if state == START else ";".join(f"{at},{'' if last is None else last},{ago}" for at, last, ago in self.states[state])

    def state(self, key: str) -> int:
        if key == START_KEY:
            return START
        parts = (e.split(",") for e in key.split(";"))
        entry = tuple((int(at), int(last) if last else None, int(ago)) for at, last, ago in parts)
        to = self.number.get(entry)
        if to is None:
            to = self.number[entry] = len(self.states)
            self.states.append(entry)
            self.steps.append({})
        return to

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """The state after a text, and the tokens between."""
        total = 0
        for byte in text:
            state, emitted = self.step(state, byte)
            total += emitted
        return state, total

    def count(self, word: bytes) -> int:
        if len(self.states) > KEEP_STATES:
            self.reset()
        return self.run(START, word)[1]

    def led_to(self, lead: str) -> set[int]:
        """The states after a text, from START at each of its characters."""
        states: set[int] = set()
        for c in lead:
            states.add(START)
            for byte in c.encode():
                states = {self.step(q, byte)[0] for q in states}
        return states

    def run_all(self, states: set[int], text: bytes) -> dict[int, tuple[int, int]]:
        """`run` from several states at once; those that meet go on as one."""
        met: dict[int, list[tuple[int, int]]] = {q: [(q, 0)] for q in states}
        for k, byte in enumerate(text):
            if len(met) == 1:
                (q, origins), = met.items()
                to, n = self.run(q, text[k:])
                return {o: (to, m + n) for o, m in origins}
            after: dict[int, list[tuple[int, int]]] = {}
            for q, origins in met.items():
                to, emitted = self.step(q, byte)
                after.setdefault(to, []).extend((o, m + emitted) for o, m in origins)
            met = after
        return {o: (q, m) for q, origins in met.items() for o, m in origins}


class TokenCounter:
    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.stretches: dict[str, int] = {}
        self.kept_chars = 0
        names = sorted(self.transducer.model.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.names = names

    def stretch(self, s: str) -> int:
        known = self.stretches.get(s)
        if known is None:
            known = sum(self.transducer.count(w.encode()) for w in PRE_TOKEN.findall(s))
            if len(s) <= LONGEST_KEPT:
                if self.kept_chars > KEEP_CHARS:
                    self.stretches.clear()
                    self.kept_chars = 0
                self.stretches[s] = known
                self.kept_chars += len(s)
        return known

    def closed(self, text: str) -> int:
        """Tokens of a text that starts and ends at places where all states become START."""
        parts = STRETCH.findall(text)
        try:
            return sum(map(self.stretches.__getitem__, parts))
        except KeyError:
            return sum(map(self.stretch, parts))

    def parts(self, text: str) -> list[str]:
        """The text between special strings, which are one token each, as the tokenizers library has it by default."""
        return self.special.split(text) if self.special and "<|" in text else [text]

    def state_map(self, chunk: str, lead: str = "", goes_on: bool = False) -> list[StateMapEntry]:
        """(state before, state after, tokens between) for the states that can stand before a chunk: START, or those that `lead` leads to where the chunk begins within a word. `goes_on`: it ends within one."""
        parts = self.parts(chunk)
        if not lead and not goes_on:
            return [(START_KEY, START_KEY, len(parts) - 1 + sum(map(self.closed, parts)))]
        t = self.transducer
        if len(t.states) > KEEP_STATES:
            t.reset()
        head = PRE_TOKEN.match(parts[0]).group() if lead else ""
        befores = t.led_to(lead) if lead else {START}
        if goes_on and head == chunk:
            return [(t.key(q), t.key(to), n) for q, (to, n) in t.run_all(befores, chunk.encode()).items()]
        words = [PRE_TOKEN.findall(p) for p in [parts[0][len(head) :], *parts[1:]]]
        tail = words[-1].pop() if goes_on else ""
        after, in_tail = t.run(START, tail.encode())
        n = len(parts) - 1 + in_tail + sum(t.run(START, w.encode())[1] for ws in words for w in ws)
        return [(t.key(q), t.key(after), in_head + n) for q, (_, in_head) in t.run_all(befores, head.encode()).items()]

    def pieces(self, text: str, chunk_chars: int) -> Iterator[tuple[str, str, bool]]:
        """(chunk, lead, goes_on): about so many characters each, cut before white space if a chunk's length has such a place, else within a run."""
        at, lead = 0, ""
        while at < len(text):
            to, goes_on = self.next_cut(text, at + chunk_chars, chunk_chars)
            yield text[at:to], lead, goes_on
            lead = text[max(at, to - LEAD) : to] if goes_on else ""
            at = to
        if not text:
            yield "", "", False

    def next_cut(self, text: str, after: int, within: int) -> tuple[int, bool]:
        """The first place from `after` on that a cut may be laid at, and whether it parts a word."""
        white = BEFORE_WHITE.search(text, after, min(after + within, len(text)) + 1)
        if white:
            return white.start(), False
        for m in WITHIN.finditer(text, after):
            k = m.start()
            if not any(name in text[max(0, k - len(name) + 1) : k + len(name) - 1] for name in self.names):
                white = BEFORE_WHITE.search(text, after, k)
                return (white.start(), False) if white else (k, True)
        white = BEFORE_WHITE.search(text, after)
        return (white.start(), False) if white else (len(text), False)


StateMapEntry = tuple[str, str, int]


def compose(a: list[StateMapEntry], b: list[StateMapEntry]) -> list[StateMapEntry]:
    """The map of two chunks, one after the other; states that the second lacks are lost."""
    after = {q: (to, n) for q, to, n in b}
    return [(q, after[mid][0], n + after[mid][1]) for q, mid, n in a if mid in after]


def scanned(maps: Iterable[list[StateMapEntry]]) -> list[StateMapEntry]:
    return reduce(compose, maps)


def cut(text: Column, chunk_chars: int = CHUNK_CHARS) -> Column:
    """The text in chunks that end before white space or at the end: so many characters, and on to the next such place."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_chars}}}[{WHITE}]*[^{WHITE}]*"), F.lit(0))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One for each Python worker, kept between tasks."""
    return TokenCounter(path)


_ENTRY = ("before", "after", "n")
_MAP = "array<struct<before: string, after: string, n: bigint>>"


def _rows(entries: list[StateMapEntry]) -> list[dict]:
    return [dict(zip(_ENTRY, e)) for e in entries]


def _entries(rows: list[dict]) -> list[StateMapEntry]:
    return [tuple(r[k] for k in _ENTRY) for r in rows]


def _in_tasks(rows: DataFrame, path: str | None, chunk_chars: int, schema) -> DataFrame:
    """Texts whose cuts all lie before white space: a text's chunks follow each other in one task, which composes their maps as they come."""
    pieces = rows.withColumn("pieces", cut(F.col("text"), chunk_chars))
    chunks = pieces.select("id", "n_bytes", (F.size("pieces") - 1).alias("last"), F.posexplode_outer("pieces").alias("chunk", "piece"))

    def start():
        state_map, done = counter(path or public_tokenizer("byte_bpe_50k.json")).state_map, None

        def maps(ids, sizes, lasts, numbers, texts):
            nonlocal done
            for i, size, last, number, piece in zip(ids, sizes, lasts, numbers, texts):
                own = state_map(piece or "")
                done = compose(done, own) if number else own
                if (number or 0) >= last:
                    yield i, size, done[0][2]

        return maps

    return map_rows(chunks, ["id", "n_bytes", "last", "chunk", "piece"], schema, start)


def _over_tasks(rows: DataFrame, path: str | None, chunk_chars: int, schema) -> DataFrame:
    """Texts with long runs: their chunks are dealt to all tasks, and the maps composed in groups of FAN, then of the groups."""
    kind = schema["id"].dataType.simpleString()
    own = lambda: counter(path or public_tokenizer("byte_bpe_50k.json"))

    def start_cut():
        pieces = own().pieces
        return lambda *columns: ((*keys, k, *p) for *keys, text in zip(*columns) for k, p in enumerate(pieces(text, chunk_chars)))

    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    pieces = map_rows(keyed, ["id", "n_bytes", "row", "text"], schema_of(f"id {kind}, n_bytes bigint, row bigint, chunk int, piece string, lead string, goes_on boolean"), start_cut)
    # written before they are dealt by row, so that a repeated task cannot number texts anew
    chunks = staged(pieces, "token-chunks").repartition("row", "chunk")

    def start_maps():
        state_map = own().state_map
        return lambda *columns: ((*keys, _rows(state_map(piece, lead, goes_on))) for *keys, piece, lead, goes_on in zip(*columns))

    def start_scan():
        return lambda *columns: ((*keys, _rows(scanned(_entries(m["map"]) for m in maps))) for *keys, maps in zip(*columns))

    maps = map_rows(chunks, ["id", "n_bytes", "row", "chunk", "piece", "lead", "goes_on"], schema_of(f"id {kind}, n_bytes bigint, row bigint, chunk int, map {_MAP}"), start_maps)
    for size in (FAN, None):
        group = F.floor(F.col("chunk") / size).cast("int") if size else F.lit(0)
        lists = maps.groupBy("row", group.alias("chunk")).agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct(F.col("chunk").alias("at"), "map"))).alias("maps"))
        maps = map_rows(lists, ["id", "n_bytes", "row", "chunk", "maps"], schema_of(f"id {kind}, n_bytes bigint, row bigint, chunk int, map {_MAP}"), start_scan)
    maps = staged(maps, "token-maps")
    found = maps.filter(F.size("map") > 0).select("id", "n_bytes", F.get("map", F.lit(0))["n"].alias("n_tokens"))

    def start_whole():
        state_map = own().state_map
        return lambda ids, sizes, texts: ((i, size, state_map("".join(p["piece"] for p in t))[0][2]) for i, size, t in zip(ids, sizes, texts))

    missing = maps.filter(F.size("map") == 0).select("row")
    whole = chunks.join(missing, "row", "left_semi").groupBy("row").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("chunk", "piece"))).alias("texts"))
    return found.unionByName(map_rows(whole, ["id", "n_bytes", "texts"], schema, start_whole))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, tokenizer: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. Only the chunks of texts with a run of `chunk_chars` characters without white space are shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = schema_of(f"id {id_type(df, id_col)}, n_bytes bigint, n_tokens bigint")
    # looked for from the beginnings of runs only, so in one pass
    runs = F.col("text").rlike(f"(?:^|[{WHITE}])[^{WHITE}]{{{chunk_chars}}}")
    counted = _in_tasks(rows.filter(~runs), tokenizer, chunk_chars, schema).unionByName(_over_tasks(rows.filter(runs), tokenizer, chunk_chars, schema))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
