"""Personal data: overlapping candidates scored by boosted trees.

Four checked patterns give the base spans, which always stay. High-recall generators
propose further, overlapping spans: runs of digits and separators, address-like words,
spelt-out addresses and account numbers. Boosted trees see each candidate's format and
context. They learn from all candidates that the checks settle, wherever these lie, and rate the others. 1: a
valid checksum, parts in range, a plausible number of digits, an account number whose
remainder modulo 97 is 1, a spelt-out address that reads as one when rewritten, a
national phone or social security number with its parts in range. 0: a
failed check of what can be nothing else, so never a run of as many digits as a phone
number has, and dates. A candidate above its generator's threshold, calibrated on
held-out candidates (on those of all generators where its own has none), is added as a
span of kind `likely` if no better span overlaps it.

Defined cases: a null text is the empty text and has no spans; repeated rows and ids are
scanned each for itself; without settled candidates of both classes nothing is added;
candidates of one score are taken in the order in which they stand; texts are scanned
whole, and a candidate may be as long as it is; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import boosting
from larder.llm.common import Cover, id_type, map_rows, schema_of, staged

#: Fixed values of the base patterns, and the order in which spans with one start are listed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # digits that fail at their start fail everywhere
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "likely")

GENERATORS = (
    ("digits", re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20().-]{5,}[0-9](?![0-9A-Za-z])")),
    ("address", re.compile(r"(?<![^\s<(\"'])[^\s@<>()\"']+@[^\s@<>()\"']+")),
    ("spelt", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20\[(]{1,3}at[\x20\])]{1,3}[A-Za-z0-9-]{1,63}(?:[\x20\[(]{1,3}dot[\x20\])]{1,3}[A-Za-z0-9-]{1,63})+")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
)
CONTEXT = ("phone", "tel", "call", "fax", "card", "visa", "pay", "ip", "host", "mail", "contact", "account", "iban", "id", "order", "version")
AT, DOT = re.compile(r"[\x20\[(]{1,3}at[\x20\])]{1,3}"), re.compile(r"[\x20\[(]{1,3}dot[\x20\])]{1,3}")
ADDRESS = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-.\x20](?:0?[1-9]|1[0-2])[-.\x20](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-.\x20](?:0?[1-9]|[12][0-9]|3[01])[-.\x20](?:19|20)[0-9]{2}")
#: Phone and social security numbers without a country code, parts in range.
NATIONAL = re.compile(r"(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[-.\x20])[2-9][0-9]{2}[-.\x20][0-9]{4}|(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
DIGITS, SPELT, ACCOUNT = 0, 2, 3

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _checked(text: str) -> list[tuple[int, str, int, bool]]:
    """All matches of the base patterns: start, kind, end, passed."""
    out = []
    at = text.find("@")
    free = 0  # where the last address ended
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, "email", m.end(), True))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        out.append((m.start(), "ip", m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 7:
            out.append((m.start(), "card", m.end(), 12 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((m.start(), "phone", m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def base_spans(text: str) -> list[Span]:
    return [(a, k, z) for a, k, z, ok in _checked(text) if ok]


def account_valid(s: str) -> bool:
    """The check of account numbers: country and check digits moved to the end, letters as numbers, 1 modulo 97."""
    s = s.replace("\x20", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_length(s: str) -> int:
    """Characters of the longest valid account number of whole groups at the start, all where there is none: a word in capitals may follow."""
    return next((n for n in range(len(s), 0, -1) if (n == len(s) or s[n] == "\x20") and account_valid(s[:n])), len(s))


def own_check(s: str, generator: int) -> int | None:
    """1 or 0 for spelt-out addresses and account numbers, 1 for national numbers and 0 for dates among the digits, None for other candidates."""
    if generator == DIGITS:
        return 1 if NATIONAL.fullmatch(s) else 0 if DATE.fullmatch(s) else None
    if generator == SPELT:
        return int(ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", s, count=1))) is not None)
    return int(account_valid(s)) if generator == ACCOUNT else None


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all candidates; they may overlap."""
    out = []
    for g, (name, pattern) in enumerate(GENERATORS):
        if (name == "address" and "@" not in text) or (name == "spelt" and "dot" not in text):
            continue
        for m in pattern.finditer(text):
            if name != "digits" or sum(c.isdigit() for c in m[0]) >= 7:
                out.append((m.start(), m.start() + account_length(m[0]) if name == "account" else m.end(), g))
    return out


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    digits = "".join(c for c in s if c.isdigit() and c.isascii())
    groups = [len(x) for x in re.split(r"[^0-9]+", s) if x] or [0]
    dots = s.split(".")
    before = text[max(0, start - 40) : start].lower()
    around = (text[start - 1] if start else " ", text[end] if end < len(text) else " ")
    return [
        len(s), len(digits), len(groups), max(groups), min(groups), s.count("."), s.count("-"), s.count(" "), s.count("("), float(s[:1] == "+"), s.count("@"),
        sum(c.isalpha() for c in s), sum(c.isupper() for c in s), len(set(digits)), float(bool(digits) and luhn(digits)),
        float(len(dots) == 4 and all(d.isascii() and d.isdigit() and int(d[:9]) <= 255 for d in dots)), float(s[:1] == "0"),
        float(around[0].isalnum()), float(around[1].isalnum()), float(around[0] in "\"'=:"), *(float(generator == g) for g in range(len(GENERATORS))), *(float(w in before) for w in CONTEXT), float(own_check(s, generator) or 0), float(DATE.fullmatch(s) is not None),
    ]


def failed(s: str, kind: str) -> bool:
    """Is a span whose check failed surely none of the other kinds? As many digits as a phone number has may be one, and a long run with separators several."""
    n = sum(c.isdigit() for c in s)
    if kind == "phone":
        return n < 9 or s[1:].isdigit()
    if kind == "card":
        return 15 < n <= 19 or (n > 19 and s.isdigit())
    return not 7 <= n <= 15


def settled(text: str) -> list[tuple[int, int, int, int | None]]:
    """Candidates with their label: 1 or 0 where a check has settled that very span, else None. A failed span that overlaps a passed one is not settled."""
    found = {(a, z): g for a, z, g in reversed(proposals(text))}
    own = {(a, z): c for (a, z), g in found.items() if (c := own_check(text[a:z], g)) is not None}
    checked = _checked(text)
    passed = sorted({(a, z) for a, _, z, ok in checked if ok} | {at for at, c in own.items() if c})
    checks: dict[tuple[int, int], int | None] = {(a, z): 0 for a, _, z, ok in checked if not ok}
    for a, kind, z, ok in checked:
        if not ok and not failed(text[a:z], kind):
            checks[a, z] = None
    checks |= {at: 0 for at, c in own.items() if not c}
    ends = list(accumulate((z for _, z in passed), max))
    for a, z in checks:
        k = bisect_left(passed, (z, 0))  # those that start before z
        if k and ends[k - 1] > a:
            checks[a, z] = None
    checks |= dict.fromkeys(passed, 1)
    for a, z in checks:
        found.setdefault((a, z), 1 if "@" in text[a:z] else 0)
    return [(a, z, g, checks.get((a, z))) for (a, z), g in sorted(found.items())]


def fit_candidates(df: DataFrame, text_col: str = "text") -> dict | None:
    """Trees and each generator's threshold from all distinct settled candidates of all texts, a fourth of them, by hash, held out for the thresholds; None where one class is missing."""

    def start():
        def rows(texts):
            for t in texts:
                for a, z, g, label in settled(t) if t else ():
                    if label is not None:
                        yield label, g, t[a:z], [float(v) for v in features(t, a, z, g)]

        return rows

    found = map_rows(df, [text_col], schema_of("label int, generator int, shown string, x array<double>"), start).distinct()
    held = F.pmod(F.xxhash64("shown", "x"), F.lit(4)) == 0
    found = staged(found.select("label", "generator", held.alias("held"), "x"), "pii-candidates")
    rows, cuts = boosting.binned(found, len(features("", 0, 0, 0)), "NOT held")
    model = boosting.fit_table(rows.filter("NOT held"), cuts)
    if model is None:
        return None
    counts = boosting.score_counts(rows.filter("held"), model, "generator")
    every = [c for own in counts.values() for c in own]
    own = [np.array(counts.get(g) or every, float).reshape(-1, 3) for g in range(len(GENERATORS))]
    model["least"] = [min(_least(c), 1e300) for c in own]
    return model


def _least(counts: np.ndarray) -> float:
    """The threshold by (score, rows, rows with label 1); equal scores of several generators are one."""
    scores, place = np.unique(counts[:, 0], return_inverse=True)
    return boosting.calibrate(scores, np.bincount(place, counts[:, 2], len(scores)), n=np.bincount(place, counts[:, 1], len(scores)))


def scan_batch(texts: list[str], model: dict | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the candidates of all texts are scored at once."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if model:
        at, x = [], []
        for k, t in enumerate(texts):
            taken = Cover((b, e) for b, _, e in base[k])
            for a, z, g in proposals(t):
                if not taken.meets(a, z):
                    at.append((k, a, z, g))
                    x.append(features(t, a, z, g))
        if x:
            scores, chosen = boosting.predict(model, np.array(x, float)), [Cover() for _ in texts]
            for j in np.argsort(-scores, kind="stable"):
                k, a, z, g = at[j]
                if scores[j] >= model["least"][g] and not chosen[k].meets(a, z):
                    chosen[k].add(a, z)
                    added[k].append((a, "likely", z))
    return [(b, sorted(b + m, key=lambda s: (s[0], KINDS.index(s[1])))) for b, m in zip(base, added)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base spans, all spans) of every row; spans are (start, kind, end) in code points."""
    model = fit_candidates(df, text_col)

    def start():
        dicts = lambda spans: [{"start": a, "kind": k, "end": z} for a, k, z in spans]
        return lambda ids, texts: ((i, dicts(b), dicts(s)) for i, (b, s) in zip(ids, scan_batch([t or "" for t in texts], model)))

    span = "array<struct<start: bigint, kind: string, end: bigint>>"
    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, base {span}, spans {span}"), start)


def pii_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, the digest of their list and the list of all spans."""
    model = fit_candidates(df, text_col)

    def start():
        def rows(ids, texts):
            for i, (base, spans) in zip(ids, scan_batch([t or "" for t in texts], model)):
                kinds = [k for _, k, _ in base]
                yield (i, *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))

        return rows

    return map_rows(df, [id_col, text_col], schema_of(f"{id_col} {id_type(df, id_col)}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"), start)
