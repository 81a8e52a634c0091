"""Toxicity by weak supervision.

Many voters look at each text: word lists of several kinds and languages, patterns, and
lists learnt from labelled rows (words and word beginnings far commoner in toxic texts,
dealt into several voters). How often each set of votes occurs in the whole corpus is
counted by Spark; from these counts a generative model estimates by expectation and
maximisation each voter's rates in toxic and other texts and how far voters err
together; correlated voters share their weight. Its posterior labels, of a bounded
sample, train a linear classifier on the texts, which scores every document.

Labels are learnt only from rows whose crc32 of the id, as text, leaves a remainder
other than 2 by 4; labels, language, source and id never are inputs of a score.

Defined cases: a null or empty text gets no votes and is scored by the bias alone; null
labels are not learnt from; without labels the fixed lists vote alone; of a repeated id
one text is learnt from, the smallest, and all rows are scored each for itself; ties of
the samples' hashes go by id; long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import hashed_linear
from larder.llm.common import Kept, crc_mod, filter_rows, map_rows, schema_of, staged
from larder.llm.hashed_linear import words_and_prefixes
from larder.llm.quality_classifier import labelled_sample

#: Word lists of the fixed voters, by what they express.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile fool foolish dimwit dunce idiota idiotas estupido estúpido imbécil tonto idiotisch dumm dummkopf trottel crétin stupide débile abruti",
    "contempt": "loser losers pathetic worthless useless failure miserable inútil patético fracasado wertlos versager erbärmlich minable nul pathétique raté",
    "disgust": "trash garbage scum filth filthy disgusting vermin sickening vile basura asqueroso escoria abschaum müll ekelhaft dreck ordure déchet dégoûtant racaille",
    "ridicule": "clown clowns joke freak weirdo creep payaso ridículo witzfigur spinner bouffon ridicule",
    "insult": "bastard jerk asshole bitch slut whore cabrón puta mierda arschloch schlampe hurensohn salope connard putain",
    "threat": "kill murder hurt destroy hang burn stab matar morir töten sterben umbringen tuer mourir",
    "hate": "hate despise detest loathe odio odiar hasse hassen verachte haine haïr déteste",
}
PATTERNS = (re.compile(r"\byou(?:'re| are| were)?\s+(?:all\s+|just\s+|such\s+)?an?\s+\w+"), re.compile(r"\b(?:shut up|go away|get lost|drop dead|nobody likes)\b"))
#: What a text must contain for a pattern to match.
PATTERN_SIGNS = (("you",), ("shut up", "go away", "get lost", "drop dead", "nobody likes"))
LEARNT_VOTERS = 8
#: Bounds: labelled rows and units of the learnt lists, documents of either posterior class that train the classifier.
LABELLED_ROWS = 6000
CANDIDATE_UNITS = 20000
LEARNT_UNITS = 400
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 5000


def repeated(units: Counter) -> list[str]:
    """The units, and those that occur at least twice or three times marked so."""
    return [*units, *(f"{u}*2" for u, n in units.items() if n >= 2), *(f"{u}*3" for u, n in units.items() if n >= 3)]


def _unit_counts(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """In how many of the texts each unit occurs, counted in shards of the bounded sample."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for t in pdf["text"]:
            units = repeated(Counter(u for c in (t or "").split() for u in words_and_prefixes(c)))
            seen.update(units if among is None else among.intersection(units))
        return pd.DataFrame({"unit": pd.Series(list(seen), dtype=object), "texts": pd.Series(list(seen.values()), dtype="int64")})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(64)))
    return sharded.groupBy("shard").applyInPandas(count, "unit string, texts long").groupBy("unit").agg(F.sum("texts").alias("texts"))


def learn_units(sample: DataFrame) -> list[str]:
    """Words and word beginnings whose share of toxic texts is far above that of others: at most LEARNT_UNITS. First the units of toxic texts are counted, then the commonest CANDIDATE_UNITS of them in the others."""
    sample = staged(sample.select("id", "text", "y"), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1.0) or not n.get(0.0):
        return []
    common = _unit_counts(sample.filter("y = 1")).filter((F.col("texts") >= 4) & (F.length("unit") >= 4)).orderBy(F.col("texts").desc(), "unit").limit(CANDIDATE_UNITS)
    toxic = {r["unit"]: r["texts"] for r in common.collect()}
    clean = {r["unit"]: r["texts"] for r in _unit_counts(sample.filter("y = 0"), frozenset(toxic)).collect()}  # CANDIDATE_UNITS at most
    lift = {u: (t / n[1.0]) / ((clean.get(u, 0) + 0.5) / n[0.0]) for u, t in toxic.items()}
    best = sorted((u for u in toxic if lift[u] >= 20), key=lambda u: (-toxic[u] * np.log(lift[u]), u))
    return best[:LEARNT_UNITS]


class Voters:
    """The votes of a text as bits."""

    def __init__(self, learnt: list[str]):
        self.units: dict[str, int] = {}
        for bit, words in enumerate(LEXICONS.values()):
            for w in words.split():
                self.units[w] = self.units.get(w, 0) | 1 << bit
        first = len(LEXICONS)
        for k, u in enumerate(learnt):  # neighbours in rank go to different voters
            self.units[u] = self.units.get(u, 0) | 1 << first + k % LEARNT_VOTERS
        self.first_pattern = first + LEARNT_VOTERS
        self.count = self.first_pattern + len(PATTERNS)
        self.bases = {u.removesuffix("*2").removesuffix("*3") for u in self.units}
        self.known = Kept(lambda c: tuple(u for u in words_and_prefixes(c) if u in self.bases))  # the units of a chunk that any list knows; mostly none

    def votes(self, text: str) -> int:
        known = self.known
        bits = 0
        for u in repeated(Counter([u for c in text.split() if (x := known[c]) for u in x])):
            bits |= self.units.get(u, 0)
        low = text.lower()
        for k, (pattern, sign) in enumerate(zip(PATTERNS, PATTERN_SIGNS)):
            if any(s in low for s in sign):
                bits |= bool(pattern.search(low)) << self.first_pattern + k
        return bits


@lru_cache(maxsize=2)
def voters(learnt: tuple[str, ...]) -> Voters:
    """One for each Python worker and learnt list, kept between tasks."""
    return Voters(list(learnt))


def label_model(patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray, voters: int, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of each vote pattern, and what was estimated.

    `patterns` are bit sets, `counts` how many texts show each, `labelled[:, y]` how many
    rows with a known label y do. Rates of each voter given the class come from
    expectation and maximisation; a voter's log-odds are divided by the number of voters
    it errs together with, from correlations within the classes.
    """
    votes = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
    free = np.maximum(counts - labelled.sum(axis=1), 0)
    post = np.where(votes.sum(axis=1) >= 2, 0.9, np.where(votes.sum(axis=1) == 1, 0.3, 0.02))
    share = np.ones(voters)
    correlation = np.zeros((voters, voters))
    for k in range(rounds):
        mass = np.stack([free * (1 - post) + labelled[:, 0], free * post + labelled[:, 1]])
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        rates = (mass @ votes + np.array([[0.01], [0.5]])) / (mass.sum(axis=1)[:, None] + 1)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        if k % 10 == 9:
            correlation = np.zeros((voters, voters))
            for y in (0, 1):
                off = votes - rates[y]
                cov = (off * mass[y][:, None]).T @ off / max(mass[y].sum(), 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                correlation = np.maximum(correlation, np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0))
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + np.where(correlation > 0.2, correlation, 0).sum(axis=1))
        ratio = np.where(votes > 0, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior[1] / prior[0]) + ratio @ share, -30, 30)))
    return post, {"prior": prior, "rates": rates, "correlation": correlation, "share": share}


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the linear classifier."""
    learnable = crc_mod(id_col, 4) != 2
    learnt = learn_units(labelled_sample(docs, labels, "toxic", learnable, LABELLED_ROWS, id_col, text_col))

    def start():
        votes = voters(tuple(learnt)).votes
        return lambda ids, texts: ((i, votes(t) if t else 0) for i, t in zip(ids, texts))

    voted = staged(map_rows(docs, [id_col, text_col], schema_of("id bigint, votes bigint"), start), "toxic-votes")
    known = labels.filter(learnable & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("y"))
    seen = voted.groupBy("votes").agg(F.count("*").alias("n"))
    told = voted.join(known, "id").groupBy("votes").agg(F.sum("y").alias("ones"), F.count("*").alias("rows"))
    # a row for each set of votes that occurs, 2 ** voters at most
    rows = sorted(seen.join(told, "votes", "left").select("votes", "n", F.coalesce("ones", F.lit(0)).alias("ones"), F.coalesce("rows", F.lit(0)).alias("rows")).collect())
    if not rows:
        return np.zeros(hashed_linear.BUCKETS, np.float32)
    table = np.array(rows, np.int64)
    post, _ = label_model(table[:, 0], table[:, 1].astype(float), np.stack([table[:, 3] - table[:, 2], table[:, 2]], axis=1).astype(float), Voters(learnt).count)
    # so few rows: each set of votes once
    believed = docs.sparkSession.createDataFrame([(int(v), float(p)) for v, p in zip(table[:, 0], post)], "votes long, y double")
    marked = voted.join(F.broadcast(believed), "votes").filter((F.col("y") >= 0.8) | (F.col("y") <= 0.2))
    chosen = []
    for is_toxic, most in ((True, TRAIN_TOXIC), (False, TRAIN_CLEAN)):
        chosen.append(marked.filter((F.col("y") >= 0.8) == is_toxic).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(most))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1]).groupBy("id").agg(F.max("y").alias("y"))), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text"))  # one text of an id
    return hashed_linear.train(sample.withColumn("w", F.when(F.col("y") > 0.5, 2.0).otherwise(1.0)), "presence", epochs=8, alpha=1.0, l1=6.0, l1_per_row=0.004, l2=0.0)


def score_toxicity(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = hashed_linear.score(docs, weights, "presence", id_col, text_col)
    held = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with their columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4 * BUCKETS bytes

    def start():
        score = hashed_linear.scorer(sent.value, "presence")
        return lambda t: score(t or "") < threshold

    return filter_rows(docs, text_col, start)
