import collections
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import fingerprints, hashed_linear, near_dedup, quality_classifier, quality_rules, toxicity

SF = "/root/testdata/sf0.001"


def sets_of(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def plain_components(ids, texts, size, percent=80):
    sets, parent = sets_of(texts, size), {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((top(i), top(j)))
            parent[high] = low
    return {i: top(i) for i in ids}, dict(zip(ids, map(len, sets)))


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for group, copies in enumerate([1, 1, 2, 3, 40, 12]):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, len(base) // 12])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((k, " ".join(text)))
            k += 1
    return rows + [(k, ""), (k + 1, None), (k + 2, "One"), (k + 3, "one"), (k + 4, "  ")]


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_duplicates_are_all_found(spark, seed, size):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"c": F.lit(1), "label": F.lit("x"), "first_id": F.lit(0)})
    want, sizes = plain_components([i for i, _ in rows], [t for _, t in rows], size)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, size=size).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sorted(r["doc_id"] for r in near_dedup.keep_first(df, size=size).collect()) == sorted(i for i, c in want.items() if i == c)


def test_near_duplicates_of_many_unlinked_members(spark, monkeypatch):
    """A key with many components goes through block rounds; every link must still be found."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "GROW", 3)
    base = [f"b{k}" for k in range(100)]
    rows = [(k, " ".join(base[:88] + [f"x{k // 3}y{j}" for j in range(12)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = plain_components([i for i, _ in rows], [t for _, t in rows], 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, size=2).collect()} == want


def test_near_duplicates_of_odd_rows(docs, empty):
    assert near_dedup.near_duplicates(empty).collect() == []
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[1] == by[5] == {1} and by[2] == {2} and by[3] == {3}
    assert near_dedup.keep_first(docs).columns == docs.columns


def test_one_row_of_each_component_stays(spark):
    """Repeated ids with equal and with different texts, and null ids."""
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(60)) for w in "abcd")
    near = d.replace("d30", "x")
    rows = [(1, b, "s"), (5, a, "s"), (5, b, "s"), (6, a, "s"), (7, c, "s"), (7, c, "s"), (7, c, "t"), (None, a, "s"), (None, d, "s"), (None, near, "s"), (None, d, "s"), (8, None, "s"), (8, None, "s"), (None, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in near_dedup.keep_first(df).select("doc_id", "text").collect()]
    assert sorted(r for r in kept if r[0] and r[1]) == [(1, b), (5, a), (7, c)]
    assert sorted((str(r[1]) for r in kept if r[0] is None), key=len)[0] == "" and kept.count((8, None)) == 2
    assert sum(r[0] is None for r in kept) == 2 and sum(r[1] in (d, near) for r in kept) == 1
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(kept) == 7
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 5), (5, 1), (6, 5), (7, 7), (None, 5), (None, None), (8, 8)}


def test_band_chance():
    """Sets of similarity 0.8 share a key nearly always, unlike sets nearly never."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(60):
        both = rng.integers(0, 2**63, 160, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(np.r_[both, rng.integers(0, 2**63, 20).astype(np.uint64)]), np.unique(np.r_[both, rng.integers(0, 2**63, 20).astype(np.uint64)])
        x, y = near_dedup.band_values(a, 9, 2), near_dedup.band_values(b, 9, 2)
        found += any(p == q for p, q in zip(x[:9], y[:9])) and any(p == q for p, q in zip(x[9:], y[9:]))
    assert found == 60


words = st.lists(st.sampled_from("abcdefghij"), max_size=60)


@settings(max_examples=80, deadline=None)
@given(words, words, st.sampled_from([4, 64]))
def test_fingerprints_are_the_smallest_hashes(a, b, k):
    x, y = " ".join(a), " ".join(b)
    whole = lambda t: np.unique(fingerprints.shingle_hashes(fingerprints.WordHashes().of(t.encode().split()), 2))
    s, t = fingerprints.sketch(x, k, 2), fingerprints.sketch(y, k, 2)
    assert s.tolist() == whole(x)[:k].tolist()
    assert fingerprints.merge([s, t], k).tolist() == np.unique(np.r_[whole(x), whole(y)])[:k].tolist()
    assert fingerprints.from_text(fingerprints.to_text(s)).tolist() == s.tolist()
    if len(whole(x)) < k and len(whole(y)) < k:
        p, q = set(whole(x).tolist()), set(whole(y).tolist())
        assert fingerprints.resemblance(s, t, k) == (len(p & q) / len(p | q) if p and q else float(not p and not q))


def test_fingerprint_estimates():
    a, b = " ".join(f"x{k}" for k in range(4000)), " ".join(f"x{k}" for k in range(2000, 6000))
    s, t = fingerprints.sketch(a, 512), fingerprints.sketch(b, 512)
    assert abs(fingerprints.resemblance(s, t, 512) - 1 / 3) < 0.08
    assert abs(fingerprints.containment(s, t, 512) - 0.5) < 0.1
    assert abs(fingerprints.distinct(s, 512) / 3996 - 1) < 0.15


def test_fingerprint_queries(spark, docs, empty):
    import hashlib

    assert fingerprints.fingerprint_edits(empty).collect() == []
    own = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(own).collect()}
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in own.collect()), reverse=True)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert rows[i]["edited_fingerprint"] == fingerprints.to_text(fingerprints.sketch(e))
        assert rows[i]["near_next"] == fingerprints.resemblance(fingerprints.sketch(t), fingerprints.sketch(following))
    assert fingerprints.fingerprint_edits(docs).count() == docs.count()
    merged = fingerprints.merge_fingerprints(fingerprints.fingerprint_documents(docs, k=16).withColumn("all", F.lit(1)), ["all"], k=16).first()
    parts = [fingerprints.sketch(r["text"] or "", 16) for r in docs.collect()]
    assert fingerprints.from_text(merged["fingerprint"]).tolist() == fingerprints.merge(parts, 16).tolist()


def plain_measures(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if n[r] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_measures(spark, docs, empty):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "\n", "d# ", "é ", "😀", "\t"]) for _ in range(rng.randrange(80))) for _ in range(150)] + ["a b", "a b a b a b", "x", "\n\n", "a\na\na"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    for r in quality_rules.rule_verdicts(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_measures(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.rule_verdicts(empty).collect() == [] and quality_rules.rule_verdicts(docs).count() == docs.count()
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {6}


def prose(rng, n=80, size=(4, 5), symbols=0):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice(size)))
    return " ".join(word() + "#" * (k < symbols) for k in range(n))


def verdicts(spark, rows):
    return {r["doc_id"]: r["kept"] for r in quality_rules.rule_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


def test_quality_thresholds_adapt(spark):
    """Every language and source has limits of its own: what is usual in one is rejected in another."""
    rng = random.Random(7)
    form = lambda times: prose(rng, 300) + " one two three four" * times
    rows = [(k, prose(rng, 300, size=(4, 5) if k % 2 else (13, 14)), "en" if k % 2 else "xx", "s") for k in range(600)]
    rows += [(1000 + k, prose(rng, 300, symbols=rng.randrange(30, 60)), "en", "code") for k in range(300)]  # symbols are usual here
    rows += [(2000 + k, form(rng.randrange(10, 20)), "en", "forms") for k in range(300)]  # and repetitions here
    odd = [(5000, prose(rng, size=(13, 14)), "en", "s"), (5001, prose(rng, symbols=80), "xx", "rare"), (5002, prose(rng, 300, symbols=50), "en", "s"), (5003, prose(rng, 300, symbols=50), "en", "code")]
    odd += [(5004, form(30), "en", "s"), (5005, form(30), "en", "forms")]
    got = verdicts(spark, rows + odd)
    assert all(got[i] for i, *_ in rows)
    assert [got[5000 + k] for k in range(6)] == [False, False, False, True, False, True]


@pytest.mark.parametrize("junk", [30, 48])
def test_bad_sources_do_not_hide_themselves(spark, junk):
    """A source that holds most rows and is a third to nearly a half junk: the junk goes, the rest stays; and a lone row of a new source leans on the others."""
    rng = random.Random(junk)
    rows = [(k, prose(rng), "en", f"s{k % 3}") for k in range(90)]
    rows += [(1000 + k, prose(rng, symbols=rng.randrange(20, 60)) if k % 100 < junk else prose(rng), "en", "hot") for k in range(600)]
    rows += [(5000, prose(rng), "en", "new"), (5001, prose(rng, symbols=40), "en", "new"), (5002, prose(rng), None, None)]
    got = verdicts(spark, rows)
    assert all(got[k] for k in range(90)) and all(got[1000 + k] == (k % 100 >= junk) for k in range(600))
    assert got[5000] and not got[5001] and got[5002]


def test_good_documents_are_left_alone(spark):
    """Of the given tables' documents of good quality that the base rules pass, nearly all stay, and the bad ones go."""
    base = "/root/testdata/sf0.1"
    try:
        docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("the given tables are not here")
    judged = quality_rules.rule_verdicts(docs).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {r["quality"]: r["kept"] for r in judged.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_sketches_merge(spark):
    df = spark.createDataFrame([(k % 2, float(k)) for k in range(1000)], "g int, v double")
    s = quality_rules.sketch(df, ["g"], {"mean_word": F.col("v")})
    whole = quality_rules.sketch(df, [], {"mean_word": F.col("v")})
    merged = quality_rules.merge_sketches(s, [])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(map(tuple, whole.select(*merged.columns).collect()), key=str)
    found = quality_rules.quantiles(whole, []).first()
    assert found["rows"] == 1000 and all(abs(found[k] / v - 1) < 0.06 for k, v in (("low", 100), ("mid", 400), ("median", 500)))


def test_leader_and_scores(spark):
    model = hashed_linear.Leader()
    for _ in range(30):
        model.learn(*hashed_linear.vector("good words", "ngrams"), 1.0)
        model.learn(*hashed_linear.vector("bad !!! words", "ngrams"), 0.0)
    p = lambda t: float(model.at(hashed_linear.vector(t, "ngrams")[0]) @ hashed_linear.vector(t, "ngrams")[1])
    assert p("good") > 0 > p("bad !!!")
    rng = np.random.default_rng(1)
    w = np.where(rng.random(hashed_linear.BUCKETS) < 0.3, rng.normal(size=hashed_linear.BUCKETS), 0).astype(np.float32)
    sparse = hashed_linear.SparseScorer(w)
    for t in ("", "one two two three three three", "réeux réeuxpa réeuxment idiot"):
        at, x = hashed_linear.vector(t, "presence")
        assert abs(sparse.score(t) - 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))) < 1e-6


def test_label_model():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.1
    rate = {True: [0.8, 0.8, 0.6, 0.5], False: [0.01, 0.01, 0.05, 0.02]}
    v = np.stack([np.where(y, rng.random(len(y)) < rate[True][k], rng.random(len(y)) < rate[False][k]) for k in range(4)], axis=1)
    v = np.c_[v, v[:, 0]]  # a voter that only repeats another
    bits = (v * (1 << np.arange(5))).sum(axis=1)
    patterns, at, counts = np.unique(bits, return_inverse=True, return_counts=True)
    post, est = toxicity.label_model(patterns, counts.astype(float), np.zeros((len(patterns), 2)), 5)
    assert abs(est["prior"][1] - 0.1) < 0.02 and abs(est["rates"][1][2] - 0.6) < 0.08
    assert est["correlation"][0, 4] > 0.9 and est["share"][0] < 0.7 < est["share"][2]
    assert (((post > 0.5)[at]) == y).mean() > 0.97


def test_classifiers_on_odd_rows(spark, docs, labels, empty):
    for score, train in ((quality_classifier.score_quality, quality_classifier.train_quality), (toxicity.score_toxicity, toxicity.train_toxicity)):
        weights = train(docs, labels)
        rows = score(docs, weights).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert score(empty, weights).collect() == []
        assert not train(docs, labels.limit(0)).any() or score is toxicity.score_toxicity
        assert len(train(empty, labels)) == hashed_linear.BUCKETS
    assert toxicity.drop_toxic(docs, weights).columns == docs.columns


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    try:
        docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    except Exception:
        pytest.skip("the given tables are not here")
    q = quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels)).join(labels, "doc_id").filter("held_out")
    assert q.filter(F.col("predicted") == F.col("quality")).count() / q.count() > 0.98
    t = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out")
    assert t.filter(F.col("predicted") == F.col("toxic")).count() / t.count() > 0.97
    assert t.filter("predicted = 1 AND toxic = 1").count() / t.filter("toxic = 1").count() > 0.85
