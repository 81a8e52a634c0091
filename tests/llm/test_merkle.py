"""Manifests against plain trees built over whole lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from larder.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """The root over the nodes, and each node's list of (before, after)."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for o in owners[at + k]:
                    paths[o].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            above_owners.append([o for own in owners[at : at + 16] for o in own])
        nodes, owners = above, above_owners
    return nodes[0], paths


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = mine, *climb([leaf_of(*r) for r in mine])
    root, upper = climb([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, upper):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            x = leaf_of(*r[:4], text)
            for before, after in path + up:
                x = sha(before + x + after)
            out.append((r[0], leaf_of(*r), subroot, root, sha("".join(b + a for b, a in path + up)), x, x == root))
    return out


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), merkle.lower_case_tampering())
    ours = sorted((tuple(r)[:7] for r in got.collect()), key=repr)
    assert ours == sorted(plain(rows), key=repr)
    return ours


@pytest.mark.parametrize("counts", [(1,), (1, 1), (16, 17), (256, 257, 1), (300, 15, 4200)])
def test_as_plain_trees(spark, counts):
    rng = random.Random(sum(counts))
    ids = rng.sample(range(100_000), sum(counts))
    rows = [(ids.pop(), f"s{s}", rng.choice(["en", None]), rng.randrange(9), rng.choice(["Some Text", "plain", "", None, "Ünï 漢"])) for s, n in enumerate(counts) for _ in range(n)]
    ours = check(spark, rows)
    if sum(counts) > 100:
        assert {r[6] for r in ours} == {True, False}


def test_more_than_one_round(spark, monkeypatch):
    """Blocks of 16 leaves: a tree of 5,000 takes four rounds."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    block, levels = 16, [merkle.levels_of(n) for n in (1, 2, 16, 17, 5000)]
    assert levels == [0, 1, 1, 1, 1] and block == merkle.BLOCK
    nodes = [sha(str(k)) for k in range(600)]
    root, paths = climb(nodes)
    rounds, own = nodes, [[] for _ in nodes]
    owners = [[k] for k in range(len(nodes))]
    while len(rounds) > 1:
        grown = [merkle.grown(rounds[at : at + 16], len(rounds)) for at in range(0, len(rounds), 16)]
        for b, g in enumerate(grown):
            for k, w in enumerate(g.witness):
                for o in owners[b * 16 + k]:
                    own[o] += w
        owners = [[o for mine in owners[at : at + 16] for o in mine] for at in range(0, len(rounds), 16)]
        rounds = [g.root for g in grown]
    assert (rounds[0], own) == (root, paths)


def test_many_sources_nulls_ties_and_repeats(spark):
    rows = [(k % 40, None if k % 7 == 0 else f"src{k % 290}", None, None, f"T{k % 11}") for k in range(900)]
    rows += [(None, "ß", "x", 3, None)] * 3 + [(5, None, "x", 3, "A")] * 20 + [(6, "", None, 0, "")]
    check(spark, rows)


def test_appending_extends_partial_witnesses():
    block = merkle.Appender(2)
    for k in range(20):
        block.append(sha(str(k)))
    assert [len(w) for w in block.witness] == [1] * 16 + [0] * 4  # the open run's leaves wait for their siblings
    block.finish()
    assert all(len(w) == 2 for w in block.witness)
    assert all(merkle.fold(sha(str(k)), w) == block.root for k, w in enumerate(block.witness))


def test_clashing_columns_and_empty_tables(spark, docs, empty):
    got = merkle.manifest(docs, merkle.lower_case_tampering())
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == sorted(plain(rows), key=repr)
    assert merkle.manifest(empty).count() == 0
    assert merkle.manifest(docs).where(~F.col("verified")).count() == 0
