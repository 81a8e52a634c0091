"""A Merkle manifest of a table: 16-ary hash trees per source, a tree over the sources, and a witness for every row.

Rows are appended in order to aligned blocks of 256 leaves. An `Appender` holds the open
runs of one block: a leaf starts with an empty witness, and whenever a run closes, every
leaf beneath it gets the digests that stand before and after its own subtree, and the
run's digest is appended one level up. A block's root is itself appended to the block of
the next round, so a tree of n leaves takes log256(n) rounds, each over 1/256 of the
rows of the one before; the subroots are one more such tree. A row's whole witness is its block's part, then the
parts of the blocks above, joined from the top down. So no tree, source or level is ever
in one task: a task sees blocks of at most 256 digests.

Order within a source is found by range partitions: each sorted range counts its rows per
source, and the ranges before it give its offset; a source of any size is spread out.

Defined cases: a null field is `-`, so it differs from an empty text; null ids come first
and are never tampered with; rows of one id are ordered by their digests, repeated rows
take places side by side (each with its own proof); a null source is a source of its own,
the first; a source of one row has that leaf as subroot, one source alone has its subroot
as root, the only row of a table has an empty proof; an empty table gives no rows; texts
are hashed whole; only the five hashed columns are read, so further columns may have any
names.
"""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import id_type, map_rows, schema_of, staged

FAN = 16
#: Levels of runs within a block, and the leaves that it then holds.
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
#: The hashed columns in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks that a Python worker holds as objects at a time; `map_rows` counts 64 bytes for each row without texts.
BLOCKS_AT_ONCE = 64 * 32


def levels_of(total: int) -> int:
    """How often the nodes of a tree are cut into runs within one block: until one remains or the block is full."""
    n, levels = min(total, BLOCK), 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """The open runs of a block, one for each level, and the witnesses of its leaves as far as they are known."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels)]
        self.witness: list[list[tuple[str, str]]] = []
        self.root: str | None = None

    def append(self, node: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, node, at, at + 1)

    def _add(self, level: int, node: str, first: int, end: int) -> None:
        if level == self.levels:
            self.root = node
            return
        self.open[level].append((node, first, end))
        if len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        whole, width = "".join(node for node, _, _ in run), len(run[0][0])
        for k, (_, first, end) in enumerate(run):
            siblings = whole[: k * width], whole[(k + 1) * width :]
            for leaf in range(first, end):
                self.witness[leaf].append(siblings)
        self._add(level + 1, digest(whole), run[0][1], run[-1][2])

    def finish(self) -> None:
        """The last runs close with what they have, the lowest first."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)


def grown(nodes: list[str], total: int) -> Appender:
    """A block of a tree of `total` nodes with these nodes appended."""
    block = Appender(levels_of(total))
    for node in nodes:
        block.append(node)
    block.finish()
    return block


def fold(node: str, witness: list[tuple[str, str]]) -> str:
    for before, after in witness:
        node = digest(before + node + after)
    return node


def hashed_fields(**replaced: F.Column) -> F.Column:
    """The digest of a row: each field as `-` or its length in bytes, a colon and its value."""
    def field(name):
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(name) for name in FIELDS)), 256)


def lower_case_tampering() -> tuple[F.Column, F.Column]:
    """Which rows are tampered with and their text then: where 5 divides the id's crc32, A-Z become a-z."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)


def leaves_of(df: DataFrame, tampering: tuple[F.Column, F.Column] | None = None) -> DataFrame:
    """(key, doc_id, leaf, forged): the key is the source so that null sorts first; `forged` is the leaf of a tampered row, else null."""
    which, text = tampering or (F.lit(False), F.col("text"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return df.select(key.alias("key"), F.col("doc_id"), hashed_fields().alias("leaf"), F.when(which, hashed_fields(text=text)).alias("forged"))


def _ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df`, which is staged, with `rank` (from 0) and `total` within its key, by the given columns; alike rows may share a range border."""
    columns = df.columns
    ranges = df.withColumn("_salt", F.rand(11)).repartitionByRange("key", *order, "_salt").sortWithinPartitions("key", *order, "_salt")

    def start():
        key, at = None, 0

        def rows(parts, *cells):
            nonlocal key, at
            keys = cells[columns.index("key")]
            for k, row in enumerate(zip(*cells)):
                key, at = keys[k], at + 1 if key == keys[k] else 0
                yield parts[k], at, *row

        return rows

    schema = schema_of("part int, at long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    ranges = staged(map_rows(ranges.withColumn("part", F.spark_partition_id()), ["part", *columns], schema, start), f"{name}-ranges")
    of_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(ranges.groupBy("part", "key").agg(F.count("*").alias("n")).select("part", "key", before.alias("before"), F.sum("n").over(of_key).alias("total")), f"{name}-offsets")
    return ranges.join(offsets, ["part", "key"]).select(*columns, (F.col("before") + F.col("at")).alias("rank"), "total")


def _blocks(ranked: DataFrame, *columns: str) -> DataFrame:
    """(key, block, total, nodes): the nodes of each aligned block in order, at most BLOCK of them."""
    nodes = F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("nodes")
    return ranked.groupBy("key", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), "total").agg(nodes)


def _climb(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """(key, rank, up, root): for each node (key, rank, total, node) its siblings up to the root of its key's tree; `most` is the largest total."""
    if most <= 1:
        return nodes.select("key", "rank", F.array().cast("array<struct<before:string,after:string>>").alias("up"), F.col("node").alias("root"))

    def start():
        def rows(keys, blocks, totals, lists):
            for key, at, total, members in zip(keys, blocks, totals, lists):
                block = grown([m["node"] for m in members], total)
                ups = [{"rank": m["rank"], "up": [{"before": b, "after": a} for b, a in w]} for m, w in zip(members, block.witness)]
                yield key, at, -(-total // BLOCK), block.root, ups

        return rows

    schema = schema_of("key string, rank long, total long, node string, ups array<struct<rank:bigint,up:array<struct<before:string,after:string>>>>")
    blocks = staged(map_rows(_blocks(nodes, "node"), ["key", "block", "total", "nodes"], schema, start, BLOCKS_AT_ONCE), name)
    above = _climb(blocks.select("key", "rank", "total", "node"), -(-most // BLOCK), name)
    below = blocks.select("key", "rank", F.explode("ups").alias("m")).alias("below")
    return below.join(above.alias("above"), ["key", "rank"]).select("key", F.col("m.rank").alias("rank"), F.concat("m.up", "above.up").alias("up"), "above.root")


def _block_roots(blocks: DataFrame, name: str) -> DataFrame:
    def start():
        return lambda keys, at, totals, lists: ((k, b, -(-n // BLOCK), grown([m["leaf"] for m in nodes], n).root) for k, b, n, nodes in zip(keys, at, totals, lists))

    return staged(map_rows(blocks, ["key", "block", "total", "nodes"], schema_of("key string, rank long, total long, node string"), start, BLOCKS_AT_ONCE), name)


def manifest(df: DataFrame, tampering: tuple[F.Column, F.Column] | None = None) -> DataFrame:
    """For each row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, place).

    `tampering` (which rows, their text then) is what a reader is given instead of the
    rows hashed; `folded_root` is computed from that and the row's own witness.
    """
    leaves = staged(leaves_of(df, tampering), "merkle-leaves")
    blocks = staged(_blocks(_ranked(leaves, ["doc_id", "leaf"], "merkle-leaf"), "doc_id", "leaf", "forged"), "merkle-blocks")
    roots = _block_roots(blocks, "merkle-roots")
    in_source = staged(_climb(roots, roots.agg(F.max("total")).first()[0] or 0, "merkle-climb"), "merkle-witnesses")
    subroots = staged(in_source.where("rank = 0").select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("root").alias("node")), "merkle-subroots")
    ordered = staged(_ranked(subroots, ["source_key"], "merkle-subroot"), "merkle-ordered")
    top = _climb(ordered.select("key", "rank", "total", "node"), ordered.agg(F.max("total")).first()[0] or 0, "merkle-top").alias("top")
    of_source = ordered.alias("o").join(top, F.col("o.rank") == F.col("top.rank")).select(F.col("o.source_key").alias("key"), F.col("o.node").alias("subroot"), F.col("top.up").alias("last"), F.col("top.root").alias("root"))
    above = staged(in_source.select("key", F.col("rank").alias("block"), "up").join(of_source, "key").select("key", "block", F.concat("up", "last").alias("up"), "subroot", "root"), "merkle-above")

    def start():
        def rows(keys, at, totals, lists, ups, subroots, roots):
            for key, b, total, nodes, up, subroot, root in zip(keys, at, totals, lists, ups, subroots, roots):
                block = grown([m["leaf"] for m in nodes], total)
                upper = [(u["before"], u["after"]) for u in up]
                said = "".join(before + after for before, after in upper)
                for m, witness in zip(nodes, block.witness):
                    proof = digest("".join(before + after for before, after in witness) + said)
                    folded = fold(fold(m["forged"] or m["leaf"], witness), upper)
                    yield m["doc_id"], m["leaf"], subroot, root, proof, folded, folded == root, key[1:] if key else None, m["rank"]

        return rows

    schema = schema_of(f"doc_id {id_type(df, 'doc_id')}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, place long")
    return map_rows(blocks.join(above, ["key", "block"]), ["key", "block", "total", "nodes", "up", "subroot", "root"], schema, start, BLOCKS_AT_ONCE)
