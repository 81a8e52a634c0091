"""Near duplicates by MinHash with tensored banding.

A document is its set of distinct word shingles. Two collections of GROUPS groups of
WIDTH minhashes each are computed; a table's key combines one group of the first with
one of the second, so GROUPS ** 2 tables of 2 * WIDTH minhashes need only 2 * GROUPS *
WIDTH minhashes. Sets of equal hash are one class; everything after runs over classes.

Classes that share a key are candidates. A key's members are not paired with each
other: each is confirmed against one pivot, by the sizes of the intersection and the
union of the full sets, and what is linked becomes one component. Only where a key
still spans several components do blocks of further pivots follow, of 32, 1024, ...
members, the same ones for all keys that the members share, and only against members of
other components, until every member was a pivot or no key spans components. Every class
has a bitmap of the parities of its shingles' hashes: two bitmaps differ in at most as
many bits as the sets differ in shingles, so a pair whose bitmaps differ in more than a
link allows is left out inside the join, with certainty. So no link among candidates is
lost, and a key emits pairs only for members not yet linked and nearly alike.

Two sets of similarity s share no key with probability
1 - (1 - (1 - s ** WIDTH) ** GROUPS) ** 2: 2e-4 at 0.8, 2e-5 at 0.85.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing;
a text with fewer words than a shingle is one shingle; equal texts are one class;
rows are judged each for itself, whatever their ids: of a component's rows the one with
the smallest id is kept, null ids last and ties by a hash of the whole row, and of rows
alike in all columns one; a component's id is the smallest id in it, null if all are
null; rows without an id are linked, kept or dropped as others are; ids of other types
than integers are not supported; a long text costs its length in time and its shingles in
memory; an empty table gives no rows; other columns only break ties, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_rows, schema_of, staged
from larder.llm.fingerprints import mixed, shingle_hashes, word_hashes

GROUPS, WIDTH = 9, 2
#: Keys of at most so many members are settled in one round of blocks; larger keys have blocks that grow by this factor.
SMALL, GROW = 32, 32
#: Members of a key that are joined in one place: those of larger keys are dealt into parts.
PART_MEMBERS = 256
#: Rows of two numbers up to which a join side is sent to all tasks; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
#: 64-bit words of a class's parity bitmap.
BITMAP_WORDS = 16


def shingle_set(text: str, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of the text, A-Z in lower case, rising."""
    return np.unique(shingle_hashes(word_hashes().of(text.encode().lower().split()), size))


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit id of the whole set, as a signed integer."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def band_values(shingles: np.ndarray, groups: int, width: int) -> list[int]:
    """2 * groups values, each combining `width` minhashes."""
    seeds = mixed(np.arange(1, 2 * groups * width + 1, dtype=np.uint64))
    least = np.empty(len(seeds), np.uint64)
    for k in range(0, len(shingles), 4096):
        part = shingles[k : k + 4096]
        low = ((part[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint64)
        low = (low ^ (low >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        low = low.min(axis=1)
        least = low if k == 0 else np.minimum(least, low)
    by_group = least.reshape(2 * groups, width)
    out = by_group[:, 0]
    for k in range(1, width):
        out = mixed(out) ^ by_group[:, k]
    return out.view(np.int64).tolist()


def parity_bitmap(shingles: np.ndarray) -> list[int]:
    """Bit b is set if an odd number of shingles hash to b."""
    counts = np.bincount((shingles % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def may_link(a: str, b: str, n: str, m: str, percent: int) -> Column:
    """Can sets of n and m shingles with these bitmaps have 100 * intersection >= percent * union? They differ in at least as many shingles as the bitmaps do in bits."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(BITMAP_WORDS)))
    return (100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m))


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, groups: int, width: int) -> DataFrame:
    """(id, row, n_shingles, class, bands) of every row; `row` is a hash of all its columns."""

    def start():
        def rows(ids, hashes, texts):
            for i, h, t in zip(ids, hashes, texts):
                s = shingle_set(t, size) if t else np.zeros(0, np.uint64)
                yield (i, h, len(s), class_of(s), band_values(s, groups, width), parity_bitmap(s)) if len(s) else (i, h, 0, None, None, None)

        return rows

    own = df.select(F.col(id_col).alias("id"), row_hash(df).alias("row"), F.col(text_col).alias("text"))
    return map_rows(own, ["id", "row", "text"], schema_of("id bigint, row bigint, n_shingles bigint, c bigint, bands array<bigint>, bitmap array<bigint>"), start)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, nulls told from other values."""
    cells = [F.to_json(F.col(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*cells, *(F.isnull(c) for c in cells))


def tensored_keys(groups: int) -> Column:
    """All keys of a class: one band of the first collection with one of the second."""
    return F.explode(F.array(*(F.xxhash64(F.lit(i * groups + j), F.get("bands", i), F.get("bands", groups + j)) for i in range(groups) for j in range(groups))))


def _alike_size(n: str, m: str, percent: int) -> Column:
    return (100 * F.least(F.col(n), F.col(m))) >= percent * F.greatest(F.col(n), F.col(m))


def _parts(step: int) -> Column:
    """Parts of a key: the larger the blocks of pivots that go to every part, the fewer parts."""
    return F.ceil(F.col("in_key") / (PART_MEMBERS * GROW ** max(step - 1, 0)))


def own_part(step: int) -> Column:
    """The part of its key that a member is in."""
    return F.pmod(F.xxhash64("c", F.lit("part")), _parts(step)).alias("part")


def every_part(step: int) -> Column:
    """All parts of a key: what meets all members of a large key goes to each. Pivots so repeated stay fewer than the members."""
    return F.explode(F.sequence(F.lit(0).cast("long"), _parts(step) - 1)).alias("part")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. The often repeated pivots, a, are joined last, where Spark can split a skewed join."""
    b = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    a = sets.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label reachable over the edges, starting from labels (c, n, label): minimum over neighbours, then over the label's own label, until nothing changes."""
    ways = edges.select(F.col("a").alias("c"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("other")))
    known = labels.select(F.col("c").alias("other"), F.col("label").alias("near"))
    # between labels, not nodes: what is one component already is one node
    ways = staged(ways.join(labels, "c").join(known, "other").filter(F.col("label") != F.col("near")).select(F.col("label").alias("x"), F.col("near").alias("y")).distinct(), "near-ways")
    tree = ways.select("x", F.col("x").alias("top")).distinct()
    while True:
        least = ways.join(tree.select(F.col("x").alias("y"), F.col("top").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        lower = tree.join(least, "x").select("x", "top", F.least("top", "near").alias("new"))
        lower = staged(lower, "near-tree")
        jump = lower.select(F.col("x").alias("new"), F.col("new").alias("up"))
        new = staged(lower.join(jump, "new", "left").select("x", F.least("new", F.coalesce("up", "new")).alias("top"), (F.least("new", F.coalesce("up", "new")) != F.col("top")).alias("moved")), "near-tree")
        moved = new.filter("moved").limit(1).count()
        tree = new.select("x", "top")
        if not moved:
            break
    return staged(labels.join(tree, labels["label"] == tree["x"], "left").select("c", "n", F.coalesce("top", "label").alias("label")), "near-labels")


def judged(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, groups: int = GROUPS, width: int = WIDTH) -> DataFrame:
    """(id, row, n_shingles, component_id, kept) of every row; of a component's rows exactly one is kept."""
    # the staged numbers tell apart rows that are alike in all columns
    docs = staged(signatures(df, id_col, text_col, size, groups, width).withColumn("at", F.monotonically_increasing_id()), "near-signatures")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "at")
    classes = docs.filter("c is not null").groupBy("c").agg(F.min("id").alias("first_id"), F.min(place).alias("first"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands"), F.max("bitmap").alias("bitmap"))
    classes = staged(classes, "near-classes")

    member = classes.select("c", tensored_keys(groups).alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("in_key")).filter("in_key > 1")
    # `turn`, a hash of the class in [0, 1), says when a member becomes a pivot
    turn = F.pmod(F.xxhash64("c", F.lit("turn")), F.lit(1 << 30)) / (1 << 30)
    members = staged(member.join(shared, "key").select("key", "in_key", "c", turn.alias("turn")), "near-members")

    wanted = staged(classes.select("c", "first_id", "n").join(members.select("c").distinct(), "c"), "near-wanted")
    small = wanted.count() <= BROADCAST_ROWS
    every = df.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text"))
    sought = wanted.select("c", "first_id")
    texts = every.join(F.broadcast(sought) if small else sought, "first_id")

    def start():
        def rows(cs, ts):
            for c, t in zip(cs, ts):
                s = shingle_set(t or "", size)
                if class_of(s) == c:
                    yield c, s.view(np.int64).tolist()

        return rows

    def start_nameless():
        def rows(ts):
            for t in ts:
                s = shingle_set(t or "", size)
                if len(s):
                    yield class_of(s), s.view(np.int64).tolist()

        return rows

    set_schema = schema_of("c bigint, s array<bigint>")
    nameless = map_rows(every.filter("first_id is null"), ["text"], set_schema, start_nameless).join(wanted.filter("first_id is null").select("c"), "c", "left_semi")
    sets = staged(map_rows(texts, ["c", "text"], set_schema, start).unionByName(nameless.groupBy("c").agg(F.first("s").alias("s"))), "near-sets")
    bitmaps = staged(classes.select("c", "bitmap").join(wanted.select("c"), "c", "left_semi"), "near-bitmaps")
    labels = wanted.select("c", "n", F.col("c").alias("label"))

    open_rows, step = members, 0
    while True:
        told = open_rows.join(labels, "c")
        spans = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("in_key").alias("in_key")).filter("low <> high")
        told = staged(told.withColumn("part", own_part(step)).join(spans.select("key", every_part(step)), ["key", "part"], "left_semi"), "near-open")
        if not told.limit(1).count():
            break
        if step == 0:
            pivot = told.groupBy("key").agg(F.min_by(F.struct("c", "n", "label"), "turn").alias("p"), F.max("in_key").alias("in_key")).select("key", every_part(step), F.col("p.c").alias("a"), F.col("p.n").alias("an"), F.col("p.label").alias("al"))
            open_rows = told.drop("label", "n", "part")
        else:
            upto = F.when(F.col("in_key") <= SMALL, 1.0).otherwise(F.lit(float(GROW**step)) / F.col("in_key"))
            open_rows = told.filter(F.col("turn") >= upto).drop("label", "n", "part")
            told = told.join(bitmaps, "c")
            pivot = told.filter(F.col("turn") < upto).select("key", every_part(step), F.col("c").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("bitmap").alias("ab"))
        apart = (F.col("label") != F.col("al")) & _alike_size("n", "an", percent)
        found = told.join(pivot, ["key", "part"]).filter(apart & may_link("bitmap", "ab", "n", "an", percent) if step else apart)
        if step:
            found = found.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))
        else:
            found = found.select("a", F.col("c").alias("b"))
        edges = staged(confirmed(found.distinct(), sets, percent), "near-edges")
        labels = components(labels, edges)
        step += 1

    grouped = classes.select("c", "first").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = grouped.groupBy("label").agg(F.min("first").alias("best"))
    found = staged(grouped.join(least, "label").select("c", F.col("best.id").alias("component_id"), F.col("best.at").alias("best_at")), "near-components")
    rows = docs.select("id", "row", "at", "n_shingles", "c").join(found, "c", "left")
    return rows.select("id", "row", "n_shingles", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce(F.col("at") == F.col("best_at"), F.lit(True)).alias("kept"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    groups: int = GROUPS,
    width: int = WIDTH,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of documents linked by a Jaccard similarity of at least percent / 100."""
    return judged(df, id_col, text_col, size, percent, groups, width).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that are kept, one of each component, with their columns as they were, whatever their names. Rows without shingles all stay."""
    # rows alike in all columns share (id, row): such a group goes, stays, or has one row that stays
    groups = judged(df, id_col, text_col, size, percent).groupBy("id", "row").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    cut = staged(groups.filter("stay < n").select(F.col("id").alias("cut_id"), F.col("row").alias("cut_row"), "stay"), "near-cut")
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(own.alias("own"), F.col(id_col).alias("own_id"), row_hash(df).alias("own_row"))
    same = F.col("own_id").eqNullSafe(F.col("cut_id")) & (F.col("own_row") == F.col("cut_row"))
    out = keyed.join(cut, same, "left_anti")
    repeated = cut.filter("stay > 0")
    if repeated.limit(1).count():
        out = out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_row"]))
    return out.select(*(F.col("own").getField(c).alias(c) for c in df.columns))
