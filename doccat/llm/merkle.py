"""Merkle manifest of a dataset: bitmap ranks place the leaves, keyed slot arrays reduce the levels.

A document is a leaf of its source's tree, in the order of ``doc_id``; the subroots, in the order of the
source, are the leaves of one more tree. A node of a tree is the hash of up to ``FAN`` nodes below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.operators.scale import cut, fits_broadcast
from doccat.operators.vectors import dense_index

# Nodes of a run, and the bits of a place in it.
FAN = 16
FAN_BITS = 4
# Bits of an id within a word of the bitmap, and of a word within a block of the directory.
WORD_BITS = 6
BLOCK_BITS = 16
# Levels of blocks above the words: 64 bits are used up, and what is left is a few hundred blocks a tree.
BLOCK_LEVELS = 3
# The word of rows without an id; it lies before the words of all ids.
NO_ID = -(1 << (63 - WORD_BITS)) - 1
# Columns of a leaf, in the order of the hash.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(**changed: Column) -> Column:
    """Hash of the fields, each ``-`` if null, else its bytes, ``:`` and value; ``changed`` ones replace columns."""
    values = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return digest(
        *[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    )


def _joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if fits_broadcast(table) else table, on, how)


def bitmap_words(rows: DataFrame) -> DataFrame:
    """``tree, w, bits, n``: the bitmap of the ids of each tree, only words that have an id; a written table.

    Rows are merged by bit-or before the shuffle and after it. ``n`` counts rows: more than the bits where
    an id repeats.
    """
    return cut(
        rows.groupBy("tree", "w").agg(
            F.expr("bit_or(shiftleft(1L, b))").alias("bits"), F.count("*").alias("n")
        )
    )


def directory(words: DataFrame) -> DataFrame:
    """``tree, w, bits, n, base``: the words with the number of rows of their tree before each; a written table.

    Blocks of ``2**BLOCK_BITS`` words are summed up, blocks of blocks likewise; a running sum covers one
    block at a time, so none is longer than that however sparse the ids are.
    """
    levels = [words.select("tree", F.col("w").alias("k0"), "n")]
    for k in range(BLOCK_LEVELS):
        above = levels[-1].groupBy("tree", F.shiftright(f"k{k}", BLOCK_BITS).alias(f"k{k + 1}")).agg(F.sum("n").alias("n"))
        levels.append(cut(above))
    out = words.withColumn("k0", F.col("w"))
    total = F.lit(0).cast("long")
    for k, level in enumerate(levels):
        key = ["tree"] if k == BLOCK_LEVELS else ["tree", F.shiftright(f"k{k}", BLOCK_BITS)]
        before = W.partitionBy(*key).orderBy(f"k{k}").rowsBetween(W.unboundedPreceding, -1)
        if k:
            out = out.withColumn(f"k{k}", F.shiftright(f"k{k - 1}", BLOCK_BITS))
            sums = cut(level.select("tree", f"k{k}", F.sum("n").over(before).alias(f"s{k}")))
            out = _joined(out, sums, ["tree", f"k{k}"])
        else:
            out = out.withColumn("s0", F.sum("n").over(before))
        total = total + F.coalesce(f"s{k}", F.lit(0))
    return cut(out.select("tree", "w", "bits", "n", total.alias("base")))


def place_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, at, n, doc_id, leaf, other)`` for the written table ``leaves``, and ``(tree, source, n)``.

    ``at`` is the rank of the row in its source, by the directory's base and the count of lower bits in its
    word; no rows are sorted. Only rows of words in which an id repeats are: by id (null first), leaf
    and row, over ranges of all of them.
    """
    sources = cut(dense_index(leaves.select("source").distinct(), ["source"], "tree"))
    named = leaves.withColumn("source", F.concat(F.lit("="), "source")).fillna({"source": "-"})
    keys = sources.withColumn("source", F.concat(F.lit("="), "source")).fillna({"source": "-"})
    rows = _joined(named, keys, ["source"]).select(
        "tree", "doc_id", "leaf", "other", "_row",
        F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NO_ID)).alias("w"),
        F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int").alias("b"),
    )
    words = directory(bitmap_words(rows))
    sizes = cut(words.groupBy("tree").agg(F.sum("n").alias("size")))
    words = _joined(words, sizes, ["tree"]).withColumn("crowded", F.col("n") > F.bit_count("bits"))
    ranked = _joined(rows, cut(words.drop("n").withColumnRenamed("size", "n")), ["tree", "w"])
    lower = F.bit_count(F.expr("bits & ~shiftleft(-1L, b)"))
    kept = ["tree", "at", "n", "doc_id", "leaf", "other"]
    placed = ranked.filter("NOT crowded").withColumn("at", F.col("base") + lower).select(*kept)
    if not words.filter("crowded").isEmpty():
        order = ["tree", "w", "doc_id", "leaf", "_row"]
        sorted_ = cut(dense_index(ranked.filter("crowded").select(*order, "n", "base", "other"), order, "pos"))
        first = cut(sorted_.groupBy("tree", "w").agg(F.min("pos").alias("first")))
        repeated = _joined(sorted_, first, ["tree", "w"]).withColumn("at", F.expr("base + pos - first"))
        placed = placed.unionByName(repeated.select(*kept))
    return placed, sources.join(sizes.withColumnRenamed("size", "n"), "tree")


def _above(n: Column) -> Column:
    return F.shiftright(n + FAN - 1, FAN_BITS)


def reduce_levels(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs ``(tree, at, n, hs)`` and roots ``(tree, h)`` per level of ``nodes (tree, at, n, h)``.

    ``n`` is the number of nodes of the tree on the level; a tree ends at one node. The slots of a run are
    gathered under the run's key, at most ``FAN`` of them, and each level is a written table.
    """
    runs, roots = [], []
    for _ in range(depth):
        roots.append(nodes.filter("n = 1").select("tree", "h"))
        slots = F.array_sort(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(FAN - 1)).alias("slot"), "h")))
        level = nodes.filter("n > 1").groupBy("tree", F.shiftright("at", FAN_BITS).alias("at"), "n").agg(slots.alias("s"))
        runs.append(cut(level.select("tree", "at", "n", F.col("s.h").alias("hs"))))
        nodes = runs[-1].select("tree", "at", _above(F.col("n")).alias("n"), F.sha2(F.array_join("hs", ""), 256).alias("h"))
    return runs, [*roots, nodes.filter("n = 1").select("tree", "h")]


def _step(hs: str, at: str) -> Column:
    """The other nodes of a run, before and after the one at ``at``."""
    before = F.slice(hs, F.lit(1), F.col(at))
    after = F.slice(hs, F.col(at) + 2, F.lit(FAN))
    return F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right"))


def paths(runs: list[DataFrame], roots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``(tree, at, subroot, up)`` for the nodes that ``reduce_levels`` was given.

    ``up`` has the siblings on each level from the node's own run on, followed by ``up`` of ``tops (tree,
    subroot, up)`` for the root of its tree.
    """
    known = None
    for level in range(len(roots) - 1, -1, -1):
        here = roots[level].select("tree").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("at"), "subroot", "up")
        if known is not None:
            inner = runs[level].join(known, ["tree", "at"]).select(
                "tree", (F.col("at") * FAN).alias("first"), "hs", "subroot", "up", F.posexplode("hs").alias("slot", "h")
            )
            here = here.unionByName(
                inner.select(
                    "tree", (F.col("first") + F.col("slot")).alias("at"), "subroot",
                    F.concat(F.array(_step("hs", "slot")), "up").alias("up"),
                )
            )
        known = here
    return known


def _depth(n: int) -> int:
    """Levels until ``n`` nodes are one."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def manifest(docs: DataFrame, tampered: Column, altered: dict[str, Column]) -> DataFrame:
    """``doc_id, source, at, leaf, subroot, root, path, folded_root, verified`` for each row of ``docs``.

    ``docs`` has the columns of ``FIELDS``; others are not read. ``path`` has the siblings of each level, first
    in the source's tree and then among the subroots, as ``left`` and ``right`` of the row's own node. Where
    ``tampered`` holds, the leaf is hashed anew with the columns ``altered``, and ``folded_root`` is what this leaf
    and the untouched siblings give; ``verified`` says that it equals ``root``. Rows without an id come first
    in their source, a null source comes first among sources, and rows that share an id are in the
    order of their leaves. A lone leaf is its own subroot, a lone subroot the root. An empty table stays empty.
    """
    leaves = cut(
        docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS]).select(
            "doc_id", "source", leaf_hash().alias("leaf"), F.when(tampered, leaf_hash(**altered)).alias("other"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    placed, sources = place_leaves(leaves)
    sources = cut(sources)
    most, n_trees = sources.agg(F.max("n"), F.count("*")).first()
    lone = placed.filter("n = 1")
    member = F.struct("at", "doc_id", "leaf", "other")
    groups = cut(
        placed.filter("n > 1").groupBy("tree", F.shiftright("at", FAN_BITS).alias("at"), "n")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    nodes = groups.select(
        "tree", "at", _above(F.col("n")).alias("n"), F.sha2(F.array_join("members.leaf", ""), 256).alias("h")
    )
    runs, roots = reduce_levels(nodes, max(0, _depth(most or 0) - 1))
    # The subroots are the nodes of a tree above all trees.
    subroots = lone.select("tree", F.col("leaf").alias("h"))
    for level in roots:
        subroots = subroots.unionByName(level)
    subroots = cut(subroots)
    above = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), "h"
    )
    top_runs, top_roots = reduce_levels(above, _depth(n_trees))
    root = top_roots[-1].first()
    root = F.lit(root["h"] if root else None).cast("string")
    nothing = F.array().cast(STEP)
    over = paths(top_runs, top_roots, top_roots[-1].select("tree", F.lit("").alias("subroot"), nothing.alias("up")))
    tops = cut(
        over.select(F.col("at").alias("tree"), "up").join(subroots, "tree")
        .join(sources.select("tree", "source"), "tree").select("tree", F.struct("source", "h").alias("subroot"), "up")
    )
    up = paths(runs, roots, tops)
    inner = groups.join(up, ["tree", "at"]).select(
        "subroot", "up", F.col("members.leaf").alias("hs"), F.posexplode("members").alias("slot", "m")
    )
    inner = inner.select("m.*", "subroot", F.concat(F.array(_step("hs", "slot")), "up").alias("path"))
    alone = lone.join(tops, "tree").select("at", "doc_id", "leaf", "other", "subroot", F.col("up").alias("path"))
    folded = F.aggregate(
        "path", F.coalesce("other", "leaf"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256)
    )
    return inner.unionByName(alone).select(
        "doc_id", F.col("subroot.source").alias("source"), "at", "leaf", F.col("subroot.h").alias("subroot"),
        root.alias("root"), "path", folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof(path: str = "path") -> Column:
    """Hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)
