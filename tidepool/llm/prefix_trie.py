"""Prefix trie of conversations: one node for each distinct sequence of first
turns, with totals over every node's subtree by parallel tree contraction.

Nodes. A prefix is named by its length and four running sums of 32-bit hashes
of its turns with their positions, so no conversation is folded in one task:
the sums run inside blocks of positions, and the blocks' totals are added.

Contraction. Every node starts with its own value and its number of children.
A round rakes all leaves (their totals are final; they are added up by parent
before they travel) and compresses chains: of the nodes that keep one child,
those whose coin is heads while the child's is tails leave the tree, and the
child takes over their place and carries their value on its way up. A round
removes all leaves and about a quarter of every chain, so the tree is gone after
a number of rounds that grows with the logarithm of its size, also if it is one
long conversation. Then the compressed nodes are put back, last round first: the
total of each is its child's plus what the child carried for it.

Every round is one table in the shared folder, and each is smaller than the one
before by a constant share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import numbered
from tidepool.operators.sequence import with_positions
from tidepool.session import materialize

BLOCK = 256             # positions summed in one group
IDS = 4096              # conversation ids hashed as one row
FIRST = -(1 << 63)      # before every turn


def ordered_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, h1, h2, n_chars): the turns of each conversation numbered from
    0 in the order of their turn number, null first; a hash in two halves
    stands for role and text (null: empty). Turns of one number lie in the
    order of that hash. Conversation ids are integers; rows without one belong
    to no conversation and are left out. Other columns play no part."""
    src, names = numbered(conversations)
    text = F.coalesce(F.col(names[text_col]), F.lit(""))
    both = (F.coalesce(F.col(names[role_col]), F.lit("")), text)
    rows = src.select(F.col(names[conv_col]).cast("long").alias("conv"),
                      F.coalesce(F.col(names[turn_col]).cast("long"), F.lit(FIRST)).alias("turn"),
                      F.xxhash64(*both).alias("h1"), F.xxhash64(F.lit(1), *both).alias("h2"),
                      F.length(text).cast("long").alias("n_chars"))
    return with_positions(rows, ["conv"], "turn", ["h1", "h2"], BLOCK, "i").drop("turn")


def share_heads(turns: DataFrame, head, base, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first head(conv) turns of conversation
    base(conv) (all if it has fewer, none if it is absent), then the
    conversation's own turns after its first head(conv). ``head`` gives
    ``most`` at most. Returns (turns, conversations), the latter with those
    that have no turn left."""
    c = F.col("conv")
    heads = turns.filter((F.col("i") < most) & (c == base(c)))
    sizes = heads.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("n"))
    convs = turns.select("conv").distinct().withColumn("base", base(c)).join(sizes, "base", "left").select(
        "conv", "base", F.least(head(c), F.coalesce("n", F.lit(0))).alias("k"))
    convs = materialize(convs, "trie-conversations")
    lent = convs.filter("k > 0").join(heads.withColumnRenamed("conv", "base"), "base").filter("i < k").select(
        "conv", "i", "h1", "h2", "n_chars")
    own = turns.filter(F.col("i") >= head(c)).join(convs.select("conv", "k"), "conv").select(
        "conv", (F.col("i") - head(c) + F.col("k")).alias("i"), "h1", "h2", "n_chars")
    return lent.unionByName(own), convs.select("conv")


def _named(sums: list[Column], depth: Column) -> Column:
    """128 bits for a prefix."""
    return F.struct(F.xxhash64(depth, *sums).alias("a"), F.xxhash64(F.lit(2), depth, *sums).alias("b"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, n_chars): a row for each turn, the names of
    the prefixes that end with it and before it."""
    from pyspark.sql import Window

    low = lambda j: F.xxhash64(F.lit(j), "i", "h1", "h2").bitwiseAND(0xFFFFFFFF)
    t = turns.withColumns({f"x{j}": low(j) for j in range(4)}).withColumn("block", F.floor(F.col("i") / BLOCK))
    blocks = t.groupBy("conv", "block").agg(*[F.sum(f"x{j}").alias(f"t{j}") for j in range(4)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(f"t{j}").over(before), F.lit(0)).alias(f"o{j}") for j in range(4)])
    inside = Window.partitionBy("conv", "block").orderBy("i")
    t = t.join(blocks, ["conv", "block"]).withColumns({f"s{j}": F.col(f"o{j}") + F.sum(f"x{j}").over(inside) for j in range(4)})
    depth = F.col("i") + 1
    return t.select("conv", depth.alias("depth"), _named([F.col(f"s{j}") for j in range(4)], depth).alias("node"),
                    _named([F.col(f"s{j}") - F.col(f"x{j}") for j in range(4)], F.col("i")).alias("parent"), "n_chars")


def contract(nodes: DataFrame) -> DataFrame:
    """(n, leaves, saved): subtree totals of a forest given as (n, p, kids,
    leaves, saved): unique number, parent's number (root: null), number of
    children, own values. Empty in, empty out."""
    zero = F.lit(0).cast("long")
    tree = nodes.select("n", "p", "kids", "leaves", "saved", zero.alias("up_leaves"), zero.alias("up_saved"),
                        F.lit(None).cast("long").alias("out"), zero.alias("out_leaves"), zero.alias("out_saved"))
    rounds = []
    while True:
        tree = materialize(tree, "trie-round")
        left, spliced = tree.agg(F.count_if(F.col("kids") > 0), F.count("out")).first()
        rounds.append((tree, spliced))
        if not left:
            break
        tree = _round(tree, len(rounds))
    done = [t.filter("kids = 0").select("n", "leaves", "saved") for t, _ in rounds]
    back: list[DataFrame] = []
    for i in range(len(rounds) - 1, -1, -1):
        tree, spliced = rounds[i]
        if spliced:
            known = reduce(DataFrame.unionByName, done[i:] + back)
            moved = tree.filter("out IS NOT NULL").select("n", "out", "out_leaves", "out_saved").join(known, "n").select(
                F.col("out").alias("n"), (F.col("leaves") + F.col("out_leaves")).alias("leaves"),
                (F.col("saved") + F.col("out_saved")).alias("saved"))
            back.append(materialize(moved, "trie-back"))
    return reduce(DataFrame.unionByName, done + back)


def _round(tree: DataFrame, nth: int) -> DataFrame:
    """The tree after raking its leaves and compressing its chains. A node that
    took another's place says whose (out) and what it carried for it."""
    leaf, inner = F.col("kids") == 0, F.col("kids") > 0
    by_parent = tree.filter("p IS NOT NULL").groupBy(F.col("p").alias("n")).agg(
        F.coalesce(F.sum(F.when(leaf, F.col("leaves") + F.col("up_leaves"))), F.lit(0)).alias("more_leaves"),
        F.coalesce(F.sum(F.when(leaf, F.col("saved") + F.col("up_saved"))), F.lit(0)).alias("more_saved"),
        F.count(F.when(inner, True)).alias("still"), F.min(F.when(inner, F.col("n"))).alias("child"))
    coin = lambda c: F.xxhash64(c, F.lit(nth)).bitwiseAND(1)
    raked = tree.filter(inner).join(by_parent, "n").select(
        "n", "p", F.col("still").alias("kids"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"),
        (F.col("saved") + F.col("more_saved")).alias("saved"), "up_leaves", "up_saved",
        F.when((F.col("still") == 1) & F.col("p").isNotNull() & (coin(F.col("n")) == 1) & (coin(F.col("child")) == 0),
               F.col("child")).alias("heir"))
    gone = raked.filter("heir IS NOT NULL").select(
        F.col("heir").alias("n"), F.col("n").alias("u"), F.col("p").alias("u_p"), F.col("leaves").alias("u_leaves"),
        F.col("saved").alias("u_saved"), F.col("up_leaves").alias("u_up_leaves"), F.col("up_saved").alias("u_up_saved"))
    total = lambda c: F.coalesce(F.col(f"u_{c}"), F.lit(0))
    return raked.filter("heir IS NULL").join(gone, "n", "left").select(
        "n", F.coalesce("u_p", "p").alias("p"), "kids", "leaves", "saved",
        (F.col("up_leaves") + total("leaves") + total("up_leaves")).alias("up_leaves"),
        (F.col("up_saved") + total("saved") + total("up_saved")).alias("up_saved"),
        F.col("u").alias("out"), (total("leaves") + F.col("up_leaves")).alias("out_leaves"),
        (total("saved") + F.col("up_saved")).alias("out_saved"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which arrive in order: the hash is fed
    piece by piece, so a node of any size takes no memory."""
    import hashlib

    node = state = None
    for batch in batches:
        a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for key, piece in zip(zip(a, b), batch.column("ids").to_pylist()):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=["a", "b", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (conv, node), the prefix that a conversation is."""
    pieces = last.groupBy("node", F.floor(F.col("conv") / IDS).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))       # IDS ids at most
    rows = pieces.select("node.a", "node.b", "part", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "part")
    return rows.mapInArrow(_hashed, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("node"), "ends_sha256")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as (conv, i, h1, h2, n_chars),
    turns numbered from 0 without gaps, and (conv), the distinct ids, also those
    without turns.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root:
    null); n_convs: members; n_children; n_leaves: childless nodes in the
    subtree; saved_tokens: summed over the subtree, (n_convs - 1) times the code
    points of the node's last text; ends_sha256: of the ids of the conversations
    that are the prefix, ascending, joined by commas. Equal conversations share
    all their nodes. Without conversations there are no nodes.
    """
    rows = materialize(prefixes(turns), "trie-prefixes")
    root = _named([F.lit(0).cast("long")] * 4, F.lit(0).cast("long"))
    nodes = rows.groupBy("node").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"),
                                     F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"))
    none = F.lit(None).cast(rows.schema["parent"].dataType)
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        root.alias("node"), "conv_id", "n_convs", none.alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("n_chars"))
    nodes = materialize(nodes.unionByName(top).withColumn("n", F.monotonically_increasing_id()), "trie-nodes")
    kids = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("n").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.join(above, "parent", "left").drop("parent"), "trie-tree")
    totals = contract(nodes.select("n", "p", F.col("n_children").alias("kids"), (F.col("n_children") == 0).cast("long").alias("leaves"),
                                   ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")))
    last = rows.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    last = convs.join(last, "conv", "left").select("conv", F.coalesce("node", root).alias("node"))
    out = nodes.join(totals, "n").join(_ends(last), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
