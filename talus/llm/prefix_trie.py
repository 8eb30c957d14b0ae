"""Prefix trie over conversations, summed up from its leaves by messages from node to node.

A node is a sequence of turns; its key is a sum of 128-bit digests of (place, turn) over the sequence, so keys of all prefixes
are prefix sums, which blocks of a conversation take apart: no conversation meets in one task, however long.

Totals of subtrees pass from leaves to the root by leaf peeling. As a long conversation would need a round for each turn, the
trie's nodes are first contracted to paths: each node is on the path of its longest member, so a path runs from a branch
down to a leaf. A path holds a counter of the paths that still hang from its nodes; once the counter is 0, it sends its
totals to the path that it hangs from, and is done. When only the root's path is left and done, one sum along each path
gives every node its totals. Rounds follow the nesting of branches, at most the square root of twice the number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import BROADCAST_LIMIT, Scratch, broadcast_if_small
from talus.operators.digests import ordered_digests

#: Turns of a conversation, and nodes of a path, that are summed in one window.
BLOCK = 4096
#: A parent with more than this share of all nodes for children meets them by broadcast, so at most so many are broadcast.
HOT_PARENTS = 200_000

_PARTS = ["s0", "s1", "s2", "s3"]
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1), digest, n_bytes: turns numbered in order of turn (null first), then role and text.

    Ranges are sorted apart and a conversation's later ranges go on where the earlier ones end.
    """
    # beginnings of texts order them as whole texts do, and a sample of them stays small
    ranges = [*map(F.col, ("conv_id", "turn", "role")), F.substring("text", 1, 32)]
    ranged = turns.repartitionByRange(*ranges).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    # a role's length tells where the text begins
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = scratch.save(ranged.select("conv_id", F.shiftright("at", 33).alias("range"), "at", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "ordered")
    parts = scratch.save(rows.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n")), "ranges")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv_id", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("passed"))
    placed = rows.join(broadcast_if_small(offsets, 32), ["conv_id", "range"])
    return scratch.save(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("passed") + 1).alias("pos"), "digest", "n_bytes"), "turns")


def rebuilt_turns(turns: DataFrame, every: int, modulus: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """conv_id and pos of rebuilt turns, with digest and n_bytes; and the conversations.

    Conversation c begins with the first h turns of c - c % every, where h is crc32 of c's decimal digits modulo
    ``modulus``, and goes on with its own turns after its first h.
    """
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % modulus
    convs = scratch.save(turns.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(modulus - 1)).alias("heads")), "convs")
    c = F.col("conv_id")
    base = c - c % every
    own = turns.filter((c % every == 0) | (F.col("pos") > head(c)))
    # a base lends its first turns, fewer than ``modulus``, to those of its neighbours that exist
    neighbours = F.explode(F.sequence(F.lit(1 - every), F.lit(every - 1))).alias("step")
    lent = turns.filter((c % every == 0) & (F.col("pos") < modulus)).select("*", neighbours).withColumn("other", F.try_add(c, F.col("step")))
    lent = lent.filter((F.col("step") != 0) & (F.col("other") - F.col("other") % every == c) & (F.col("pos") <= head(F.col("other"))))
    lent = lent.join(convs.select(F.col("conv_id").alias("other")), "other", "left_semi").select(F.col("other").alias("conv_id"), "pos", "digest", "n_bytes")
    # own turns move up where the base is shorter than h
    bases = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    moved = convs.filter(c % every != 0).select("conv_id", base.alias("base")).join(bases, "base", "left")
    moved = moved.select("conv_id", F.greatest(head(c) - F.coalesce("base_heads", F.lit(0).cast("long")), F.lit(0).cast("long")).alias("up")).filter("up > 0")
    spread = own.withColumn("block", F.expr(f"pos div {BLOCK}"))
    blocks = spread.select("conv_id", "block").distinct().join(moved, "conv_id")  # so that no conversation's turns meet in one task
    own = spread.join(broadcast_if_small(blocks, 32), ["conv_id", "block"], "left").select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0).cast("long"))).alias("pos"), "digest", "n_bytes")
    return scratch.save(own.unionByName(lent), "rebuilt"), convs


def _node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", depth.cast("string"), *[s.cast("string") for s in sums])))


def member_rows(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per conversation and prefix, the empty one too: conv_id, depth, node, parent, n_bytes, length of the conversation."""
    digest = F.md5(F.concat(F.col("pos").cast("string").cast("binary"), F.lit("/").cast("binary"), "digest"))
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_PARTS)]
    rows = turns.select("conv_id", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n_bytes", *parts)
    blocks = scratch.save(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in _PARTS]), "blocks")
    whole, zero = Window.partitionBy("conv_id"), F.lit(0).cast("long")  # a row a block
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", F.sum("n").over(whole).alias("length"), *[F.coalesce(F.sum(s).over(earlier), zero).alias(f"c{s}") for s in _PARTS])
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("conv_id", "block", "pos", "n_bytes", *_PARTS, *[F.sum(s).over(inside).alias(f"i{s}") for s in _PARTS])
    summed = summed.join(broadcast_if_small(carried, 64), ["conv_id", "block"])
    upto = [F.col(f"c{s}") + F.col(f"i{s}") for s in _PARTS]
    before = [u - F.col(s) for u, s in zip(upto, _PARTS, strict=True)]
    found = summed.select("conv_id", F.col("pos").alias("depth"), _node_key(F.col("pos"), upto).alias("node"), _node_key(F.col("pos") - 1, before).alias("parent"), "n_bytes", "length")
    lengths = carried.groupBy("conv_id").agg(F.max("length").alias("length"))
    root = _node_key(zero, [zero] * len(_PARTS))
    tops = convs.select("conv_id").join(lengths, "conv_id", "left").select("conv_id", zero.alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("n_bytes"), F.coalesce("length", zero).alias("length"))
    return scratch.save(found.unionByName(tops), "members")


def _with_parents(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with n_children, and parent_conv_id and parent_path of their parents; a parent of very many children is broadcast."""
    n_nodes = nodes.count()
    children = scratch.save(nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    counted = nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = scratch.save(counted, "counted")
    parents = counted.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), "n_children")
    # parents of more than n_nodes / HOT_PARENTS children are fewer than HOT_PARENTS
    hot = parents.filter(F.col("n_children") > n_nodes / HOT_PARENTS + 1000).drop("n_children")
    met = counted.join(F.broadcast(hot), "parent", "left")
    rest = parents.filter(F.col("n_children") <= n_nodes / HOT_PARENTS + 1000).drop("n_children")
    cold = met.filter("parent_path IS NULL AND parent IS NOT NULL").drop("parent_conv_id", "parent_path").join(rest, "parent")
    return scratch.save(met.filter("parent_path IS NOT NULL OR parent IS NULL").unionByName(cold.select(met.columns)), "linked")


def peel(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """path, n_leaves, saved: totals of all that hangs from each path and of its own nodes.

    ``paths`` has path, parent_path (null for the root's), n_leaves and saved of the path's own nodes. A round takes the paths whose
    counter is 0 out of the active ones and sends their totals on, summed for each receiver before they are shuffled.
    """
    hanging = paths.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("remaining"))
    active = scratch.save(paths.join(hanging, "path", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("long"))), "active-0")
    done, k = [], 0
    while not active.isEmpty():
        ready = scratch.save(active.filter("remaining = 0"), f"done-{k}")
        done.append(ready.select("path", "n_leaves", "saved"))
        sent = ready.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        left = active.filter("remaining > 0").join(sent, "path", "left").na.fill(0, ["n", "more_leaves", "more_saved"])
        left = left.select("path", "parent_path", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), (F.col("remaining") - F.col("n")).alias("remaining"))
        active = scratch.save(left, f"active-{k + 1}")
        scratch.drop(f"active-{k}")
        k += 1
    out = done[0] if done else active.select("path", "n_leaves", "saved")
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def subtree_totals(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes with n_leaves and saved_tokens of their subtrees."""
    own = linked.groupBy("path").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"))
    tops = linked.filter("parent_path IS NULL OR parent_path <> path").select("path", "parent_path", (F.col("depth") - 1).alias("hangs_at"))
    paths = scratch.save(tops.join(own, "path").select("path", "parent_path", "hangs_at", F.lit(1).cast("long").alias("n_leaves"), "saved"), "paths")
    totals = peel(paths.drop("hangs_at"), scratch)
    sent = paths.select("path", "parent_path", "hangs_at").filter("parent_path IS NOT NULL").join(totals, "path")
    arrived = sent.groupBy(F.col("parent_path").alias("path"), F.col("hangs_at").alias("depth")).agg(F.sum("n_leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    zero = F.lit(0).cast("long")
    rows = linked.join(arrived, ["path", "depth"], "left")
    leaves = F.coalesce("got_leaves", zero) + (F.col("n_children") == 0).cast("long")
    rows = rows.withColumn("leaves_here", leaves).withColumn("saved_here", F.col("saved") + F.coalesce("got_saved", zero)).withColumn("block", F.expr(f"depth div {BLOCK}"))
    rows = scratch.save(rows.drop("got_leaves", "got_saved"), "along")
    blocks = rows.groupBy("path", "block").agg(F.sum("leaves_here").alias("n_leaves"), F.sum("saved_here").alias("saved"))
    deeper = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carried = blocks.select("path", "block", F.coalesce(F.sum("n_leaves").over(deeper), zero).alias("deep_leaves"), F.coalesce(F.sum("saved").over(deeper), zero).alias("deep_saved"))
    carried = carried.filter("deep_leaves > 0")
    inside = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("n_leaves", F.sum("leaves_here").over(inside)).withColumn("saved_tokens", F.sum("saved_here").over(inside))
    summed = summed.join(broadcast_if_small(carried, 48), ["path", "block"], "left")
    return summed.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("deep_leaves", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("deep_saved", zero)})


def prefix_trie(
    conversations: DataFrame, *, every: int = 5, modulus: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    A conversation c is rebuilt from the first h turns of c - c % ``every`` and its own turns after its first h (h: crc32 of
    c in decimal, modulo ``modulus``); ``every`` 1 leaves conversations as they are. ``conv_id`` is the smallest member,
    ``saved_tokens`` sums (n_convs - 1) times the bytes of the last text over the subtree, and ``ends_sha256`` digests the ids of
    the conversations that end at the node, ascending and comma-joined.

    Defined cases: a null turn comes first; equal turns are ordered by role and text. Null roles and texts are empty ones.
    Repeated rows are turns of their own. Rows without an id belong to no conversation and are left out. The remainder of
    a negative id is negative or 0, as in SQL. Very long texts are digested whole. Further columns are ignored. An empty table has no
    members and so no node, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    given = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).filter("conv_id IS NOT NULL")
    turns = ordered_turns(given, scratch)
    rebuilt, convs = rebuilt_turns(turns, every, modulus, scratch)
    members = member_rows(rebuilt, convs, scratch)
    scratch.drop("ordered", "ranges", "turns", "rebuilt", "blocks")

    ends = F.col("depth") == F.col("length")
    longest = F.max(F.struct("length", F.bitwise_not("conv_id").alias("not_id")))
    nodes = members.groupBy("node", "parent", "depth", "n_bytes").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), longest.alias("longest"), F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("first_end")
    )
    nodes = nodes.withColumn("path", F.bitwise_not(F.col("longest.not_id"))).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("longest", "n_bytes")
    nodes = scratch.save(nodes, "nodes")
    linked = _with_parents(nodes, scratch)
    totals = subtree_totals(linked, scratch)

    several = broadcast_if_small(nodes.filter("n_ends > 1").select("node"), 24, broadcast_limit)
    ended = members.filter(ends).join(several, "node", "left_semi").select("node", "conv_id")
    digests = ordered_digests(ended, ["node"], "conv_id", "conv_id")
    one = F.when(F.col("n_ends") == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(F.col("first_end").cast("string"), 256))
    out = totals.join(broadcast_if_small(digests, 24, broadcast_limit), "node", "left")
    return out.select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends",
        F.coalesce("digest", one).alias("ends_sha256"),
    )
