"""Prefix trie of conversations, with totals over subtrees by centroid decomposition.

A node of depth d is a distinct sequence of first d turns; its members are the conversations
that start with it, and the smallest member's id with the depth names the node.  A turn's
128-bit fingerprint contains its place, so the exclusive-or of the first d fingerprints
names a prefix, and members, mass and words of all nodes are one aggregate.

Totals over subtrees (roll-ups) are found by splitting the tree at centroids.  The weight of
a node is its number of members; ``mass`` is the weight of its subtree within its component,
which the same aggregate gives for the whole tree.  A component's centroid is its deepest
node that holds more than half of the component's mass.  The total over the centroid and all
that lies below it in the component is added to every node on the path from the centroid up
to the component's top, whose masses lose the centroid's; the centroid is then settled, and
what hung below each of its children, and what is left above it, are components of at most
half the mass.  So there are at most log2(mass) rounds, however deep or wide the tree is.
While a component holds more than a bound, a round is two joins on (conversation, depth)
pairs; smaller components are split in one task, many at a time.

Who lies on which side of a centroid needs no walk: a node lies below it if its smallest
member passes through the centroid at that depth, and above it if the centroid's smallest
member passes through the node.  Both are one look-up in the table of shared prefixes, which
holds (conversation, depth, smallest member) wherever that is another conversation.

Cases: rows without a conv_id take no part.  A null role or text is empty.  Turns are
ordered by turn (null first), then role and text; rows that repeat are turns of their own.
An empty table gives an empty result.  Long conversations are numbered and fingerprinted in
blocks.  Other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posefarm.functions.ordering import with_order
from posefarm.llm.digest import run_digests
from posefarm.llm.store import stored

#: Turns of one conversation fingerprinted in one go, as a power of two.
BLOCK_BITS = 10
#: Mass of a component that one task may hold, and the most components above it that a
#: round may send to all tasks.
LOCAL, MOST = 20_000, 1_000_000
#: Conversations whose ids are joined in one run, by ranges of ids.
RUN = 4096
#: Conversations that share the head of the first of them, and the most turns they share.
HEADS, LONGEST_HEAD = 20, 3
NODE = ["conv_id", "depth"]
TOP = ["top_conv", "top_depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of every turn."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-2**63)).alias("_turn"),
        F.col("turn").isNotNull().alias("_known"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return with_order(rows, "conv_id", "_turn", ["_known", "role", "text"], rank="place").select("conv_id", "place", "role", "text")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """conv_id, depth, role, text of conversations rebuilt on a shared head, and turnless
    ones with depth 0 (role and text null).

    Conversation c starts with the first crc32(c) % 4 turns of conversation c - c % 20 and
    goes on with its own turns after as many.
    """
    turns = stored(turns, "turns")
    base = F.col("conv_id") - F.col("conv_id") % HEADS
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    heads = turns.filter((F.col("place") <= LONGEST_HEAD) & (F.col("conv_id") == base)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("head"))
    convs = convs.join(heads, "base", "left").select("conv_id", "h", F.expr("coalesce(slice(head, 1, CAST(h AS INT)), array())").alias("head"))
    convs = stored(convs, "heads")
    start = convs.select("conv_id", F.inline("head")).select("conv_id", F.col("place").alias("depth"), "role", "text")
    own = turns.join(convs.select("conv_id", "h", F.size("head").cast("long").alias("taken")), "conv_id").filter("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return start.unionByName(own).unionByName(root)


def _fingerprints(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, words, length: fingerprint of the first ``depth`` turns."""
    word = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    own = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(s), "depth", "role", "text")).alias(s) for s in ("a", "b")]
    marked = stored(turns.select("conv_id", "depth", *own, F.when(F.col("depth") == 0, 0).otherwise(word).cast("long").alias("words"),
                                 F.shiftright("depth", BLOCK_BITS).alias("block")), "marked")
    blocks = marked.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("_a"), F.bit_xor("b").alias("_b"), F.max("depth").alias("_last"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in ("a", "b")],
                           F.max("_last").over(whole).alias("length"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumns({f"upto_{s}": F.bit_xor(s).over(upto) for s in ("a", "b")}).join(blocks, ["conv_id", "block"]).select(
        "conv_id", "depth", *[F.col(f"upto_{s}").bitwiseXOR(F.col(f"before_{s}")).alias(s) for s in ("a", "b")], "words", "length")


def _named(levels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes; shared prefixes (conv_id, depth, owner, next_owner); and the end of every conversation."""
    found = stored(levels.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("mass")), "found")
    owned = stored(levels.join(found.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).select("conv_id", "depth", "length", "owner"), "owned")
    on = Window.partitionBy("conv_id").orderBy("depth")
    shared = owned.filter("owner <> conv_id").select("conv_id", "depth", "owner", F.coalesce(F.lead("owner").over(on), "conv_id").alias("next_owner"))
    ends = owned.filter("depth = length").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    nodes = found.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words", "mass")
    return nodes, stored(shared, "shared"), ends


def _looked_up(rows: DataFrame, conv: Column, depth: Column, shared: DataFrame) -> DataFrame:
    """Add owner and next_owner of (conv, depth): the smallest members there and one turn on."""
    s = shared.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "owner", "next_owner")
    met = rows.withColumns({"_conv": conv, "_depth": depth}).join(s, (F.col("_conv") == F.col("_c")) & (F.col("_depth") == F.col("_d")), "left")
    return met.withColumns({c: F.coalesce(c, "_conv") for c in ("owner", "next_owner")}).drop("_conv", "_depth", "_c", "_d")


def split_totals(parent: list[int], mass: list[int], values: list[list[int]], more: list[list[int]]) -> list[list[int]]:
    """Centroid decomposition of small components: total of each value over each subtree.

    ``parent`` is -1 at a component's top; ``more`` is what is already known to lie below.
    """
    children: list[list[int]] = [[] for _ in parent]
    for v, p in enumerate(parent):
        if p >= 0:
            children[p].append(v)
    mass, out = list(mass), [list(m) for m in more]
    settled = [False] * len(parent)
    tops = [v for v, p in enumerate(parent) if p < 0]
    while tops:
        top = tops.pop()
        whole, centre = mass[top], top
        while True:
            heavy = next((c for c in children[centre] if not settled[c] and 2 * mass[c] > whole), None)
            if heavy is None:
                break
            centre = heavy
        total, below = [0] * len(values), [centre]
        while below:
            v = below.pop()
            for k, value in enumerate(values):
                total[k] += value[v]
            below.extend(c for c in children[v] if not settled[c])
        gone = mass[centre]
        v = centre
        while v != top:
            v = parent[v]
            mass[v] -= gone
            for k, t in enumerate(total):
                out[k][v] += t
        for k, t in enumerate(total):
            out[k][centre] += t
        settled[centre] = True
        tops.extend(c for c in children[centre] if not settled[c])
        if centre != top:
            tops.append(top)
    return out


def _split_frame(frame: pd.DataFrame) -> pd.DataFrame:
    conv, depth, up = frame["conv_id"].tolist(), frame["depth"].tolist(), frame["parent_conv_id"].tolist()
    at = {key: i for i, key in enumerate(zip(conv, depth))}
    is_top = ((frame["conv_id"] == frame["top_conv"]) & (frame["depth"] == frame["top_depth"])).tolist()
    parent = [-1 if top else at[int(p), d - 1] for top, p, d in zip(is_top, up, depth)]
    got = split_totals(parent, frame["mass"].tolist(), [frame["leaves"].tolist(), frame["saved"].tolist()],
                       [frame["more_leaves"].tolist(), frame["more_saved"].tolist()])
    return frame[NODE].assign(n_leaves=got[0], saved_tokens=got[1])


def rolled_up(nodes: DataFrame, shared: DataFrame, local: int | None = None) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: totals of ``leaves`` and ``saved`` over subtrees.

    ``nodes`` has conv_id, depth, parent_conv_id, mass, leaves, saved; ``shared`` as ``_named`` gives it.
    """
    root = nodes.filter("depth = 0").select("conv_id", "mass").first()
    if root is None:
        return nodes.select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # Components above the bound are disjoint, so no round has more than MOST of them.
    bound = max(LOCAL if local is None else local, -(-root["mass"] // MOST))
    zero = F.lit(0).cast("long")
    live = nodes.select(*NODE, "parent_conv_id", "mass", "leaves", "saved", F.lit(root["conv_id"]).cast("long").alias("top_conv"),
                        zero.alias("top_depth"), zero.alias("more_leaves"), zero.alias("more_saved"))
    columns, small, settled = live.columns, [], []
    is_top = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth"))
    while True:
        large = stored(live.filter(is_top & (F.col("mass") > bound)).select(*TOP, F.col("mass").alias("whole")), "large")
        met = live.join(F.broadcast(large), TOP, "left")
        small.append(met.filter("whole IS NULL").select(*columns))
        if large.isEmpty():
            break
        heavy = met.filter(2 * F.col("mass") > F.col("whole")).groupBy(*TOP).agg(F.max_by(F.struct("conv_id", "depth", "mass"), "depth").alias("g"))
        heavy = stored(heavy.select(*TOP, *[F.col(f"g.{c}").alias(f"g_{c}") for c in ("conv_id", "depth", "mass")]), "centroids")
        met = met.filter("whole IS NOT NULL").select(*columns).join(F.broadcast(heavy), TOP)
        under = F.col("depth") > F.col("g_depth")
        met = _looked_up(met, F.when(under, F.col("conv_id")).otherwise(F.col("g_conv_id")), F.least("depth", "g_depth"), shared)
        side = (F.when((F.col("conv_id") == F.col("g_conv_id")) & (F.col("depth") == F.col("g_depth")), "centre")
                .when(under & (F.col("owner") == F.col("g_conv_id")), "under")
                .when((F.col("depth") < F.col("g_depth")) & (F.col("owner") == F.col("conv_id")), "over").otherwise("beside"))
        met = stored(met.withColumn("side", side), "sides")
        totals = met.filter("side IN ('centre', 'under')").groupBy(*TOP).agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
        met = met.join(F.broadcast(stored(totals, "totals")), TOP)
        settled.append(met.filter("side = 'centre'").select(*NODE, (F.col("more_leaves") + F.col("t_leaves")).alias("n_leaves"),
                                                            (F.col("more_saved") + F.col("t_saved")).alias("saved_tokens")))
        over, below = F.col("side") == "over", F.col("side") == "under"
        live = stored(met.filter("side <> 'centre'").select(
            *NODE, "parent_conv_id", (F.col("mass") - F.when(over, F.col("g_mass")).otherwise(0)).alias("mass"), "leaves", "saved",
            F.when(below, F.col("next_owner")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(below, F.col("g_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            *[(F.col(f"more_{v}") + F.when(over, F.col(f"t_{v}")).otherwise(0)).alias(f"more_{v}") for v in ("leaves", "saved")]), "live")
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    rest = stored(rest, "small")
    buckets = max(1, -(-rest.count() // LOCAL))
    out = rest.groupBy(F.pmod(F.xxhash64(*TOP), F.lit(buckets))).applyInPandas(
        _split_frame, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for part in settled:
        out = out.unionByName(part)
    return out


def trie(turns: DataFrame, local: int | None = None) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv_id, depth from 1, role, text; a row of
    depth 0 for every conversation): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``local`` is the mass of a component that one task may split.
    """
    nodes, shared, ends = _named(stored(_fingerprints(turns), "levels"))
    nodes = _looked_up(nodes, F.col("conv_id"), F.col("depth") - 1, shared).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("owner")))
    nodes = stored(nodes.drop("owner", "next_owner"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").fillna(0, ["n_children"]).withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "tree")
    totals = rolled_up(nodes, shared, local)
    runs = ends.groupBy(*NODE, F.floor(F.col("member") / RUN).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("ends_sha256"))
    digests = run_digests(stored(runs, "ends"), NODE, ["ends_sha256"], ",")
    out = nodes.select(*NODE, "parent_conv_id", "n_convs", "n_children").join(totals, NODE).join(digests, NODE, "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
