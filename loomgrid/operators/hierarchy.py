"""Parent-child links to full hierarchies, by heavy-path decomposition.

The links form a graph in which every node has at most one parent: trees, and
rings with whatever hangs below them.  Rings are separated first.  Then every
inner node passes the larger part of its subtree on to its heaviest child; the
maximal runs of such links are chains, and a path from a root crosses at most
log2(n) of them.  So a node's whole path is a short list of chain segments, and
all descendants of a node are the rest of its chain and the chains that hang
from there: an equality on the chain and a range on the position.

All passes work on inner nodes only (leaves attach to their parent at the end,
by one join), cost O(log depth) rounds, and never gather a subtree in one task.
Each round is written as a table, see ``workspace``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.names import bare_name, not_blank
from loomgrid.workspace import Workspace


@dataclass
class Hierarchy:
    """nodes: id, project_id, name, parent, inner (has children).

    inner: id, parent, size, chain, pos, root, depth, segs; size counts the
    node itself, segs is the list of (chain, pos) crossed from the root; for
    nodes on or below a ring everything but id and parent is null.
    rings: id, jump - nodes on or below a ring and an ancestor far up.
    """

    nodes: DataFrame
    inner: DataFrame
    rings: DataFrame
    ws: Workspace


def call_links(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, node, parent, n_parents): callee and caller of calls whose callee is a known symbol.

    One aggregation over calls and symbols decides existence and parent at once,
    so a callee with very many call sites needs no join.  Should a name have
    several callers, the smallest is its parent and n_parents exceeds 1.
    """
    c = calls.where(F.col("project_id").isNotNull() & not_blank("callee") & F.col("caller").isNotNull()).select("project_id", bare_name("callee").alias("node"), bare_name("caller").alias("parent"), F.lit(False).alias("known"))
    s = symbols.where(F.col("project_id").isNotNull() & F.col("name").isNotNull()).select("project_id", F.col("name").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("known"))
    g = c.unionByName(s).groupBy("project_id", "node").agg(F.max("known").alias("known"), F.min("parent").alias("parent"), F.max("parent").alias("parent2"))
    return g.where(F.col("known") & F.col("parent").isNotNull()).select("project_id", "node", "parent", F.when(F.col("parent") == F.col("parent2"), 1).otherwise(2).alias("n_parents"))


def _nodes(links: DataFrame, ws: Workspace, seed: int = 0) -> DataFrame:
    """Nodes under 64-bit ids; a collision of ids (checked, not assumed away) leads to another seed."""
    nid = lambda c: F.xxhash64(F.lit(seed), "project_id", c)
    a = links.select(nid("node").alias("id"), "project_id", F.col("node").alias("name"), nid("parent").alias("parent"), F.lit(False).alias("inner"))
    b = links.select(nid("parent").alias("id"), "project_id", F.col("parent").alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("inner"))
    g = a.unionByName(b).groupBy("id").agg(F.min(F.struct("project_id", "name")).alias("k"), F.max(F.struct("project_id", "name")).alias("k2"), F.max("parent").alias("parent"), F.max("inner").alias("inner"))
    nodes, clashes = ws.write_measured(g.select("id", "k.project_id", "k.name", "parent", "inner", (F.col("k") != F.col("k2")).alias("clash")), f"nodes{seed}", F.count_if(F.col("clash")))
    if clashes:
        return _nodes(links, ws, seed + 1)
    return nodes.drop("clash")


def _sizes(inner: DataFrame, ws: Workspace) -> DataFrame:
    """id, parent, size, ptr: subtree sizes by pointer doubling; ptr stays non-null exactly on and below rings.

    After round k, size counts the descendants less than 2^k steps below and ptr
    is the ancestor 2^k steps above.  Each round resolves at least the next depth,
    so a round without progress proves that what is left never reaches a root.
    """
    open_ = F.count_if(F.col("ptr").isNotNull())
    t, now = ws.write_measured(inner.withColumn("ptr", F.col("parent")), "sz0", open_)
    k, left = 0, None
    while now and now != left:
        left = now
        add = t.where("ptr is not null").groupBy(F.col("ptr").alias("_v")).agg(F.sum("size").alias("_add"))
        up = t.select(F.col("id").alias("_u"), F.col("ptr").alias("_ptr"))
        n = t.join(add, F.col("id") == F.col("_v"), "left").join(up, F.col("ptr") == F.col("_u"), "left")
        n = n.select("id", "parent", (F.col("size") + F.coalesce("_add", F.lit(0))).alias("size"), F.col("_ptr").alias("ptr"))
        t, now = ws.write_measured(n, f"sz{k + 1}", open_, replaces=f"sz{k}")
        k += 1
    return t


def _chains(tree: DataFrame, ws: Workspace) -> DataFrame:
    """id, parent, size, chain (id of the chain's head), pos (steps from the head)."""
    heavy = tree.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.max(F.struct("size", "id")).alias("_h"))
    t = tree.join(heavy.select(F.col("_h.id").alias("_hid")), F.col("id") == F.col("_hid"), "left")
    is_heavy = F.col("_hid").isNotNull()
    t = t.select("id", "parent", "size", F.when(is_heavy, F.col("parent")).otherwise(F.col("id")).alias("chain"), F.when(is_heavy, 1).otherwise(0).cast("long").alias("pos"), (~is_heavy).alias("done"))
    left = F.count_if(~F.col("done"))
    (t, now), k = ws.write_measured(t, "ch0", left), 0
    while now:
        up = t.select(F.col("id").alias("_u"), F.col("chain").alias("_c"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        open_ = t.where("not done").join(up, F.col("chain") == F.col("_u")).select("id", "parent", "size", F.col("_c").alias("chain"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"))
        t, now = ws.write_measured(t.where("done").unionByName(open_), f"ch{k + 1}", left, replaces=f"ch{k}")
        k += 1
    return t.drop("done")


def _segments(chained: DataFrame, names: DataFrame, ws: Workspace) -> DataFrame:
    """Resolve the tree of chains level by level; its height is at most log2(nodes)."""
    heads = chained.where("id = chain")
    at = chained.select(F.col("id").alias("_p"), F.col("chain").alias("up"), F.col("pos").alias("up_pos"))
    seg = "array<struct<chain:bigint,pos:bigint>>"
    start = heads.where("parent is null").select("id").join(names, "id").select(F.col("id").alias("chain"), F.col("name").alias("root"), F.lit(0).cast("long").alias("base"), F.array().cast(seg).alias("above"))
    level = ws.write(start, "lv0")
    rest = ws.write(heads.where("parent is not null").select("id", "parent").join(at, F.col("parent") == F.col("_p")).select(F.col("id").alias("chain"), "up", "up_pos"), "rest0")
    levels, k = [level], 0
    while True:
        got = rest.join(level.withColumnRenamed("chain", "_c"), F.col("up") == F.col("_c"))
        step = F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("pos"))).cast(seg)
        nxt, n = ws.write_measured(got.select("chain", "root", (F.col("base") + F.col("up_pos") + 1).alias("base"), F.concat("above", step).alias("above")), f"lv{k + 1}", F.count(F.lit(1)))
        if not n:
            break
        levels.append(nxt)
        level, k = nxt, k + 1
    allc = levels[0]
    for x in levels[1:]:
        allc = allc.unionByName(x)
    allc = allc.withColumnRenamed("chain", "_c")
    out = chained.join(allc, F.col("chain") == F.col("_c"))
    return out.select("id", "parent", "size", "chain", "pos", "root", (F.col("base") + F.col("pos")).alias("depth"), F.concat("above", F.array(F.struct("chain", "pos")).cast(seg)).alias("segs"))


def build_hierarchy(links: DataFrame, ws: Workspace | None = None) -> Hierarchy:
    """Decompose (project_id, node, parent) links.  Repeated links count once, null ends are ignored, no links give empty tables."""
    ws = ws or Workspace(links.sparkSession, "hierarchy")
    links = links.select("project_id", "node", "parent").where("node is not null and parent is not null")
    nodes = _nodes(links, ws)
    leaves = nodes.where("not inner").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_leaves"))
    inner = nodes.where("inner").join(leaves, F.col("id") == F.col("_p"), "left").select("id", "parent", (F.coalesce("_leaves", F.lit(0)) + 1).alias("size"))
    sized = _sizes(inner, ws)
    tree = sized.where("ptr is null").drop("ptr")
    chained = _chains(tree, ws)
    done = _segments(chained, nodes.select("id", "name"), ws)
    rings = sized.where("ptr is not null").select("id", "parent", F.col("ptr").alias("jump"))
    return Hierarchy(nodes, done, rings, ws)


def node_roots(h: Hierarchy) -> DataFrame:
    """(project_id, node, root, depth) of every node; root '' and depth -1 on and below rings."""
    i = h.inner.select(F.col("id").alias("_i"), "root", "depth").unionByName(h.rings.select(F.col("id").alias("_i"), F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth")))
    n = h.nodes.withColumn("_at", F.when(F.col("inner"), F.col("id")).otherwise(F.col("parent")))
    j = n.join(i, F.col("_at") == F.col("_i"))
    return j.select("project_id", F.col("name").alias("node"), "root", F.when((F.col("depth") < 0) | F.col("inner"), F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"))


#: Names of a chain that one row holds.
BLOCK = 1024


def chain_blocks(h: Hierarchy) -> DataFrame:
    """(chain, block, names): the names of a chain from its head down, BLOCK a row, so no chain is gathered whole."""
    names = h.nodes.select("id", "name")
    block = F.floor(F.col("pos") / BLOCK)
    g = h.inner.select("id", "chain", "pos").join(names, "id").groupBy("chain", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_n"))
    return g.select("chain", "block", F.transform("_n", lambda x: x["name"]).alias("names"))


def node_paths(h: Hierarchy, sep: str = "/", asked: DataFrame | None = None) -> DataFrame:
    """(project_id, node, path, depth, root) of every node of a tree, or of the ``asked`` ids; path names all nodes from the root down.

    A path is a concatenation of the leading parts of the chains it crosses.  Spelled
    out, the paths of a deep chain are quadratic in its length; ``h.inner.segs`` with
    ``chain_blocks`` says the same in linear space, and ``asked`` spells out some.
    """
    n = h.nodes
    if asked is not None:
        n = n.join(asked.select("id").distinct(), "id", "left_semi")
    n = n.withColumn("_at", F.when(F.col("inner"), F.col("id")).otherwise(F.col("parent")))
    i = h.inner
    if asked is not None:
        i = i.join(n.select(F.col("_at").alias("id")).distinct(), "id", "left_semi")
    ex = i.select("id", "root", "depth", F.posexplode("segs").alias("_k", "_s"))
    ex = ex.select("id", "root", "depth", "_k", F.col("_s.chain").alias("chain"), F.col("_s.pos").alias("_pos"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_s.pos") / BLOCK))).alias("block"))
    last = F.least(F.col("_pos") - F.col("block") * BLOCK + 1, F.lit(BLOCK)).cast("int")
    part = ex.join(chain_blocks(h), ["chain", "block"]).select("id", "root", "depth", "_k", "block", F.slice("names", F.lit(1), last).alias("_part"))
    p = part.groupBy("id", "root", "depth").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "block", "_part"))), lambda x: x["_part"])).alias("_path"))
    j = n.join(p.withColumnRenamed("id", "_i"), F.col("_at") == F.col("_i"))
    leaf = ~F.col("inner")
    full = F.when(leaf, F.concat("_path", F.array("name"))).otherwise(F.col("_path"))
    return j.select("project_id", F.col("name").alias("node"), F.array_join(full, sep).alias("path"), F.when(leaf, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), "root")


def descendants(h: Hierarchy, ancestors: DataFrame | None = None) -> DataFrame:
    """(project_id, node, descendant, steps) for the given ancestor ids, or for all inner nodes.

    A node lies below v when one of its segments is on v's chain at or after v:
    an equality on the chain and a range on the position.
    """
    names = h.nodes.select("id", "project_id", "name")
    q = h.inner.select(F.col("id").alias("anc"), F.col("chain").alias("_c"), F.col("pos").alias("_p"), F.col("depth").alias("_d"))
    if ancestors is not None:
        q = q.join(ancestors.select(F.col("id").alias("anc")).distinct(), "anc", "left_semi")
    seg = h.inner.select("id", "depth", F.explode("segs").alias("s")).select("id", "depth", F.col("s.chain").alias("chain"), F.col("s.pos").alias("pos"))
    hit = q.join(seg, (F.col("_c") == F.col("chain")) & (F.col("_p") <= F.col("pos"))).select("anc", "id", (F.col("depth") - F.col("_d")).alias("steps"))
    leaves = h.nodes.where("not inner").select(F.col("id").alias("_leaf"), F.col("parent").alias("_lp"))
    below = hit.where("anc != id").unionByName(hit.join(leaves, F.col("id") == F.col("_lp")).select("anc", F.col("_leaf").alias("id"), (F.col("steps") + 1).alias("steps")))
    a = names.select(F.col("id").alias("anc"), "project_id", F.col("name").alias("node"))
    d = names.select("id", F.col("name").alias("descendant"))
    return below.join(a, "anc").join(d, "id").select("project_id", "node", "descendant", "steps")


def ring_members(h: Hierarchy) -> DataFrame:
    """(project_id, node, ring, ring_size) of the nodes on rings; ring is the smallest name on it.

    Jumping up far enough from anywhere lands on a ring, and a jump permutes a
    ring, so ring nodes are the image of a long jump.
    """
    ws, t, k, before = h.ws, h.rings.select("id", "jump"), 0, None
    while True:
        image = t.select("jump").distinct().count()
        if image in (0, before):
            break
        before = image
        t = ws.write(t.join(t.select(F.col("id").alias("_u"), F.col("jump").alias("_j")), F.col("jump") == F.col("_u")).select("id", F.col("_j").alias("jump")), f"rg{k}", replaces=f"rg{k - 1}")
        k += 1
    names = h.nodes.select("id", "project_id", "name")
    on = h.rings.select("id", "parent").join(t.select(F.col("jump").alias("id")).distinct(), "id", "left_semi").join(names, "id")
    # Smallest name on each ring, by doubling over its own links.
    # Ids tell rings of different projects apart; a round that changes no row proves that every window spans its ring.
    m, k, changed = ws.write(on.select("id", F.col("parent").alias("ptr"), F.col("name").alias("low")), "rm0"), 0, True
    while changed:
        up = m.select(F.col("id").alias("_u"), F.col("ptr").alias("_p"), F.col("low").alias("_l"))
        nxt = m.join(up, F.col("ptr") == F.col("_u")).select("id", F.col("_p").alias("ptr"), F.least("low", "_l").alias("low"), (F.col("_l") < F.col("low")).alias("moved"))
        m, changed = ws.write_measured(nxt, f"rm{k + 1}", F.count_if(F.col("moved")), replaces=f"rm{k}")
        m, k = m.drop("moved"), k + 1
    out = on.select("id", "project_id", F.col("name").alias("node")).join(m.select("id", F.col("low").alias("ring")), "id")
    size = out.groupBy("project_id", "ring").agg(F.count("*").alias("ring_size"))
    return out.join(size, ["project_id", "ring"]).select("project_id", "node", "ring", "ring_size")
