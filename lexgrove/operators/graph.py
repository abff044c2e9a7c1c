"""Trees and functional graphs: closure, spans, preorder, chains, cycles, edge views, pattern matching."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's own part of the folder that spark.checkpoint.dir names; a session on one machine without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame in the session's shared folder, so that a loop's plan doesn't grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


BLOCK = 1024  # rows of a side that one cell of joined_in_cells holds, more or less


def joined_in_cells(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int = BLOCK) -> DataFrame:
    """left joined to right by key, where a few keys hold most rows of both: all pairs of a key, in cells of some block x block rows.

    Each side is dealt by its ids into as many parts as its blocks need, and meets all parts of the other, so no task
    has a whole key. Rows without key or id join nothing.
    """
    n = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    parts = n(left, "_ls").join(n(right, "_rs"), key).where("_ls > 1 OR _rs > 1")  # keys of over a block, so few that they are broadcast if they fit

    def dealt(df: DataFrame, ident: str, own: str, others: str, mine: str, theirs: str) -> DataFrame:
        rows = df.join(parts, key, "left").withColumn(mine, F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))))
        return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1)).cast("long") - 1))).drop("_ls", "_rs")

    return dealt(left, left_id, "_ls", "_rs", "_i", "_j").join(dealt(right, right_id, "_rs", "_ls", "_j", "_i"), [key, "_i", "_j"]).drop("_i", "_j")


class CycleError(ValueError):
    """A node is its own ancestor."""


def closure(nodes: DataFrame, ident: str = "id", parent: str = "parent") -> DataFrame:
    """(node, anc, dist): all proper ancestors by path doubling: after k rounds all of distance up to 2^k are known.

    A round joins only ancestors at the largest distance so far with what is known about them, so
    a tree of depth d takes ceil(log2 d) rounds and no row is found twice. A node that meets
    itself is no tree's and raises a CycleError.
    """
    known = cut(nodes.where(F.col(parent).isNotNull()).select(F.col(ident).alias("node"), F.col(parent).alias("anc"), F.lit(1).cast("long").alias("dist")))
    more, reach = known, 1
    while True:
        if own := more.where(F.col("node") == F.col("anc")).select("node").first():
            raise CycleError(f"{own[0]} is its own ancestor")
        tip = known.where(F.col("dist") == reach).select("node", F.col("anc").alias("mid"), F.col("dist").alias("d1"))
        up = known.select(F.col("node").alias("mid"), "anc", F.col("dist").alias("d2"))
        more = cut(tip.join(up, "mid").select("node", "anc", (F.col("d1") + F.col("d2")).alias("dist")))
        if more.isEmpty():
            return known
        known, reach = known.unionByName(more), reach * 2


def leaf_closure(nodes: DataFrame, leaf: Column, ident: str = "id", parent: str = "parent") -> DataFrame:
    """(anc, leaf, dist): ancestors of leaves; the closure of inner nodes is built once and leaves are attached to it."""
    inner = closure(nodes.where(~leaf), ident, parent)
    leaves = nodes.where(leaf & F.col(parent).isNotNull()).select(F.col(ident).alias("leaf"), F.col(parent).alias("node"))
    direct = leaves.select(F.col("node").alias("anc"), "leaf", F.lit(1).cast("long").alias("dist"))
    return direct.unionByName(leaves.join(inner, "node").select("anc", "leaf", (F.col("dist") + 1).alias("dist")))


def group_spans(clo: DataFrame, leaves: DataFrame, ident: str = "id", order: str = "ord") -> DataFrame:
    """(anc, first_leaf, last_leaf, n_leaves, contiguous) of each inner node from its leaves' order."""
    by = clo.join(leaves.select(F.col(ident).alias("leaf"), F.col(order).alias("o")), "leaf").groupBy("anc")
    out = by.agg(F.min_by("leaf", "o").alias("first_leaf"), F.max_by("leaf", "o").alias("last_leaf"), F.count("*").alias("n_leaves"), F.min("o").alias("a"), F.max("o").alias("b"))
    return out.withColumn("contiguous", F.col("b") - F.col("a") + 1 == F.col("n_leaves")).drop("a", "b")


def preorder(nodes: DataFrame, clo: DataFrame, ident: str = "id", child_ord: str = "child_ord", width: int = 10) -> DataFrame:
    """(id, depth, path): path is the fixed-width child ordinals from the root, so sorting by it lists the tree in preorder."""
    own = nodes.select(F.col(ident).alias("anc"), F.lpad(F.col(child_ord).cast("string"), width, "0").alias("o"))
    selfs = nodes.select(F.col(ident).alias("node"), F.col(ident).alias("anc"), F.lit(0).cast("long").alias("dist"))
    steps = clo.select("node", "anc", "dist").unionByName(selfs).join(own, "anc")
    by = steps.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("d"), "o"))).alias("s"))
    return by.select(F.col("node").alias("id"), (F.size("s") - 1).cast("long").alias("depth"), F.array_join(F.transform("s", lambda x: x["o"]), ".").alias("path"))


def chains(starts: DataFrame, edges: DataFrame, cap: int = 50, hops: int = 5) -> DataFrame:
    """(start, step, id): follows a functional graph (src, dst) from many starts at once.

    A chain ends at a null target, at a node it has been to, or after cap steps. A row is a chain
    with its path; a round follows `hops` edges before chains that go on are parted from the rest.
    """
    first = cut(edges.where("dst IS NOT NULL").select("src", "dst"))
    going = starts.select("start", F.array("start").alias("path"), F.lit(False).alias("done"))
    ended = None
    for at in range(0, cap, hops):
        for _ in range(min(hops, cap - at)):
            j = going.withColumn("src", F.when(~F.col("done"), F.element_at("path", -1))).join(first, "src", "left")
            on = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
            going = j.select("start", F.when(on, F.array_append("path", F.col("dst"))).otherwise(F.col("path")).alias("path"), (~on).alias("done"))
        going = cut(going)
        over = going.where("done")
        ended, going = over if ended is None else ended.unionByName(over), going.where("NOT done")
        if going.isEmpty():
            break
    paths = going if ended is None else ended.unionByName(going)
    return paths.select("start", F.posexplode("path").alias("step", "id")).withColumn("step", F.col("step").cast("long"))


def _doubled(step: DataFrame) -> list[DataFrame]:
    """Tables of the targets 1, 2, 4, ... steps on, until the last table's targets are the nodes of cycles and no others.

    Whoever is reached after h steps is among those reached after fewer. If 2h steps reach as many nodes as
    h steps, then h steps carry these nodes onto themselves, so each of them is on a cycle.
    That takes log2 of the longest way into a cycle or out of the graph.
    """
    reached = lambda df: df.agg(F.count_distinct("dst")).first()[0]
    jumps = [step]
    n = reached(step)
    while n:
        near = jumps[-1]
        far = cut(near.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")))
        before, n = n, reached(far)
        jumps.append(far)
        if n == before:
            break
    return jumps


def _rings(step: DataFrame, last: DataFrame) -> DataFrame:
    """(src, low): the nodes on cycles, which are the targets of `last`, and the smallest node of their cycle.

    Smallest values spread by doubling. A round in which no value falls is the last one: then values
    are equal at all nodes h steps apart, and each was the least of the h nodes from its own on, which together are the cycle.
    """
    members = last.select(F.col("dst").alias("src")).distinct()
    ring = cut(step.join(members, "src", "left_semi").withColumn("low", F.least("src", "dst")))
    falls = not ring.isEmpty()
    while falls:
        y = ring.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("low").alias("low2"))
        further = cut(ring.join(y, "dst").select("src", F.col("far").alias("dst"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")))
        ring, falls = further.drop("fell"), not further.where("fell").isEmpty()
    return ring.select("src", "low")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(root): the smallest node of each cycle of a functional graph (src, dst); self-loops count.

    Pointers are doubled until they stand on cycles alone; smallest members then spread along the
    cycles by doubling. Chains that leave the graph drop out. longest: only cycles of so many
    nodes or fewer; all of them if it is left out.
    """
    step = cut(edges.where("dst IS NOT NULL").select("src", "dst"))
    ring = _rings(step, _doubled(step)[-1])
    if longest is None:
        return ring.select(F.col("low").alias("root")).distinct()
    return ring.groupBy(F.col("low").alias("root")).agg(F.count("*").alias("n")).where(F.col("n") <= longest).select("root")


def edge_view(relations: list[tuple[str, str, str, DataFrame, str, str]]) -> DataFrame:
    """(src, dst, label, src_table, dst_table) from (label, src_table, dst_table, frame, src column, dst column); null targets are dropped."""
    out = None
    for label, src_table, dst_table, df, src, dst in relations:
        one = df.where(F.col(dst).isNotNull()).select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(label).alias("label"), F.lit(src_table).alias("src_table"), F.lit(dst_table).alias("dst_table"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class V:
    """A vertex of a pattern: its name there, its table's label, a condition on its columns, and its key."""

    name: str
    label: str
    where: str | None = None
    key: str = "id"


@dataclass(frozen=True)
class E:
    """An edge of a pattern, directed from the vertex before it to the one after it."""

    name: str
    label: str
    where: str | None = None
    src: str = "src"
    dst: str = "dst"


def match(vertices: dict[str, DataFrame], edges: dict[str, DataFrame], pattern: list[V | E], columns: dict[str, str]) -> DataFrame:
    """Rows of a path pattern V, E, V, E, V ... with columns {output: 'name.column'}.

    Conditions go to the tables before the joins; edges without a target match nothing; a pair
    that several edges join appears for each.
    """

    def part(x: V | E, frames: dict[str, DataFrame]) -> DataFrame:
        df = frames[x.label] if x.where is None else frames[x.label].where(x.where)
        return df.alias(x.name)

    out = part(pattern[0], vertices)
    for e, v in zip(pattern[1::2], pattern[2::2], strict=True):
        before = pattern[pattern.index(e) - 1]
        out = out.join(part(e, edges), F.col(f"{before.name}.{before.key}") == F.col(f"{e.name}.{e.src}"))
        out = out.join(part(v, vertices), F.col(f"{e.name}.{e.dst}") == F.col(f"{v.name}.{v.key}"))
    return out.select(*(F.col(c).alias(k) for k, c in columns.items()))


def list_edges(df: DataFrame, src: str, packed: str) -> DataFrame:
    """(src, dst, ord) from lists parted by white space; ordinals from 1; empty lists give no rows."""
    return df.select(F.col(src).alias("src"), F.posexplode(F.filter(F.split(F.trim(packed), r"\s+"), lambda x: x != "")).alias("p", "dst")).select("src", "dst", (F.col("p") + 1).cast("long").alias("ord"))


def frame_edges(df: DataFrame, src: str, packed: str, implicit: str) -> DataFrame:
    """(src, dst, arg_role, implicit, ord) from `ROLE:id;id ROLE:id`.

    Parts without a role or target are skipped; the implicit mark gives a null target; ordinals
    run on across roles. All of a row's edges come from one array, so nothing is shuffled.
    """
    parts = F.transform(F.split(F.trim(packed), r"\s+"), lambda p: F.struct(F.substring_index(p, ":", 1).alias("role"), F.when(p.contains(":"), F.substring_index(p, ":", -1)).otherwise("").alias("ids")))
    good = F.filter(parts, lambda p: (p["role"] != "") & (p["ids"] != ""))
    flat = F.flatten(F.transform(good, lambda p: F.transform(F.filter(F.split(p["ids"], ";"), lambda t: t != ""), lambda t: F.struct(p["role"].alias("role"), t.alias("t")))))
    rows = df.select(F.col(src).alias("src"), F.posexplode(flat).alias("p", "e"))
    hidden = F.col("e.t") == implicit
    return rows.select("src", F.when(~hidden, F.col("e.t")).alias("dst"), F.col("e.role").alias("arg_role"), hidden.alias("implicit"), (F.col("p") + 1).cast("long").alias("ord"))


def tag_tree(pages: DataFrame, ident: str = "page_id", html: str = "html", void: tuple[str, ...] = ("br", "hr", "img", "input", "link", "meta")) -> DataFrame:
    """(ident, n, tag, depth, parent): each opening tag with its number among the tags, its depth from 1 and the number of the tag it stands in.

    Depth is the running balance of tags, in which an end tag with nothing open counts for nothing: the balance
    less its lowest value so far, if that is below 0. The parent is the last tag opened one level up.
    """
    tags = F.filter(F.regexp_extract_all(F.lower(html), F.lit("</?[a-z0-9]+"), F.lit(0)), lambda t: ~F.regexp_replace(t, "[</]", "").isin(*void))
    rows = pages.select(ident, F.posexplode(tags).alias("n", "t"))
    w = Window.partitionBy(ident).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum(F.when(F.col("t").startswith("</"), -1).otherwise(1)).over(w))
    rows = rows.withColumn("depth", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(w))).cast("long"))
    opened = rows.where("t NOT LIKE '</%'").select(ident, F.col("n").cast("long").alias("n"), F.substring("t", 2, 100).alias("tag"), "depth")
    # each tag is a row of its own level, to be found, and one of the level above, to look
    level = opened.select("*", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("own")), F.struct((F.col("depth") - 1).alias("level"), F.lit(False).alias("own")))).alias("at"))
    up = Window.partitionBy(ident, "at.level").orderBy("n", "at.own").rowsBetween(Window.unboundedPreceding, 0)
    return level.withColumn("parent", F.last(F.when(F.col("at.own"), F.col("n")), ignorenulls=True).over(up)).where("NOT at.own").drop("at")


def chain_ends(edges: DataFrame) -> DataFrame:
    """(start, end, length, cyclic) for every node of a functional graph (src, dst): the last node of its chain, its steps, and whether a node came again.

    Tables of the targets 1, 2, 4, ... steps on are made by doubling, as many as the longest way into a
    cycle takes, so a chain of any length takes log2 rounds. Chains stop at nodes without a target or, on a cycle, at the last one
    before a node would come again. Nothing is followed edge by edge.
    """
    step = cut(edges.where("dst IS NOT NULL").select("src", "dst"))
    jumps = _doubled(step)
    on = cut(_rings(step, jumps[-1]))
    around = on.join(on.groupBy("low").agg(F.count("*").alias("around")), "low").select("src", "around")
    before = step.join(on, "src", "left_semi").join(on.select(F.col("src").alias("dst")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("last"))
    stops = cut(around.join(before, "src"))  # on a cycle: its size, and the node before, where a chain that enters here ends
    nodes = edges.select(F.col("src").alias("start")).distinct()
    ringed = on.select(F.col("src").alias("to"), F.lit(True).alias("hit"))
    outside = nodes.join(on.select(F.col("src").alias("start")), "start", "left_anti")
    at = cut(outside.select("start", F.col("start").alias("at"), F.lit(0).cast("long").alias("length")))
    for k in range(len(jumps) - 2, -1, -1):  # as far as no cycle is reached; the last table's targets are all on one
        ahead = at.join(jumps[k].select(F.col("src").alias("at"), F.col("dst").alias("to")), "at", "left").join(ringed, "to", "left")
        go = F.col("to").isNotNull() & F.col("hit").isNull()
        at = cut(ahead.select("start", F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("length") + F.when(go, 1 << k).otherwise(0)).alias("length")))
    entered = at.join(step.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at", "left").join(stops.withColumnRenamed("src", "to"), "to", "left")
    cyclic = F.col("around").isNotNull()
    led = entered.select("start", F.when(cyclic, F.col("last")).otherwise(F.col("at")).alias("end"), (F.col("length") + F.coalesce("around", F.lit(0))).alias("length"), cyclic.alias("cyclic"))
    own = nodes.join(stops.withColumnRenamed("src", "start"), "start")
    return led.unionByName(own.select("start", F.col("last").alias("end"), (F.col("around") - 1).alias("length"), F.lit(True).alias("cyclic")))


def chain_from(edges: DataFrame, start: object, cap: int = 50) -> DataFrame:
    """(step, id): the chain of one start, by Spark's recursive query with the path as an array; it ends at a null target, at a node of its path, or after cap steps."""
    kind = edges.schema["src"].dataType.simpleString()
    text = f"""WITH RECURSIVE w(step, id, path) MAX RECURSION LEVEL {cap + 1} AS (
        SELECT 0L, cast(:start AS {kind}), array(cast(:start AS {kind}))
        UNION ALL SELECT w.step + 1, e.dst, array_append(w.path, e.dst) FROM w JOIN {{edges}} e ON e.src = w.id
        WHERE e.dst IS NOT NULL AND w.step < :cap AND NOT array_contains(w.path, e.dst))
        SELECT step, id FROM w"""
    return edges.sparkSession.sql(text, args={"start": start, "cap": cap}, edges=edges.select("src", "dst"))
