"""Graph algebra over edges (src, dst, ...) and nodes (id, ...) as DataFrames.

Traversals expand a frontier level by level for all start nodes at once; a level is one equi-join with the edges
and one anti-join with what has been reached, both on narrow rows. Minima and sums are partial before shuffles.
Iterations are cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row of largest order for each key: what is added again overwrites."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def merge_nodes(rows: DataFrame, keys: list[str], declared: list[str], extra: list[str], order: str = "seq") -> DataFrame:
    """Adding a node again resets its declared fields and keeps extra ones that the new row doesn't have."""
    last = F.max_by(F.struct(*declared), F.col(order)).alias("x")
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in extra]
    return rows.groupBy(*keys).agg(last, *kept).select(*keys, "x.*", *extra)


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and endpoints of edges that are none yet, their other columns null."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.unionByName(ends.join(nodes, "id", "left_anti"), allowMissingColumns=True)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def touching(edges: DataFrame, ids: list[str], k: int | None = None) -> DataFrame:
    """The distinct edges with an end among ids, in order of their ends; the first k of them."""
    found = edges.where(F.col("src").isin(ids) | F.col("dst").isin(ids)).distinct().orderBy("src", "dst")
    return found if k is None else found.limit(k)


def updated(nodes: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with the values that updates(key, ...) has for them; null values and unknown keys change nothing."""
    new = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in new])
    joined = nodes.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in new else F.col(c) for c in nodes.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """A graph's rows over an earlier one's: for each key the row of the new graph, and in each the last added."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1))).withColumn("at", F.struct("fresh", order))
    return last_wins(both, keys, "at").select(*old.columns)


def without(rows: DataFrame, changes: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is not among changes(path)."""
    return rows.join(changes.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def related_by_file(nodes: DataFrame, files: DataFrame, types: tuple[str, ...] = ("config", "pipeline")) -> DataFrame:
    """The ids of nodes of some types that files(source_file) declare."""
    return nodes.where(F.col("node_type").isin(*types)).join(files.select("source_file").distinct(), "source_file", "left_semi").select("id").distinct()


#: One side of a join of so many rows at most is sent to where the other lies, which stays there.
SMALL = 50_000


def sent(side: DataFrame, rows: int | None = None) -> DataFrame:
    """One side of a join: of few rows (by their count) it is sent to the other, else neither passes through the driver.

    Spark would go by the size it guesses, and for rows that are made of a small table that is a fraction of the truth.
    """
    return F.broadcast(side) if rows is not None and rows <= SMALL else side.hint("merge")


def _met(frontier: DataFrame, rows: int, edges: DataFrame) -> DataFrame:
    """frontier (of so many rows) with src and dst of its edges out; what is met more than once stays so."""
    return sent(frontier, rows).join(edges, frontier["node"] == edges["src"])


def levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) of all nodes that starts(start) reach by the fewest edges, start itself left out."""
    edges = edges.select("src", "dst")
    seen = frontier = cut(starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    depth, rows = 0, frontier.count()
    held = rows
    while max_depth is None or depth < max_depth:
        depth += 1
        met = _met(frontier, rows, edges).select("start", F.col("dst").alias("node")).distinct()
        new = cut(met.join(sent(seen.select("start", "node"), held), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        rows = new.count()
        if not rows:
            break
        held += rows
        seen, frontier = seen.unionByName(new), new  # a union of levels that are each cut
    return seen.where("depth > 0")


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth, parent, key) of all nodes that starts(start) reach, start itself left out.

    depth is the fewest edges. parent is the node it is discovered from: among the nodes of the level before, the
    first one in order of discovery, where the neighbours of a node are discovered in order of their ids. key orders
    the nodes of a level by discovery; numbered() makes positions of it. A level is sorted by ranges, so no start's
    nodes have to meet in one task.
    """
    edges = edges.select("src", "dst")
    frontier = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.monotonically_increasing_id().alias("key"))
    seen = frontier = cut(frontier)
    depth, rows = 0, frontier.count()
    held = rows
    while max_depth is None or depth < max_depth:
        depth += 1
        met = _met(frontier, rows, edges).select("start", F.col("dst").alias("node"), F.col("node").alias("parent"), F.col("key").alias("at"))
        met = met.groupBy("start", "node").agg(F.min(F.struct("at", "parent")).alias("x")).select("start", "node", "x.at", "x.parent")
        new = met.join(sent(seen.select("start", "node"), held), ["start", "node"], "left_anti")
        new = new.repartitionByRange("at", "node").sortWithinPartitions("at", "node")
        new = cut(new.select("start", "node", F.lit(depth).alias("depth"), "parent", F.monotonically_increasing_id().alias("key")))
        rows = new.count()
        if not rows:
            break
        held += rows
        seen, frontier = seen.unionByName(new), new  # a union of levels that are each cut
    return seen.where("depth > 0")


def numbered(found: DataFrame) -> DataFrame:
    """reach() with `position` for key: the discovery of each start's nodes numbered from 1.

    Counts of each start, level and range come first, then numbers within these.
    """
    part = F.shiftright("key", 33)  # monotonically_increasing_id() holds the partition there
    rows = found.withColumn("part", part)
    count = rows.groupBy("start", "depth", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("start").orderBy("depth", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("start", "depth", "part").orderBy("key"))
    rows = rows.withColumn("nth", nth).join(count.withColumn("before", before).drop("n"), ["start", "depth", "part"])
    return rows.select("start", "node", "depth", "parent", (F.col("before") + F.col("nth")).alias("position"))


def sources_and_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_source, is_sink): no edge in, no edge out; an isolated node is both."""
    out, into = edges.select(F.col("src").alias("id"), F.lit(1).alias("o")).distinct(), edges.select(F.col("dst").alias("id"), F.lit(1).alias("i")).distinct()
    found = nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return found.select("id", F.col("i").isNull().alias("is_source"), F.col("o").isNull().alias("is_sink"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree_centrality): (in + out) / (n - 1), 0 for a single node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.count()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = nodes.select("id").join(d, "id", "left").select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"))
    share = (F.col("in_degree") + F.col("out_degree")) / F.lit(n - 1) if n > 1 else F.lit(0.0)
    return out.withColumn("degree_centrality", share)


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank). Weighted by `weight`; the mass of nodes without edges out is spread evenly; stops when the sum of
    changes is below n * tolerance, after `rounds` rounds at most. No nodes: no rows."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    weights = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    total = weights.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(weights.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    rank = cut(nodes.select("id").join(total.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost")
    dangling = rank.agg(lost).first()["lost"]
    for _ in range(rounds):
        given = rank.join(share, rank["id"] == share["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = (1 - alpha) / n + alpha * dangling / n
        after = rank.join(given, rank["id"] == given["dst"], "left").select("id", "dangling", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        after = cut(after)
        now = after.agg(lost, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).first()
        rank, dangling = after.drop("old"), now["lost"]
        if now["change"] < n * tolerance:
            break
    return rank.select("id", "rank")


def _on_cycles(e: DataFrame) -> tuple[DataFrame, int]:
    """The edges left, and their number, when nodes without edges in or out are taken away again and again."""
    count = -1
    while True:
        e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = e.count()
        if now == count or not now:
            return e, now
        count = now


def _coloured(e: DataFrame) -> DataFrame:
    """(id, component) by colours: each node takes the largest id that reaches it; what a colour's own node is reached from is one component.

    Rows are as many as nodes and edges, never pairs of nodes. Found components are taken away, and the rest goes on.
    """
    found, left = e.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0), e.count()
    while left:
        colour = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        moved = colour
        while True:
            given = moved.join(e, moved["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("n"))
            after = cut(colour.join(given, "id", "left").select("id", F.greatest("c", F.coalesce("n", "c")).alias("c"), (F.col("n") > F.col("c")).alias("new")))
            colour, moved = after.drop("new"), after.where("new").drop("new")
            if moved.isEmpty():
                break
        same = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colour.where("id = c").select(F.col("id").alias("start"))
        mine = levels(reverse(cut(same)), roots).select(F.col("node").alias("id"), F.col("start").alias("component"))
        mine = cut(mine.union(roots.select(F.col("start").alias("id"), F.col("start").alias("component"))))
        found = found.union(mine)
        e = e.join(mine.select(F.col("id").alias("src")), "src", "left_anti").join(mine.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
        e, left = _on_cycles(e)
    return found


def strong_components(nodes: DataFrame, edges: DataFrame, few: int = 1000) -> DataFrame:
    """(component, size, members): strongly connected components of two nodes or more.

    Components are numbered cycle_1, cycle_2, ... by falling size, then first member. Nodes that no cycle can hold go
    first. If `few` nodes are left, or fewer, mutual reach decides (few * few pairs at most), else colours do.
    """
    e, left = _on_cycles(edges.select("src", "dst").where("src <> dst").distinct())
    if left and e.select("src").distinct().count() > few:
        part = _coloured(e)
    else:
        pairs = levels(e, e.select(F.col("src").alias("start")))
        back = pairs.select(F.col("node").alias("start"), F.col("start").alias("node"))
        mutual = pairs.select("start", "node").join(back, ["start", "node"], "left_semi")
        part = mutual.groupBy(F.col("start").alias("id")).agg(F.least(F.min("node"), F.col("start")).alias("component"))
    found = part.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members")).where("size > 1")
    number = F.row_number().over(Window.orderBy(F.desc("size"), F.col("members")[0]))
    return found.select(F.concat(F.lit("cycle_"), number.cast("string")).alias("cycle_id"), "size", "members")


def descendants(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, descendants): how many other nodes each node reaches; 0 for nodes that reach none."""
    pairs = levels(edges, edges.select(F.col("src").alias("start")))
    counts = pairs.where("node <> start").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("descendants"))
    return counts if nodes is None else nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def betweenness(nodes: DataFrame, edges: DataFrame, most: int | None = 250) -> DataFrame | None:
    """(id, betweenness), directed and normalised; None above `most` nodes (a most of None: always computed).

    All shortest paths are counted level by level; a node lies on those of (s, t) through it if the distances add up.
    """
    n = nodes.count()
    if most is not None and n > most:
        return None
    e = edges.select("src", "dst").where("src <> dst").distinct()
    frontier = nodes.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    seen = frontier = cut(frontier)
    d = 0
    while True:
        d += 1
        met = frontier.join(e, frontier["t"] == e["src"]).groupBy("s", F.col("dst").alias("t")).agg(F.sum("paths").alias("paths"))
        new = cut(met.join(seen.select("s", "t"), ["s", "t"], "left_anti").select("s", "t", F.lit(d).alias("d"), "paths"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new  # a union of levels that are each cut
    a = seen.where("d > 0").select("s", F.col("t").alias("v"), F.col("d").alias("d1"), F.col("paths").alias("p1"))
    b = seen.where("d > 0").select(F.col("s").alias("v"), "t", F.col("d").alias("d2"), F.col("paths").alias("p2"))
    st = seen.where("d > 0")
    through = a.join(b, "v").where("s <> t").join(st, ["s", "t"]).where("d1 + d2 = d").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("p1") * F.col("p2") / F.col("paths")).alias("sum"))
    scale = (n - 1) * (n - 2) if n > 2 else 1
    return nodes.select("id").join(through, "id", "left").select("id", (F.coalesce("sum", F.lit(0.0)) / scale).alias("betweenness"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, id, depth 1) of the direct neighbours of a node."""
    up = edges.where(F.col("dst") == node).select(F.lit("upstream").alias("direction"), F.col("src").alias("id"))
    down = edges.where(F.col("src") == node).select(F.lit("downstream").alias("direction"), F.col("dst").alias("id"))
    return up.union(down).distinct().withColumn("depth", F.lit(1))


def node_type_of(id: Column) -> Column:
    """The type that an id tells: by its prefix, else function if it has ::, else module."""
    out = F.when(F.contains(id, F.lit("::")), F.lit("function")).otherwise(F.lit("module"))
    for prefix, kind in (("dataset::", "dataset"), ("transform::", "transformation"), ("config::", "config"), ("pipeline::", "pipeline")):
        out = F.when(F.startswith(id, F.lit(prefix)), F.lit(kind)).otherwise(out)
    return out


def impacted(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, start, depth, the rest of nodes(id, ...), goes_on) of what lies downstream of each start; goes_on is null at sinks."""
    found = levels(edges, starts).select("start", F.col("node").alias("id"), "depth").join(sent(nodes), "id", "left")
    out = edges.select(F.col("src").alias("id"), F.lit(True).alias("goes_on")).distinct()
    return found.join(sent(out), "id", "left")


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """What lies downstream of each start: counts, largest depth, datasets, sinks and source files.

    nodes: id, node_type, transformation_type, source_file. Starts that reach nothing have zeros and empty lists.
    """
    return impact_of(impacted(edges, nodes, starts), starts)


def impact_of(found: DataFrame, starts: DataFrame) -> DataFrame:
    """impact() of the rows of impacted()."""
    pick = lambda c: F.array_sort(F.collect_set(c))
    summary = found.groupBy("start").agg(
        F.count("*").alias("impacted"),
        F.max("depth").alias("max_depth"),
        F.sum(F.when(F.col("node_type") == "dataset", 1).otherwise(0)).alias("datasets"),
        F.sum(F.when(F.col("node_type") == "transformation", 1).otherwise(0)).alias("transformations"),
        pick(F.when(F.col("goes_on").isNull(), F.col("id"))).alias("sinks"),
        pick(F.when(F.col("source_file") != "", F.col("source_file"))).alias("source_files"),
    )
    none = F.array().cast("array<string>")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("impacted", "max_depth", "datasets", "transformations")} | {c: F.coalesce(c, none) for c in ("sinks", "source_files")}
    return starts.select("start").distinct().join(sent(summary), "start", "left").withColumns(zero)


def resolve(nodes: DataFrame, wanted: str, prefix: str = "dataset::") -> str | None:
    """The id of a node that a name means: exact id, id or name without case (first added), `id::` prefix, part of a name.

    nodes: id, name, seq. Ties go to the smallest id, among names without case to the first added.
    """
    full, low = wanted if wanted.startswith(prefix) else prefix + wanted, wanted.lower().removeprefix(prefix)
    id, name = F.lower("id"), F.lower(F.coalesce("name", F.lit("")))
    tier = (
        F.when((F.col("id") == wanted) | (F.col("id") == full), 0)
        .when((id == full.lower()) | (name == low), 1)
        .when(F.startswith(F.col("id"), F.lit(full + "::")), 2)
        .when(F.contains(id, F.lit(low)) | F.contains(name, F.lit(low)), 3)
    )
    found = nodes.select("id", "seq", tier.alias("tier")).where("tier is not null").orderBy("tier", F.when(F.col("tier") == 1, F.col("seq")), "id").limit(1).collect()
    return found[0]["id"] if found else None
