"""Graphs as edge lists ``(src, dst)``: degrees, distances, closures, family relations, walks."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from truthframe.operators.relalg import compose
from truthframe.session import drop_written, map_arrow, materialize


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def with_identity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = F.col(nodes.columns[0])
    return edges.select("src", "dst").union(nodes.select(n, n)).distinct()


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, degree)``, 0 for nodes without an edge."""
    n = nodes.select(F.col(nodes.columns[0]).alias("node"))
    counts = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return n.join(counts, "node", "left").fillna(0, ["degree"])


def distances(edges: DataFrame, nodes: DataFrame, limit: int | None = None, pairs: bool = False) -> DataFrame:
    """``(src, dst, dist)`` of the reachable pairs within ``limit`` steps, 0 on the diagonal.

    A frontier join per step: only pairs reached for the first time go on, so the work is that of the answer. With
    ``pairs`` unreachable pairs come out too, with n + 1 for n nodes; that answer has n * n rows by definition.
    """
    n = F.col(nodes.columns[0])
    e = materialize(edges.select(F.col("src").alias("via"), "dst").distinct(), "edges")
    found = frontier = materialize(nodes.select(n.alias("src"), n.alias("dst"), F.lit(0).alias("dist")).distinct(), "frontier")
    step = 0
    while limit is None or step < limit:
        step += 1
        reach = frontier.select("src", F.col("dst").alias("via")).join(e, "via").select("src", "dst").distinct()
        # every frontier stays a table of its own; none is written again
        frontier = materialize(reach.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(step)), "frontier")
        if not frontier.head(1):
            break
        found = found.unionByName(frontier)
    drop_written(e)
    if not pairs:
        return found
    far = nodes.count() + 1
    every = nodes.select(n.alias("src")).crossJoin(nodes.select(n.alias("dst")))
    return every.join(found, ["src", "dst"], "left").withColumn("dist", F.coalesce("dist", F.lit(far)))


def k_connected(edges: DataFrame, nodes: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Pairs at most k steps apart."""
    out = distances(edges, nodes, k).select("src", "dst")
    return out.filter("src != dst") if exclude_self else out


def closure(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node)``: the seeds and all that edges lead to from them, within ``rounds`` steps if given; seeds stay where they are found, frontier by frontier."""
    found = materialize(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), "closure")
    frontier = found
    e = edges.select(F.col("src").alias("node"), "dst")
    step = 0
    while rounds is None or step < rounds:
        step += 1
        fresh = materialize(frontier.join(e, "node").select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti"), "frontier")
        if not fresh.head(1):
            break
        found, frontier = materialize(found.unionByName(fresh), "closure"), fresh
    return found


#: Edges that one task takes to finish the peeling of ``on_cycle`` by itself.
PEELED = 200_000


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges left of all ``(a, b, src, dst)`` in one task, node after node."""
    rows = list(batches)
    if not rows:
        return
    edges = pa.Table.from_batches(rows)
    a, b = edges.column("a").to_pylist(), edges.column("b").to_pylist()
    out, into, left = defaultdict(list), defaultdict(list), [True] * len(a)
    for i, (x, y) in enumerate(zip(a, b)):
        out[x].append(i), into[y].append(i)
    leaving, coming = {x: len(i) for x, i in out.items()}, {y: len(i) for y, i in into.items()}
    free = deque(x for x in {*a, *b} if not leaving.get(x) or not coming.get(x))
    while free:
        x = free.popleft()
        for i in (*out[x], *into[x]):
            if not left[i]:
                continue
            left[i] = False
            for node, count in ((a[i], leaving), (b[i], coming)):
                count[node] -= 1
                if not count[node] and node != x:
                    free.append(node)
    yield from edges.select(["src", "dst"]).filter(pa.array(left, pa.bool_())).to_batches()


def on_cycle(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an incoming or an outgoing edge are taken away again and again: none if there is no cycle.

    A round takes only the ends of long paths away; once no more than ``PEELED`` edges are left, one task does the rest.
    """
    now = materialize(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    size = now.count()
    while size > PEELED:
        then = materialize(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
        drop_written(now)
        now, before, size = then, size, then.count()
        if size == before:
            return now
    key = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    return map_arrow(now.select(key("src").alias("a"), key("dst").alias("b"), "src", "dst").repartition(1), _peel, now.schema)


def chain_of_two(edges: DataFrame) -> DataFrame:
    """Nodes that are both the end of one edge and the start of another."""
    return edges.select(F.col("dst").alias("node")).join(edges.select(F.col("src").alias("node")), "node", "left_semi").distinct()


def transitive_reduction_step(edges: DataFrame) -> DataFrame:
    """Without the edges (c, a) for which there are (c, b) and (b, a)."""
    e = edges.select("src", "dst").distinct()
    long_way = e.select("src", F.col("dst").alias("via")).join(e.withColumnRenamed("src", "via"), "via").filter((F.col("src") != F.col("via")) & (F.col("via") != F.col("dst")))
    return e.join(long_way.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, cap: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes within k steps of the seeds as ``(node, hop)``, and the edges among them; with ``cap`` a node passes on to so many neighbours at most, in hash order."""
    found = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("hop", F.lit(0))
    e = edges.select(F.col("src").alias("node"), "dst").distinct()
    if cap is not None:
        w = Window.partitionBy("node").orderBy(F.xxhash64("node", "dst", F.lit(seed)), "dst")
        e = e.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= cap).drop("nth")
    for hop in range(1, k + 1):
        fresh = found.filter(F.col("hop") == hop - 1).join(e, "node").select(F.col("dst").alias("node"), F.lit(hop).alias("hop"))
        found = materialize(found.unionByName(fresh).groupBy("node").agg(F.min("hop").alias("hop")), "hops")
    inside = lambda c: found.select(F.col("node").alias(c))
    return found, edges.select("src", "dst").distinct().join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi").select("src", "dst")


def relabel(df: DataFrame, column: str, order: str) -> DataFrame:
    """``new_id`` from 0 in an order that is total."""
    from truthframe.operators.fuzzy_logic import with_rank

    return with_rank(df, order, "new_id").withColumn("new_id", F.col("new_id") - 1)


def adjacent_colors(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """``(node, color)``: colours that a node or a neighbour has; ``colors`` is (node, color)."""
    near = edges.select(F.col("src").alias("of"), F.col("dst").alias("node")).join(colors, "node").select(F.col("of").alias("node"), "color")
    return colors.select("node", "color").union(near).distinct()


# family relations over (rel, a, b): b is a's rel


def relative(family: DataFrame, *rels: str) -> DataFrame:
    return family.filter(F.col("rel").isin(*rels)).select("a", "b").distinct()


def parents(family: DataFrame) -> DataFrame:
    return relative(family, "father", "mother")


def has_relative(family: DataFrame, people: DataFrame, *rels: str) -> DataFrame:
    return people.join(relative(family, *rels).select(F.col("a").alias(people.columns[0])), people.columns[0], "left_semi")


def has_sister(family: DataFrame, people: DataFrame) -> DataFrame:
    """Those whose father has a daughter other than themselves."""
    p = people.columns[0]
    daughters = relative(family, "daughter").select(F.col("a").alias("f"), F.col("b").alias("d"))
    sisters = relative(family, "father").select(F.col("a").alias(p), F.col("b").alias("f")).join(daughters, "f").filter(F.col("d") != F.col(p))
    return people.join(sisters, p, "left_semi")


def grandparents(family: DataFrame, of: Sequence[str] = ("father", "mother")) -> DataFrame:
    """Parents' parents; ``of`` restricts the second step, to ``father`` for grandfathers."""
    return compose(parents(family), relative(family, *of))


def uncles(family: DataFrame) -> DataFrame:
    """Grandparents' sons other than the father."""
    return compose(grandparents(family), relative(family, "son")).join(relative(family, "father"), ["a", "b"], "left_anti")


def maternal_great_uncles(family: DataFrame) -> DataFrame:
    """Sons of the grandmother's mother."""
    grandmother = grandparents(family, ("mother",))
    return compose(compose(grandmother, relative(family, "mother")), relative(family, "son"))


def random_graph(spark: SparkSession, nodes: int, edge_share: float, seed: int = 0) -> DataFrame:
    """Each ordered pair of different nodes is an edge with the given probability; quadratic in ``nodes`` by definition."""
    n = spark.range(nodes)
    pairs = n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst"))).filter("src != dst")
    return pairs.filter(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) < edge_share * 1_000_000)


def nearest_neighbours(points: DataFrame, k: int, cells: int = 1) -> DataFrame:
    """``(src, dst)`` to the k nearest of ``(node, x, y)`` within the node's cell of a grid; one cell compares all."""
    p = points.withColumn("cell", F.floor(F.col("x") * cells) * cells + F.floor(F.col("y") * cells))
    a, b = p.toDF("src", "x", "y", "cell"), p.toDF("dst", "x2", "y2", "cell")
    d = F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2))
    w = Window.partitionBy("src").orderBy("d", "dst")
    return a.join(b, "cell").filter("src != dst").withColumn("d", d).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select("src", "dst")


def random_family(spark: SparkSession, people: int, generations: int = 4, seed: int = 0) -> DataFrame:
    """``(rel, a, b)``: couples of neighbouring ids of one generation, children hashed to couples of the generation before."""
    per = people // generations // 2 * 2
    p = spark.range(per * generations).select(F.col("id"), F.floor(F.col("id") / per).alias("g"), (F.col("id") % 2 == 0).alias("male"))
    wife = p.filter("male").select(F.lit("wife").alias("rel"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    husband = wife.select(F.lit("husband"), "b", "a")
    couple = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(per // 2)) * 2 + (F.col("g") - 1) * per
    kids = p.filter("g > 0").select("id", "male", couple.alias("father"), (couple + 1).alias("mother"))
    up = kids.select(F.lit("father"), "id", "father").union(kids.select(F.lit("mother"), "id", "mother"))
    kid = F.when(F.col("male"), "son").otherwise("daughter")
    down = kids.select(kid, "father", "id").union(kids.select(kid, "mother", "id"))
    return wife.union(husband).union(up).union(down)


def sort_state(df: DataFrame, position: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """How every pair of places compares, in position and in value (lt, eq, gt)."""
    from truthframe.operators.relalg import meshgrid

    rows = df.select(*by, F.col(position).alias("place"), F.col(position).alias("position"), F.col(value).alias("value"))
    return meshgrid(rows, "place", ["position", "value"], "cmp", by)


def optimal_swaps(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row: the fewest swaps that sort, the number of places less the cycles of the sorting permutation."""
    from truthframe.operators.components import connected_components
    from truthframe.operators.fuzzy_logic import with_rank

    ranked = with_rank(df.select(F.struct(value, position).alias("v"), F.col(position).alias("p")), "v", "goal").withColumn("goal", F.col("goal") - 1)
    base = with_rank(ranked.select("p", "goal"), "p", "now").withColumn("now", F.col("now") - 1)
    moved = connected_components(base.select(F.col("now").cast("long").alias("src"), F.col("goal").cast("long").alias("dst")))
    return moved.agg((F.count("*") - F.countDistinct("component")).alias("swaps"))


# walks over (s, p, o)


def random_walks(edges: DataFrame, roots: DataFrame, depth: int, cap: int | None = None, seed: int = 0) -> DataFrame:
    """``(root, walk)``: all walks of up to ``depth`` hops, entities and predicates in turn; a walk ends early where nothing follows.

    With ``cap`` a root keeps so many walks in hash order at each hop.
    """
    r = F.col(roots.columns[0])
    walks = roots.select(r.alias("root"), F.array(r.cast("string")).alias("walk"), r.alias("end"))
    e = edges.select(F.col("s").alias("end"), F.col("p").cast("string").alias("p"), F.col("o"))
    for hop in range(depth):
        grown = F.when(F.col("o").isNotNull(), F.concat("walk", F.array("p", F.col("o").cast("string")))).otherwise(F.col("walk"))
        # a walk that has ended has a null end and finds nothing more
        walks = walks.join(e, "end", "left").select("root", grown.alias("walk"), F.col("o").alias("end"))
        if cap is not None:
            w = Window.partitionBy("root").orderBy(F.xxhash64("walk", F.lit(seed)), "walk")
            walks = walks.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= cap).drop("nth")
    return walks.select("root", "walk").distinct()


def wl_labels(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``(node, label)`` after Weisfeiler-Lehman rounds: md5 of the own label and the sorted distinct labels of those pointing here."""
    labels = nodes.select(F.col(nodes.columns[0]).alias("node"), F.col(nodes.columns[0]).cast("string").alias("label"))
    for _ in range(rounds):
        sent = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).join(labels, "node").select(F.col("to").alias("node"), F.col("label").alias("got"))
        heard = sent.distinct().groupBy("node").agg(F.array_sort(F.collect_set("got")).alias("got"))
        labels = labels.join(heard, "node", "left").select("node", F.md5(F.concat_ws("-", "label", F.concat_ws("-", F.coalesce("got", F.array().cast("array<string>"))))).alias("label"))
    return labels


def walklets(walks: DataFrame) -> DataFrame:
    """``(root, hop n)`` pairs of each walk."""
    w = F.col("walk")
    return walks.select("root", F.explode(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda x: F.array(F.element_at(w, 1), x))).alias("walk")).distinct()


def anonymous(walks: DataFrame) -> DataFrame:
    """Every hop named by the place of its first appearance."""
    w = F.col("walk")
    return walks.select("root", F.transform(w, lambda x, i: F.when(i == 0, x).otherwise((F.array_position(w, x) - 1).cast("string"))).alias("walk")).distinct()


def wildcards(walks: DataFrame, hops: Sequence[int]) -> DataFrame:
    """The walks, and those with one of the given hops replaced by ``*``."""
    w = F.col("walk")

    def starred(h: int) -> DataFrame:
        return walks.filter(F.size(w) > h).select("root", F.transform(w, lambda x, i: F.when(i == h, F.lit("*")).otherwise(x)).alias("walk"))

    out = walks
    for h in hops:
        out = out.union(starred(h))
    return out.distinct()


def ngrams(walks: DataFrame, n: int) -> DataFrame:
    """Walks of n-grams: after the root, every n consecutive hops joined to one."""
    w = F.col("walk")
    starts = F.sequence(F.lit(2), F.greatest(F.size(w) - n + 1, F.lit(2)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), "|"))
    return walks.select("root", F.when(F.size(w) - 1 >= n, F.concat(F.slice(w, 1, 1), grams)).otherwise(w).alias("walk")).distinct()


def halk(walks: DataFrame, least: float) -> DataFrame:
    """Walks without hops that occur in less than the share ``least`` of the walks; the root stays."""
    total = walks.agg(F.count("*").alias("total"))
    w = F.col("walk")
    hop = walks.select(F.explode(F.array_distinct(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))))).alias("hop")).groupBy("hop").agg(F.count("*").alias("n"))
    rare = hop.crossJoin(F.broadcast(total)).filter(F.col("n") < F.col("total") * least).select("hop")
    parts = walks.withColumn("id", F.xxhash64("root", "walk")).select("id", "root", F.posexplode("walk").alias("i", "hop"))
    kept = parts.filter("i = 0").unionByName(parts.filter("i > 0").join(rare, "hop", "left_anti").select(*parts.columns))
    order = F.array_sort(F.collect_list(F.struct("i", "hop")))
    return kept.groupBy("id", "root").agg(F.transform(order, lambda r: r["hop"]).alias("walk")).select("root", "walk").distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, community)``: every node takes its neighbours' most frequent label, the smallest of several, for so many rounds."""
    e = undirected(edges).filter("src != dst")
    labels = materialize(e.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct(), "communities")
    for _ in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst", "community").agg(F.count("*").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best")
        then = materialize(votes.groupBy(F.col("dst").alias("node")).agg(best).select("node", "best.community"), "communities")
        drop_written(labels)
        labels = then
    return labels


def community_walks(edges: DataFrame, roots: DataFrame, depth: int, hop_share: float = 0.1, seed: int = 0) -> DataFrame:
    """Random walks in which some hops, chosen by hash, jump to another member of the end's community, marked ``community``."""
    c = label_propagation(edges.select(F.col("s").alias("src"), F.col("o").alias("dst")))
    w = Window.partitionBy("community").orderBy("node")
    ordered = c.withColumn("nth", F.row_number().over(w))
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    placed = ordered.join(sizes, "community")
    target = placed.select("node", "community", (F.pmod(F.xxhash64("node", F.lit(seed)), F.col("size")) + 1).cast("int").alias("nth"))
    jumps = target.join(ordered.withColumnRenamed("node", "o"), ["community", "nth"]).filter("node != o").select(F.col("node").alias("s"), F.lit("community").alias("p"), "o")
    chosen = jumps.filter(F.pmod(F.xxhash64("s", "o", F.lit(seed)), F.lit(1000)) < hop_share * 1000)
    return random_walks(edges.select("s", "p", "o").union(chosen), roots, depth)


# blocks world: (world, block, under), the ground being block 0


def clear_blocks(on: DataFrame) -> DataFrame:
    """Blocks with nothing on them."""
    return on.select("world", "block").join(on.select("world", F.col("under").alias("block")), ["world", "block"], "left_anti")


def move_block(on: DataFrame, moves: DataFrame) -> DataFrame:
    """After moves ``(world, block, target)``: those of a clear block onto another clear one or the ground; others change nothing."""
    clear = clear_blocks(on)
    may = moves.join(clear, ["world", "block"], "left_semi").filter("block != target")
    onto = may.join(clear.select("world", F.col("block").alias("target")), ["world", "target"], "left_semi").unionByName(may.filter("target = 0").select("world", "target", "block"))
    return on.join(onto.distinct(), ["world", "block"], "left").select("world", "block", F.coalesce("target", "under").alias("under"))


def block_depths(on: DataFrame, limit: int | None = None) -> DataFrame:
    """``(world, block, depth, path)``: steps above the ground and the blocks below, from the ground up, to depth ``limit`` if given."""
    level = on.filter("under = 0").select("world", "block", F.lit(1).alias("depth"), F.array("block").alias("path"))
    out = level
    depth = 1
    while limit is None or depth < limit:
        depth += 1
        level = materialize(on.join(level.select("world", F.col("block").alias("under"), "path"), ["world", "under"]).select("world", "block", F.lit(depth).alias("depth"), F.concat("path", F.array("block")).alias("path")), "levels")
        if not level.head(1):
            break
        out = out.unionByName(level)
    return out


def goal_reached(on: DataFrame, goal: DataFrame) -> DataFrame:
    """``(world, reached)``: whether every block lies on what the goal says."""
    both = goal.select("world", "block", F.col("under").alias("wanted")).join(on, ["world", "block"], "left")
    return both.groupBy("world").agg(F.bool_and(F.coalesce(F.col("under") == F.col("wanted"), F.lit(False))).alias("reached"))



def pairs_at_distance(edges: DataFrame, nodes: DataFrame, dist: int, most: int | None = None, seed: int = 0) -> DataFrame:
    """``(src, dst)`` exactly so many steps apart; ``most`` takes that many in hash order, as a task sampler does."""
    out = distances(edges, nodes, dist).filter(F.col("dist") == dist).select("src", "dst")
    return out.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(most) if most is not None else out


def mask_neighbours(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``(node, hop, name)``: nodes within k steps of the seeds under neutral names, numbered by hop and then by node."""
    found, _ = k_hop(edges, seeds, k)
    named = relabel(found.withColumn("key", F.struct("hop", "node")), "node", "key")
    return named.select("node", "hop", F.concat(F.lit("concept"), F.col("new_id").cast("string")).alias("name"))


def prediction_samples(edges: DataFrame, labels: DataFrame, k: int = 1) -> DataFrame:
    """``(node, label, context)``: each labelled node with its sorted neighbours within k steps, for node-level tasks."""
    near = distances(edges, labels.select("node"), k).filter("dist > 0").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("context"))
    return labels.join(near, "node", "left").withColumn("context", F.coalesce("context", F.array().cast(near.schema["context"].dataType)))
