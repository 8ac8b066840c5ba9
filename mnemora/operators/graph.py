"""Graphs of causes and similarity: traversal by levels, components, overlap.

Iterations write each round's frontier to the shared folder, which cuts the
lineage; what a round moves is its frontier, not the graph. Edges with a null
end and loops are left out, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora import workspace


def edges_of(nodes: DataFrame, key: str = "node_id", parents: str = "causal_parents") -> DataFrame:
    """(source, target): one row a causal edge, parent to child."""
    e = nodes.select(F.explode(parents).alias("source"), F.col(key).alias("target"))
    return e.where("source is not null and target is not null and source <> target").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    both = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def spread_activation(edges: DataFrame, seeds: DataFrame, *, hops: int = 3, strength: float = 0.5, least: float = 0.01, directed: bool = False) -> DataFrame:
    """(node, score, depth): scores of seeds (node, score) carried along edges, level by level.

    A hop at depth d gives score * .5 ** (d + 1) * strength; a node is reached
    once, at its least depth, with the greatest score offered there.
    """
    links = edges.select("source", "target") if directed else both_ways(edges)
    seen = workspace.materialise(seeds.groupBy("node").agg(F.max("score").cast("double").alias("score")).withColumn("depth", F.lit(0)), "seen")
    front = seen
    for d in range(hops):
        step = (
            front.join(links, front.node == links.source)
            .select(F.col("target").alias("node"), (F.col("score") * 0.5 ** (d + 1) * strength).alias("score"))
            .where(F.col("score") > least)
            .groupBy("node").agg(F.max("score").alias("score"))
            .join(seen.select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(d + 1))
        )
        front = workspace.materialise(step, "front")
        seen = seen.unionByName(front)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node, depth): everything a seed (node) reaches along the edges, at its least depth, however far; a seed on a cycle does not reach itself."""
    seen = workspace.materialise(seeds.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "reach")
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        step = front.join(edges, front.node == edges.source).select("root", F.col("target").alias("node")).distinct()
        front = workspace.materialise(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def adjustment_sets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, parent): the parents of each seed (node) that it does not itself reach."""
    below = reachable(edges, seeds).select(F.col("root").alias("node"), F.col("node").alias("parent"))
    above = edges.join(seeds, edges.target == seeds.node, "left_semi").select(F.col("target").alias("node"), F.col("source").alias("parent")).distinct()
    return above.join(below, ["node", "parent"], "left_anti")


def front_doors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cause, effect, mediators): what each seed reaches over one node between."""
    first = edges.join(seeds, edges.source == seeds.node, "left_semi").select(F.col("source").alias("cause"), F.col("target").alias("mediator"))
    second = edges.select(F.col("source").alias("mediator"), F.col("target").alias("effect"))
    return first.join(second, "mediator").where("cause <> effect").groupBy("cause", "effect").agg(F.count("*").alias("mediators"))


def do_probability(pairs: DataFrame, strengths: DataFrame, singles: DataFrame, joint: DataFrame) -> DataFrame:
    """``pairs`` (cause, effect) with ``p``: the edge's strength, else the share of the cause's observations (item, n) that
    both are in (a, b, n), at most 1; .5 where the cause was met under three times."""
    n = singles.select(F.col("item").alias("cause"), F.col("n").alias("n_cause"))
    both = joint.select(F.col("a").alias("cause"), F.col("b").alias("effect"), F.col("n").alias("n_both"))
    j = pairs.join(strengths.select("cause", "effect", "strength"), ["cause", "effect"], "left").join(n, "cause", "left").join(both, ["cause", "effect"], "left")
    naive = F.when(F.coalesce("n_cause", F.lit(0)) < 3, 0.5).otherwise(F.least(F.lit(1.0), F.coalesce("n_both", F.lit(0)) / F.col("n_cause")))
    return j.select("cause", "effect", F.coalesce("strength", naive).alias("p"))


def counterfactual(p: DataFrame, targets: DataFrame, interventions: DataFrame) -> DataFrame:
    """(target, by, p): for each target (node) the intervention (node) of greatest probability; 1 where it is set itself, .5 where nothing leads to it."""
    best = p.join(interventions.select(F.col("node").alias("cause")), "cause", "left_semi").where("p > 0").groupBy("effect").agg(F.min(F.struct((-F.col("p")).alias("m"), "cause")).alias("b"))
    t = targets.select(F.col("node").alias("target")).join(best.withColumnRenamed("effect", "target"), "target", "left")
    own = t.join(interventions.select(F.col("node").alias("target"), F.lit(True).alias("own")), "target", "left")
    by = F.when(F.col("own"), F.col("target")).otherwise(F.col("b.cause"))
    return own.select("target", by.alias("by"), F.when(F.col("own"), 1.0).otherwise(F.coalesce(-F.col("b.m"), F.lit(0.5))).alias("p"))


def contradictions(strengths: DataFrame, singles: DataFrame, joint: DataFrame, total: int, *, least: float = 0.1, threshold: float = 0.3) -> DataFrame:
    """(a, b, effect, ratio): causes of one effect, each stronger than ``least``, that are met together by ``threshold`` less often than by chance."""
    e = strengths.where(F.col("strength") > least).select("cause", "effect")
    pairs = e.select(F.col("cause").alias("a"), "effect").join(e.select(F.col("cause").alias("b"), "effect"), "effect").where("a < b")
    one = lambda k: singles.select(F.col("item").alias(k), F.col("n").alias(f"n{k}"))
    ratio = F.coalesce("n", F.lit(0)) / (F.col("na") * F.col("nb") / F.lit(float(total)))
    j = pairs.join(one("a"), "a").join(one("b"), "b").join(joint, ["a", "b"], "left").withColumn("ratio", ratio)
    return j.where(F.col("ratio") < 1 - threshold).select("a", "b", "effect", "ratio")


def unsafe_merges(pairs: DataFrame, edges: DataFrame, strengths: DataFrame, opposed: DataFrame) -> DataFrame:
    """(a, b, reason) of candidate merges (a, b) that causes speak against: an edge or a path between them, effects of very different strength, a contradiction."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    paths = reachable(edges, ends)
    both = lambda df, x, y: pairs.join(df.select(F.col(x).alias("a"), F.col(y).alias("b")), ["a", "b"], "left_semi").unionByName(pairs.join(df.select(F.col(y).alias("a"), F.col(x).alias("b")), ["a", "b"], "left_semi"))
    direct, path = both(edges, "source", "target"), both(paths, "root", "node")
    side = lambda k: strengths.select(F.col("cause").alias(k), "effect", F.col("strength").alias(f"s{k}"))
    differ = pairs.join(side("a"), "a").join(side("b"), ["b", "effect"]).where("abs(sa - sb) > 0.4").select("a", "b")
    against = pairs.join(opposed.select("a", "b"), ["a", "b"], "left_semi")
    reasons = [(direct, "causal relationship"), (path, "causal path"), (differ, "opposing effects"), (against, "contradiction")]
    out = None
    for df, why in reasons:
        one = df.distinct().withColumn("reason", F.lit(why))
        out = one if out is None else out.unionByName(one)
    return out


def carried_bonus(edges: DataFrame, seeds: DataFrame, *, hops: int = 2, strength: float = 0.5) -> DataFrame:
    """(query_id, node, bonus): scores of seeds (query_id, node, score) carried to causes and effects and added up over all ways; a hop at depth d gives score * strength * .5 ** d."""
    links = both_ways(edges)
    front, total = seeds, None
    for d in range(hops):
        step = front.join(links, front.node == links.source).groupBy("query_id", F.col("target").alias("node")).agg((F.sum("score") * strength * 0.5**d).alias("score"))
        front = workspace.materialise(step, "bonus")
        total = front if total is None else total.unionByName(front)
    return total.groupBy("query_id", "node").agg(F.sum("score").alias("bonus"))


def conflicts(rules: DataFrame, *, gap: float = 0.3) -> DataFrame:
    """(a, b): rules (rule, head, body, weight) of one head and one body whose weights differ by more than ``gap``."""
    key = F.concat_ws("\u0001", "head", F.array_sort("body"))
    r = rules.select("rule", "weight", key.alias("k"))
    # rules of one key are ordered by weight; the lightest and the heaviest tell whether any two conflict
    x, y = r.alias("x"), r.alias("y")
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.rule") < F.col("y.rule")))
    return pairs.where(F.abs(F.col("x.weight") - F.col("y.weight")) > gap).select(F.col("x.rule").alias("a"), F.col("y.rule").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, named by their least node.

    Alternating large-star and small-star steps: each round hangs a node's
    larger neighbours, then its smaller ones, on the least of them, so that the
    rounds grow with the logarithm of the component's size.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = both_ways(e) if large else e.select(F.greatest("source", "target").alias("source"), F.least("source", "target").alias("target")).distinct()
        least = pairs.groupBy("source").agg(F.min("target").alias("m")).select("source", F.least("m", "source").alias("m"))
        near = pairs.join(least, "source")
        if large:
            return near.where("target > source").select(F.col("target").alias("source"), F.col("m").alias("target")).where("source <> target").distinct()
        own = least.select("source", F.col("m").alias("target"))
        return near.select(F.col("target").alias("source"), F.col("m").alias("target")).unionByName(own).where("source <> target").distinct()

    current = workspace.materialise(edges.select("source", "target"), "edges")
    nodes = both_ways(current).select(F.col("source").alias("node")).distinct()
    digest = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("source", "target").cast("decimal(38,0)")), F.lit(0))).first())
    before = None
    while True:
        current = workspace.materialise(star(star(current, True), False), "edges")
        now = digest(current)
        if now == before:
            break
        before = now
    return nodes.join(current.select(F.col("source").alias("node"), F.col("target").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def colliders(edges: DataFrame) -> DataFrame:
    """(a, b, target): pairs of causes, a < b, of one effect that are not themselves linked."""
    e = edges.select("source", "target")
    pairs = e.alias("x").join(e.alias("y"), (F.col("x.target") == F.col("y.target")) & (F.col("x.source") < F.col("y.source")))
    found = pairs.select(F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.target").alias("target"))
    linked = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return found.join(linked, ["a", "b"], "left_anti")


def independence(pairs: DataFrame, singles: DataFrame, total: int, *, limit: float = 3.84) -> DataFrame:
    """(a, b, chi2) of pairs (a, b, n) whose chi-square against singles (item, n) reaches ``limit``.

    Pairs with under 2 joint or 3 single observations, or under 5 expected, count as independent.
    """
    one = lambda k: singles.select(F.col("item").alias(k), F.col("n").alias(f"n{k}"))
    expected = F.col("na") * F.col("nb") / F.lit(float(total))
    j = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("e", expected)
    chi2 = F.pow(F.col("n") - F.col("e"), 2) / F.col("e")
    return j.where("n >= 2 and na >= 3 and nb >= 3 and e >= 5").withColumn("chi2", chi2).where(F.col("chi2") >= limit).select("a", "b", "chi2")


def forward_chain(facts: DataFrame, rules: DataFrame, *, rounds: int = 3, least: float = 0.65) -> DataFrame:
    """(item, conf): facts (item, conf) and what rules (rule, head, body, weight) with body arrays derive from them.

    A rule fires when every body item holds with at least ``least``; its head
    gets weight * the least of the body's confidences, if that is enough.
    """
    known = workspace.materialise(facts.where(F.col("conf") >= least).groupBy("item").agg(F.max("conf").alias("conf")), "facts")
    parts = rules.select("rule", "head", "weight", F.size("body").alias("need"), F.explode("body").alias("item"))
    for _ in range(rounds):
        fired = (
            parts.join(known, "item").groupBy("rule", "head", "weight", "need").agg(F.count("*").alias("met"), F.min("conf").alias("c"))
            .where("met = need").select(F.col("head").alias("item"), (F.col("weight") * F.col("c")).alias("conf"))
            .where(F.col("conf") >= least).groupBy("item").agg(F.max("conf").alias("conf"))
            .join(known.select("item"), "item", "left_anti")
        )
        new = workspace.materialise(fired, "fired")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def overlap_pairs(members: DataFrame, *, least: float = 0.7) -> DataFrame:
    """(a, b, jaccard): groups (group, item) whose item sets agree in at least ``least``, a < b.

    Found by prefix: the rarest items that must hold one in common. A pair of
    such sets shares an item among the first size - ceil(least * size) + 1 of
    each, so common items are joined only where they are that rare.
    """
    from pyspark.sql import Window

    m = members.distinct()
    df = m.groupBy("item").agg(F.count("*").alias("df"))
    sized = m.join(df, "item").withColumn("size", F.count("*").over(Window.partitionBy("group")))
    place = F.row_number().over(Window.partitionBy("group").orderBy("df", "item"))
    prefix = sized.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("group", "item", "size")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.group") < F.col("y.group")) & (F.col("x.size") * least <= F.col("y.size")) & (F.col("y.size") * least <= F.col("x.size")))
    pairs = near.select(F.col("x.group").alias("a"), F.col("y.group").alias("b"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb")).distinct()
    both = pairs.join(m.select(F.col("group").alias("a"), "item"), "a").join(m.select(F.col("group").alias("b"), "item"), ["b", "item"])
    j = both.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n")).withColumn("jaccard", F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")))
    return j.where(F.col("jaccard") >= least - 1e-9).select("a", "b", "jaccard")
