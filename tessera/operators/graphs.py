"""Graph operations over edge DataFrames: for graphs that don't fit a driver's matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions of undirected edges (a, b)."""
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def unshielded_triples(edges: DataFrame) -> DataFrame:
    """(x, y, z), x < z, of paths x - y - z whose ends aren't adjacent."""
    e = both_ways(edges)
    left, right = e.select(F.col("a").alias("x"), F.col("b").alias("y")), e.select(F.col("a").alias("y"), F.col("b").alias("z"))
    return left.join(right, "y").where("x < z").join(e.select(F.col("a").alias("x"), F.col("b").alias("z")), ["x", "z"], "left_anti").select("x", "y", "z")


def meek_first(arrows: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines b - c (as b, c) that become b -> c as some a -> b has a and c apart."""
    line = both_ways(lines)
    adjacent = both_ways(arrows.select("a", "b").union(lines.select("a", "b")))
    paths = arrows.select(F.col("a"), F.col("b")).join(line.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c")
    return paths.join(adjacent.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti").select("b", "c").distinct()


def ancestors(arrows: DataFrame) -> DataFrame:
    """(node, ancestor) pairs of a directed graph, cycles allowed: paths double in length each round, until none is new.

    Each round joins what is new with everything known on both sides and ends in a checkpoint.
    """
    reach = cut(arrows.select(F.col("b").alias("node"), F.col("a").alias("ancestor")).distinct())
    new = reach

    def through(left, right):
        return left.alias("l").join(right.alias("r"), F.col("l.ancestor") == F.col("r.node")).select("l.node", "r.ancestor")

    while True:
        longer = through(new, reach).union(through(reach, new)).distinct()
        new = cut(longer.join(reach, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return reach
        reach = cut(reach.union(new))


def markov_blankets(arrows: DataFrame) -> DataFrame:
    """(node, member): parents, children and the children's other parents."""
    parents = arrows.select(F.col("b").alias("node"), F.col("a").alias("member"))
    children = arrows.select(F.col("a").alias("node"), F.col("b").alias("member"))
    spouses = children.join(parents.select(F.col("node").alias("member"), F.col("member").alias("other")), "member").where("other <> node").select("node", F.col("other").alias("member"))
    return parents.union(children).union(spouses).distinct()


def summary_of_lags(links: DataFrame) -> DataFrame:
    """(cause, effect, lags): links merged over lags."""
    return links.groupBy("cause", "effect").agg(F.array_join(F.transform(F.sort_array(F.collect_set("lag")), lambda x: x.cast("string")), ",").alias("lags"))


def vote(fits: DataFrame, n_fits: int) -> DataFrame:
    """(i, j, mark_i, mark_j, frequency) over the edges of many fits."""
    return fits.groupBy("i", "j", "mark_i", "mark_j").agg((F.count("*") / n_fits).alias("frequency"))


def shared_members(sets: DataFrame, key: str, member: str) -> DataFrame:
    """(member, sets, in_all): in how many of the sets (rows key, member) each member is, and whether in every one.

    The number of sets is one row, and so are two counts of a member: nothing but partial counts is shuffled.
    """
    members = sets.select(key, member).distinct()
    n = sets.select(key).distinct().count()
    return members.groupBy(member).agg(F.count("*").alias("sets")).withColumn("in_all", F.col("sets") == n)


def strongest(candidates: DataFrame, target: str, candidate: str, strength: str, most: int) -> DataFrame:
    """The `most` strongest candidates of each target, ties by the candidate; tasks keep so many each before the shuffle."""
    place = F.row_number().over(Window.partitionBy(target).orderBy(F.col(strength).desc(), candidate))
    return candidates.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def separating_sets(tests: DataFrame, alpha: float) -> DataFrame:
    """(x, y, sepset, p) of the tests (x, y, s, p) that don't reject: the union of a pair's sets and their largest p-value."""
    members = tests.where(F.col("p") > alpha).select("x", "y", "p", F.explode_outer("s").alias("v"))
    return members.groupBy("x", "y").agg(F.array_sort(F.collect_set("v")).alias("sepset"), F.max("p").alias("p"))


def best_moves(moves: DataFrame, target: str, move: str, delta: str, digits: int = 9) -> DataFrame:
    """Each target's move of the least delta rounded to `digits`, ties by the move: (target, move, delta)."""
    best = F.min(F.struct(F.round(delta, digits).alias("d"), F.col(move).alias("m")))
    return moves.groupBy(target).agg(best.alias("__best")).select(target, F.col("__best.m").alias(move), F.col("__best.d").alias(delta))


#: Rows of knowledge up to which it is broadcast.
MOST_KNOWLEDGE = 100_000


def permitted(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """The candidate edges (a, b) without those that a table of knowledge, a or b or both of them, forbids."""
    few = forbidden.limit(MOST_KNOWLEDGE + 1).count() <= MOST_KNOWLEDGE
    return edges.join(F.broadcast(forbidden) if few else forbidden, forbidden.columns, "left_anti").select("a", "b")
