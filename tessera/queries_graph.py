"""Queries of graph operators over a graph of the nations, with SQL that walks its edges by recursion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.operators.ci import Oracle
from tessera.plans import orient
from tessera.plans.constraint import pc
from tessera.plans.graph import ARROW, TAIL, Graph
from tessera.plans.knowledge import Knowledge
from tessera.queries import query, r6, sql6, table
from tessera.queries_search import meek_sql

#: Arrows between nations: acyclic by a shuffled number of theirs, and sparse.
ARROWS = "(a.n_nationkey * 7) % 25 < (b.n_nationkey * 7) % 25 AND (a.n_nationkey * 7 + b.n_nationkey * 13) % {m} < {k}"


def edges_sql(name: str, m: int = 19, k: int = 2) -> str:
    return f"{name} AS (SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE {ARROWS.format(m=m, k=k)})"


E = "WITH RECURSIVE " + edges_sql("e")
UP = ", up AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey AS BIGINT) AS above FROM nation UNION SELECT up.node, e.a FROM up JOIN e ON e.b = up.above)"


def nations(spark, sf_dir, m: int = 19, k: int = 2) -> Graph:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    found = n.alias("a").join(n.alias("b"), F.expr(ARROWS.format(m=m, k=k))).select("a.n_nationkey", "b.n_nationkey").collect()
    size = n.count()
    a = np.zeros((size, size), bool)
    for i, j in found:
        a[i, j] = True
    return Graph.of_dag(a, [str(i) for i in range(size)])


def _pairs(spark, rows, more: str = ""):
    return spark.createDataFrame(rows, "a long, b long" + more)


@query(E + UP + """, blanket AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT l.a, r.a FROM e l JOIN e r ON l.b = r.b AND l.a <> r.a)
SELECT b AS node, 'parent' AS relation, a AS other FROM e UNION ALL SELECT a, 'child', b FROM e UNION ALL SELECT a, 'neighbor', b FROM e UNION ALL SELECT b, 'neighbor', a FROM e
UNION ALL SELECT node, 'ancestor', above FROM up WHERE node <> above UNION ALL SELECT above, 'descendant', node FROM up WHERE node <> above UNION ALL SELECT x, 'blanket', y FROM blanket""")
def graph_relations(spark, sf_dir):
    """Parents, children, neighbours, ancestors, descendants and Markov blankets of all nodes."""
    g = nations(spark, sf_dir)
    ask = {"parent": g.parents, "child": g.children, "neighbor": g.neighbors, "ancestor": g.ancestors, "descendant": g.descendants, "blanket": g.markov_blanket}
    return spark.createDataFrame([(int(v), name, int(o)) for v in g.labels for name, f in ask.items() for o in f(v)], "node long, relation string, other long")


MORAL = """, q AS (SELECT x.n_nationkey AS x, y.n_nationkey AS y, z.n_nationkey AS z FROM nation x, nation y, nation z WHERE x.n_nationkey < y.n_nationkey AND z.n_nationkey NOT IN (x.n_nationkey, y.n_nationkey)),
own AS (SELECT DISTINCT x, y, z, above AS v FROM q JOIN up ON up.node IN (q.x, q.y, q.z)),
moral AS (SELECT o.x, o.y, o.z, e.a AS u, e.b AS v FROM own o JOIN e ON e.b = o.v UNION SELECT o.x, o.y, o.z, e.b, e.a FROM own o JOIN e ON e.b = o.v UNION SELECT o.x, o.y, o.z, l.a, r.a FROM own o JOIN e l ON l.b = o.v JOIN e r ON r.b = o.v AND r.a <> l.a),
walk AS (SELECT x, y, z, x AS v FROM q UNION SELECT m.x, m.y, m.z, m.v FROM walk w JOIN moral m ON m.x = w.x AND m.y = w.y AND m.z = w.z AND m.u = w.v WHERE m.v <> m.z)"""


@query(E + UP + MORAL + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS given FROM q WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.x = q.x AND w.y = q.y AND w.z = q.z AND w.v = q.y)")
def separations(spark, sf_dir):
    """All pairs that each single node separates; the SQL asks the moral graph of the ancestors."""
    g = nations(spark, sf_dir)
    rows = [(x, y, z) for x in range(g.d) for y in range(x + 1, g.d) for z in range(g.d) if z not in (x, y) and g.separated(x, y, [z])]
    return spark.createDataFrame(rows, "x long, y long, given long")


CLASS = ", adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e), to0 AS (SELECT l.a, l.b FROM e l JOIN e r ON l.b = r.b AND l.a <> r.a WHERE NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = l.a AND t.b = r.a))" + meek_sql(8)
TYPED = " SELECT a, b, 'directed' AS type FROM to8 UNION ALL SELECT a, b, 'undirected' FROM adj WHERE a < b AND NOT EXISTS (SELECT 1 FROM to8 t WHERE (t.a = adj.a AND t.b = adj.b) OR (t.a = adj.b AND t.b = adj.a))"


def _typed(spark, g: Graph):
    return spark.createDataFrame([(int(a), int(b), t) for a, b, t in g.oriented_edges()], "a long, b long, type string")


@query(E + CLASS + TYPED)
def class_of_a_graph(spark, sf_dir):
    """The class of a directed graph: what all graphs of the same separations share."""
    return _typed(spark, nations(spark, sf_dir).to_cpdag())


@query(E + CLASS + TYPED)
def class_of_an_extension(spark, sf_dir):
    """A class has a member, whose class it is."""
    g = nations(spark, sf_dir)
    member = g.to_cpdag().to_dag()
    assert metrics.markov_equivalent(member, g)
    return _typed(spark, Graph(orient.cpdag_of(member.to_cpdag().marks), "cpdag", g.labels))


@query(E + CLASS + TYPED)
def pc_of_separations(spark, sf_dir):
    """PC asking the graph itself finds its class."""
    return _typed(spark, pc(None, test=Oracle(nations(spark, sf_dir))))


@query(E + CLASS + " SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b, CAST(1 AS BIGINT) AS entry FROM nation a, nation b WHERE EXISTS (SELECT 1 FROM adj WHERE adj.a = a.n_nationkey AND adj.b = b.n_nationkey) AND NOT EXISTS (SELECT 1 FROM to8 t WHERE t.a = a.n_nationkey AND t.b = b.n_nationkey)")
def class_as_matrix(spark, sf_dir):
    """The entries of the class's matrix where column j points to row i, there and back through that form."""
    g = nations(spark, sf_dir).to_cpdag()
    m = Graph.from_pcalg(g.to_pcalg(), "cpdag", g.labels).to_pcalg()
    return _pairs(spark, [(int(i), int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], ", entry long")


@query(E + CLASS.replace("to0 AS (", "to0 AS (SELECT a, b FROM e WHERE a % 4 = 1 UNION ", 1).replace(meek_sql(8), meek_sql(8, rule4=True)) + TYPED)
def knowledge_in_a_class(spark, sf_dir):
    """The class, where knowledge requires the arrows out of every fourth node, and what follows by all four rules."""
    g = nations(spark, sf_dir)
    required = g.directed & (np.arange(g.d) % 4 == 1)[:, None]
    return _typed(spark, Graph(orient.apply_knowledge(g.to_cpdag().marks, required, np.zeros_like(required)), "cpdag", g.labels))


@query("WITH RECURSIVE " + edges_sql("e") + ", q AS (SELECT a, b FROM e WHERE a % 4 = 1), up AS (SELECT a, b FROM q UNION SELECT up.a, q.b FROM up JOIN q ON q.a = up.b) SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE a.n_regionkey > b.n_regionkey + 1 OR EXISTS (SELECT 1 FROM up WHERE up.b = a.n_nationkey AND up.a = b.n_nationkey AND a.n_nationkey <> b.n_nationkey)")
def knowledge_resolved(spark, sf_dir):
    """Forbidden pairs: by a table of pairs, and against the ways of required arrows."""
    g = nations(spark, sf_dir)
    region = {r["n_nationkey"]: r["n_regionkey"] for r in table(spark, sf_dir, "nation").collect()}
    forbidden = tuple((a, b) for a in g.labels for b in g.labels if region[int(a)] > region[int(b)] + 1)
    required = tuple((a, b) for a, b, _ in g.oriented_edges() if int(a) % 4 == 1)
    keep = tuple(e for e in required if e not in forbidden)
    c = Knowledge(required=keep, forbidden=forbidden).resolve(g.labels)
    c2 = Knowledge(required=required).resolve(g.labels)
    return _pairs(spark, [(int(i), int(j)) for i, j in zip(*np.nonzero(c.forbidden | c2.forbidden), strict=True)])


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a, nation b WHERE a.n_regionkey > b.n_regionkey")
def knowledge_tiers(spark, sf_dir):
    """Causes aren't in later tiers than their effects: the pairs that tiers forbid."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    tiers = tuple(tuple(str(r["n_nationkey"]) for r in rows if r["n_regionkey"] == k) for k in sorted({r["n_regionkey"] for r in rows}))
    c = Knowledge(tiers=tiers).resolve([str(k) for k in range(len(rows))])
    return _pairs(spark, [(int(i), int(j)) for i, j in zip(*np.nonzero(c.forbidden), strict=True)])


TWO = "WITH " + edges_sql("t") + ", " + edges_sql("f", 17, 3) + ", s AS (SELECT a, b FROM f WHERE (a + b) % 5 > 0 UNION SELECT b, a FROM f WHERE (a + b) % 5 = 0 UNION SELECT a, b FROM t WHERE (a + b) % 2 = 0), ts AS (SELECT least(a, b) AS a, greatest(a, b) AS b, a < b AS up FROM t), es AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(a < b) AS up, count(*) AS k FROM s GROUP BY 1, 2), both_ AS (SELECT ts.a IS NOT NULL AS t, es.a IS NOT NULL AS e, ts.up = es.up AND es.k = 1 AS same FROM ts FULL JOIN es ON ts.a = es.a AND ts.b = es.b)"


def _two(spark, sf_dir) -> tuple[Graph, Graph]:
    t, f = nations(spark, sf_dir), nations(spark, sf_dir, 17, 3)
    i, j = np.indices((t.d, t.d))
    turned = (i + j) % 5 == 0
    s = (f.directed & ~turned) | (f.directed & turned).T | (t.directed & ((i + j) % 2 == 0))
    return Graph(np.where(s & s.T, ARROW, s * TAIL + s.T * ARROW), "digraph", t.labels), t


@query(TWO + f" SELECT CAST(sum(CASE WHEN t AND e AND same THEN 0 ELSE 1 END) AS BIGINT) AS shd, {sql6('sum(CASE WHEN t AND e THEN 1.0 ELSE 0 END) / sum(CASE WHEN e THEN 1 ELSE 0 END)', 'precision')}, {sql6('sum(CASE WHEN t AND e THEN 1.0 ELSE 0 END) / sum(CASE WHEN t THEN 1 ELSE 0 END)', 'recall')}, {sql6('sum(CASE WHEN same THEN 1.0 ELSE 0 END) / sum(CASE WHEN t AND e THEN 1 ELSE 0 END)', 'direction')} FROM both_")
def graph_distances(spark, sf_dir):
    """Structural Hamming distance, skeleton precision and recall, and the share of found edges directed alike."""
    e, t = _two(spark, sf_dir)
    s = metrics.skeleton_scores(e, t)
    return spark.createDataFrame([(metrics.shd(e, t), s["precision"], s["recall"], metrics.direction_accuracy(e, t))], "shd long, precision double, recall double, direction double").withColumns({c: r6(c) for c in ("precision", "recall", "direction")})


@query(TWO + ", ah AS (SELECT a, b FROM t), eh AS (SELECT a, b FROM s), k AS (SELECT count(*) AS both_k FROM ah JOIN eh ON ah.a = eh.a AND ah.b = eh.b) SELECT " + sql6("both_k / CAST((SELECT count(*) FROM eh) AS DOUBLE)", "precision") + ", " + sql6("both_k / CAST((SELECT count(*) FROM ah) AS DOUBLE)", "recall") + " FROM k")
def arrowhead_scores(spark, sf_dir):
    """Precision and recall of arrowheads."""
    s = metrics.arrow_scores(*_two(spark, sf_dir))
    return spark.createDataFrame([(s["precision"], s["recall"])], "precision double, recall double").withColumns({c: r6(c) for c in ("precision", "recall")})


@query("WITH " + edges_sql("t") + " SELECT " + sql6("avg(CASE WHEN a < b THEN 1.0 ELSE 0 END)", "share") + " FROM t")
def order_agreement(spark, sf_dir):
    """Which share of the arrows an order of the nodes doesn't contradict."""
    g = nations(spark, sf_dir)
    return spark.createDataFrame([(metrics.order_agreement(list(g.labels), g),)], "share double").withColumn("share", r6("share"))


#: Hidden: every fifth node. Two others are joined if a walk over hidden ancestors alone connects them in the moral graph.
MAG = """, seen AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation WHERE n_nationkey % 5 > 0), q AS (SELECT x.v AS x, y.v AS y FROM seen x JOIN seen y ON x.v < y.v),
own AS (SELECT DISTINCT x, y, above AS v FROM q JOIN up ON up.node IN (q.x, q.y)),
moral AS (SELECT o.x, o.y, e.a AS u, e.b AS v FROM own o JOIN e ON e.b = o.v UNION SELECT o.x, o.y, e.b, e.a FROM own o JOIN e ON e.b = o.v UNION SELECT o.x, o.y, l.a, r.a FROM own o JOIN e l ON l.b = o.v JOIN e r ON r.b = o.v AND r.a <> l.a),
walk AS (SELECT x, y, x AS v FROM q UNION SELECT m.x, m.y, m.v FROM walk w JOIN moral m ON m.x = w.x AND m.y = w.y AND m.u = w.v WHERE m.v = m.y OR m.v % 5 = 0)"""


@query("WITH RECURSIVE " + edges_sql("e", 13, 2) + UP + MAG + " SELECT q.x AS a, q.y AS b, CAST(CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.node = q.y AND up.above = q.x) THEN 1 ELSE 2 END AS BIGINT) AS mark_a, CAST(CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.node = q.x AND up.above = q.y) THEN 1 ELSE 2 END AS BIGINT) AS mark_b FROM q JOIN walk w ON w.x = q.x AND w.y = q.y AND w.v = q.y")
def hidden_nodes(spark, sf_dir):
    """The projection of the graph over every fifth node: a maximal ancestral graph with its marks."""
    g = nations(spark, sf_dir, 13, 2)
    m = g.to_mag(latent=[v for v in g.labels if int(v) % 5 == 0])
    return _pairs(spark, [(int(m.labels[i]), int(m.labels[j]), a, b) for i, j, a, b in m.edges()], ", mark_a long, mark_b long")


@query("WITH " + edges_sql("e") + " SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(CASE WHEN a < b THEN 1 ELSE 2 END AS BIGINT) AS mark_a, CAST(CASE WHEN a < b THEN 2 ELSE 1 END AS BIGINT) AS mark_b FROM e")
def graph_as_table(spark, sf_dir):
    """The edges of a graph as a table, read back from one and shown again."""
    g = nations(spark, sf_dir)
    again = Graph.of_frame(g.frame(spark), g.labels, "dag").validate()
    return again.frame(spark).select(F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), F.col("mark_i").cast("long").alias("mark_a"), F.col("mark_j").cast("long").alias("mark_b"))


DEPTH = ", depth AS (SELECT CAST(n_nationkey AS BIGINT) AS v, 0 AS k FROM nation UNION SELECT e.b, depth.k + 1 FROM depth JOIN e ON e.a = depth.v)"


@query(E + DEPTH + ", d AS (SELECT v, max(k) AS k FROM depth GROUP BY v) SELECT count(*) AS arrows, CAST(sum(CASE WHEN x.k < y.k THEN 1 ELSE 0 END) AS BIGINT) AS forward FROM e JOIN d x ON x.v = e.a JOIN d y ON y.v = e.b")
def topological_order(spark, sf_dir):
    """How many arrows there are, and how many go forward in an order of the nodes: all of them."""
    from tessera.plans.graph import order_of

    g = nations(spark, sf_dir)
    at = {v: k for k, v in enumerate(order_of(g.directed))}
    arrows = list(zip(*np.nonzero(g.directed), strict=True))
    return spark.createDataFrame([(len(arrows), sum(at[a] < at[b] for a, b in arrows))], "arrows long, forward long")
