"""Queries over the star-schema tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as fx
from tessera.functions.blas import one_thread
from tessera.operators import cells as cell_tables
from tessera.operators import graphs
from tessera.operators import moments as mm
from tessera.operators import ordered
from tessera.operators import profile as prof

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: A critical value of the normal distribution at 0.05: a fixed value.
Z05 = 1.959963984540054


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """Rounded to six places, without negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).cast("double")


def sql6(x: str, name: str) -> str:
    return f"CAST(round({x}, 6) + 0.0 AS DOUBLE) AS {name}"


#: The line items with the price in thousands, so that rounded covariances keep all their digits.
ITEMS = "(SELECT * REPLACE (l_extendedprice / 1000 AS l_extendedprice) FROM lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts).replace("FROM lineitem", f"FROM {ITEMS}")


PAIRS = list(combinations(NUMBERS, 2))
TRIPLES = [(a, b, c) for a, b in PAIRS for c in NUMBERS if c not in (a, b)]


# statistics


@query(union([f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS n_null, {sql6(f'min({c})', 'least')}, {sql6(f'max({c})', 'greatest')}, {sql6(f'avg({c})', 'mean')} FROM lineitem" for c in NUMBERS]))
def profile(spark, sf_dir):
    p = prof.profile(prof.as_doubles(items(spark, sf_dir), NUMBERS), NUMBERS)
    return p.select("name", "n", "n_null", r6("least").alias("least"), r6("greatest").alias("greatest"), r6("mean").alias("mean"))


def _square(spark, m, values) -> DataFrame:
    rows = [(m.names[i], m.names[j], float(values[i, j])) for i in range(m.d) for j in range(i, m.d)]
    return spark.createDataFrame(rows, "x string, y string, v double").select("x", "y", r6("v").alias("v"))


@query(union([f"SELECT '{a}' AS x, '{b}' AS y, {sql6(f'covar_samp({a}, {b})', 'v')} FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]))
def cov_matrix(spark, sf_dir):
    m = mm.moments(items(spark, sf_dir), NUMBERS)
    return _square(spark, m, m.cov)


@query(union([f"SELECT '{a}' AS x, '{b}' AS y, {sql6(f'corr({a}, {b})', 'v')} FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]))
def corr_matrix(spark, sf_dir):
    m = mm.moments(items(spark, sf_dir), NUMBERS)
    return _square(spark, m, m.corr)


@query(union([f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {sql6(f'corr({a}, {b})', 'r')} FROM lineitem WHERE {a} > 5 AND {b} IS NOT NULL" if a == "l_quantity" else f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {sql6(f'corr({a}, {b})', 'r')} FROM lineitem" for a, b in PAIRS]))
def pairwise_deletion(spark, sf_dir):
    """Correlations over the rows that have both; small quantities count as missing."""
    df = items(spark, sf_dir).withColumn("l_quantity", F.when(F.col("l_quantity") > 5, F.col("l_quantity")))
    return mm.pairwise_moments(df, NUMBERS).select("x", "y", "n", r6("r").alias("r"))


@query(f"WITH p AS ({union([f'SELECT {chr(39)}{a}{chr(39)} AS x, {chr(39)}{b}{chr(39)} AS y, corr({a}, {b}) AS r, count(*) AS n FROM lineitem' for a, b in PAIRS])}) SELECT x, y, n, {sql6('r', 'r')}, {sql6('sqrt(n - 3) * abs(atanh(r))', 'z')}, sqrt(n - 3) * abs(atanh(r)) > {Z05} AS dependent FROM p")
def fisher_z_marginal(spark, sf_dir):
    p = mm.pairwise_moments(items(spark, sf_dir), NUMBERS).withColumn("z", fx.fisher_statistic(F.col("r"), F.col("n")))
    return p.select("x", "y", "n", r6("r").alias("r"), r6("z").alias("z"), (F.col("z") > Z05).alias("dependent"))


@query(f"WITH p AS ({union([f'SELECT {chr(39)}{a}{chr(39)} AS x, {chr(39)}{b}{chr(39)} AS y, corr({a}, {b}) AS r, count(*) AS n FROM lineitem' for a, b in PAIRS])}) SELECT x, y, {sql6('r', 'r')}, {sql6('sqrt(n - 3) * abs(atanh(r))', 'z')} FROM p WHERE sqrt(n - 3) * abs(atanh(r)) > 0.5")
def skeleton_marginal(spark, sf_dir):
    """The edges that a marginal pass keeps at z > 0.5."""
    p = fisher_z_marginal(spark, sf_dir)
    return p.where("z > 0.5").select("x", "y", "r", "z")


def _partial_sql() -> str:
    rows = [f"SELECT '{a}' AS x, '{b}' AS y, '{c}' AS given, corr({a}, {b}) AS xy, corr({a}, {c}) AS xz, corr({b}, {c}) AS yz, count(*) AS n FROM lineitem" for a, b, c in TRIPLES]
    return f"WITH p AS ({union(rows)}), q AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM p) SELECT x, y, given, {sql6('r', 'r')}, {sql6('sqrt(n - 4) * abs(atanh(r))', 'z')} FROM q"


@query(_partial_sql())
def partial_correlation_1(spark, sf_dir):
    """Partial correlations given one variable, as Column expressions over one row of correlations."""
    df = items(spark, sf_dir)
    one = df.agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"{a}:{b}") for a, b in PAIRS))
    r = lambda a, b: F.col(f"`{a}:{b}`" if (a, b) in PAIRS else f"`{b}:{a}`")
    rows = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("given"), fx.partial_1(r(a, b), r(a, c), r(b, c)).alias("r"), F.col("n")) for a, b, c in TRIPLES))
    out = one.select(F.explode(rows).alias("q")).select("q.*")
    return out.select("x", "y", "given", r6("r").alias("r"), r6(fx.fisher_statistic(F.col("r"), F.col("n"), 1)).alias("z"))


CHI2 = """WITH t AS (SELECT {s} AS s, l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, sum(o) OVER (PARTITION BY s, x) AS rx, sum(o) OVER (PARTITION BY s, y) AS cy, sum(o) OVER (PARTITION BY s) AS ns FROM t),
k AS (SELECT s, ns, count(DISTINCT x) AS a, count(DISTINCT y) AS b FROM m GROUP BY s, ns),
full_t AS (SELECT m1.s, m1.rx, m2.cy, m1.ns, coalesce(t.o, 0) AS o FROM (SELECT DISTINCT s, x, rx, ns FROM m) m1 JOIN (SELECT DISTINCT s, y, cy FROM m) m2 ON m1.s = m2.s LEFT JOIN t ON t.s = m1.s AND t.x = m1.x AND t.y = m2.y)"""
CHI2_END = """SELECT CAST(round((SELECT sum((o - rx * cy / ns) * (o - rx * cy / ns) / (rx * cy / ns)) FROM full_t), 6) + 0.0 AS DOUBLE) AS chi2, CAST(round((SELECT sum(CASE WHEN o > 0 THEN 2 * o * ln(o * ns / (CAST(rx AS DOUBLE) * cy)) ELSE 0 END) FROM full_t), 6) + 0.0 AS DOUBLE) AS g2, CAST(round((SELECT sum(CAST(ns AS DOUBLE) * (a - 1) * (b - 1) / (ns - 1)) FROM k WHERE ns > 1), 6) + 0.0 AS DOUBLE) AS dof"""


def _chi2(spark, df: DataFrame, x: str, y: str, given: list[str]) -> DataFrame:
    """Pearson's and the likelihood-ratio statistic with the former's mean under shuffles, from one scan's joint cells."""
    from tessera.operators.ci import ChiSquare

    c = cell_tables.cells(df, [x, y, *given])
    s = tuple(range(2, 2 + len(given)))
    chi2, dof = ChiSquare(c).statistic(0, 1, s)
    return spark.createDataFrame([(chi2, ChiSquare(c, True).statistic(0, 1, s)[0], dof)], "chi2 double, g2 double, dof double").select(*(r6(x).alias(x) for x in ("chi2", "g2", "dof")))


@query(CHI2.format(s="0") + CHI2_END)
def chi2_marginal(spark, sf_dir):
    return _chi2(spark, table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", [])


@query(CHI2.format(s="l_linenumber") + CHI2_END)
def chi2_conditional(spark, sf_dir):
    """Return flag and line status given the line number."""
    return _chi2(spark, table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string")), "l_returnflag", "l_linestatus", ["l_linenumber"])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping_id(l_linenumber, l_linestatus, l_returnflag) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linenumber, l_returnflag), (l_linenumber, l_linestatus))")
def contingency_batch(spark, sf_dir):
    """All tables of a batch of tests, from one Expand and one shuffle."""
    pairs = [["l_linestatus", "l_returnflag"], ["l_linenumber", "l_returnflag"], ["l_linenumber", "l_linestatus"]]
    return cell_tables.counts_for(table(spark, sf_dir, "lineitem"), pairs).withColumn("gid", F.col("gid").cast("long"))


BIC_SETS = [(y, p) for y in NUMBERS for p in ((), *((q,) for q in NUMBERS if q != y))]


def _bic_sql() -> str:
    rows = []
    for y, p in BIC_SETS:
        var = f"var_samp({y})" + (f" - covar_samp({y}, {p[0]}) * covar_samp({y}, {p[0]}) / var_samp({p[0]})" if p else "")
        rows.append(f"SELECT '{y}' AS node, '{p[0] if p else ''}' AS parent, CAST(round(count(*) * ln({var}) + {len(p)} * ln(count(*)), 3) + 0.0 AS DOUBLE) AS score FROM lineitem")
    return union(rows)


@query(_bic_sql())
def bic_local(spark, sf_dir):
    """Gaussian BIC of each variable with no and with one parent, from one scan's moments."""
    from tessera.operators.scores import BIC

    score = BIC(mm.moments(items(spark, sf_dir), NUMBERS))
    rows = [(y, p[0] if p else "", score.local(NUMBERS.index(y), [NUMBERS.index(q) for q in p])) for y, p in BIC_SETS]
    return spark.createDataFrame(rows, "node string, parent string, score double").select("node", "parent", (F.round("score", 3) + 0.0).alias("score"))


@query("""WITH t AS (SELECT l_returnflag AS p, l_linestatus AS v, count(*) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY p) AS np FROM t)
SELECT CAST(round(-2 * sum(o * ln(o / CAST(np AS DOUBLE))) + ln(sum(o)) * count(DISTINCT p) * (count(DISTINCT v) - 1), 6) + 0.0 AS DOUBLE) AS score FROM m""")
def discrete_bic_local(spark, sf_dir):
    """BIC of the line status with the return flag as its parent."""
    from tessera.operators.scores import CategoricalBIC

    c = cell_tables.cells(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(CategoricalBIC(c).local(1, [0]),)], "score double").select(r6("score").alias("score"))


@query("""WITH t AS (SELECT l_returnflag AS p, l_linestatus AS v, count(*) AS o FROM lineitem GROUP BY 1, 2), q AS (SELECT p, sum(o) AS np FROM t GROUP BY p)
SELECT CAST(round(-2 * ((SELECT sum(lgamma(1.0 / 3) - lgamma(np + 1.0 / 3)) FROM q) + (SELECT sum(lgamma(o + 1.0 / 6) - lgamma(1.0 / 6)) FROM t)), 5) + 0.0 AS DOUBLE) AS score""")
def bdeu_local(spark, sf_dir):
    """BDeu of the line status given the return flag (sample size 1; two variables have no structure prior)."""
    from tessera.operators.scores import BDeu

    c = cell_tables.cells(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(BDeu(c).local(1, [0]),)], "score double").select((F.round("score", 5) + 0.0).alias("score"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, " + "CAST(round(sum(o_totalprice), 3) + 0.0 AS DOUBLE) AS s, " + sql6("sum(o_totalprice / 1000 * o_totalprice / 1000)", "ss") + " FROM orders GROUP BY 1, 2")
def mixed_cells(spark, sf_dir):
    """The cells of a mixed table: counts, sums and squares of the price by status and priority."""
    c = cell_tables.cells(table(spark, sf_dir, "orders").withColumn("p", F.col("o_totalprice") / 1000), ["o_orderstatus", "o_orderpriority"], ["p"])
    rows = [(*(c.levels[v][k] for v, k in zip(c.names, code, strict=True)), int(n), float(t[0]) * 1000, float(q[0, 0])) for code, n, t, q in zip(c.codes.tolist(), c.counts, c.sums, c.products, strict=True)]
    return spark.createDataFrame(rows, "o_orderstatus string, o_orderpriority string, n long, s double, ss double").select("o_orderstatus", "o_orderpriority", "n", (F.round("s", 3) + 0.0).alias("s"), r6("ss").alias("ss"))


@query("WITH v AS (SELECT DISTINCT o_orderpriority AS v FROM orders), c AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM v) SELECT code, count(*) AS n FROM orders JOIN c ON o_orderpriority = v GROUP BY 1")
def category_codes(spark, sf_dir):
    df, _ = prof.encoded(table(spark, sf_dir, "orders"), ["o_orderpriority"])
    return df.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))


ENV_PAIRS = [(a, b) for i, a in enumerate(NUMBERS[:3]) for b in NUMBERS[i:3]]


@query(union([f"SELECT l_returnflag AS env, '{a}' AS x, '{b}' AS y, count(*) AS n, {sql6(f'covar_samp({a}, {b})', 'cov')} FROM lineitem GROUP BY l_returnflag" for a, b in ENV_PAIRS]))
def env_moments(spark, sf_dir):
    """Covariances within each environment, from one aggregation."""
    by = mm.moments_by(items(spark, sf_dir), NUMBERS[:3], "l_returnflag")
    rows = [(e, a, b, m.n, float(m.cov[NUMBERS.index(a), NUMBERS.index(b)])) for e, m in by.items() for a, b in ENV_PAIRS]
    return spark.createDataFrame(rows, "env string, x string, y string, n long, cov double").select("env", "x", "y", "n", r6("cov").alias("cov"))


@query("SELECT CAST(round(avg(r), 6) + 0.0 AS DOUBLE) AS mean_rank, count(*) AS n, CAST(round(sum(r * l_quantity), 4) + 0.0 AS DOUBLE) AS weighted FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem)")
def average_ranks(spark, sf_dir):
    """Ranks with ties averaged: the distinct values are sorted, not the rows."""
    r = ordered.average_ranks(table(spark, sf_dir, "lineitem"), "l_quantity")
    return r.agg(r6(F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("mean_rank"), F.sum("n").alias("n"), (F.round(F.sum(F.col("rank") * F.col("n") * F.col("value")), 4) + 0.0).alias("weighted"))


@query("WITH p AS (SELECT p_partkey AS id, (p_size * 7919 % 1000) / 1000.0 + p_partkey / 1e9 AS p FROM part), r AS (SELECT id, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p), q AS (SELECT id, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM r) SELECT id, " + sql6("q", "q") + " FROM q")
def bh_adjust(spark, sf_dir):
    """Benjamini-Hochberg adjustment of made-up p-values."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") * 7919 % 1000) / 1000.0 + F.col("p_partkey") / 1e9).alias("p"))
    return ordered.benjamini_hochberg(p, "p", "q").select("id", r6("q").alias("q"))


HOURS = "WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)"


def hourly(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))


@query(HOURS + " SELECT count(*) AS rows, " + sql6("sum(n * n1)", "nn1") + ", " + sql6("sum(v * n2) / 1000", "vn2") + " FROM (SELECT n, v, lag(n, 1) OVER (ORDER BY t) AS n1, lag(n, 2) OVER (ORDER BY t) AS n2, row_number() OVER (ORDER BY t) AS k FROM h) WHERE k > 2")
def lagged_design(spark, sf_dir):
    """Hourly counts and values with two lags."""
    d = mm.lagged(hourly(spark, sf_dir), ["n", "v"], "t", 2)
    return d.agg(F.count("*").alias("rows"), r6(F.sum(F.col("n") * F.col("n__1"))).alias("nn1"), r6(F.sum(F.col("v") * F.col("n__2")) / 1000).alias("vn2"))


@query(HOURS + ", d AS (SELECT n, v, lag(n) OVER (ORDER BY t) AS n1, lag(v) OVER (ORDER BY t) AS v1, row_number() OVER (ORDER BY t) AS k FROM h) " + union([f"SELECT '{a}' AS x, '{b}' AS y, {sql6(f'corr({a}, {b})', 'r')} FROM d WHERE k > 1" for a, b in (("n", "n1"), ("n", "v1"), ("v", "n1"), ("v", "v1"))]))
def lagged_correlations(spark, sf_dir):
    d = mm.lagged(hourly(spark, sf_dir), ["n", "v"], "t", 1).withColumnsRenamed({"n__1": "n1", "v__1": "v1"})
    m = mm.moments(d, ["n", "v", "n1", "v1"])
    rows = [(a, b, float(m.corr[m.names.index(a), m.names.index(b)])) for a, b in (("n", "n1"), ("n", "v1"), ("v", "n1"), ("v", "v1"))]
    return spark.createDataFrame(rows, "x string, y string, r double").select("x", "y", r6("r").alias("r"))


MEASURE_SQL = "WITH c AS (SELECT (l_quantity - avg(l_quantity) OVER ()) AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) AS b FROM lineitem), v AS (SELECT var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM c), s AS (SELECT a / sqrt(va) AS a, b / sqrt(vb) AS b, cab / sqrt(va * vb) AS r FROM c, v)"


@query(MEASURE_SQL + ", m AS (SELECT any_value(r) * (avg(a * tanh(b)) - avg(tanh(a) * b)) AS t, sign(avg(a * a * a)) AS sa, sign(avg(b * b * b)) AS sb, any_value(r) AS r, avg(a * a * b) AS aab, avg(a * b * b) AS abb FROM s) SELECT 'quantity' AS variable, " + sql6("-pow(least(0, t), 2) * 1e6", "tanh") + ", " + sql6("-pow(least(0, r * (aab * sa - abb * sb)), 2) * 1e6", "skew") + " FROM m UNION ALL SELECT 'price', " + sql6("-pow(least(0, -t), 2) * 1e6", "tanh") + ", " + sql6("-pow(least(0, r * (abb * sb - aab * sa)), 2) * 1e6", "skew") + " FROM m")
def exogeneity_measures(spark, sf_dir):
    """How exogenous each of two variables is by the nonlinear moments that order a linear non-Gaussian pair (in millionths)."""
    import numpy as np

    from tessera.plans.lingam import scores

    df, names = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]
    m = mm.moments(df, names)
    by = {k: scores(df, names, m, np.eye(2), [0, 1], k) for k in ("tanh", "skew")}
    rows = [(v, float(by["tanh"][i]) * 1e6, float(by["skew"][i]) * 1e6) for i, v in enumerate(("quantity", "price"))]
    return spark.createDataFrame(rows, "variable string, tanh double, skew double").select("variable", r6("tanh").alias("tanh"), r6("skew").alias("skew"))


@query("SELECT l_orderkey % 7 AS unit, count(*) AS n, " + sql6("avg(l_quantity)", "mean") + ", " + sql6("var_samp(l_quantity)", "var") + " FROM lineitem GROUP BY 1")
def panel_moments(spark, sf_dir):
    by = mm.moments_by(table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_orderkey") % 7), ["l_quantity"], "unit")
    rows = [(u, m.n, float(m.mean[0]), float(m.cov[0, 0])) for u, m in by.items()]
    return spark.createDataFrame(rows, "unit long, n long, mean double, var double").select("unit", "n", r6("mean").alias("mean"), r6("var").alias("var"))


# graphs over whole tables: suppliers and parts (numbered from 10^9) are nodes, large quantities join them


EDGE_SQL = "WITH e AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS a, CAST(1000000000 + l_partkey AS BIGINT) AS b FROM lineitem WHERE l_quantity > 49)"


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").cast("long").alias("a"), (F.lit(10**9) + F.col("l_partkey")).cast("long").alias("b")).distinct()


@query(EDGE_SQL + ", s AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT l.a AS x, l.b AS y, r.b AS z FROM s l JOIN s r ON l.b = r.a WHERE l.a < r.b AND NOT EXISTS (SELECT 1 FROM s t WHERE t.a = l.a AND t.b = r.b)")
def unshielded_triples(spark, sf_dir):
    return graphs.unshielded_triples(_edges(spark, sf_dir))


@query(EDGE_SQL + ", arrows AS (SELECT a, b FROM e WHERE (a + b) % 3 = 0), lines AS (SELECT a, b FROM e WHERE (a + b) % 3 <> 0), line AS (SELECT a, b FROM lines UNION SELECT b, a FROM lines), adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT DISTINCT w.b, l.b AS c FROM arrows w JOIN line l ON w.b = l.a WHERE w.a <> l.b AND NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = w.a AND t.b = l.b)")
def meek_rule_1(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graphs.meek_first(e.where("(a + b) % 3 = 0"), e.where("(a + b) % 3 <> 0"))


#: A part's arrow goes to twice its number or one more, as the line's supplier is even or odd: a graph as deep as its numbers have digits.
CHAIN_SQL = "WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS a, CAST(2 * l_partkey + l_suppkey % 2 AS BIGINT) AS b FROM lineitem WHERE l_linenumber <= 2), r AS (SELECT b AS node, a AS ancestor FROM e UNION SELECT r.node, e.a FROM r JOIN e ON e.b = r.ancestor)"


def _chain(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_partkey").cast("long").alias("a"), (2 * F.col("l_partkey") + F.col("l_suppkey") % 2).cast("long").alias("b")).distinct()


@query(CHAIN_SQL + " SELECT node, ancestor FROM r")
def ancestors(spark, sf_dir):
    return graphs.ancestors(_chain(spark, sf_dir))


@query(CHAIN_SQL + " SELECT b AS node, a AS member FROM e UNION SELECT a, b FROM e UNION SELECT l.a, r.a FROM e l JOIN e r ON l.b = r.b WHERE l.a <> r.a")
def markov_blankets(spark, sf_dir):
    return graphs.markov_blankets(_chain(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT l_suppkey  AS i, 1000000000 + l_partkey AS j, CAST(1 + l_linenumber % 2 AS TINYINT) AS m FROM lineitem), a AS (SELECT i, j, min(m) AS m FROM e GROUP BY 1, 2), b AS (SELECT i, j, max(m) AS m FROM e WHERE i % 10 <> 3 GROUP BY 1, 2) SELECT count(*) AS pairs, CAST(sum(CASE WHEN a.m IS NOT DISTINCT FROM b.m THEN 0 ELSE 1 END) AS BIGINT) AS shd, CAST(sum(CASE WHEN a.m IS NOT NULL AND b.m IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN b.m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j")
def structural_hamming(spark, sf_dir):
    """Differences of two edge tables by a full outer join."""
    from tessera.operators.metrics import edge_differences

    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), (F.lit(10**9) + F.col("l_partkey")).alias("j"), (1 + F.col("l_linenumber") % 2).cast("byte").alias("m")).distinct()
    a = e.groupBy("i", "j").agg(F.min("m").alias("mark_i")).withColumn("mark_j", F.lit(2))
    b = e.where("i % 10 <> 3").groupBy("i", "j").agg(F.max("m").alias("mark_i")).withColumn("mark_j", F.lit(2))
    d = edge_differences(a, b)
    return d.agg(F.count("*").alias("pairs"), F.sum((~F.col("same")).cast("long")).alias("shd"), F.sum((F.col("found") & F.col("real")).cast("long")).alias("tp"), F.sum((~F.col("real")).cast("long")).alias("fp"))


@query("WITH t AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), c AS (SELECT sum(n * (n - 1) / 2.0) AS both_ FROM t), r AS (SELECT sum(s * (s - 1) / 2.0) AS ra FROM (SELECT sum(n) AS s FROM t GROUP BY a)), q AS (SELECT sum(s * (s - 1) / 2.0) AS rb FROM (SELECT sum(n) AS s FROM t GROUP BY b)), k AS (SELECT sum(n) * (sum(n) - 1) / 2.0 AS total FROM t) SELECT " + sql6("(both_ - ra * rb / total) / ((ra + rb) / 2 - ra * rb / total)", "ari") + " FROM c, r, q, k")
def adjusted_rand(spark, sf_dir):
    """Agreement of two groupings of the parts, from one contingency table."""
    from tessera.operators.metrics import adjusted_rand_of

    return adjusted_rand_of(table(spark, sf_dir, "part"), "p_brand", "p_type").select(r6("ari").alias("ari"))


@query("SELECT l_suppkey % 5 AS i, 5 + l_partkey % 5 AS j, CAST(1 AS TINYINT) AS mark_i, CAST(1 + l_linenumber % 2 AS TINYINT) AS mark_j, " + sql6("count(*) / 100.0", "frequency") + " FROM lineitem GROUP BY 1, 2, 3, 4")
def bootstrap_votes(spark, sf_dir):
    fits = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("i"), (5 + F.col("l_partkey") % 5).alias("j"), F.lit(1).cast("byte").alias("mark_i"), (1 + F.col("l_linenumber") % 2).cast("byte").alias("mark_j"))
    return graphs.vote(fits, 100).withColumn("frequency", r6("frequency"))


@query("WITH l AS (SELECT DISTINCT l_suppkey AS cause, l_partkey AS effect, l_linenumber % 3 AS lag FROM lineitem) SELECT cause, effect, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) AS lags FROM l GROUP BY 1, 2")
def lag_summary(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cause"), F.col("l_partkey").alias("effect"), (F.col("l_linenumber") % 3).alias("lag"))
    return graphs.summary_of_lags(links)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, " + sql6("sum(value)", "total") + ", " + sql6("sum(value * value)", "squares") + " FROM events GROUP BY 1, 2")
def stream_window_statistics(spark, sf_dir):
    """Daily windows of a stream by event type: the batch form of the streaming operator."""
    from tessera.streaming.moments import window_statistics

    out = window_statistics(table(spark, sf_dir, "events"), "ts", "event_type", "value", width="1 day")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"), r6("squares").alias("squares"))


# more of the reference points of a search, as tables


def _partial2_sql() -> str:
    c = lambda a, b: f"corr({a}, {b})"
    x, y, z, w = NUMBERS
    one = lambda a, b, g: f"(({c(a, b)} - {c(a, g)} * {c(b, g)}) / sqrt((1 - {c(a, g)} * {c(a, g)}) * (1 - {c(b, g)} * {c(b, g)})))"
    r = f"(({one(x, y, z)} - {one(x, w, z)} * {one(y, w, z)}) / sqrt((1 - {one(x, w, z)} * {one(x, w, z)}) * (1 - {one(y, w, z)} * {one(y, w, z)})))"
    return f"SELECT {sql6(r, 'r')}, {sql6(f'sqrt(count(*) - 5) * abs(atanh({r}))', 'z')} FROM {ITEMS}"


@query(_partial2_sql())
def partial_correlation_2(spark, sf_dir):
    """The first two columns given the other two, by the recursion over one row of correlations."""
    df = items(spark, sf_dir)
    one = df.agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"{a}:{b}") for a, b in PAIRS))
    r = lambda a, b: F.col(f"`{a}:{b}`" if (a, b) in PAIRS else f"`{b}:{a}`")
    x, y, z, w = NUMBERS
    given_z = lambda a, b: fx.partial_1(r(a, b), r(a, z), r(b, z))
    p = fx.partial_1(given_z(x, y), given_z(x, w), given_z(y, w))
    return one.select(r6(p).alias("r"), r6(fx.fisher_statistic(p, F.col("n"), 2)).alias("z"))


@query("SELECT CAST(k AS INTEGER) AS k, CAST(round(2 * (lgamma(10) - lgamma(k + 1) - lgamma(10 - k)), 6) + 0.0 AS DOUBLE) AS penalty FROM range(1, 6) t(k)")
def ebic_penalty(spark, sf_dir):
    """2 ln C(9, k): the extended penalty of k of nine possible parents."""
    from tessera.operators.scores import ebic_penalty as penalty

    return spark.createDataFrame([(k, penalty(k, 10, 1.0)) for k in range(1, 6)], "k int, penalty double").select("k", r6("penalty").alias("penalty"))


@query("WITH d AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS o, o_totalprice / 1000 AS p FROM orders) " + union([f"SELECT '{a}' AS x, '{b}' AS y, {sql6(f'covar_samp({a}, {b})', 'v')} FROM d" for a, b in (("f", "f"), ("f", "o"), ("f", "p"), ("o", "o"), ("o", "p"), ("p", "p"))]))
def indicator_moments(spark, sf_dir):
    """Moments of a mixed table with its categories, but the last, as indicators."""
    df = table(spark, sf_dir, "orders").select(F.array_position(F.lit(["F", "O", "P"]), F.col("o_orderstatus")).cast("int").alias("status"), (F.col("o_totalprice") / 1000).alias("p"))
    wide, _ = mm.dummies(df.withColumn("status", F.col("status") - 1), {"status": 3})
    m = mm.moments(wide.withColumnsRenamed({"status__is0": "f", "status__is1": "o"}), ["f", "o", "p"])
    return _square(spark, m, m.cov)


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS v FROM lineitem), n AS (SELECT count(DISTINCT k) AS n FROM a) SELECT v, count(*) AS sets, count(*) = (SELECT n FROM n) AS in_all FROM a GROUP BY v")
def icp_intersection(spark, sf_dir):
    """Which members all accepted sets share, for a table of sets: of each member, in how many of them it is."""
    return graphs.shared_members(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("v")), "k", "v")


@query("WITH p AS (SELECT (p_partkey * 7919 % 10007 + 0.5) / 10007 AS u FROM part), r AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM p) SELECT CAST(round(-max(a.n) - avg((2 * a.i - 1) * (ln(a.u) + ln(1 - b.u))), 6) + 0.0 AS DOUBLE) AS statistic FROM r a JOIN r b ON b.i = a.n + 1 - a.i")
def anderson_darling(spark, sf_dir):
    """The statistic of uniformity of made-up p-values."""
    _, z = ordered.anderson_darling(table(spark, sf_dir, "part").select(((F.col("p_partkey") * 7919 % 10007 + 0.5) / 10007).alias("u")), "u")
    return spark.createDataFrame([(z,)], "statistic double").select(r6("statistic").alias("statistic"))


@query("SELECT l_returnflag AS target, l_linenumber AS candidate, " + sql6("s", "strength") + " FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s DESC, l_linenumber) AS k FROM (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2)) WHERE k <= 3")
def strongest_candidates(spark, sf_dir):
    """The three strongest candidates of each target, ties by number."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("candidate")).agg(F.avg("l_quantity").alias("s"))
    return graphs.strongest(s, "target", "candidate", "s", 3).select("target", "candidate", r6("s").alias("strength"))


@query("SELECT x, y, string_agg(DISTINCT CAST(s AS VARCHAR), ',' ORDER BY CAST(s AS VARCHAR)) AS sepset, " + sql6("max(p)", "p") + " FROM (SELECT l_suppkey AS x, 1000000000 + l_partkey AS y, l_linenumber AS s, l_tax AS p FROM lineitem WHERE l_tax > 0.05) GROUP BY 1, 2")
def separating_sets(spark, sf_dir):
    """Each removed pair's separating set: the union of the sets that separate it, and their largest p-value."""
    q = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("x"), (F.lit(10**9) + F.col("l_partkey")).alias("y"), F.array("l_linenumber").alias("s"), F.col("l_tax").alias("p"))
    return graphs.separating_sets(q, 0.05).select("x", "y", F.array_join(F.array_sort(F.transform("sepset", lambda v: v.cast("string"))), ",").alias("sepset"), r6("p").alias("p"))


@query("SELECT l_returnflag AS target, min_by(l_linenumber, v) AS best, " + sql6("min(v)", "delta") + " FROM (SELECT l_returnflag, l_linenumber, round(avg(l_discount - l_tax), 9) + l_linenumber / 1e12 AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def best_moves(spark, sf_dir):
    """The best move of each target by rounded gains, ties by number."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("move")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return graphs.best_moves(v, "target", "move", "delta").select("target", F.col("move").alias("best"), r6("delta").alias("delta"))


@query(EDGE_SQL + " SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = a AND s_nationkey % 5 = 0)")
def knowledge_restricted(spark, sf_dir):
    """Candidate edges without those that a table of knowledge forbids."""
    forbidden = table(spark, sf_dir, "supplier").where("s_nationkey % 5 = 0").select(F.col("s_suppkey").cast("long").alias("a"))
    return graphs.permitted(_edges(spark, sf_dir), forbidden)


@query("WITH t AS (SELECT l_suppkey AS i, 1000000000 + l_partkey AS j, min(l_linenumber % 2) AS way FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2), e AS (SELECT l_suppkey AS i, 1000000000 + l_partkey AS j, max(l_linenumber % 2) AS way FROM lineitem GROUP BY 1, 2) SELECT count(*) AS found, CAST(sum(CASE WHEN t.way = e.way THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM t JOIN e ON t.i = e.i AND t.j = e.j")
def direction_accuracy(spark, sf_dir):
    """True arrows that an estimate has as adjacencies, and how many of them point the right way."""
    from tessera.operators.metrics import direction_counts

    def side(df, f):
        way = f(F.col("l_linenumber") % 2)
        marks = [F.when(way == 0, 1).otherwise(2).cast("byte").alias("mark_i"), F.when(way == 0, 2).otherwise(1).cast("byte").alias("mark_j")]
        return df.groupBy(F.col("l_suppkey").alias("i"), (F.lit(10**9) + F.col("l_partkey")).alias("j")).agg(*marks)

    lines = table(spark, sf_dir, "lineitem")
    return direction_counts(side(lines, F.max), side(lines.where("l_quantity > 40"), F.min))


# searches: results without SQL


def graph_frame(spark, graph) -> DataFrame:
    return spark.createDataFrame([(a, b, t) for a, b, t in graph.oriented_edges()], "source string, target string, type string")


#: Two numbers of a line item in [-1/2, 1/2), the same in Spark and SQL: remainders of its keys by primes.
NOISE = {
    "e1": "((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 10007) / 10007.0 - 0.5",
    "e2": "((l_orderkey * 15485863 + l_partkey * 611953 + l_linenumber * 7919) % 20011) / 20011.0 - 0.5",
}
#: A table with known structure over the line items: quantity -> cost -> paid <- tax.
PLANT = {"quantity": "l_quantity / 15", "tax": "l_tax * 30", "cost": "l_quantity / 15 + 2 * e1", "paid": "l_quantity / 15 + 2 * e1 + l_tax * 30 + e2"}
#: The same where returned items are taxed twice and accepted ones cost more.
PLANT_ENV = {
    "quantity": "l_quantity / 15",
    "tax": "l_tax * CASE WHEN l_returnflag = 'R' THEN 60 ELSE 30 END",
    "cost": "l_quantity / 15 + 2 * e1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END",
    "paid": "l_quantity / 15 + 2 * e1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + l_tax * CASE WHEN l_returnflag = 'R' THEN 60 ELSE 30 END + e2",
}


def plant_sql(columns: dict[str, str], more: str = "") -> str:
    return f"(SELECT {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for c, x in columns.items())}{more} FROM (SELECT *, {', '.join(f'{x} AS {c}' for c, x in NOISE.items())} FROM lineitem))"


def _planted(spark, sf_dir, columns=None) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("*", *(f"{x} AS {c}" for c, x in NOISE.items()))
    return df.selectExpr(*(f"CAST({x} AS DOUBLE) AS {c}" for c, x in (columns or PLANT).items()), "l_returnflag", "l_linestatus")


PLANTED = ["quantity", "tax", "cost", "paid"]
#: Noise of the same variance in all variables, whose directions least squares finds.
PLANT_EVEN = {"quantity": "(l_quantity - 25.5) / 14.43", "tax": "l_tax * 38.7", "cost": "1.2 * (l_quantity - 25.5) / 14.43 + 3.464 * e1", "paid": "1.2 * (l_quantity - 25.5) / 14.43 + 3.464 * e1 + 38.7 * l_tax + 3.464 * e2"}
#: Curved effects, whose directions additive models find.
PLANT_CURVED = {"quantity": "l_quantity / 15", "cost": "2 * sin(l_quantity / 8) + e1 + e2", "paid": "pow(2 * sin(l_quantity / 8) + e1 + e2, 2) + 2 * l_tax * 30 + e1 * e2", "tax": "l_tax * 30"}


def search(name: str, fit, columns=None):
    def run(spark, sf_dir):
        with one_thread():  # a search's matrices are small
            return graph_frame(spark, fit(_planted(spark, sf_dir, columns)))

    run.__name__, run.__doc__ = name, f"{name} over the planted table."
    QUERIES[name] = run


@query()
def pc_skeleton_lineitem(spark, sf_dir):
    """PC over the four numeric columns of the line items."""
    from tessera.plans.constraint import pc

    return graph_frame(spark, pc(table(spark, sf_dir, "lineitem"), columns=NUMBERS))


OTHER_PLANTS = dict.fromkeys(("cdnod", "icp", "fci_jci", "gies", "gnies", "igsp", "ut_igsp"), PLANT_ENV) | dict.fromkeys(("notears", "dagma"), PLANT_EVEN) | dict.fromkeys(("cam", "score_matching", "nogam", "resit", "camuv", "anm", "pnl", "loci"), PLANT_CURVED)


def _register_searches() -> None:
    from tessera.plans import constraint, continuous, functional, lingam, resample, score_search

    categories = lambda df: df.withColumn("kept", F.when((F.col("cost") - F.col("quantity")) / 2 < 0.2, F.col("l_returnflag")).otherwise("X"))
    for name, fit in {
        "pc": lambda df: constraint.pc(df, columns=PLANTED),
        "pc_majority": lambda df: constraint.pc(df, columns=PLANTED, collider_rule="majority"),
        "pc_gsq": lambda df: constraint.pc(categories(df), columns=["l_returnflag", "l_linestatus", "kept"], indep_test="gsq"),
        "fci": lambda df: constraint.fci(df, columns=PLANTED),
        "iamb": lambda df: constraint.blanket(df, method="iamb", columns=PLANTED),
        "mmpc": lambda df: constraint.blanket(df, method="mmpc", columns=PLANTED, structure="skeleton"),
        "cdnod": lambda df: constraint.cdnod(df.drop("l_linestatus"), "l_returnflag"),
        "icp": lambda df: constraint.icp(df.drop("l_linestatus"), "l_returnflag", target="paid"),
        "ges": lambda df: score_search.ges(df, columns=PLANTED),
        "xges": lambda df: score_search.xges(df, columns=PLANTED),
        "hc": lambda df: score_search.hc(df, columns=PLANTED).to_cpdag(),
        "tabu": lambda df: score_search.tabu(df, columns=PLANTED).to_cpdag(),
        "exact_search": lambda df: score_search.exact_search(df, columns=PLANTED),
        "boss": lambda df: score_search.boss(df, columns=PLANTED),
        "grasp": lambda df: score_search.grasp(df, columns=PLANTED),
        "gfci": lambda df: score_search.hybrid_fci(df, "gfci", columns=PLANTED),
        "mmhc": lambda df: score_search.mmhc(df, columns=PLANTED).to_cpdag(),
        "gies": lambda df: score_search.gies(df, "l_returnflag", {"R": ["tax"], "A": ["cost"]}, columns=PLANTED),
        "direct_lingam": lambda df: lingam.direct_lingam(df, columns=PLANTED),
        "ges_mixed": lambda df: score_search.ges(df, columns=["quantity", "cost", "l_returnflag"]),
        "notears": lambda df: continuous.notears(df, columns=PLANTED),
        "dagma": lambda df: continuous.dagma(df, columns=PLANTED),
        "calm": lambda df: continuous.calm(df, columns=PLANTED, standardize=True).to_cpdag(),
        "fci_jci": lambda df: constraint.fci_jci(df.drop("l_linestatus"), "l_returnflag"),
        "inter_iamb": lambda df: constraint.blanket(df, method="inter_iamb", columns=PLANTED),
        "pc_mixed": lambda df: constraint.pc(df, columns=["quantity", "cost", "l_returnflag"]),
        "pc_student_t": lambda df: constraint.pc(df, columns=PLANTED, indep_test="student_t"),
        "pc_normal_scores": lambda df: constraint.pc(df, columns=PLANTED, indep_test="normal_scores"),
        "pc_rcot": lambda df: constraint.pc(df, columns=["quantity", "cost", "tax"], indep_test="rcot"),
        "pc_kci": lambda df: constraint.pc(df, columns=["quantity", "cost", "tax"], indep_test="kci"),
        "pc_missing": lambda df: constraint.pc(df.withColumn("tax", F.when(F.col("quantity") < 3, F.col("tax"))), columns=PLANTED, missing="mvpc"),
        "ages": lambda df: score_search.ages(df, columns=PLANTED),
        "gnies": lambda df: score_search.gnies(df, "l_returnflag", columns=PLANTED),
        "igsp": lambda df: score_search.igsp(df, "l_returnflag", {"R": ["tax"], "A": ["cost"]}, columns=PLANTED, n_starts=3),
        "ut_igsp": lambda df: score_search.igsp(df, "l_returnflag", columns=PLANTED, n_starts=3),
        "boss_fci": lambda df: score_search.hybrid_fci(df, "boss_fci", columns=PLANTED),
        "grasp_fci": lambda df: score_search.hybrid_fci(df, "grasp_fci", columns=PLANTED),
        "rsmax2": lambda df: score_search.rsmax2(df, restrict="iamb", maximize="tabu", columns=PLANTED).to_cpdag(),
        "structural_em": lambda df: score_search.structural_em(df.withColumn("tax", F.when(F.col("quantity") < 3, F.col("tax"))), score_search.ges, PLANTED, rounds=3),
        "ica_lingam": lambda df: lingam.ica_lingam(df, columns=PLANTED),
        "rcd": lambda df: lingam.rcd(df, columns=PLANTED[:3]),
        "bottom_up_parce_lingam": lambda df: lingam.bottom_up_parce_lingam(df, columns=PLANTED),
        "gin": lambda df: lingam.gin(df, columns=PLANTED),
        "cam": lambda df: functional.cam(df, columns=PLANTED),
        "resit": lambda df: functional.resit(df, columns=PLANTED[:3]),
        "score_matching": lambda df: functional.by_score(df, columns=PLANTED),
        "nogam": lambda df: functional.by_score(df, "nogam", columns=PLANTED[:3]),
        "camuv": lambda df: functional.camuv(df, columns=PLANTED[:3]),
        "anm": lambda df: functional.pair_direction(df, "anm", columns=["quantity", "cost"]),
        "pnl": lambda df: functional.pair_direction(df, "pnl", columns=["quantity", "cost"]),
        "loci": lambda df: functional.pair_direction(df, "loci", columns=["quantity", "cost"]),
    }.items():
        search(name, fit, OTHER_PLANTS.get(name))

    def bootstrap_pc(spark, sf_dir):
        """Edge frequencies of PC over 40 half samples, whose moments one scan gathers."""
        from tessera.operators.ci import FisherZ

        out = resample.bootstrap(_planted(spark, sf_dir), lambda m: constraint.pc(None, test=FisherZ(m)), n_resamples=40, columns=PLANTED)
        return spark.createDataFrame(out.table(), "x string, y string, mark_x int, mark_y int, frequency double")

    def markov_check(spark, sf_dir):
        """How the independences that PC's graph implies hold on halves of the rows."""
        df = _planted(spark, sf_dir)
        r = resample.markov_check(df, constraint.pc(df, columns=PLANTED))
        return spark.createDataFrame([(r["n_tests"], float(r["dependent"]), float(r["p_value"]))], "n_tests int, dependent double, p_value double")

    QUERIES["bootstrap_pc"], QUERIES["markov_check"] = bootstrap_pc, markov_check


_register_searches()


def _scaled(df: DataFrame) -> DataFrame:
    s = df.agg(F.avg("n"), F.stddev("n"), F.avg("v"), F.stddev("v")).head()
    return df.select("t", ((F.col("n") - s[0]) / s[1]).alias("n"), ((F.col("v") - s[2]) / s[3]).alias("v"))


#: Hours of events: their number n, and v, which follows the number an hour before, with a noise of the hour.
HOUR_NOISE = "((epoch(t) // 3600 * 7919) % 10007) / 10007.0 - 0.5"
SERIES = HOURS + f", s AS (SELECT t, n, 0.2 * lag(n) OVER (ORDER BY t) + ({HOUR_NOISE}) AS v FROM h)"


def _followed(df: DataFrame) -> DataFrame:
    noise = F.floor(F.unix_timestamp("t") / 3600) * 7919 % 10007 / 10007.0 - 0.5
    return df.withColumn("v", 0.2 * F.col("n__1") + noise)


def _series(spark, sf_dir) -> DataFrame:
    return _followed(mm.lagged(hourly(spark, sf_dir), ["n"], "t", 1)).select("t", "n", "v")


def _by_type(spark, sf_dir) -> DataFrame:
    """The same for each event type, by twelve hours."""
    span = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 43200) * 43200)
    df = table(spark, sf_dir, "events").groupBy("event_type", span.alias("t")).agg(F.count("*").cast("double").alias("n"))
    return _followed(mm.lagged(df, ["n"], "t", 1, "event_type")).select("event_type", "t", "n", "v")


def _temporal(name, fit):
    def run(spark, sf_dir):
        g = fit(_series(spark, sf_dir))
        return g.frame(spark)

    run.__name__ = name
    QUERIES[name] = run


def _register_temporal() -> None:
    from tessera.plans import temporal

    _temporal("granger", lambda df: temporal.granger(df, "t", tau_max=1, columns=["n", "v"]))
    _temporal("pcmci", lambda df: temporal.pcmci(df, "t", tau_max=2, columns=["n", "v"]))
    _temporal("pcmciplus", lambda df: temporal.pcmciplus(df, "t", tau_max=2, columns=["n", "v"]))
    _temporal("dynotears", lambda df: temporal.dynotears(_scaled(df), "t", tau_max=1, columns=["n", "v"]))
    _temporal("lpcmci", lambda df: temporal.lpcmci(df, "t", tau_max=1, columns=["n", "v"]))
    _temporal("varma_lingam", lambda df: temporal.varma_lingam(df, "t", columns=["n", "v"]))

    def jpcmciplus(spark, sf_dir):
        """Series of all event types with a dummy for each."""
        df = _by_type(spark, sf_dir)
        return temporal.jpcmciplus(df, "t", "event_type", columns=["n", "v"]).frame(spark)

    def longitudinal_lingam(spark, sf_dir):
        """Users on all days, counted from the first of 2024."""
        e = table(spark, sf_dir, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2023-12-31")).alias("day")).agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
        out = temporal.longitudinal_lingam(e, "user_id", "day", columns=["n", "v"])
        return spark.createDataFrame([(int(t), a, b, k) for t, g in out.items() for a, b, k in g.links()], "occasion int, cause string, effect string, lag int")

    QUERIES["jpcmciplus"], QUERIES["longitudinal_lingam"] = jpcmciplus, longitudinal_lingam
    _temporal("var_lingam", lambda df: temporal.var_lingam(df, "t", tau_max=1, columns=["n", "v"]))


_register_temporal()


# further queries, and SQL for searches, are in modules of their own
from tessera import queries_functions, queries_graph, queries_search  # noqa: E402, F401
