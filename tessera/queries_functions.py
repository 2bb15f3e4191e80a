"""Queries of distribution functions, tests and scores, with SQL that integrates densities and sums likelihoods itself."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import cells as cell_tables
from tessera.operators import ci, scores
from tessera.operators import moments as mm
from tessera.queries import ITEMS, NUMBERS, PAIRS, PLANT, PLANTED, TRIPLES, _planted, items, plant_sql, query, r6, sql6, table, union

STEPS = 4_000


def two_places(c) -> F.Column:
    """Scores are sums over rows: rounded to two places."""
    return (F.round(c, 2) + F.lit(0.0)).cast("double")


def sql_two(x: str, name: str) -> str:
    return f"CAST(round({x}, 2) + 0.0 AS DOUBLE) AS {name}"



def simpson(f: str, low: str, high: str, alias: str = "u") -> str:
    """SQL of the integral of f over the interval, by Simpson's rule; f says alias for the variable."""
    at = f"(({low}) + (({high}) - ({low})) * i / {STEPS}.0)"
    weight = f"CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"((({high}) - ({low})) / {3 * STEPS}.0 * (SELECT sum({weight} * ({f.replace(alias + '$', at)})) FROM range({STEPS + 1}) v(i)))"


def normal_tail(z: str) -> str:
    """SQL of the two-sided normal p-value of z >= 0."""
    return f"(1 - 2 / sqrt(2 * pi()) * {simpson('exp(-u$ * u$ / 2)', '0', f'least({z}, 40)')})"


def t_tail(t: str, dof: str) -> str:
    """SQL of Student's two-sided p-value of t >= 0."""
    return f"(1 - 2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi()) * {simpson(f'pow(1 + u$ * u$ / {dof}, -({dof} + 1) / 2.0)', '0', f'least({t}, 60)')})"


def chi2_tail(x: str, dof: str) -> str:
    """SQL of P(chi-square > x); with u = s^2 the density has no pole from one degree on."""
    return f"(1 - 2 / (pow(2, {dof} / 2.0) * exp(lgamma({dof} / 2.0))) * {simpson(f'pow(u$, {dof} - 1) * exp(-u$ * u$ / 2)', '1e-12', f'sqrt({x})')})"


def f_tail(x: str, a: str, b: str) -> str:
    front = f"2 * exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0)) * pow({a} / {b}, {a} / 2.0)"
    return f"(1 - {front} * {simpson(f'pow(u$, {a} - 1) * pow(1 + {a} * u$ * u$ / {b}, -({a} + {b}) / 2.0)', '1e-12', f'sqrt({x})')})"


def _grid(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in rows) + ")"


ZS = [-3.5, -1.959963984540054, -1.0, -0.1, 0.0, 0.3, 1.5, 4.0]


@query(f"SELECT x, {sql6('CASE WHEN x < 0 THEN p / 2 ELSE 1 - p / 2 END', 'cdf')}, {sql6('x', 'back')} FROM (SELECT x, {normal_tail('abs(x)')} AS p FROM {_values([(z,) for z in ZS])} t(x))")
def normal_distribution(spark, sf_dir):
    """The normal distribution function, and its quantile function of that."""
    rows = [(z, float(special.normal_cdf(z)), float(special.normal_quantile(special.normal_cdf(z)))) for z in ZS]
    return _grid(spark, rows, "x double, cdf double, back double").select("x", r6("cdf").alias("cdf"), r6("back").alias("back"))


TS = [(t, k) for t in (0.0, 0.7, 2.5, 6.0) for k in (1.5, 3.0, 30.0, 1000.0)]


@query(f"SELECT t, dof, {sql6(t_tail('t', 'dof'), 'p')} FROM {_values(TS)} v(t, dof)")
def student_distribution(spark, sf_dir):
    df = _grid(spark, [(t, k, float(special.t_two_sided(t, k))) for t, k in TS], "t double, dof double, p double")
    return df.withColumn("p", r6("p"))


CHIS = [(x, k) for x in (0.5, 3.84, 20.0) for k in (1.0, 2.0, 3.5, 14.7)]


@query(f"SELECT x, dof, {sql6(chi2_tail('x', 'dof'), 'p')} FROM {_values(CHIS)} v(x, dof)")
def chi_square_distribution(spark, sf_dir):
    """The chi-square distribution with real-valued degrees of freedom."""
    return _grid(spark, [(x, k, float(special.chi2_sf(x, k))) for x, k in CHIS], "x double, dof double, p double").withColumn("p", r6("p"))


@query(f"SELECT x, shape, scale, {sql6(chi2_tail('2 * x / scale', '2 * shape'), 'p')} FROM {_values([(x, k, s) for x in (0.5, 4.0) for k in (1.0, 2.7) for s in (0.5, 2.0)])} v(x, shape, scale)")
def gamma_distribution(spark, sf_dir):
    rows = [(x, k, s, float(special.gamma_sf(x, k, s))) for x in (0.5, 4.0) for k in (1.0, 2.7) for s in (0.5, 2.0)]
    return _grid(spark, rows, "x double, shape double, scale double, p double").withColumn("p", r6("p"))


FS = [(x, a, b) for x in (0.4, 1.0, 3.0) for a in (1.0, 2.0, 5.0) for b in (4.0, 60.0)]


@query(f"SELECT x, d1, d2, {sql6(f_tail('x', 'd1', 'd2'), 'p')} FROM {_values(FS)} v(x, d1, d2)")
def f_distribution(spark, sf_dir):
    return _grid(spark, [(x, a, b, float(special.f_sf(x, a, b))) for x, a, b in FS], "x double, d1 double, d2 double, p double").withColumn("p", r6("p"))


@query(f"SELECT x, {sql6('lgamma(x)', 'y')} FROM {_values([(x,) for x in (0.1, 1.0, 2.5, 30.0, 1e5)])} v(x)")
def log_gamma_function(spark, sf_dir):
    return _grid(spark, [(x, float(special.log_gamma(x))) for x in (0.1, 1.0, 2.5, 30.0, 1e5)], "x double, y double").withColumn("y", r6("y"))


IMHOFS = [(x, a, b) for x in (1.0, 5.0, 12.0) for a, b in ((1.0, 1.0), (2.0, 1.0), (5.0, 0.3))]


@query(f"SELECT x, a, b, {sql6('2 / pi() * ' + simpson('exp(-x / 2 / (a * pow(cos(u$), 2) + b * pow(sin(u$), 2)))', '0', 'pi() / 2'), 'two')}, {sql6('1 - (' + simpson('exp(-u$ * u$ / 2 / a) * 2 / sqrt(2 * pi() * a) * (1 - exp(-(x - u$ * u$) / 2 / b))', '0', 'sqrt(x)') + ')', 'three')} FROM {_values(IMHOFS)} v(x, a, b)")
def weighted_chi_squares(spark, sf_dir):
    """P(a X1 + b X2 > x) and P(a X1 + b X2 + b X3 > x): the second by parts, as the last two make an exponential."""
    rows = [(x, a, b, special.weighted_chi2_sf(x, [a, b]), special.weighted_chi2_sf(x, [a, b, b])) for x, a, b in IMHOFS]
    return _grid(spark, rows, "x double, a double, b double, two double, three double").withColumns({c: r6(c) for c in ("two", "three")})


@query("SELECT CAST(k AS INTEGER) AS k, " + sql6("cos(k / 4.0)", "c") + ", " + sql6("sin(k / 4.0)", "s") + " FROM range(12) t(k)")
def matrix_exponential(spark, sf_dir):
    """The exponential of a turn is a rotation."""
    rows = [(k, *(float(x) for x in special.expm(np.array([[0.0, -k / 4], [k / 4, 0.0]]))[:, 0])) for k in range(12)]
    return _grid(spark, rows, "k int, c double, s double").select("k", r6("c").alias("c"), r6("s").alias("s"))


# tests


@query(f"WITH p AS ({union([f'SELECT {chr(39)}{a}{chr(39)} AS x, {chr(39)}{b}{chr(39)} AS y, corr({a}, {b}) AS r, count(*) AS n FROM lineitem' for a, b in PAIRS])}) SELECT x, y, {sql6(normal_tail('sqrt(n - 3) * abs(atanh(r))'), 'fisherz')}, {sql6(t_tail('abs(r) * sqrt((n - 2) / (1 - r * r))', '(n - 2)'), 'student_t')} FROM p")
def correlation_pvalues(spark, sf_dir):
    """p-values of all pairs by the two tests of correlations."""
    m = mm.moments(items(spark, sf_dir), NUMBERS)
    queries = [(NUMBERS.index(a), NUMBERS.index(b), ()) for a, b in PAIRS]
    rows = [(a, b, float(p), float(q)) for (a, b), p, q in zip(PAIRS, ci.FisherZ(m).many(queries), ci.StudentT(m).many(queries), strict=True)]
    return _grid(spark, rows, "x string, y string, fisherz double, student_t double").withColumns({c: r6(c) for c in ("fisherz", "student_t")})


def _partial_pvalues() -> str:
    rows = [f"SELECT '{a}' AS x, '{b}' AS y, '{c}' AS given, corr({a}, {b}) AS xy, corr({a}, {c}) AS xz, corr({b}, {c}) AS yz, count(*) AS n FROM lineitem" for a, b, c in TRIPLES]
    return f"WITH p AS ({union(rows)}), q AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM p) SELECT x, y, given, {sql6(normal_tail('sqrt(n - 4) * abs(atanh(r))'), 'fisherz')}, {sql6(t_tail('abs(r) * sqrt((n - 3) / (1 - r * r))', '(n - 3)'), 'student_t')} FROM q"


@query(_partial_pvalues())
def partial_pvalues(spark, sf_dir):
    """p-values of all pairs given each other variable: one batch of queries, one scan."""
    m = mm.moments(items(spark, sf_dir), NUMBERS)
    queries = [(NUMBERS.index(a), NUMBERS.index(b), (NUMBERS.index(c),)) for a, b, c in TRIPLES]
    rows = [(a, b, c, float(p), float(q)) for (a, b, c), p, q in zip(TRIPLES, ci.FisherZ(m).many(queries), ci.StudentT(m).many(queries), strict=True)]
    return _grid(spark, rows, "x string, y string, given string, fisherz double, student_t double").withColumns({c: r6(c) for c in ("fisherz", "student_t")})


HOLES = "CASE WHEN l_quantity > 5 THEN l_tax END"


@query(f"WITH d AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, CASE WHEN l_linenumber < 5 THEN l_discount END AS c FROM lineitem WHERE l_linenumber > 0), p AS (SELECT 'a' AS x, 'b' AS y, corr(a, b) AS r, count(*) AS n FROM d UNION ALL SELECT 'a', 'c', corr(a, c), count(c) FROM d UNION ALL SELECT 'b', 'c', corr(b, c), count(c) FROM d), q AS (SELECT count(*) AS n, corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz FROM d WHERE c IS NOT NULL) SELECT x, y, '' AS given, {sql6('r', 'r')}, {sql6(normal_tail('sqrt(n - 3) * abs(atanh(r))'), 'p')} FROM p UNION ALL SELECT 'a', 'b', 'c', {sql6('r', 'r')}, {sql6(normal_tail('sqrt(n - 4) * abs(atanh(r))'), 'p')} FROM (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM q)")
def testwise_deletion(spark, sf_dir):
    """Tests on the rows observed in all variables of each, from the moments of each pattern of missing values."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("c"))
    test = ci.make_test(df, "fisherz", ["a", "b", "c"], missing="testwise")
    rows = [("abc"[x], "abc"[y], "".join("abc"[v] for v in s), test.partial(x, y, s), float(test.many([(x, y, s)])[0])) for x, y, s in ((0, 1, ()), (0, 2, ()), (1, 2, ()), (0, 1, (2,)))]
    return _grid(spark, rows, "x string, y string, given string, r double, p double").withColumns({c: r6(c) for c in ("r", "p")})


CROSS = """WITH t AS (SELECT {s} AS s, {x} AS x, {y} AS y, count(*) AS o FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, sum(o) OVER (PARTITION BY s, x) AS rx, sum(o) OVER (PARTITION BY s, y) AS cy, sum(o) OVER (PARTITION BY s) AS ns FROM t),
k AS (SELECT s, ns, count(DISTINCT x) AS a, count(DISTINCT y) AS b, sum((o - rx * cy / ns) * (o - rx * cy / ns) / (rx * cy / ns) - rx * cy / ns) + ns AS c FROM m GROUP BY s, ns)
SELECT sum(c) AS x, sum(CASE WHEN ns > 1 THEN CAST(ns AS DOUBLE) * (a - 1) * (b - 1) / (ns - 1) ELSE 0 END) AS dof FROM k"""
CROSSES = [("l_returnflag", "l_linestatus", "l_linenumber"), ("l_returnflag", "l_linenumber", "l_linestatus"), ("l_linestatus", "l_linenumber", "l_returnflag")]


@query(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, '{g}' AS given, {sql6(chi2_tail('q.x', 'q.dof'), 'p')} FROM ({CROSS.format(x=x, y=y, s=s)}) q" for x, y, z in CROSSES for g, s in (("", "0"), (z, z))))
def chi_square_pvalues(spark, sf_dir):
    """Pearson's test of the pairs of three categories, alone and given the third: one scan's joint cells."""
    names = ["l_returnflag", "l_linestatus", "l_linenumber"]
    test = ci.ChiSquare(cell_tables.cells(table(spark, sf_dir, "lineitem"), names))
    rows = [(x, y, g, test.pvalue(names.index(x), names.index(y), tuple(names.index(v) for v in ([g] if g else [])))) for x, y, z in CROSSES for g in ("", z)]
    return _grid(spark, rows, "x string, y string, given string, p double").withColumn("p", r6("p"))


G2 = """WITH t AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM t)"""


@query(G2 + f" SELECT {sql6('g', 'g2')}, {sql6(chi2_tail('g', '2'), 'p')} FROM (SELECT sum(2 * o * ln(o * n / (CAST(rx AS DOUBLE) * cy))) AS g FROM m)")
def likelihood_ratio_pvalue(spark, sf_dir):
    """The likelihood-ratio test of two categories; its degrees of freedom, a mean under shuffles, are two but for 1 / n."""
    test = ci.ChiSquare(cell_tables.cells(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), True)
    g, dof = test.statistic(0, 1)
    assert abs(dof - 2) < 0.01
    return _grid(spark, [(g, float(special.chi2_sf(g, round(dof))))], "g2 double, p double").withColumns({c: r6(c) for c in ("g2", "p")})


#: Log likelihood of a category and a standardised number by conditional Gaussians, whose variances are drawn to the whole.
CG = """WITH w AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd, count(*) AS total FROM orders), z AS (SELECT o_orderstatus AS c, (o_totalprice - mu) / sd AS z FROM orders, w),
k AS (SELECT c, count(*) AS n, var_pop(z) * count(*) AS scatter FROM z GROUP BY c), f AS (SELECT n, scatter, (scatter + 1) / (n + 1) AS v FROM k),
joint AS (SELECT sum(n * ln(n / CAST(total AS DOUBLE))) - 0.5 * sum(n * (ln(2 * pi()) + ln(v)) + scatter / v) AS l, count(*) * 3 - 1 AS p FROM f, w),
cat AS (SELECT sum(n * ln(n / CAST(total AS DOUBLE))) AS l, count(*) - 1 AS p FROM f, w),
con AS (SELECT -0.5 * total * (ln(2 * pi()) + 1) AS l, 2 AS p FROM w)"""


@query(CG + f" SELECT {sql_two('-2 * (j.l - c.l) + ln(total) * (j.p - c.p)', 'number_given_category')}, {sql_two('-2 * (j.l - n.l) + ln(total) * (j.p - n.p)', 'category_given_number')}, {sql_two('2 * (j.l - c.l - n.l)', 'ratio')}, {sql6(chi2_tail('2 * (j.l - c.l - n.l)', 'CAST(j.p - c.p - n.p AS DOUBLE)'), 'p')} FROM joint j, cat c, con n, w")
def conditional_gaussian(spark, sf_dir):
    """Scores of a category and a number given each other, and the likelihood-ratio test of the two."""
    c = cell_tables.cells(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_totalprice"])
    score, test = scores.CGScore(c), ci.CGTest(c)
    (joint, _), (cat, _), (con, _) = test.fit([0, 1]), test.fit([0]), test.fit([1])
    rows = [(score.local(1, [0]), score.local(0, [1]), 2 * (joint - cat - con), test.pvalue(0, 1))]
    return _grid(spark, rows, "number_given_category double, category_given_number double, ratio double, p double").select(*(two_places(c).alias(c) for c in ("number_given_category", "category_given_number", "ratio")), r6("p").alias("p"))


DG = "WITH g AS (SELECT o_orderstatus AS c, count(*) AS n, avg(o_totalprice / 1000) AS m, var_pop(o_totalprice / 1000) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * v) AS within_ FROM g), w AS (SELECT count(*) AS k, var_samp(o_totalprice / 1000) AS v FROM orders)"


@query(DG + f" SELECT {sql_two('w.k * ln(within_ / (w.k - 1)) + ln(w.k) * 2', 'score')}, {sql_two('-w.k * ln(1 - r2)', 'ratio')}, {sql6(chi2_tail('(-w.k * ln(1 - r2))', '2'), 'p')} FROM (SELECT within_, 1 - within_ / (w.v * (w.k - 1)) AS r2 FROM t, w) q, w")
def degenerate_gaussian(spark, sf_dir):
    """The score of a number given a category, and the test of the two, on indicators of the category."""
    c = cell_tables.cells(table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("p")), ["o_orderstatus"], ["p"])
    test = ci.DGTest(c)
    cov, n = test.m.cov, test.m.n
    r2 = float(cov[2, :2] @ np.linalg.solve(cov[:2, :2], cov[:2, 2]) / cov[2, 2])
    rows = [(scores.DGScore(c).local(1, [0]), float(-n * np.log1p(-r2)), test.pvalue(0, 1))]
    return _grid(spark, rows, "score double, ratio double, p double").select(*(two_places(c).alias(c) for c in ("score", "ratio")), r6("p").alias("p"))


# scores


def _residual(y: str, p: tuple) -> str:
    """SQL of the residual variance of a regression on up to two variables."""
    if not p:
        return f"var_samp({y})"
    if len(p) == 1:
        return f"(var_samp({y}) - covar_samp({y}, {p[0]}) * covar_samp({y}, {p[0]}) / var_samp({p[0]}))"
    a, b = p
    va, vb, ab, ya, yb = f"var_samp({a})", f"var_samp({b})", f"covar_samp({a}, {b})", f"covar_samp({y}, {a})", f"covar_samp({y}, {b})"
    return f"(var_samp({y}) - ({ya} * {ya} * {vb} - 2 * {ya} * {yb} * {ab} + {yb} * {yb} * {va}) / ({va} * {vb} - {ab} * {ab}))"


FAMILIES = [(y, p) for y in PLANTED for k in range(3) for p in combinations([q for q in PLANTED if q != y], k)]


@query(" UNION ALL ".join(f"SELECT '{y}' AS node, '{','.join(p)}' AS parents, {sql_two(f'count(*) * ln({_residual(y, p)}) + {len(p)} * ln(count(*)) + 2 * (lgamma(4) - lgamma({len(p) + 1}) - lgamma({4 - len(p)}))', 'score')} FROM {plant_sql(PLANT)}" for y, p in FAMILIES))
def extended_bic(spark, sf_dir):
    """Extended BIC of each family of up to two parents."""
    s = scores.BIC(mm.moments(_planted(spark, sf_dir), PLANTED), ebic_gamma=1.0)
    rows = [(y, ",".join(p), s.local(PLANTED.index(y), [PLANTED.index(q) for q in p])) for y, p in FAMILIES]
    return _grid(spark, rows, "node string, parents string, score double").withColumn("score", two_places("score"))


@query(" UNION ALL ".join(f"SELECT '{y}' AS node, '{','.join(p)}' AS base, '{u}' AS move, {sql_two(f'a.s - b.s', 'delta')} FROM (SELECT count(*) * ln({_residual(y, tuple(sorted((*p, u), key=PLANTED.index)))}) + {len(p) + 1} * ln(count(*)) AS s FROM {plant_sql(PLANT)}) a, (SELECT count(*) * ln({_residual(y, p)}) + {len(p)} * ln(count(*)) AS s FROM {plant_sql(PLANT)}) b" for y, p in FAMILIES if len(p) < 2 for u in PLANTED if u != y and u not in p))
def score_deltas(spark, sf_dir):
    """What each further parent adds to each family's score: all moves from one base at once."""
    s = scores.BIC(mm.moments(_planted(spark, sf_dir), PLANTED))
    rows = []
    for y, p in FAMILIES:
        if len(p) < 2:
            base = [PLANTED.index(q) for q in p]
            d = scores.add_deltas(s, PLANTED.index(y), base)
            rows += [(y, ",".join(p), u, float(d[k])) for k, u in enumerate(PLANTED) if u != y and u not in p]
    return _grid(spark, rows, "node string, base string, move string, delta double").withColumn("delta", two_places("delta"))


@query(f"SELECT 'quantity' AS node, {sql_two('(SELECT count(*) * ln(var_samp(quantity)) FROM d)', 'alone')} UNION ALL SELECT 'tax', {sql_two('(SELECT count(*) * ln(var_samp(tax)) FROM d WHERE l_returnflag <> ' + chr(39) + 'R' + chr(39) + ')', 'alone')} UNION ALL SELECT 'cost', {sql_two('(SELECT count(*) * ln(' + _residual('cost', ('quantity',)) + ') + (SELECT ln(count(*)) FROM d) FROM d)', 'alone')}".replace("SELECT 'quantity'", f"WITH d AS {plant_sql(PLANT, ', l_returnflag')} SELECT 'quantity'", 1))
def interventional_bic(spark, sf_dir):
    """Scores of variables where an environment intervenes on one of them: its rows don't count for that one."""
    df = _planted(spark, sf_dir)
    by = mm.moments_by(df, PLANTED, "l_returnflag")
    whole, rest = mm.pooled(list(by.values())), mm.pooled([m for e, m in by.items() if e != "R"])
    s = scores.InterventionalBIC([rest if v == "tax" else whole for v in PLANTED], whole.n)
    rows = [("quantity", s.local(0, [])), ("tax", s.local(1, [])), ("cost", s.local(2, [0]))]
    return _grid(spark, rows, "node string, alone double").withColumn("alone", two_places("alone"))


@query(f"WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS u FROM {ITEMS}) SELECT {sql6('avg(ln(cosh(u)))', 'log_cosh')}, {sql6('avg(u * exp(-u * u / 2))', 'gauss')}, {sql6('(1 + ln(2 * pi())) / 2 - 79.047 * pow(avg(ln(cosh(u))) - 0.37457, 2) - 7.4129 * pow(avg(u * exp(-u * u / 2)), 2)', 'entropy')} FROM z")
def entropy(spark, sf_dir):
    """The approximate entropy of a standardised variable, by two nonlinear moments of one scan."""
    from tessera.operators.rowwise import row_sums
    from tessera.plans.lingam import entropy_of

    df = items(spark, sf_dir)
    m = mm.moments(df, ["l_quantity"])
    n, s = row_sums(df, ["l_quantity"], lambda x: (lambda u: np.array([np.log(np.cosh(u)).sum(), (u * np.exp(-(u**2) / 2)).sum()]))((x[:, 0] - m.mean[0]) / m.cov[0, 0] ** 0.5))
    a, b = s / n
    return _grid(spark, [(float(a), float(b), float(entropy_of(a, b)))], "log_cosh double, gauss double, entropy double").select(*(r6(c).alias(c) for c in ("log_cosh", "gauss", "entropy")))


VARS = " UNION ALL ".join(f"SELECT '{v}' AS variable, var_samp({v}) AS var FROM {plant_sql(PLANT)}" for v in PLANTED)


@query(f"WITH v AS ({VARS}), p AS (SELECT * FROM (VALUES ('quantity', 'cost'), ('cost', 'paid'), ('tax', 'paid'), ('quantity', 'paid')) p(a, b)) SELECT {sql6('avg(CASE WHEN y.var / x.var > 1 + 1e-9 THEN 1.0 WHEN abs(y.var / x.var - 1) <= 1e-9 THEN 0.5 ELSE 0 END)', 'share')} FROM p JOIN v x ON x.variable = p.a JOIN v y ON y.variable = p.b")
def varsortability(spark, sf_dir):
    """Along how many of the planted directed paths the variance grows."""
    from tessera.operators import metrics

    a = np.zeros((4, 4))
    for x, y in (("quantity", "cost"), ("cost", "paid"), ("tax", "paid")):
        a[PLANTED.index(x), PLANTED.index(y)] = 1
    m = mm.moments(_planted(spark, sf_dir), PLANTED)
    return _grid(spark, [(float(metrics.varsortability(np.diag(m.cov), a)),)], "share double").withColumn("share", r6("share"))
