"""SQL that derives the searches' results over the planted table by itself, from correlations alone.

The pattern (CPDAG) of a table of four variables: all partial correlations by the recursion, the edges that no set
separates, colliders from the smallest separating sets, and Meek's rules. Searches of all kinds must agree with it.
"""

from __future__ import annotations

from itertools import combinations

from tessera.queries import NUMBERS, PLANT, PLANT_EVEN, PLANTED, QUERIES, SERIES, SQL, Z05, plant_sql, sql6
from tessera.queries_functions import chi2_tail


def _r(a: str, b: str, given: tuple = ()) -> str:
    a, b = sorted((a, b))
    return "r_" + "_".join((a, b, *sorted(given)))


def _partial(a: str, b: str, c: str, given: tuple = ()) -> str:
    """The correlation of a and b given c besides the others, from those given the others."""
    ab, ac, bc = _r(a, b, given), _r(a, c, given), _r(b, c, given)
    return f"({ab} - {ac} * {bc}) / sqrt((1 - {ac} * {ac}) * (1 - {bc} * {bc})) AS {_r(a, b, (*given, c))}"


def tests_sql(columns: list[str], source: str) -> str:
    """CTEs up to tests(x, y, s, k, r, n): every pair's partial correlation given every set of up to two others."""
    pairs = list(combinations(columns, 2))
    one = [(a, b, c) for a, b in pairs for c in columns if c not in (a, b)]
    two = [(a, b, c, d) for a, b in pairs for c, d in combinations([x for x in columns if x not in (a, b)], 2)]
    at = {c: k for k, c in enumerate(columns)}
    rows = [f"SELECT {at[a]} AS x, {at[b]} AS y, CAST([] AS INTEGER[]) AS s, 0 AS k, {_r(a, b)} AS r, n FROM c2" for a, b in pairs]
    rows += [f"SELECT {at[a]}, {at[b]}, [{at[c]}], 1, {_r(a, b, (c,))}, n FROM c2" for a, b, c in one]
    rows += [f"SELECT {at[a]}, {at[b]}, [{at[c]}, {at[d]}], 2, {_r(a, b, (c, d))}, n FROM c2" for a, b, c, d in two]
    return (
        f"WITH c0 AS (SELECT count(*) AS n, {', '.join(f'corr({a}, {b}) AS {_r(a, b)}' for a, b in pairs)} FROM {source}), "
        f"c1 AS (SELECT *, {', '.join(_partial(a, b, c) for a, b, c in one)} FROM c0), "
        f"c2 AS (SELECT *, {', '.join(_partial(a, b, d, (c,)) for a, b, c, d in two)} FROM c1), "
        f"names AS (SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{c}{chr(39)})' for c, k in at.items())}) v(i, name)), "
        f"tests AS ({' UNION ALL '.join(rows)})"
    )


def pattern_sql(columns: list[str], source: str, critical: float = Z05, rounds: int = 3) -> str:
    """CTEs up to adj(a, b) (both ways), to0(a, b) (arrows of colliders) and to{rounds}(a, b) (with Meek's rules)."""
    sql = tests_sql(columns, source) + f""", apart AS (SELECT x, y, min(k) AS k FROM tests WHERE sqrt(n - k - 3) * abs(atanh(r)) <= {critical} GROUP BY x, y),
sepset AS (SELECT DISTINCT t.x, t.y, v.m FROM tests t JOIN apart p ON t.x = p.x AND t.y = p.y AND t.k = p.k, unnest(t.s) AS v(m) WHERE sqrt(t.n - t.k - 3) * abs(atanh(t.r)) <= {critical}),
edge AS (SELECT DISTINCT x, y FROM tests EXCEPT SELECT x, y FROM apart), adj AS (SELECT x AS a, y AS b FROM edge UNION SELECT y, x FROM edge),
collider AS (SELECT l.a, l.b, r.a AS c FROM adj l JOIN adj r ON l.b = r.b AND l.a < r.a WHERE NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = l.a AND t.b = r.a) AND NOT EXISTS (SELECT 1 FROM sepset s WHERE s.x = l.a AND s.y = r.a AND s.m = l.b)),
to0 AS (SELECT a, b FROM collider UNION SELECT c, b FROM collider)"""
    return sql + meek_sql(rounds)


def meek_sql(rounds: int, rule4: bool = False) -> str:
    """CTEs to1 .. from to0(a, b) and adj(a, b): three or all four of Meek's rules, round by round."""
    sql = ""
    for k in range(rounds):
        line, to = f"(SELECT a, b FROM adj EXCEPT (SELECT a, b FROM to{k} UNION SELECT b, a FROM to{k}))", f"to{k}"
        sql += f""", to{k + 1} AS (SELECT a, b FROM {to}
UNION SELECT l.a, l.b FROM {to} w JOIN {line} l ON w.b = l.a WHERE w.a <> l.b AND NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = w.a AND t.b = l.b)
UNION SELECT l.a, l.b FROM {line} l JOIN {to} p ON p.a = l.a JOIN {to} q ON q.a = p.b AND q.b = l.b
UNION SELECT l.a, l.b FROM {line} l JOIN {line} u ON u.a = l.a JOIN {to} p ON p.a = u.b AND p.b = l.b JOIN {line} v ON v.a = l.a AND v.b <> u.b JOIN {to} q ON q.a = v.b AND q.b = l.b WHERE NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = u.b AND t.b = v.b)"""
        if rule4:
            sql += f""" UNION SELECT l.a, l.b FROM {line} l JOIN {line} u ON u.a = l.a AND u.b <> l.b JOIN {to} p ON p.a = u.b JOIN {to} q ON q.a = p.b AND q.b = l.b JOIN adj y ON y.a = l.a AND y.b = p.b WHERE NOT EXISTS (SELECT 1 FROM adj t WHERE t.a = u.b AND t.b = l.b)"""
        sql += ")"
    return sql


def typed_sql(arrow: str, line: str, directed: str = "to3") -> str:
    """The edges by name: arrows of `directed`, and the others from the first column to the later one."""
    return f""" SELECT a.name AS source, b.name AS target, '{arrow}' AS type FROM {directed} t JOIN names a ON a.i = t.a JOIN names b ON b.i = t.b
UNION ALL SELECT a.name, b.name, '{line}' FROM edge e JOIN names a ON a.i = e.x JOIN names b ON b.i = e.y WHERE NOT EXISTS (SELECT 1 FROM {directed} t WHERE (t.a = e.x AND t.b = e.y) OR (t.a = e.y AND t.b = e.x))"""


PLANT_SOURCE = plant_sql(PLANT)
PATTERN = pattern_sql(PLANTED, PLANT_SOURCE)
#: What is left undirected gets the way of the larger fourth cumulant, as the noise isn't Gaussian.
MOMENT = f""", z AS (SELECT {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS v{k}' for k, c in enumerate(PLANTED))} FROM {PLANT_SOURCE}),
moment AS ({' UNION ALL '.join(f'SELECT {i} AS a, {j} AS b, corr(v{i}, v{j}) * sign(avg(pow(v{i}, 4)) - 3) * (avg(pow(v{i}, 3) * v{j}) - avg(v{i} * pow(v{j}, 3))) AS m FROM z' for i in range(4) for j in range(4) if i != j)}),
dag AS (SELECT a, b FROM to3 UNION SELECT l.a, l.b FROM (SELECT a, b FROM adj EXCEPT (SELECT a, b FROM to3 UNION SELECT b, a FROM to3)) l JOIN moment m ON m.a = l.a AND m.b = l.b WHERE m.m > 0)"""

CPDAGS = ("pc", "pc_majority", "pc_student_t", "iamb", "inter_iamb", "ges", "xges", "ages", "boss", "grasp", "exact_search", "hc", "tabu", "mmhc", "rsmax2", "calm")
PAGS = ("fci", "gfci", "boss_fci", "grasp_fci")
DAGS = ("direct_lingam",)
for _name in CPDAGS:
    SQL[_name] = PATTERN + typed_sql("directed", "undirected")
for _name in PAGS:
    SQL[_name] = PATTERN + typed_sql("partially_directed", "circle", "to0")
for _name in DAGS:
    SQL[_name] = PATTERN + MOMENT + typed_sql("directed", "undirected", "dag")
SQL["mmpc"] = PATTERN + " SELECT a.name AS source, b.name AS target, 'undirected' AS type FROM edge e JOIN names a ON a.i = e.x JOIN names b ON b.i = e.y"
SQL["pc_skeleton_lineitem"] = pattern_sql(NUMBERS, "lineitem") + typed_sql("directed", "undirected")

#: Regressions of each variable on both lags: the t of a coefficient is the partial correlation's.
SQL["granger"] = SERIES + f""", d AS (SELECT n, v, lag(n) OVER (ORDER BY t) AS n1, lag(v) OVER (ORDER BY t) AS v1 FROM s WHERE v IS NOT NULL), e AS (SELECT * FROM d WHERE n1 IS NOT NULL),
c AS (SELECT count(*) AS k, corr(n, n1) AS a, corr(n, v1) AS b, corr(v, n1) AS c, corr(v, v1) AS d, corr(n1, v1) AS l, stddev_samp(n) AS sn, stddev_samp(v) AS sv, stddev_samp(n1) AS sn1, stddev_samp(v1) AS sv1 FROM e),
f AS (SELECT 'n' AS cause, 'n' AS effect, a AS y, b AS o, l, k, sn / sn1 AS w FROM c UNION ALL SELECT 'v', 'n', b, a, l, k, sn / sv1 FROM c UNION ALL SELECT 'n', 'v', c, d, l, k, sv / sn1 FROM c UNION ALL SELECT 'v', 'v', d, c, l, k, sv / sv1 FROM c),
g AS (SELECT cause, effect, (y - o * l) / (1 - l * l) * w AS weight, (y - o * l) / sqrt((1 - o * o) * (1 - l * l)) AS r, k FROM f),
p AS (SELECT cause, effect, weight, abs(r) * sqrt((k - 3) / (1 - r * r)) AS t, k - 3 AS dof FROM g),
q AS (SELECT cause, effect, weight, 1 - 2 * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(dof * pi()) * least(t, 40) / 6000 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(least(t, 40) * i / 2000, 2) / dof, -(dof + 1) / 2.0)) FROM range(2001) v(i)) AS p FROM p),
z AS (SELECT *, min(p * 4 / r) OVER (ORDER BY r DESC) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p) AS r FROM q))
SELECT cause, effect, 1 AS lag, {sql6("weight", "weight")} FROM z WHERE adjusted <= 0.05"""


SQL["var_lingam"] = SQL["granger"].replace(" WHERE adjusted <= 0.05", "")
SQL["pc_missing"] = SQL["structural_em"] = SQL["pc"]
SQL["ica_lingam"] = SQL["bottom_up_parce_lingam"] = SQL["direct_lingam"]
#: With noise of one variance in all variables, a cause varies less than its effect.
EVEN = pattern_sql(PLANTED, plant_sql(PLANT_EVEN)) + f""", var AS ({' UNION ALL '.join(f'SELECT {k} AS i, var_samp({c}) AS v FROM {plant_sql(PLANT_EVEN)}' for k, c in enumerate(PLANTED))}),
dag AS (SELECT a, b FROM to3 UNION SELECT l.a, l.b FROM (SELECT a, b FROM adj EXCEPT (SELECT a, b FROM to3 UNION SELECT b, a FROM to3)) l JOIN var x ON x.i = l.a JOIN var y ON y.i = l.b WHERE x.v < y.v)"""
SQL["notears"] = SQL["dagma"] = EVEN + typed_sql("directed", "undirected", "dag")

def _g2(x: str, y: str) -> str:
    """SQL of the pair as an edge if the likelihood-ratio test rejects their independence."""
    return f"""SELECT '{x}' AS source, '{y}' AS target, 'undirected' AS type FROM (SELECT sum(2 * o * ln(o * n / (CAST(rx AS DOUBLE) * cy))) AS g, CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS DOUBLE) AS dof
FROM (SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM (SELECT {x} AS x, {y} AS y, count(*) AS o FROM {plant_sql({}, f"*, {KEPT_SQL} AS kept")} GROUP BY 1, 2))) q WHERE {chi2_tail('q.g', 'q.dof')} <= 0.05"""


KEPT_SQL = "CASE WHEN e1 < 0.2 THEN l_returnflag ELSE 'X' END"
SQL["pc_gsq"] = " UNION ALL ".join(_g2(x, y) for x, y in combinations(("l_returnflag", "l_linestatus", "kept"), 2))


def _granger(spark, sf_dir):
    from pyspark.sql import functions as F

    return GRANGER(spark, sf_dir).withColumn("weight", F.round("weight", 6) + 0.0)


def _var_lingam(spark, sf_dir):
    from pyspark.sql import functions as F

    return VAR_LINGAM(spark, sf_dir).withColumn("weight", F.round("weight", 6) + 0.0)


GRANGER, VAR_LINGAM = QUERIES["granger"], QUERIES["var_lingam"]
QUERIES["granger"], QUERIES["var_lingam"] = _granger, _var_lingam
