from itertools import product

import numpy as np
import pytest

from tessera.operators import graphs, metrics
from tessera.operators.ci import Oracle
from tessera.plans import orient
from tessera.plans.constraint import fci, pc
from tessera.plans.graph import Graph, has_cycle
from tessera.plans.knowledge import Knowledge
from tessera.sources.generate import random_dag


def blocked(a, x, y, z):
    """d-separation by its definition: every path is blocked."""
    d = len(a)
    below = [set() for _ in range(d)]
    for v in range(d):
        todo = [v]
        while todo:
            u = todo.pop()
            if u not in below[v]:
                below[v].add(u)
                todo += np.flatnonzero(a[u]).tolist()

    def walk(path):
        if path[-1] == y:
            for p, v, q in zip(path, path[1:], path[2:], strict=False):
                if a[p, v] and a[q, v]:
                    if not below[v] & z:
                        return False
                elif v in z:
                    return False
            return True
        return any(walk([*path, int(w)]) for w in np.flatnonzero(a[path[-1]] | a[:, path[-1]]) if w not in path)

    return not walk([x])


@pytest.mark.parametrize("seed", range(8))
def test_separation_matches_its_definition(seed):
    a = random_dag(6, 2.5, seed)
    g = Graph.of_dag(a)
    for x, y in ((0, 5), (1, 4), (2, 3)):
        for bits in product((0, 1), repeat=4):
            z = {v for v, b in zip([v for v in range(6) if v not in (x, y)], bits, strict=True) if b}
            assert g.separated(x, y, z) == blocked(a, x, y, z)


@pytest.mark.parametrize("seed", range(12))
def test_pc_with_an_oracle_gives_the_class(seed):
    g = Graph.of_dag(random_dag(7, 2.5, seed))
    assert (pc(None, test=Oracle(g)).marks == orient.dag_to_cpdag(g.directed)).all()


def classes(d):
    """All DAGs of d nodes by skeleton and unshielded colliders."""
    pairs = [(i, j) for i in range(d) for j in range(i)]
    out = {}
    for choice in product((0, 1, 2), repeat=len(pairs)):
        a = np.zeros((d, d), bool)
        for (i, j), c in zip(pairs, choice, strict=True):
            if c:
                a[(i, j) if c == 1 else (j, i)] = True
        if has_cycle(a):
            continue
        adj = a | a.T
        v = frozenset((min(x, z), y, max(x, z)) for y in range(d) for x in range(d) for z in range(d) if x != z and a[x, y] and a[z, y] and not adj[x, z])
        out.setdefault((adj.tobytes(), v), []).append(a)
    return out


def test_completed_graphs_keep_what_all_members_share():
    for members in classes(4).values():
        m = orient.dag_to_cpdag(members[0])
        both = np.logical_and.reduce(members)
        assert (orient.directed(m) == both).all()
        assert (orient.dag_to_cpdag(orient.extension(m)) == m).all()


def test_fci_finds_a_hidden_cause():
    a = np.zeros((5, 5), bool)  # 0 -> 1 <- 4 -> 2 <- 3 with 4 hidden
    a[0, 1] = a[4, 1] = a[4, 2] = a[3, 2] = True
    mag = Graph.of_dag(a).to_mag(latent=["X4"])
    assert mag.marks[1, 2] == mag.marks[2, 1] == 2
    p = fci(None, test=Oracle(mag))
    assert (Graph.of_dag(a).to_pag(latent=["X4"]).marks == p.marks).all()
    assert p.marks[1, 2] == p.marks[2, 1] == 2
    assert p.marks[1, 0] == 2 and p.marks[0, 1] == 3


@pytest.mark.parametrize("seed", range(6))
def test_fci_marks_are_true_of_the_mag(seed):
    g = Graph.of_dag(random_dag(7, 2.2, seed))
    mag = g.to_mag(latent=["X0", "X3"])
    p = fci(None, test=Oracle(mag))
    assert ((p.marks != 0) == (mag.marks != 0)).all()
    known = (p.marks == 1) | (p.marks == 2)
    assert (p.marks[known] == mag.marks[known]).all()


def test_knowledge_orients_and_forbids():
    a = np.zeros((3, 3), bool)
    a[0, 1] = a[1, 2] = True
    g = pc(None, test=Oracle(Graph.of_dag(a)), knowledge=Knowledge(required=(("X0", "X1"),)))
    assert g.oriented_edges() == [("X0", "X1", "directed"), ("X1", "X2", "directed")]
    with pytest.raises(ValueError, match="cycle"):
        Knowledge(required=(("a", "b"), ("b", "a"))).resolve("ab")
    with pytest.raises(ValueError, match="isn't a variable"):
        Knowledge(forbidden=(("a", "q"),)).resolve("ab")


def test_conversions_and_queries(spark, tmp_path):
    from tessera.sources.tables import load_graph, save_graph

    a = np.zeros((4, 4), bool)
    a[0, 1] = a[1, 2] = a[3, 2] = True
    g = Graph.of_dag(a, "wxyz")
    assert g.ancestors("y") == ["w", "x", "z"]
    assert g.descendants("w") == ["x", "y"]
    assert g.markov_blanket("x") == ["w", "y", "z"]
    assert (Graph.from_pcalg(g.to_pcalg(), "dag", "wxyz").marks == g.marks).all()
    p = g.to_cpdag()
    assert (Graph.from_pcalg(p.to_pcalg(), "cpdag").marks == p.marks).all()
    assert (Graph.of_frame(p.frame(spark), p.labels, "cpdag").marks == p.marks).all()
    save_graph(spark, p, str(tmp_path / "g"))
    assert (load_graph(spark, str(tmp_path / "g")).marks == p.marks).all()
    assert "digraph" in g.dot() and g.svg().count("<line") == 3
    with pytest.raises(ValueError, match="cycle"):
        Graph.of_dag(np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0]])).validate()


def test_distances():
    a, b = np.zeros((3, 3), bool), np.zeros((3, 3), bool)
    a[0, 1] = a[1, 2] = True
    b[1, 0] = b[1, 2] = True
    g, h = Graph.of_dag(a), Graph.of_dag(b)
    assert metrics.shd(g, h) == 1
    assert metrics.shd(g, h, endpoint_aware=True) == 2
    assert metrics.shd(g, g) == 0
    assert metrics.markov_equivalent(g, h)
    assert metrics.skeleton_scores(g, h)["f1"] == 1.0
    assert metrics.direction_accuracy(g, h) == 0.5
    assert metrics.adjusted_rand([1, 1, 2, 2], ["a", "a", "b", "b"]) == 1.0
    assert metrics.varsortability([1, 2, 3], a) == 1.0


def test_edge_tables_agree_with_matrices(spark):
    a = random_dag(8, 2.5, 4)
    g = Graph.of_dag(a)
    e = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)], "a long, b long")
    got = {(r[0], r[1]) for r in graphs.ancestors(e).collect()}
    assert got == {(v, int(u[1:])) for v in range(8) for u in g.ancestors(v)}
    blankets = {(r[0], r[1]) for r in graphs.markov_blankets(e).collect()}
    assert blankets == {(v, int(u[1:])) for v in range(8) for u in g.markov_blanket(v)}
    adj = a | a.T
    triples = {tuple(r) for r in graphs.unshielded_triples(e).collect()}
    assert triples == {(x, y, z) for x in range(8) for y in range(8) for z in range(x + 1, 8) if adj[x, y] and adj[y, z] and not adj[x, z] and y not in (x, z)}
