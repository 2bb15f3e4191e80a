"""Reading sample tables and network files, and saving results."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.profile import DataError
from tessera.plans.graph import Graph

MISSING = ("", "NA", "N/A", "nan")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV, TSV, white-space text or .npy, by the name's end.

    A first line without any number is the header; one that mixes words and numbers is an error. Empty cells, NA,
    N/A and nan are missing. Columns of numbers become doubles.
    """
    for end in ("parquet", "orc", "json"):
        if path.rstrip("/").endswith(f".{end}"):
            return getattr(spark.read, end)(path)
    if path.endswith(".npy"):
        x = np.load(path)
        return spark.createDataFrame(pd.DataFrame(x, columns=[f"X{j}" for j in range(x.shape[1])]))
    head = spark.read.text(path).head()
    if head is None:
        raise DataError("the file is empty")
    separator = "," if path.endswith(".csv") else "\t" if path.endswith(".tsv") else None
    cells = [c.strip().strip('"') for c in (head[0].split(separator) if separator else head[0].split())]
    words = [c for c in cells if c not in MISSING and not _number(c)]
    if words and len(words) < sum(c not in MISSING for c in cells):
        raise DataError("the first line mixes names and numbers")
    if separator is None:
        rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v"))
        if words:
            rows = rows.where(F.col("v") != F.lit(cells))
        df = rows.select(*(F.col("v")[k].alias(c if words else f"X{k}") for k, c in enumerate(cells)))
    else:
        df = spark.read.option("header", bool(words)).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)
        df = df if words else df.toDF(*(f"X{k}" for k in range(len(df.columns))))
    df = df.select(*(F.when(~F.trim(c).isin(*MISSING), F.trim(c)).alias(c) for c in df.columns))
    bad = df.agg(*(F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), 1)).alias(c) for c in df.columns)).head()
    return df.select(*(F.col(c).try_cast("double").alias(c) if not bad[c] else F.col(c) for c in df.columns))


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def read_panel(spark: SparkSession, paths: list[str], name: str = "dataset_id") -> DataFrame:
    """Several tables of the same columns as one, with each row's table number."""
    out = None
    for k, p in enumerate(paths):
        part = read_table(spark, p).withColumn(name, F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Network:
    """A discrete Bayesian network: states, parents, and tables by parent configuration."""

    states: dict[str, list[str]]
    parents: dict[str, list[str]]
    tables: dict[str, dict[tuple, list[float]]]

    def graph(self) -> Graph:
        names = list(self.states)
        a = np.zeros((len(names),) * 2, bool)
        for v, ps in self.parents.items():
            for p in ps:
                a[names.index(p), names.index(v)] = True
        return Graph.of_dag(a, names)

    def sample(self, n: int, seed: int = 0) -> pd.DataFrame:
        from tessera.plans.graph import order_of

        rng, g, out = np.random.default_rng(seed), self.graph(), {}
        for k in order_of(g.directed):
            v = g.labels[k]
            ps = self.parents.get(v, [])
            keys = list(zip(*(out[p] for p in ps), strict=True)) if ps else [()] * n
            cum = {q: np.cumsum(t) for q, t in self.tables[v].items()}
            u = rng.random(n)
            out[v] = [self.states[v][min(int(np.searchsorted(cum[q], x)), len(self.states[v]) - 1)] for q, x in zip(keys, u, strict=True)]
        return pd.DataFrame({v: out[v] for v in self.states})


def parse_bif(text: str) -> Network:
    """A network in the Bayesian interchange format."""
    states = {m[1]: [s.strip() for s in m[2].split(",")] for m in re.finditer(r"variable\s+(\S+)\s*\{[^{}]*\{([^}]*)\}", text)}
    parents, tables = {}, {}
    for m in re.finditer(r"probability\s*\(\s*([^|)\s]+)\s*(?:\|\s*([^)]*))?\)\s*\{([^}]*)\}", text):
        v, ps = m[1], [p.strip() for p in (m[2] or "").split(",") if p.strip()]
        parents[v] = ps
        numbers = lambda s: [float(x) for x in s.split(",")]
        rows = {tuple(s.strip() for s in r[1].split(",")): numbers(r[2]) for r in re.finditer(r"\(([^)]*)\)\s*([^;]*);", m[3])}
        if t := re.search(r"table\s+([^;]*);", m[3]):
            rows[()] = numbers(t[1])
        tables[v] = rows
    return Network(states, parents, tables)


def read_bif(spark: SparkSession, path: str) -> Network:
    return parse_bif(spark.read.text(path, wholetext=True).head()[0])


def save_graph(spark: SparkSession, graph: Graph, path: str) -> None:
    """One JSON file in a folder that any store can hold."""
    meta = {k: v for k, v in graph.meta.items() if isinstance(v, (str, int, float, list, dict))}
    spark.createDataFrame([(json.dumps({"kind": graph.kind, "labels": list(graph.labels), "edges": graph.edges(), "latent": sorted(graph.latent), "meta": meta}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_graph(spark: SparkSession, path: str) -> Graph:
    x = json.loads(spark.read.text(path, wholetext=True).head()[0])
    g = Graph.from_edges(x["edges"], len(x["labels"]), x["kind"], x["labels"])
    return Graph(g.marks, g.kind, g.labels, frozenset(x["latent"]), x["meta"])


def load_config(path: str) -> dict:
    """Options from a JSON file, or from lines `key: value` of plain YAML (values as JSON or text, # for comments)."""
    with open(path) as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        found = {}
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*", "", line).rstrip()
            if not line:
                continue
            if line[0] in " \t-" or ":" not in line:
                raise DataError(f"not a line `key: value`: {line}") from None
            key, _, value = line.partition(":")
            value = value.strip()
            try:
                found[key.strip()] = json.loads(value)
            except ValueError:
                found[key.strip()] = value.strip("'\"") or None
    if not isinstance(found, dict):
        raise DataError("options must be keys and values")
    return found


def load_dataset(spark: SparkSession, name: str, data_home: str, *, n: int = 1000, seed: int = 0) -> tuple[DataFrame, Graph | None]:
    """A data set by name from a folder: a table (name.parquet, .csv, .tsv), or rows drawn from a network (name.bif).

    With it the true graph, if there is a network or a saved graph (name.graph).
    """
    def exists(path):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    base = f"{data_home.rstrip('/')}/{name}"
    truth = load_graph(spark, f"{base}.graph") if exists(f"{base}.graph") else None
    network = read_bif(spark, f"{base}.bif") if exists(f"{base}.bif") else None
    for end in ("parquet", "csv", "tsv"):
        if exists(f"{base}.{end}"):
            return read_table(spark, f"{base}.{end}"), truth or (network.graph() if network else None)
    if network is None:
        raise DataError(f"no {name}.parquet, .csv, .tsv or .bif in {data_home}")
    return spark.createDataFrame(network.sample(n, seed)), network.graph()


def from_marks(marks, *, kind: str | None = None, labels=(), allow_self_loops: bool = False) -> Graph:
    """A graph of a matrix of marks, checked; without a kind, the narrowest that has all the marks."""
    m = np.asarray(marks)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isin(m, (0, 1, 2, 3)).all():
        raise ValueError("marks are a square matrix of 0, 1, 2 and 3")
    if m.diagonal().any() and not allow_self_loops:
        raise ValueError("a variable has an edge to itself")
    if ((m != 0) != (m.T != 0)).any():
        raise ValueError("an edge has a mark at one end only")
    kinds = [kind] if kind else ["dag", "undirected", "cpdag", "mag", "pag", "digraph"]
    for k in kinds:
        try:
            return Graph(m, k, labels).validate()
        except ValueError as e:
            reason = e
    raise ValueError(f"no kind of graph has these marks: {reason}")


def to_coo(graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, causes, effects) of a graph's weights, or ones for its arrows without weights: a sparse matrix's triple."""
    w = graph.meta.get("weights")
    a = np.asarray(w).T if w is not None else graph.directed.astype(float)
    i, j = np.nonzero(a)
    return a[i, j], i, j


def to_csr(graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, columns, row starts) of the same matrix."""
    values, i, j = to_coo(graph)
    return values, j, np.searchsorted(i, np.arange(graph.d + 1))


def from_networkx(g, *, kind: str | None = None) -> Graph:
    """A graph of any object with `nodes`, `edges` and `is_directed()`; marks may be edge attributes mark_u and mark_v."""
    labels = [str(v) for v in g.nodes]
    at = {v: k for k, v in enumerate(g.nodes)}
    m = np.zeros((len(labels),) * 2, np.int8)
    for u, v, *rest in g.edges(data=True):
        data = rest[-1] if rest else {}
        i, j = at[u], at[v]
        a, b = data.get("mark_u", 1), data.get("mark_v", 2 if g.is_directed() else 1)
        m[i, j], m[j, i] = (1, 1) if m[i, j] == 2 and "mark_u" not in data else (a, b)  # arrows both ways are a line
    return from_marks(m, kind=kind, labels=labels)


def to_networkx(graph: Graph):
    """The graph as a NetworkX DiGraph with the marks as edge attributes; that library must be installed."""
    import networkx

    g = networkx.DiGraph()
    g.add_nodes_from(graph.labels)
    for i, j, a, b in graph.edges():
        if (a, b) == (2, 1):
            i, j, a, b = j, i, b, a
        g.add_edge(graph.labels[i], graph.labels[j], mark_u=a, mark_v=b)
    return g


def save_npz(graph: Graph, path: str) -> None:
    """Marks, kind, labels and weights in one compressed file."""
    w = graph.meta.get("weights")
    np.savez_compressed(path, marks=graph.marks, kind=graph.kind, labels=np.array(graph.labels), latent=np.array(sorted(graph.latent), int), weights=np.asarray(w if w is not None else []))


def load_npz(path: str) -> Graph:
    with np.load(path) as x:
        meta = {"weights": x["weights"]} if x["weights"].size else {}
        return Graph(x["marks"], str(x["kind"]), [str(v) for v in x["labels"]], frozenset(int(v) for v in x["latent"]), meta)


def truncated(result: dict, limit: int = 1000) -> tuple[dict, bool]:
    """A result's JSON with at most `limit` edges or links inline, and whether some were left out (their number is told)."""
    out, cut = dict(result), False
    for key in ("edges", "links"):
        if len(out.get(key, ())) > limit:
            out[f"n_{key}"], out[key], cut = len(out[key]), out[key][:limit], True
    return out, cut
