"""Command line: python -m tessera COMMAND ...

run METHOD TABLE [key=value ...] [--config FILE] [--out FOLDER] [--graph json|dot|svg] [--limit N]   (run may be left out)
bootstrap METHOD TABLE [key=value ...] [n_resamples=N] [resampling=subsample|bootstrap] [sample_fraction=X]
markov-check GRAPH TABLE [alpha=X] [seed=N]
list [--json]; schema [METHOD]; config; calibrate

Options of a method: its defaults, then those of --config, then key=value. TABLE may be several paths with commas
between: a panel.
"""

from __future__ import annotations

import inspect
import json
import sys

from pyspark.sql import SparkSession

from tessera.operators.inputs import resolve_seed, warn_past_boundary
from tessera.plans import constraint, continuous, functional, lingam, resample, score_search, temporal
from tessera.plans.graph import Graph, TemporalGraph
from tessera.sources.tables import load_config, load_graph, read_panel, read_table, save_graph, truncated


def _fixed(f, **fixed):
    def run(df, **options):
        return f(df, **fixed, **options)

    run.__signature__, run.__doc__ = inspect.signature(f), f.__doc__
    return run


METHODS = {
    **{n: getattr(constraint, n) for n in ("pc", "fci", "cdnod", "fci_jci", "icp")},
    **{n: _fixed(constraint.blanket, method=n) for n in ("iamb", "inter_iamb", "mmpc")},
    **{n: getattr(score_search, n) for n in ("ges", "xges", "ages", "gies", "gnies", "hc", "tabu", "exact_search", "boss", "grasp", "rsmax2", "mmhc", "igsp")},
    "ut_igsp": score_search.igsp,
    **{n: _fixed(score_search.hybrid_fci, method=n) for n in ("gfci", "boss_fci", "grasp_fci")},
    **{n: getattr(continuous, n) for n in ("notears", "dagma", "calm")},
    **{n: getattr(lingam, n) for n in ("direct_lingam", "ica_lingam", "rcd", "bottom_up_parce_lingam", "gin")},
    **{n: getattr(functional, n) for n in ("cam", "resit", "camuv")},
    "score_matching": _fixed(functional.by_score, method="score_matching"),
    "nogam": _fixed(functional.by_score, method="nogam"),
    **{n: _fixed(functional.pair_direction, method=n) for n in ("anm", "pnl", "loci")},
    **{n: getattr(temporal, n) for n in ("pcmci", "pcmciplus", "jpcmciplus", "lpcmci", "granger", "dynotears", "var_lingam", "varma_lingam", "longitudinal_lingam")},
}


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def envelope(method: str, options: dict, result) -> dict:
    """The result as JSON: method, options, and edges or links."""
    out = {"method": method, "options": options}
    if isinstance(result, Graph):
        return out | {"kind": result.kind, "labels": list(result.labels), "edges": result.oriented_edges()}
    if isinstance(result, TemporalGraph):
        return out | {"kind": "temporal", "labels": list(result.labels), "links": result.links()}
    return out | {"result": result if isinstance(result, list) else {str(k): v.links() for k, v in result.items()}}


#: Options that a method passes on to its test, score or input.
PASSED = {"missing", "seed", "penalty_discount", "ebic_gamma", "equivalent_sample_size"}


def schema(name: str | None = None) -> dict:
    """The options of a method, or of all, with their defaults, as JSON."""
    if name is not None and name not in METHODS:
        raise ValueError(f"no method {name}")

    def one(f):
        options = {k: p for k, p in inspect.signature(f).parameters.items() if k not in ("df", "test") and p.kind is not p.VAR_KEYWORD}
        plain = lambda v: v if isinstance(v, (str, int, float, bool, list, type(None))) else list(v) if isinstance(v, tuple) else str(v)
        return {"options": {k: {"required": p.default is p.empty} | ({} if p.default is p.empty else {"default": plain(p.default)}) for k, p in options.items()}}

    return {n: one(f) for n, f in sorted(METHODS.items()) if name in (None, n)}


def resolve_options(method: str, config: dict, given: dict) -> dict:
    """The given options over those of a file; unknown ones are refused by name."""
    options = {**config, **given}
    if unknown := set(options) - set(inspect.signature(METHODS[method]).parameters) - PASSED:
        raise ValueError(f"{method} has no option {', '.join(sorted(unknown))}")
    return options


def _split(args: list[str], flags: tuple[str, ...]) -> tuple[list[str], dict, dict]:
    """(plain arguments, key=value options, flags)."""
    plain, options, found = [], {}, {}
    rest = iter(args)
    for a in rest:
        if a in flags:
            found[a] = next(rest, None)
            if found[a] is None:
                raise ValueError(f"{a} needs a value")
        elif a.startswith("--"):
            found[a] = True
        elif "=" in a and len(plain) >= 2:
            k, _, v = a.partition("=")
            options[k] = _value(v)
        else:
            plain.append(a)
    return plain, options, found


def _table(spark, path: str):
    paths = path.split(",")
    return read_table(spark, path) if len(paths) == 1 else read_panel(spark, paths)


def cmd_run(args: list[str]) -> int:
    plain, given, flags = _split(args, ("--out", "--graph", "--config", "--limit"))
    if len(plain) != 2 or plain[0] not in METHODS:
        raise ValueError(f"run METHOD TABLE; methods: {', '.join(sorted(METHODS))}")
    method, path = plain
    options = resolve_options(method, load_config(flags["--config"]) if "--config" in flags else {}, given)
    spark = SparkSession.builder.getOrCreate()
    df = _table(spark, path)
    warn_past_boundary(method, len(df.columns))
    result = METHODS[method](df, **options)
    if isinstance(result, Graph) and flags.get("--graph") in ("dot", "svg"):
        print(getattr(result, flags["--graph"])())
    else:
        print(json.dumps(truncated(envelope(method, options, result), int(flags.get("--limit", 100_000)))[0]))
    if "--out" in flags and isinstance(result, Graph):
        save_graph(spark, result, flags["--out"])
    return 0


def cmd_bootstrap(args: list[str]) -> int:
    plain, given, _ = _split(args, ())
    if len(plain) != 2 or plain[0] not in METHODS:
        raise ValueError(f"bootstrap METHOD TABLE; methods: {', '.join(sorted(METHODS))}")
    method, path = plain
    own = {k: given.pop(k) for k in ("n_resamples", "resampling", "sample_fraction", "threshold", "unit") if k in given}
    options = resolve_options(method, {}, given)
    seed = resolve_seed(None, own.pop("seed", None) or options.get("seed"))
    spark = SparkSession.builder.getOrCreate()
    threshold, more = own.pop("threshold", 0.5), {"fraction": own.pop("sample_fraction", 0.5), "seed": seed, **own}
    out = resample.bootstrap_rows(_table(spark, path), lambda df: METHODS[method](df, **options), **more)
    print(json.dumps({"method": method, "n_resamples": len(out.fits), "edges": out.table(), "average": out.average(threshold).oriented_edges()}))
    return 0


def cmd_markov_check(args: list[str]) -> int:
    plain, given, _ = _split(args, ())
    if len(plain) != 2:
        raise ValueError("markov-check GRAPH TABLE")
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(resample.markov_check(_table(spark, plain[1]), load_graph(spark, plain[0]), **given)))
    return 0


def cmd_list(args: list[str]) -> int:
    docs = {n: (inspect.getdoc(f) or "").split("\n")[0] for n, f in sorted(METHODS.items())}
    print(json.dumps(docs) if "--json" in args else "\n".join(f"{n:24} {d}" for n, d in docs.items()))
    return 0


def cmd_schema(args: list[str]) -> int:
    print(json.dumps(schema(args[0] if args else None)))
    return 0


def cmd_config(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    names = ("spark.master", "spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "tessera.seed")
    print(json.dumps({n: spark.conf.get(n, None) for n in names} | {"methods": len(METHODS), "seed": resolve_seed(spark)}))
    return 0


def cmd_calibrate(args: list[str]) -> int:
    """The seconds of an empty job and of summing a million numbers, on Spark and here: what select_engine's bound rests on."""
    import time

    import numpy as np

    spark = SparkSession.builder.getOrCreate()
    took = {}
    for name, f in {"empty_job": lambda: spark.range(1).count(), "spark_sum": lambda: spark.range(1_000_000).selectExpr("sum(id * id)").head(), "numpy_sum": lambda: (np.arange(1e6) ** 2).sum()}.items():
        f()
        start = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - start, 6)
    print(json.dumps(took | {"cells": max(1, int(1e6 * took["empty_job"] / max(took["numpy_sum"], 1e-9)))}))
    return 0


COMMANDS = {"run": cmd_run, "bootstrap": cmd_bootstrap, "markov-check": cmd_markov_check, "list": cmd_list, "schema": cmd_schema, "config": cmd_config, "calibrate": cmd_calibrate}


def main(args: list[str]) -> int:
    if args and args[0] in METHODS:
        args = ["run", *args]
    if not args or args[0] not in COMMANDS:
        print(f"{__doc__}\nMethods: {', '.join(sorted(METHODS))}")
        return 2
    try:
        return COMMANDS[args[0]](args[1:])
    except (ValueError, TypeError) as e:
        print(e)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
