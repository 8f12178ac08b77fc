"""Command line: ``python -m loomgraph plan|map|score|report|export|replan|diagnose|inspect|plugins|query``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.options import AlignmentOptions, NetworkOptions, PlanError

SHOWN = ["source", "target", "feasible", "total", "rejections", "n_sc_1", "n_sc_2", "complete"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--format", choices=("table", "csv", "json"), default="table")
        return c

    for name, about in (("plan", "plan a network"), ("map", "map and judge all pairs"), ("score", "score all pairs"), ("report", "plan and write an HTML report")):
        c = command(name, about)
        c.add_argument("structures", help="folder, file or glob of .sdf, .mol and .mol2 files")
        c.add_argument("--planner", default="mst")
        c.add_argument("--scorer", default="linear")
        c.add_argument("--mapper", default="mcss-e2")
        c.add_argument("--weights", default=None, help="K=V,K=V or a JSON file of scorer weights")
        c.add_argument("--align", choices=("off", "tree", "star"), default="off")
        c.add_argument("--options", default="{}", help="JSON of network options")
        c.add_argument("--compat", default=None)
        c.add_argument("-o", "--output", default=None, help="folder of the planned tables")
    c = command("export", "write a saved network in another form")
    c.add_argument("network", help="folder of a saved network")
    c.add_argument("path")
    c.add_argument("--as", dest="form", choices=("json", "edgelist", "graphml", "sdf"), default="json")
    c = command("replan", "plan a saved network again without its worst edges")
    c.add_argument("network")
    c.add_argument("diagnostics", help="JSON file of values by edge")
    c.add_argument("--quantile", type=float, default=0.9)
    c.add_argument("--cut", type=float, default=None)
    c.add_argument("--max-pruned", type=int, default=None)
    c.add_argument("--partial", action="store_true", help="edges may lack a value")
    c.add_argument("--planner", default="mst")
    c.add_argument("-o", "--output", default=None)
    c = command("diagnose", "what a saved network is worth")
    c.add_argument("network")
    c.add_argument("--rate", type=float, default=0.05)
    c.add_argument("--trials", type=int, default=100)
    c.add_argument("--seed", type=int, default=20260824)
    c = command("inspect", "the candidates of a saved network, the best first")
    c.add_argument("network")
    c.add_argument("--most", type=int, default=50)
    c = command("query", "run a registered query over a folder of tables")
    c.add_argument("name")
    c.add_argument("tables")
    command("plugins", "what can be plugged in")
    return p


def weights_of(text: str | None) -> dict[str, float] | None:
    """Scorer weights from K=V,K=V or a JSON file."""
    if not text:
        return None
    if "=" in text:
        return {k.strip(): float(v) for k, v in (x.split("=", 1) for x in text.split(",") if x.strip())}
    with open(text) as f:
        return {k: float(v) for k, v in json.load(f).items()}


def show(df: DataFrame, form: str, most: int = 1000) -> None:
    """The first rows of a result, in the order in which they come."""
    if form == "table":
        df.show(most, truncate=False)
        return
    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    if form == "json":
        print(json.dumps(rows, default=str))
        return
    import csv

    out = csv.writer(sys.stdout)
    out.writerow(df.columns)
    out.writerows([json.dumps(x) if isinstance(x, (list, dict)) else x for x in r.values()] for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (PlanError, ValueError, LookupError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace) -> int:
    if args.command == "plugins":
        from loomgraph.plans.registry import default

        for x in default().list():
            print(x.kind, x.name, "available" if not x.missing else f"needs {', '.join(x.missing)}")
        return 0
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if args.command == "query":
        from loomgraph.queries import QUERIES

        if args.name not in QUERIES:
            raise LookupError(f"no query {args.name!r}")
        show(QUERIES[args.name](spark, args.tables), args.format, 50)
        return 0
    return saved(spark, args) if hasattr(args, "network") else fresh(spark, args)


def saved(spark: SparkSession, args: argparse.Namespace) -> int:
    """Commands over a network on disk."""
    from loomgraph.operators import diagnostics, replan
    from loomgraph.operators.pairs import KEY
    from loomgraph.plans.planners import listing
    from loomgraph.sources import network, structures, writers

    tables, options = network.load(spark, args.network)
    vertices, candidates, selected, unmet = (tables[x] for x in network.TABLES)
    if args.command == "export":
        if args.form == "edgelist":
            writers.write_edge_list(selected, args.path)
        else:
            documents = {"json": lambda: writers.network_json(vertices, candidates, selected, unmet), "graphml": lambda: writers.graphml(vertices, selected), "sdf": lambda: structures.sdf_records(vertices).drop("name")}[args.form]()
            documents.write.mode("error").partitionBy(KEY).text(args.path)
    elif args.command == "replan":
        with open(args.diagnostics) as f:
            values = replan.read_lmi(spark, f.read())
        high = replan.high_edges(selected, values, options, args.quantile, args.cut, args.max_pruned, not args.partial)
        p = replan.replan(vertices, candidates, selected, high, options, args.planner).settled()
        show(p.selected.select("source", "target", "kind", "total").orderBy("source", "target"), args.format)
        if args.output:
            network.save(args.output, options, vertices=vertices, candidates=candidates, selected=p.selected, unmet=p.unmet)
    elif args.command == "diagnose":
        sturdy = diagnostics.failure_robustness(vertices, selected, args.rate, args.trials, args.seed)
        show(diagnostics.summarize(vertices, selected).join(sturdy, KEY, "left"), args.format)
    else:
        rows = listing(candidates, args.most)
        show(rows.select("rank", *[c for c in SHOWN if c in rows.columns]).orderBy("rank"), args.format)
    return 0


def fresh(spark: SparkSession, args: argparse.Namespace) -> int:
    """Commands over structures."""
    from loomgraph.operators.alignment import with_fingerprints
    from loomgraph.operators.diagnostics import summarize
    from loomgraph.plans.build import build
    from loomgraph.sources import network, report, structures

    given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(args.options).items()}
    options = NetworkOptions.preset(args.compat, **given) if args.compat else NetworkOptions(**given)
    vertices = with_fingerprints(structures.read_structures(spark, args.structures))
    net = build(vertices, options, args.mapper, args.scorer, args.planner, weights=weights_of(args.weights), alignment=AlignmentOptions(args.align))
    if args.output:
        network.save(args.output, options, vertices=net.vertices, candidates=net.candidates, selected=net.selected, unmet=net.unmet)
    if args.command in ("map", "score"):
        columns = SHOWN if args.command == "map" else ["source", "target", "feasible", "total", "descriptors"]
        show(net.candidates.select(*columns).orderBy("source", "target"), args.format)
        return 0
    if args.command == "report":
        print(report.html_report(net.vertices, net.selected, net.candidates, net.unmet, summarize(net.vertices, net.selected), "default"))
        return 0
    show(net.selected.select("source", "target", "kind", "total").orderBy("source", "target"), args.format)
    for r in net.unmet.collect():
        print("unmet:", r.message)
    return 0


if __name__ == "__main__":
    sys.exit(main())
