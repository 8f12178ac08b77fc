import itertools
import json

import pytest

from loomgraph.operators import alignment as A
from loomgraph.operators.pairs import candidates as candidate_pairs
from loomgraph.operators.pairs import expand, reconnect, similarities
from loomgraph.plans.build import build
from loomgraph.plans.options import NetworkOptions, PlanError
from loomgraph.plans.registry import Plugin, default
from loomgraph.sources import network, report, runfiles, structures


def sdf(name, n, branch=None, shift=0.0):
    pts = [(i * 1.2 + shift, (i % 2) * 0.7 + shift, shift) for i in range(n)]
    bonds = [(i, i + 1) for i in range(n - 1)]
    if branch is not None:
        pts.append((branch * 1.2 + shift, 2.0 + shift, 0.9 + shift))
        bonds.append((branch, n))
    atoms = "".join(f"{x:10.4f}{y:10.4f}{z:10.4f} C   0  0\n" for x, y, z in pts)
    return f"{name}\n\n\n{len(pts):3d}{len(bonds):3d}  0  0  0  0            999 V2000\n{atoms}" + "".join(f"{a + 1:3d}{b + 1:3d}  1  0\n" for a, b in bonds) + "M  END\n$$$$\n"


@pytest.fixture(scope="module")
def chains(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mols")
    (path / "x.sdf").write_text(sdf("c10", 10) + sdf("c11", 11) + sdf("c12", 12) + sdf("b10", 10, 9))
    return A.with_fingerprints(structures.read_structures(spark, str(path))).cache()


def test_build_end_to_end(spark, chains, tmp_path):
    net = build(chains)
    got = net.selected.collect()
    assert {n for r in got for n in (r.u, r.v)} == {"c10", "c11", "c12", "b10"} and all(r.total >= 0 for r in got)
    d = net.candidates.where("feasible").first().descriptors
    assert d["mcs_fraction"] > 0.5 and d["n_softcore_max_heavy"] >= 1
    options = NetworkOptions(banned_edges=("c10~c11",), n_edges=5)
    network.save(str(tmp_path / "net"), options, vertices=net.vertices, candidates=net.candidates, selected=net.selected, unmet=net.unmet)
    tables, back = network.load(spark, str(tmp_path / "net"))
    assert back == options and tables["selected"].count() == len(got)
    with pytest.raises(PlanError):
        build(chains, planner="nothing")
    page = report.html_report(net.vertices, net.selected, net.candidates, net.unmet, net.selected.groupBy("campaign").count(), "default")
    assert page.count("<circle") == 4 and "Rejected (0 of 0)" in page
    all_cbfe = build(chains, NetworkOptions(cbfe_mode="all")).selected.collect()
    assert {r.kind for r in all_cbfe} == {"cbfe"}


def test_runfiles(spark, chains, tmp_path):
    net = build(chains)
    names = {r.name: [a.name for a in r.atoms] for r in chains.collect()}
    rows = [("c", r.source, r.target, "rbfe", r.cc1, r.cc2, r.sc1, r.sc2, names[r.source], names[r.target], len(names[r.source]), len(names[r.target]), r.method, False) for r in net.candidates.where("feasible").collect()]
    schema = "campaign string, source string, target string, kind string, cc1 array<int>, cc2 array<int>, sc1 array<int>, sc2 array<int>, names_1 array<string>, names_2 array<string>, n_atoms_1 int, n_atoms_2 int, method string, repaired boolean"
    edges = spark.createDataFrame(rows, schema)
    assert runfiles.problems(edges) == []
    runfiles.write_runfiles(edges, str(tmp_path))
    lines = (tmp_path / "c" / "edges.txt").read_text().split()
    assert len(lines) == len(rows)
    one = runfiles.read_runfile(str(tmp_path / "c" / f"atommap_{lines[0]}.runconfig"))
    assert one["timask1"] == ":SRC" and one["timask2"] == ":DST" and one["atommapindices"]
    assert set(json.loads((tmp_path / "c" / "atommaps.runconfig").read_text())) == set(lines)
    bad = spark.createDataFrame([rows[0][:4] + ([], [], *rows[0][6:])], schema)
    assert runfiles.problems(bad) and "empty core" in runfiles.problems(bad)[0]


def test_alignment(spark, chains, tmp_path):
    (tmp_path / "y.sdf").write_text(sdf("c10", 10, 2) + sdf("far", 10, 2, shift=40.0))
    v = structures.read_structures(spark, str(tmp_path))
    v = A.with_fingerprints(v).cache()
    sims = similarities(expand(v), v).selectExpr("campaign", "least(source, target) AS u", "greatest(source, target) AS v", "sim")
    got = A.align(v, sims, reference="c10").cache()
    far = got.where("name = 'far'").first()
    assert far.ok and far.rmsd < 1e-6 and far.parent == "c10"
    assert A.median_rmsd(got).first().median_rmsd < 1e-6
    x = A.moved(v, got).where("name = 'far'").first().atoms[0].x
    assert abs(x) < 1e-3
    order = A.order(["a", "b", "c"], {("a", "b"): 0.2, ("a", "c"): 0.9, ("b", "c"): 0.8}, "a")
    assert order == [("c", "a"), ("b", "c")]
    assert A.reference_of(["x", "y"], [5, 5]) == "x"
    with pytest.raises(ValueError):
        A.reference_of(["x"], [1], "z")


def test_candidate_pairs_with_prefilter(spark):
    v = spark.createDataFrame([("c", f"n{i}", i, [i // 3 * 10 + k for k in range(4)] + [100 + i]) for i in range(9)], "campaign string, name string, ord long, fp array<int>")
    p = candidate_pairs(v, NetworkOptions(prefilter="fingerprint", prefilter_k=1, prefilter_min_tanimoto=0.5)).collect()
    assert sum(r.restored for r in p) == 2  # three groups, joined again by two pairs
    sims = similarities(expand(v), v)
    kept = sims.where("sim > 0.5")
    assert reconnect(kept, sims, v).count() == 2
    assert len({(r.source, r.target) for r in p}) == len(p)


def test_registry():
    r = default()
    assert {p.name for p in r.list("planner")} == {"mst", "redundant-mst", "star", "explicit", "complete", "optimal"}
    assert callable(r.create("scorer", "linear"))
    with pytest.raises(ValueError, match="already"):
        r.register(Plugin("scorer", "linear", "x:y"))
    with pytest.raises(LookupError, match="needs"):
        r.register(Plugin("mapper", "none", "x:y", ("no_such_module",))) or r.create("mapper", "none")
    r.switch("scorer", "linear", False)
    with pytest.raises(LookupError):
        r.create("scorer", "linear")


def test_command_line(capsys):
    from loomgraph.__main__ import main

    assert main(["plugins"]) == 0 and "planner mst available" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_scores_are_expressions(spark):
    from pyspark.sql import functions as F

    from loomgraph.functions import scoring

    d = {"n_softcore_max_heavy": F.lit(4.0), "charge_delta": F.lit(1.0), "mcs_fraction": F.lit(0.75), "n_heavy_1": F.lit(16.0)}
    row = spark.range(1).select(scoring.linear(d).alias("a"), scoring.variance(d).alias("b"), scoring.lomaplike(d).alias("c"), F.aggregate(F.array(*scoring.lomaplike_contributions(d).values()), F.lit(0.0), lambda x, y: x + y).alias("s"), scoring.score(d, F.array(F.lit("x"))).alias("r")).first()
    assert row.a == pytest.approx(0.5 + 4.0 + 0.5) and row.b == pytest.approx(1 + 2 + 2) and row.c == pytest.approx(row.s)
    assert row.r.total is None and not row.r.feasible
    with pytest.raises(ValueError, match="unknown"):
        scoring.linear(d, {"nope": 1})
    with pytest.raises(ValueError, match="negative"):
        scoring.variance(d, {"intercept": -1})
    assert len(list(itertools.chain(scoring.LINEAR_TERMS))) == 11


def test_wiring_of_options(spark, chains, tmp_path, monkeypatch):
    from loomgraph.plans import build as B
    from loomgraph.plans.options import AlignmentOptions, IntermediateOptions, MappingOptions

    plain = build(chains)
    for mode in ("component", "graph"):
        net = build(chains, NetworkOptions(consistency=mode))
        cores = {}
        for r in net.selected.join(net.candidates.select("source", "target", "cc1", "cc2"), ["source", "target"]).collect():
            for name, core in ((r.source, r.cc1), (r.target, r.cc2)):
                cores.setdefault(name, set()).add(frozenset(core))
        assert all(len(x) == 1 for x in cores.values()) and len(cores) == 4
    few = build(chains, NetworkOptions(pair_evaluation="adaptive", adaptive_initial_neighbors=1, adaptive_batch_size=1))
    assert few.candidates.count() <= plain.candidates.count() and few.unmet.count() == plain.unmet.count()
    shares = build(chains, NetworkOptions(design_total_ns=100.0, design_lambda_min=4, design_lambda_max=8)).allocation.collect()
    assert sum(r.effort for r in shares) == pytest.approx(100) and {r.windows for r in shares} <= set(range(4, 9))
    with pytest.raises(PlanError, match="generate"):
        build(chains, NetworkOptions(intermediates=IntermediateOptions(mode="gaps")))
    with pytest.raises(ValueError, match="chiral"):
        MappingOptions(match_chiral_tag=True)
    (tmp_path / "y.sdf").write_text(sdf("c10", 10, 2) + sdf("far", 10, 2, shift=40.0) + sdf("c11", 11, 2))
    v = A.with_fingerprints(structures.read_structures(spark, str(tmp_path))).cache()
    assert build(v, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0, require_connected=False)).candidates.where("feasible").count() < 3
    moved = build(v, NetworkOptions(edges_per_ligand=1, min_cycle_coverage=0), alignment=AlignmentOptions("tree"))
    assert moved.candidates.where("feasible").count() == 3


def test_gaps_are_bridged_by_invented_vertices(spark, tmp_path):
    from loomgraph.plans.options import IntermediateOptions, SoftcorePolicy

    (tmp_path / "z.sdf").write_text(sdf("c08", 8) + sdf("c14", 14))
    v = A.with_fingerprints(structures.read_structures(spark, str(tmp_path))).cache()
    tight = {"softcore": SoftcorePolicy(max_softcore_atoms=4), "edges_per_ligand": 1, "min_cycle_coverage": 0}
    with pytest.raises(Exception, match="components"):
        build(v, NetworkOptions(**tight)).selected.collect()

    def generate(a, b):
        _, atoms, bonds = structures.parse_v2000(sdf("x", 11))
        return [("int_1", "C11", {"atoms": atoms, "bonds": bonds})]

    net = build(v, NetworkOptions(**tight, intermediates=IntermediateOptions(mode="bridge")), generate=generate)
    assert {(r.u, r.v) for r in net.selected.collect()} == {("c08", "int_1"), ("c14", "int_1")}
    assert [r.accepted for r in net.attempts.collect()] == [True] and net.vertices.where("synthetic").count() == 1
    refused = build(v, NetworkOptions(**tight, require_connected=False, intermediates=IntermediateOptions(mode="gaps")), generate=lambda a, b: "too far apart")
    assert [r.reason for r in refused.attempts.collect()] == ["too far apart"] and refused.selected.count() == 0


def test_command_line_over_structures(spark, chains, tmp_path, capsys):
    from loomgraph.__main__ import main, weights_of

    source, out = tmp_path / "in", str(tmp_path / "net")
    source.mkdir()
    (source / "x.sdf").write_text(sdf("c10", 10) + sdf("c11", 11) + sdf("c12", 12) + sdf("b10", 10, 9))
    assert main(["plan", str(source), "-o", out, "--format", "json"]) == 0
    edges = json.loads(capsys.readouterr().out.splitlines()[0])
    assert len(edges) >= 4 and set(edges[0]) == {"source", "target", "kind", "total"}
    assert main(["inspect", out, "--format", "csv"]) == 0 and capsys.readouterr().out.startswith("rank,source,target")
    assert main(["diagnose", out, "--format", "json", "--trials", "5"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["n_edges"] == len(edges)
    values = tmp_path / "lmi.json"
    values.write_text(json.dumps({f"{e['source']}~{e['target']}": float(i) for i, e in enumerate(edges)}))
    assert main(["replan", out, str(values), "--quantile", "0.5", "--format", "json"]) == 0
    worst = edges[-1]
    again = json.loads(capsys.readouterr().out)
    assert {worst["source"], worst["target"]} not in [{e["source"], e["target"]} for e in again]
    for form in ("json", "graphml", "sdf"):
        assert main(["export", out, str(tmp_path / form), "--as", form]) == 0
    assert spark.read.text(str(tmp_path / "graphml")).first().value.count("<node") == 4
    assert weights_of("a=1,b=2.5") == {"a": 1.0, "b": 2.5} and weights_of(None) is None
