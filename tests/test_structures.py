import itertools

import numpy as np
import pytest

from loomgraph.operators import intermediates as I
from loomgraph.operators import mapping as M
from loomgraph.operators.molecule import Molecule, bits, connect, mask_of
from loomgraph.plans.options import CorePruning, MappingOptions, SoftcorePolicy


def chain(n, extra=(), elements=None):
    """A zigzag chain of carbons with more bonds."""
    pts = np.array([[i * 1.2, (i % 2) * 0.7, 0.0] for i in range(n)])
    return Molecule(tuple(elements or [6] * n), (*((i, i + 1) for i in range(n - 1)), *extra), pts, (0,) * n, (False,) * n)


def test_rings_of_fused_and_bridged_systems():
    naphthalene = chain(10, extra=((0, 9), (4, 9)))
    assert sorted(r.bit_count() for r in naphthalene.rings) == [6, 6]
    cubane = Molecule((6,) * 8, tuple((a, b) for a, b in itertools.combinations(range(8), 2) if (a ^ b).bit_count() == 1), np.zeros((8, 3)))
    assert sorted(r.bit_count() for r in cubane.rings) == [4] * 5  # edges - vertices + 1
    assert chain(5).rings == ()


def test_pieces_stranded_branches():
    m = chain(7)
    assert [sorted(bits(p)) for p in m.pieces(mask_of([0, 1, 3, 5, 6]))] == [[0, 1], [5, 6], [3]]
    assert sorted(bits(m.stranded(1 << 2))) == [0, 1]
    ring = chain(7, extra=((0, 5),))
    assert set(ring.branches(5)) == {6} and ring.branches(0) == {}


@pytest.mark.parametrize("seed", range(8))
def test_connecting_two_parts_is_exact(seed):
    r = np.random.default_rng(seed)
    bonds = tuple((a, b) for a, b in itertools.combinations(range(8), 2) if r.random() < 0.35)
    m = Molecule((6,) * 8, bonds, np.zeros((8, 3)))
    if len(m.pieces(255)) > 1:
        return
    price = r.integers(1, 9, 8).astype(float)
    got, heuristic = connect(m, [1, 1 << 7], lambda a: price[a])
    best = min(sum(price[a] for a in c) for k in range(7) for c in itertools.combinations(range(1, 7), k) if m.spread(1, mask_of(c) | 1 | 1 << 7) >> 7 & 1)
    assert sum(price[a] for a in bits(got)) == best and not heuristic


def test_connecting_more_parts_spans():
    m = chain(9)
    got, heuristic = connect(m, [1, 1 << 4, 1 << 8], lambda a: 1.0)
    assert heuristic and len(m.pieces(got | 1 | 1 << 4 | 1 << 8)) == 1
    with pytest.raises(ValueError, match="pieces"):
        connect(Molecule((6, 6), (), np.zeros((2, 3))), [1, 2], lambda a: 1.0)


def test_repair_joins_regions_and_keeps_partners():
    p = q = chain(12)
    core = {i: i for i in range(12) if i not in (0, 3)}
    r = M.repair(p, q, core, SoftcorePolicy())
    assert r.rejection is None and r.fragments_before == (2, 2) and r.fragments_after == (1, 1)
    assert set(r.core) == set(range(4, 12)) and r.demoted_1 == [1, 2]


def test_repair_takes_whole_rings_and_rejects_by_budget():
    ring = chain(10, extra=((4, 9),))
    core = {i: i for i in range(10) if i != 9}
    r = M.repair(ring, ring, core, SoftcorePolicy())
    assert r.rejection is None and sorted(set(range(10)) - set(r.core)) == [4, 5, 6, 7, 8, 9]
    tight = M.repair(ring, ring, core, SoftcorePolicy(max_softcore_atoms=3))
    assert tight.rejection == "softcore_too_large" and tight.core == core
    assert M.repair(ring, ring, core, SoftcorePolicy(min_core_atoms=6)).rejection == "core_too_small"


def test_attachment_by_one_bond():
    square = chain(8, extra=((0, 7),))
    r = M.repair(square, square, {i: i for i in range(8) if i != 3}, SoftcorePolicy(ring_policy="none"))
    assert r.rejection == "softcore_multiple_attachments"


def test_prune_takes_branches_of_a_light_swap():
    p = chain(5, elements=[6, 6, 6, 6, 1])
    q = chain(5)
    assert M.prune(p, q, {i: i for i in range(5)}, CorePruning()) == {0: 0, 1: 1, 2: 2, 3: 3}
    assert M.prune(q, chain(5, elements=[6, 7, 6, 6, 6]), {i: i for i in range(5)}, CorePruning.preset("mcss-e2")) == {0: 0, 2: 2, 3: 3, 4: 4}


def test_common_core_and_hydrogens():
    long, short = chain(6), chain(4)
    core = M.common_core(long, short, MappingOptions())
    assert len(core) == 4 and core == {i: i for i in range(4)}
    ring = chain(6, extra=((0, 5),))
    assert M.common_core(ring, chain(6), MappingOptions()) == {}
    methane = Molecule((6, 1, 1), ((0, 1), (0, 2)), np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0.0]]))
    swapped = Molecule((6, 1, 1), ((0, 1), (0, 2)), np.array([[0, 0, 0], [0, 1, 0], [1, 0, 0.0]]))
    assert M.pair_hydrogens(methane, swapped, {0: 0}) == {0: 0, 1: 2, 2: 1}


@pytest.mark.parametrize("seed", range(10))
def test_assignment_by_brute_force(seed):
    r = np.random.default_rng(seed)
    cost = r.random((int(r.integers(1, 6)), int(r.integers(1, 6))))
    small, wide = (cost, False) if cost.shape[0] <= cost.shape[1] else (cost.T, True)
    best = min(sum(small[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert sum(cost[i, j] for i, j in M.assign(cost)) == pytest.approx(best) and wide in (True, False)


@pytest.mark.parametrize("seed", range(6))
def test_kabsch_undoes_a_motion(seed):
    r = np.random.default_rng(seed)
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    x = r.normal(size=(9, 3))
    y = x @ q.T + r.normal(size=3) * 40
    rot, shift = M.kabsch(x, y)
    assert np.allclose(x @ rot.T + shift, y) and np.linalg.det(rot) == pytest.approx(1)
    mirrored = x * [1, 1, -1]
    assert np.linalg.det(M.kabsch(mirrored, x)[0]) == pytest.approx(1)
    assert M.collinear(np.array([[0, 0, 0], [1, 1, 1], [2, 2, 2.0]])) and not M.collinear(x)


def test_consistency_settles():
    mols = {k: chain(10) for k in "abc"}
    mapped = [("a", "b", {i: i for i in range(9)}), ("b", "c", {i: i for i in range(8)})]
    out = M.make_consistent(mapped, mols, SoftcorePolicy())
    assert {frozenset(r.core) for _, _, r in out} == {frozenset(range(8))}


def test_bridging_states():
    positions = [I.Position(6, 1), I.Position(1, 5), I.Position(3, 3, True)]
    path = I.propose(positions)
    assert 1 <= len(path) <= 2 and all(len(s) == 3 for s in path)
    many = [I.Position(i + 1, 1, True) for i in range(9)]
    assert len(I.states(many)) <= I.MAX_STATES
    assert I.propose([I.Position(60, 60)]) == []
    direct = I.cheapest_path({("a", "b"): 0.1, ("a", "c"): 1.0, ("c", "b"): 1.0}, "a", "b", 3)
    assert direct == ["a", "c", "b"]


def test_read_and_evaluate(spark, tmp_path):
    from loomgraph.operators.pairs import expand
    from loomgraph.sources.structures import read_smiles, read_structures

    def block(name, n, charge=0):
        atoms = "".join(f"{i * 1.2:10.4f}{(i % 2) * 0.7:10.4f}{0:10.4f} C   0  0\n" for i in range(n))
        bonds = "".join(f"{i + 1:3d}{i + 2:3d}  1  0\n" for i in range(n - 1))
        return f"{name}\n\n\n{n:3d}{n - 1:3d}  0  0  0  0            999 V2000\n{atoms}{bonds}" + (f"M  CHG  1   1{charge:4d}\n" if charge else "") + "M  END\n$$$$\n"

    (tmp_path / "x.sdf").write_text(block("one", 9) + block("two (b)", 10) + "broken\n$$$$\n" + block("", 8, -1))
    v = read_structures(spark, str(tmp_path)).cache()
    assert {(r.name, r.n_heavy, r.charge) for r in v.collect()} == {("one", 9, 0), ("two_b", 10, 0), ("x_3", 8, -1)}
    got = M.evaluate(expand(v), v).collect()
    by_pair = {(r.source, r.target): r for r in got}
    assert by_pair["one", "two_b"].reason is None and len(by_pair["one", "two_b"].cc1) == 8
    # the charged end can't be shared, so both ends change and all between them
    assert by_pair["one", "x_3"].reason == "no_common_core" and by_pair["one", "x_3"].cc1 == [1, 2, 3, 4, 5, 6]
    strict = M.evaluate(expand(v), v, policy=SoftcorePolicy(charge_change_policy="reject")).where("reason = 'net_charge_change'").count()
    assert strict == 2
    (tmp_path / "s.smi").write_text("# list\nCCO ethanol\n\nc1ccccc1 ben zene\n")
    assert [r.name for r in read_smiles(spark, str(tmp_path / "s.smi")).orderBy("ord").collect()] == ["ethanol", "ben"]
    cores = M.cores_by_vertex(spark.createDataFrame([("c", "a", "b", [0, 1, 2], [5, 6, 7]), ("c", "b", "d", [6, 7], [0, 1])], "campaign string, source string, target string, cc1 array<int>, cc2 array<int>"))
    assert sorted((r.name, r.atom) for r in cores.where("name = 'b'").collect()) == [("b", 6), ("b", 7)]


def test_edge_lists_and_writers(spark):
    from loomgraph.sources import writers
    from loomgraph.sources.edges import parse_edge_lines

    def lines(*xs):
        return spark.createDataFrame([("c", x) for x in xs], "campaign string, value string")

    got = parse_edge_lines(lines("# c", "ab12: A >>> B", "B >>> A", "A >>> C # x")).orderBy("line").collect()
    assert [(r.a, r.b) for r in got] == [("A", "B"), ("A", "C")]
    with pytest.raises(Exception, match="not an edge line"):
        parse_edge_lines(lines("A >> B")).collect()
    assert parse_edge_lines(lines("A >> B"), ">>").count() == 1
    v = spark.createDataFrame([("c", "A", 0, 0, 5), ("c", "B", 1, 1, 6)], "campaign string, name string, ord long, charge long, n_heavy long")
    e = spark.createDataFrame([("c", "A", "B", "A", "B", "rbfe", 1.25, 2, 3)], "campaign string, source string, target string, u string, v string, kind string, total double, n_sc_1 int, n_sc_2 int")
    assert writers.edge_list_lines(e).first().value == "A B 1.250000 2 3 rbfe"
    xml = writers.graphml(v, e).first().value
    assert xml.count("<node") == 2 and '<edge source="A" target="B"><data key="total">1.25' in xml
    doc = writers.network_json(v, e.withColumn("cand_ord", e.n_sc_1), e, spark.createDataFrame([("c", 0, "m")], "campaign string, seq int, message string")).first().value
    assert '"schema_version":1' in doc and '"message":"m"' in doc
    named = spark.createDataFrame([(["a", "b"], ["x", "c"], ["a"], ["q"])], "core_names_1 array<string>, soft_names_1 array<string>, core_names_2 array<string>, soft_names_2 array<string>")
    assert writers.masks(named).first().source_mask == ":SRC&@c,x"


def test_records_round_trip(spark, tmp_path):
    from loomgraph.sources.structures import parse_v2000, read_structures, sdf_records

    atoms = [(0, 6, "C1", 0.0, 1.5, -2.25, 0, False), (1, 8, "O2", 1.0, 0.0, 0.5, -1, False), (2, 17, "CL3", 3.0, 0.0, 0.0, 0, False)]
    bonds = [(0, 1, 1.0, False), (0, 2, 1.0, False)]
    v = spark.createDataFrame([("c", "m", atoms, bonds)], "campaign string, name string, atoms array<struct<idx: int, elem: int, name: string, x: double, y: double, z: double, charge: int, aromatic: boolean>>, bonds array<struct<a: int, b: int, order: double, in_ring: boolean>>")
    text = sdf_records(v).first().value
    name, got, ties = parse_v2000(text)
    assert name == "m" and [(a["elem"], a["charge"], a["x"]) for a in got] == [(6, 0, 0.0), (8, -1, 1.0), (17, 0, 3.0)] and len(ties) == 2
    (tmp_path / "m.sdf").write_text(text)
    assert read_structures(spark, str(tmp_path)).first().charge == -1


def test_augmenting_gaps():
    from loomgraph.plans.options import IntermediateOptions

    def generate(a, b):
        return "too far apart" if a == "x" else [(f"int_{a}_{b}", "same" if b in ("b", "c") else b, None)]

    def evaluate(new, pairs):
        return {p: 1.0 for p in pairs if "d" not in p}

    vertices, edges, attempts = I.augment([("a", "b"), ("a", "c"), ("x", "y"), ("a", "d")], generate, evaluate, lambda a, b: False, IntermediateOptions(mode="gaps"))
    assert [v[0] for v in vertices] == ["int_a_b"]  # the second gap asks for the same structure
    assert [x.accepted for x in attempts] == [True, True, False, False] and attempts[2].reason == "too far apart"
    assert ("a", "int_a_b") in edges and ("c", "int_a_b") in edges and ("a", "d") not in edges
    assert I.augment([("a", "b")], generate, evaluate, lambda a, b: True, IntermediateOptions(mode="bridge")) == ([], {}, [])
    capped = I.augment([("a", "b"), ("a", "e")], generate, evaluate, lambda a, b: False, IntermediateOptions(mode="gaps", max_intermediates=1))
    assert [x.accepted for x in capped[2]] == [True, False]


def test_cache_evaluates_only_what_is_new(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.adaptive import with_cache

    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "source string, target string")
    seen = []

    def evaluate(df):
        seen.append(df.count())
        return df.withColumn("total", F.lit(1.0))

    first = with_cache(pairs.limit(1), None, ["source", "target"], evaluate)
    both = with_cache(pairs, first, ["source", "target"], evaluate)
    assert both.count() == 2 and seen == [1, 1]


def test_cores_are_chosen_among_all_embeddings():
    # a ring with a tail: the ring fits on itself in twelve ways
    pts = np.array([[np.cos(k * np.pi / 3), np.sin(k * np.pi / 3), 0.0] for k in range(6)])
    ring = Molecule((6,) * 6, tuple((k, (k + 1) % 6) for k in range(6)), pts)
    turned = Molecule((6,) * 6, ring.bonds, np.roll(pts, 2, axis=0))
    found = M.common_cores(ring, turned, MappingOptions())
    assert found.complete and len(found.found) == 12
    assert M.common_core(ring, turned, MappingOptions()) == {k: (k + 2) % 6 for k in range(6)}
    assert not M.common_cores(ring, turned, MappingOptions(max_matches=3)).complete
    assert not M.common_cores(ring, turned, MappingOptions(max_steps=5)).complete
    # equally large cores: the one that leaves one changed region, though the other is nearer
    long, two = chain(5), [{0: 0, 1: 1, 2: 2}, {1: 0, 2: 1, 3: 2}]
    short = Molecule((6,) * 3, ((0, 1), (1, 2)), long.points[1:4])
    assert M.choose_core(long, short, two, "fewest_fragments") == two[0] and M.choose_core(long, short, two, "best_rmsd") == two[1] and M.choose_core(long, short, two, "first") == two[0]
    double = Molecule((6, 6), ((0, 1),), np.zeros((2, 3)), orders=(2.0,))
    single = Molecule((6, 6), ((0, 1),), np.zeros((2, 3)), orders=(1.0,))
    assert len(M.common_core(double, single, MappingOptions())) == 2 and M.common_core(double, single, MappingOptions(match_valences=True)) == {}
    row = M.map_pair(ring, turned, "mcss-e2", MappingOptions(max_steps=5), SoftcorePolicy())
    assert row["complete"] is False
