import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import zset as z
from tidemark.recursion import rdfs
from tidemark.recursion.datalog import Datalog, Rule, guarded, stratify, untag
from tidemark.recursion.fixpoint import NotConverged, Reachability, reach

E = "src long, dst long"


def graph(spark, rows):
    return spark.createDataFrame(rows, E)


def pairs(df):
    return {tuple(r) for r in df.select("src", "dst").collect()}


@pytest.mark.parametrize("hops", [True, False])
def test_reach(spark, hops):
    ring, line = graph(spark, [(0, 1), (1, 2), (2, 0)]), graph(spark, [(k, k + 1) for k in range(4)])
    found, rounds = reach(ring, hop_by_hop=hops)
    assert len(pairs(found)) == 9 and (not hops or rounds == 3)
    found, rounds = reach(line, hop_by_hop=hops)
    assert pairs(found) == {(a, b) for a in range(5) for b in range(a + 1, 5)} and (not hops or rounds == 4)
    found, rounds = reach(graph(spark, []), hop_by_hop=hops)
    assert pairs(found) == set() and rounds == 0


def test_rounds_are_limited(spark):
    with pytest.raises(NotConverged):
        reach(graph(spark, [(k, k + 1) for k in range(6)]), max_rounds=2, hop_by_hop=True)


def test_reachability_under_deletion(spark):
    w = lambda rows: z.from_rows(spark, rows, E)
    r = Reachability(w({}))
    total = [r.push(w({(0, 1): 1, (1, 2): 1})), r.push(w({(2, 3): 1, (3, 0): 2})), r.push(w({(1, 2): -1})), r.push(w({(3, 0): -1}))]
    want = {(0, 1), (2, 3), (2, 0), (2, 1), (3, 0), (3, 1)}
    assert pairs(r.pairs) == want
    assert z.to_rows(z.add(*total)) == {p: 1 for p in want}
    assert z.to_rows(total[-1]) == {}


def session(spark, rules, facts, **kw):
    d = Datalog(spark, **kw)
    d.push_rules(rules)
    d.push_facts(facts)
    return d


TC = [(("tc", ("?X", "?Y")), ("e", ("?X", "?Y"))), (("tc", ("?X", "?Z")), ("e", ("?X", "?Y")), ("tc", ("?Y", "?Z")))]


def derived(d, predicate):
    d.saturate()
    return {args for p, args in d.rows() if p == predicate}


def test_closure_and_constants(spark):
    d = session(spark, [*TC, (("two", ("?X", "mark")), ("e", ("?X", 2)))], {("e", (0, 1)): 1, ("e", (1, 2)): 2, ("e", (5, 2)): 1, ("e", (7, 7)): 0})
    assert derived(d, "tc") == {(0, 1), (1, 2), (5, 2), (0, 2)}
    assert derived(d, "two") == {(1, "mark"), (5, "mark")}


def test_nonlinear_recursion_and_given_derived_facts(spark):
    rules = [TC[0], (("tc", ("?X", "?Z")), ("tc", ("?X", "?Y")), ("tc", ("?Y", "?Z")))]
    d = session(spark, rules, {("e", (k, k + 1)): 1 for k in range(6)} | {("tc", (6, 9)): 1})
    want = {(a, b) for a in range(7) for b in range(a + 1, 7)} | {(a, 9) for a in range(7)}
    assert derived(d, "tc") == want


def test_unification_and_union(spark):
    rules = [(("p", ("?X", "?Y")), ("e", ("?X", "?Y")), ("n", ("?Y",))), (("good", ("?X",)), ("b", ("?X",))), (("good", ("?X",)), ("c", ("?X",))), (("loop", ("?X",)), ("e", ("?X", "?X")))]
    d = session(spark, rules, {("e", (0, 1)): 1, ("e", (2, 3)): 1, ("e", (4, 4)): 1, ("n", (1,)): 1, ("b", ("u",)): 1, ("c", (None,)): 1})
    d.saturate()
    assert derived(d, "p") == {(0, 1)} and derived(d, "good") == {("u",), (None,)} and derived(d, "loop") == {(4,)}


def test_negation(spark):
    d = session(spark, [(("alive", ("?X",)), ("!dead", ("?X",)), ("person", ("?X",)))], {("person", ("alice",)): 1, ("person", ("bob",)): 1, ("dead", ("bob",)): 1})
    assert derived(d, "alive") == {("alice",)}


def test_upper_cycle_needs_lower_stratum(spark):
    rules = [*TC, (("a", ("?X",)), ("node", ("?X",)), ("!tc", (0, "?X"))), (("b", ("?X",)), ("a", ("?X",))), (("a", ("?X",)), ("b", ("?X",)))]
    d = session(spark, rules, {("e", (k, k + 1)): 1 for k in range(3)} | {("node", (k,)): 1 for k in range(4)})
    assert derived(d, "a") == {(0,)} and derived(d, "b") == {(0,)}


def test_existential_negation_and_ground_atoms(spark):
    rules = [(("sink", ("?X",)), ("node", ("?X",)), ("!e", ("?X", "?Y"))), (("on", ()), ("switch", ())), (("lit", ("?X",)), ("node", ("?X",)), ("on", ())), (("quiet", ()), ("!alarm", ()), ("switch", ()))]
    d = session(spark, rules, {("node", (0,)): 1, ("node", (1,)): 1, ("e", (0, 1)): 1, ("e", (0, 0)): 1, ("switch", ()): 1})
    assert derived(d, "sink") == {(1,)} and derived(d, "lit") == {(0,), (1,)} and derived(d, "quiet") == {()}


def test_programs_are_checked(spark):
    d = Datalog(spark)
    for bad in ([(("a", ("?X",)), ("n", ("?X",)), ("!b", ("?X",))), (("b", ("?X",)), ("n", ("?X",)), ("!a", ("?X",)))], [(("a", ("?Y",)), ("n", ("?X",)))], [(("!a", ("?X",)), ("n", ("?X",)))], [(("a", ("?X",)), ("n", ("?X",)), ("n", ("?X", "?X")))]):
        with pytest.raises(ValueError):
            d.push_rules(bad)
    assert d.rules == {}
    with pytest.raises(ValueError):
        d.push_facts({("n", (1,)): 1, ("n", (1, 2)): 1})


def test_rules_and_facts_change(spark):
    d = session(spark, [(("b", ("?X",)), ("p", ("?X",)))], {("p", (1,)): 1})
    assert derived(d, "b") == {(1,)}
    d.push_rules({(("b", ("?X",)), ("p", ("?X",))): -1})
    assert derived(d, "b") == set() and derived(d, "p") == {(1,)}
    d.push_facts({("p", (1,)): -1})
    d.saturate()
    assert d.rows() == set()


def test_late_lower_fact(spark):
    d = session(spark, [(("a", ("?X",)), ("p", ("?X",))), (("c", ("?X",)), ("dom", ("?X",)), ("!a", ("?X",)))], {("dom", (1,)): 1, ("dom", (2,)): 1, ("p", (1,)): 1})
    assert derived(d, "c") == {(2,)}
    d.push_rules([(("a", ("?X",)), ("q", ("?X",)))])
    d.push_facts({("q", (2,)): 1})
    assert derived(d, "c") == set()


@pytest.mark.parametrize("order", [0, 1])
def test_one_at_a_time_equals_all_at_once(spark, order):
    facts = {("e", x): 1 for x in [(0, 1), (1, 2), (2, 0), (2, 3)]} | {("node", (k,)): 1 for k in range(4)}
    rules = [*TC, (("far", ("?X", "?Y")), ("node", ("?X",)), ("node", ("?Y",)), ("!tc", ("?X", "?Y")))]
    whole = session(spark, rules, facts)
    whole.saturate()
    d = Datalog(spark)
    items = [("r", r) for r in rules] + [("f", f) for f in facts if f[0] == "e"]
    d.push_facts({f: 1 for f in facts if f[0] == "node"})
    for kind, x in items if order == 0 else items[::-1]:
        d.push_rules([x]) if kind == "r" else d.push_facts({x: 1})
        if kind == "r":
            d.saturate()
    d.saturate()
    assert d.rows() == whole.rows()
    assert d.unified().count() == len(whole.rows())


PROGRAM = [
    *TC,
    (("far", ("?X", "?Y")), ("node", ("?X",)), ("node", ("?Y",)), ("!tc", ("?X", "?Y"))),
    (("sink", ("?X",)), ("node", ("?X",)), ("!e", ("?X", "?Y"))),
    (("tc", ("?X", "?X")), ("mark", ("?X",)), ("!off", ())),
    (("mark", ("?X",)), ("mark", ("?X",)), ("node", ("?X",))),
    (("back", ("?X",)), ("far", ("?X", "?Y")), ("tc", ("?Y", "?X")), ("!sink", ("?Y",))),
    (("quiet", ()), ("!off", ())),
    (("even", ("?X",)), ("back", ("?X",))),
    (("back", ("?X",)), ("even", ("?X",)), ("mark", ("?X",))),
]


@pytest.mark.parametrize("seed", [2, 5])
def test_changes_equal_a_new_start(spark, seed):
    """Facts and rules come and go; model and summed changes equal those of a session from scratch."""
    rng = random.Random(seed)
    pool = [("e", (a, b)) for a in range(5) for b in range(5)] + [("node", (k,)) for k in range(5)] + [("mark", (k,)) for k in range(3)] + [("tc", (9, 0)), ("off", ())]
    d, rules, facts, total = Datalog(spark), {}, {}, {}
    for step in range(3):
        change = {f: rng.choice((1, 1, 2) if step == 0 else (1, -1, -2)) for f in rng.sample(pool, 12 if step == 0 else 5)}
        turned = {r: 1 for r in PROGRAM} if step == 0 else {r: -1 if rules.get(r) else 1 for r in rng.sample(PROGRAM, 2)}
        for held, more in ((facts, change), (rules, turned)):
            for k, w in more.items():
                held[k] = held.get(k, 0) + w
        d.push_facts(change)
        d.push_rules(turned)
        d.saturate()
        for p, f in d.delta.items():
            for r in f.collect():
                key = (p, tuple(untag(v) for c, v in r.asDict().items() if c not in ("_w", "_unit")))
                total[key] = total.get(key, 0) + r["_w"]
        new = session(spark, {r: w for r, w in rules.items() if w}, facts)
        new.saturate()
        assert d.rows() == new.rows()
        assert {k: w for k, w in total.items() if w} == dict.fromkeys(new.rows(), 1)


def test_rules_without_positive_atoms(spark):
    d = session(spark, [(("calm", ("x",)), ("!off", ())), (("sure", (1,)),)], {("n", (1,)): 1})
    assert derived(d, "calm") == {("x",)} and derived(d, "sure") == {(1,)}
    d.push_facts({("off", ()): 1})
    assert derived(d, "calm") == set() and derived(d, "sure") == {(1,)}
    d.push_facts({("off", ()): -1})
    assert derived(d, "calm") == {("x",)}


def test_an_equal_atom_is_no_support(spark):
    rules = [(("p", ("?X",)), ("q", ("?X",))), (("p", ("?X",)), ("p", ("?X",)), ("n", ("?X",)))]
    d = session(spark, rules, {("q", (1,)): 1, ("n", (1,)): 1})
    assert derived(d, "p") == {(1,)}
    d.push_facts({("q", (1,)): -1})
    assert derived(d, "p") == set()


def test_levels_and_guards():
    rules = [*TC, (("far", ("?X",)), ("n", ("?X",)), ("!tc", ("?X", "?X"))), (("top", ("?X",)), ("n", ("?X",)), ("!far", ("?X",)))]
    assert stratify(map(Rule.parse, rules)) == {"e": 0, "n": 0, "tc": 0, "far": 1, "top": 2}
    out = guarded(rules)
    assert out[2][1] == ("stratum_ready", (0,)) and out[3][1] == ("stratum_ready", (1,))
    assert guarded(rules, {"tc": 0})[0][1] == ("stratum_ready", (-1,)) and len(guarded(rules, {"tc": 0})) == 2


SCO, SPO, DOM, RNG, TYPE = range(5)


@pytest.mark.parametrize(
    "tbox, abox, want",
    [
        ([(10, SCO, 11), (11, SCO, 12)], [], {(10, SCO, 12)}),
        ([(20, SPO, 21), (21, SPO, 22)], [], {(20, SPO, 22)}),
        ([(20, SPO, 21)], [(1, 20, 2)], {(1, 21, 2)}),
        ([(20, DOM, 10)], [(1, 20, 2)], {(1, TYPE, 10)}),
        ([(20, RNG, 10)], [(1, 20, 2)], {(2, TYPE, 10)}),
        ([(10, SCO, 11)], [(1, TYPE, 10)], {(1, TYPE, 11)}),
        ([(20, SPO, 21), (21, DOM, 10), (10, SCO, 11)], [(1, 20, 2)], {(1, 21, 2), (1, TYPE, 10), (1, TYPE, 11)}),
        ([(20, SPO, SCO)], [(10, 20, 11), (1, TYPE, 10)], {(10, SCO, 11), (1, TYPE, 11)}),
    ],
)
def test_rdfs(spark, tbox, abox, want):
    kind = "s long, p long, o long"
    found, _ = rdfs.closure(spark.createDataFrame(tbox, kind), spark.createDataFrame(abox, kind))
    assert {tuple(r) for r in found.collect()} == {*tbox, *abox, *want}


def test_rdfs_under_changes(spark):
    """Each box gets and loses triples; the closure equals that of a new start, and the changes add up to it."""
    kind = "s long, p long, o long"
    tbox = {(20, SPO, 21): 1, (21, DOM, 10): 1, (10, SCO, 11): 1, (11, SCO, 10): 1, (21, RNG, 12): 1}
    abox = {(1, 20, 2): 1, (2, 21, 3): 2, (4, TYPE, 10): 1, (1, TYPE, 10): 1}
    steps = [(tbox, abox), ({(20, SPO, SCO): 1, (12, SCO, 13): 1}, {(12, 20, 14): 1}), ({(20, SPO, SCO): -1, (10, SCO, 11): -1}, {(1, 20, 2): -1, (2, 21, 3): -1, (1, TYPE, 10): -1})]
    state, held, total = rdfs.Knowledge(spark), ({}, {}), {}
    for step in steps:
        for box, change in zip(held, step):
            for t, w in (change or {}).items():
                box[t] = box.get(t, 0) + w
        got = state.push(*(None if c is None else z.from_rows(spark, c, kind) for c in step))
        for t, w in z.to_rows(got).items():
            total[t] = total.get(t, 0) + w
        boxes = [spark.createDataFrame([t for t, w in box.items() if w > 0], kind) for box in held]
        want = {tuple(r): 1 for r in rdfs.closure(*boxes)[0].collect()}
        assert dict.fromkeys((tuple(r) for r in state.closure().collect()), 1) == want
        assert {t: w for t, w in total.items() if w} == want


def test_loaders(spark, tmp_path):
    from tidemark.sources import loaders

    at = tmp_path / "g.txt"
    at.write_text("0 1 x\n1\t2\n\n0 1 y\n")
    assert z.to_rows(loaders.edges(spark, str(at))) == {(0, 1): 1, (1, 2): 1}
    (tmp_path / "t.txt").write_text("1 2 3\n1 2 3\n")
    assert z.to_rows(loaders.triples(spark, str(tmp_path / "t.txt"))) == {(1, 2, 3): 1}
    log = str(tmp_path / "log")
    for e, rows in enumerate([{(1, 2): 1}, {(1, 2): -1, (3, 4): 2}]):
        loaders.write_changelog(z.from_rows(spark, rows, E), log, e)
    assert z.to_rows(loaders.changelog_state(loaders.read_changelog(spark, log))) == {(3, 4): 2}
    assert z.to_rows(loaders.changelog_state(loaders.read_changelog(spark, log, 0))) == {(1, 2): 1}


def test_weighted_edges_are_a_set(spark):
    r = Reachability(z.from_rows(spark, {}, E))
    r.push(z.from_rows(spark, {(0, 1): 3, (1, 2): -1}, E))
    assert pairs(r.pairs) == {(0, 1)} and r.edges.where(F.col("_w") == 3).count() == 1
