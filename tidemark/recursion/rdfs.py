"""RDFS closure of a triple table by six rules.

``p1``  (a sub b), (b sub c)       -> (a sub c)      classes
``p2``  (p subp q), (q subp r)     -> (p subp r)     properties
``p3``  (x p y), (p subp q)        -> (x q y)
``p4``  (p domain c), (x p y)      -> (x type c)
``p5``  (p range c), (x p y)       -> (y type c)
``p6``  (x type a), (a sub b)      -> (x type b)

Domain and range triples count as given in the TBox; p3 to p5 apply to predicates that are
not schema predicates. Schema closures come first and are small beside the data, so each
data rule is one join whose schema side Spark broadcasts by size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import zset as z
from tidemark.operators.zset import W
from tidemark.recursion.datalog import Datalog
from tidemark.recursion.fixpoint import MAX_ROUNDS, NotConverged, reach
from tidemark.session import materialize


@dataclass(frozen=True)
class Vocabulary:
    """The terms that stand for the schema predicates."""

    sub_class: object = 0
    sub_property: object = 1
    domain: object = 2
    range: object = 3
    type: object = 4

    def schema_terms(self) -> list:
        return [self.sub_class, self.sub_property, self.domain, self.range, self.type]


def _links(triples: DataFrame, term: object) -> DataFrame:
    return triples.where(F.col("p") == F.lit(term)).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def _triples(pairs: DataFrame, term: object, kind: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("s"), F.lit(term).cast(kind.schema["p"].dataType).alias("p"), F.col("dst").alias("o"))


def closure(tbox: DataFrame, abox: DataFrame | None = None, terms: Vocabulary = Vocabulary(), max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """All given and derived triples ``s, p, o``, and the outer rounds until nothing was added."""
    given = tbox.select("s", "p", "o")
    whole = materialize((given if abox is None else given.unionByName(abox.select("s", "p", "o"))).distinct(), "triples")
    domain, range_ = (materialize(_links(given, t).distinct(), "schema") for t in (terms.domain, terms.range))
    plain = ~F.col("p").isin(terms.schema_terms())
    for rounds in range(1, max_rounds + 1):
        classes = reach(_links(whole, terms.sub_class))[0]
        properties = reach(_links(whole, terms.sub_property))[0]
        facts = whole.where(plain)
        lifted = facts.join(properties, F.col("p") == F.col("src")).select("s", F.col("dst").alias("p"), "o")
        facts = facts.union(lifted.where(plain))
        typed = lambda links, who: facts.join(links, F.col("p") == F.col("src")).select(F.col(who).alias("src"), "dst")
        direct = _links(whole.union(lifted), terms.type).union(typed(domain, "s")).union(typed(range_, "o")).distinct()
        up = direct.alias("a").join(classes.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        found = _triples(classes, terms.sub_class, whole).union(_triples(properties, terms.sub_property, whole)).union(lifted).union(_triples(direct.union(up), terms.type, whole))
        added = materialize(z.semi(found.distinct(), whole, ["s", "p", "o"], "left_anti"), "triples")
        if added.isEmpty():
            return whole, rounds
        whole = materialize(whole.union(added), "triples")
        if lifted.where(~plain).isEmpty():
            return whole, rounds  # each rule has seen the others' results; only a derived schema triple needs another round
    raise NotConverged(f"no closure in {max_rounds} rounds")


class Knowledge:
    """An RDFS closure kept up to date under insertions and deletions in both boxes.

    The six rules run as a Datalog program over weighted triples, so a change is followed to
    its consequences only. Terms are of one type, that of the triples' columns.
    """

    def __init__(self, spark: SparkSession, terms: Vocabulary = Vocabulary(), max_rounds: int = MAX_ROUNDS):
        self.terms, self.program = terms, Datalog(spark, typed=True, max_rounds=max_rounds)
        t = lambda *args: ("triple", args)
        data = [t("?x", "?p", "?y"), ("!schema", ("?p",))]
        self.program.push_rules(
            [
                (t("?s", "?p", "?o"), ("tbox", ("?s", "?p", "?o"))),
                (t("?s", "?p", "?o"), ("abox", ("?s", "?p", "?o"))),
                (t("?a", terms.sub_class, "?c"), t("?a", terms.sub_class, "?b"), t("?b", terms.sub_class, "?c")),
                (t("?a", terms.sub_property, "?c"), t("?a", terms.sub_property, "?b"), t("?b", terms.sub_property, "?c")),
                (t("?x", "?q", "?y"), *data, t("?p", terms.sub_property, "?q")),
                (t("?x", terms.type, "?c"), *data, ("tbox", ("?p", terms.domain, "?c"))),
                (t("?y", terms.type, "?c"), *data, ("tbox", ("?p", terms.range, "?c"))),
                (t("?x", terms.type, "?b"), t("?x", terms.type, "?a"), t("?a", terms.sub_class, "?b")),
            ]
        )

    def push(self, tbox: DataFrame | None = None, abox: DataFrame | None = None) -> DataFrame:
        """Add weighted triples ``s, p, o`` to the boxes; the change of the closure, as a Z-set."""
        program, boxes = self.program, {}
        for name, change in (("tbox", tbox), ("abox", abox)):
            if change is None:
                continue
            change = change if W in change.columns else z.weighted(change)
            boxes[name] = change.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate("spo")), W)
            if "schema" not in program.facts:
                kind = F.array(*map(F.lit, self.terms.schema_terms())).cast(f"array<{change.schema['p'].dataType.simpleString()}>")
                program.push_facts({"schema": z.weighted(program.spark.range(1).select(F.explode(kind).alias("c0")))})
        if not boxes:
            raise ValueError("neither box changes")
        program.push_facts(boxes)
        program.saturate()
        change = program.delta.get("triple")
        if change is None:
            change = z.weighted(next(iter(boxes.values())).drop(W)).limit(0)
        return change.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate("spo")), W)

    def closure(self) -> DataFrame | None:
        """All given and derived triples ``s, p, o``; None before there are any."""
        held = self.program.model.get("triple")
        return None if held is None else held.toDF("s", "p", "o")
