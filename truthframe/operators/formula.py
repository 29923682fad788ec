"""Formulas over relations, and inference with them as a bounded fixpoint of DataFrames.

A theory is a directed graph of formulas; equal formulas are one node. Every pass visits the nodes after their
operands (upward) or before them (downward), and a node's update is seen by those visited later in the pass. A
node's relation is written out after each change, so plans don't grow with the number of passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from truthframe.functions import bounds as B
from truthframe.operators.relation import (
    Const, Relation, exists_down, exists_up, exists_up_grounded, forall_down, forall_up, forall_up_grounded, gather, groundings_of, unique_variables,
)
from truthframe.session import drop_written, materialize, settle

CONVERGED = 1e-7
#: Rows up to which a relation is kept on the driver, as part of the plans that use it; larger ones are written.
SMALL = 10_000


class Variable(str):
    """A variable, optionally with the name of a type."""

    type: str | None = None

    def __new__(cls, name: str, type: str | None = None):  # noqa: A002
        out = super().__new__(cls, name)
        out.type = type
        return out


def variables(*names: str) -> list[Variable]:
    return [Variable(n) for n in names]


class Formula:
    """Anything with truth bounds for each grounding of its variables."""

    operands: Sequence[Formula] = ()
    variables: list[str]
    world = "OPEN"
    weights: list[float] | None = None
    bias = 1.0

    def key(self) -> tuple:
        raise NotImplementedError

    def And(self, *others):  # noqa: N802
        return And(self, *others)

    def Or(self, *others):  # noqa: N802
        return Or(self, *others)

    def Implies(self, other):  # noqa: N802
        return Implies(self, other)

    def Iff(self, other):  # noqa: N802
        return Iff(self, other)

    def Not(self):  # noqa: N802
        return Not(self)

    def Forall(self, *bound):  # noqa: N802
        return Forall(*(bound or self.variables), self)

    def Exists(self, *bound):  # noqa: N802
        return Exists(*(bound or self.variables), self)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(map(repr, self.operands))})"


class Predicate:
    """A name with an arity; calling it with variables and constants (plain strings) gives a formula."""

    def __init__(self, name: str, arity: int = 1, world: str = "OPEN"):
        self.name, self.arity, self.world = name, arity, world
        self.keys = [f"g{i}" for i in range(arity)]

    def __call__(self, *arguments) -> Atom:
        if len(arguments) != self.arity:
            raise ValueError(f"{self.name} takes {self.arity} arguments")
        return Atom(self, [a if isinstance(a, (Variable, Const)) else Const(a) for a in arguments])


def Predicates(*names: str, arity: int = 1) -> list[Predicate]:  # noqa: N802
    return [Predicate(n, arity) for n in names]


def Proposition(name: str, world: str = "OPEN") -> Atom:  # noqa: N802
    return Predicate(name, 0, world)()


class Atom(Formula):
    def __init__(self, predicate: Predicate, arguments: list):
        self.predicate, self.arguments = predicate, arguments
        self.world = predicate.world
        self.variables = unique_variables([arguments])

    def key(self) -> tuple:
        return ("atom", self.predicate.name, tuple(map(repr, self.arguments)))

    def __repr__(self) -> str:
        return f"{self.predicate.name}({', '.join(map(str, self.arguments))})"


class Connective(Formula):
    def __init__(self, *operands: Formula, weights: Sequence[float] | None = None, bias: float = 1.0, world: str = "OPEN"):
        self.operands, self.world, self.bias = list(operands), world, bias
        self.weights = list(weights) if weights is not None else None
        self.variables = unique_variables(o.variables for o in operands)

    def key(self) -> tuple:
        return (type(self).__name__, self.world, self.bias, tuple(self.weights or ()), tuple(o.key() for o in self.operands))

    def up(self, xs: list[B.Bounds]) -> B.Bounds:
        raise NotImplementedError

    def down(self, whole: B.Bounds, xs: list[B.Bounds]) -> list[B.Bounds]:
        raise NotImplementedError


class And(Connective):
    def up(self, xs):
        return B.and_up(xs, self.weights, self.bias)

    def down(self, whole, xs):
        return B.and_down(whole, xs, self.weights, self.bias)


class Or(Connective):
    def up(self, xs):
        return B.or_up(xs, self.weights, self.bias)

    def down(self, whole, xs):
        return B.or_down(whole, xs, self.weights, self.bias)


class Implies(Connective):
    def up(self, xs):
        return B.implies_up(*xs, self.weights, self.bias)

    def down(self, whole, xs):
        return B.implies_down(whole, *xs, self.weights, self.bias)


class Not(Connective):
    def up(self, xs):
        return B.not_(xs[0])

    def down(self, whole, xs):
        return [B.not_(whole)]


class Congruent(Connective):
    def up(self, xs):
        return B.congruent_up(xs)

    def down(self, whole, xs):
        return [whole] * len(xs)


def Iff(a: Formula, b: Formula, world: str = "OPEN") -> Formula:  # noqa: N802
    return And(Implies(a, b), Implies(b, a), world=world)


def XOr(*operands: Formula, world: str = "OPEN") -> Formula:  # noqa: N802
    """Some operand, and no two of them."""
    pairs = [Not(And(a, b)) for i, a in enumerate(operands) for b in operands[i + 1 :]]
    return And(Or(*operands), *pairs, world=world)


class Quantifier(Formula):
    """``fully_grounded`` says that all individuals are known, so that an open formula's group proves both bounds."""

    def __init__(self, *bound_then_formula, world: str = "OPEN", fully_grounded: bool = False):
        *bound, inner = bound_then_formula
        bound = bound or list(inner.variables)
        if not set(bound) <= set(inner.variables):
            raise ValueError("quantified variables must occur in the formula")
        self.operands, self.bound, self.world, self.fully_grounded = [inner], list(bound), world, fully_grounded
        if fully_grounded:
            self.up, self.side = self.up_grounded, "both"
        self.variables = [v for v in inner.variables if v not in bound]

    def key(self) -> tuple:
        return (type(self).__name__, self.world, self.fully_grounded, tuple(self.bound), self.operands[0].key())


class Forall(Quantifier):
    up, up_grounded, down, side = staticmethod(forall_up), staticmethod(forall_up_grounded), staticmethod(forall_down), "upper"


class Exists(Quantifier):
    up, up_grounded, down, side = staticmethod(exists_up), staticmethod(exists_up_grounded), staticmethod(exists_down), "lower"


class Theory:
    """Formulas with data. ``natural`` joins operands on agreeing values only, instead of the quadratic grounding join: the
    groundings it leaves out are those put together from rows that disagree, whose bounds would stay unknown."""

    def __init__(self, spark: SparkSession, *formulas: Formula, natural: bool = False):
        self.spark, self.natural = spark, natural
        self.predicates: dict[str, Relation] = {}
        self.relations: dict[tuple, Relation] = {}
        self.nodes: dict[tuple, Formula] = {}
        self.roots: list[tuple] = []
        self.query: Formula | None = None
        self.only: DataFrame | None = None
        self._version: dict[object, int] = {}
        self._seen: dict[tuple, tuple] = {}
        self.add(*formulas)

    def add(self, *formulas: Formula, world: str | None = None) -> None:
        for f in formulas:
            if world:
                f.world = world
            self.roots.append(self._register(f))

    def _register(self, f: Formula) -> tuple:
        for o in f.operands:
            self._register(o)
        k = f.key()
        if isinstance(f, Atom):
            p = f.predicate
            if p.name not in self.predicates:
                self.predicates[p.name] = Relation.from_facts(self.spark, p.keys, {} if p.arity else {(): B.WORLDS[p.world]}, p.world)
        elif k not in self.relations:
            self.relations[k] = Relation.from_facts(self.spark, [str(v) for v in f.variables], {} if f.variables else {(): B.WORLDS[f.world]}, f.world)
        self.nodes.setdefault(k, f)  # post-order: operands stand before
        return k

    def add_data(self, data: Mapping) -> None:
        """``{predicate: {grounding: fact}}``, or a DataFrame with the predicate's keys g0, g1... and l, u; a proposition takes one fact."""
        for p, facts in data.items():
            p = p.predicate if isinstance(p, Atom) else p
            if p.name not in self.predicates:
                raise KeyError(f"{p.name} occurs in no formula")
            if not isinstance(facts, DataFrame):
                if p.arity == 0 and not isinstance(facts, Mapping):
                    facts = {(): facts}
                facts = Relation.from_facts(self.spark, p.keys, facts).df
            self.predicates[p.name] = self.predicates[p.name].add_data(facts) if p.arity else Relation(facts, [], p.world)
        self._seen.clear()

    def relation(self, f: Formula | Predicate) -> Relation:
        if isinstance(f, Predicate):
            return self.predicates[f.name]
        return self.predicates[f.predicate.name] if isinstance(f, Atom) else self.relations[f.key()]

    @staticmethod
    def _name(f: Formula) -> object:
        return f.predicate.name if isinstance(f, Atom) else f.key()

    def _unchanged(self, direction: str, f: Formula) -> bool:
        """Whether neither the formula nor any operand has changed since it was last visited in this direction."""
        now = tuple(self._version.get(self._name(x), 0) for x in (f, *f.operands))
        seen = self._seen.get((direction, f.key()))
        self._seen[direction, f.key()] = now
        return now == seen

    def _call(self, f: Formula) -> DataFrame:
        if isinstance(f, Atom):
            return self.predicates[f.predicate.name].bind(f.arguments)
        return self.relations[f.key()].df

    def _update(self, f: Formula, proofs: DataFrame, side: str = "both") -> float:
        """Tightens by proofs over the formula's variables, and returns by how much in all."""
        rel = self.relation(f)
        if isinstance(f, Atom):  # constants go back to their places
            proofs = proofs.select(*((F.lit(a.value) if isinstance(a, Const) else F.col(a)).alias(k) for k, a in zip(rel.keys, f.arguments)), "l", "u")
        # the change is summed up while the relation is written; a small one is kept with the plan
        counted = rel.tightened(proofs, side)
        out, head = settle(counted, "relation") if getattr(rel, "_rows", 0) <= SMALL else (None, None)
        if head is not None:
            change, rows = sum(head.column("moved").to_pylist()), head.num_rows
        elif out is not None:  # it has just outgrown the driver's share
            change, rows = out.agg(F.coalesce(F.sum("moved"), F.lit(0.0)), F.count("*")).first()
        else:
            seen = Observation()
            out = materialize(counted.observe(seen, F.coalesce(F.sum("moved"), F.lit(0.0)).alias("change"), F.count("*").alias("rows")), "relation")
            change, rows = seen.get["change"], seen.get["rows"]
        if change or rows != getattr(rel, "_rows", None):  # a new grounding may make others new, whatever its bounds
            self._version[self._name(f)] = self._version.get(self._name(f), 0) + 1
        drop_written(getattr(rel, "_table", None))
        fresh = Relation(out.drop("moved"), rel.keys, rel.world, rel.leaves)
        fresh._table, fresh._rows = out, rows
        if isinstance(f, Atom):
            self.predicates[f.predicate.name] = fresh
        else:
            self.relations[f.key()] = fresh
        return change

    def _bounds(self, f: Connective, extra: DataFrame | None = None) -> DataFrame:
        calls = [self._call(o) for o in f.operands]
        found = groundings_of(calls, self.natural) if f.variables else self.spark.range(1, numPartitions=1).select()
        if extra is not None and f.variables:
            found = found.select(*f.variables).unionByName(extra.select(*f.variables)).distinct()
        if self.only is not None and (shared := [v for v in f.variables if v in self.only.columns]):
            found = found.join(self.only.select(*shared).distinct(), shared, "left_semi")
        out = gather(found, calls, [o.world for o in f.operands])
        # operands in contradiction prove nothing
        for i in range(len(f.operands)):
            out = out.filter(~B.is_contradiction((F.col(f"l{i}"), F.col(f"u{i}"))))
        return out

    def upward(self, f: Formula) -> float:
        if isinstance(f, Atom) or self._unchanged("up", f):
            return 0.0
        if isinstance(f, Quantifier):
            return self._update(f, f.up(self._call(f.operands[0]), f.variables), f.side)
        xs = [(F.col(f"l{i}"), F.col(f"u{i}")) for i in range(len(f.operands))]
        l, u = f.up(xs)
        return self._update(f, self._bounds(f).select(*f.variables, l.alias("l"), u.alias("u")))

    def downward(self, f: Formula) -> float:
        if isinstance(f, Atom) or self._unchanged("down", f):
            return 0.0
        own = self.relations[f.key()]
        if isinstance(f, Quantifier):
            # the quantifier's groundings, in the world's bounds where there are none yet, meet the operand's rows
            inner = self._call(f.operands[0])
            whole = own.get(inner.select(*f.variables).distinct()) if f.variables else own.df
            return self._update(f.operands[0], f.down(inner, whole, f.variables))
        both = self._bounds(f, own.df)
        low, high = B.WORLDS[f.world]
        mine = own.df.select(*own.keys, F.col("l").alias("wl"), F.col("u").alias("wu"))
        both = both.join(mine, own.keys, "left") if own.keys else both.crossJoin(mine)
        both = both.withColumns({"wl": F.coalesce("wl", F.lit(low)), "wu": F.coalesce("wu", F.lit(high))})
        xs = [(F.col(f"l{i}"), F.col(f"u{i}")) for i in range(len(f.operands))]
        proofs = f.down((F.col("wl"), F.col("wu")), xs)
        both, _ = settle(both, "bounds", SMALL)  # all operands are proved from the same bounds
        change = 0.0
        for o, (l, u) in zip(f.operands, proofs):
            change += self._update(o, both.select(*o.variables, l.alias("l"), u.alias("u")))
        drop_written(both)
        return change

    def _order(self, source: Formula | None) -> list[Formula]:
        if source is None:
            return list(self.nodes.values())
        keys: list[tuple] = []

        def visit(f: Formula) -> None:
            for o in f.operands:
                visit(o)
            if f.key() not in keys:
                keys.append(f.key())

        visit(source)
        return [self.nodes[k] for k in keys]

    def set_query(self, f: Formula) -> None:
        self.query = f
        self._register(f)

    def _resolved(self) -> bool:
        if self.query is None:
            return False
        return bool(self.relation(self.query).states().agg(F.coalesce(F.count_if(F.col("state").isin("T", "F")) == F.count("*"), F.lit(False)) & (F.count("*") > 0)).first()[0])

    def infer(self, direction: str | None = None, source: Formula | None = None, max_steps: int = 50, groundings: DataFrame | None = None) -> tuple[int, float]:
        """Passes upward and downward until bounds change by less than ``CONVERGED`` in all; returns the passes and the total change.

        A single ``direction`` is one pass. With a query set, inference ends when all its groundings are true or false.
        With ``groundings``, columns named after variables, connectives are evaluated only for those that it has.
        """
        self.only = groundings
        if groundings is not None:
            self._seen.clear()
        order, total = self._order(source), 0.0
        if direction:
            step = self.upward if direction == "up" else self.downward
            return 1, sum(step(f) for f in (order if direction == "up" else reversed(order)))
        for steps in range(1, max_steps + 1):
            change = sum(self.upward(f) for f in order) + sum(self.downward(f) for f in reversed(order))
            total += change
            if change <= CONVERGED or self._resolved():
                break
        return steps, total

    def ask(self, f: Formula, max_steps: int = 50) -> DataFrame:
        """States of a formula's groundings after inference."""
        self.set_query(f)
        self.infer(max_steps=max_steps)
        return self.relation(f).states()

    def contradictions(self) -> dict[str, DataFrame]:
        """Groundings in contradiction, by formula."""
        named = {repr(f): self.relation(f) for f in self.nodes.values()}
        return {name: r.contradictions() for name, r in named.items()}

    def has_contradiction(self) -> bool:
        return any(df.head(1) for df in self.contradictions().values())

    def shape(self) -> dict[str, int]:
        """Groundings of each formula."""
        return {repr(f): self.relation(f).df.count() for f in self.nodes.values()}
