"""The parts of a rule program.

    x, y, z = variables("x y z")
    engine.rule(path(x, z), path(x, y), edge(y, z), ~blocked(x, z), x < z)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class RuleError(ValueError):
    """A rule that can't be evaluated."""


class NotStratifiableError(RuleError):
    """A relation depends on its own negation or aggregate."""


@dataclass(frozen=True)
class Var:
    name: str

    def _compare(self, op: str, other: Any) -> Cmp:
        return Cmp(op, self, other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __le__(self, other):
        return self._compare("<=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    def eq(self, other):
        return self._compare("==", other)

    def ne(self, other):
        return self._compare("!=", other)


def variables(names: str) -> list[Var]:
    return [Var(n) for n in names.replace(",", " ").split()]


class _Wildcard:
    def __repr__(self):
        return "_"


#: Any value, not bound.
_ = WILD = _Wildcard()


@dataclass(frozen=True)
class Atom:
    relation: Any
    args: tuple

    def __invert__(self) -> Not:
        return Not(self)

    def vars(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var)))


@dataclass(frozen=True)
class Not:
    atom: Atom


@dataclass(frozen=True)
class Cmp:
    op: str
    left: Any
    right: Any

    def vars(self) -> list[str]:
        return [a.name for a in (self.left, self.right) if isinstance(a, Var)]


@dataclass(frozen=True)
class Where:
    """``test`` gets a Column for each variable and returns a boolean Column."""

    test: Callable
    args: tuple

    def vars(self) -> list[str]:
        return [a.name for a in self.args]


def where(test: Callable, *args: Var) -> Where:
    return Where(test, args)


@dataclass(frozen=True)
class Agg:
    """``out`` = ``fn`` over ``value`` in each group of ``by``.

    ``fn``: sum, min, max, count, avg, or a function from a pandas Series to a scalar with ``returns``, its type.
    The input is the bag of distinct bindings of all the body's variables.
    """

    out: Var
    fn: str | Callable
    value: Var
    by: tuple
    returns: str = "bigint"


def agg(out: Var, fn: str | Callable, value: Var, by=(), returns: str = "bigint") -> Agg:
    return Agg(out, fn, value, tuple(by), returns)


@dataclass(frozen=True)
class Rule:
    heads: tuple[Atom, ...]
    atoms: tuple[Atom, ...]
    nots: tuple[Not, ...]
    tests: tuple
    aggs: tuple[Agg, ...]

    @staticmethod
    def of(head, *body) -> Rule:
        heads = tuple(head) if isinstance(head, (tuple, list)) else (head,)
        pick = lambda *kinds: tuple(b for b in body if isinstance(b, kinds))
        rule = Rule(heads, pick(Atom), pick(Not), pick(Cmp, Where), pick(Agg))
        unknown = [b for b in body if not isinstance(b, (Atom, Not, Cmp, Where, Agg))]
        if unknown:
            raise RuleError(f"not a part of a rule: {unknown}")
        check(rule)
        return rule

    def is_monotone(self) -> bool:
        return not self.nots and not self.aggs


def check(rule: Rule) -> None:
    """Arities, bound variables, and what an aggregate leaves to the heads."""
    for a in (*rule.heads, *rule.atoms, *(n.atom for n in rule.nots)):
        if len(a.args) != a.relation.arity:
            raise RuleError(f"{a.relation.name} has {a.relation.arity} columns, not {len(a.args)}")
    if not rule.atoms:
        raise RuleError("a rule needs a positive atom")
    bound = {v for a in rule.atoms for v in a.vars()}
    for part in (*rule.tests, *(n.atom for n in rule.nots)):
        if missing := set(part.vars()) - bound:
            raise RuleError(f"unbound variables: {sorted(missing)}")
    visible = set(bound)
    if rule.aggs:
        by = [v.name for v in rule.aggs[0].by]
        if any(a.by != rule.aggs[0].by for a in rule.aggs):
            raise RuleError("aggregates of one rule share their grouping")
        if len(set(by)) != len(by) or set(by) - bound or {a.value.name for a in rule.aggs} - bound:
            raise RuleError("groups must be distinct and, like values, bound")
        outs = [a.out.name for a in rule.aggs]
        if set(outs) & bound or len(set(outs)) != len(outs):
            raise RuleError("an aggregate's output is a new variable")
        visible = set(by) | set(outs)
    for h in rule.heads:
        if any(a is WILD for a in h.args) or set(h.vars()) - visible:
            raise RuleError(f"head of {h.relation.name}: unbound {sorted(set(h.vars()) - visible)}")
