"""Rules to a fixpoint: stratum by stratum, semi-naive, each round a few Spark jobs on newly derived facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.operators.relation import Mark, Relation, union
from tidelog.plans.compile import bindings, heads_once, project
from tidelog.plans.ir import Rule
from tidelog.plans.strata import strata
from tidelog.sources.tables import few_sent, materialise, scratch


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rules: list[Rule] = []
        self.rounds = 0
        self._bodies: dict[int, DataFrame] = {}
        #: By relation: how far the last solve has seen it; rules that have been solved at least once.
        self._seen: dict[str, Mark] = {}
        self._solved: set[int] = set()

    def relation(self, name: str, schema: str, rows=None, on_null: str = "error") -> Relation:
        r = Relation(self.spark, name, schema, on_null)
        return r if rows is None else r.insert(rows)

    def rule(self, head, *body) -> Engine:
        """``head`` (one atom, or several that share the body) holds where all of ``body`` does."""
        self.rules.append(Rule.of(head, *body))
        strata(self.rules)
        return self

    def relations(self) -> dict[str, Relation]:
        out = {}
        for r in self.rules:
            for a in (*r.heads, *r.atoms, *(n.atom for n in r.nots)):
                if out.setdefault(a.relation.name, a.relation) is not a.relation:
                    raise ValueError(f"two relations are named {a.relation.name}")
        return out

    def solve(self, max_rounds: int | None = None) -> Engine:
        """Derive all facts. May be called again after more were inserted, committed or derived by another engine.

        Each engine remembers how far it has seen every relation. Positive rules go on from the facts that are new since then, joined with
        what there is; nothing new, nothing runs. Relations above a negation or an aggregate of something that has
        changed, or above facts that were taken back, are derived anew from what was inserted.
        """
        relations = self.relations()
        self._bodies = {}
        before, marks = dict(self._seen), {}
        with few_sent(self.spark), scratch(lambda: [p for r in relations.values() for p in r.paths()]):
            for group in strata(self.rules):
                own = [r for r in self.rules if any(h.relation.name in group for h in r.heads)]
                used = {a.relation.name for r in own for a in r.atoms} | {n.atom.relation.name for r in own for n in r.nots}
                hard = {n.atom.relation.name for r in own for n in r.nots} | {a.relation.name for r in own if r.aggs for a in r.atoms}
                for g in group:
                    relations[g].commit()
                anew = any(relations[n].mark.epoch != before[n].epoch for n in used | set(group) if n in before)
                anew = anew or any(n in before and relations[n].mark != before[n] for n in hard)
                if anew:
                    for g in group:
                        relations[g].reset()
                left = self._stratum(group, own, relations, before, anew, max_rounds) if own else {}
                marks |= {g: left.get(g, relations[g].mark) for g in group}
        self._seen |= marks
        self._solved |= {id(r) for r in self.rules}
        return self

    def _stratum(self, group: list[str], rules: list[Rule], relations: dict[str, Relation], before: dict[str, Mark], anew: bool, max_rounds: int | None) -> dict[str, Mark]:
        """Returns the marks up to which facts were joined, of relations that ``max_rounds`` stopped before that."""
        total = {n: r.df() for n, r in relations.items()}
        derived: dict[str, list[tuple[DataFrame, bool]]] = {g: [] for g in group}
        fresh = {n: relations[n].since(m) for n, m in before.items() if n in relations}
        for r in rules:
            names = [a.relation.name for a in r.atoms]
            if anew or id(r) not in self._solved:
                self._emit(r, [total[n] for n in names], total, None, relations, derived)
                continue
            for i, name in enumerate(names):  # what is new, with everything; both sides new are joined twice at most
                if fresh[name] is not None:
                    self._emit(r, [fresh[name] if j == i else total[n] for j, n in enumerate(names)], total, i, relations, derived)
        recursive = [(r, i) for r in rules for i, a in enumerate(r.atoms) if a.relation.name in group]
        marks = {g: relations[g].mark for g in group}
        delta = self._advance(derived, relations)
        if recursive:  # facts inserted before are a delta as well, but the first pass has joined them with each other
            rounds = 0
            while delta and (max_rounds is None or rounds < max_rounds):
                rounds += 1
                old = {g: total[g] for g in group}
                now = {g: relations[g].df() for g in group}
                derived = {g: [] for g in group}
                for r, i in recursive:
                    name = r.atoms[i].relation.name
                    if name not in delta:
                        continue
                    frames = []
                    for j, a in enumerate(r.atoms):
                        n = a.relation.name
                        frames.append(delta[name] if j == i else total[n] if n not in group else now[n] if j < i else old[n])
                    self._emit(r, frames, total, i, relations, derived)
                total |= now
                marks = {g: relations[g].mark for g in group}
                delta = self._advance(derived, relations)
            self.rounds += rounds
        return {g: marks[g] for g in delta} if recursive else {}

    def _emit(self, rule: Rule, frames, total, first, relations, derived) -> None:
        counts = [relations[a.relation.name].count for a in rule.atoms]
        df = bindings(rule, frames, [total[n.atom.relation.name] for n in rule.nots], first, counts)
        if len(rule.heads) > 1:  # the body is evaluated once, also for heads of another stratum
            final = first is None and not {a.relation.name for a in rule.atoms} & set(derived)  # no round adds to the body
            if final and id(rule) in self._bodies:
                df = self._bodies[id(rule)]
            else:
                df, _ = materialise(df)
            if final:
                self._bodies[id(rule)] = df
        for h in rule.heads:
            if h.relation.name in derived:
                derived[h.relation.name].append((project(h, df), heads_once(rule, h)))

    def _advance(self, derived: dict[str, list[tuple[DataFrame, bool]]], relations: dict[str, Relation]) -> dict[str, DataFrame]:
        delta = {}
        for g, frames in derived.items():
            if frames:
                r = relations[g]
                r.add(union([df for df, _ in frames]), derived=True, is_set=len(frames) == 1 and frames[0][1])
                if r.delta is not None:
                    delta[g] = r.delta
        return delta
