"""Best-fit packing of documents into sequences by a configuration linear program.

The lengths' histogram (at most ``capacity`` entries, whatever the corpus) is all that the program sees. Lengths are
grouped upwards to multiples of ``grain``; a configuration is a multiset of groups that fits the capacity; the
program asks for the fewest configurations that cover every group's count. Multiplicative weights solve it: each
group's weight falls as it is covered, and the configurations to add next are the heaviest ones, found by an unbounded
knapsack over the capacity (dynamic programming). The fractional answer is feasible, and its gap to a lower bound is reported. It is
rounded down to whole runs of configurations, then up once by the largest remainders; runs that the same knapsack prices by the
lengths alone take most of what is left, and the last few pieces go by best fit, longest first, into the space left in any sequence.

The plan is a list of intervals: pieces of one length, by their rank among the pieces of that length, go to
consecutive sequences at one offset. Ranks are counted per partition of a range sort, so a length that a third
of all pieces share is dealt to many tasks.

Null text counts as empty (only the end id remains), null doc_ids are kept, repeated rows are packed each, no rows give
no pieces. Documents of more than ``capacity`` ids are cut into full pieces and a rest; no other is cut.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, save, small_batches, with_null, without_null
from tidelog.llm.tokens import default_path, encoder, in_groups

CAPACITY = 2048


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and the ids) of every piece of every document."""
    vocabulary = vocabulary or default_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(vocabulary, drops_space=True, most=400_000)
        for pdf in batches:
            numbers = zip(pdf["doc_id"].tolist(), pdf["__null"].tolist(), strict=True)
            for group in in_groups(pdf["text"].tolist()):
                rows = []
                for own in encode(group):
                    (doc_id, null), own = next(numbers), own + end
                    for k in range(0, len(own), 4 * capacity):
                        part = own[k : k + 4 * capacity]
                        rows.append((doc_id, null, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "__null", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return with_null(without_null(rows).mapInPandas(cut, "doc_id long, __null boolean, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids))


class Knapsack:
    """The heaviest multisets of sizes 1.. (``weight`` by size, index 0 unused) for every capacity up to the largest size.

    Unbounded dynamic programming; of equally heavy choices the largest size counts.
    """

    def __init__(self, weight: np.ndarray):
        self.weight, cap = weight, len(weight) - 1
        self.best, self.choice = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
        sizes = np.flatnonzero(weight > 0)
        w = weight[sizes]
        for c in range(int(sizes[0]) if len(sizes) else cap + 1, cap + 1):
            k = int(np.searchsorted(sizes, c, "right"))
            got = w[:k] + self.best[c - sizes[:k]]
            i = k - 1 - int(got[::-1].argmax())
            self.best[c], self.choice[c] = got[i], sizes[i]

    def chosen(self, capacity: int, first: int = 0) -> dict[int, int]:
        """The heaviest multiset for ``capacity``; with ``first``, of those that hold one of that size."""
        out: dict[int, int] = defaultdict(int)
        if first:
            out[first] += 1
        c = capacity - first
        while c > 0 and (s := int(self.choice[c])):
            out[s] += 1
            c -= s
        return dict(out)


@dataclass
class Answer:
    """A fractional cover by configurations, its sum, and a lower bound on any such sum."""

    configurations: list[tuple[dict[int, int], float]]
    total: float
    bound: float

    @property
    def gap(self) -> float:
        return self.total / self.bound - 1 if self.bound else 0.0


def solve(counts: np.ndarray, eps: float = 2.0, theta: float = 0.3, near: float = 0.97, rounds: int = 400, rest: float = 0.01, bend: float = 0.5) -> Answer:
    """The fewest configurations that cover ``counts`` (by size, index 0 unused), by multiplicative weights.

    A size weighs its length, a little more for long ones (``bend``), times exp(eps * share of its demand not covered yet). In each round one knapsack prices, for every size,
    the best configuration that holds it, those least covered first; each of at least ``near`` times the best weight gets ``theta`` of what
    its scarcest size leaves. So no demand is covered twice, and no answer has to be scaled. At ``rest`` of all lengths, or after
    ``rounds``, what is left gets configurations of one size each, which makes the cover feasible. By duality each round's weights bound all covers.
    """
    sizes, cap = np.flatnonzero(counts), len(counts) - 1
    if not len(sizes):
        return Answer([], 0.0, 0.0)
    demand = counts[sizes].astype(float)
    left, bound = demand.copy(), float((demand * sizes).sum()) / cap
    place = np.zeros(cap + 1, np.int64)
    place[sizes] = np.arange(len(sizes))
    x: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        if (left * sizes).sum() <= rest * (demand * sizes).sum():
            break
        share = left / demand
        weight = np.zeros(cap + 1)
        weight[sizes] = sizes * (1 + bend * sizes / cap) * np.exp(eps * (share - share.max()))
        weight[sizes[share < 1e-6]] = 0  # a bound all the same
        sack = Knapsack(weight)
        bound = max(bound, float((weight[sizes] * demand).sum()) / sack.best[cap])
        for first in sizes[np.argsort(-share, kind="stable")].tolist():
            if not weight[first] or weight[first] + sack.best[cap - first] < near * sack.best[cap]:
                continue
            chosen = sack.chosen(cap, first)
            step = theta * min(left[place[s]] / a for s, a in chosen.items())
            x[tuple(sorted(chosen.items()))] += step
            for s, a in chosen.items():
                left[place[s]] -= a * step
    out = [(dict(k), v) for k, v in x.items()]
    out += [({int(s): int(cap // s)}, float(n / (cap // s))) for s, n in zip(sizes, left, strict=True) if n > 0]
    return Answer(out, sum(v for _, v in out), bound)


class _Plan:
    """Intervals of ranks by length, and the space left in runs of sequences."""

    def __init__(self, histogram: np.ndarray, capacity: int, grain: int):
        self.capacity, self.grain = capacity, grain
        self.left = histogram.copy()
        self.next_rank = np.zeros(len(histogram), np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, rank from, rank to, sequence of the first, offset
        self.space: dict[int, list[list[int]]] = defaultdict(list)  # space left: runs [first sequence, how many]

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        r = int(self.next_rank[length])
        self.rows.append((length, r, r + n, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def run(self, chosen: dict[int, int], times: int) -> None:
        """``times`` sequences of one configuration, in stretches of equal lengths."""
        slots = [g for g, a in sorted(chosen.items(), reverse=True) for _ in range(a)]
        while times:
            lengths = [0] * len(slots)
            need: dict[int, int] = defaultdict(int)
            for i, g in enumerate(slots):
                for length in range(min(self.capacity, g * self.grain), (g - 1) * self.grain, -1):
                    if self.left[length] > need[length]:
                        lengths[i] = length
                        need[length] += 1
                        break
            n = min([times, *(int(self.left[length]) // k for length, k in need.items() if k)])
            at = 0
            for length in lengths:
                if length:
                    self.place(length, n, self.sequences, at)
                    at += length
            self.space[self.capacity - at].append([self.sequences, n])
            self.sequences += n
            times -= n

    def best_fit(self) -> None:
        """What is left, longest first, each into the least space that holds it."""
        keys = sorted(k for k, v in self.space.items() if v)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                i = bisect.bisect_left(keys, length)
                if i == len(keys):
                    space, first, n = self.capacity, self.sequences, min(int(self.left[length]), 1)
                    self.sequences += n
                else:
                    space = keys[i]
                    run = self.space[space][-1]
                    n = min(run[1], int(self.left[length]))
                    first = run[0]
                    run[0] += n
                    run[1] -= n
                    if not run[1]:
                        self.space[space].pop()
                        if not self.space[space]:
                            keys.pop(i)
                self.place(length, n, first, self.capacity - space)
                rest = space - length
                if rest:
                    if not self.space[rest]:
                        bisect.insort(keys, rest)
                    self.space[rest].append([first, n])


@dataclass
class Layout:
    """Where the pieces of each length go (intervals of ranks), the number of sequences, and how they came about:
    the program's answer, and the pieces that its configurations (rounded), priced runs of the rest, and best fit placed."""

    steps: pd.DataFrame
    sequences: int
    answer: Answer
    by_program: int
    by_pricing: int
    by_best_fit: int


def plan(histogram: np.ndarray, capacity: int = CAPACITY, grain: int = 2) -> Layout:
    groups = -(-capacity // grain)
    p = _Plan(histogram.astype(np.int64), capacity, grain)
    index = -(-np.arange(len(histogram)) // grain)
    count = lambda: np.bincount(index, weights=p.left, minlength=groups + 1)[: groups + 1].astype(np.int64)
    every = int(p.left.sum())
    if p.left[capacity] and capacity > grain:  # a piece that fills a sequence is a configuration of its own
        n = int(p.left[capacity])
        p.place(capacity, n, p.sequences, 0)
        p.sequences += n
    answer = solve(count())
    left = count()
    for whole in (True, False):  # whole multiples, then once more by the largest remainders
        for chosen, x in sorted(answer.configurations, key=lambda c: (-(c[1] if whole else c[1] % 1), sorted(c[0].items()))):
            times = int(min([x if whole else 1, *(left[g] // a for g, a in chosen.items())]))
            if times:
                p.run(chosen, times)
                for g, a in chosen.items():
                    left[g] -= a * times
    by_program = every - int(p.left.sum())
    while (size := np.flatnonzero(left)).size:  # what is left is priced by its length
        weight = np.zeros(groups + 1)
        weight[size] = size
        sack, before = Knapsack(weight), int(left.sum())
        for s in size[::-1].tolist():
            chosen = sack.chosen(groups, s)
            fill = sum(g * a for g, a in chosen.items())
            times = int(min(left[g] // a for g, a in chosen.items()))
            if times and fill >= 0.99 * groups:
                p.run(chosen, times)
                for g, a in chosen.items():
                    left[g] -= a * times
        if left.sum() > 0.9 * before:
            break
    by_pricing = every - by_program - int(p.left.sum())
    rest = int(p.left.sum())
    p.best_fit()
    steps = pd.DataFrame(p.rows, columns=["length", "from", "to", "sequence", "offset"]).sort_values(["length", "from"])
    return Layout(steps, p.sequences, answer, by_program, by_pricing, rest)


def pack(cut: DataFrame, capacity: int = CAPACITY, grain: int = 2) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``cut`` (needs ``doc_id`` and ``length``)."""

    def ranked(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for pdf in batches:
            if len(pdf):
                pdf["__idx"] = pdf.groupby("length").cumcount() + pdf["length"].map(lambda x: seen[x])
                for length, n in pdf["length"].value_counts().items():
                    seen[length] += n
                pdf["__part"] = part
                yield pdf

    cut = without_null(cut)  # of its columns doc_id alone may be null
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    tied = cut.withColumn("__tie", F.monotonically_increasing_id()) if "__tie" not in cut.columns else cut
    dealt = tied.repartitionByRange("length", "__tie").sortWithinPartitions("length", "__tie").drop("__tie")
    dealt = save(dealt.mapInPandas(ranked, fields + ", __idx long, __part int"), "pack-ranks")
    totals = dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "__part").toPandas()  # a range per partition
    histogram = np.zeros(capacity + 1, np.int64)
    np.add.at(histogram, totals["length"].to_numpy(np.int64), totals["n"].to_numpy(np.int64))
    totals["before"] = totals.groupby("length")["n"].cumsum() - totals["n"]
    before = dict(zip(zip(totals["length"].tolist(), totals["__part"].tolist(), strict=True), totals["before"].tolist(), strict=True))
    steps = plan(histogram, capacity, grain).steps
    by_length = {int(k): tuple(g[c].to_numpy(np.int64) for c in ("from", "sequence", "offset")) for k, g in steps.groupby("length")}
    sent = cut.sparkSession.sparkContext.broadcast((before, by_length))  # by lengths, partitions and configurations, not by pieces

    def placed(batches):
        before, by_length = sent.value
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            idx = pdf["__idx"].to_numpy()
            for key, own in pdf.groupby(["length", "__part"]).indices.items():
                starts, seqs, offs = by_length[int(key[0])]
                rank = idx[own] + before[int(key[0]), int(key[1])]
                k = np.searchsorted(starts, rank, "right") - 1
                sequence[own], offset[own] = seqs[k] + rank - starts[k], offs[k]
            pdf["sequence_id"], pdf["offset"] = sequence, offset
            yield pdf.drop(columns=["__idx", "__part"])

    return with_null(dealt.mapInPandas(placed, fields + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY, grain: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    cut = save(pieces(docs, vocabulary, end_id, capacity, with_ids), "pack-pieces")
    return pack(cut, capacity, grain)
