"""Near-duplicates by a chosen-path set similarity join.

A document's set is its distinct shingles of ``width`` words. Texts with equal sets form one class, and only the class's
smallest doc_id goes on. Every representative has ``SKETCH`` minwise tokens. In each of ``trees`` independent trees, or more,
it starts at the root and follows, node by node, the token at a place that the node chooses: similar sets choose the
same child with a probability of their similarity. Nodes of one document end; nodes of up to ``small`` documents are
compared exhaustively by their sketches; larger ones get first links by blocks that all hold the same few documents as pivots. Those
whose documents these links make one component are done with, those with at most ``small`` documents outside the most frequent component end, and
the others branch again, up to ``depth`` times; what is then still too large gets links by blocks again. In a block or small node a document
proposes two partners that look similar enough: the node's hub (of the well connected documents the first by a hash, so that
trees agree on it) and the one most like itself. Proposals are confirmed on the full
sets and joined to components. Then all pairs are accounted for: in a node that stayed large the documents outside its
most frequent component meet every block of the node (those inside are linked already), and documents that still have a
possible partner in another component of their node
are brought together with their texts, node by node, and all such pairs are tried on the full sets. So no group
emits all its pairs and no pair that a node finds is left out.

A pair at similarity s shares a child with probability s, so a tree whose last node is ``n`` tokens down finds it with s ** n. From the
deepest level that a document reached follows how many trees find a partner at the threshold with probability ``target``, the sketch
filter included; documents that had fewer go on in more trees. ASCII letters are lower-cased; null and empty texts have empty
sets, are linked with nothing and stay; fewer words than ``width`` are one shingle; null doc_ids come last and repeated
rows are of one class; an empty table gives no rows; very long texts are shingled whole; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidelog.llm.common import Box, columns, key_filter, maybe_in, save, save_counted, settle, small_batches, with_null, without_null

SKETCH = 64
#: Links that one task joins to components, of 16 bytes each; more go by rounds until as many are left.
AT_ONCE = 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)


class _Words(dict):
    """Word (bytes) to a 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 100_000 and len(word) <= 24:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of ``text``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s = (s ^ (s >> np.uint64(29))) * _M2 + h[k : k + len(s)] * _M1 + np.uint64(k)
    return np.unique((s ^ (s >> np.uint64(31))) * _M3)


def minwise(s: np.ndarray) -> np.ndarray:
    out = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(s), 8192):
        part = s[k : k + 8192, None]
        out = np.minimum(out, ((part * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """rid, doc_id, n, digest (of the set; of the row where it is empty) and sig."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["rid"], pdf["text"], strict=True):
                s = shingles(text, width)
                key = s.tobytes() if len(s) else b"empty" + int(rid).to_bytes(8, "little")
                rows.append((len(s), hashlib.blake2b(key, digest_size=16).digest(), minwise(s).tobytes()))
            yield pd.concat([pdf.drop(columns="text"), pd.DataFrame(rows, columns=["n", "digest", "sig"])], axis=1)

    rows = without_null(docs.select("rid", "doc_id", "text"))
    return with_null(rows.mapInPandas(run, "rid long, doc_id long, __null boolean, n long, digest binary, sig binary"))


def _mix(a: np.ndarray, b) -> np.ndarray:
    x = (a ^ np.asarray(b).astype(np.uint64)) * _M1
    return (x ^ (x >> np.uint64(32))) * _M2


def _child(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The next node of documents at ``node``: it chooses a place, the sketch's token there names the child."""
    place = (_mix(node, 7) >> np.uint64(40)) % np.uint64(SKETCH)
    return _mix(_mix(node, 11), sig[np.arange(len(sig)), place.astype(np.int64)])


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, SKETCH)


def paths(reps: DataFrame, first: int, trees: int) -> DataFrame:
    """The first node below the root, a row each, of ``trees`` trees from number ``first``: of each document the first ``more``."""

    def run(batches):
        for pdf in batches:
            for t in range(trees):
                part = pdf[pdf["more"] > t].drop(columns="more")
                if len(part):
                    root = _mix(np.full(len(part), first + t + 1, np.uint64), 3)
                    yield part.assign(tree=first + t, node=_child(root, _sigs(part["sig"])).view(np.int64))

    return reps.select("id", "n", "sig", "more").mapInPandas(run, "id long, n long, sig binary, tree int, node long")


def branch(rows: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(node=_child(pdf["node"].to_numpy(np.int64).view(np.uint64), _sigs(pdf["sig"])).view(np.int64))

    return rows.mapInPandas(run, rows.schema)


def recall(level: int, trees: int, ratio: float, low: float) -> float:
    """How likely a pair at ``ratio`` passes the sketch filter and goes ``level`` tokens together in one of ``trees`` trees."""
    k = np.arange(math.ceil(low * SKETCH - 1e-9), SKETCH + 1)  # equal tokens
    has = np.array([math.comb(SKETCH, int(i)) for i in k], float) * ratio**k * (1 - ratio) ** (SKETCH - k)
    return float((has * (1 - (1 - (k / SKETCH) ** level) ** trees)).sum())


def needed(level: int, ratio: float, low: float, target: float) -> int:
    """The number of trees that reaches ``target`` for documents whose last nodes are ``level`` tokens down at most."""
    if recall(0, 1, ratio, low) <= target:
        raise ValueError(f"the sketch filter alone keeps {recall(0, 1, ratio, low):.4f} of the pairs, target {target}")
    n = 1
    while recall(level, n, ratio, low) < target:
        n += 1
    return n


def save_tested(df: DataFrame, tag: str, test: str = "true") -> tuple[DataFrame, int]:
    """:func:`save`, and the number of rows that meet ``test``; one job."""
    seen = Observation()
    out = save(df.observe(seen, F.count(F.when(F.expr(test), 1)).alias("n")), tag)
    return out, int(seen.get["n"])


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` with the size of their node, without those that are alone."""
    sizes = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, ["tree", "node"])


def named(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """``rows`` with comp: their component by ``label`` (id, comp), or the document itself."""
    if label is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def mixed(large: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of those nodes in ``large`` that hold several components, with the number ``outside`` the most frequent one."""
    counts = named(large, label).groupBy("tree", "node", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("tree", "node").agg((F.sum("k") - F.max("k")).alias("outside")).filter("outside > 0")
    return large.join(main, ["tree", "node"])


def grow(rows: DataFrame, label: DataFrame | None, first: bool, small: int, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The last nodes below ``rows`` (sized, of the level below the roots) as rows (id, n, sig, tree, node, size, first), and (id, tree) of
    those that branched; size: 0 of small nodes; first: of the first trees, not tried yet.

    A large node ends where all its documents are in one component already (nothing is left to find there), and where at most
    ``small`` are outside the most frequent one, which then meet all the others."""
    done, sunk = [], []
    own = lambda df, size, new=first: df.select("id", "n", "sig", "tree", "node", size.cast("long").alias("size"), F.lit(new).alias("first"))
    in_large = label is not None and not rows.filter(F.col("size") > small).isEmpty()
    for level in range(depth + 1):
        done.append(own(rows.filter(F.col("size") <= small), F.lit(0)))
        if not in_large:  # there are labels as soon as there is a large node
            break
        large, left = save_tested(mixed(rows.filter(F.col("size") > small), label), f"near-mixed{level}", f"outside > {small}")
        few = F.col("outside") <= small if level < depth else F.lit(True)
        done.append(own(large.filter(few), F.col("size"), first and level > 0))
        if not left or level == depth:
            break
        large = large.filter(~few).drop("size", "outside")
        sunk.append(large.select("id", "tree"))
        rows, in_large = save_tested(sized(branch(large)), f"near-level{level + 1}", f"size > {small}")
    return done, sunk


def dealt(large: DataFrame, small: int, pivots: int) -> DataFrame:
    """Blocks of the nodes in ``large``, all with their node's pivots: for first links only, as pairs of blocks don't meet.

    Pivots are the first by a hash, of about four times as many that another hash picks, so a node sends a bounded number.
    """
    block = F.expr(f"pmod(xxhash64(id, tree), cast(ceil(size / {small - pivots}) as int))")
    picked = large.filter(F.expr(f"pmod(xxhash64(id, tree, 2), size) < {4 * pivots}"))
    ranked = F.struct(F.xxhash64("id", "tree", F.lit(3)).alias("h"), "id", "n", "sig").alias("p")
    held = picked.select("tree", "node", "size", ranked).groupBy("tree", "node", "size").agg(F.slice(F.sort_array(F.collect_list("p")), 1, pivots).alias("p"))
    blocks = held.select("tree", "node", F.explode("p").alias("p"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / (small - pivots)) - 1).cast("int"))).alias("b"))
    rows = large.withColumn("b", block).select("id", "n", "sig", "tree", "node", "b").unionByName(blocks.select("p.id", "p.n", "p.sig", "tree", "node", "b")).dropDuplicates(["id", "tree", "node", "b"])
    return rows.withColumn("node", F.xxhash64("node", "b")).drop("b")


def block_pairs(large: DataFrame, small: int) -> DataFrame:
    """Groups of two blocks of the nodes in ``large`` (with comp), so that every document outside its node's most frequent
    component meets all documents of the node: ``small`` of those outside with ``small`` of all."""
    counts = large.groupBy("tree", "node", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("tree", "node").agg(F.max(F.struct("k", "comp")).alias("main"))
    rows = large.join(main, ["tree", "node"]).withColumn("out", F.col("comp") != F.col("main.comp")).withColumn("outside", F.col("size") - F.col("main.k")).filter("outside > 0")
    of = lambda seed, n: F.expr(f"pmod(xxhash64(id, tree, {seed}), cast(ceil({n} / {small}) as int))")
    every = lambda n: F.sequence(F.lit(0), (F.ceil(F.col(n) / small) - 1).cast("int"))
    own = ["id", "n", "sig", "tree", "node"]
    at_home = rows.withColumn("b", of(1, "size")).select(*own, "b", F.explode(every("outside")).alias("c"))
    visits = rows.filter("out").withColumn("c", of(2, "outside")).select(*own, "c", "size").select(*own, F.explode(every("size")).alias("b"), "c")
    met = at_home.unionByName(visits).dropDuplicates(["id", "tree", "node", "b", "c"])
    return met.select("id", "n", "sig", "tree", F.xxhash64("node", "b", "c").alias("node"))


def last_nodes(reps: DataFrame, rows: DataFrame, label: DataFrame | None, at: int, small: int, depth: int, ratio: float, low: float, target: float) -> DataFrame:
    """Rows (id, n, sig, tree, node, size, first) of all trees' last nodes of two or more documents; size: 0 of nodes up to ``small``.
    ``rows``: of the first ``at`` trees, sized; ``label``: the components that their large nodes have shown.

    Documents whose deepest node so far makes ``target`` need more trees than they had go on in as many more. The deepest counts for all
    trees of a document: those that end early do so by rare tokens, which its partners share less often. A pair of which one
    document stops has met the target by that one's nodes alone."""
    need = F.element_at(F.array(*[F.lit(needed(k, ratio, low, target)) for k in range(1, depth + 2)]), F.col("level").cast("int"))
    reps, first, out, sunk = reps.withColumn("had", F.lit(at)), 0, [], []
    while True:
        done, large = grow(rows, label, first == 0, small, depth)
        out += done
        sunk += large
        if not sunk:
            break
        deepest = functools.reduce(DataFrame.unionByName, sunk).groupBy("id", "tree").agg((F.count(F.lit(1)) + 1).alias("level")).groupBy("id").agg(F.max("level").alias("level"))
        reps = reps.drop("more").join(deepest, "id").withColumn("more", need - F.col("had")).filter("more > 0")
        reps = save(reps.select("id", "n", "sig", (F.col("had") + F.col("more")).alias("had"), "more"), "near-unmet")
        first, at = first + at, reps.agg(F.max("more")).first()[0]
        if not at:
            break
        rows = save(sized(save(paths(reps, first, at), "near-paths")), "near-level0")
    return functools.reduce(DataFrame.unionByName, out)


def _by_node(batches):
    """Frames of whole nodes from batches sorted by (tree, node), with the places where nodes begin."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        tree, node = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (node[1:] != node[:-1])) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        held = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last], [0, *cuts.tolist()]
    if held is not None and len(held):
        yield held, [0, len(held)]


def _alike(n, sig, comp, low: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Equal tokens of all pairs of a node, and which pairs may be linked and aren't in one component yet."""
    m = len(n)
    like = np.zeros((m, m), np.int16)
    for k in range(SKETCH):
        like += sig[:, k, None] == sig[None, :, k]
    fits = (like >= low * SKETCH) & (np.minimum(n[:, None], n) >= ratio * np.maximum(n[:, None], n)) & (comp[:, None] != comp)
    return like, fits


def _node_rows(pdf):
    return pdf["id"].to_numpy(), pdf["n"].to_numpy(), _sigs(pdf["sig"]), pdf["comp"].to_numpy()


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "node").sortWithinPartitions("tree", "node", "id")


def proposals(nodes: DataFrame, low: float, ratio: float) -> DataFrame:
    """Pairs (a, b), a < b: of each document the partners to try first, the hub of its node and the document most like it."""

    def run(batches):
        for pdf, cuts in _by_node(batches):
            ids, n, sig, comp = _node_rows(pdf)
            out = set()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                like, fits = _alike(n[a:b], sig[a:b], comp[a:b], low, ratio)
                degree = fits.sum(axis=0)
                if not degree.any():
                    continue
                strong = np.flatnonzero(degree >= 0.8 * degree.max())
                hub = strong[_mix(ids[a + strong].astype(np.uint64), 5).argmin()]
                closest = np.where(fits, like, -1).argmax(axis=1)
                for i in np.flatnonzero(fits.any(axis=1)):
                    for j in {int(hub) if fits[i, hub] else int(closest[i]), int(closest[i])}:
                        out.add((min(ids[a + i], ids[a + j]), max(ids[a + i], ids[a + j])))
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype=np.int64)

    return _dealt(nodes).mapInPandas(run, "a long, b long").distinct()


def undecided(nodes: DataFrame, low: float, ratio: float) -> DataFrame:
    """The rows of ``nodes`` that still have a possible partner in another component."""

    def run(batches):
        for pdf, cuts in _by_node(batches):
            _, n, sig, comp = _node_rows(pdf)
            keep = np.zeros(len(pdf), bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1 and (comp[a:b] != comp[a]).any():
                    keep[a:b] = _alike(n[a:b], sig[a:b], comp[a:b], low, ratio)[1].any(axis=1)
            yield pdf[keep]

    return _dealt(nodes).mapInPandas(run, nodes.schema)


def exhaust(rows: DataFrame, texts: DataFrame, width: int, percent: int, low: float) -> DataFrame:
    """Links (a, b) within the nodes of ``rows``: all possible pairs on their full sets, but for those joined meanwhile."""

    def run(batches):
        for pdf, cuts in _by_node(batches):
            ids, n, sig, comp = _node_rows(pdf)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                like, fits = _alike(n[a:b], sig[a:b], comp[a:b], low, percent / 100)
                name = {c: c for c in comp[a:b].tolist()}

                def root(c, name=name):
                    while name[c] != c:
                        c = name[c]
                    return c

                sets: dict[int, np.ndarray] = {}
                own = pdf["text"].iloc[a:b].tolist()
                i, j = np.nonzero(np.triu(fits))
                for k in np.argsort(-like[i, j], kind="stable"):
                    x, y = int(i[k]), int(j[k])
                    rx, ry = root(int(comp[a + x])), root(int(comp[a + y]))
                    if rx == ry:
                        continue
                    for q in (x, y):
                        if q not in sets:
                            sets[q] = shingles(own[q], width)
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        out.append((min(ids[a + x], ids[a + y]), max(ids[a + x], ids[a + y])))
                        name[max(rx, ry)] = min(rx, ry)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    ids, count = save_counted(rows.select("id").distinct(), "near-ids")
    filt = key_filter(ids, "id", "near-filter", count)
    used = maybe_in(texts, "id", filt).filter("__maybe").select("id", "text")
    return _dealt(rows.join(used, "id")).mapInPandas(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets have 100 * intersection >= percent * union. ``texts``: id, text."""

    def run(batches):
        for pdf in batches:
            keep, last, s = [], None, None
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, s = a, shingles(ta, width)
                t = shingles(tb, width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pdf.loc[keep, ["a", "b"]]

    ends, count = save_counted(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "near-ends")
    filt = key_filter(ends, "id", "near-filter", count)
    used = save(maybe_in(texts, "id", filt).filter("__maybe").select("id", "text"), "near-texts")
    with_a = pairs.join(used.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.join(used.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").mapInPandas(run, "a long, b long")


def contracted(links: DataFrame, label: DataFrame) -> DataFrame:
    """``links`` (a, b) as links a > b between the components that ``label`` (id, comp) gives their ends, each once, none within one."""
    of = lambda end: label.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    return ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(up: DataFrame) -> DataFrame:
    """``up`` (id, comp: a smaller id) followed to its end for every id, by pointer jumps."""
    while True:
        over = up.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        step = up.join(over, "comp", "left").select("id", F.coalesce("above", "comp").alias("comp"), F.col("above").isNotNull().alias("moved"))
        step, moved = save_tested(step, "near-labels", "moved")
        up = step.select("id", "comp")
        if not moved:
            return up


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links a - b but those that are their component's smallest, and that smallest."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place.reshape(2, -1)
    up = np.arange(len(ids))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(up, x, low)
        np.minimum.at(up, y, low)
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(up != np.arange(len(ids)))
    return ids[moved], ids[up[moved]]


def joined_at_once(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``links`` (a, b) but the smallest of each component, from one task."""

    def run(batches):
        held = [pdf[["a", "b"]].to_numpy(np.int64) for pdf in batches]
        both = np.concatenate([np.zeros((0, 2), np.int64), *held])
        yield pd.DataFrame(dict(zip(("id", "comp"), lowest(both[:, 0], both[:, 1]), strict=True)))

    return links.coalesce(1).mapInPandas(run, "id long, comp long")


def components(links: DataFrame, label: DataFrame | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(id, comp): for every end of ``links`` (a, b), and every id of ``label``, the smallest id that it reaches. ``label``: the components by
    earlier links, which needn't be given again.

    Each round hangs every id below its smallest neighbour, if that is smaller, and goes on with the links between the trees that come of it.
    An id that stays on top twice running has had all its neighbours in its tree, so two rounds at least halve the ids with links. At
    most ``at_once`` links need no more rounds: one task joins them."""
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    if label is None:
        label = ids.distinct().withColumn("comp", F.col("id"))
        links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        links = contracted(links, label)
        label = ids.unionByName(label.select("id")).distinct().join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    done = 0
    while True:
        links, left = save_tested(links, "near-links")
        if not left:
            return label
        few = left <= at_once
        up = save(joined_at_once(links), "near-labels") if few else roots(save(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), "near-labels"))
        root = up.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        label, done = label.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), done + 1
        if few:
            return label
        links = contracted(links, up)
        if done % 4 == 0:  # a plan of a few joins
            label = save(label, "near-labels")


def near_groups(docs: DataFrame, width: int = 3, percent: int = 85, trees: int = 6, small: int = 512, depth: int = 6, pivots: int = 32, target: float = 0.99) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``; needs doc_id and text."""
    rows = columns(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id())
    found = _numbered_groups(save(rows.select("rid", "doc_id", "text"), "near-rows"), width, percent, trees, small, depth, pivots, target)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _numbered_groups(rows: DataFrame, width: int, percent: int, trees: int = 6, small: int = 512, depth: int = 6, pivots: int = 32, target: float = 0.99) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and kept for the rows (rid, doc_id, text) of a saved table; rid is unique."""
    spark = rows.sparkSession
    small_batches(spark)
    sk = save(sketches(rows, width), "near-sketches")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))).alias("lead")
    classes = save(sk.groupBy("digest").agg(lead, F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
    reps = classes.filter("n > 0").select(F.col("lead.rid").alias("id"), "n", "sig")
    ratio = percent / 100
    low = ratio - 3 * (ratio * (1 - ratio) / SKETCH) ** 0.5
    texts = rows.select(F.col("rid").alias("id"), "text")
    confirmed = lambda pairs: settle(spark, "near-confirmed", lambda: confirm(pairs, texts, width, percent))
    joined = lambda links, label=None: settle(spark, "near-components", lambda: components(links, label))
    at = max(trees, needed(1, ratio, low, target))
    top = settle(spark, "near-roots", lambda: sized(save(paths(reps.withColumn("more", F.lit(at)), 0, at), "near-paths")))
    label, hot = None, top.filter(F.col("size") > small)
    if not hot.isEmpty():  # what large nodes show at once needn't branch
        label = joined(confirmed(save(proposals(named(dealt(hot, small, pivots), None), low, ratio), "near-pairs")))
    every = settle(spark, "near-nodes", lambda: last_nodes(reps, top, label, at, small, depth, ratio, low, target))
    if not every.isEmpty():
        nodes, large = every.filter("size = 0").drop("size"), every.filter("size > 0")
        none_large = large.isEmpty()
        tried = nodes.filter("first").drop("first")
        if not none_large:
            tried = tried.unionByName(dealt(large.filter("first").drop("first"), small, pivots))
        label = joined(confirmed(save(proposals(named(tried, label), low, ratio), "near-pairs")), label)
        open_nodes = named(nodes.drop("first"), label)
        if not none_large:
            pairs_of_blocks = save(block_pairs(named(large.drop("first"), label), small), "near-blocks")
            open_nodes = open_nodes.unionByName(named(pairs_of_blocks, label))
        rest = save(undecided(open_nodes, low, ratio), "near-undecided")
        if not rest.isEmpty():
            more = settle(spark, "near-confirmed", lambda: exhaust(rest, texts, width, percent, low))
            label = joined(more, label)
    # ids of rows to ids of documents: a component is named by its smallest lead
    leads = classes.select("digest", F.col("lead.rid").alias("id"), "lead", "n")
    if label is not None:
        leads = leads.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    else:
        leads = leads.withColumn("comp", F.col("id"))
    head = leads.groupBy("comp").agg(F.min("lead").alias("head"))
    leads = save(leads.join(head, "comp").select("digest", "head"), "near-heads")
    out = sk.select("rid", "doc_id", "n", "digest").join(leads, "digest")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, depth: int = 3) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays, with all their columns.

    ``depth`` is less than in ``near_groups``: at a lower threshold each level takes many more trees for the same recall.
    """
    box = Box(docs)
    kept = save(box.rows.select(box.struct().alias("row"), F.monotonically_increasing_id().alias("rid")), "near-rows")
    rows = kept.select("rid", box.inside("row", "doc_id").cast("long").alias("doc_id"), box.inside("row", "text").cast("string").alias("text"))
    gone = settle(docs.sparkSession, "near-gone", lambda: _numbered_groups(rows, width, percent, depth=depth).filter("not kept").select("rid"))
    tested = maybe_in(kept, "rid", key_filter(gone, "rid", "near-filter"))
    rows = tested.filter("not __maybe").select("row").unionByName(tested.filter("__maybe").join(gone, "rid", "left_anti").select("row"))
    return rows.select(*box.out("row"))
