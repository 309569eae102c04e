"""The pipeline on a small fixture, stage by stage against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm.common import shared_dir
from tidelog.llm.tokens import default_path

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
WEIGHTS = (5, 2, 1)


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.choice([1, 4, 30, 60, 200]))]
        if i % 5 == 0:
            words[len(words) // 2 :] = ["zqxvile", "zqxfoul", "zqxgrim"]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", "c", None])))
    clean = [r for r in rows if r[0] % 5]
    for k, r in enumerate(clean[:40]):  # exact copies but for white space
        rows.append((400 + k, r[1].replace(" ", " \n" if k % 2 else " "), "de", "b"))
    long = [r for r in clean if len(r[1].split()) >= 60]
    for k, r in enumerate(long[:30]):  # near copies on either side of the threshold
        words = r[1].split()
        for at in range(k % 4):
            words[7 * at + 3] = "other"
        rows.append((500 + k, " ".join(words[: len(words) - k % 7]), "en", "c"))
    rows += [(700, None, None, None), (701, "", "en", "a"), (702, "tiny " * 9000, "en", "b"), (703, rows[1][1], "en", "a"), (703, rows[1][1], "en", "a")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def by_exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: r[0]):
        best.setdefault(SPACE.sub(" ", r[1] or ""), r[0])
    return sorted(best.values())


def by_shingles(rows, width=5, percent=80):
    sets = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return [i for i in ids if root(i) == i]


def by_mixing(rows):
    """Texts as the mix takes them: each source's stream in md5 order, repeated up to its target."""
    streams = defaultdict(list)
    for r in rows:
        streams[r[3]].append(r)
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    count = {s: sum(len(WORD.findall(r[1] or "")) for r in streams[s]) for s in names}
    target, free, left = {}, list(names), float(sum(count.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * count[s]]
        for s in over or free:
            target[s] = 3 * count[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in target]
    out = []
    for s in names:
        need = round(target[s])
        own = sorted(streams[s], key=lambda r: hashlib.md5(f"17:{r[0]}".encode()).hexdigest())
        while need > 0:
            for r in own:
                words = WORD.findall(r[1] or "")
                if need > 0 and words:
                    out.append((r[0], r[1] if len(words) <= need else " ".join(words[:need])))
                    need -= len(words)
    return out


def test_pipeline(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen, frame = [rows], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert frame.columns == docs.columns
            seen.append([tuple(r) for r in frame.collect()])
    mild, single, apart, mixed = seen[1:]
    assert Counter(mild) == Counter(r for r in rows if "zqx" not in (r[1] or ""))
    assert sorted(r[0] for r in single) == by_exact(mild) and set(single) <= set(mild)
    assert sorted(r[0] for r in apart) == by_shingles(single) and set(apart) <= set(single)
    assert len(mild) > len(single) > len(apart)
    assert Counter((r[0], r[1]) for r in mixed) == Counter(by_mixing(apart))
    assert all(r[4] == len(r[1]) for r in mixed)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    packed = frame.toPandas()
    assert Counter(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect())) == want


def test_tables_that_nothing_reads_go(spark):
    import os

    from tidelog.llm import near_dedup

    top = shared_dir(spark).removeprefix("file://")
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(40)], "doc_id long, text string").withColumn("n", F.lit(1))
    before = set(os.listdir(top))
    kept = near_dedup.drop_near_copies(docs)
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(top)) - before)
    assert left == ["near-filter", "near-gone", "near-rows"]
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
