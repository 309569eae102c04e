"""Token files: ids of whole texts in Simple-8b words.

A word has a 4-bit selector in its high bits and packs as many ids as fit in the other 60 at one of the widths of
``LAYOUT``. Selector 0 is the escape: the next word is one raw value, for those of over 60 bits. Ids are coded in
blocks of ``BLOCK``, each starting a new word, and a segment keeps where each block's words start, so a reader
decodes any block alone and many blocks at once. A file (Parquet, which gives commit and recovery) has one row for each
segment: the ids of the file before it, the documents' ids and lengths, the words and the block offsets; files and segments follow ascending doc_id.

Null text counts as empty (only the end id is written); null doc_ids come first; repeated rows are written
each; no rows give no segments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import columns, new_path, small_batches, with_null, without_null
from tidelog.llm.tokens import default_path, encoder, in_groups

#: Selector: (ids in a word, bits of each), fixed values of the format.
LAYOUT = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 0
BLOCK = 128
#: Ids after which a segment ends (a document isn't divided).
SEGMENT = 1 << 18
SCHEMA = "part int, before long, doc_ids array<long>, lengths array<long>, words binary, block_offsets array<int>"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of ``ids``, and at which word each block starts (and the last ends)."""
    v = ids.astype(np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int32)
    wide = v >> np.uint64(60) > 0
    pos = np.arange(blocks) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    choice = np.full(n, 14, np.int8)  # the best selector for a word that starts at each id
    tops_of = np.array([(1 << b) - 1 for b in sorted({b for _, b in LAYOUT.values()})], np.uint64)
    widths = np.array([*sorted({b for _, b in LAYOUT.values()}), 61], np.int8)
    bits = widths[np.searchsorted(tops_of, v)]
    left = np.minimum(BLOCK, n - np.arange(n) // BLOCK * BLOCK) - np.arange(n) % BLOCK
    reach = bits.copy()  # the widest of the ids from each place on, as many as a selector packs
    packs = {count: (sel, width) for sel, (count, width) in LAYOUT.items()}
    for count in range(1, max(packs) + 1):
        if count > 1:
            np.maximum(reach[: max(0, n - count + 1)], bits[count - 1 :], out=reach[: max(0, n - count + 1)])
        if count in packs:
            sel, width = packs[count]
            choice[(reach <= width) & (left >= count)] = sel
        if not np.any(reach[: max(1, n - count + 1)] <= 30) or (count >= 4 and not np.any(reach <= 60 // count)):
            break
    choice[wide] = ESCAPE
    counts = np.array([1] + [LAYOUT[s][0] for s in range(1, 15)])
    rows_pos, rows_block = [], []
    active = np.arange(blocks)
    while len(active):  # one word of every block at a time
        rows_pos.append(pos[active])
        rows_block.append(active)
        pos[active] += counts[choice[pos[active]]]
        active = active[pos[active] < end[active]]
    at, block = np.concatenate(rows_pos), np.concatenate(rows_block)
    order = np.lexsort((at, block))
    at, block = at[order], block[order]
    sel = choice[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if s == ESCAPE:
            continue
        count, width = LAYOUT[int(s)]
        own = np.flatnonzero(sel == s)
        for k in range(count):
            words[own] |= v[at[own] + k] << np.uint64(width * k)
    size = 1 + (sel == ESCAPE)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[place] = words
    out[place[sel == ESCAPE] + 1] = v[at[sel == ESCAPE]]
    first = np.searchsorted(block, np.arange(blocks))
    return out, np.append(place[first], len(out)).astype(np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of ``words`` (any whole blocks)."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    code = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # a raw value may look like an escape
        if code[i]:
            code[i + 1] = False
    at = np.flatnonzero(code)
    sel, w = sel[at], words[at]
    counts = np.array([1] + [LAYOUT[s][0] for s in range(1, 15)])[sel]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[start[own]] = words[at[own] + 1]
            continue
        count, width = LAYOUT[int(s)]
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[start[own] + k] = (w[own] >> np.uint64(width * k)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    return decode(words[offsets[k] : offsets[k + 1]])


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode the texts of ``docs`` and write token files below ``path``."""
    vocabulary = vocabulary or default_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encode_texts = encoder(vocabulary, drops_space=False)
        ids, doc_ids, lengths, held = [], [], [], 0

        def flush():
            words, offsets = encode(np.frombuffer(b"".join(ids), "<u4"))
            return pd.DataFrame({"part": [part], "before": [before], "doc_ids": [doc_ids], "lengths": [lengths], "words": [words.astype("<u8").tobytes()], "block_offsets": [offsets]})

        for pdf in batches:
            numbers = iter(pdf["doc_id"].astype(object).where(~pdf["__null"], None))
            for group in in_groups(pdf["text"].tolist()):
                for own in encode_texts(group):
                    ids.append(own + end)
                    doc_id = next(numbers)
                    doc_ids.append(None if doc_id is None else int(doc_id))
                    lengths.append(len(own) // 4 + 1)
                    held += lengths[-1]
                    if held >= SEGMENT:
                        yield flush()
                        before += held
                        ids, doc_ids, lengths, held = [], [], [], 0
        if ids:
            yield flush()

    rows = columns(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("__tie"))
    dealt = without_null(rows.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie"))
    dealt.mapInPandas(segments, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 for every document, from the files below ``path``."""
    files = spark.read.schema(SCHEMA).parquet(path)
    count = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.select("part", count.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    rows, at = [], 0
    for t in totals:  # a row per file
        rows.append((t["part"], at))
        at += t["n"]
    offsets = spark.createDataFrame(rows, "part int, at long")

    def documents(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = decode(np.frombuffer(r.words, "<u8")).astype("<u4")
                lengths = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"doc_id": r.doc_ids, "__null": r.nulls, "start": r.at + r.before + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})

    told = files.withColumn("nulls", F.transform("doc_ids", F.isnull)).withColumn("doc_ids", F.transform("doc_ids", lambda x: F.coalesce(x, F.lit(0).cast("long"))))
    return with_null(told.join(F.broadcast(offsets), "part").mapInPandas(documents, "doc_id long, __null boolean, start long, n_tokens long, ids_crc32 long"))  # a row per file


def token_digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    small_batches(docs.sparkSession)
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path)
