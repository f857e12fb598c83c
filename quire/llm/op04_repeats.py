"""Substring deduplication by Rabin-Karp hashes of every window of ``width`` words.

Each word of each text is hashed, and one prefix sum gives the hash of every window. A window whose
hash also starts earlier (smaller doc_id, or same document and earlier start) is repeated; the
maximal intervals that repeated windows cover are removed. Windows are judged on the input.

Only one shuffle carries windows. A task first compares its own windows, slice by slice: a window
that is not the slice's earliest of its hash is repeated for certain and goes no further, so a
passage or text of any frequency reaches a reducer once a slice at most. The others travel in runs
of neighbours: a window is dealt by the smallest hash of the ``GRAM``-word grams inside it, which
equal windows share and which changes only every few words, so a run pays for one key. Reducers
hold the windows of their keys as flat arrays and compare them by sorting. A last join brings the
intervals of a document to its text.

Null text has no words. A null doc_id comes after all others. Rows that share a doc_id are the same
document for "earlier"; equal rows get equal results. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rolling, scan_words, shuffle_partitions, table, text_slices, word_hashes

WIDTH = 20
GRAM = 6
SLICE = 8 << 20
NULL_ID = (1 << 63) - 1

RUN = "key bigint, doc bigint, crc bigint, start int, n int, hashes binary"


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def _earliest(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each window has the smallest (doc, start) of its hash."""
    order = np.lexsort((start, doc, h))
    hs = h[order]
    begin = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    lead = np.repeat(order[begin], np.diff(np.r_[begin, len(hs)]))
    out = np.empty(len(h), bool)
    out[order] = (doc[order] == doc[lead]) & (start[order] == start[lead])
    return out


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs, given where a new one begins."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.r_[first, len(breaks)])


def _batch(key, doc, crc, start, n, hashes):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), hashes], names=["key", "doc", "crc", "start", "n", "hashes"])


def _six_bytes(h: np.ndarray, lengths: np.ndarray):
    """A binary column with the low six bytes of each hash, ``lengths`` hashes a row."""
    import pyarrow as pa

    flat = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)
    offsets = np.r_[0, np.cumsum(lengths * 6)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def window_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Runs of windows to compare (hashes given), and intervals already known as repeated (hashes null)."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text", SLICE):
                rows = batch.slice(i, j - i)
                doc_of, crc_of = (rows.column(k).to_numpy() for k in (0, 1))
                s, e, row, before = scan_words(data, offs)
                if len(s) < width:
                    continue
                w = word_hashes(data, s, e)
                at = np.flatnonzero(row[: len(s) - width + 1] == row[width - 1 :])
                if not len(at):
                    continue
                h = rolling(w, at, at + width)
                grams = np.arange(len(s) - GRAM + 1)
                key = sliding_min(rolling(w, grams, grams + GRAM), width - GRAM + 1)[at]
                r = row[at]
                doc, crc, start = doc_of[r], crc_of[r], at - before[r]
                lead = _earliest(h, doc, start)
                gone = ~lead
                if gone.any():
                    g = np.flatnonzero(gone)
                    first, n = _runs(np.r_[True, np.diff(at[g]) != 1] | np.r_[True, np.diff(r[g]) != 0])
                    f = g[first]
                    yield _batch(mix(doc[f].view(np.uint64)).view(np.int64), doc[f], crc[f], start[f], n + width - 1, pa.nulls(len(f), pa.binary()))
                g = np.flatnonzero(lead)
                first, n = _runs(np.r_[True, (np.diff(at[g]) != 1) | (np.diff(r[g]) != 0) | (key[g][1:] != key[g][:-1])])
                f = g[first]
                for a in range(0, len(f), 1 << 17):
                    part, m = f[a : a + (1 << 17)], n[a : a + (1 << 17)]
                    own = h[g[first[a] : first[a] + m.sum()]]
                    yield _batch(key[part].view(np.int64), doc[part], crc[part], start[part], m, _six_bytes(own, m))

    src = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc"), "text")
    return src.mapInArrow(run, RUN)


def repeated_intervals(runs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, crc, start, stop) of words that repeated windows cover."""

    def run(batches: Iterator):
        import pyarrow as pa

        def out(doc, crc, start, stop):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["doc", "crc", "start", "stop"])

        parts = []
        for b in batches:
            key, doc, crc, start, n = (b.column(k).to_numpy() for k in range(5))
            h = b.column(5)
            known = h.is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield out(doc[known], crc[known], start[known], start[known] + n[known])
            here = ~known
            if not here.any():
                continue
            flat = h.filter(pa.array(here))
            ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
            six = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 6)
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six
            n = n[here]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            low = wide.reshape(-1).view(np.uint64)
            with np.errstate(over="ignore"):
                full = mix(np.repeat(key[here].view(np.uint64), n) * np.uint64(0x9E3779B97F4A7C15) + low)
            parts.append((full, np.repeat(doc[here], n), np.repeat(crc[here], n), (np.repeat(start[here], n) + inside).astype(np.int32)))
        if not parts:
            return
        h, doc, crc, start = (np.concatenate(x) for x in zip(*parts))
        del parts
        gone = np.flatnonzero(~_earliest(h, doc, start))
        if not len(gone):
            return
        doc, crc, start = doc[gone], crc[gone], start[gone]
        order = np.lexsort((start, crc, doc))
        doc, crc, start = doc[order], crc[order], start[order]
        first, n = _runs(np.r_[True, (np.diff(doc) != 0) | (np.diff(crc) != 0) | (np.diff(start) > 1)])
        last = first + n - 1
        for a in range(0, len(first), 1 << 18):
            f, z = first[a : a + (1 << 18)], last[a : a + (1 << 18)]
            yield out(doc[f], crc[f], start[f], start[z] + width)

    return runs.repartition(shuffle_partitions(runs.sparkSession), "key").mapInArrow(run, "doc bigint, crc bigint, start int, stop int")


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def keep_words(words: list[bytes], cuts: list) -> list[bytes]:
    """Words that no interval covers; intervals come sorted and may overlap."""
    out, at = [], 0
    for start, stop in cuts:
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    return out + words[at:]


def with_cuts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text and the sorted array ``cuts`` of (start, stop) to remove; null where none."""
    cuts = repeated_intervals(window_runs(docs, width), width)
    cuts = cuts.groupBy("doc", "crc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    src = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc"))
    return src.join(cuts.hint("shuffle_hash"), ["doc", "crc"], "left").select("doc_id", "text", "cuts")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Digest of what is left of each document."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                rows = []
                for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = (text or "").encode().split()
                    left = keep_words(words, [(c["start"], c["stop"]) for c in cuts]) if cuts else words
                    rows.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_cuts(docs, width).mapInArrow(run, KEPT)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 20 THEN range(0, len(ws) - 19) ELSE [] END) AS i FROM w
), h AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS g FROM p
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM h
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE again
), g AS (
  SELECT doc_id, list(k) AS ks, count(*) AS n FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN g.n IS NULL THEN ws ELSE [ws[j + 1] FOR j IN range(0, len(ws)) IF NOT list_contains(g.ks, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
