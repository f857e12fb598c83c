"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to ``order`` is counted from a sample of labelled
texts and frozen. Escapes follow method C: in a context seen n times with d distinct successors, a
successor seen c times has probability c / (n + d) and the escape d / (n + d); below order 0 all 256
bytes are equal. A context that the language never showed is skipped at no cost. The code length of
a text is the sum over all of its bytes, contexts never reaching over the text's start; the language
with the shortest code wins.

As the statistics are frozen, the cost of a byte depends only on the ``order + 1`` bytes that end
there. The trees of all languages are therefore compiled into one hash table a level, with a row of
costs (one per language) for each successor seen and for each escape, and texts are scored by numpy
gathers: a byte looks up its longest context first and goes down a level with the escape costs added.

Sample (the documented bound): of each language, the ``TRAIN_DOCS`` different texts with the smallest
hashes, whole. Prediction reads whole texts.

Null texts and texts without a letter get ``und`` with score 0; so does everything when no language
could be learned. Score: the posterior of the winner under equal priors, with code lengths divided
by the square root of the text's bytes, which keeps it from saturating. Ties go to the smaller label.
Repeated rows are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, table, text_slices, tidy

ORDER = 4
#: Bytes scored at once.
STEP = 1 << 18
TRAIN_DOCS = 300
UND = "und"


class ByteTrees:
    """Frozen PPM statistics of several languages."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs = sorted(k for k, v in samples.items() if any(v))
        self.order = order
        self.levels: list[tuple] = []
        k = len(self.langs)
        counts = [self._counts(samples[lang]) for lang in self.langs]
        below = None
        for n in range(order + 1):
            keys = np.unique(np.concatenate([c[n][0] for c in counts])) if k else np.zeros(0, np.uint64)
            ctxs = np.unique(keys >> np.uint64(8))
            cost = np.zeros((len(keys), k))
            esc = np.zeros((len(ctxs), k))
            at = np.searchsorted(ctxs, keys >> np.uint64(8))
            for j, c in enumerate(counts):
                have, times = c[n]
                where = np.searchsorted(keys, have)
                per = np.zeros(len(keys))
                per[where] = times
                total = np.bincount(at, per, len(ctxs))
                kinds = np.bincount(at, per > 0, len(ctxs))
                seen = total > 0
                esc[seen, j] = -np.log2(kinds[seen] / (total + kinds)[seen])
                down = 8.0 if n == 0 else self._walk(below, keys & np.uint64((1 << (8 * n)) - 1), n - 1, j)
                cost[:, j] = np.where(per > 0, -np.log2(np.maximum(per, 1) / np.maximum(total + kinds, 1)[at]), esc[at, j] + down)
            below = [*(below or []), (keys, cost, ctxs, esc)]
        for keys, cost, ctxs, esc in below or []:
            self.levels.append((*_hashed(keys, cost), *_hashed(ctxs, esc)))

    def _counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each order n, the n + 1 bytes that occur (first byte highest) and how often."""
        out = [[] for _ in range(self.order + 1)]
        for t in texts:
            b = np.frombuffer(t.encode(), np.uint8).astype(np.uint64)
            for n in range(min(self.order, len(b) - 1) + 1 if len(b) else 0):
                key = np.zeros(len(b) - n, np.uint64)
                for i in range(n + 1):
                    key = key << np.uint64(8) | b[i : len(b) - n + i]
                out[n].append(key)
        return [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in out]

    @staticmethod
    def _walk(below: list, keys: np.ndarray, n: int, j: int) -> np.ndarray:
        """Cost for language j of keys of n + 1 bytes, from the levels compiled so far."""
        cost = np.zeros(len(keys))
        todo = np.arange(len(keys))
        while n >= 0:
            have, val, ctxs, esc = below[n]
            k = keys[todo] & np.uint64((1 << (8 * (n + 1))) - 1)
            i = np.minimum(np.searchsorted(have, k), len(have) - 1)
            hit = have[i] == k
            cost[todo[hit]] += val[i[hit], j]
            todo, k = todo[~hit], k[~hit]
            c = k >> np.uint64(8)
            i = np.minimum(np.searchsorted(ctxs, c), len(ctxs) - 1)
            cost[todo] += np.where(ctxs[i] == c, esc[i, j], 0.0)
            n -= 1
        cost[todo] += 8.0
        return cost

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each row of a byte range under each language."""
        rows = len(offs) - 1
        out = np.zeros((rows, len(self.langs)))
        width = self.order
        for a in range(0, len(data), STEP):
            b = min(len(data), a + STEP)
            pad = np.zeros(b - a + width, np.uint64)
            lo = max(0, a - width)
            pad[width - (a - lo) :] = data[lo:b]
            key = pad[: b - a].copy()
            for i in range(1, width + 1):
                key <<= np.uint64(8)
                key |= pad[i : i + b - a]
            r0, r1 = np.searchsorted(offs, [a, b - 1], side="right") - 1
            edges = np.clip(offs[r0 : r1 + 2], a, b)
            begin = offs[r0 : r1 + 1]
            short = [np.unique(s[(s >= a) & (s < np.minimum(b, offs[r0 + 1 : r1 + 2]))]) - a for s in (begin + n for n in range(width))]
            slots, vals, eslots, evals = self.levels[width]
            at = _find(slots, key & np.uint64((1 << (8 * (width + 1))) - 1))
            early = np.concatenate(short) if short else np.zeros(0, np.int64)
            at[early] = -1
            cost = vals[at]
            miss = at < 0
            miss[early] = False
            todo = np.flatnonzero(miss)
            cost[todo] += evals[_find(eslots, key[todo] >> np.uint64(8) & np.uint64((1 << (8 * width)) - 1))]
            for n in range(width - 1, -1, -1):
                todo = np.concatenate([todo, short[n]])
                if not len(todo):
                    continue
                k = key[todo] & np.uint64((1 << (8 * (n + 1))) - 1)
                slots, vals, eslots, evals = self.levels[n]
                at = _find(slots, k)
                cost[todo] += vals[at]
                todo, k = todo[at < 0], k[at < 0] >> np.uint64(8)
                cost[todo] += evals[_find(eslots, k)]
            cost[todo] += 8.0
            full = np.flatnonzero(np.diff(edges))
            out[r0 + full] += np.add.reduceat(cost, edges[full] - a, axis=0, dtype=np.float64)
        return out


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple:
    """An open hash table (slot keys, slot rows), and the values with a row of zeros for absent keys (-1)."""
    size = 1 << max(4, int(2 * len(keys)).bit_length())
    slot_key = np.zeros(size, np.uint64)
    slot_row = np.full(size, -1, np.int32)
    at = (mix(keys) & np.uint64(size - 1)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        free = slot_row[at[todo]] < 0
        cand = todo[free]
        first = np.unique(at[cand], return_index=True)[1]
        win = cand[first]
        slot_key[at[win]], slot_row[at[win]] = keys[win], win
        todo = np.setdiff1d(todo, win, assume_unique=True)
        at[todo] = (at[todo] + 1) & (size - 1)
    return (slot_key, slot_row), np.vstack([values, np.zeros((1, values.shape[1]))]).astype(np.float32)


def _find(slots: tuple, keys: np.ndarray) -> np.ndarray:
    """Row of each key, -1 where there is none."""
    slot_key, slot_row = slots
    size = len(slot_key)
    at = (mix(keys) & np.uint64(size - 1)).astype(np.int64)
    row = slot_row[at]
    out = np.where(slot_key[at] == keys, row, -1)
    todo = np.flatnonzero((out < 0) & (row >= 0))
    while len(todo):
        at[todo] = (at[todo] + 1) & (size - 1)
        row = slot_row[at[todo]]
        hit = slot_key[at[todo]] == keys[todo]
        out[todo[hit]] = row[hit]
        todo = todo[~hit & (row >= 0)]
    return out


def held_out() -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """Up to ``docs_per_lang`` different labelled texts of each language that are not held out, whole.

    Texts are drawn by a hash of their own: copies of a text, and rows with a null or repeated id, are
    one draw. A threshold a language on that hash lets through about twice the wanted number of texts,
    and a window keeps the wanted ones, so at most ``docs_per_lang`` rows a language reach the driver.
    """
    h = F.xxhash64(F.lit("langid"), "text").bitwiseAND(F.lit((1 << 30) - 1))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", h.alias("h"))
    limit = F.least(F.lit(float(1 << 30)), F.ceil(F.lit(float(1 << 30) * (2 * docs_per_lang + 20)) / F.greatest(F.col("kinds"), F.lit(1)))).cast("bigint")
    limits = rows.groupBy(F.col("lang").alias("l_")).agg(F.approx_count_distinct("h", 0.05).alias("kinds")).select("l_", limit.alias("limit_"))
    # One row a label is broadcast, less than the model, which has a column a label.
    drawn = rows.join(F.broadcast(limits), F.col("lang") == F.col("l_")).where("h < limit_").groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).select("lang", "nth", "text").collect(), key=lambda r: (r.lang, r.nth)):
        out.setdefault(r.lang, []).append(r.text)
    return out


TOLD = "struct<lang_pred: string, score: double, bits: double>"


def told(model: ByteTrees, spark: SparkSession, text: str = "text") -> F.Column:
    """Struct (lang_pred, score, bits a byte under that language; null where ``und``) of the whole ``text``.

    Only the text goes to Python and only the struct comes back, so other columns never leave the JVM.
    """
    shared = spark.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.field(0)], names=["text"])
            letters = batch.field(1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score, per = [], [], []
            for i, j, data, offs in text_slices(texts):
                letter = letters[i:j]
                names, sure, cost = np.full(j - i, UND, object), np.zeros(j - i), np.full(j - i, np.nan)
                if m.langs and letter.any():
                    bits = m.bits(data, offs)
                    size = np.maximum(np.diff(offs), 1)
                    gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(size)[:, None]
                    names[letter] = np.array(m.langs, object)[bits.argmin(axis=1)[letter]]
                    sure[letter] = (1 / np.exp2(-gap).sum(axis=1))[letter]
                    cost[letter] = (bits.min(axis=1) / size)[letter]
                lang.append(names)
                score.append(sure)
                per.append(cost)
            lang, score, per = (np.concatenate(x) if x else np.zeros(0) for x in (lang, score, per))
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per, pa.float64(), from_pandas=True)], names=["lang_pred", "score", "bits"]
            )

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return F.arrow_udf(run, TOLD)(F.struct(F.col(text).alias("text"), has_letter.alias("letter")))


def predict(docs: DataFrame, model: ByteTrees, *keep: F.Column) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score of the whole ``text``; one pass, no shuffle."""
    return docs.select(*keep, told(model, docs.sparkSession).alias("told_")).select("*", "told_.lang_pred", "told_.score").drop("told_")


def train(docs: DataFrame) -> ByteTrees:
    return ByteTrees(training_sample(docs))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs), F.col("doc_id"), held_out().alias("held_out"))
