"""Secret scans: fixed patterns, and values in credential contexts judged by their guess cost.

Base kinds, leftmost and non-overlapping each: ``assign``, ``access``, ``hex`` (see ``BASE``). Spans
are those of the whole match, in code points, end exclusive.

Kind ``guess``: a value that stands after a credential word and a separator. Dynamic programming
over its prefixes finds the cheapest segmentation into known words, dates, repeats, keyboard walks
and brute-force spans; a segmentation of k parts costs the product of its parts' guesses times k!
plus MIN_PARTS ** (k - 1), as an attacker has to order the parts. A value whose cheapest cost reaches
``MIN_LOG10`` digits is a secret. Values that touch a base span are left to it. Values are judged
whole, whatever their length; the unit of a repeat may have any length and costs what it costs itself.

Known words are those of ``WORDS`` and, in any language, the words of the corpus itself: a run of
letters that stands outside such values in ``MIN_DOCS`` documents or more costs the number of all
(document, word) pairs over its own, which no smaller rank can exceed. Only words of values that are
secrets without them are counted: one pass over the texts finds these, one counts them (a bitmap of
fixed size leaves out most others, a join the rest), the third judges. The words that are both asked
for and seen often enough are held by each task, an entry a word.

Null and empty texts have no spans: counts 0, the hash of the empty text, spans ''. Repeated rows
each get a row; whole texts are read, and no text is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, work_dir, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|client_?secret|credentials?|auth|bearer)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"']+))""",
    re.I | re.A,
)
#: Digits of guesses from which a value counts as a secret.
MIN_LOG10 = 10.0
MIN_PARTS = 10_000.0
#: Four parts need 12 digits at least for their order alone, a secret by any tried limit; more are not told apart.
MOST_PARTS = 4

# Frequent passwords and words, by rank.
WORDS = """password 123456 qwerty letmein admin welcome login dragon master monkey shadow sunshine
princess football baseball superman batman trustno1 hello freedom whatever secret access root test
guest user default changeme example sample token null none true false undefined your mypassword the
and for with this that from have name value string key love money summer winter spring autumn monday
friday january february march april june july august september october november december""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Documents that hold a word outside credential values, from which it counts as a word.
MIN_DOCS = 2
BITMAP = 1 << 22
#: Words a task counts before it passes the counts on.
FLUSH = 100_000
LEET = str.maketrans("4@301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?\d\d?[-/._]?\d\d?)?|\d\d?[-/._]\d\d?[-/._](?:19|20)?\d\d")


def _neighbours() -> dict[str, set[str]]:
    at = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (x, y) in at.items() if abs(x - p) <= 1 and abs(y - q) <= 1} for a, (p, q) in at.items()}


NEAR = _neighbours()


def _same(v: str, a: int, b: int) -> int:
    """Length of the longest common start of v[a:] and v[b:]; a < b."""
    n, size, got = len(v), 16, 0
    while b + got < n and v[a + got : a + got + size] == v[b + got : b + got + size]:
        got += min(size, n - b - got)
        size *= 2
    while size > 1:
        size //= 2
        if b + got + size <= n and v[a + got : a + got + size] == v[b + got : b + got + size]:
            got += size
    return got


def repeats(v: str) -> list[tuple[int, int, int]]:
    """(start, end, unit length) of the longest stretches that repeat a unit of any length twice or more.

    A stretch with unit u holds two neighbours of the places 0, u, 2u, ..., which agree around; so
    n / u places are looked at for each u. Places inside a stretch whose unit divides u are passed by.
    """
    n, back = len(v), v[::-1]
    out: dict[tuple[int, int, int], None] = {}
    live: list[tuple[int, int, int]] = []
    for u in range(1, n // 2 + 1):
        live = [r for r in live if r[1] - r[0] > u]
        known = [r for r in live if u % r[2] == 0]
        p = 0
        while p + u < n:
            inside = max((e for s, e, _ in known if s <= p and p + u < e), default=0)
            if inside:
                p = max(p + u, (inside - u) // u * u)
                if p + u < inside:
                    p += u
                continue
            end = p + u + _same(v, p, p + u)
            start = p - _same(back, n - p - u, n - p) if p else 0
            if end - start >= 2 * u:
                if (start, end, u) not in out:
                    out[start, end, u] = None
                    live.append((start, end, u))
                p = max(p + u, (end - u) // u * u)
                if p + u < end:
                    p += u
            else:
                p += u
    return list(out)


def _ends(n: int, goes_on) -> list[int]:
    """End of the longest span from each place whose neighbours i, i + 1 all pass ``goes_on(i)``."""
    out = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if goes_on(i):
            out[i] = out[i + 1]
    return out


def _cased(word: str) -> float:
    """Times the guesses of a word for its capitals."""
    upper = sum(c.isupper() for c in word)
    return 1 if not upper else 2 if upper in (1, len(word)) else 2 ** min(upper, len(word) - upper, 10)


def word_spans(v: str, known: dict[str, float]) -> tuple[tuple[int, int, float], ...]:
    """(start, end, log10 of guesses) of the known words among a value's runs of letters."""
    runs = ((m, known.get(m.group().lower())) for m in LETTERS.finditer(v)) if known else ()
    return tuple((*m.span(), cost + math.log10(_cased(m.group()))) for m, cost in runs if cost is not None)


def _spans(v: str, words: tuple = ()):
    """For each place, the cheap spans that start there: (end, log10 of guesses)."""
    n = len(v)
    # Lower case and leet letters one by one: places stay as they are.
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in v)
    plain = low.translate(LEET)
    code = [ord(c) for c in v]
    lows = [ord(c) for c in low]
    equal = _ends(n, lambda i: v[i] == v[i + 1])
    walk = _ends(n, lambda i: low[i + 1] in NEAR.get(low[i], ()))
    rise, fall = _ends(n, lambda i: code[i + 1] - code[i] == 1), _ends(n, lambda i: code[i + 1] - code[i] == -1)
    turns = [0] * (n + 1)  # turns before a place
    for j in range(n):
        turns[j + 1] = turns[j] + (j > 1 and lows[j] - lows[j - 1] != lows[j - 1] - lows[j - 2])
    runs = sorted((r for r in repeats(v) if r[2] > 1), reverse=True)
    active: list[tuple[int, int, int]] = []
    given: dict[int, tuple[int, float]] = {i: (j, cost) for i, j, cost in words}
    for i in range(n):
        out: list[tuple[int, float]] = [given[i]] if i in given else []

        def add(j: int, guesses: float) -> None:
            out.append((j, math.log10(max(guesses, 2))))

        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(low[i:j]) or (RANK.get(plain[i:j]) or 0) * 4
            if rank:
                add(j, rank * _cased(v[i:j]))
        m = DATE.match(v, i)
        if m:
            add(m.end(), 365.0 * (120 if m.end() - i > 4 else 0.33) * (4 if not m.group().isdigit() else 1))
        if equal[i] - i >= 3:
            add(equal[i], 12.0 * (equal[i] - i))
        while runs and runs[-1][0] <= i:
            active.append(runs.pop())
        active = [r for r in active if r[1] - i >= 2 * r[2]]
        for _, e, u in active:
            times = (e - i) // u
            unit = min(float(u), guess_log10(v[i : i + u])) if u > 2 else float(u)
            out.append((i + times * u, unit + math.log10(times)))
        j = walk[i]
        if j - i >= 3:
            add(j, 47.0 * (j - i) * 4.0 ** min(turns[j] - turns[i + 2], 20))
        j = max(rise[i], fall[i])
        if j - i >= 3:
            add(j, 20.0 * (j - i))
        yield out


@lru_cache(maxsize=20_000)
def guess_log10(value: str, words: tuple = ()) -> float:
    """Digits of the number of guesses that the cheapest segmentation into at most MOST_PARTS parts needs.

    Time is in proportion to the length but for the search of repeats (n log n): each place has few
    cheap spans, and of all brute-force spans that end at a place only the best start counts, one
    number for each count of parts.
    """
    n = len(value)
    if not n:
        return 0.0
    best = [array("d", [math.inf]) * (n + 1) for _ in range(MOST_PARTS + 1)]  # by parts and place: log10 of the product
    best[0][0] = 0.0
    brute = [math.inf] * MOST_PARTS  # least of best[k][i] - i so far
    spans = _spans(value, words)
    for i in range(n + 1):
        for k in range(MOST_PARTS):
            if brute[k] + i < best[k + 1][i]:
                best[k + 1][i] = brute[k] + i
        if i == n:
            break
        out = next(spans)
        for k in range(MOST_PARTS):
            before = best[k][i]
            if before < math.inf:
                brute[k] = min(brute[k], before - i)
                for j, cost in out:
                    if before + cost < best[k + 1][j]:
                        best[k + 1][j] = before + cost
    return min(max(best[k][n] + math.lgamma(k + 1) / math.log(10), (k - 1) * math.log10(MIN_PARTS)) for k in range(1, MOST_PARTS + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, base: list[tuple[int, int, int]], known: dict[str, float] = {}, least: float = MIN_LOG10) -> list[tuple[int, int, int]]:  # noqa: B006
    """Values in credential contexts that the base kinds leave and that cost enough guesses."""
    out = []
    for i, j in values(text):
        if any(a < j and b > i for a, _, b in base) or guess_log10(text[i:j]) < least:
            continue
        words = word_spans(text[i:j], known)
        if not words or guess_log10(text[i:j], words) >= least:
            out.append((i, 3, j))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in credential contexts."""
    if not (":" in text or "=" in text or " is " in text or " IS " in text or " Is " in text):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        group = next(g for g in (1, 2, 3) if m[g] is not None)
        i, j = m.span(group)
        while j > i and text[j - 1] in ".,;:!?)]}":
            j -= 1
        if j > i:
            out.append((i, j))
    return out


def all_spans(text: str | None, known: dict[str, float] = {}) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:  # noqa: B006
    base = base_spans(text or "")
    return base, sorted(base + guess_spans(text or "", base, known))


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) % BITMAP


def asked_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words of the values that are secrets as long as no word of the corpus is known, with their bits."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = set()
            for t in batch.column(0).to_pylist():
                for i, _, j in guess_spans(t or "", base_spans(t or "")):
                    found.update(w.lower() for w in LETTERS.findall(t[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([_bit(w) for w in found], pa.int32())], names=["word", "bit"])

    return docs.select(text).mapInArrow(run, "word string, bit int").distinct()


def known_words(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """log10 of the guesses of the corpus's own words, as far as its values ask for them."""
    here = work_dir(docs.sparkSession)
    asked = written(asked_words(docs, text), f"{here}/asked")
    bits = asked.select("bit").distinct().toArrow().column("bit").to_numpy()
    if not len(bits):
        return {}
    import numpy as np

    bitmap = np.zeros(BITMAP, bool)
    bitmap[bits] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        marks = held.value

        def rows(seen: Counter):
            found = [(w, n) for w, n in seen.items() if marks[(b := _bit(w)) >> 3] & (128 >> (b & 7))]
            cols = [w for w, _ in found] + [None], [n for _, n in found] + [seen.total()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                at, rest = 0, []
                for i, j in values(t):
                    rest.append(t[at:i])
                    at = j
                seen.update(set(LETTERS.findall("\n".join([*rest, t[at:]]).lower())))
                if len(seen) > FLUSH:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    counts = docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.when(F.col("word").isNull(), F.col("n"))
    counts = written(counts.join(asked.select(F.col("word").alias("w")), F.col("word") == F.col("w"), "left").where("word IS NULL OR w IS NOT NULL").drop("w"), f"{here}/counts")
    every = counts.agg(F.max(total)).first()[0] or 1
    held.unpersist()
    often = counts.where((F.col("n") >= MIN_DOCS) & F.col("word").isNotNull()).toArrow().to_pydict()
    return {w: math.log10(max(every / n, 2)) for w, n in zip(often["word"], often["n"])}


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each row."""
    held = docs.sparkSession.sparkContext.broadcast(known_words(docs))

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = []
                for text in b.column(1).to_pylist():
                    base, spans = all_spans(text, held.value)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def redacted(text: str | None, mark: str = "[SECRET]", known: dict[str, float] = {}) -> str | None:  # noqa: B006
    """``text`` with each maximal run of overlapping spans replaced."""
    if not text:
        return text
    out, end = [], 0
    for i, _, j in all_spans(text, known)[1]:
        if i >= end:
            out += [text[end:i], mark]
        end = max(end, j)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; the columns stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(known_words(docs, text))

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                new = pa.array([redacted(t, known=held.value) for t in b.column(at).to_pylist()], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
