"""Shared helpers: table access, the work folder and vectorised word scanning over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: One word, as every contract of this subpackage defines it (Java and Python dialect).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step looks at; bounds the memory of the scanning operators.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; below the warehouse, which is shared too, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-work"
    path = f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


_folders: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_work() -> None:
    """Removes the work folders of this process, as far as its session still runs; results must not be read after it."""
    while _folders:
        spark, path = _folders.pop()
        if spark.sparkContext._jsc is not None:
            try:
                to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
            except Exception:  # the virtual machine is gone: the folder stays
                return


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table and read back: cuts lineage and survives lost executors.

    The driver collects its garbage then, so that Spark removes the shuffle files of finished steps,
    and returns what it freed.
    """
    df.write.mode("overwrite").parquet(path)
    driver_gives_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """This process returns its free memory to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give:
        give(0)


#: Per cent of the driver's heap that may stay free after a whole collection; 70 is Java's own value.
HEAP_FREE = "40"


def driver_gives_back(spark: SparkSession) -> None:
    """The driver collects its garbage and returns free memory: of its heap, of native code, of its Python.

    Planning hundreds of stages leaves much of each in hundreds of threads, which no later collection
    returns. A virtual machine without these commands keeps it; results do not depend on it.
    """
    from py4j.protocol import Py4JError

    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        made = new(kind, len(values))
        for i, x in enumerate(values):
            made[i] = x
        return made

    def ask(bean: str, command: str, *values: str) -> None:
        at = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
        kinds = array(jvm.String, *["java.lang.String"] * len(values))
        # Through the interface, as the server's own class is closed to callers.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        with contextlib.suppress(Py4JError):
            invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, at, command, array(jvm.Object, *values), kinds))

    ask("HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", HEAP_FREE)
    jvm.System.gc()
    ask("DiagnosticCommand", "systemTrimNativeHeap")
    trim()


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink before a step that needs memory beside them.

    A few rows a core are dealt out, each of which asks the virtual machine it meets; nothing depends on
    whether all are reached.
    """
    rows = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, rows, 1, rows).selectExpr("java_method('java.lang.System', 'gc') AS g").where("g IS NULL").count()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches; then the worker, which serves further tasks, returns its free memory."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def text_slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut an Arrow batch into row ranges ``(first, last, bytes, offsets)`` of about ``limit`` bytes.

    ``bytes`` is a uint8 view of the range's UTF-8 and ``offsets`` its row starts, so that a null
    is an empty range. A row longer than ``limit`` is a range of its own and is never cut.
    """
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    buffers = col.buffers()
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one, by BLAKE2.
LONG_WORD = 256
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below at least ``n``."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE & _MASK, np.uint64)
            up[0] = 1
            down = np.full(size, _INV, np.uint64)
            down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
        if size <= 16 << 20:
            _powers[0] = have
    return have


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of ``values[start:end]``, ranges of mixed 64-bit values, by one prefix sum."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def scan_words(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """Words of all rows of a range: byte starts, byte ends, row of each word, words before each row.

    Row borders cut words. The last item has one entry more than there are rows.
    """
    space = _SPACE[data]
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~space
    starts = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
    starts[inner] |= word[1:-1][inner]
    ends[inner - 1] |= word[1:-1][inner - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    before = np.searchsorted(s, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    return s, e, row, before


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words ``data[s:e]``: a chain of bijective mixing steps, eight bytes each.

    A polynomial modulo a power of two would let long words of few letters collide whatever its base.
    """
    import hashlib

    if lower:
        data = _LOWER[data]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = e - s
    with np.errstate(over="ignore"):
        h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
        h = mix(h ^ (eight[s] & _PART[np.minimum(n, 8)]))
        at = np.flatnonzero((n > 8) & (n <= LONG_WORD))
        for k in range(8, LONG_WORD, 8):
            if not len(at):
                break
            h[at] = mix((h[at] ^ (eight[s[at] + k] & _PART[np.minimum(n[at] - k, 8)])) * np.uint64(0x9E3779B97F4A7C15))
            at = at[n[at] > k + 8]
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]], digest_size=8).digest(), "little")
    return h
