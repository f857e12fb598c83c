"""N-gram Jaccard join with a count-vector R-tree, and the components its links make.

A document's set holds its distinct ``WIDTH``-word shingles (as 64-bit hashes); two documents link
when 100 * intersection >= 80 * union. Equal sets are one node, known by the hash of its set.

Co-location. All shingles stand in one total order: rare ones first, by hash, then the frequent
ones by rising count (frequent: seen often by the tasks' own counts over all documents; the list is
bounded and only steers cost, never results). Two sets that link share at least one of the first
n - ceil(0.8 n) + 1 shingles of each, so only nodes that share such a key meet, each key a group.

Count vectors. The shingles of a node are hashed into groups (``GROUPS`` in the tree, more for long
texts); the counts are a point. The overlap of two nodes is at most the sum of the smaller coordinates
of their points, and has to reach ceil(0.8 / 1.8 (n_a + n_b)); what passes is verified on the sets.

Stars first. In the groups of a few keys of each node, every node is held against ``STARS`` nodes of
the group, drawn leaders; verified links give provisional components. Then, ``ROUNDS`` times, in each
group that holds several components every node outside the largest is held against a drawn node of it,
another one in each group. That costs a pair a row and round, so copies in any number never become all
pairs, and what belongs to a large cluster joins it.

Then the tree. In each group that still holds several components, the points are packed into an
R-tree by sorted tiles and joined with themselves from the top down: a pair of boxes goes on only while
the summed minima of their upper corners, their sizes and their components allow a link. All pairs of
different components that pass are verified, so no link between components is lost. A pair is told
under the smallest key that the ``LEAST`` smallest keys of both have in common; under every key, where
they have none. A group of more than ``BLOCK_ROWS`` rows is cut into blocks (one component's rows among
themselves, where it is large) and each pair of blocks that could hold a link is a group of its own, so
no group lands in one task.

Components spread by smallest labels and pointer jumping, in tables, never on the driver.

Null, empty and wordless texts have empty sets and link with nothing; texts of fewer words have one
shingle, the whole sequence. A null doc_id takes part; a component has the smallest id of its members,
null where none has one. Ids may have any value. Repeated rows get a row each. An empty table gives
none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, rolling, scan_words, shuffle_partitions, table, text_slices, tidy, word_hashes, work_dir, written

WIDTH = 5
PERCENT = 80
GROUPS = 64
#: Rows of a leaf, and boxes below a box.
LEAF, FAN = 32, 4
#: Keys of a node that take part in the first stars, and their leaders of a group; rounds of stars after them.
FIRST_KEYS = 4
STARS = 2
ROUNDS = 2
#: Smallest keys of a node by which a pair that meets under several keys is told once.
LEAST = 16
#: Rows of a group that meet in one task; larger groups are cut into blocks.
BLOCK_ROWS = 8_192
#: A shingle counts as frequent from so many sightings; at most FREQUENT of them steer the order.
OFTEN = 60
FREQUENT = 200_000
#: Parts that the rows of a frequent key are dealt to where only equal rows have to meet.
SALTS = 4_096
#: Pairs that are looked at in one numpy step; rows that a task gathers before it looks at their groups.
STEP, HELD = 1 << 17, 1 << 15
#: Nodes, of some 50 bytes each, that are sent to all tasks to pick their texts.
BROADCAST_NODES = 200_000


def need(a, b):
    """Smallest overlap with which sets of a and b shingles link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def near(a, b):
    """Whether sets of a and b shingles may link by their sizes."""
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def prefix_length(n):
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and the number before each row."""
    s, e, row, before = scan_words(data, offs)
    n_rows = len(offs) - 1
    counts = np.diff(before)
    w = word_hashes(data, s, e, lower=True)
    at = np.flatnonzero(row[: max(0, len(s) - width + 1)] == row[width - 1 :]) if len(s) >= width else np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < width))
    h = np.r_[rolling(w, at, at + width), rolling(w, before[few], before[few + 1])]
    r = np.r_[row[at], few]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.r_[True, (np.diff(r) != 0) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(n_rows + 1))


def signatures(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        n = np.diff(before).astype(np.uint64)
        return mix(sums[before[1:]] - sums[before[:-1]] + n * np.uint64(0x9E3779B97F4A7C15))


def count_points(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts of each set's shingles in each group, a byte each; 255 stands for any larger count.

    A set of n shingles has n / 16 groups or up to twice as many, a power of two and ``GROUPS`` at least,
    so that long texts are told apart as well as short ones; a point is folded to fewer groups by adding up.
    """
    m = mix(h)
    ends = np.cumsum(n)
    out = []
    for a, b in zip(ends - n, ends):
        g = max(GROUPS, 1 << max(0, int(b - a - 1) >> 4).bit_length())
        counts = np.bincount((m[a:b] & np.uint64(g - 1)).astype(np.int64), minlength=g)
        out.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
    return out


def folded(points: list[bytes], groups: int) -> np.ndarray:
    """The points with ``groups`` groups, a row each; a saturated count stays without bound."""
    out = np.empty((len(points), groups), np.int32)
    size = np.fromiter(map(len, points), np.int64, len(points))
    for g in np.unique(size):
        at = np.flatnonzero(size == g)
        for x in range(0, len(at), max(1, (4 << 20) // int(g))):
            k = at[x : x + max(1, (4 << 20) // int(g))]
            got = np.frombuffer(b"".join([points[i] for i in k]), np.uint8).reshape(len(k), g // groups, groups)
            full = got == 255
            got = got.sum(axis=1, dtype=np.int32)
            if full.any():
                got[full.any(axis=1)] = 1 << 28
            out[k] = got
    return out


def may_link(i: np.ndarray, j: np.ndarray, points: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which pairs of rows (i, j) the sizes and the summed minima of the count vectors allow."""
    a, b = sizes[i], sizes[j]
    ok = near(a, b)
    at = np.flatnonzero(ok)
    for x in range(0, len(at), STEP >> 2):
        k = at[x : x + (STEP >> 2)]
        ok[k] = np.minimum(points[i[k]], points[j[k]]).sum(axis=1, dtype=np.int64) >= need(a[k], b[k])
    at = np.flatnonzero(ok & (np.minimum(a, b) > 16 * GROUPS))  # both points have more groups than the tree's
    if len(at):
        groups = np.fromiter((min(len(raw[x]), len(raw[y])) for x, y in zip(i[at], j[at])), np.int64, len(at))
        for g in np.unique(groups):
            some = at[groups == g]
            for x in range(0, len(some), max(1, (2 << 20) // int(g))):
                k = some[x : x + max(1, (2 << 20) // int(g))]
                rows, place = np.unique(np.r_[i[k], j[k]], return_inverse=True)
                fine = folded([raw[r] for r in rows], int(g))
                ok[k] = np.minimum(fine[place[: len(k)]], fine[place[len(k) :]]).sum(axis=1, dtype=np.int64) >= need(a[k], b[k])
    return ok


class CountTree:
    """An R-tree of points: leaves packed by sorted tiles, and levels of boxes over ``FAN`` boxes each.

    A box has the upper corner of its points and the least and most of their sizes and labels.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        tiles = list(self._tiles(points, sizes, np.arange(len(sizes)), 0))
        self.order = np.concatenate(tiles)
        ends = np.cumsum([len(t) for t in tiles])
        self.start, self.end = ends - [len(t) for t in tiles], ends
        level = [f.reduceat(x[self.order], self.start) for f, x in ((np.maximum, points), (np.minimum, sizes), (np.maximum, sizes), (np.minimum, labels), (np.maximum, labels))]
        self.levels = [level]
        while len(level[1]) > FAN:
            at = np.arange(0, len(level[1]), FAN)
            level = [f.reduceat(x, at) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level)]
            self.levels.append(level)

    def _tiles(self, points, sizes, at, depth):
        if len(at) <= LEAF:
            yield at
            return
        by = sizes[at] if depth == 0 else points[at, np.argmax(points[at].var(axis=0))]
        at = at[np.argsort(by, kind="stable")]
        yield from self._tiles(points, sizes, at[: len(at) // 2], depth + 1)
        yield from self._tiles(points, sizes, at[len(at) // 2 :], depth + 1)

    def _open(self, level: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of boxes may hold two points of different labels that link."""
        upper, least, most, low, high = level
        ok = (100 * most[a] >= PERCENT * least[b]) & (100 * most[b] >= PERCENT * least[a])
        ok &= ~((low[a] == high[b]) & (low[b] == high[a]) & (low[a] == low[b]))
        at = np.flatnonzero(ok)
        for x in range(0, len(at), STEP >> 2):
            k = at[x : x + (STEP >> 2)]
            ok[k] = np.minimum(upper[a[k]], upper[b[k]]).sum(axis=1, dtype=np.int64) >= need(least[a[k]], least[b[k]])
        return ok

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (the first not after the second) that are left when the tree meets itself."""
        top = len(self.levels[-1][1])
        a, b = np.triu_indices(top)
        for depth in range(len(self.levels) - 1, -1, -1):
            ok = self._open(self.levels[depth], a, b)
            a, b = a[ok], b[ok]
            if depth:
                n = len(self.levels[depth - 1][1])
                a, b = (np.repeat(a, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(a)), np.repeat(b, FAN * FAN) * FAN + np.tile(np.arange(FAN), len(b) * FAN))
                ok = (a < n) & (b < n) & (a <= b)
                a, b = a[ok], b[ok]
        return a, b


def row_pairs(start_a, end_a, start_b, end_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of pairs of ranges, i < j where a range meets itself; about ``STEP`` at a time."""
    many = (end_a - start_a) * (end_b - start_b)
    edge = np.r_[0, np.cumsum(many)]
    x = 0
    while x < len(many):
        y = max(x + 1, int(np.searchsorted(edge, edge[x] + STEP, side="right")) - 1)
        n = many[x:y]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat((end_b - start_b)[x:y], n)
        i = np.repeat(start_a[x:y], n) + k // width
        j = np.repeat(start_b[x:y], n) + k % width
        once = (np.repeat(start_a[x:y] != start_b[x:y], n)) | (i < j)
        yield i[once], j[once]
        x = y


def _nodes_and_counts(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: (doc_id, th, sig, n, point); of kind 1: shingles seen repeatedly in a slice, with counts."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                h, before = shingle_sets(data, offs)
                n = np.diff(before)
                sig = signatures(h, before).view(np.int64)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(j - i, np.int8)), rows.column(0), rows.column(1), pa.array(sig), pa.array(n.astype(np.int64)), pa.array(count_points(h, n), pa.binary())], names=["kind", "doc_id", "th", "sig", "n", "point"]
                )
                u, c = np.unique(h, return_counts=True)
                u, c = u[c > 2], c[c > 2]
                if len(u):
                    no = pa.nulls(len(u), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), no, no, pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], names=["kind", "doc_id", "th", "sig", "n", "point"])

    return docs.mapInArrow(run, "kind byte, doc_id bigint, th bigint, sig bigint, n bigint, point binary")


KEYS = "key bigint, id bigint, n int, early boolean, salt int"


def _keys(docs: DataFrame, frequent: np.ndarray, place: np.ndarray) -> DataFrame:
    """(key, id, n, early, salt) of each set's prefix; a set is listed once a slice. Frequent keys have a salt."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, place))

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        often, rank = shared.value
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                h, before = shingle_sets(data, offs)
                if not len(h):
                    continue
                n = np.diff(before)
                sig = signatures(h, before)
                row = np.repeat(np.arange(j - i), n)
                once = np.zeros(j - i, bool)
                once[np.unique(sig, return_index=True)[1]] = True
                once &= n > 0
                late = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    late = np.where(often[at] == h, rank[at], 0)
                order = np.lexsort((h, late, row))
                inside = np.arange(len(h)) - before[row]
                pick = order[(inside < prefix_length(n)[row]) & once[row]]
                r = row[pick]
                second = mix(h[pick] + np.uint64(0x51ED2701))
                by = np.lexsort((second, r))
                nth = np.arange(len(r)) - np.searchsorted(r[by], r[by])
                early = np.zeros(len(r), bool)
                early[by[nth < FIRST_KEYS]] = True
                salt = np.where(late[pick] > 0, 1 + (sig[r] % np.uint64(SALTS)).astype(np.int64), 0)
                for x in range(0, len(r), 1 << 17):
                    y = slice(x, x + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[pick[y]].view(np.int64)), pa.array(sig[r[y]].view(np.int64)), pa.array(n[r[y]].astype(np.int32)), pa.array(early[y]), pa.array(salt[y].astype(np.int32))], names=["key", "id", "n", "early", "salt"]
                    )

    return docs.select("text").mapInArrow(run, KEYS)


def _shared_keys(keys: DataFrame) -> DataFrame:
    """Distinct rows (key, id, n, early) whose key has another set of a size that could link, or is frequent."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        got = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(5)] for b in batches if b.num_rows]
        if not got:
            return
        key, sig, n, early, salt = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((sig, n, key))
        key, sig, n, early, salt = key[order], sig[order], n[order], early[order], salt[order]
        new = np.r_[True, (np.diff(key) != 0) | (np.diff(sig) != 0)]
        key, sig, n, early, salt = key[new], sig[new], n[new], early[new], salt[new]
        near = (key[1:] == key[:-1]) & (PERCENT * n[1:].astype(np.int64) <= 100 * n[:-1].astype(np.int64))
        keep = np.r_[near, False] | np.r_[False, near] | (salt > 0)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, sig, n, early)], names=["key", "id", "n", "early"])

    return keys.repartition(shuffle_partitions(keys.sparkSession), "key", "salt").mapInArrow(run, "key bigint, id bigint, n int, early boolean")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each row (key, id, n) with its group's leader of the turn."""
    leaders = rows.groupBy("key").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(turn))).alias("l"), F.count("*").alias("of")).where("of > 1").select("key", "l")
    met = rows.join(leaders, "key").where((F.col("id") != F.col("l.id")) & near(F.col("n"), F.col("l.n")))
    return met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"))


def _joining_pairs(rows: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b): each row (key, id, n, label) with a drawn node of its group's largest component, if not of it."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("of"))
    sized = rows.join(sizes, "label", "left").withColumn("of", F.coalesce("of", F.lit(1)))
    lead = F.max_by(F.struct("id", "n", "label"), F.struct("of", "label", F.xxhash64("id", "key", F.lit(turn))))
    leaders = sized.groupBy("key").agg(lead.alias("l"))
    met = rows.join(leaders, "key").where((F.col("label") != F.col("l.label")) & near(F.col("n"), F.col("l.n")))
    return met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and count vectors allow."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            raw = b.column(4).to_pylist() + b.column(5).to_pylist()
            sizes = np.r_[b.column(2).to_numpy(), b.column(3).to_numpy()].astype(np.int64)
            if n:
                yield b.select([0, 1]).filter(pa.array(may_link(np.arange(n), np.arange(n, 2 * n), folded(raw, GROUPS), sizes, raw)))

    one = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def _blocks(rows: DataFrame, most: int = 0) -> DataFrame:
    """``rows`` (key, id, n, label) with (x, y, own): the pair of blocks in which a row meets others, and its block.

    Groups of up to ``BLOCK_ROWS`` rows are one block. In larger ones, the rows of a component that has
    more than that are blocks of their own, the other rows are dealt by component; two blocks of one
    component alone do not meet.
    """
    most = most or BLOCK_ROWS
    large = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    few = rows.join(large, "key", "left_anti").select("*", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("own"))
    hot = rows.join(large, "key")
    own = hot.groupBy("key", "label").agg(F.count("*").alias("of"), F.first("rows").alias("rows"))
    whole = F.col("of") > most
    inside = F.when(whole, F.pmod(F.xxhash64("id"), F.ceil(F.col("of") / most))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("rows") / most)))
    block = F.xxhash64(F.when(whole, F.col("label")), inside)
    hot = hot.drop("rows").join(own.drop("rows"), ["key", "label"]).join(large, "key").select(*rows.columns, block.alias("own"), F.when(whole, F.col("label")).alias("sole"))
    blocks = hot.groupBy("key", "own").agg(F.min("sole").alias("sole"), F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = blocks.alias("a"), blocks.alias("b")
    fits = (100 * F.col("a.most") >= PERCENT * F.col("b.least")) & (100 * F.col("b.most") >= PERCENT * F.col("a.least"))
    pairs = a.join(b, F.col("a.key") == F.col("b.key")).where((F.col("a.own") <= F.col("b.own")) & fits & ~F.coalesce(F.col("a.sole") == F.col("b.sole"), F.lit(False)))
    pairs = pairs.select(F.col("a.key").alias("key"), F.col("a.own").alias("x"), F.col("b.own").alias("y"))
    sides = pairs.withColumn("own", F.explode(F.array_distinct(F.array("x", "y"))))
    return few.unionByName(hot.drop("sole").join(sides, ["key", "own"]).select(*few.columns))


def _tree_pairs(rows: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of different labels, of rows (key, id, n, label, point, least, x, y, own).

    Rows come sorted by group, so a task holds only the groups of one step at a time.
    """

    def told_here(key, least, i, j):
        """Whether a pair is told under this key: the smallest that both lists hold, any where they share none."""
        both = least[i][:, :, None] == least[j][:, None, :]
        smallest = np.where(both.any(axis=2), least[i], np.iinfo(np.int64).max).min(axis=1)
        return ~both.any(axis=(1, 2)) | (smallest == key[i])

    def candidates(new, alone, key, ids, n, label, own, raw, least):
        """Pairs of groups that begin where ``new``; ``alone``: the group is one block, not two that meet crosswise."""
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(new)]
        sizes = n.astype(np.int64)
        points = folded(raw, GROUPS)
        # One leaf where the group is small, else the tree's leaves; places are in ``order``.
        order = np.arange(len(new))
        small = (last - first <= LEAF) & (last - first > 1)
        parts = [(first[small], last[small], first[small], last[small])]
        for a, b in zip(first[last - first > LEAF], last[last - first > LEAF]):
            tree = CountTree(points[a:b], sizes[a:b], label[a:b])
            order[a:b] = a + tree.order
            i, j = tree.joined()
            parts.append((a + tree.start[i], a + tree.end[i], a + tree.start[j], a + tree.end[j]))
        found = []
        for i, j in row_pairs(*(np.concatenate(x) for x in zip(*parts))):
            i, j = order[i], order[j]
            ok = (label[i] != label[j]) & (alone[i] | (own[i] != own[j])) & near(sizes[i], sizes[j])
            i, j = i[ok], j[ok]
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            ok = may_link(i, j, points, sizes, raw)
            for a in range(0, len(i), STEP >> 3):
                b = np.flatnonzero(ok[a : a + (STEP >> 3)]) + a
                ok[b] = told_here(key, least, i[b], j[b])
            found.append(np.stack([low[ok], high[ok]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        held: list = []
        count = 0

        def flush(done: bool):
            nonlocal held, count
            t = pa.Table.from_batches(held).combine_chunks()
            key, x, y = (t.column(k).to_numpy() for k in (0, 1, 2))
            new = np.r_[True, (np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)]
            cut = len(key) if done else int(np.flatnonzero(new)[-1])  # the last group may go on
            rest = t.slice(cut)
            t = t.slice(0, cut)
            held, count = (rest.to_batches(), len(rest))
            if not cut:
                return None
            least = np.arange(cut * LEAST, dtype=np.int64).reshape(cut, LEAST) | np.int64(-1 << 62)  # places without a key: all different
            lists = t.column(8).combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            least[np.arange(LEAST) < size[:, None]] = lists.flatten().to_numpy()
            got = candidates(new[:cut], (x == y)[:cut], *(t.column(k).to_numpy() for k in (0, 3, 4, 5, 6)), t.column(7).to_pylist(), least)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"]) if len(got) else None

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count > HELD and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    src = rows.select("key", "x", "y", "id", "n", "label", "own", "point", "least").repartition(shuffle_partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return src.mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """(id, hashes) of the nodes of ``pairs``, made from a text each; at least once each.

    The nodes asked for are broadcast to the texts where they are few, by their count; else the texts
    are dealt to them.
    """

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                h, before = shingle_sets(data, offs)
                asked = batch.column(0).slice(i, j - i).to_numpy()
                good = []
                for g in np.flatnonzero(signatures(h, before).view(np.int64) == asked):
                    if asked[g] not in seen:
                        seen.add(asked[g])
                        good.append(g)
                yield pa.RecordBatch.from_arrays([pa.array(asked[good], pa.int64()), pa.array([h[before[g] : before[g + 1]].tobytes() for g in good], pa.binary())], names=["id", "hashes"])

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    asked = written(ids.join(nodes, "id").select("id", F.col("row.doc_id").alias("d"), F.col("row.th").alias("t")), f"{path}-asked")
    held = F.broadcast(asked) if asked.count() <= BROADCAST_NODES else asked.hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    return written(docs.join(held, same).select("id", "text").mapInArrow(run, "id bigint, hashes binary"), f"{path}-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets link."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            got = b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if got.num_rows:
                yield got

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, path: str) -> DataFrame:
    """(id, label): the smallest id reachable, for ids that have edges; ``edges`` is a written table."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{path}/both")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{path}/l0")
    n = 0
    while True:
        n += 1
        far = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        best = both.join(far, "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("lb"))
        step = labels.join(best, "id").select("id", "label", F.least("label", "lb").alias("l1"))
        jump = labels.select(F.col("id").alias("l1"), F.col("label").alias("l2"))
        step = step.join(jump, "l1", "left").select("id", F.least("l1", F.coalesce("l2", "l1")).alias("new"), "label")
        now = written(step, f"{path}/l{n}")
        labels = now.select("id", F.col("new").alias("label"))
        if now.where("new <> label").isEmpty():
            return labels


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    path = work_dir(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    scan = written(_nodes_and_counts(docs), f"{path}/scan")
    own = scan.where("kind = 0")
    often = scan.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "sig").limit(FREQUENT).orderBy("c", "sig").toArrow()
    order = often.column("sig").to_numpy().view(np.uint64)
    by = np.argsort(order)
    frequent, place = order[by], by.astype(np.int64) + 1
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    nodes = own.where("n > 0").groupBy(F.col("sig").alias("id")).agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.min("n").alias("n"), F.min("point").alias("point"))
    nodes = written(nodes, f"{path}/nodes")
    shared = written(_shared_keys(_keys(docs, frequent, place)), f"{path}/shared")

    early = shared.where("early").drop("early")
    pairs = _star_pairs(early, 0)
    for turn in range(1, STARS):
        pairs = pairs.unionByName(_star_pairs(early, turn))
    pairs = written(_bounded(pairs.distinct(), nodes), f"{path}/stars")
    links = written(_verified(pairs, _sets(docs, nodes, pairs, f"{path}/stars")), f"{path}/links")
    labels = components(links, f"{path}/c0")
    for turn in range(ROUNDS + 1):
        rows = shared.drop("early").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = rows.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
        rows = written(rows.join(mixed, "key", "left_semi"), f"{path}/rows{turn}")
        if turn < ROUNDS:
            pairs = written(_bounded(_joining_pairs(rows, labels, turn), nodes), f"{path}/joining{turn}")
            more = _verified(pairs, _sets(docs, nodes, pairs, f"{path}/joining{turn}"))
            links = written(links.unionByName(more), f"{path}/links{turn}")
            labels = components(links, f"{path}/joined{turn}")
    least = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST).alias("least"))  # keys of one document
    points = nodes.select("id", "point").join(least, "id")
    pairs = written(_tree_pairs(_blocks(rows).join(points, "id")), f"{path}/pairs")
    more = _verified(pairs, _sets(docs, nodes, pairs, f"{path}/pairs"))
    every = written(links.unionByName(more), f"{path}/every")
    labels = components(every, f"{path}/c1")
    named = nodes.select("id", "least").join(labels, "id", "left").select("id", "least", F.coalesce("label", "id").alias("label"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component")), "label").select(F.col("id").alias("sig"), "component")
    out = own.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
