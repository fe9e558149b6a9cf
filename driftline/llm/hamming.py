"""All links of 64-bit fingerprints at a small Hamming distance, by the pigeonhole principle.

``keyed`` rows say under which keys a fingerprint is stored and probed; rows that share a key are
compared in one run. A run longer than ``BLOCK`` is cut into blocks, and every pair of its blocks
becomes a run of its own, so that no task holds an unbounded group. Of the links found in a run
only a spanning forest leaves it: that is all that components need, and there is never a row for
each pair of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a run that are compared at once, at most.
BLOCK = 2048


def blocked(keyed: DataFrame, block: int = BLOCK, count: str | None = None) -> DataFrame:
    """Long runs cut to pairs of blocks; adds ``run`` (key and block pair), ``part`` and ``cross``.

    A key with n rows has ceil(n / block) blocks, and a row goes to one run for each block of its
    key. Keys are counted with map-side partial sums. Only keys over the limit go through the
    join: their number is at most rows / block. ``count`` names a column that has a key's number of rows (or more) already.
    """
    if count is not None:
        wide = keyed.withColumn("blocks", F.when(F.col(count) > block, F.ceil(F.col(count) / block).cast("int")))
        return _runs(wide, [c for c in keyed.columns if c != "key"], ["node"])
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    return _runs(keyed.join(counts, "key", "left"), [c for c in keyed.columns if c != "key"], ["fp", "node"])


def _runs(keyed: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    own = F.pmod(F.xxhash64(*by), F.col("blocks")).cast("int")
    wide = keyed.withColumn("own", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(own))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return wide.withColumn("other", F.explode(others)).select(
        F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("run"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("part"),
        *columns,
    )


class Forest:
    """Union-find over the rows of one array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        parent = self.parent
        at = parent[x]
        while True:
            up = parent[at]
            if np.array_equal(up, at):
                break
            at = up
        parent[x] = at
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links joined two parts; in their order."""
        out = np.zeros(len(a), bool)
        ra, rb = self.roots(a), self.roots(b)
        parent = self.parent
        for k in np.flatnonzero(ra != rb).tolist():
            x, y = a[k], b[k]
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out[k] = True
        return out


def forest_of_runs(run: np.ndarray, part: np.ndarray, node: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], gather: int = 0, unique_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each run. ``run`` is sorted; ``linked`` says of row pairs whether they link.

    Shifts by 1, 2, ... compare each row with the later rows of its run, all runs together; pairs
    that are already joined are not compared. Rows of parts 1 and 2 meet only across parts. Later shifts
    wait for one another until there are ``gather`` pairs (as many as have been compared, at most).
    ``unique_pairs`` says that ``linked`` is dear and should see a pair of nodes once at a time.
    """
    n = len(run)
    unique, which = np.unique(node, return_inverse=True)
    forest, out_a, out_b = Forest(len(unique)), [], []
    left, shift, waiting, count, compared = np.arange(n), 0, [], 0, 0
    while True:
        shift += 1
        left = left[left + shift < n]
        left = left[run[left] == run[left + shift]]
        if len(left):
            a, b = left, left + shift
            pa_, pb_ = part[a], part[b]
            ok = ((pa_ == 0) & (pb_ == 0)) | ((pa_ | pb_) == 3) & (pa_ != pb_) & (pa_ != 0) & (pb_ != 0)
            ok &= node[a] != node[b]
            waiting.append((a[ok], b[ok]))
            count += len(waiting[-1][0])
        if waiting and (not len(left) or count >= min(gather, compared)):
            a, b = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            compared += count
            waiting, count = [], 0
            if len(a):
                apart = forest.roots(which[a]) != forest.roots(which[b])
                a, b = a[apart], b[apart]
                if unique_pairs:
                    u, v = which[a], which[b]
                    _, first = np.unique(np.minimum(u, v) * len(unique) + np.maximum(u, v), return_index=True)
                    a, b = a[first], b[first]
            if len(a):
                found = linked(a, b)
                a, b = a[found], b[found]
                new = forest.join(which[a], which[b])
                out_a.append(a[new])
                out_b.append(b[new])
        if not len(left):
            break
    empty = np.zeros(0, np.int64)
    return np.concatenate([*out_a, empty]), np.concatenate([*out_b, empty])


def whole_runs(batches, columns: int, rows: int = 40_000):
    """Column lists of bounded size that never cut a run; rows arrive sorted by run (column 0)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(tables):
        t = pa.Table.from_batches(tables)
        return [t.column(k) for k in range(columns)]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            run = t.column(0).to_numpy()
            cut = int(np.searchsorted(run, run[-1], "left")) if run[0] <= run[-1] else 0
            if cut:
                yield [t.column(k).slice(0, cut) for k in range(columns)]
            held = t.slice(cut).to_batches()
            count = t.num_rows - cut
    if held:
        yield flush(held)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(keyed: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """u, v: spanning links of the nodes whose fingerprints differ in at most ``most`` bits.

    ``keyed`` has long columns key, fp, node and boolean probe: a probing row is compared with the
    stored rows only, stored rows also with one another. Nodes are distinct by fingerprint.
    """

    def run(batches):
        for r, p, fp, node, probe in whole_runs(batches, 5):
            r, p, fp, node = r.to_numpy(), p.to_numpy(), fp.to_numpy().view(np.uint64), node.to_numpy()
            probe = np.asarray(probe.to_numpy(), bool)
            a, b = forest_of_runs(r, p, node, lambda i, j, fp=fp, probe=probe: (popcount(fp[i] ^ fp[j]) <= most) & ~(probe[i] & probe[j]))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    rows = blocked(keyed, block).select("run", "part", "fp", "node", "probe")
    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(run, "u long, v long")
