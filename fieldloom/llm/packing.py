"""Operator 3: best-fit packing after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most `capacity` of them.
So the instance is its histogram: counts of pieces by length, whatever the
number of documents. On it

* dominance reduction fixes bins for good: the longest piece alone where
  nothing fits beside it, with a partner that fills the bin exactly, or
  with the largest partner where no two pieces fit beside it, or where that
  partner is at least as long as the best two that would;
* the remainder is packed best fit, longest first, into the fullest bin
  that takes the piece; bins with equal room are handled as one group.

The plan is a bounded table of segments: the pieces of one length with
ranks from r0 to r1 go to consecutive sequences at one offset. Ranks come
from a count within each task of a stored table plus prefix sums over
tasks, so no group is sorted or gathered.

Defined results: null and empty texts are one token, the end mark; repeated
rows are packed as often as they occur; null doc_ids are carried through;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, staged, table, texts
from .tokens import TEXT_BYTES, encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1


@dataclass
class Plan:
    """bins: (lengths, how many bins hold exactly these); n_fixed: bins fixed by dominance."""

    bins: list[tuple[tuple[int, ...], int]]
    n_fixed: int

    @property
    def n_bins(self) -> int:
        return sum(n for _, n in self.bins)

    def segments(self) -> np.ndarray:
        """Rows (length, r0, r1, first sequence, offset), sorted by length and r0."""
        used: dict[int, int] = {}
        out, sequence = [], 0
        for lengths, n in self.bins:
            at = 0
            for x in lengths:
                r = used.get(x, 0)
                out.append((x, r, r + n, sequence, at))
                used[x] = r + n
                at += x
            sequence += n
        return np.array(sorted(out), np.int64).reshape(-1, 5)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that dominance fixes, and what is left."""
    left = {k: v for k, v in counts.items() if v}
    sizes, fixed = sorted(left), []

    def take(*own: int) -> None:
        """Fix as many bins of this kind as there are pieces for."""
        need: dict[int, int] = {}
        for x in own:
            need[x] = need.get(x, 0) + 1
        n = min(left[x] // k for x, k in need.items())
        fixed.append((own, n))
        for x, k in need.items():
            left[x] -= k * n
            if not left[x]:
                del left[x]
                sizes.pop(bisect_left(sizes, x))

    def least(n: int, but: int) -> list[int]:
        """The n shortest pieces besides one of length `but`."""
        out: list[int] = []
        for x in sizes:
            out += [x] * min(n - len(out), left[x] - (x == but))
            if len(out) >= n:
                break
        return out

    j = len(sizes) - 1
    while j >= 0:
        big = sizes[j]
        room = capacity - big
        small = least(3, big)
        if not small or small[0] > room:
            take(big)
        else:
            at = bisect_left(sizes, room + 1) - 1
            while at >= 0 and sizes[at] == big and left[big] == 1:
                at -= 1
            partner = sizes[at]
            exact = partner == room
            alone = len(small) < 2 or small[0] + small[1] > room
            pair = False
            if not exact and not alone and (len(small) < 3 or sum(small) > room):
                best, lo, hi = 0, 0, at
                while lo <= hi and best <= partner:
                    total = sizes[lo] + sizes[hi]
                    if total <= room:
                        best = max(best, total)
                        lo += 1
                    else:
                        hi -= 1
                pair = partner >= best
            if not (exact or alone or pair):
                j -= 1
                continue
            take(big, partner)
        j = min(j, len(sizes) - 1)
        while j >= 0 and j + 1 < len(sizes) and sizes[j + 1] <= big:
            j += 1
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; groups of equal bins move together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(own: tuple[int, ...], n: int, room: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((own, n))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                each = capacity // x
                if n >= each:
                    put((x,) * each, n // each, capacity - each * x)
                if n % each:
                    put((x,) * (n % each), 1, capacity - (n % each) * x)
                n = 0
                continue
            room = rooms[at]
            own, have = groups[room].pop()
            fit = min(room // x, n)
            k = min(have, n // fit)
            if have > k:
                groups[room].append((own, have - k))
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            put(own + (x,) * fit, k, room - fit * x)
            n -= k * fit
    return [g for room in rooms for g in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, left = reduced(counts, capacity)
    return Plan(fixed + best_fit(left, capacity), sum(n for _, n in fixed))


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the encoded documents: doc_id, piece, start, length, ids_crc32, task, rank (by length, within the task)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), {}, encoder(path).encode
        for batch in pieces(batches, "raw", TEXT_BYTES):
            rows = []
            ids, starts = encode(batch.column("raw"), END_ID)
            ids = ids.astype("<u4", copy=False)
            for d, doc in enumerate(batch.column("doc_id").to_pylist()):
                for k, at in enumerate(range(starts[d], starts[d + 1], capacity)):
                    n = min(capacity, int(starts[d + 1]) - at)
                    rows.append((doc, k, k * capacity, n, zlib.crc32(ids[at : at + n]), task, seen.get(n, 0)))
                    seen[n] = rows[-1][-1] + 1
            columns = zip(*rows, strict=True)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    cuts, _ = staged(cut(docs, path, capacity))
    tasks, _ = staged(cuts.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    made = spark.sparkContext.broadcast(plan(counts, capacity).segments())
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = made.value
        lengths = np.searchsorted(segments[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            lo, hi = lengths[length], lengths[length + 1]
            while (hi - lo > 1).any():  # the last segment of the length that begins at or before the rank
                mid = (lo + hi) // 2
                up = segments[np.minimum(mid, len(segments) - 1), 1] <= rank
                wide = hi - lo > 1
                lo, hi = np.where(wide & up, mid, lo), np.where(wide & ~up, mid, hi)
            own = segments[lo] if len(lo) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cuts.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
