"""Operator 4: line dedup that can be undone.

The exact side is a table of postings, one row for each key and document
that holds it; reference counts are its sums. Keys that reach `least`
documents are also put in cuckoo filters, one for each shard of the key
space, which screen lines before the exact join. Adding documents adds
postings and fingerprints; removing documents removes postings and, for
keys that fall below the limit, fingerprints. So the state after an
insertion and its deletion equals the state before. An insertion writes its
own postings beside those that are there, and new counts of repeated keys;
parts are put together when there are MOST_PARTS of them.

Keys are 16 bytes of BLAKE2b over the stripped, lower-cased line.

Defined results: null and empty texts are one empty line; a doc_id that
occurs in several rows is one document; rows with a null doc_id hold no
postings and lose nothing; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import pieces, small_batches, staged, table, texts

STRIP = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 1 << 16
#: Filters of more bytes than this aren't broadcast; each shard's postings are then sent to its filter, so many at a time.
FILTER_BYTES, GROUP_ROWS = 64 << 20, 1 << 18
SLOTS = 4
#: Tables of postings beside each other.
MOST_PARTS = 8


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    line = line.strip(STRIP).lower()
    if len(line) < LEAST_CHARS or (len(line) < 4 * LEAST_CHARS and len(line.decode("utf-8", "replace")) < LEAST_CHARS):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; add, remove and test for arrays of 16-byte keys."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.84)))))
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16) if slots is None else slots.reshape(-1, SLOTS).copy()
        self.buckets = len(self.slots)

    @staticmethod
    def hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64. Fingerprints from 1 to 65535, and hashes whose low bits name the first bucket."""
        return (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), keys[:, 0]

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket ^ textvec.mix(mark.astype(np.uint64)).astype(np.int64)) & (self.buckets - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark, h = self.hashed(keys)
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """False if a fingerprint found no place; the filter must then be rebuilt larger."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for b in (one, two):
                free = np.flatnonzero(self.slots[b] == 0)
                if len(free):
                    self.slots[b, free[0]] = mark
                    break
            else:
                b = one
                for kick in range(500):
                    at = (kick * 7 + b) % SLOTS
                    mark, self.slots[b, at] = int(self.slots[b, at]), mark
                    b = int(self._other(np.array([b]), np.array([mark], np.uint16))[0])
                    free = np.flatnonzero(self.slots[b] == 0)
                    if len(free):
                        self.slots[b, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; keys must have been added."""
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for b in (one, two):
                held = np.flatnonzero(self.slots[b] == mark)
                if len(held):
                    self.slots[b, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        size = max(len(keys), room, 1)
        while not (made := cls(size)).add(keys):
            size *= 2
        return made


def _pairs(keys: list[bytes] | pa.Array) -> np.ndarray:
    if isinstance(keys, pa.Array):
        keys = keys.to_pylist()
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def postings(docs: DataFrame) -> DataFrame:
    """(key, doc_id), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            ids, keys = [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                found = {line_key(x) for x in raw.split(b"\n")} - {None}
                keys += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field("doc_id").type)], ["key", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).filter("doc_id is not null").mapInArrow(run, f"key binary, doc_id {kind}").distinct()


def counted(rows: DataFrame) -> DataFrame:
    """Exact reference counts: key, n_docs, last_doc (the document that keeps its lines)."""
    return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard(n: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("shard")


def filters_of(keys: DataFrame, n_shards: int, room: int = 1) -> DataFrame:
    """(shard, n_keys, slots) of a table of distinct keys, with room for so many times as many."""

    def build(rows: pa.Table) -> pa.Table:
        made = CuckooFilter.of(_pairs(rows.column("key").to_pylist()), max(room * rows.num_rows, SHARD_KEYS // 8))
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "n_keys": pa.array([rows.num_rows], pa.int64()), "slots": pa.array([made.slots.tobytes()], pa.binary())})

    return keys.select(shard(n_shards), "key").groupBy("shard").applyInArrow(build, "shard int, n_keys long, slots binary")


@dataclass
class LineState:
    """Tables of the incremental state; a shard that is full gets a larger filter, and where all are, there are more shards."""

    parts: list[DataFrame]
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    least: int

    @property
    def postings(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    @classmethod
    def of(cls, docs: DataFrame, least: int = LEAST_DOCS) -> LineState:
        rows, _ = staged(postings(docs))
        counts, _ = staged(counted(rows).filter(F.col("n_docs") >= least))
        n = max(1, -(-counts.count() // SHARD_KEYS))
        made, _ = staged(filters_of(counts, n))
        return cls([rows], counts, made, n, least)

    def _after(self, parts: list[DataFrame], touched: DataFrame) -> LineState:
        """The state with these postings, of which only touched keys have new counts."""
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if len(parts) > MOST_PARTS:
            rows, _ = staged(rows)
            parts = [rows]
        new = counted(rows.join(touched, "key", "left_semi")).filter(F.col("n_docs") >= self.least)
        counts, _ = staged(self.counts.join(touched, "key", "left_anti").unionByName(new).select("key", "n_docs", "last_doc"))
        n = -(-counts.count() // SHARD_KEYS)
        if n > 2 * self.n_shards:
            made, _ = staged(filters_of(counts, n))
            return LineState(parts, counts, made, n, self.least)
        old, now = self.counts.select("key"), counts.select("key")
        change = now.join(old, "key", "left_anti").select("key", F.lit(True).alias("add")).unionByName(old.join(now, "key", "left_anti").select("key", F.lit(False).alias("add")))

        def update(held: pa.Table, rows: pa.Table) -> pa.Table:
            at = (held if held.num_rows else rows).column("shard")[0].as_py()
            add = np.array(rows.column("add").to_pylist(), bool)
            keys = _pairs(rows.column("key").to_pylist())
            n = held.column("n_keys")[0].as_py() if held.num_rows else 0
            total = n + int(add.sum()) - int((~add).sum())
            made = CuckooFilter(1, np.frombuffer(held.column("slots")[0].as_py(), np.uint16)) if n else CuckooFilter(max(total, SHARD_KEYS // 8))
            made.remove(keys[~add])
            slots = made.slots.tobytes() if made.add(keys[add]) else None
            return pa.table({"shard": pa.array([at], pa.int32()), "n_keys": pa.array([total], pa.int64()), "slots": pa.array([slots], pa.binary())})

        schema = "shard int, n_keys long, slots binary"
        made, _ = staged(self.filters.groupBy("shard").cogroup(change.select(shard(self.n_shards), "key", "add").groupBy("shard")).applyInArrow(update, schema))
        full = made.filter("slots is null").select("shard")
        if not full.isEmpty():
            own = counts.withColumn("shard", shard(self.n_shards)).join(full, "shard", "left_semi")
            made, _ = staged(made.filter("slots is not null").unionByName(filters_of(own, self.n_shards, 2)))
        return LineState(parts, counts, made, self.n_shards, self.least)

    def insert(self, docs: DataFrame) -> LineState:
        """The state with these documents too; ones it already has change nothing."""
        new, _ = staged(postings(docs).join(self.postings, ["key", "doc_id"], "left_anti"))
        return self._after([*self.parts, new.select("key", "doc_id")], new.select("key").distinct())

    def delete(self, ids: DataFrame) -> LineState:
        """The state without the documents of these doc_ids."""
        ids = ids.select("doc_id").distinct()
        gone, _ = staged(self.postings.join(ids, "doc_id", "left_semi").select("key").distinct())
        left, _ = staged(self.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
        return self._after([left], gone)

    def screened(self) -> DataFrame:
        """Postings that pass the filters: all of a repeated key's, and few others."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if not size:
            return self.postings.limit(0)
        if size > FILTER_BYTES:
            return self._screened_by_shard()
        held = {r["shard"]: r["slots"] for r in self.filters.collect()}
        sent = self.postings.sparkSession.sparkContext.broadcast(held)
        kind = self.postings.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter(1, np.frombuffer(v, np.uint16)) for k, v in sent.value.items()}
            for batch in batches:
                shards, keys = batch.column("shard").to_numpy(zero_copy_only=False), _pairs(batch.column("key"))
                passed = np.zeros(len(keys), bool)
                for k in np.unique(shards):
                    if k in filters:
                        at = np.flatnonzero(shards == k)
                        passed[at] = filters[k].contains(keys[at])
                yield batch.select(["key", "doc_id"]).filter(pa.array(passed))

        return self.postings.select("key", "doc_id", shard(self.n_shards)).mapInArrow(run, f"key binary, doc_id {kind}")

    def _screened_by_shard(self) -> DataFrame:
        """As screened, with each filter sent to the postings of its shard; large shards are dealt by document too."""

        def run(rows: pa.Table, held: pa.Table) -> pa.Table:
            if not held.num_rows or not rows.num_rows:
                return rows.select(["key", "doc_id"]).slice(0, 0)
            made = CuckooFilter(1, np.frombuffer(held.column("slots")[0].as_py(), np.uint16))
            return rows.select(["key", "doc_id"]).filter(pa.array(made.contains(_pairs(rows.column("key").to_pylist()))))

        rows = self.postings.select("key", "doc_id", shard(self.n_shards))
        deals, _ = staged(rows.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("long").alias("deals")))
        deals = F.broadcast(deals)
        rows = rows.join(deals, "shard").select("key", "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), "deals").alias("deal"))
        held = self.filters.join(deals, "shard").select("shard", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
        kind = self.postings.schema["doc_id"].dataType.simpleString()
        return rows.groupBy("shard", "deal").cogroup(held.groupBy("shard", "deal")).applyInArrow(run, f"key binary, doc_id {kind}")

    def dropped(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses."""
        hit = self.screened().join(self.counts, "key").filter(F.col("doc_id") != F.col("last_doc"))
        return hit.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def deduped(docs: DataFrame, state: LineState | None = None) -> DataFrame:
    """docs, with kept_text, n_lines and n_dropped."""
    state = state or LineState.of(docs)
    lost = state.dropped().withColumnRenamed("doc_id", "_doc").withColumnRenamed("keys", "_keys")
    joined = docs.join(lost, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    rest = [c for c in docs.columns if c != "text"]
    flat = joined.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_raw"), F.coalesce("_keys", F.array().cast("array<binary>")).alias("_keys"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_raw"):
            out, lines, gone = [], [], []
            for raw, keys in zip(batch.column("_raw").to_pylist(), batch.column("_keys").to_pylist(), strict=True):
                own = raw.split(b"\n")
                if keys:
                    keys = set(keys)
                    good = [x for x in own if line_key(x) not in keys]
                    out.append(b"\n".join(good))
                else:
                    good = own
                    out.append(raw)
                lines.append(len(own))
                gone.append(len(own) - len(good))
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), *columns], ["_raw", "n_lines", "n_dropped", *rest])

    schema = ", ".join(["_raw binary, n_lines long, n_dropped long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)])
    return small_batches(flat).mapInArrow(run, schema).withColumn("kept_text", F.col("_raw").cast("string")).drop("_raw")


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents without their dropped lines; those that held nothing else go. Same columns, whatever their names."""
    out = deduped(docs.select("doc_id", "text", F.struct("*").alias("_row"))).filter("n_dropped = 0 or length(trim(kept_text)) > 0")
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduped(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
