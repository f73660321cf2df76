"""Operator 10: language-model scores by a probabilistic suffix tree over words.

The root is the add-one-half unigram distribution. Every sequence of two to
DEPTH + 1 words that occurs LEAST_COUNT times in the training texts is
counted, however large they are. A context stays where its next-word
distribution diverges from its longest kept suffix by enough (expected gain
in nats, over GAIN for each symbol it would store). Kept distributions are
smoothed by absolute discounts; the mass they leave goes to the shorter
suffix, scaled to sum to one. A token is scored by the longest kept suffix
of what stands before it.

Such a score is a sum of one number for each sequence in a text. A kept
context adds its factor on the shorter suffix wherever it occurs; a stored
sequence adds what its own probability has over that. So the tree is a
staged table (key, value), and scores are lookups and sums.

Words, and sequences of the tree, with at least N / 2^22 occurrences (2^22
of each length at most) are sent to every task. All others are counted and
looked up by exchange: a batch of texts sends its different hashes, sorted
and packed, to buckets of the hash space, one row for each batch and bucket;
a bucket counts them, or answers with what it holds, and the batch puts the
answers where it asked. The number of buckets follows the size of the
texts, so a bucket stays at a few MB, and a word in a third of all rows
is one hash of each batch. Bit tables of fixed size spare most sequences the
exchange: they only skip what can't be there, and results don't depend on
them.

Defined results: null and empty texts are the end token alone; rows with a
null doc_id are training rows; a doc_id in several rows counts as often and
gets one row each; other columns are ignored; without training rows every
word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import FILES, buffers, pieces, released, shared_dir, staged, table, texts

END = np.uint64(0x0E0D0E0D0E0D0E0D)
FREQUENT_BITS, SKETCH_BITS, DEPTH = 22, 27, 3
#: Bytes of text for each bucket of the hash space, and of one batch when texts are counted and scored.
BUCKET_BYTES, COUNT_BYTES, BATCH_BYTES = 1 << 22, 8 << 20, 2 << 20
#: Rows of the tree that are packed together.
PIECE_ROWS = 1 << 20
LEAST_COUNT, DISCOUNT, GAIN = 3, 0.75, 6.0
#: Decimals of the tree's values, so that they travel as 32-bit integers; a value is under 20 in size.
DIGITS = 8
BASE, INVERSE = np.uint64(textvec.BASE), np.uint64(pow(textvec.BASE, -1, 1 << 64))
LEVELS = textvec.seeds(DEPTH + 1, 47)
#: Bytes of a row group of packed rows. Parquet's writer looks at its size after 100 rows first, which are 0.5 GB of a
#: batch's own rows; a reader then makes one batch of such a group.
GROUP_BYTES = 8 << 20
#: Longer words, in bytes, are hashed by BLAKE2: from 512 on, plain patterns make polynomials modulo 2^64 equal.
LONG_WORD = 128


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (each text's words, then END) and where each text begins."""
    offsets, raw = buffers(column)
    places: list[tuple[np.ndarray, np.ndarray]] = []
    (words,), starts = textvec.heads(offsets, raw, (0,), places=places)
    if places:
        begins, ends = (np.concatenate(x) for x in zip(*places, strict=True))
        for k in np.flatnonzero(ends - begins > LONG_WORD):
            words[k] = int.from_bytes(hashlib.blake2b(raw[begins[k] : ends[k]].tobytes().lower(), digest_size=8).digest(), "little")
    out = np.full(len(words) + len(starts) - 1, END, np.uint64)
    to = starts + np.arange(len(starts))
    out[np.arange(len(words)) + textvec.owners(starts)] = words
    return out, to


def small_groups() -> dict[str, str]:
    """Options of the Parquet writer for rows that may have MBs each."""
    checks = {f"parquet.{x}.size.row.check.{k}": v for x in ("block", "page") for k, v in (("min", "1"), ("max", "100"))}
    return checks | {"parquet.block.size": str(GROUP_BYTES), "parquet.enable.dictionary": "false"}


@contextmanager
def writers_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """Tasks that write n partitions keep a file open for each: they don't sort their rows, which takes memory and spills."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Model:
    """What tasks get: frequent words, frequent sequences of the tree, and a bit table of the sequences to ask for."""

    words: np.ndarray  # frequent word hashes, sorted
    counts: np.ndarray  # and their counts
    n: int  # training tokens
    v: int  # distinct words in them
    least: int  # words and sequences of fewer occurrences aren't sent
    keys: np.ndarray  # frequent sequences of the tree, sorted
    values: np.ndarray  # and what each adds to log10 of a text's probability
    sketch: np.ndarray

    def base(self, c: np.ndarray | float) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


def rolled(tokens: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of level + 1 tokens inside a text, and the places of their last tokens."""
    n = max(0, len(tokens) - level)
    h = tokens[:n].copy()
    for k in range(1, level + 1):
        h = h * BASE + tokens[k : k + n]
    begins = np.repeat(starts[:-1], np.diff(starts))
    good = np.flatnonzero(begins[level:] <= np.arange(n)) if level else np.arange(n)
    return h[good], good + level


def keyed(h: np.ndarray, level: int) -> np.ndarray:
    """Keys of sequences, apart for each level."""
    return textvec.mix(h + LEVELS[level])


def sketch(rows: DataFrame) -> np.ndarray:
    """A bit table of the keys; at most 2^(SKETCH_BITS - 6) rows come to the driver."""
    at, bit = f"shiftrightunsigned(key, {70 - SKETCH_BITS})", f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - SKETCH_BITS}) & 63 as int))"
    found = rows.select(F.expr(at).alias("at"), F.expr(bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (SKETCH_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def seen(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys may be in the table: always where they are."""
    bits = len(table).bit_length() + 5
    bit = keys >> np.uint64(64 - bits)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in arrays]


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def buckets_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BUCKET_BYTES))


def packed(x: np.ndarray) -> bytes:
    """Integers by planes of bytes: planes without information cost next to nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(h: np.ndarray) -> bytes:
    """Sorted hashes, as packed differences."""
    return packed(np.diff(h, prepend=np.uint64(0)))


def steps_back(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def ranges(h: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; buckets are equal ranges of the hash space."""
    if not len(h):
        return []
    at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    own, first = np.unique(at, return_index=True)
    ends = np.append(first[1:], len(h))
    return list(zip(own.tolist(), first.tolist(), ends.tolist(), strict=True))


def _joined(table: pa.Table, column: str, back, *kind) -> np.ndarray:  # noqa: ANN001
    parts = [back(x, *kind) for x in table.column(column).to_pylist()]
    return np.concatenate(parts) if parts else back(b"", *kind)


def _words(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw", COUNT_BYTES):
            h, n = np.unique(stream(batch.column("raw"))[0], return_counts=True)
            rows = [(k, steps(h[a:b]), packed(n[a:b])) for k, a, b in ranges(h, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "h", "n"])

    return run


def _merged_words(rows: pa.Table) -> pa.Table:
    h, n = _joined(rows, "h", steps_back), _joined(rows, "n", unpacked, np.int64)
    h, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, n).astype(np.int64)
    return pa.table({"bucket": rows.column("bucket").slice(0, 1), "h": pa.array([steps(h)], pa.binary()), "n": pa.array([packed(n)], pa.binary()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})


def _listed(least: int, keys: bool = False):  # noqa: ANN202
    """Rows (h, n) of the words with at least so many occurrences; keys: with their keys in the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True):
                h, n = steps_back(h), unpacked(n, np.int64)
                good = np.flatnonzero(n >= least)
                columns = (h[good], n[good], keyed(h[good], 0))[: 3 if keys else 2]
                yield pa.RecordBatch.from_arrays(_longs(*columns), ["h", "n", "key"][: len(columns)])

    return run


def _sequences(sent, level: int, buckets: int):  # noqa: ANN001, ANN202
    """Every batch's different sequences whose parts may occur often enough: hashes, last words and numbers, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        lookup = textvec.Lookup(model.words)
        for batch in pieces(batches, "raw", COUNT_BYTES):
            tokens, starts = stream(batch.column("raw"))
            above, ends = rolled(tokens, starts, level - 1)
            may = np.zeros(len(tokens), bool)
            may[ends] = seen(model.sketch, keyed(above, level - 1))
            h, at = rolled(tokens, starts, level)
            good = np.flatnonzero(may[at - 1] & may[at])
            h, first, n = np.unique(h[good], return_index=True, return_counts=True)
            last = tokens[at[good]][first]
            place = lookup.find(last).astype(np.int32)
            rows = []
            for k, a, b in ranges(h, buckets):
                own = place[a:b]
                rows.append((k, steps(h[a:b]), packed(own), packed(last[a:b][own < 0]), packed(n[a:b].astype(np.uint32))))
            kinds = (pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["bucket", "h", "place", "last", "n"])

    return run


def _merged_sequences(sent, level: int):  # noqa: ANN001, ANN202
    """Rows of the sequences that occur often enough: hash, number, hash without the last word, key in the tree."""

    def run(rows: pa.Table) -> pa.Table:
        place = _joined(rows, "place", unpacked, np.int32)
        last = np.zeros(len(place), np.uint64)
        last[place >= 0] = sent.value.words[place[place >= 0]]
        last[place < 0] = _joined(rows, "last", unpacked, np.uint64)
        h, first, at = np.unique(_joined(rows, "h", steps_back), return_index=True, return_inverse=True)
        n = np.bincount(at, _joined(rows, "n", unpacked, np.uint32)).astype(np.int64)
        good = np.flatnonzero(n >= LEAST_COUNT)
        h = h[good]
        return pa.table(dict(zip(("h", "n", "context", "key"), _longs(h, n[good], (h - last[first][good]) * INVERSE, keyed(h, level)), strict=True)))

    return run


def _suffixes(level: int):  # noqa: ANN202
    """Adds the hash of a sequence without its first word."""
    power = np.uint64(pow(textvec.BASE, level, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("suffix", _longs(_unsigned(batch, "h") - _unsigned(batch, "first") * power)[0])

    return run


def _keys(level: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*_longs(keyed(_unsigned(batch, "h"), level)), batch.column("n"), batch.column("value")], ["key", "n", "value"])

    return run


def learned(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the training words by bucket, the tree (key, n, value) without what the model holds, and the number of buckets."""
    spark = docs.sparkSession
    train = texts(docs.filter(~held_out())).select("raw")
    buckets = buckets_of(docs)
    counted = train.mapInArrow(_words(buckets), "bucket long, h binary, n binary").groupBy("bucket").applyInArrow(_merged_words, "bucket long, h binary, n binary, words long, tokens long")
    counts, _ = staged(counted, **small_groups())
    total = counts.agg(F.sum("words"), F.sum("tokens")).first()
    v, n = total[0] or 0, total[1] or 0
    least = -(-n >> FREQUENT_BITS)
    # at most 2^FREQUENT_BITS rows, since each has that share of all tokens
    top = counts.mapInArrow(_listed(least), "h long, n long").toArrow()
    words, own = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(words)
    none = np.zeros(0, np.uint64)
    model = Model(words[order], own[order], n, v, least, none, np.zeros(0), none)
    paths: list[str] = []
    tree, _ = staged(grown(train, counts, model, paths, buckets))
    released(spark, paths)
    often = tree.filter(F.col("n") >= least).toArrow()  # at most 2^FREQUENT_BITS rows of each length
    keys = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.values = keys[order], often.column("value").to_numpy()[order]
    seldom = tree.filter(F.col("n") < least)
    model.sketch = sketch(seldom)
    return model, counts, seldom, buckets


def grown(train: DataFrame, counts: DataFrame, model: Model, paths: list[str], buckets: int) -> DataFrame:
    """The tree: (key, n, value) of every kept context and every sequence that one stores; paths gets the tables that it reads."""
    spark = train.sparkSession

    def put(df: DataFrame, where: list[str]) -> DataFrame:
        out, path = staged(df)
        where.append(path)
        released(spark, [])
        return out

    size = F.lit(float(model.n + 0.5 * (model.v + 1)))
    # sequences of the level above: their first word, and log10 of their last word's probability by the longest kept suffix of the others
    often = put(counts.mapInArrow(_listed(LEAST_COUNT, True), "h long, n long, key long"), paths)
    model.sketch = sketch(often)
    above = often.select("h", "n", F.col("h").alias("first"), F.log10((F.col("n") + 0.5) / size).alias("own"))
    entries = []
    for level in range(1, DEPTH + 1):
        sent = spark.sparkContext.broadcast(model)
        parts = train.mapInArrow(_sequences(sent, level, buckets), "bucket long, h binary, place binary, last binary, n binary")
        rows = parts.groupBy("bucket").applyInArrow(_merged_sequences(sent, level), "h long, n long, context long, key long")
        brief: list[str] = []
        held = put(rows, brief)
        sent.unpersist()
        if level < DEPTH:
            model.sketch = sketch(held)
        rows = held.drop("key").join(above.select(F.col("h").alias("context"), F.col("n").alias("n_context"), "first"), "context")
        rows = rows.mapInArrow(_suffixes(level), "context long, h long, n long, n_context long, first long, suffix long")
        p, q = F.log10((F.col("n") - DISCOUNT) / F.col("n_context")), F.col("own")
        rows = rows.join(above.select(F.col("h").alias("suffix"), "own"), "suffix").select("h", "n", "context", "n_context", "first", p.alias("p"), q.alias("q"))
        rows = put(rows, brief)
        p, q, ten = F.col("p"), F.col("q"), F.lit(10.0)
        sums = rows.groupBy("context").agg(
            F.max("n_context").alias("n"), F.count("*").alias("stored"), F.sum(F.pow(ten, p)).alias("p"), F.sum(F.pow(ten, q)).alias("q"), F.sum(F.pow(ten, p) * (p - q)).alias("over")
        )
        rest, other = F.greatest(1 - F.col("p"), F.lit(1e-12)), 1 - F.least(F.col("q"), F.lit(1 - 1e-12))
        sums = sums.select("context", "n", "stored", "over", rest.alias("rest"), (F.log10(rest) - F.log10(other)).alias("spill"))
        gain = F.col("n") * float(np.log(10)) * (F.col("over") + F.col("rest") * F.col("spill"))
        kept = put(sums.filter(gain > GAIN * (F.col("stored") + 1)).select("context", "n", "spill"), paths)
        rows = rows.join(kept.select("context", "spill"), "context", "left")
        above = put(rows.select("h", "n", "first", F.when(F.col("spill").isNotNull(), p).otherwise(q).alias("own"), (p - q - F.col("spill")).alias("value")), paths)
        released(spark, brief)
        for k, part in ((level - 1, kept.select(F.col("context").alias("h"), "n", F.col("spill").alias("value"))), (level, above.filter("value is not null").select("h", "n", "value"))):
            entries.append(part.mapInArrow(_keys(k), "key long, n long, value double"))
    out = entries[0]
    for part in entries[1:]:
        out = out.unionByName(part)
    return out.groupBy("key").agg(F.max("n").alias("n"), F.round(F.sum("value"), DIGITS).alias("value"))


def _asking(sent, buckets: int):  # noqa: ANN001, ANN202
    """One row for each batch with its texts' sums and where its answers belong, and one for each bucket that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        lookup, frequent = textvec.Lookup(own.words), textvec.Lookup(own.keys)
        log = own.base(own.counts.astype(float))
        for batch in pieces(batches, "raw", BATCH_BYTES):
            tokens, starts = stream(batch.column("raw"))
            place = lookup.find(tokens)
            base = np.where(place >= 0, log[place], 0.0) if len(log) else np.zeros(len(place))
            gain, asked, ends = np.zeros(len(tokens)), [], []
            for level in range(DEPTH + 1):
                h, at = rolled(tokens, starts, level)
                key = keyed(h, level)
                there = frequent.find(key)
                hit = np.flatnonzero(there >= 0)
                gain[at[hit]] += own.values[there[hit]]
                ask = np.flatnonzero((there < 0) & seen(own.sketch, key))
                asked.append(key[ask])
                ends.append(at[ask])
            sums = [np.add.reduceat(x, starts[:-1]) for x in (base, gain, (place >= 0).astype(np.int64))]
            text, rare, order = textvec.owners(starts), np.flatnonzero(place < 0), np.argsort(np.concatenate(ends), kind="stable")
            parts, questions = [], []
            for where, h in ((rare, tokens[rare]), (np.concatenate(ends)[order], np.concatenate(asked)[order])):
                different, at = np.unique(h, return_inverse=True)
                questions.append(different)
                parts += [packed(np.diff(text[where], prepend=0).astype(np.uint32)), packed(at.astype(np.uint32))]
            # the batch's name is its first row's: a task's own number would be one for all partitions that coalesce() gives it
            n, number = batch.num_rows, batch.column("row")[0].as_py()
            rows = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(starts)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "held_out", "n_tokens", "known", "base", "gain"])
            requests: dict[int, list[bytes]] = {}
            for kind, h in enumerate(questions):
                for k, a, b in ranges(h, buckets):
                    requests.setdefault(k, [b"", b""])[kind] = steps(h[a:b])
            m, none = len(requests), [None] * len(requests)
            columns = {
                "batch": pa.array([number] * (m + 1), pa.int64()), "bucket": pa.array([None, *requests], pa.int64()),
                "rows": pa.ListArray.from_arrays(pa.array([0, *[n] * (m + 1)], pa.int32()), rows),
                "a": pa.array([parts[0], *(x[0] for x in requests.values())], pa.binary()), "b": pa.array([parts[1], *(x[1] for x in requests.values())], pa.binary()),
                "c": pa.array([parts[2], *none], pa.binary()), "d": pa.array([parts[3], *none], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _held(kind: int, buckets: int):  # noqa: ANN202
    """What buckets answer from: rows (bucket, kind, h, v) of seldom words (kind 0, from blobs) or sequences of the tree (kind 1, from rows)."""

    def blob(h: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        rows = [(k, kind, steps(h[a:b]), packed(v[a:b])) for k, a, b in ranges(h, buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "h", "v"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield blob(steps_back(h), unpacked(n, np.int64))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In few and large pieces."""
        own: list[tuple[np.ndarray, np.ndarray]] = []

        def piece() -> pa.RecordBatch:
            h, v = (np.concatenate(x) for x in zip(*own, strict=True))
            own.clear()
            order = np.argsort(h)
            return blob(h[order], v[order])

        for batch in batches:
            own.append((_unsigned(batch, "key").copy(), np.rint(batch.column("value").to_numpy() * 10**DIGITS).astype(np.int32)))
            if sum(len(h) for h, _ in own) >= PIECE_ROWS:
                yield piece()
        if own:
            yield piece()

    return sequences if kind else words


def _answered(questions: pa.Table, held: pa.Table) -> pa.Table:
    """For every batch that asks a bucket: counts of the words, and values of the sequences; 0 where the bucket holds none."""
    kinds = held.column("kind").to_numpy()
    tables = []
    for kind, type_ in ((0, np.int64), (1, np.int32)):
        part = held.filter(pa.array(kinds == kind))
        h, v = _joined(part, "h", steps_back), _joined(part, "v", unpacked, type_)
        order = np.argsort(h)
        tables.append((h[order], v[order]))
    answers: list[list[bytes]] = [[], []]
    for kind, column in enumerate("ab"):
        h, v = tables[kind]
        for data in questions.column(column).to_pylist():
            asked = steps_back(data)
            at = np.minimum(np.searchsorted(h, asked), max(0, len(h) - 1))
            answers[kind].append(packed(np.where(h[at] == asked, v[at], 0) if len(h) else np.zeros(len(asked), v.dtype)))
    return pa.table({"batch": questions.column("batch"), "bucket": questions.column("bucket"), "a": pa.array(answers[0], pa.binary()), "b": pa.array(answers[1], pa.binary())})


def _summed(n: int, size: float):  # noqa: ANN202
    """Scores of a batch's texts, from its own sums and the answers."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        counts, values = _joined(answers, "a", unpacked, np.int64), _joined(answers, "b", unpacked, np.int32) / 10**DIGITS
        rows = own.column("rows").combine_chunks().flatten()
        get = dict(zip((f.name for f in rows.type), rows.flatten(), strict=True))
        a, b, c, d = (unpacked(own.column(x)[0].as_py(), np.uint32).astype(np.int64) for x in "abcd")
        base, gain, known = (get[x].to_numpy(zero_copy_only=False).copy() for x in ("base", "gain", "known"))
        text, c_of = np.cumsum(a), counts[b] if len(b) else np.zeros(0, np.int64)
        base += np.bincount(text, np.log10((c_of + 0.5) / size), minlength=len(base))
        known += np.bincount(text, c_of > 0, minlength=len(base)).astype(np.int64)
        gain += np.bincount(np.cumsum(c), values[d] if len(d) else np.zeros(0), minlength=len(base))
        tokens = get["n_tokens"].to_numpy()
        out = [get["doc_id"], get["held_out"], get["n_tokens"], pa.array(known), pa.array(np.full(len(base), n)), pa.array(base), pa.array(base + gain), pa.array(gain / tokens)]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lift"])

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, and lift: what contexts add to a token's score."""
    spark = docs.sparkSession
    model, counts, tree, buckets = learned(docs)
    sent = spark.sparkContext.broadcast(model)
    name = docs.schema["doc_id"].dataType.simpleString()
    rows = f"array<struct<doc_id:{name},held_out:boolean,n_tokens:long,known:long,base:double,gain:double>>"
    asking = texts(docs.select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row")), "held_out", "row").mapInArrow(_asking(sent, buckets), f"batch long, bucket long, rows {rows}, a binary, b binary, c binary, d binary")
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    asking = asking.withColumn("question", F.col("bucket").isNotNull()).coalesce(FILES * spark.sparkContext.defaultParallelism)
    with writers_at_once(spark, 2):
        asking.write.options(**small_groups()).partitionBy("question").parquet(path)
    asked = spark.read.schema(asking.schema).parquet(path)
    questions, own = asked.filter("question").select("batch", "bucket", "a", "b"), asked.filter("not question").drop("question")
    held = counts.mapInArrow(_held(0, buckets), "bucket long, kind int, h binary, v binary").unionByName(tree.select("key", "value").mapInArrow(_held(1, buckets), "bucket long, kind int, h binary, v binary"))
    answers, _ = staged(questions.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_answered, "batch long, bucket long, a binary, b binary"), **small_groups())
    released(spark, [f"{path}/question=true"])
    schema = f"doc_id {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lift double"
    return own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_summed(model.n, model.n + 0.5 * (model.v + 1)), schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
