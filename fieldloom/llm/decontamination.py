"""Operator 1: benchmark decontamination by spaced seeds.

Words are lower-cased and lose ASCII punctuation. A fixed mask hashes some
positions of a window and ignores the others, so a substituted word under
an ignored position does not hide a match. Hashes of the benchmark's
windows under every mask are looked up in the documents; each hit fixes a
diagonal (a document place for each item place), on which the overlap is
verified word by word: an item is in a document if some stretch of
min(item's words, SPAN) words agrees in at least SHARE of them.

The benchmark is sent to tasks in blocks of about BLOCK_WORDS words; a
larger one takes more passes over the documents, never more memory. Hits
are expanded in slices, and where many items share a seed (a question's
stem), all of them are verified together, one comparison for each word.

Defined results: null and empty texts and items match nothing, as do items
of fewer than LEAST_WORDS words; each row is a document of its own, also
where its doc_id is null or in several rows; items with one text and
several ids are each reported, equal rows once, and item_id may be of any
type that can be compared; other columns are ignored; an empty benchmark
finds nothing, an empty table gives an empty result. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec
from .common import buffers, dropped, pieces, small_batches, staged, table

#: 1: hashed, 0: ignored. The first has no gap, so that short items are found too.
MASKS = ("11111", "111011", "1101101", "11010011")
#: For items of at most SHORT words also: these find 4 of 5 and 5 of 6 words, whichever is changed.
SHORT_MASKS, SHORT = ("1111", "10111", "11011", "11101"), 6
SPAN, SHARE, LEAST_WORDS = 13, 0.8, 5
BLOCK_WORDS = 2_000_000
#: Seeds that so many items hold are verified for all of them together; hits and words of one slice of the others.
BUNDLE, BUNDLE_ROWS, SLICE = 32, 1 << 16, 1 << 20
#: Bundles are forgotten, and made again where they are hit, beyond so many words.
BUNDLE_WORDS = 8_000_000


def seed_hashes(words: np.ndarray, starts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside a document, and the places where they begin."""
    keys, n = textvec.seeds(len(mask), 31 + (MASKS + SHORT_MASKS).index(mask)), len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for p, bit in enumerate(mask):
        if bit == "1":
            total += (words[p : p + n] ^ keys[p]) * (keys[p] | np.uint64(1))
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(n) + len(mask) <= ends[:n])
    return textvec.mix(total[at]), at


class Seeds:
    """One block of the benchmark: its words and, for each mask, its sorted seeds."""

    def __init__(self, items: list, raws: list[bytes]):
        self.words, self.starts = textvec.words(*buffers(pa.array(raws, pa.large_binary())), punctuation=False)
        self.items, self.sizes = items, np.diff(self.starts)
        owner = textvec.owners(self.starts)
        self.masks = []
        for mask in MASKS + SHORT_MASKS:
            h, at = seed_hashes(self.words, self.starts, mask)
            size = self.sizes[owner[at]]
            good = (size >= LEAST_WORDS) & ((size <= SHORT) | (mask in MASKS))
            h, at = h[good], at[good]
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.masks.append((textvec.Lookup(keys), np.append(first, len(order)), at[order]))
        self.owner = owner
        self._forget()

    def _forget(self) -> None:
        self.bundles: dict[bytes, int] = {}
        self.members: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.lists: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.held = 0

    def _bundles(self, mask: int, key: int) -> list[tuple[int, int]]:
        """(bundle, place in the items) of a seed that many items hold; items that hold several seeds at fixed distances are one bundle."""
        if (mask, key) not in self.lists:
            _, first, places = self.masks[mask]
            q = places[first[key] : first[key + 1]]
            item = self.owner[q]
            place = q - self.starts[item]
            out = []
            for x in np.unique(place).tolist():
                own = np.sort(item[place == x])
                name = own.tobytes()
                if name not in self.bundles:
                    self.bundles[name] = len(self.members)
                    sizes = self.sizes[own]
                    parts = []
                    for n in np.unique(sizes).tolist():
                        same = own[sizes == n]
                        for k in range(0, len(same), BUNDLE_ROWS):
                            part = same[k : k + BUNDLE_ROWS]
                            parts.append((part, np.ascontiguousarray(self.words[self.starts[part][None, :] + np.arange(n)[:, None]])))
                    self.members.append(parts)
                    self.held += int(sizes.sum())
                out.append((self.bundles[name], x))
            self.lists[mask, key] = out
        return self.lists[mask, key]

    def matches(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, agreeing words of its best stretch), each pair once."""
        owner, hits = textvec.owners(starts), []
        for mask, (name, (lookup, first, _)) in enumerate(zip(MASKS + SHORT_MASKS, self.masks, strict=True)):
            if len(lookup.keys):
                h, at = seed_hashes(words, starts, name)
                key = lookup.find(h)
                hit = np.flatnonzero(key >= 0)
                hits.append((mask, key[hit], at[hit], first[key[hit] + 1] - first[key[hit]]))
        best: dict[tuple[int, int], int] = {}
        for doc, item, most in [*self._few(words, starts, owner, hits), *self._many(words, starts, owner, hits)]:
            for i, m in zip(item.tolist(), most.tolist(), strict=True):
                best[doc, i] = max(best.get((doc, i), 0), m)
        return [(d, i, m) for (d, i), m in best.items()]

    def _few(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray, hits: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Seeds of few items: every diagonal by itself, in slices of the hits."""
        parts = []
        for mask, key, at, many in hits:
            few = np.flatnonzero(many < BUNDLE)
            parts.append(np.stack([at[few], np.full(len(few), mask), key[few], many[few]]))
        if not parts:
            return
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        ends, begin = np.cumsum(rows[3]), 0
        while begin < rows.shape[1]:
            done = ends[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            found = []
            for mask, (_, first, places) in enumerate(self.masks):
                at, _, key, many = own = rows[:, begin:to][:, rows[1, begin:to] == mask]
                if own.shape[1]:
                    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    q, at = places[np.repeat(first[key], many) + inner], np.repeat(at, many)
                    item = self.owner[q]
                    found.append(np.stack([owner[at], item, at - starts[owner[at]] - (q - self.starts[item])]))
            doc, item, shift = np.unique(np.concatenate(found, axis=1), axis=1)
            most = self._agreement(words, starts, doc, item, shift)
            good = np.flatnonzero(most >= SHARE * np.minimum(self.sizes[item], SPAN))
            for d, i, m in zip(doc[good].tolist(), item[good], most[good], strict=True):
                yield d, i[None], m[None]
            begin = to

    def _agreement(self, words: np.ndarray, starts: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Agreeing words of the best stretch on each diagonal; -1 where none fits."""
        out = np.full(len(doc), -1, np.int64)
        span = np.minimum(self.sizes[item], SPAN)
        lo, hi = np.maximum(0, -shift), np.minimum(self.sizes[item], np.diff(starts)[doc] - shift)
        fits = np.flatnonzero(hi - lo >= span)
        ends, begin = np.cumsum(hi[fits] - lo[fits]), 0
        while begin < len(fits):
            done = ends[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            at = fits[begin:to]
            n, w = hi[at] - lo[at], hi[at] - lo[at] - span[at] + 1
            base = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(base - lo[at], n)
            same = words[np.repeat(starts[doc[at]] + shift[at], n) + inside] == self.words[np.repeat(self.starts[item[at]], n) + inside]
            total = np.concatenate([[0], np.cumsum(same)])
            begins = np.cumsum(w) - w
            window = np.arange(w.sum()) + np.repeat(base - begins, w)
            out[at] = np.maximum.reduceat(total[window + np.repeat(span[at], w)] - total[window], begins)
            begin = to
        return out

    def _many(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray, hits: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Seeds of many items: all items of a bundle are compared with the text at once, each diagonal of the bundle once."""
        if self.held > BUNDLE_WORDS:
            self._forget()
        met: set[tuple[int, int, int]] = set()
        for mask, key, at, many in hits:
            often = np.flatnonzero(many >= BUNDLE)
            for p, k, d in zip(at[often].tolist(), key[often].tolist(), owner[at[often]].tolist(), strict=True):
                for bundle, place in self._bundles(mask, k):
                    met.add((d, bundle, p - int(starts[d]) - place))
        last, best = -1, np.zeros(0, np.int16)
        for d, bundle, shift in sorted(met):
            if d != last:
                if len(found := np.flatnonzero(best)):
                    yield last, found, best[found]
                last, best = d, np.zeros(len(self.items), np.int16)
            text = words[starts[d] : starts[d + 1]]
            for item, own in self.members[bundle]:
                size = len(own)
                span, lo, hi = min(size, SPAN), max(0, -shift), min(size, len(text) - shift)
                if hi - lo < span:
                    continue
                run, most, kept = np.zeros(len(item), np.int16), np.zeros(len(item), np.int16), []
                for k in range(lo, hi):
                    kept.append(own[k] == text[k + shift])
                    run += kept[-1]
                    if k - lo >= span:
                        run -= kept[k - lo - span]
                        kept[k - lo - span] = None
                    if k - lo >= span - 1:
                        np.maximum(most, run, out=most)
                good = most >= SHARE * span
                best[item[good]] = np.maximum(best[item[good]], most[good])
        if len(found := np.flatnonzero(best)):
            yield last, found, best[found]


def matched(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, with _found: each row's own (item_id, n_words)."""
    spark = docs.sparkSession
    items, items_path = staged(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), (F.length(F.coalesce("text", F.lit(""))) / 2 + 1).alias("most")).distinct())
    blocks = max(1, int(-(-(items.agg(F.sum("most")).first()[0] or 0) // BLOCK_WORDS)))
    item_kind = benchmark.schema["item_id"].dataType

    def finder(sent, names: list[str]):  # noqa: ANN001, ANN202
        kind = pa.struct([("item_id", to_arrow_type(item_kind)), ("n_words", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            for batch in pieces(batches, "text"):
                found = [[] for _ in range(batch.num_rows)]
                for d, i, m in seeds.matches(*textvec.words(*buffers(batch.column("text")), punctuation=False)):
                    found[d].append({"item_id": seeds.items[i], "n_words": m})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(kind))], [*names, "_new"])

        return run

    new = T.StructField("_new", T.ArrayType(T.StructType([T.StructField("item_id", item_kind), T.StructField("n_words", T.LongType())])))
    rows, before = small_batches(docs), None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Seeds([r[0] for r in own], [r[1].encode() for r in own]))
        last = block + 1 == blocks
        names = [c for c in rows.columns if not last or c in keep or c == "_found"]
        rows = rows.mapInArrow(finder(sent, names), T.StructType([*(rows.schema[c] for c in names), new]))
        rows = rows.withColumn("_found", F.concat("_found", "_new") if block else F.col("_new")).drop("_new")
        if not last:  # rows go on to the next block with what they have, so that no more than one block is held
            rows, path = staged(rows)
            if before:
                dropped(spark, before)
            sent.unpersist()
            before = path
    dropped(spark, items_path)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row's doc_id with contaminated, the items found (sorted), their number and the longest agreement."""
    items = F.sort_array(F.array_distinct(F.array_compact("_found.item_id")))
    rows = matched(docs.select("doc_id", "text"), benchmark, ["doc_id"]).withColumn("items", items)
    return rows.select(
        "doc_id", (F.size("_found") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
        "items", F.coalesce(F.array_max("_found.n_words"), F.lit(0)).cast("long").alias("most_words"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item; same columns."""
    return matched(docs, benchmark, docs.columns).filter(F.size("_found") == 0).drop("_found")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
