"""Operator 5: near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes its set of word shingles; equal sets form one class,
   whose smallest doc_id stands for it from then on.
2. Minima under 512 permutations; rows of four of the first 128 name 32
   buckets. A pair at similarity 0.8 shares none with probability 5e-8.
3. Two low bits of every minimum are packed in two bit planes. Matching
   positions, counted by xor and bit_count and corrected for chance
   matches, estimate the similarity; pairs more than 5.5 standard errors
   under the limit go no further.
4. In each bucket members are screened against a few pivots, picked by hash
   and so others in each bucket; each member's likeliest pairs are confirmed
   on the full sets, and components are formed.
5. Buckets that then still hold several components may join them. Their
   members' shingles are ordered by how many members have them, rarest
   first. Two sets of x and y shingles reach the limit only if they share
   one among the first x - o + 1 and y - o + 1, o being the shingles that
   they must have in common. So members meet on (shingle, size class) of
   these first shingles, in no other way, and a group of texts which differ
   from each other in shingles of their own makes no pairs, however large.
   Pairs of one component add nothing and are left out. Those that share a
   bucket and whose estimate allows it are confirmed on the full sets.
6. Components by smallest label, with pointer jumping.

Defined results: null, empty and blank texts have an empty set, link with
nothing and are kept; a doc_id in several rows is one vertex, and each row
is returned with its own set size; rows with a null doc_id are returned
with a null component and kept; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import dropped, pieces, staged, table, texts

PERMUTATIONS, BANDS, ROWS, BITS, PIVOTS = 512, 32, 4, 2, 2
#: Similarity, in hundredths, from which documents are linked.
LIMIT = 80
#: How many of a member's pivot pairs are confirmed at once; the others wait for the comparison across components.
STAR_PAIRS = 6
#: Pairs of one anchor that are verified in one unit, to which its text is sent once.
UNIT_PAIRS = 512
#: Set sizes of one class differ by less than this factor.
CLASS = 1.03
_A, _B = textvec.seeds(PERMUTATIONS, 5) | np.uint64(1), textvec.seeds(PERMUTATIONS, 6)
#: The planes of the first 128 positions, by word.
SKETCH = [f"p{b}{k}" for k in range(2) for b in range(BITS)]
PLANES = [f"p{b}{k}" for b in range(BITS) for k in range(PERMUTATIONS // 64)]


def least_matches(limit: int = LIMIT, positions: int = PERMUTATIONS) -> int:
    """Matching positions that a pair at the limit falls short of with a chance of about 1e-7 (5.5 standard errors)."""
    p = limit / 100 + (1 - limit / 100) / 2**BITS
    return int(positions * p - 5.5 * np.sqrt(positions * p * (1 - p)))


def minima(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(permutation, document) minima of documents that all have items; the upper 32 bits are kept."""
    out, n = np.empty((PERMUTATIONS, len(starts) - 1), np.uint64), len(starts) - 1
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 32_768, side="right")) - 1)
        block, places = items[starts[at] : starts[to]], starts[at:to] - starts[at]
        for k in range(PERMUTATIONS):
            out[k, at:to] = np.minimum.reduceat(block * _A[k] + _B[k], places)
        at = to
    return out >> np.uint64(32)


def packed(low: np.ndarray) -> list[np.ndarray]:
    """Bit planes of the low bits: BITS x PERMUTATIONS / 64 arrays of int64."""
    bits = [((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(BITS)]
    return [np.ascontiguousarray(np.packbits(x[64 * k : 64 * k + 64], axis=0).T).view(np.int64).ravel() for x in bits for k in range(PERMUTATIONS // 64)]


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, the set's hash in two halves, bucket keys (null: empty set) and bit planes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import buffers

        for batch in pieces(batches, "raw"):
            items, starts = textvec.shingles(*textvec.words(*buffers(batch.column("raw"))), width)
            n, h1, h2 = np.zeros(len(starts) - 1, np.int64), np.zeros(len(starts) - 1, np.uint64), np.zeros(len(starts) - 1, np.uint64)
            full = np.flatnonzero(np.diff(starts) > 0)
            for d in full:
                own = np.unique(items[starts[d] : starts[d + 1]])
                n[d], h1[d], h2[d] = len(own), own.sum(), textvec.mix(own).sum()
            low = minima(items, np.append(starts[full], starts[-1])) if len(full) else np.zeros((PERMUTATIONS, 0), np.uint64)
            keys = np.zeros((len(starts) - 1, BANDS), np.int64)
            for b in range(BANDS):
                key = np.full(len(full), b + 1, np.uint64)
                for r in range(ROWS):
                    key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[b * ROWS + r])
                keys[full, b] = key.view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            planes = []
            for plane in packed(low):
                all_ = np.zeros(len(starts) - 1, np.int64)
                all_[full] = plane
                planes.append(pa.array(all_))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands, *planes], ["doc_id", "n_shingles", "h1", "h2", "bands", *PLANES])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES))


def matches(x: str, y: str) -> Column:
    """Positions, of PERMUTATIONS, whose low bits agree: from the planes in the structs x and y."""
    total = F.lit(PERMUTATIONS)
    for k in range(PERMUTATIONS // 64):
        differ = F.lit(0).cast("long")
        for b in range(BITS):
            differ = differ.bitwiseOR(F.col(f"{x}.p{b}{k}").bitwiseXOR(F.col(f"{y}.p{b}{k}")))
        total = total - F.bit_count(differ)
    return total


def estimate(matching: Column) -> Column:
    """Similarity, corrected for positions that agree by chance."""
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (matching / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance))


def _may(k: int, limit: int) -> Column:
    """Whether a bucket's row may be linked with pivot k: by set sizes, and by the first 128 positions with the same margin."""
    own, other = F.col("n_shingles"), F.col(f"_n_shingles_{k}")
    same, positions = F.lit(0), 64 * (len(SKETCH) // BITS)
    for word in range(len(SKETCH) // BITS):
        differ = F.lit(0).cast("long")
        for c in SKETCH[BITS * word : BITS * (word + 1)]:
            differ = differ.bitwiseOR(F.col(c).bitwiseXOR(F.col(f"_{c}_{k}")))
        same = same + 64 - F.bit_count(differ)
    sizes = 100 * F.least(own, other) >= limit * F.greatest(own, other)
    return (F.col("doc_id") != F.col(f"_doc_id_{k}")) & sizes & (same >= least_matches(limit, positions))


def confirmed(pairs: DataFrame, bodies: DataFrame, width: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit; bodies: doc_id, raw.

    Pairs are shared out over so many units that the anchor with most pairs
    has about UNIT_PAIRS in each; its text is sent to each once. So an
    anchor with very many pairs is no hot key.
    """
    units = -(-(pairs.groupBy("a").count().agg(F.max("count")).first()[0] or 1) // UNIT_PAIRS)
    dealt = pairs.withColumn("unit", F.pmod(F.xxhash64("b", F.lit(7)), F.lit(units)))
    anchors = dealt.select("a", "unit").distinct().join(bodies, F.col("a") == F.col("doc_id")).select("a", "unit", F.lit(None).cast(bodies.schema["doc_id"].dataType).alias("b"), "raw")
    others = dealt.join(bodies, F.col("b") == F.col("doc_id")).select("a", "unit", "b", "raw")
    rows = anchors.unionByName(others).repartition("a", "unit").sortWithinPartitions("a", "unit", F.col("b").asc_nulls_first())
    kind = bodies.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import buffers

        held, at = [], None
        for batch in pieces(batches, "raw"):
            items, starts = textvec.shingles(*textvec.words(*buffers(batch.column("raw"))), width)
            left, right = [], []
            for k, (a, unit, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "unit", "b")), strict=True)):
                own = np.unique(items[starts[k] : starts[k + 1]])
                if (a, unit) != at:
                    held, at = [], (a, unit)
                if b is None:
                    held.append(own)
                    continue
                for other in held:
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    if not len(small):
                        continue
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                    if 100 * both >= limit * (len(own) + len(other) - both):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field("a").type), pa.array(right, batch.schema.field("b").type)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(CLASS))).cast("int")


def sharing(bodies: DataFrame, components: DataFrame, width: int, limit: int) -> tuple[DataFrame, str]:
    """Pairs (a, b) of different components that may reach the limit: an exact prefix filter.

    bodies: doc_id, raw; components: (doc_id, component) of the documents to
    compare. The shingle at place i of a set of x, rarest first, is among
    those that a partner of y must share one of if
    limit * (x + y) <= (100 + limit) * (x - i).
    """
    kind = bodies.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .common import buffers

        row = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, "raw"):
            items, starts = textvec.shingles(*textvec.words(*buffers(batch.column("raw"))), width)
            own = [np.unique(items[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            sizes = np.array([len(x) for x in own], np.int64)
            owner = np.repeat(np.arange(len(own)), sizes)
            columns = [batch.column("doc_id").take(pa.array(owner)), batch.column("component").take(pa.array(owner)), pa.array(row + owner), pa.array(sizes[owner]), pa.array(np.concatenate(own).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "component", "row", "x", "h"])
            row += len(own)

    rows, path = staged(bodies.join(components, "doc_id").select("doc_id", "component", "raw").mapInArrow(run, f"doc_id {kind}, component {kind}, row long, x long, h long"))
    # shingles that one member alone has are the first of its order and lead to nobody
    common = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(common, "h").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("component").alias("component"), F.first("x").alias("x"), F.sort_array(F.collect_list(F.struct("n", "h"))).alias("order"))
    x, i = F.col("x"), F.col("x") - F.size("order") + F.col("_k")
    reach = F.floor((100 + limit) * (x - i) / limit).cast("long") - x  # the largest partner for which place i counts
    first = shared.select("doc_id", "component", "x", "order", F.posexplode(F.slice("order", 1, F.greatest(F.lit(0), F.size("order") - F.ceil(limit * x / 100).cast("int") + 1))).alias("_k", "_s"))
    first, first_path = staged(first.select("doc_id", "component", "x", F.col("_s.h").alias("h"), reach.alias("reach")).filter("100 * reach >= %d * x" % limit))
    small = first.filter("reach >= x").withColumn("class", _class(x))
    large = first.withColumn("class", F.explode(F.sequence(_class(F.ceil(limit * x / 100)), _class(F.least(x, F.col("reach"))))))
    ends = [F.min("component").alias("_lo"), F.max("component").alias("_hi")]
    met = small.select("h", "class", "component").unionByName(large.select("h", "class", "component")).groupBy("h", "class").agg(*ends).filter("_lo <> _hi").select("h", "class")
    named = lambda df, a: df.join(met, ["h", "class"], "left_semi").select("h", "class", *[F.col(c).alias(f"{a}_{c}") for c in ("doc_id", "component", "x", "reach")])
    order = (F.col("s_x") < F.col("l_x")) | ((F.col("s_x") == F.col("l_x")) & (F.col("s_doc_id") < F.col("l_doc_id")))
    pairs = named(small, "s").join(named(large, "l"), ["h", "class"]).filter(F.expr("s_component <> l_component and s_x <= l_reach and l_x <= s_reach") & order)
    pairs, pairs_path = staged(pairs.select(F.least("s_doc_id", "l_doc_id").alias("a"), F.greatest("s_doc_id", "l_doc_id").alias("b")).distinct())
    for p in (path, first_path):
        dropped(bodies.sparkSession, p)
    return pairs, pairs_path


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(doc_id, component) for each end of an edge (a, b), and its folder: smallest label, by neighbours and pointer jumping."""
    spark = edges.sparkSession
    both, both_path = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, path = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("doc_id")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("doc_id") == F.col("a")).select("doc_id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        up = labels.select(F.col("doc_id").alias("_up"), F.col("component").alias("_top"))
        step = step.join(up, F.col("mid") == F.col("_up")).select("doc_id", "old", F.least("mid", "_top").alias("component"))
        new, new_path = staged(step)
        moved = new.filter("old <> component").limit(1).count()
        dropped(spark, path)
        labels, path = new.select("doc_id", "component"), new_path
        if not moved:
            dropped(spark, both_path)
            return labels, path


def linked(docs: DataFrame, width: int = 4, limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        out, path = staged(df)
        paths.append(path)
        return out

    sig = kept(signatures(docs, width))
    sets = ["n_shingles", "h1", "h2"]
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = kept(named.groupBy(*sets).agg(F.min("doc_id").alias("rep")))
    reps = classes.withColumnRenamed("rep", "doc_id")

    # buckets with two members or more
    rows = named.select("doc_id", *sets, "bands").join(reps, ["doc_id", *sets], "left_semi").select(F.explode("bands").alias("bucket"), "doc_id")
    several = rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    members = kept(rows.join(several, "bucket", "left_semi"))
    ids = kept(members.select("doc_id").distinct())
    vectors = kept(named.join(ids, "doc_id", "left_semi").select("doc_id", F.struct("n_shingles", "bands", *PLANES).alias("v")))
    bodies = kept(texts(docs).join(ids, "doc_id", "left_semi"))
    sizes = 100 * F.least("va.n_shingles", "vb.n_shingles") >= limit * F.greatest("va.n_shingles", "vb.n_shingles")
    of = lambda x: vectors.select(F.col("doc_id").alias(x), F.col("v").alias(f"v{x}"))
    likely = lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b").filter(sizes & (matches("va", "vb") >= least_matches(limit)))

    # each member with pivots of its buckets: the likeliest pair of each
    sketch = ["n_shingles", *SKETCH]
    seen = members.join(vectors.select("doc_id", *[F.col(f"v.{c}").alias(c) for c in sketch]), "doc_id")
    pivots = [F.min_by(c, F.xxhash64("bucket", "doc_id", F.lit(k))).alias(f"_{c}_{k}") for k in range(PIVOTS) for c in ("doc_id", *sketch)]
    near = [F.when(_may(k, limit), F.col(f"_doc_id_{k}")) for k in range(PIVOTS)]
    starred = seen.join(seen.groupBy("bucket").agg(*pivots), "bucket").select("doc_id", F.explode(F.array_distinct(F.array_compact(F.array(*near)))).alias("a"))
    starred = likely(starred.select("a", F.col("doc_id").alias("b")).distinct()).select("a", "b", matches("va", "vb").alias("matching"))
    turn = Window.partitionBy("b").orderBy(F.desc("matching"), "a")  # at most PIVOTS * BANDS rows
    pairs = kept(starred.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= STAR_PAIRS).select("a", "b").distinct())
    # a doc_id in several rows is one vertex: its classes are linked through it
    again = sig.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    same = named.join(again, "doc_id", "left_semi").join(classes, sets).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels, path = components(kept(confirmed(pairs, bodies, width, limit).unionByName(same)))
    paths.append(path)

    # what may still join two components
    all_ = members.join(labels, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = all_.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("bucket")
    open_ = kept(all_.join(mixed, "bucket", "left_semi").select("doc_id", "component").distinct())
    met, path = sharing(bodies, open_, width, limit)
    paths.append(path)
    met = likely(met).filter(F.arrays_overlap("va.bands", "vb.bands")).select("a", "b", F.lit(0).alias("done"))
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("done"))
    left = kept(met.unionByName(tried).groupBy("a", "b").agg(F.max("done").alias("done")).filter("done = 0").select("a", "b"))
    more = kept(confirmed(left, bodies, width, limit))
    if not more.isEmpty():  # components of components
        top = lambda x: open_.select(F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"))
        joined = more.join(top("a"), "a").join(top("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        up, path = components(kept(joined))
        paths.append(path)
        up = up.select(F.col("doc_id").alias("_own"), F.col("component").alias("_top"))
        labels = all_.select("doc_id", "component").unionByName(labels.select("doc_id", "component")).distinct()
        labels = labels.join(up, F.col("component") == F.col("_own"), "left").select("doc_id", F.coalesce("_top", "component").alias("component"))
    member = sig.join(classes, sets, "left").select("doc_id", "n_shingles", "rep")
    tops = labels.select(F.col("doc_id").alias("_doc"), "component")
    out = member.join(tops, F.col("rep") == F.col("_doc"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    out, _ = staged(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    for path in paths:
        dropped(spark, path)
    return out


def cleaned(docs: DataFrame, width: int = 4) -> DataFrame:
    """One document of each component; same columns."""
    gone = linked(docs.select("doc_id", "text"), width).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
