"""What the methods promise beyond the contracts."""

import itertools
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_contracts import PASSAGE

from fieldloom.llm import decontamination, line_dedup, lm_scoring, near_dedup, packing, pii, secrets, textvec, toxicity


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# packing


def fewest(sizes, capacity):
    """Bins of an optimal packing, by search."""
    best, sizes = len(sizes), sorted(sizes, reverse=True)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                rooms.remove(r)
                rooms.append(r - sizes[k])
                place(k + 1, rooms)
                rooms.remove(r - sizes[k])
                rooms.append(r)
        rooms.append(capacity - sizes[k])
        place(k + 1, rooms)
        rooms.pop()

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    fixed, left = packing.reduced(Counter(sizes), 20)
    assert Counter(x for own, n in fixed for x in own for _ in range(n)) + Counter(left) == Counter(sizes)
    assert all(sum(own) <= 20 for own, _ in fixed)
    rest = list(Counter(left).elements())
    assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plans_hold_every_piece_once(counts):
    made = packing.plan(counts, 30)
    assert Counter({x: sum(n * own.count(x) for own, n in made.bins) for x in counts}) == Counter(counts)
    assert all(sum(own) <= 30 and n > 0 for own, n in made.bins)
    for x in counts:
        own = [s for s in made.segments().tolist() if s[0] == x]
        assert own[0][1] == 0 and own[-1][2] == counts[x] and all(a[2] == b[1] for a, b in itertools.pairwise(own))


# lines


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    made = line_dedup.CuckooFilter.of(keys[:2000])
    assert made.contains(keys[:2000]).all() and made.contains(keys[2000:]).mean() < 0.01
    made.remove(keys[:1000])
    assert made.contains(keys[1000:2000]).all() and made.contains(keys[:1000]).mean() < 0.01


def test_insertion_and_deletion_undo_each_other(spark):
    line = "a line that is long enough to count"
    other = "another line that is long enough too"
    docs = frame(spark, [f"{line}\n{other}", line, f"{line}\nx", other])
    rows = lambda df: sorted(map(tuple, df.collect()))
    dropped = lambda s: sorted((r["doc_id"], sorted(r["keys"])) for r in s.dropped().collect())
    before = line_dedup.LineState.of(docs)
    more = spark.createDataFrame([(10, other), (11, line)], "doc_id long, text string")
    after = before.insert(more)
    whole = line_dedup.LineState.of(docs.unionByName(more))
    assert rows(after.counts) == rows(whole.counts) and dropped(after) == dropped(whole) and len(dropped(after)) > len(dropped(before))
    back = after.delete(more)
    assert rows(back.postings) == rows(before.postings) and rows(back.counts) == rows(before.counts) and dropped(back) == dropped(before)
    keys = lambda s: {bytes(k[0]) for k in s.counts.select("key").collect()}
    held = {r["shard"]: line_dedup.CuckooFilter(1, np.frombuffer(r["slots"], np.uint16)) for r in back.filters.collect()}
    assert all(f.contains(line_dedup._pairs(sorted(keys(back)))).all() for f in held.values())
    assert sum(int((f.slots > 0).sum()) for f in held.values()) == len(keys(back))


def test_insertions_append(spark, monkeypatch):
    """The postings that were there are not written again, until there are many parts."""
    monkeypatch.setattr(line_dedup, "MOST_PARTS", 3)
    text = lambda k: f"a line that stands in all of them\na line of document {k} alone, long enough"
    state, sizes = line_dedup.LineState.of(frame(spark, [text(0), text(1)])), []
    for k in range(2, 6):
        state = state.insert(spark.createDataFrame([(k, text(k))], "doc_id long, text string"))
        sizes.append(len(state.parts))
        whole = line_dedup.LineState.of(frame(spark, [text(x) for x in range(k + 1)]))
        assert sorted(map(tuple, state.postings.collect())) == sorted(map(tuple, whole.postings.collect())) and sorted(map(tuple, state.counts.collect())) == sorted(map(tuple, whole.counts.collect()))
    assert sizes == [2, 3, 1, 2]
    assert len(state.dropped().collect()) == 5


@pytest.mark.parametrize("shard_keys", [line_dedup.SHARD_KEYS, 6000])
def test_insertions_go_on_when_a_shard_is_full(spark, monkeypatch, shard_keys):
    """With a larger filter, or with more shards."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    lines = "\n".join(f"line number {k} is long enough to count" for k in range(20000))
    state = line_dedup.LineState.of(frame(spark, ["this one line is long enough to count"] * 3))
    after = state.insert(spark.createDataFrame([(k, lines) for k in (10, 11, 12)], "doc_id long, text string"))
    assert after.n_shards == (1 if shard_keys > 20000 else 4)
    held = {r["shard"]: (r["n_keys"], line_dedup.CuckooFilter(1, np.frombuffer(r["slots"], np.uint16))) for r in after.filters.collect()}
    assert sum(n for n, _ in held.values()) == after.counts.count() == 20001
    keys = after.counts.select(line_dedup.shard(after.n_shards), "key").collect()
    assert all(held[k][1].contains(line_dedup._pairs([bytes(r["key"]) for r in keys if r["shard"] == k])).all() for k in held)
    assert {r["doc_id"]: len(r["keys"]) for r in after.dropped().collect()} == {0: 1, 1: 1, 10: 20000, 11: 20000}


@pytest.mark.parametrize("rows", [line_dedup.GROUP_ROWS, 5])
def test_filters_screen_at_every_size(spark, monkeypatch, rows):
    texts = [f"a line that stands in all of them\nand a line that is only in document {k}" for k in range(40)]
    state = line_dedup.LineState.of(frame(spark, texts))
    found = lambda: sorted((bytes(r["key"]), r["doc_id"]) for r in state.screened().collect())
    small = found()
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 1)
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", rows)
    assert found() == small and len(small) < state.postings.count()
    assert state.dropped().count() == 39


# near-duplicates


def test_estimates_are_corrected_for_chance(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(600)]
    texts = []
    for changes in (0, 4, 12, 40, 120):
        own = list(base)
        for k in rng.sample(range(600), changes):
            own[k] = f"c{k}"
        texts.append(" ".join(own))
    sig = near_dedup.signatures(frame(spark, texts)).select("doc_id", F.struct(*near_dedup.PLANES).alias("v"))
    pairs = sig.select(F.col("doc_id").alias("a"), F.col("v").alias("va")).crossJoin(sig.select(F.col("doc_id").alias("b"), F.col("v").alias("vb"))).filter("a < b")
    sets = [{tuple(t.split()[k : k + 4]) for k in range(597)} for t in texts]
    for r in pairs.select("a", "b", near_dedup.estimate(near_dedup.matches("va", "vb")).alias("e")).collect():
        x, y = sets[r["a"]], sets[r["b"]]
        assert abs(r["e"] - len(x & y) / len(x | y)) < 0.07


def test_chains_of_near_copies_and_large_groups(spark):
    rng = random.Random(4)
    own, texts = [f"w{k}" for k in range(150)], []
    for step in range(12):  # each near the one before, the ends far apart
        texts.append(" ".join(own))
        own[step * 11] = f"x{step}"
    group = [f"g{k}" for k in range(100)]
    for _ in range(60):
        copy = list(group)
        for k in rng.sample(range(100), rng.randint(0, 4)):
            copy[k] = f"y{rng.random()}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = [tuple(r) for r in near_dedup.linked(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute.near(rows))


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from fieldloom.llm.common import buffers
    import pyarrow as pa

    texts = ["alpha Beta  gamma\ndelta", "", " x ", "long" * 50 + " tail", "é ü ß"]
    whole = textvec.words(*buffers(pa.array(texts)))
    monkeypatch.setattr(textvec, "BLOCK", 7)
    cut = textvec.words(*buffers(pa.array(texts)))
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    assert np.diff(whole[1]).tolist() == [4, 0, 1, 2, 3]


# decontamination


@pytest.mark.parametrize("changed", [(), (3,), (2, 9), (4, 8, 12)])
def test_substitutions_are_tolerated(spark, changed):
    words = PASSAGE.split()
    for k in changed:
        words[k] = f"z{k}"
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = frame(spark, ["before it " + " ".join(words) + " after it", "one two three four " * 30])
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.contamination(docs, items).collect()}
    assert got == {0: True, 1: False}


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"{PASSAGE} number{k} of these{k} passages{k}") for k in range(12)], "item_id long, text string")
    docs = frame(spark, [f"{PASSAGE} number{k} of these{k} passages{k}" for k in range(0, 12, 3)] + ["none"])
    rows = lambda: sorted(map(str, decontamination.contamination(docs, items).collect()))
    whole = rows()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    assert rows() == whole


@pytest.mark.parametrize("most", [decontamination.BLOCK_WORDS, 20])
def test_rows_of_one_id_keep_their_own_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.upper() + " and more"), (3, "other words that none holds")], "item_id long, text string")
    docs = spark.createDataFrame([(None, PASSAGE, 1), (None, "clean", 2), (None, None, 3), (7, "clean too", 4), (7, PASSAGE, 5)], "doc_id long, text string, x int")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"], *r["items"]) for r in got) == [(0, False), (0, False), (0, True, 1, 2), (7, False), (7, True, 1, 2)]
    kept = decontamination.cleaned(docs, items)
    assert kept.columns == docs.columns and sorted(r["x"] for r in kept.collect()) == [2, 3, 4]


@pytest.mark.parametrize("size", range(5, 14))
def test_every_allowed_substitution_is_found(size):
    """Also in items of 5 and 6 words."""
    from fieldloom.llm.common import buffers
    import pyarrow as pa

    own = [f"w{k}" for k in range(size)]
    seeds = decontamination.Seeds([1], [" ".join(own).encode()])
    most = size - math.ceil(decontamination.SHARE * size)
    for n in range(most + 2):
        for changed in itertools.combinations(range(size), n):
            text = " ".join(["before", *("z" if k in changed else w for k, w in enumerate(own)), "after"])
            found = seeds.matches(*textvec.words(*buffers(pa.array([text])), punctuation=False))
            assert found == ([(0, 0, size - n)] if n <= most else [])


def plain_matches(texts, items):
    """(document, item, most agreeing words of a stretch on one diagonal that holds a seed), by trying all diagonals."""
    out = set()
    masks = decontamination.MASKS + decontamination.SHORT_MASKS
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            t_, x_ = t.split(), x.split()
            span, most = min(len(x_), decontamination.SPAN), 0
            if len(x_) < decontamination.LEAST_WORDS:
                continue
            own = masks if len(x_) <= decontamination.SHORT else decontamination.MASKS
            for shift in range(-len(x_) + 1, len(t_)):
                same = [x_[k] == t_[k + shift] for k in range(max(0, -shift), min(len(x_), len(t_) - shift))]
                if len(same) >= span and any(all(same[k + j] for j, c in enumerate(m) if c == "1") for m in own for k in range(len(same) - len(m) + 1)):
                    most = max(most, max(sum(same[k : k + span]) for k in range(len(same) - span + 1)))
            if most >= decontamination.SHARE * span:
                out.add((d, i, most))
    return out


def found_matches(texts, items):
    from fieldloom.llm.common import buffers
    import pyarrow as pa

    seeds = decontamination.Seeds(list(range(len(items))), [x.encode() for x in items])
    return seeds.matches(*textvec.words(*buffers(pa.array(texts)), punctuation=False))


@pytest.mark.parametrize(("bundle", "part", "size"), [(32, 1 << 16, 1 << 20), (2, 3, 7), (1000, 4, 5)])
def test_matches_equal_all_diagonals(monkeypatch, bundle, part, size):
    """Also where many items share a seed, and in small slices."""
    monkeypatch.setattr(decontamination, "BUNDLE", bundle)
    monkeypatch.setattr(decontamination, "BUNDLE_ROWS", part)
    monkeypatch.setattr(decontamination, "SLICE", size)
    rng = random.Random(6)
    some = lambda n, words: " ".join(rng.choices(words, k=n))
    items = [some(rng.randint(3, 30), "abc") for _ in range(30)] + [f"what is the best known name of {some(rng.choice((1, 2, 3, 20)), 'abcdefgh')}" for _ in range(60)] + ["", "a"]
    texts = ["", "a", *[some(rng.randint(1, 60), "abc") for _ in range(10)], *[f"{some(9, 'xyz')} what is the best known name of {some(12, 'abcdefgh')} what is the z known name" for _ in range(8)]]
    got = found_matches(texts, items)
    assert len(got) == len(set(got)) > 100
    assert set(got) == plain_matches(texts, items)


def test_many_items_of_one_stem_in_a_long_document():
    """14,000 items, some 12,000 occurrences: bounded time and memory."""
    import time

    rng = random.Random(1)
    stem = "which one of the following statements about topic{} is right"
    text = " ".join(stem.format(rng.randrange(20000)) + " so" for _ in range(12000))
    began = time.perf_counter()
    got = found_matches([text, "none"], [stem.format(k) for k in range(14000)])
    assert len(got) == 14000 and {m for _, _, m in got} == {9, 10} and {d for d, _, _ in got} == {0}
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(20,2)", "date", "boolean", "double"])
def test_item_ids_of_any_type(spark, kind):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string").withColumn("item_id", (F.to_date(F.lit("2024-01-01")) if kind == "date" else F.col("item_id").cast(kind)))
    got = decontamination.contamination(frame(spark, [PASSAGE, "none"]), items.unionByName(items))
    assert got.schema["items"].dataType.elementType == items.schema["item_id"].dataType
    assert sorted((r["contaminated"], len(r["items"])) for r in got.collect()) == [(False, 0), (True, 1)]


# secrets


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_queries_are_necessary(data):
    """Whatever matches a rule holds the trigrams of one of its alternatives."""
    for rule in secrets.RULES:
        text = data.draw(st.from_regex(re.compile(rule.pattern.replace("(?<![0-9a-f])", ""), re.A), fullmatch=True))
        query = secrets.trigram_query(rule.pattern)
        assert query is None or any(all(t in text.lower() for t in alternative) for alternative in query)


def test_every_base_rule_but_hex_has_a_query():
    assert [secrets.trigram_query(r.pattern) is None for r in secrets.BASE_RULES] == [False, False, True]


# personal data


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- ()4\né9%", max_size=60))
def test_parsers_equal_left_to_right_search(text):
    got, expected = pii.spans(text), brute.found(text, pii.BASE_KINDS)
    assert {k: got[k] for k in pii.BASE_KINDS} == expected


# language model


def plain_tree(rows, support, depth):
    """Probabilities by the same model, over tuples of words."""
    train = [[*brute.words(t), None] for d, t in rows]
    counts = Counter(w for own in train for w in own)
    n, v = sum(counts.values()), len(counts)
    grams = [None, Counter(), *[Counter() for _ in range(depth)]]
    for own in train:
        for size in range(1, depth + 2):
            for k in range(len(own) - size + 1):
                grams[size][tuple(own[k : k + size])] += 1
    held = [None, {g for g, c in grams[1].items() if c >= support}]
    for size in range(2, depth + 2):
        held.append({g for g, c in grams[size].items() if c >= support and g[:-1] in held[size - 1] and g[1:] in held[size - 1]})
    root = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    kept: dict = {}

    def probability(context, word):
        for k in range(len(context)):
            s = context[k:]
            if s in kept:
                own, factor = kept[s]
                return own[word] if word in own else factor * probability(s[1:], word)
        return root(word)

    for size in range(2, depth + 2):
        by: dict = {}
        for g in held[size]:
            by.setdefault(g[:-1], []).append(g)
        for s, own in by.items():
            p = {g[-1]: (grams[size][g] - lm_scoring.DISCOUNT) / grams[size - 1][s] for g in own}
            q = {w: probability(s[1:], w) for w in p}
            rest, other = max(1 - sum(p.values()), 1e-12), 1 - min(sum(q.values()), 1 - 1e-12)
            gain = grams[size - 1][s] * (sum(p[w] * math.log(p[w] / q[w]) for w in p) + rest * math.log(rest / other))
            if gain > lm_scoring.GAIN * (len(p) + 1):
                kept[s] = (p, rest / other)
    return kept, probability


def test_scores_equal_a_plain_tree(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        own = [rng.choice("abc"), rng.choice("abc")]
        for _ in range(rng.randint(10, 60)):  # the next word hangs on the last two
            own.append("abc"[(ord(own[-1]) + 2 * ord(own[-2])) % 3] if rng.random() < 0.8 else rng.choice("abcd"))
        texts.append(" ".join(own))
    ids = [k for k in range(400) if not brute.unigram([(k, "")])[0][1]][:60]
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, probability = plain_tree(rows, lm_scoring.LEAST_COUNT, lm_scoring.DEPTH)
    assert any(len(s) > 1 for s in kept)
    got = {r["doc_id"]: (r["base_score"], r["score"]) for r in lm_scoring.scored(docs).collect()}
    for d, t in rows:
        own = [*brute.words(t), None]
        expected = sum(math.log10(probability(tuple(own[max(0, k - lm_scoring.DEPTH) : k]), w)) for k, w in enumerate(own))
        assert got[d][1] == pytest.approx(expected, abs=1e-6)
    assert sum(s for _, s in got.values()) > sum(b for b, _ in got.values())


@pytest.mark.parametrize("bits", [(20, 27), (6, 8)])
def test_a_phrase_stays_however_large_the_corpus(spark, monkeypatch, bits):
    """Five occurrences in 200,000 tokens are stored; also where most of the tree is joined and the bit table is full."""
    rng = random.Random(4)
    phrase = "nine quiet lamps burn beside our river"
    ids = [k for k in range(1200) if not brute.unigram([(k, "")])[0][1]][:500]
    texts = [" ".join(f"w{int(600 * rng.random() ** 2)}" for _ in range(400)) for _ in ids]
    texts[::100] = [f"{x} {phrase} {x[:50]}" for x in texts[::100]]
    rows = list(zip(ids, texts, strict=True))
    monkeypatch.setattr(lm_scoring, "FREQUENT_BITS", bits[0])
    monkeypatch.setattr(lm_scoring, "SKETCH_BITS", bits[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, probability = plain_tree(rows, lm_scoring.LEAST_COUNT, lm_scoring.DEPTH)
    assert ("nine", "quiet", "lamps") in kept or ("lamps",) in kept
    got = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs).collect()}
    for d, t in rows[::20]:
        own = [*brute.words(t), None]
        expected = sum(math.log10(probability(tuple(own[max(0, k - lm_scoring.DEPTH) : k]), w)) for k, w in enumerate(own))
        assert got[d] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("parts", [3, 40])
def test_base_scores_however_many_partitions(spark, parts):
    """More partitions than a staged table gets files: then one task makes the batches of several."""
    rows = [(k, " ".join(f"w{k * j % 37}" for j in range(1 + k % 30)) + f" seldom{k // 2}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in lm_scoring.scored(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    for own, plain in zip(sorted(got), sorted(brute.unigram(rows)), strict=True):
        assert own == pytest.approx(plain, abs=1e-6)


@pytest.mark.parametrize("doublings", [10, 12])
def test_long_words_of_equal_polynomials_stay_apart(spark, doublings):
    a = "a"
    for _ in range(doublings):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = list(enumerate([f"{a} x", b, f"{b} {a.upper()}", f"{b[:-1]} {a}", "x", f"{b}c {b}"]))
    got = [tuple(r) for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    for own, plain in zip(sorted(got), sorted(brute.unigram(rows)), strict=True):
        assert own == pytest.approx(plain, abs=1e-6)


def test_packed_rows_are_written_in_small_groups(spark, monkeypatch, tmp_path):
    """Parquet's writer and reader hold a group of rows at once: its size must not follow the number of batches."""
    monkeypatch.setattr(lm_scoring, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 1 << 14)
    monkeypatch.setattr(lm_scoring, "FREQUENT_BITS", 2)
    rng = random.Random(6)
    rows = [(k, " ".join(f"word{rng.randrange(10**6)}" for _ in range(2000))) for k in range(90)]
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    out = lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert spark.conf.get(name) == before
    files = [pq.ParquetFile(x).metadata for x in tmp_path.glob("staged/*/question=false/*.parquet")]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(x.num_rows for x in groups) == 90
    assert max(x.total_byte_size for x in groups) < 8 << 16
    assert {r["doc_id"]: r["n_known"] for r in out.collect()} == {r[0]: r[3] for r in brute.unigram(rows)}


# toxicity


def toxic_cells(rng, n=60, width=5):
    at = [sorted(rng.sample(range(width), rng.randint(0, width))) for _ in range(n)]
    return at, [[rng.randint(1, 4) for _ in x] for x in at]


def test_slopes_equal_differences_of_the_loss():
    rng = random.Random(8)
    at, many = toxic_cells(rng)
    x = toxicity.Sparse.of(at, many, 5)
    dense = np.zeros((60, 5))
    for k, (a, m) in enumerate(zip(at, many, strict=True)):
        dense[k, a] = np.log1p(m)
    w, raw = np.array([rng.uniform(-1, 1) for _ in range(5)]), np.array([0.3, -0.2])
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(np.arange(60.0)), dense.T @ np.arange(60.0))
    assert np.allclose(x.taken(np.array([3, 7, 9])).dot(w), (dense @ w)[[3, 7, 9]])
    grade = np.array([rng.randint(0, 2) for _ in range(60)])
    value, by_w, by_raw = toxicity.loss(w, raw, x, grade, 1e-2)
    theta = raw[0] + np.array([0, np.exp(raw[1])])
    above = np.concatenate([np.ones((60, 1)), 1 / (1 + np.exp(theta[None, :] - (dense @ w)[:, None])), np.zeros((60, 1))], axis=1)
    assert value == pytest.approx(-np.log([above[k, g] - above[k, g + 1] for k, g in enumerate(grade)]).mean() + 0.005 * w @ w)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up, down = (toxicity.loss(w + s * step[:5], raw + s * step[5:], x, grade, 1e-2)[0] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(np.concatenate([by_w, by_raw])[k], abs=1e-6)


def test_ordinal_fit_finds_ordered_grades():
    rng = random.Random(5)
    at = [[0] if g == 0 else [1] if g == 1 else [1, 2] for g in (rng.randint(0, 2) for _ in range(300))]
    grade = np.array([0 if x == [0] else len(x) for x in at])
    x = toxicity.Sparse.of(at, [[1] * len(y) for y in at], 3)
    model = toxicity.ordinal(np.arange(3, dtype=np.uint64), x, grade)
    assert model.thresholds[0] < model.thresholds[1]
    above = model.above(x.dot(model.weights))
    assert ((above > 0.5).sum(1) == grade).mean() > 0.99


def test_toxicity_of_odd_labels(spark):
    """Nulls, repeated and missing labels count as stated; partitions don't matter; documents are scored one by one."""
    bad, good = "you utter nasty fool", "a calm walk along the river bank"
    texts = [(f"{bad} number{k} " * (1 + k % 3) if k % 4 == 0 else f"{good} number{k}") for k in range(120)]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, bad), (None, None), (4, texts[4])], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (8, 0), (999, 1)], "doc_id long, toxic int"))
    model = toxicity.fitted(docs, labels)
    for other in (toxicity.fitted(docs.repartition(7), odd.repartition(5)), toxicity.fitted(docs.coalesce(1), odd)):
        assert np.array_equal(model.features, other.features) and np.allclose(model.weights, other.weights, atol=1e-12) and model.cut == other.cut
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 123
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None)
    assert sorted(r["toxic"] for r in got if r["doc_id"] is None) == [False, True]
    one = toxicity.fitted(docs, labels.filter("toxic = 1"))
    assert not any(r["toxic"] or r["expected_severity"] for r in toxicity.scored(docs, one).collect())
    assert not len(toxicity.fitted(docs, labels.limit(0)).features)


# token ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_other_tokenizer_files(name):
    """Chunks are taken apart only where the file allows it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from fieldloom.llm import tokens

    texts = ["Two  words\nand it's 12 more.", "", " lead", "Café ÀÉ <|endoftext|> x", "don't stop"]
    made, own = tokens.ChunkEncoder(tokens.tokenizer_path(name)), Tokenizer.from_file(tokens.tokenizer_path(name))
    expected = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert made.chunked == (name == "word_bpe_49k.json") == (made.merged is not None)
    column = pa.array([t.encode() for t in texts])
    assert made.lengths(column).tolist() == [len(x) for x in expected]
    ids, starts = made.encode(column, 1)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(starts)] == [[*x, 1] for x in expected]


# secrets in long texts and rows without an id


def test_secrets_in_texts_of_many_matches(spark):
    texts = ["token: abcdefgh1 " * 1500, "0123456789abcdef0123456789abcdef " * 700, "token: abcdefgh1 " * secrets.BLOCK]
    rows = [*enumerate(texts), (None, "token: abcdefgh1"), (None, None), (2, "nothing"), (2, "secret=abcdefgh")]
    got = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    plain = sorted(((d, *brute.secrets(t)) for d, t in rows), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=repr) == plain


@pytest.mark.parametrize("bits", [secrets.BITS, secrets.ROW_BITS])
def test_the_bit_table_does_not_change_results(spark, monkeypatch, bits):
    monkeypatch.setattr(secrets, "BITS", bits)
    docs = frame(spark, [f"plain {k}" if k % 5 else f"token: abcdefgh{k}" for k in range(300)])
    assert {r["doc_id"] for r in secrets.scanned(docs).filter("n_assign > 0").collect()} == set(range(0, 300, 5))
