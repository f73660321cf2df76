"""corpus_pipeline.run against a plain version of its five stages."""

import zlib

import brute
import numpy as np
import pytest
from test_contracts import PASSAGE, encoded, odd_texts

import corpus_pipeline
from fieldloom.llm import decontamination, packing, quality

SPACES = quality.SPACES


def good_lines(text):
    """The lines that pass, by the rules in plain words."""
    out = []
    for line in text.split("\n"):
        own, low = line.strip(SPACES), line.lower()
        chars = [c for c in line if c not in SPACES]
        marks = sum(c in quality.MARKS for c in line)
        fails = 10 * marks > len(chars) or line.count("|") >= 3 or any(x in low for x in quality.BOILERPLATE) or (len(brute.WORD.findall(line)) < 3 and own[-1:] not in tuple(quality.TERMINAL))
        if not own or not fails:
            out.append(line)
    return out


def quality_rules(rows):
    out = []
    for d, t in rows:
        if brute.quality(t)[-1]:
            continue
        kept = good_lines(t)
        chars = lambda x: sum(map(len, brute.WORD.findall(x)))
        text = "\n".join(kept)
        whole = len(kept) == len(t.split("\n"))
        if chars(text) >= quality.LEAST_KEPT * chars(t) and (whole or len(brute.WORD.findall(text)) >= quality.LEAST_WORDS):
            out.append((d, t if whole else text))
    return out


def line_dedup(rows):
    holders = {}
    for d, t in rows:
        for line in t.split("\n"):
            if brute.line_key(line) and d is not None:
                holders.setdefault(brute.line_key(line), set()).add(d)
    gone = lambda d, x: d is not None and len(own := holders.get(brute.line_key(x), ())) >= 3 and max(own) != d
    out = []
    for d, t in rows:
        kept = [x for x in t.split("\n") if not gone(d, x)]
        if len(kept) == len(t.split("\n")) or "\n".join(kept).strip(" "):
            out.append((d, "\n".join(kept)))
    return out


def near_dedup(rows):
    top = {d: c for d, _, c in brute.near(rows)}
    return [(d, t) for d, t in rows if d is None or top[d] == d]


def contaminated(text, items):
    """Whether some stretch of an item agrees in enough words with the text, at any place."""
    for own in items:
        span = min(len(own), decontamination.SPAN)
        if len(own) < decontamination.LEAST_WORDS or len(text) < span:
            continue
        same = np.array([text == w for w in own])
        for k in range(len(own) - span + 1):
            n = len(text) - span + 1
            if sum(same[k + j, j : j + n].astype(int) for j in range(span)).max() >= decontamination.SHARE * span:
                return True
    return False


def decontaminate(rows, items):
    number: dict = {}
    strip = str.maketrans("", "", "".join(chr(c) for c in range(128) if decontamination.textvec.PUNCTUATION[c]))
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in brute.words((t or "").translate(strip))], np.int64)
    items = [coded(t) for t in items]
    return [(d, t) for d, t in rows if not contaminated(coded(t), items)]


def cut(rows):
    out = []
    for d, ids in encoded(rows):
        ids = [*ids, 1]
        for k in range(0, len(ids), packing.CAPACITY):
            own = ids[k : k + packing.CAPACITY]
            out.append((d, k // packing.CAPACITY, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def whole(rows, items):
    return cut(decontaminate(near_dedup(line_dedup(quality_rules(rows))), items))


def checked(got, expected):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(expected, key=repr)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_equals_the_plain_stages(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    expected = whole(rows, items)
    assert 50 < len({x[0] for x in expected}) < len(rows)
    checked(corpus_pipeline.run(spark, folder).collect(), expected)


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_odd_rows(spark, tmp_path, empty):
    filler = "one two three four five six seven eight nine ten eleven twelve"
    texts = [*odd_texts(), *[f"This line stands in many documents.\n{filler} number {k} {'abcdefghij'[k]}.\nhome | about | login | more\n{' '.join(f'v{k}x{j}' for j in range(30))}" for k in range(6)]]
    rows = [] if empty else [*enumerate(texts), (None, texts[-1]), (None, None), (200, texts[6]), (8, texts[8])]
    schema = "doc_id long, text string, lang string, source string, n_chars int, raw string, _row int"
    spark.createDataFrame([(d, t, "en", "web", 1, "x", 2) for d, t in rows], schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    items = [PASSAGE, None, "too short"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.names == docs.schema.names, name
    checked(corpus_pipeline.run(spark, str(tmp_path)).collect(), whole(rows, items))
