"""Operator 8: secret scans over a trigram index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is
derived, as alternatives of conjunctions: literals give conjunctions,
branches and small character classes alternatives. Postings (trigram,
doc_id) are gathered for the trigrams of all queries, intersected for each
document as bit masks, and only documents that satisfy a rule's query are
searched by its expression. Rules without mandatory trigrams search every
document.

The candidates are a stored table. A bit table of theirs, of fixed size, is
sent to all tasks; only texts that it holds are shuffled to the candidates,
all others are searched where they are, by the rules without a query. The
bit table decides what is shuffled and never what is found.

Match positions come from the pieces between matches: a match starts after
all pieces and matches before it, which running sums over blocks of matches
give.

Defined results: null and empty texts hold nothing; repeated rows are
searched alike; a doc_id in several rows is a candidate in all of them if
one satisfies the query, and each is verified by itself; rows with a null
doc_id are searched by every rule, where they are; other columns are
ignored; an empty table gives an empty result. Offsets are in code points,
ends are exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .quality import let


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and, for the query, for Python; group and least: code points that this group must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 or more is the only way in which AKIA and its run reach 16 characters; likewise runs of hex digits.
BASE_RULES = (Rule("assign", ASSIGN, 2, 8), Rule("access", r"AKIA[A-Z0-9]{12,}"), Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"))
RULES = (
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("repository", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Strings that a literal part of a pattern may stand for before it is split.
MOST_STRINGS = 24

#: A query: alternatives, each a set of trigrams that a text must hold together; None: nothing is mandatory.
Query = frozenset | None
MOST_ALTERNATIVES = 64
#: Bits of the bit table of candidates (16 MB), and of one row of it.
BITS, ROW_BITS = 1 << 27, 1 << 15
#: Matches of one block of the running sums.
BLOCK = 512


def either(alternatives: set[frozenset]) -> Query:
    """The query without alternatives that another one implies."""
    if frozenset() in alternatives or not alternatives:
        return None
    return frozenset(x for x in alternatives if not any(y < x for y in alternatives))


def both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_ALTERNATIVES:  # weaker, but still necessary
        return min(a, b, key=len)
    return either({x | y for x in a for y in b})


def of_strings(strings: set[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return either({frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings})


def _strings(op: int, arg: object) -> set[str] | None:
    """All lower-cased strings of a part, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_STRINGS else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, part = arg
        own = _all(part)
        if most is sre.MAXREPEAT or most > 3 or own is None:
            return None
        out, now = set(), {""}
        for k in range(int(most) + 1):
            if k >= least:
                out |= now
            now = {a + b for a in now for b in own}
        return out if len(out) <= MOST_STRINGS else None
    if op is sre.SUBPATTERN:
        return _all(arg[-1])
    if op is sre.BRANCH:
        parts = [_all(x) for x in arg[1]]
        return None if None in parts or sum(map(len, parts)) > MOST_STRINGS else set().union(*parts)
    return {""} if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else None


def _all(parts: object) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        own = _strings(op, arg)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _query(parts: object) -> Query:
    out, run = None, {""}
    for op, arg in parts:
        own = _strings(op, arg)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        out, run = both(out, of_strings(run)), {""}
        if own is not None:
            run = own
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out = both(out, _query(arg[2]) if arg[0] else None)
        elif op is sre.SUBPATTERN:
            out = both(out, _query(arg[-1]))
        elif op is sre.BRANCH:
            parts = [_query(x) for x in arg[1]]
            out = both(out, None if None in parts else either(set().union(*parts)))
    return both(out, of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean query of a pattern over trigrams of lower-cased text."""
    return _query(parser.parse(pattern))


def trigrams(query: Query) -> set[str]:
    return set().union(*query) if query else set()


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id): which documents hold which of the wanted trigrams; trigram is its place in the list."""
    low = docs.select("doc_id", F.lower("text").alias("low")).filter("low is not null and doc_id is not null")
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(wanted)]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query], wanted: list[str]) -> DataFrame:
    """doc_id and, for each rule, whether its postings intersect in the document."""
    words = range(-(-len(wanted) // 62))
    masks = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, F.expr("shiftleft(1L, trigram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words]

    def holds(query: Query) -> Column:
        out = F.lit(False)
        for alternative in sorted(map(sorted, query)):
            own = F.lit(True)
            for w in words:
                bits = sum(1 << k % 62 for k in map(wanted.index, alternative) if k // 62 == w)
                own = own & (F.col(f"m{w}").bitwiseAND(F.lit(bits).cast("long")) == F.lit(bits).cast("long"))
            out = out | own
        return out

    found = index.groupBy("doc_id").agg(*masks).select("doc_id", *[holds(q).alias(f"may_{k}") for k, q in queries.items()])
    some = F.lit(False)
    for k in queries:
        some = some | F.col(f"may_{k}")
    return found.filter(some)


def _running(sizes: Column, start: Column) -> Column:
    """start plus the sum of all sizes before each one."""
    begin = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
    return F.aggregate(sizes, begin, step, lambda s: s["out"])


def running_sums(sizes: Column) -> Column:
    """The sum of all sizes before each one; blocks first, then inside them, so that long arrays aren't copied at every element."""

    def blocked(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(x) - 1).cast("int"), F.lit(BLOCK)), lambda k: F.slice(x, k + 1, F.lit(BLOCK)))
        total = lambda y: F.aggregate(y, F.lit(0), lambda a, n: a + n)
        return let(blocks, lambda y: let(_running(F.transform(y, total), F.lit(0)), lambda at: F.flatten(F.transform(y, lambda own, k: _running(own, F.get(at, k))))))

    return let(sizes, lambda x: F.when(F.size(x) <= BLOCK, _running(x, F.lit(0))).otherwise(blocked(x)))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches, by start."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def found(gaps: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        good = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)

        def placed(m: Column) -> Column:
            before = lambda k: F.length(F.get(gaps, k))
            return let(running_sums(F.transform(m, lambda n, k: before(k) + n)), lambda at: F.transform(m, lambda n, k: F.struct((F.get(at, k) + before(k)).alias("start"), F.lit(kind).alias("kind"), (F.get(at, k) + before(k) + n).alias("end"))))

        all_ = let(matches, placed)
        return let(good, lambda g: F.filter(all_, lambda x, k: F.get(g, k))) if rule.least else all_

    return let(F.split(text, pattern, -1), lambda gaps: F.when(F.size(gaps) > 1, found(gaps)).otherwise(none))


def _bit(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BITS))


def bit_table(ids: DataFrame) -> DataFrame:
    """(_at, _bits): a bit for each doc_id, in BITS / ROW_BITS rows of 4 kB at most."""
    bit = ids.select(_bit("doc_id").alias("b")).select(F.floor(F.col("b") / ROW_BITS).cast("int").alias("_at"), F.pmod("b", F.lit(ROW_BITS)).alias("b"))
    return bit.groupBy("_at").agg(F.bitmap_construct_agg("b").alias("_bits"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of each rule, the digest of the base spans, and all spans."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    found, _ = staged(candidates(postings(docs, wanted), queries, wanted).select(F.col("doc_id").alias("_doc"), *[f"may_{k}" for k in queries]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(_bit("doc_id") / ROW_BITS).cast("int").alias("_at"))
    bits = F.broadcast(bit_table(found.select(F.col("_doc").alias("doc_id"))))  # at most BITS bits
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.join(bits, "_at", "left").withColumn("_in", F.coalesce((byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(xxhash64(doc_id), {ROW_BITS}) % 8 as int))")) != 0) & F.col("doc_id").isNotNull(), F.lit(False)))
    here = rows.filter("not _in").select("doc_id", "text", *[F.col("doc_id").isNull().alias(f"may_{k}") for k in queries])
    there = rows.filter("_in").select("doc_id", "text").join(found, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", *[F.coalesce(f"may_{k}", F.lit(False)).alias(f"may_{k}") for k in queries])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    names = F.array(*[F.lit(r.kind) for r in rules])
    n_base = sum(1 for r in rules if r.kind in {x.kind for x in BASE_RULES})

    def text_of(n: int) -> Column:
        found = F.sort_array(F.concat(*[F.col(f"_s{k}") for k in range(n)]))
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def searched(part: DataFrame) -> DataFrame:
        each = [F.when(F.col(f"may_{r.kind}"), spans(F.col("text"), r, k)).otherwise(none) if r.kind in queries else spans(F.col("text"), r, k) for k, r in enumerate(rules)]
        listed = part.select("doc_id", *[c.alias(f"_s{k}") for k, c in enumerate(each)])
        return listed.select("doc_id", *[F.size(f"_s{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules)], F.sha2(text_of(n_base), 256).alias("base_sha256"), text_of(len(rules)).alias("spans"))

    return searched(here).unionByName(searched(there))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
