"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def quality(text):
    text = text or ""
    own = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(own[k : k + 5]) for k in range(len(own) - 4)]
    n = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(own) < 10 or 100 * len(hit) > 20 * len(own)


def line_key(line):
    key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)
    return key if len(key) >= 20 else None


def line_dedup(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if line_key(line) and doc is not None:
                holders[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and line_key(x) and len(holders[line_key(x)]) >= 3 and max(holders[line_key(x)]) != doc  # noqa: B023, E731
        kept = [x for x in lines if not gone(x)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def near(rows, width=4, limit=80):
    sets = []
    for doc, text in rows:
        own = words(text)
        sets.append((doc, frozenset([tuple(own[k : k + width]) for k in range(len(own) - width + 1)] if len(own) >= width else ([tuple(own)] if own else []))))
    top = {d: d for d, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[1] and s[0] is not None], 2):
        if 100 * len(x & y) >= limit * len(x | y) and root(a) != root(b):
            lo, hi = sorted((root(a), root(b)))
            top[hi] = lo
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    own = [int(c) for c in reversed(digits)]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(own)) % 10 == 0


CHECKS = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "hex": lambda m: len(m[0]) >= 32,
    "email": lambda m: True,
    "ip": lambda m: all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")),
    "card": lambda m: 16 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and _luhn(d),
    "phone": lambda m: 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15,
}


def found(text, kinds):
    return {k: [m.span() for m in PATTERNS[k].finditer(text or "") if CHECKS[k](m)] for k in kinds}


def secrets(text):
    own = found(text, ("assign", "access", "hex"))
    rows = sorted((a, n, k, b) for n, (k, v) in enumerate(own.items()) for a, b in v)
    return (*(len(v) for v in own.values()), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in rows).encode()).hexdigest())


def pii(text):
    own = found(text, ("email", "ip", "card", "phone"))
    return (*(len(v) for v in own.values()), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, v in own.items() for a, b in v).encode()).hexdigest())


def unigram(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(*words(t), None) for _, t in rows]
    counts = Counter(x for (d, _), own in zip(rows, tokens, strict=True) if not held(d) for x in own)
    n, v = sum(counts.values()), len(counts)
    return [(d, held(d), len(own), sum(counts[x] > 0 for x in own), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)) for (d, _), own in zip(rows, tokens, strict=True)]
