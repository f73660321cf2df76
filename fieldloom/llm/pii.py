"""Operator 9: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs,
digits, scheme separators and account cues. At each anchor a parser that
looks at nothing but the surrounding run of characters finds the bounds of
an email address, network address, card number, telephone number, account
number or login in an address, and validates it. Text without anchors is
never looked at again.

The parsers take what a left-to-right search for the contract's patterns
takes: runs are maximal, a run that fails is passed over as a whole, and
nothing overlaps within a kind.

Defined results: null and empty texts hold nothing; repeated rows are
searched alike; null doc_ids are carried through; other columns are
ignored; an empty table gives an empty result. Offsets are in code points,
ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "login")
CUES = ("IBAN", "iban", "Iban")

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOCAL = frozenset(_LETTERS + "0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"[\x20().0-9-]+")
_GROUP = re.compile(r"(?:[\x20-]?[0-9])+")
_IBAN = re.compile(r"[:\x20]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_LOGIN = re.compile(r"[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$&*=-]+@[A-Za-z0-9.-]+")
_MANY = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _automaton():  # noqa: ANN202
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in (("@", "@"), ("+", "+"), ("://", ":"), *((c, "i") for c in CUES), *((str(d), "0") for d in range(10))):
        out.add_word(word, kind)
    out.make_automaton()
    return out


_AUTOMATON: list = []


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, by start."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail = address = card = phone = account = login = 0  # ends of what each parser has passed
    n = len(text)
    for at, kind in _AUTOMATON[0].iter(text):
        if kind == "0":
            if at >= address:
                end = _DIGITS.match(text, at).end()
                parts = [(at, end)]
                while end + 1 < n and text[end] == "." and "0" <= text[end + 1] <= "9":
                    start = end + 1
                    end = _DIGITS.match(text, start).end()
                    parts.append((start, end))
                address = end
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    if all(len(p := text[a:b].lstrip("0")) < 4 and int(p or "0") < 256 for a, b in four):
                        out["ip"].append((four[0][0], four[3][1]))
            if at >= card:
                found = _GROUP.match(text, at + 1)
                card = found.end() if found else at + 1
                if card - at >= 16:
                    own = "".join(_MANY.findall(text[at:card]))
                    if 16 <= len(own) <= 19 and luhn(own):
                        out["card"].append((at, card))
        elif kind == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            host = _HOST.match(text, at + 1)
            if start < at and host:
                end = last = host.end()
                while end < n and text[end] == "." and (label := _HOST.match(text, end + 1)):
                    end = label.end()
                if end > last:
                    out["email"].append((start, end))
                    mail = end
        elif kind == "+":
            if at >= phone and at + 1 < n and "0" <= text[at + 1] <= "9" and (run := _PHONE.match(text, at + 2)):
                end = run.end()
                while end > at + 2 and not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end >= at + 4:
                    if 8 <= len(_MANY.findall(text[at:end])) <= 15:
                        out["phone"].append((at, end))
                    phone = end
        elif kind == "i":
            if at >= account and (found := _IBAN.match(text, at + 1)):
                own = found[1]
                while len(own) >= 15:
                    flat = own.replace(" ", "")
                    if own[-1] != " " and len(flat) >= 15 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                        out["iban"].append((found.start(1), found.start(1) + len(own)))
                        account = found.start(1) + len(own)
                        break
                    own = own[:-1]
        else:
            start = at - 2
            while start > login and text[start - 1] in _LETTERS:
                start -= 1
            if start < at - 2 and start >= login and (found := _LOGIN.match(text, at + 1)):
                out["login"].append((start, found.end()))
                login = found.end()
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, the digest of the base spans, and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            counts, digests, all_ = {k: [] for k in KINDS}, [], []
            for text in batch.column("text").to_pylist():
                found = spans(text)
                for k in KINDS:
                    counts[k].append(len(found[k]))
                digests.append(hashlib.sha256(joined(found, BASE_KINDS).encode()).hexdigest())
                all_.append(joined(found, KINDS))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(all_, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
