"""Exact token ids at corpus speed.

A public tokenizer whose pre-tokens never span ASCII white space encodes
each white-space-delimited chunk by itself. So ids are looked up in a
table of chunks (by a 64-bit hash, A-Z as a-z), filled where a chunk is
new; the table is emptied when it reaches a fixed number of entries, so
memory is bounded. Lookups and joins are array operations over a batch.
Texts that hold a special token's string go to the tokenizer whole, and so
do all texts where the file's normaliser or pre-tokenizer is another one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textvec
from .common import buffers

#: The table is emptied beyond this many chunks; bytes of text that are encoded at once. Both bound a worker's memory.
MOST_CHUNKS, TEXT_BYTES = 500_000, 2 << 20
#: Marks that may be cut off a chunk's end when what stands before is a letter or digit: they always begin a new pre-token.
TAIL = re.compile(rb"^(.*?)([.,!?;:*$%&#|]+)$", re.S)

#: The normaliser and the pre-tokenizer for which chunks can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes and the characters that stand for them in byte-level vocabularies: printable ones for themselves, others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in _PLAIN]
_BYTES = [*_PLAIN, *_REST]
_CHARS = [*map(chr, _PLAIN), *(chr(0x100 + k) for k in range(len(_REST)))]


class ChunkEncoder:
    """ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Chunks are taken apart for tokenizers that drop white space, lower-case
    with NFC, and pre-tokenize into runs of letters, single digits and runs
    of marks. If the model merges bytes with an end-of-word suffix, ids in
    the order of the merges, letter runs and runs of marks at a chunk's end
    go through a faster byte-pair engine with the same vocabulary,
    everything else through the tokenizer. The file is checked for all this.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[int, int] = {}
        self._clear()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        plain = not any(x.get(k) for x in made.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        cut = made.get("truncation") or made.get("padding")
        self.chunked = plain and not cut and made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER
        self.merged = self._engine(made["model"]) if self.chunked else None

    @staticmethod
    def _engine(model: dict) -> Callable[[bytes], list[int]] | None:
        """ids of one pre-token, or None where the vocabulary isn't of this kind. The suffix is the byte FF, which no text has."""
        import tiktoken

        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("ignore_merges", "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")):
            return None
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        merged = [model["vocab"].get("".join(x), -1) for x in pairs]
        if any(a >= b for a, b in zip([-1, *merged], merged, strict=False)):  # ids must follow the order of the merges
            return None
        byte = {c: b for b, c in zip(_BYTES, _CHARS, strict=True)}
        ranks = {}
        for word, rank in model["vocab"].items():
            end = word.endswith("</w>") and word != "</w>"
            own = word[:-4] if end else word
            if all(c in byte for c in own):
                ranks[bytes(byte[c] for c in own) + b"\xff" * end] = rank
        if any(bytes([b]) not in ranks or bytes([b, 255]) not in ranks for b in range(255)):
            return None
        ranks[b"\xff"] = max(model["vocab"].values()) + 1
        made = tiktoken.Encoding("own", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda piece: made.encode_single_piece(piece + b"\xff")

    def _letters(self, part: bytes) -> bytes | None:
        """The pre-token that a run of letters becomes, or None where only the tokenizer can tell."""
        if part.isalpha():
            return part.lower()
        if part.isascii():
            return None
        text = part.decode()
        low = text.lower()
        same = text.isalpha() and len(low) == len(text) and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)
        return low.encode() if same else None

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """ids of each chunk."""
        out: list = [None] * len(chunks)
        rest = []
        for k, c in enumerate(chunks):
            found = TAIL.match(c)
            head, tail = found.groups() if found else (c, b"")
            own = self._letters(head) if self.merged else None
            if own is None:
                rest.append(k)
            else:
                out[k] = self.merged(own) + self.merged(tail) if tail else self.merged(own)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _entries(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table entry of every chunk, and where each text's chunks begin."""
        places: list = []
        (hashes,), starts = textvec.heads(offsets, raw, (0,), places=places)
        if not len(hashes):
            return np.zeros(0, np.int64), starts
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys, get = own.tolist(), self.table.get
        entry = [get(k, -1) for k in keys]
        missing = [k for k, e in enumerate(entry) if e < 0]
        if missing:
            if len(self.table) + len(missing) > MOST_CHUNKS and self.table:
                self._clear()
                return self._entries(offsets, raw)
            begin, end = (np.concatenate(x) for x in zip(*places, strict=True))
            at = first[missing]
            chunks = [raw[a:b].tobytes() for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            found = self._ids(chunks)
            base = len(self.begins) - 1
            flat = np.fromiter(chain.from_iterable(found), np.uint32)
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in found])])
            self.ids = np.concatenate([self.ids, flat])
            for n, k in enumerate(missing):
                entry[k] = self.table[keys[k]] = base + n
        return np.array(entry, np.int64)[back], starts

    def _clear(self) -> None:
        self.table.clear()
        self.ids, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, offsets: np.ndarray, raw: np.ndarray) -> dict[int, np.ndarray]:
        """ids of the texts that hold a special token's string, by place."""
        data = raw[offsets[0] : offsets[-1]].tobytes()
        if not any(x in data for x in self.special):
            return {}
        out = {}
        for d in range(len(offsets) - 1):
            text = data[offsets[d] - offsets[0] : offsets[d + 1] - offsets[0]]
            if any(x in text for x in self.special):
                out[d] = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return out

    def _plain(self, column: pa.Array) -> list[list[int]]:
        """ids of each text by the tokenizer alone."""
        texts = [(x or b"").decode() if isinstance(x, bytes | None) else x for x in column.to_pylist()]
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.chunked:
            return np.array([len(x) for x in self._plain(column)], np.int64)
        offsets, raw = buffers(column)
        entry, starts = self._entries(offsets, raw)
        total = np.concatenate([[0], np.cumsum(np.diff(self.begins)[entry])])
        out = np.diff(total[starts])
        for d, ids in self._whole(offsets, raw).items():
            out[d] = len(ids)
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin; end: an id put after every text."""
        if not self.chunked:
            own = [x + [end] * (end is not None) for x in self._plain(column)]
            return np.fromiter(chain.from_iterable(own), np.uint32), np.cumsum([0, *map(len, own)])
        offsets, raw = buffers(column)
        entry, starts = self._entries(offsets, raw)
        sizes = np.diff(self.begins)[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(total[starts])
        flat = self.ids[np.repeat(self.begins[entry] - total[:-1], sizes) + np.arange(total[-1])]
        whole = self._whole(offsets, raw)
        if end is None and not whole:
            return flat, np.concatenate([[0], np.cumsum(lengths)])
        parts, tail = [], np.array([] if end is None else [end], np.uint32)
        for d in range(len(lengths)):
            parts += [whole[d] if d in whole else flat[total[starts[d]] : total[starts[d + 1]]], tail]
        begins = np.cumsum([0, *(len(parts[k]) + len(tail) for k in range(0, len(parts), 2))])
        return (np.concatenate(parts) if parts else flat), begins


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
