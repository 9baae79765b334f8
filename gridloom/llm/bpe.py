"""BPE encoding and decoding over a contiguous rank array.

A short word keeps its parts and the merge ranks of adjacent parts in two
flat arrays. The smallest rank is looked for again and again, its boundary
goes, and the two ranks beside it are refreshed. Words over ``LONG`` symbols
take the same merges from a heap, so that a text without spaces stays near
linear. Words that were seen lately are kept, up to a bound.

The tokenizer file is one of the JSON files of the ``tokenizers`` library with
a byte-level BPE model that marks word ends; its path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Symbols of a word beyond which a heap replaces the scan, and words kept.
LONG, KEPT_WORDS = 128, 100_000
_NONE = 1 << 60
#: Unicode white space, which ends a word.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BREAKS = regex.compile(f"[{_SPACES}]+")
#: Characters that str.split takes for white space and the pattern does not.
_ODD = regex.compile("[\\x1c-\\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Tokenizer:
    """Encodes and decodes as the file says, without special tokens of its own, truncation or padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if spec["decoder"] is not None or model["unk_token"] is not None or [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"] or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is no word-end BPE file of the kind that is handled here")
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        self.bits = size.bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << self.bits | vocab[b], k)
            self.made.append(vocab[a + b])
        self.token = [b""] * size
        for t, i in chain(vocab.items(), self.special.items()):
            self.token[i] = t.encode()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _SPACES)
        self.pieces = regex.compile(pattern, regex.V0).findall
        self.parted = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, list[int]] = {}
        self.new_pieces: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one word."""
        parts = [self.inner[b] for b in piece]
        parts[-1] = self.final[piece[-1]]
        if len(parts) > LONG:
            return self._merged_long(parts)
        rank, bits, made = self.rank.get, self.bits, self.made
        ranks = [rank(a << bits | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << bits | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << bits | parts[i + 1], _NONE)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        n, rank, bits = len(parts), self.rank.get, self.bits
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << bits | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or rank(parts[i] << bits | parts[j], _NONE) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << bits | parts[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def word(self, raw: str) -> tuple[int, ...]:
        """Token ids of a run of characters without white space."""
        ids: list[int] = []
        for k, part in enumerate(self.parted(raw)) if "<" in raw else ((0, raw),):
            if k % 2:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for piece in self.pieces(part.lower()):
                got = self.new_pieces.get(piece)
                if got is None:
                    got = self.old_pieces.get(piece) or self.merged(piece.encode())
                    if len(piece) <= LONG:
                        if len(self.new_pieces) >= KEPT_WORDS:
                            self.old_pieces, self.new_pieces = self.new_pieces, {}
                        self.new_pieces[piece] = got
                ids += got
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        new, old = self.new, self.old
        for raw in text.split() if not _ODD.search(text) else filter(None, _BREAKS.split(text)):
            got = new.get(raw)
            if got is None:
                got = old.get(raw)
                if got is None:
                    got = self.word(raw)
                if len(raw) <= LONG:
                    if len(new) >= KEPT_WORDS:
                        self.old = old = new
                        self.new = new = {}
                    new[raw] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The tokens, special ones too, joined by spaces: the file names no decoder."""
        return b" ".join(map(self.token.__getitem__, ids))


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer at ``path``, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise TypeError("unsigned int has not 4 bytes here")
    return out.tobytes()


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``ids``: token ids as little-endian unsigned 32-bit integers.

    With ``decoded`` also the text that the ids decode to, from the same pass.
    Null texts are empty and have no ids; every other text is encoded whole.
    Rows that repeat are each encoded; the lowest rank, then the leftmost place
    decides between merges; no documents give no rows; columns other than
    ``keep`` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [t.encode(x or "") for x in b.column(b.num_columns - 1).to_pylist()]
                out = [*b.columns[:-1], pa.array(map(_packed, ids), pa.binary(), size=len(ids))]
                if decoded:
                    out.append(pa.array([t.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:-1], "ids", "decoded"][: len(out)])

    small_batches(docs.sparkSession)
    cut = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return cut.mapInArrow(run, f"{schema}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of packed ``ids``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            texts = [t.decode(array("I", x or b"")) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names[:-1], "decoded"])

    small_batches(encoded.sparkSession)
    cut = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return cut.mapInArrow(run, f"{schema}, decoded string")
