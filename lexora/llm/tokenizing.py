"""Exact encoders for two public byte-pair vocabularies, made fast by remembering words.

Both read a tokenizers JSON file and give the ids its library gives without special tokens being
added. Text is cut where the file's own pre-tokenizer must cut it, each distinct stretch is
encoded once and remembered up to ``REMEMBER`` stretches, and pair merging runs in compiled code.
Letters, numbers and spaces are classed the same by this code and the library for every character
that Python's version of Unicode assigns; a text with any other is given to the library itself.

A stretch that offers no cut for ``LEAF`` characters is encoded by tree concatenation, see
``ByteBpe.tree`` and ``join_ids``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

REMEMBER = 500_000
LEAF, PIECE, WINDOW = 4096, 512, 8

@lru_cache(maxsize=1)
def unknown() -> re.Pattern:
    """The characters that the libraries may class apart (letter, number, space, other): those that Python's version of
    Unicode, the oldest here, does not assign."""
    free = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).reshape(-1, 2)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist()) + "]")


def _letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def highest_bytes(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The highest byte of each row: tells how exotic its characters can be."""
    n = len(edges) - 1
    out = np.zeros(n, np.uint8)
    full = np.flatnonzero(np.diff(edges) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(raw[:edges[-1]], edges[full])
    return out


class _Bpe:
    END = b""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model, alphabet = spec["model"], _letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def raw(token: str) -> bytes:
            ended = bool(suffix) and token.endswith(suffix)
            return bytes(alphabet[c] for c in (token[: -len(suffix)] if ended else token)) + (self.END if ended else b"")

        self.bytes_of: dict[int, bytes] = {}
        rank_of: dict[bytes, int] = {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = {a + b: i for i, (a, b) in enumerate(merges)}
        singles = sorted((t for t in model["vocab"] if t not in order and t not in self.specials), key=lambda t: len(raw(t)))
        ids = []
        for token in [*singles, *sorted(order, key=order.get)]:
            rank_of[raw(token)] = len(ids)
            ids.append(model["vocab"][token])
        for b in range(256):
            if bytes([b]) not in rank_of:
                rank_of[bytes([b])] = len(ids)
                ids.append(0)
        self.packs = [i.to_bytes(4, "little") for i in ids]
        self.tokens = [b""] * len(ids)
        for token, rank in rank_of.items():
            self.tokens[rank] = token
        self.core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=rank_of, special_tokens={})._core_bpe
        self.table = [b""] * (max([*ids, *self.specials.values()]) + 1)
        for rank, token in enumerate(self.tokens):
            if self.table[ids[rank]] == b"":
                self.table[ids[rank]] = token.removesuffix(self.END) if self.END else token
        for content, at in self.specials.items():
            self.table[at] = content.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.known: dict[str, bytes] = {}
        self.unknown = unknown()

    def ranks(self, piece: bytes) -> list[int]:
        """Merge ranks of one piece; a long one is encoded in halves that are joined."""
        if len(piece) <= PIECE:
            return self.core.encode_single_piece(piece)
        half = len(piece) // 2
        return self.join(_Bpe.ranks(self, piece[:half]), _Bpe.ranks(self, piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one piece from theirs.

        A window of tokens on either side of the join is encoded anew and doubled until its first
        token is the left side's and its last token the right side's. Byte-pair encodings are
        exact if every two neighbouring tokens are, so the three parts together then are the
        encoding of the whole.
        """
        near = WINDOW
        while True:
            a, b = min(near, len(left)), min(near, len(right))
            fresh = self.core.encode_single_piece(b"".join(self.tokens[t] for t in [*left[len(left) - a:], *right[:b]]))
            if (a == len(left) or (len(fresh) > 1 and fresh[0] == left[-a])) and (b == len(right) or (len(fresh) > 1 and fresh[-1] == right[b - 1])):
                return [*left[:len(left) - a], *fresh, *right[b:]]
            near *= 2

    def packed(self, ranks: list[int]) -> bytes:
        packs = self.packs
        return b"".join([packs[r] for r in ranks])

    def remember(self, key: str, value: bytes) -> bytes:
        if len(self.known) >= REMEMBER:
            self.known.clear()
        self.known[key] = value
        return value

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str, high: int = 255) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. high: the highest byte of the text, if known."""
        if high > 0xCC and self.unknown.search(text):
            return self.by_library(text)
        if "<|" in text:
            return b"".join(
                np.uint32(self.specials[part]).astype("<u4").tobytes() if part in self.specials else self.stretch(part, high)
                for part in self.cut.split(text) if part
            )
        return self.stretch(text, high)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, special tokens included."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


class ByteBpe(_Bpe):
    """Byte-level pieces: contractions, words, numbers and marks with the space before, and spaces."""

    #: Fixed value: the pre-tokenizer's pattern.
    SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    _CROWDED = re.compile(r"\s ")

    def leaf(self, text: str) -> bytes:
        """text: a space and what follows it."""
        if text[1:].isalpha():
            return self.packed(self.ranks(text.encode()))
        return b"".join([self.packed(self.ranks(p.encode())) for p in self.SPLIT.findall(text)])

    def stretch(self, text: str, high: int) -> bytes:
        """A space between two other characters always starts a piece, so text is cut there."""
        if not text:
            return b""
        known = self.known
        if self._CROWDED.search(text) or "\x1c" <= min(text) <= "\x1f":
            return self.tree(text)
        first, *rest = text.split(" ")
        head = self.tree(first) if first else b""
        out = []
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = self.tree(" " + chunk) if len(chunk) > LEAF else self.remember(chunk, self.leaf(" " + chunk))
            out.append(ids)
        return head + b"".join(out)

    def tree(self, text: str) -> bytes:
        """Encode unsplit text by halves, each to pieces with their ids, and join them."""
        return b"".join(self.packed(ranks) for _, ranks in self.pieces(text))

    def pieces(self, text: str) -> list[tuple[str, list[int]]]:
        if len(text) <= LEAF:
            return [(p, self.ranks(p.encode())) for p in self.SPLIT.findall(text)]
        half = len(text) // 2
        return self.concatenate(self.pieces(text[:half]), self.pieces(text[half:]))

    def concatenate(self, left: list[tuple[str, list[int]]], right: list[tuple[str, list[int]]]) -> list[tuple[str, list[int]]]:
        """Join two halves. Only the left's last piece can differ from what it is in the whole;
        a window from its start grows into the right until one of its pieces starts where one of
        the right's does. From there on both sides agree, as a piece depends only on what follows
        its start."""
        if not left or not right:
            return left or right
        last, many = left[-1], 1
        while True:
            taken = right[:many]
            window = last[0] + "".join(p for p, _ in taken)
            fresh = self.SPLIT.findall(window)
            if many >= len(right) or (len(fresh) > 1 and len(fresh[-1]) == len(taken[-1][0]) and many > 1):
                break
            many *= 2
        out = left[:-1]
        if len(fresh) == 1 and len(taken) == 1:
            return [*out, (window, self.join(last[1], taken[0][1]))]
        agreed = many < len(right)
        for piece in fresh[: len(fresh) - agreed]:
            out.append((piece, self.ranks(piece.encode())))
        return [*out, *right[many - agreed:]]


class WordBpe(_Bpe):
    """Lower-cased words, single digits and marks, each with a word end; white space is dropped."""

    END = b"\xff"
    #: Fixed value: the pre-tokenizer's pattern.
    SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
    _ODD = re.compile("[\x1c-\x1f]")

    def ranks(self, piece: bytes) -> list[int]:
        return _Bpe.ranks(self, piece + self.END)

    def leaf(self, text: str, high: int) -> bytes:
        if high > 0xCB:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return self.packed(self.ranks(text.encode()))
        return b"".join([self.packed(self.ranks(p.encode())) for p in self.SPLIT.findall(text)])

    def stretch(self, text: str, high: int) -> bytes:
        if self._ODD.search(text):
            return self.leaf(text, 255)
        known, out = self.known, []
        for chunk in text.split():
            ids = known.get(chunk)
            if ids is None:
                ids = self.leaf(chunk, 255) if len(chunk) > LEAF else self.remember(chunk, self.leaf(chunk, high))
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
