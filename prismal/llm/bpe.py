"""Byte-level BPE over whole texts, with the pieces between blanks and newlines remembered.

A text is cut into pieces across which the pre-tokenizer never makes a token: words
with the single blank or newline before them, and what longer runs of these have
besides their last one.  Common pieces are looked up instead of encoded again.
Texts with other white space are given to the library whole.
"""

from __future__ import annotations

import ctypes
import gc
import functools
import heapq
import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Pieces remembered in a worker (some 150 MB at most), and the longest that is remembered.
CACHE_PIECES = 700_000
CACHE_CHARS = 24

#: Texts with other white space than blanks and newlines are not cut.
_EXOTIC = [c for c in map(chr, range(0x3001)) if (c.isspace() and c not in " \n") or c in "\x00\x01"]
_RUN = re.compile(r"([ \n]{2,}|^[ \n]|[ \n]$)")

#: Keys of pieces: ``word`` is a word with its blank, ``\nword`` one with its newline;
#: these go before a word with nothing before it and before a run of white space.
_BARE, _SPACE = "\x00", "\x01"

#: A word of letters that any Unicode version has as letters, and the marks behind it:
#: each is one pre-token.
_WORD = re.compile(r"([\x00\n]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")

#: The letters of such words as byte-level files write their bytes (other than ASCII ones are 0x80 or more).
_BYTE_CHARS = {b: chr(256 + 33 + k) for k, b in enumerate(range(0x7F, 0xA1))} | {0xAD: "\u0143"}
_LETTERS = {c: "".join([_BYTE_CHARS.get(b, chr(b)) for b in c.encode()]) for c in map(chr, range(0x100)) if _WORD.fullmatch(c)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str] | None:
    """Keys of the pieces of ``text``; null if it must be taken whole."""
    for c in _EXOTIC:
        if c in text:
            return None
    if not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text):
        flat = text.replace("\n", " \n").split(" ")
        flat[0] = _BARE + flat[0]
        return flat
    parts, out = _RUN.split(text), []
    if parts[0]:
        out = parts[0].replace("\n", " \n").split(" ")
        out[0] = _BARE + out[0]
    for run, words in zip(parts[1::2], parts[2::2], strict=True):
        if not words:  # the end of the text
            out.append(_SPACE + run)
            continue
        if len(run) > 1:
            out.append(_SPACE + run[:-1])
        if run[-1] == "\n":
            words = "\n" + words
        flat = words.replace("\n", " \n").split(" ")
        out += flat[1:] if words[0] == "\n" else flat
    return out


def written(key: str) -> str:
    """The text that a key stands for."""
    return key[1:] if key[0] in (_BARE, _SPACE) else key if key[0] == "\n" else " " + key


class _Pieces(dict):
    """Ids of pieces by key; one that is not there is learnt, and remembered while there is room."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        self.learn, self.most = learn, most

    def __missing__(self, key: str) -> bytes:
        ids = self.learn(key)
        if len(key) <= CACHE_CHARS and len(self) < self.most:  # full: what came first is what is frequent
            self[key] = ids
        return ids


class PieceEncoder:
    """Texts to ids as the library gives them without added begin or end tokens."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.special = {a["content"]: int(a["id"]) for a in added}
        #: Cutting is right for a plain byte-level model only.
        self.plain = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
            and not any(" " in a["content"] for a in added)
        )
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        if self.plain:
            self.model = self.tok.model
            self.newline = self._whole("\n")
            self.marks: dict[str, bytes] = {}
        self._special_hint = [s for s in self.special]
        self.pieces = _Pieces(self._learn, most)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _token(self, mapped: str) -> bytes:
        """Ids that the library's model gives one pre-token."""
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, key: str) -> bytes:
        """Ids of a key; a word of plain letters goes to the model as it is, marks behind it are added."""
        if key.isascii() and key.isalpha():
            return self._token("\u0120" + key)
        m = _WORD.fullmatch(key)
        if m is None:
            return self._whole(written(key))
        word, marks = m.groups()
        if not marks:
            ids = self._token(_mapped(word))
            return self.newline + ids if word[0] == "\n" else ids
        tail = self.marks.get(marks)
        if tail is None:
            tail = self._whole(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = tail
        return self.pieces[word] + tail

    def _segment(self, text: str) -> bytes:
        if not text:
            return b""
        keys = cut(text)
        if keys is None:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, keys))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``; null is empty."""
        if not text:
            return b""
        if not self.plain:
            return self._whole(text)
        if not any(s in text for s in self._special_hint):
            return self._segment(text)
        out = []
        for part in self._cut.split(text):
            out.append(np.asarray([self.special[part]], dtype="<u4").tobytes() if part in self.special else self._segment(part))
        return b"".join(out)


def _mapped(word: str) -> str:
    """A word's key as the model's characters."""
    bare = word[0] in (_BARE, "\n")
    text = "".join(map(_LETTERS.__getitem__, word[1:] if bare else word))
    return text if bare else "\u0120" + text


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Merges that BPE makes on ``symbols``: a heap of adjacent pairs over a linked list.

    The lowest rank goes first and, of equal ranks, the leftmost; entries that a
    merge has made stale are passed over when they are popped.
    """
    n = len(symbols)
    if n < 2:
        return 0
    text, after, before = symbols, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get((text[i], text[i + 1]))
        if r is not None:
            heap.append((r, i, text[i], text[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or text[i] != a or text[j] != b:
            continue
        text[i], text[j] = a + b, ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks.get((text[i], text[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, text[i], text[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get((text[h], text[i]))
            if r is not None:
                heapq.heappush(heap, (r, h, text[h], text[i]))
    return merges


class PieceCounter:
    """Token counts by heap-and-linked-list merging; no ids are made."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added, model = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or [], spec["model"]
        if pre.get("type") != "ByteLevel" or spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = [a["content"] for a in added]
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _count(self, text: str) -> int:
        total = 0
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            c = self.words.get(word)
            if c is None:
                c = len(word) - merge_count(list(word), self.ranks)
                if len(word) <= CACHE_CHARS and len(self.words) < CACHE_PIECES:
                    self.words[word] = c
            total += c
        return total

    def _segment(self, text: str) -> int:
        if not text:
            return 0
        keys = cut(text)
        if keys is None:
            return self._count(text)
        found = list(map(self.pieces.get, keys))
        if None in found:
            gaps = [i for i, n in enumerate(found) if n is None]
            new = {k: self._count(written(k)) for k in {keys[i] for i in gaps}}
            for i in gaps:
                found[i] = new[keys[i]]
            if len(self.pieces) < CACHE_PIECES:
                self.pieces.update({k: n for k, n in new.items() if len(k) <= CACHE_CHARS})
        return sum(found)

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; null is empty. A special string counts one."""
        if not text:
            return 0
        if not any(s in text for s in self.special):
            return self._segment(text)
        return sum(1 if i % 2 else self._segment(p) for i, p in enumerate(self._cut.split(text)))


@functools.cache
def encoder(path: str, most: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder for a worker process; it remembers ``most`` pieces."""
    return PieceEncoder(path, most)


@functools.cache
def counter(path: str) -> PieceCounter:
    """One counter for a worker process."""
    return PieceCounter(path)


def forget() -> None:
    """Give back the memory of remembered pieces; operators that need it themselves call this in their tasks."""
    encoder.cache_clear()
    counter.cache_clear()
    trim()


def trim() -> None:
    """Give what was freed back to the system, where the C library can: idle workers share an executor's memory."""
    gc.collect()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)
