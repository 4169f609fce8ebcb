"""Ids of a public word-end BPE vocabulary for whole text columns.

The tokenizer drops white space and never joins characters across it, so a
text's ids are those of its stretches between white space, each taken through
the tokenizer's own normalizer and model. Stretches repeat, so a process keeps
the ids of those it has met, within about ``MOST_BYTES``, until it turns to
other work.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from visiontables.llm.textbytes import ragged

MOST_BYTES = 128 << 20
_ENTRY = 200  # bytes a dictionary takes for an entry besides its text
# Fixed value: how the vocabulary's file splits normalized text.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")


class Encoder:
    """Encodes texts with the tokenizer file at ``path``, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.piece: dict[str, bytes] = {}
        self.stretch: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.held = 0

    def _pieces(self, stretches: list[str]) -> list[list[str]]:
        plain = [s.lower() if s.isascii() else None for s in stretches]
        wide = [s for s in stretches if not s.isascii()]
        if wide:
            done = self.tokenizer.normalizer.normalize_str(" ".join(wide)).split(" ")
            assert len(done) == len(wide)
            done = iter(done)
            plain = [next(done) if s is None else s for s in plain]
        return [[s] if s.isalpha() else [s[:-1], s[-1]] if s[-1:] in ".,;!?" and s[:-1].isalpha() else _PIECE.findall(s) for s in plain]

    def _learn(self, stretches: list[str]) -> None:
        model, known, ids, size = self.tokenizer.model, self.piece, [], []
        for s, pieces in zip(stretches, self._pieces(stretches)):
            self.stretch[s] = len(self.stretch)
            self.held += _ENTRY + len(s)
            total = 0
            for p in pieces:
                got = known.get(p)
                if got is None:
                    got = known[p] = array("I", [t.id for t in model.tokenize(_bytes_shown(p))]).tobytes()
                    self.held += _ENTRY + len(p)
                ids.append(got)
                total += len(got)
            size.append(total // 4)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.size = np.concatenate([self.size, np.array(size, dtype=np.int64)])

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one more at the end); ``end`` follows every text."""
        if self.held > MOST_BYTES:
            self.forget()
        odd = [i for i, t in enumerate(texts) if t and any(x in t for x in _ODD)]
        split = [t.split() if t else [] for t in texts]
        for i in odd:
            split[i] = []
        new = set().union(*split).difference(self.stretch)
        if new:
            self._learn(list(new))
        s_to = np.cumsum(self.size)
        s_at = s_to - self.size
        stretch_ids, n_extra = self.ids, len(self.size)
        # the end id and odd texts are stretches of their own
        extra = [] if end is None else [np.array([end], np.uint32)]
        words = np.fromiter(map(self.stretch.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        for i in odd:
            extra.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32))
        base = len(stretch_ids)
        for x in extra:
            s_at, s_to = np.append(s_at, base), np.append(s_to, base + len(x))
            base += len(x)
        stretch_ids = np.concatenate([stretch_ids, *extra])
        first = np.concatenate([[0], np.cumsum(n_words)])
        order = words
        if extra:
            rows = np.concatenate([odd, np.arange(len(texts) if end is not None else 0)]).astype(np.int64)
            what = np.concatenate([np.arange(len(odd)) + n_extra + (end is not None), np.full(len(rows) - len(odd), n_extra)])
            where = np.concatenate([first[:-1][rows[: len(odd)]], first[1:][rows[len(odd) :]]])
            sort = np.argsort(rows, kind="stable")
            order = np.insert(words, where[sort], what[sort])
            n_words[odd] += 1
            n_words += end is not None
        first = np.concatenate([[0], np.cumsum(n_words)])
        n = (s_to - s_at)[order]
        out = stretch_ids[ragged(s_at[order], n)]
        return out, np.concatenate([[0], np.cumsum(n)])[first]


def _shown() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TABLE = str.maketrans({b: c for b, c in _shown().items() if chr(b) != c})


def _bytes_shown(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_TABLE)


_ENCODER: Encoder | None = None


def encoder(path: str) -> Encoder:
    """This process's encoder for ``path``."""
    global _ENCODER
    if _ENCODER is None or _ENCODER.path != path:
        _ENCODER = Encoder(path)
    return _ENCODER


def drop() -> bool:
    """Let go of this process's encoder, if it has one."""
    global _ENCODER
    had, _ENCODER = _ENCODER is not None, None
    return had


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
