"""Whole-text encoding with the public tokenizers; their files are parameters and stay where they are."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from itertools import chain, repeat

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers with their ids; beyond, it forgets all and learns anew.
REMEMBERED = 1_000_000
#: Unknown pieces encoded as one text.
TOGETHER = 1000
#: Characters whose classes (letter, number, blank, other) are the same here and in the tokenizers' splitting patterns; texts with
#: others are encoded whole.
_PLAIN = [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x2028)), *map(chr, range(0x2030, 0x205F)), chr(0x20AC)]
_BLANKS = " \t\n\r\x0b\x0c\x85\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


_L, _N, _S = _class("L"), _class("N"), re.escape(_BLANKS)
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ODD = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]")


class PieceEncoder:
    """Ids of a public tokenizer, piece by piece with a memory.

    A tokenizer first splits a text into pieces and then merges inside each, so a piece has the same ids wherever it
    stands. Texts with special tokens or with characters of unsure class are encoded whole.
    """

    pattern: re.Pattern

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _codes(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, pieces: list[str]) -> None:
        coded = [c for k in range(0, len(pieces), TOGETHER) for c in self._codes(pieces[k:k + TOGETHER])]
        sizes, ids = np.array([len(c) for c in coded], np.int64), np.array([i for c in coded for i in c], np.uint32)
        n, used = len(self.known), int(self.begin[len(self.known)])
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        while len(self.begin) <= len(self.known):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.begin[n + 1:n + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.ids[used:used + len(ids)] = ids

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        parts: list[list[str]] = []
        whole: dict[int, np.ndarray] = {}
        for k, raw in enumerate(texts):
            text = raw.decode()
            if "<|" in text or not (text.isascii() or _ODD.search(text) is None):
                whole[k] = np.array(self._whole(text), np.uint32)
                parts.append([])
            else:
                parts.append(self.split(text))
        pieces = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (at < 0).any():
            new = np.flatnonzero(at < 0).tolist()
            missing = list(dict.fromkeys([pieces[i] for i in new]))
            if len(self.known) + len(missing) > self.remembered and self.known:
                self._forget()
                missing, new = list(dict.fromkeys(pieces)), range(len(pieces))
            self._learn(missing)
            at[new] = [self.known[pieces[i]] for i in new]
        first = self.begin[at]
        sizes = self.begin[at + 1] - first
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())]
        cuts = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts])] if texts else np.zeros(0, np.int64)
        out = np.split(flat, cuts[:-1]) if texts else []
        return [whole.get(k, ids) for k, ids in enumerate(out)]


class WordEncoder(PieceEncoder):
    """For the vocabulary in lower case that drops white space: pieces are split from the text in lower case."""

    pattern = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower())

    def _codes(self, pieces: list[str]) -> list[list[int]]:
        ends = np.cumsum([len(p) + 1 for p in pieces])
        coded = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids = coded.ids
        cuts = np.searchsorted([a for a, _ in coded.offsets], ends).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


class ByteLevelEncoder(PieceEncoder):
    """For byte-level vocabularies: pieces keep one blank before them, and laid end to end give the text."""

    pattern = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__(path, remembered)
        self.line_end = self._whole("\n")[0]

    def _codes(self, pieces: list[str]) -> list[list[int]]:
        # A line end between two pieces is a piece of its own, and its id stands for nothing else.
        plain = [p for p in pieces if p.strip(_BLANKS)]
        ids = np.array(self._whole("\n".join(plain)), np.int64)
        cuts = [-1, *np.flatnonzero(ids == self.line_end).tolist(), len(ids)]
        rows = ids.tolist()
        coded = iter([rows[a + 1:b] for a, b in zip(cuts[:-1], cuts[1:])])
        return [next(coded) if p.strip(_BLANKS) else self._whole(p) for p in pieces]


class ByteEncoder:
    """Ids of a byte-level vocabulary, with the number of bytes of every id: tokens laid end to end give the text."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.n_bytes = np.zeros(max(table.values()) + 2, np.int64)
        for token, rank in table.items():
            self.n_bytes[rank] = len(token)

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text.decode()), np.int64)
