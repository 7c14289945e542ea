"""Token ids of a public byte-level BPE vocabulary, with a cache of space-delimited chunks."""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Two white-space characters of which one is a space: only there may a token span a single space's left edge.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_JOINED_SPACE = re.compile(r"\s[ ]|[ ]\s")
_CACHED = 300_000


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _doubled(text: str) -> bool:
    return ("  " in text or "\n " in text or " \n" in text
            or bool(_OTHER_SPACE.search(text) and _JOINED_SPACE.search(text)))


class Ids:
    """Texts to ids, as little-endian unsigned 32-bit numbers.

    A single space between other characters always starts a new token, so a text without
    doubled white space is the join of its chunks, whose ids are looked up; chunks not seen
    before are encoded together. Texts with doubled white space are encoded whole. A text
    that spells a special token goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        byte_of = _byte_of()
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items()
                 if token not in self.special}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def _learn(self, chunks: set[str]) -> None:
        if len(self.known) > _CACHED:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        plain = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        if plain:
            ids = self.whole(" " + " ".join(plain))
            at = np.flatnonzero(self.opens[ids]).tolist()       # each chunk's first token holds its space
            raw = ids.tobytes()
            self.known.update(zip(plain, [raw[4 * i:4 * j] for i, j in zip(at, [*at[1:], len(ids)])], strict=True))
        for c in new:
            if c not in self.known:
                self.known[c] = self.whole(" " + c).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if _doubled(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        known = self.known
        self._learn({c for chunks in cut if chunks for c in chunks[1:] if c not in known} if len(known) <= _CACHED
                    else {c for chunks in cut if chunks for c in chunks[1:]})
        out = []
        for text, chunks in zip(texts, cut):
            if chunks:
                out.append(self.whole(chunks[0]).tobytes() + b"".join(map(known.__getitem__, chunks[1:])))
            elif any(s in text for s in self.special):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(self.whole(text).tobytes())
        return out


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The vocabulary at ``path``, loaded once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
