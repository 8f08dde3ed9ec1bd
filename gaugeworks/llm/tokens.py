"""Token ids of whole texts by a public byte-level BPE vocabulary.

The split pattern never joins characters across a blank that stands between two non-blank
characters, so a text is the sequence of its blank-separated parts and each part's ids can be
looked up. Parts repeat; a worker keeps the ids of those it has seen, up to a bound.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Parts kept per worker; the store is emptied when it would pass this.
KEPT_PARTS = 800_000
_PLAIN_BLANK = re.compile(r"(?<=\S) (?=\S)")
_RARE_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BY_PATH: dict[str, "Ids"] = {}


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Ids:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte_of = _byte_of()
        self.special = [t["content"] for t in said["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in word): i for word, i in said["model"]["vocab"].items()
                 if word not in self.special}
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self._sizes[i] = len(word)
        self._whole = Tokenizer.from_file(path)
        self._parts = tiktoken.Encoding(
            "parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._kept: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Encodes new parts as one text and cuts its ids where the parts' bytes end."""
        found = np.array(self._parts.encode_ordinary(" " + " ".join(parts)), "<u4")
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        cuts = np.searchsorted(np.cumsum(self._sizes[found]), ends) + 1
        whole, at, fresh = found.tobytes(), 0, {}
        for part, cut in zip(parts, (4 * cuts).tolist(), strict=True):
            fresh[part] = whole[at:cut]
            at = cut
        self._kept |= fresh
        return fresh

    def _encode(self, text: str) -> bytes:
        return array("I", self._parts.encode_ordinary(text)).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        split: list[list[str] | None] = []
        found: list[list[bytes | None]] = []
        new: set[str] = set()
        for text in texts:
            if any(s in text for s in self.special):
                split.append(None)
                found.append([])
                continue
            odd = ("  " in text or " \n" in text or "\n " in text or text[:1] == " "
                   or text[-1:] == " " or _RARE_BLANK.search(text) is not None)
            parts = _PLAIN_BLANK.split(text) if odd else text.split(" ")
            look = [self._encode(parts[0]), *map(self._kept.get, parts[1:])]
            if None in look:
                new.update(p for p, ids in zip(parts, look, strict=True) if ids is None)
            split.append(parts)
            found.append(look)
        if len(self._kept) + len(new) > KEPT_PARTS:
            self._kept.clear()
        fresh = self._learn(list(new)) if new else {}
        out = []
        for text, parts, look in zip(texts, split, found, strict=True):
            if parts is None:
                ids = self._whole.encode(text, add_special_tokens=False).ids
                out.append(array("I", ids).tobytes())
            elif None in look:
                out.append(b"".join([fresh[p] if ids is None else ids
                                     for p, ids in zip(parts, look, strict=True)]))
            else:
                out.append(b"".join(look))
        return out


def ids(path: str = DEFAULT_VOCABULARY) -> Ids:
    """The vocabulary at ``path``, loaded once per worker."""
    if path not in _BY_PATH:
        _BY_PATH[path] = Ids(path)
    return _BY_PATH[path]
