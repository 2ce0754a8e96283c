"""Whole-text encoding with a public byte-level BPE vocabulary, the slow part memoised.

The vocabulary's pre-tokenizer never lets a token reach over a space or newline that stands between two characters that
aren't white space. A text whose only white space is such single spaces and newlines is therefore the concatenation of
its units (a word with the space before it, or a newline), and each distinct unit is encoded by the library once while it is
remembered. Any other text, and any text that holds an added token's string, is given to the library whole. Both ways
give the same ids and offsets; tests hold them against each other.
"""

from __future__ import annotations

import os
import sys
from array import array
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np

#: Units that are remembered in each of two generations; the older one is forgotten when the younger is full. About 200
#: bytes a unit.
CACHE_UNITS = 700_000

#: White space other than the plain space and newline, and strings that break up units.
_OTHER_SPACE = [chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_STOPS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"
_BREAKS = ["\x00", "  ", " \n", "\n ", "\n\n", *_OTHER_SPACE]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """`offsets`: remember (start, end) of each token in characters, instead of ids."""

    def __init__(self, path: str, offsets: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # array's item sizes and byte order are the machine's; the format's are little-endian.
        assert sys.byteorder == "little" and array("H").itemsize == 2 and array("I").itemsize == array("i").itemsize == 4

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # units are remembered here; the library's own cache only costs time then
        self.offsets = offsets
        self.kind = np.dtype("<i4") if offsets else np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.breaks = [*_BREAKS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        pre = self.tokenizer.pre_tokenizer
        self.by_units = self.tokenizer.normalizer is None and self.tokenizer.post_processor is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        self.letters = _byte_letters()
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # A line is split like a text of its own, so several units may be encoded as one text.
        self.newline = line[0] if self.by_units and len(line) == 1 and not any("\n" in b for b in self.breaks[len(_BREAKS) :]) else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        if self.offsets:
            return [array("i", chain.from_iterable(e.offsets)).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, text: str) -> list[str] | None:
        if not text:
            return []
        if not self.by_units or text[0] in " \n" or text[-1] in " \n" or any(b in text for b in self.breaks):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _apart(self, units: list[str]) -> list[bytes]:
        """Packed tokens of units, encoded as one text of lines where that can be cut again at the newlines' tokens."""
        if self.newline is None or len(units) < 2:
            return self._packed(units)
        text = ["\n".join([*units, ""])]
        made = (self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast)(text, add_special_tokens=False)[0]
        ids = np.array(made.ids, np.int64)
        at = np.flatnonzero(ids == self.newline)
        assert len(at) == len(units)
        if self.offsets:
            size = np.fromiter(map(len, units), np.int64, len(units)) + 1
            spans = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
            raw = (spans - np.repeat(np.cumsum(size) - size, np.diff(at, prepend=-1))[:, None]).astype(self.kind).tobytes()
        else:
            raw = ids.astype(self.kind).tobytes()
        width = self.kind.itemsize * (2 if self.offsets else 1)
        ends = (at * width).tolist()
        return [raw[a:b] for a, b in zip([0, *[e + width for e in ends]], ends)]

    def _learn_words(self, units: set[str]) -> list[str]:
        """Remember the ids of units of letters, and of letters with stops behind them; returns the other units.

        A space and letters are one piece for the pre-tokenizer, so the library's model is asked for them directly."""
        young, old, code, tokenize, letters, others = self.young, self.old, "H" if self.kind.itemsize == 2 else "I", self.tokenizer.model.tokenize, self.letters, []
        for u in units:
            known = old.get(u)
            if known is None:
                word = u.rstrip(_STOPS)
                if not word.lstrip(" ").isalpha():
                    others.append(u)
                    continue
                known = young.get(word) or old.get(word)
                if known is None:
                    known = young[word] = array(code, [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]).tobytes()
                if len(word) < len(u):
                    stops = u[len(word) :]
                    if stops not in young:
                        young[stops] = self._packed([stops])[0]
                    known += young[stops]
            young[u] = known
        return others

    def _learn(self, units: set[str]) -> None:
        """Remember units, none of which is among the young."""
        young, old, missing, joined = self.young, self.old, [], []
        if self.newline is not None and not self.offsets:
            units = self._learn_words(units)
        for u in units:
            known = old.get(u)
            if known is not None:
                young[u] = known
                continue
            word = u.rstrip(_STOPS)
            if word != u and word.lstrip(" ").isalpha():
                # Letters and the stops behind them are always tokens of their own.
                joined.append((u, word, u[len(word) :]))
            else:
                missing.append(u)
        missing += {p for _, *parts in joined for p in parts if p not in young and p not in old}.difference(missing)
        if "\n" in units and "\n" not in young:
            missing.remove("\n")
            young["\n"] = self._packed(["\n"])[0]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            young.update(zip(part, self._apart(part)))
        for u, *parts in joined:
            a, b = (young.get(p) or old[p] for p in parts)
            young[u] = a + (np.frombuffer(b, self.kind) + np.array(len(parts[0]), self.kind)).tobytes() if self.offsets else a + b

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids; with `offsets`, an array (tokens, 2)."""
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        parts = [self._units(t) for t in texts]
        found, young, out = [p and list(map(self.young.get, p)) for p in parts], self.young, []
        self._learn({u for p, f in zip(parts, found) if p for u in compress(p, map(not_, f))})
        for text, units, packed in zip(texts, parts, found, strict=True):
            if units is None:
                got = np.frombuffer(self._packed([text])[0], self.kind)
                out.append(got.reshape(-1, 2) if self.offsets else got)
                continue
            # No unit is empty, nor are its tokens: what is false wasn't known before.
            for i in compress(range(len(packed)), map(not_, packed)):
                packed[i] = young[units[i]]
            got = np.frombuffer(b"".join(packed), self.kind)
            if self.offsets:
                got = got.reshape(-1, 2)
                size = np.fromiter(map(len, units), np.int64, len(units))
                count = np.fromiter(map(len, packed), np.int64, len(units)) // (2 * self.kind.itemsize)
                got = got + np.repeat(np.cumsum(size) - size, count)[:, None]
            out.append(got)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, offsets: bool = False) -> Encoder:
    """One for all tasks of a worker, with what it remembers."""
    return Encoder(path, offsets)
