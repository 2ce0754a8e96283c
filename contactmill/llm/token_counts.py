"""Token counts by offset-mapped attribution.

A document is encoded once, whole, and its tokens' character spans are joined to its sections, which are sorted, disjoint
character intervals. A token within one section counts there. A token that crosses boundaries goes to the section that
holds most of its characters, the earlier one in a tie (rule "most"), or to the section of its first character (rule
"first") or of its last one (rule "last"). A token that touches no section counts as outside. So a document's counts add
up to its tokens, whatever its sections, which does not hold if sections are encoded one by one. Tokens that share one
character (its bytes) each count. `count_tokens` gives each section with its place and its count, `by_section` as a row of its
own; `report` sums them up.

Null and empty texts have no tokens and no sections. Null ids, repeated rows and empty input are allowed. Other columns
pass through; an input column with the name of an added one is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .encoding import encoder

#: What `count_tokens` adds, and the numbers that `report` gives of it.
FOUND = ("section_counts", "n_tokens", "n_sections", "n_outside", "n_crossing")
ADDED = ("n_tokens", "n_sections", "max_section_tokens", "n_outside", "n_crossing", "counts_crc32")

_SENTENCE = re.compile(r"[.!?]+[^\S\n]*\n*")


def sentences(text: str) -> np.ndarray:
    """Sections that cover a text: each ends after its stop and the white space behind it. Array (sections, 2)."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array([[a, b] for a, b in zip([0, *ends], ends)], np.int64).reshape(-1, 2)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each section, and masks of the tokens outside all sections and of those that cross a boundary."""
    n = len(sections)
    if not len(spans) or not n:
        return np.zeros(n, np.int64), np.ones(len(spans), bool), np.zeros(len(spans), bool)
    starts, ends = sections[:, 0], sections[:, 1]
    first = np.searchsorted(ends, spans[:, 0], "right")  # the first section that ends behind the token's start
    last = np.searchsorted(starts, np.maximum(spans[:, 1], spans[:, 0] + 1), "left") - 1  # the last that begins before its end
    outside = last < first
    within = ~outside & (first == last) & (starts[np.minimum(first, n - 1)] <= spans[:, 0]) & (ends[np.minimum(first, n - 1)] >= spans[:, 1])
    owner = np.where(outside, -1, first if rule != "last" else last)
    if rule == "most":
        two = np.flatnonzero(~outside & (last == first + 1))
        a, b = first[two], last[two]
        owner[two] = np.where(ends[a] - np.maximum(starts[a], spans[two, 0]) >= np.minimum(ends[b], spans[two, 1]) - starts[b], a, b)
        for j in np.flatnonzero(~outside & (last > first + 1)):
            share = np.minimum(ends[first[j] : last[j] + 1], spans[j, 1]) - np.maximum(starts[first[j] : last[j] + 1], spans[j, 0])
            owner[j] = first[j] + int(share.argmax())
    return np.bincount(owner[owner >= 0], minlength=n), outside, ~outside & ~within


def count_tokens(docs: DataFrame, path: str, sections=sentences, rule: str = "most") -> DataFrame:
    """Every row of `docs` with its sections in order and each one's number of tokens (section_counts: start and end in characters, n_tokens), its numbers of tokens and sections, and of tokens outside and across."""
    keep = [c for c in docs.columns if c not in (*FOUND, *ADDED)]

    def start():
        held = encoder(path, offsets=True)

        def step(texts):
            texts = [(t or b"").decode() for t in texts]
            places, tokens, numbers = [], [], []
            for text, spans in zip(texts, held.encode(texts), strict=True):
                counts, outside, crossing = attribute(spans, found := sections(text), rule)
                places.append(found)
                tokens.append(counts)
                numbers.append((len(spans), len(found), int(outside.sum()), int(crossing.sum())))
            both = np.concatenate([np.zeros((0, 2), np.int64), *places])
            parts = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens]))], names=["start", "end", "n_tokens"])
            at = np.concatenate(([0], np.cumsum([len(c) for c in tokens]))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(at), parts), *[list(c) for c in zip(*numbers)]]

        return step

    return map_texts(docs, keep, "section_counts array<struct<start: long, end: long, n_tokens: long>>, n_tokens long, n_sections long, n_outside long, n_crossing long", start)


def by_section(counted: DataFrame) -> DataFrame:
    """Rows of `count_tokens` as one row a section: its number within the row's text from 0 on (section), start, end and n_tokens."""
    keep = [c for c in counted.columns if c not in (*FOUND, "section", "start", "end")]
    return counted.select(*keep, F.posexplode("section_counts").alias("section", "_s")).select(*keep, "section", "_s.start", "_s.end", "_s.n_tokens")


def report(counted: DataFrame) -> DataFrame:
    """Rows of `count_tokens` with their sections as a string (start:end:tokens, comma-joined), the tokens of the largest section, and the crc32 of the sections' counts (little-endian, 32 bits each)."""
    keep = [c for c in counted.columns if c not in (*FOUND, *ADDED)]
    turned = lambda x: (x % 256) * (1 << 24) + F.shiftright(x, 8) % 256 * (1 << 16) + F.shiftright(x, 16) % 256 * 256 + F.shiftright(x, 24)
    digits = F.transform("section_counts.n_tokens", lambda x: F.lpad(F.hex(turned(x)), 8, "0"))
    shown = F.transform("section_counts", lambda s: F.concat_ws(":", s["start"], s["end"], s["n_tokens"]))
    made = {
        "max_section_tokens": F.coalesce(F.array_max("section_counts.n_tokens"), F.lit(0)).cast("long"),
        "counts_crc32": F.crc32(F.unhex(F.array_join(digits, ""))),
    }
    return counted.select(*keep, *[made[c].alias(c) if c in made else c for c in ADDED], F.array_join(shown, ",").alias("section_counts"))
