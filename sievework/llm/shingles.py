"""Words and word shingles of a text, and their XXH64 hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """A whole text's words, A-Z lower-cased, as UTF-8."""
    return [w.encode() for w in WORD.findall((text or "").translate(LOWER))]


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """The hash of each shingle, repeats included; fewer words are one shingle, none have none."""
    if not found:
        return np.zeros(0, np.uint64)
    width, line, digest = min(words, len(found)), b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts))


def digest_of(found: list[bytes]) -> bytes:
    """128 bits that stand for a sequence of words."""
    return xxhash.xxh128_digest(b" ".join(found), SEED)
