"""Hashed character and word n-grams of the texts of a piece, as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP = "\n\n"                   # stands behind each text, so n-grams of three characters never reach the next


@dataclass
class Chars:
    """Code points of all texts, each followed by GAP, and where each text begins and ends."""
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def chars_of(texts: pa.Array) -> Chars:
    """Characters with A-Z lower-cased; a null text has none."""
    t = pc.fill_null(texts, "")
    codes = np.frombuffer((GAP.join(t.to_pylist()) + GAP).encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    n = pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n + len(GAP))[:-1]]) if len(n) else np.zeros(0, np.int64)
    return Chars(codes, starts, starts + n)


def hashed(parts: list[np.ndarray], kind: int, bits: int) -> np.ndarray:
    """Buckets (0 to 2**bits - 1) of tuples given as parallel uint32 arrays; `kind` keeps sorts of features apart."""
    acc = np.full(len(parts[0]), kind + 1, np.uint32)
    for p in parts:
        acc = (acc ^ p) * np.uint32(0x85EBCA6B)
        acc ^= acc >> np.uint32(13)
    acc *= np.uint32(0xC2B2AE35)
    return (acc >> np.uint32(32 - bits)).astype(np.int32)


def char_grams(c: Chars, k: int, bits: int) -> np.ndarray:
    """Bucket of the k characters from each position on (up to three); the last positions belong to no text."""
    n = len(c.codes) - 2
    return hashed([c.codes[j:j + n] for j in range(k)], k, bits)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range; zero for empty ranges."""
    tail = np.zeros((1, *values.shape[1:]), values.dtype)
    padded = np.concatenate([values, tail])
    at = np.stack([starts, ends], 1).reshape(-1)
    out = np.add.reduceat(padded, np.minimum(at, len(values)), axis=0)[::2] if len(starts) else values[:0]
    out[starts == ends] = 0
    return out
