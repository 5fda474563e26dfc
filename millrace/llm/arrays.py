"""Whole batches of texts as one numpy array of code points, for rolling hashes without a Python loop over characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of ``texts`` in a row, and the offsets of the texts (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` characters (len - width + 1 of them), by doubling."""
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, done, total, length = points.astype(np.uint64) + np.uint64(1), 0, None, 1
    factor = MULTIPLIER
    rest = width
    while rest:
        if rest & 1:
            part = power[done : done + n]
            total = part.copy() if total is None else total * np.uint64(factor) + part
            done += length
        rest >>= 1
        if rest:
            power = power[: len(power) - length] * np.uint64(factor) + power[length:]
            factor = factor * factor % 2**64
            length *= 2
    return mix(total)


def owners(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts at ``offsets``: start positions of all runs that lie within one text, and the text of each."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(first, sizes) + np.repeat(offsets[:-1], sizes), text


@lru_cache(1)
def reading_table() -> np.ndarray:
    """For each code point of the first plane: what it counts as in a comparison of letters, digits and Han characters.

    Width and case are dropped; 0 marks a character to leave out.
    """
    table = np.zeros(0x10000, np.uint32)
    for point in range(0x10000):
        char = chr(point)
        if 0xFF00 <= point <= 0xFFEF:
            char = unicodedata.normalize("NFKC", char)
        char = char.lower()
        if len(char) == 1 and unicodedata.category(char)[0] == "L" or unicodedata.category(char[0]) == "Nd":
            table[point] = ord(char[0])
    return table


def reading(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters that count, and the offsets of the texts among them."""
    kept = reading_table()[np.minimum(points, 0xFFFF)]
    kept = np.where(points > 0xFFFF, points, kept)
    mask = kept != 0
    counts = np.concatenate([[0], np.cumsum(mask)])
    return kept[mask], counts[offsets]
