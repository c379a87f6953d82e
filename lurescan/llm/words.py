"""Words and shingles as numpy arrays of 64-bit names.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters, after A-Z are lower-cased:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. On UTF-8 bytes that is a run of bytes that are 0-9, a-z or at least 128.
"""

from __future__ import annotations

import numpy as np

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: byte -> lower-case byte, or a blank where it belongs to no word
TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_LETTERS = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype="uint64") * _U(2) + _U(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(TABLE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _U(_BASE))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype="uint64")


def word_names(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit name, document index, begin byte, end byte) of every word of concatenated texts.

    The name is a polynomial in the word's bytes modulo 2^64, mixed; equal words have equal names
    wherever they stand, and different words differ but for a chance of about 2^-50 a pair.
    """
    lower = np.frombuffer(TABLE, "uint8")[data]
    inside = lower != 32
    # a document's first byte begins a word even when the byte before, in another document, is inside one
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(begin):
        none = np.zeros(0, "int64")
        return np.zeros(0, "uint64"), none, none, none
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(begin, starts)))
    # Horner by place: words are short, so a few vectorised steps over the places cover nearly all of them. Longest
    # words come first there, so that those that reach a place are the first ones
    length = end - begin
    lack = (64 - np.minimum(length, 64)).astype("uint8")
    order = np.argsort(lack, kind="stable")
    reach = np.cumsum(np.bincount(lack, minlength=64))[63::-1]
    at, value = begin[order], np.zeros(len(begin), "uint64")
    for place, n in enumerate(reach.tolist()):
        if not n:
            break
        value[:n] = value[:n] * _U(_BASE) + _LETTERS[lower[at[:n] + place]]
    name = np.empty_like(value)
    name[order] = value
    for i in np.flatnonzero(length > 64).tolist():  # words of over 64 bytes
        long = lower[begin[i] + 64 : end[i]]
        value = int(name[i])
        powers = _powers(len(long) + 1)
        tail = (_LETTERS[long] * powers[: len(long)][::-1]).sum(dtype="uint64")
        name[i] = _U((value * int(powers[len(long)]) + int(tail)) % 2**64)
    return mix(name), doc, begin, end


def gram_names(name: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name, index of the first word) of every run of ``n`` words inside one document."""
    if len(name) < n:
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    first = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    out = name[first]
    for i in range(1, n):
        out = mix(out * _U(_BASE) + name[first + i])
    return out, first
