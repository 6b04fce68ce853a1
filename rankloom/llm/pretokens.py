"""Cutting a text into units that byte-level BPE can encode one by one.

A cut before a space that follows other text, and on both sides of a line feed between other
text, never goes through a match of the split pattern.  So such units can be encoded (and
remembered) alone; so can a letter's side and the other of a mark that follows it.  Texts where white
space meets white space are cut by the pattern itself.  `cut` cuts many texts at once, as bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex

from rankloom.llm.common import runs

_MARK = "\x01"
# White space besides space and line feed.
_OTHER = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0  -     　]")
_ASCII_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_DOUBLE = ("  ", " \n", "\n ", "\n\n")

_LETTERS, _MARKS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTERS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARKS[list(b".,;:!?")] = True
# Units whose ids are put together at once.
GATHERED = 1 << 18


def units(text: str, pattern: regex.Pattern) -> list[str]:
    """Pieces that join to the text; each begins and ends at a border of the pattern's matches."""
    if not _plain(text):
        return pattern.findall(text)
    marked = text.replace(" ", _MARK + " ")
    if "\n" in marked:
        marked = marked.replace("\n", _MARK + "\n" + _MARK)
    return [u for u in marked.split(_MARK) if u] if marked else []


def _plain(text: str) -> bool:
    """Whether single spaces and line feeds are the only white space."""
    if _MARK in text or any(d in text for d in _DOUBLE):
        return False
    # single characters are searched for much faster than classes of them
    return not (any(c in text for c in _ASCII_OTHER) if text.isascii() else _OTHER.search(text))


def cut(texts: list[str], pattern: regex.Pattern) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of the texts, the place among them of each unit in text order, and the units per text."""
    plain = [_plain(t) for t in texts]
    raw = [t.encode("utf-8") if p else b"" for t, p in zip(texts, plain)]
    borders = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    cuts = np.zeros(len(data) + 1, dtype=bool)
    feeds = data == 10
    cuts[:-1] = (data == 32) | feeds
    cuts[1:] |= feeds
    cuts[1:-1] |= _LETTERS[data[:-1]] & _MARKS[data[1:]]
    cuts[borders] = True
    offsets = np.flatnonzero(cuts).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    firsts = np.searchsorted(offsets, borders)
    counts = np.diff(firsts)
    if not all(plain):
        others = [pattern.findall(t) for t, p in zip(texts, plain) if not p]
        sizes = np.array([len(o) for o in others])
        slow = np.flatnonzero(~np.array(plain))
        firsts[slow] = len(found) + np.cumsum(sizes) - sizes
        counts[slow] = sizes
        found = pa.concat_arrays([found, pa.array([u for o in others for u in o], pa.large_string())])
    coded = found.dictionary_encode()
    places = coded.indices.to_numpy()
    # by way of numpy: to_pylist makes a scalar of every value first
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), places if all(plain) else places[runs(firsts[:-1], counts)], counts


def gathered(ids: list[bytes], places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in text order and the end of each text among them, from the ids (32-bit integers) of the distinct units."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.concatenate([[0], np.cumsum(sizes[places])])[np.cumsum(counts)]
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
    at = 0
    for first in range(0, len(places), GATHERED):
        some = places[first:first + GATHERED]
        got = flat[runs(starts[some], sizes[some])]
        out[at:at + len(got)] = got
        at += len(got)
    return out, ends
