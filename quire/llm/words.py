"""Hashes of the words of many texts at once, by prefix sums over their bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that are looked at together; a longer text is cut before white space.
CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_LOWER = np.arange(256, dtype=np.uint8)
_SAME = _LOWER.copy()
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """Words of some texts: hash, number of the text in the batch, number of the line counted over the chunk, the
    number of the first line of each text that the chunk holds, where each word stands in the chunk's bytes, where each
    text begins there, and whether the last one goes on."""

    hashes: np.ndarray
    text: np.ndarray
    line: np.ndarray
    first_text: int
    texts: int
    first_line: np.ndarray
    lines: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray
    unfinished: bool


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), _U)
    step = 1 << 16  # sums over parts of 64 KiB keep the tables of powers small
    up, down = _powers(step + 1)
    if not len(starts):
        return out
    for at in range(0, len(data), step):
        part = data[at : at + step]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((letters[part].astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        s, e = np.clip(starts[a:b] - at, 0, len(part)), np.clip(ends[a:b] - at, 0, len(part))
        inside = np.maximum(at - starts[a:b], 0)  # a word may begin in an earlier part
        value = (sums[e] - sums[s]) * down[s]
        if len(inside) and inside[0]:
            value[:1] *= _U(pow(_BASE, int(inside[0]), 1 << 64))
        out[a:b] += value
    return mix(out + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def scan(column: pa.Array, cut_at: bytes = b" \t\n\r\x0b\x0c", chunk: int = CHUNK, blank_only: bool = False) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, or with ``blank_only`` words ``[^\\x20]+`` as they are, some
    texts at a time and in order; null counts as empty.

    A text that doesn't fit into a chunk is continued in the next one, cut where ``cut_at`` allows; its words then
    come in several parts with the same text number."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    breaks = np.zeros(256, bool)
    breaks[list(cut_at)] = True
    text, at = 0, int(offsets[0]) if n else 0
    while text < n:
        last = int(np.searchsorted(offsets, at + chunk, "right")) - 1
        if last > text or offsets[text + 1] - at <= chunk:
            last = max(last, text + 1)
            stop = int(offsets[last])
        else:  # part of a long text
            stop = at + chunk
            found = np.flatnonzero(breaks[whole[at + 1 : stop]])
            if len(found):
                stop = at + 1 + int(found[-1])
            else:
                found = np.flatnonzero(breaks[whole[stop : int(offsets[text + 1])]])
                stop = stop + int(found[0]) if len(found) else int(offsets[text + 1])
            last = text + 1
        data = whole[at:stop]
        begins = np.maximum(offsets[text:last] - at, 0)
        letter = data != 32 if blank_only else ~_SPACE[data]
        new = letter.copy()
        new[1:] &= ~letter[:-1]
        heads = begins[begins < len(data)]
        new[heads] = letter[heads]
        starts = np.flatnonzero(new)
        over = letter.copy()
        over[:-1] &= ~letter[1:] | new[1:]
        ends = np.flatnonzero(over) + 1
        feeds = np.zeros(len(data) + 1, np.int64)
        feeds[1:] = data == 10
        feeds[heads[heads > 0]] += 1
        line = np.cumsum(feeds)
        # texts without any byte still have one (empty) line of their own
        owner = np.searchsorted(begins, starts, "right") - 1
        extra = np.cumsum(np.concatenate(([0], (np.diff(np.append(begins, len(data))) == 0)[:-1]))) if len(begins) else begins
        first = line[np.minimum(begins, len(data))] + extra
        yield Words(_hash(data, starts, ends, _SAME if blank_only else _LOWER), text + owner, line[starts] + extra[owner], text, last - text, first, int(line[-1]) + 1 + int(extra[-1]) if len(begins) else 0, data, starts, ends, begins, bool(stop < offsets[last]))
        at = stop
        text = last if stop >= offsets[last] else text
