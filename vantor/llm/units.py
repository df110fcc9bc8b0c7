"""Texts as sequences of units, and what is kept for each distinct unit.

A unit is a stretch of text between places that a pre-token of the byte-level pattern never crosses, and a unit alone
has the same pre-tokens as in its text, so whatever is worked out for a unit holds at each of its places. Units start
at a space before a character that isn't white space, at a mark after a letter, at a line feed or the like after a
character that isn't white space, and at the start of a text. Cuts are found by bytes: where these leave it open what
a neighbour is, there is none, and the unit is longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Longer units are worked out each time; the memory then has entries of bounded size.
LONGEST_UNIT = 64


def _of(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


MARK, LINE, SHOWN = _of(*b".,;:!?"), _of(*range(9, 14)), _of(*range(0x21, 0x7F))
LETTER = _of(*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1))
#: By two bytes: whether the character they begin surely isn't white space.
SOLID = np.repeat(~_of(*range(9, 14), *range(0x1C, 0x21))[:, None], 256, axis=1)
for _lead, _next in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
    SOLID[_lead, list(_next)] = False


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start in the bytes of texts that stand at offsets[i] to offsets[i + 1]."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    at = np.flatnonzero(data == 32)
    first[at[SOLID[data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]]]] = True
    first[offsets[1:] - 1] = False  # what follows is another text
    at = np.flatnonzero(MARK[data[1:]]) + 1
    left = data[at - 1]
    first[at[LETTER[left] | (data[np.maximum(at - 2, 0)] == 0xC3) & (left != 0x97) & (left != 0xB7)]] = True  # U+00C0 to U+00FF but two signs
    first[1:n][LINE[data[1:]] & SHOWN[data[:-1]]] = True
    first[offsets[:-1]] = True
    return np.flatnonzero(first[:n])


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units, which of them stand in the texts one after the other, and the place in that of each text's first one and the end."""
    whole = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(texts) + 1)
    size = int(offsets[-1])
    if not size:
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    starts = unit_starts(np.frombuffer(whole.buffers()[2], np.uint8, size), offsets)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size)), whole.buffers()[2]).dictionary_encode()
    return units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy(), np.searchsorted(starts, offsets)


def joinable(units: list[str]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The places of units that may stand one behind the other (two kinds), of those that may with a line feed before each, and of others."""
    spaced, lines, words, rest = [], [], [], []
    for i, u in enumerate(units):
        if u[:1] == " " and u[1:2].strip():
            spaced.append(i)
        elif (found := u.split()) == [u]:
            words.append(i)
        elif u[:1] == "\n" and found == [u[1:]]:
            lines.append(i)
        else:
            rest.append(i)
    return spaced, lines, words, rest


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 and so on, sizes[0] numbers, then those from starts[1]."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class UnitMemory:
    """Remembers the ids of each distinct unit, for at most `most` units and a batch's; misses are worked out many at a time."""

    def __init__(self, work_out: Callable[[list[str]], list[bytes]], most: int = 300_000) -> None:
        self.work_out, self.most = work_out, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)  # those of a slot end at ends[slot + 1]

    def _learn(self, units: list[str]) -> None:
        """Puts units behind those of the memory."""
        known, values = len(self.slots), self.work_out(units)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = int(self.ends[known])
        stop, last = start + int(sizes.sum()), known + len(units)
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids[:start], np.zeros(max(stop, 2 * start) - start, "<u4")])
        if last >= len(self.ends):
            self.ends = np.concatenate([self.ends[: known + 1], np.zeros(max(last, 2 * known) - known, np.int64)])
        self.ids[start:stop] = np.frombuffer(b"".join(values), "<u4")
        self.ends[known + 1 : last + 1] = start + np.cumsum(sizes)

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of each text's units, joined in order."""
        if len(self.slots) > self.most:
            self.clear()
        units, codes, firsts = cut(texts)
        slots = list(map(self.slots.get, units))
        new = [i for i, s in enumerate(slots) if s is None]
        if new:
            new.sort(key=lambda i: len(units[i]) > LONGEST_UNIT)  # long ones last, to be forgotten
            self._learn([units[i] for i in new])
            for s, i in enumerate(new, len(self.slots)):
                slots[i] = s
            self.slots |= {units[i]: slots[i] for i in new if len(units[i]) <= LONGEST_UNIT}
        which = np.array(slots, np.int64)[codes]
        starts = self.ends[which]
        sizes = self.ends[which + 1] - starts
        data = self.ids[stretches(starts, sizes)].tobytes()
        bounds = 4 * np.append(0, np.cumsum(sizes))[firsts]
        if len(self.ids) > 1 << 20 and len(self.ids) > 4 * (used := int(self.ends[len(self.slots)])):
            self.ids = self.ids[:used].copy()
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shared_prefix(a, b) -> int:
    """Length of the longest common prefix of two strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low
