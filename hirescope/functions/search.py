"""Many keywords sought in texts at once: tables of the keywords by length, looked up at every place of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 16  # bytes of texts that are looked at together
GRAM = 16  # bytes of a keyword that two numbers hold
_DENSE = 512  # a text with a hit for so many keywords of the table marks them in a row of flags
_TURN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from every place of ``data`` on as a number; behind its end are zeros."""
    return np.ndarray(len(data) + 8, "<u8", data + bytes(16), strides=(1,))


class _Table:
    """Keywords of ``size`` bytes, at most ``GRAM``: all of them are compared, so what is found is there."""

    def __init__(self, size: int, words: list[bytes], ids: np.ndarray):
        self.size, self.two = size, size > 8
        raw = _eights(b"".join(words))
        first, second = raw[::size][: len(words)] & _MASK[min(size, 8)], raw[8::size][: len(words)] & _MASK[max(size - 8, 0)]
        bits = max(4, int(len(words) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.first, self.second, self.ids = first, second if self.two else None, ids.astype(np.int32)
        left = np.arange(len(words))
        at = self._home(first, second)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want one slot the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first ^ (second * _MIX) if self.two else first
        return ((key * _TURN) >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that hold a keyword, in order, and which."""
        first = first & _MASK[min(self.size, 8)]
        second = second & _MASK[self.size - 8] if self.two else second
        at = self._home(first, second)
        out = self.slots[at]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self._differ(out, first, second, open_)]
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[self._differ(out, first, second, open_)]
        place = np.flatnonzero(out >= 0)
        return place, self.ids[out[place]]

    def _differ(self, out: np.ndarray, first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
        got = out[place]
        differ = self.first[got] != first[place]
        return differ | (self.second[got] != second[place]) if self.two else differ


class Keywords:
    """Different keywords (bytes, none empty), numbered as given; those over ``GRAM`` bytes are found by their first ones."""

    def __init__(self, words: list[bytes]):
        self.count = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        self.tables = []
        for size in np.unique(sizes[sizes <= GRAM]).tolist():
            ids = np.flatnonzero(sizes == size)
            self.tables.append(_Table(size, [words[i] for i in ids.tolist()], ids))
        self.long: list[dict[int, dict[bytes, int]]] = []  # by first bytes, then by length
        begins: dict[bytes, int] = {}
        for i in np.flatnonzero(sizes > GRAM).tolist():
            at = begins.setdefault(words[i][:GRAM], len(begins))
            if at == len(self.long):
                self.long.append({})
            self.long[at].setdefault(len(words[i]), {})[words[i]] = i
        self.begins = _Table(GRAM, list(begins), np.arange(len(begins))) if begins else None
        eight = sorted({w[:8] for w in words if len(w) > 8})
        self.eight = _Table(8, eight, np.arange(len(eight)))  # few places have the first bytes of a keyword of more

    def _at(self, data: bytes, eights: np.ndarray, start: int, end: int, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Keywords at the places from ``start`` to ``end``; per table all hits in order of place, and where those of each text, from
        ``left`` to ``right``, begin and end."""
        first, second = eights[start:end].copy(), eights[start + 8 : end + 8].copy()
        some, _ = self.eight.find(first, second)
        more = first[some], second[some]
        out = []
        for table in self.tables:
            place, ids = table.find(*more) if table.two else table.find(first, second)
            place = some[place] if table.two else place
            out.append((ids, np.searchsorted(place, left - start), np.searchsorted(place, right - table.size + 1 - start)))
        if self.begins is not None:
            found: list[tuple[int, int]] = []
            place, begin = self.begins.find(*more)
            place = some[place]
            owner = np.searchsorted(left, place + start, "right") - 1
            for p, b, text in zip((place + start).tolist(), begin.tolist(), owner.tolist()):
                for size, same in self.long[b].items():
                    i = same.get(data[p : p + size]) if text >= 0 and p + size <= right[text] else None
                    if i is not None:
                        found.append((p, i))
            at = np.array([p for p, _ in found], np.int64)
            out.append((np.array([i for _, i in found], np.int32), np.searchsorted(at, left), np.searchsorted(at, right)))
        return out

    def search(self, ends: np.ndarray, data: bytes) -> Iterator[np.ndarray]:
        """The keywords in each text, once each; the texts lie in ``data`` one after the other, the first from ``ends[0]`` on."""
        eights, flags = _eights(data), np.zeros(self.count, np.bool_)
        parts: list[np.ndarray] = []
        held, marked, text = 0, False, 0
        for start in range(int(ends[0]), max(int(ends[-1]), int(ends[0]) + 1), PIECE):
            end = min(start + PIECE, int(ends[-1]))
            last = int(np.searchsorted(ends[1:], end, "right"))  # the first text that goes on beyond ``end``
            here = np.arange(text, min(last + 1, len(ends) - 1))
            hits = self._at(data, eights, start, end, ends[here], ends[here + 1])
            cuts = [(ids, begin.tolist(), stop.tolist()) for ids, begin, stop in hits]
            for i, t in enumerate(here.tolist()):
                for ids, begin, stop in cuts:
                    if begin[i] < stop[i]:
                        parts.append(ids[begin[i] : stop[i]])
                        held += stop[i] - begin[i]
                if held * _DENSE > self.count:
                    for x in parts:
                        flags[x] = True
                    parts, held, marked = [], 0, True
                if t == last:
                    break  # it goes on
                for x in parts if marked else ():
                    flags[x] = True
                found = np.flatnonzero(flags) if marked else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                if marked:
                    flags[found] = False
                parts, held, marked = [], 0, False
                yield found
            text = last
