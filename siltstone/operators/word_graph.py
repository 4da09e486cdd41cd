"""The graph of a dictionary's words over a text, searched for its cheapest path with arrays in place of a loop over characters.

The dictionary is a trie in one hash table; all positions of a window of text walk down it side by
side.  No path passes between two characters without stopping there unless a word spans them, so a
text falls into segments at the places that no word spans, and segments step on side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands after each text; no character has this code.
END = 0x110000
#: Characters that are searched at a time (more if no place in them is free).
WINDOW = 1 << 18
#: Bits of the class of a character: the commonest of the dictionary have one of their own, all others share class 0.
CLASS = 6
#: Segments step on side by side as long as so many are left, and for at most so many characters.
FEW, STEPS = 8, (1 << 11) - 1
_HASH = np.uint64(0x9E3779B97F4A7C15)


class WordGraph:
    """Words (at most 31 characters) and their costs as a trie: a slot of the table is a node, its key the parent's slot and a character.

    Like ``segmentation.best_path``, which defines the result: of equally cheap paths that with the longer
    last word, characters that the dictionary lacks alone at the cost ``unknown``.
    """

    def __init__(self, costs: dict[str, int], unknown: int):
        assert max(map(len, costs), default=0) < 32 and max([unknown, *costs.values()]) < 1 << 25
        self.unknown, self.longest = unknown, max(map(len, costs), default=1)
        words = [w for w in costs if w]
        sizes = np.array([len(w) for w in words], np.int64)
        nodes = len({w[:k] for w in words for k in range(1, len(w) + 1)})
        codes = np.frombuffer("".join(w.ljust(self.longest, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), self.longest)
        cost = np.array([costs[w] for w in words], np.int32)
        self.bits = max(8, (4 * nodes).bit_length())
        self.keys, self.costs = np.full((1 << self.bits) + 1, -1, np.int64), np.full((1 << self.bits) + 1, -1, np.int32)
        slots = np.full(len(words), -1, np.int64)
        for k in range(self.longest):
            there = np.flatnonzero(sizes > k)
            keys = (slots[there] + 1) << 21 | codes[there, k].astype(np.int64)
            self._add(np.unique(keys))
            slots[there] = self._find(keys)
            last = there[sizes[there] == k + 1]
            self.costs[slots[last]] = cost[last]
        # nodes of one character by its code; of three characters, and costs of words of up to three, by their classes
        self.first = self._find(np.arange(END + 1, dtype=np.int64)).astype(np.int32)
        letters, counts = np.unique(codes[codes > 0], return_counts=True)
        common = letters[np.argsort(-counts, kind="stable")[: (1 << CLASS) - 1]]
        self.classes = np.zeros(END + 1, np.int32)
        self.classes[common] = np.arange(1, len(common) + 1)
        self.third = np.full(1 << 3 * CLASS, -1, np.int32)
        self.short = [np.full(1 << k * CLASS, -1, np.int32) for k in (1, 2, 3)]
        for k in range(min(3, self.longest)):
            there = np.flatnonzero(sizes > k)
            of = self.classes[codes[there, : k + 1]]
            there, of = there[(of > 0).all(1)], of[(of > 0).all(1)]
            of = (of << np.arange(k, -1, -1) * CLASS).sum(1)
            keys = self.first[codes[there, 0]].astype(np.int64)
            for j in range(1, k + 1):
                keys = self._find((keys + 1) << 21 | codes[there, j].astype(np.int64))
            self.short[k][of] = self.costs[keys]
            if k == 2:
                self.third[of] = keys

    def _at(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * _HASH
        return (((mixed ^ mixed >> np.uint64(29)) * _HASH) >> np.uint64(64 - self.bits)).view(np.int64)

    def _add(self, keys: np.ndarray) -> None:
        at, mask = self._at(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            left = self.keys[at] != keys
            keys, at = keys[left], (at[left] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if there is none."""
        at = self._at(keys)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        left = np.flatnonzero((got != keys) & (got != -1))
        at, mask = at[left], (1 << self.bits) - 1
        while len(left):
            at = (at + 1) & mask
            got = self.keys[at]
            same = got == keys[left]
            out[left[same]] = at[same]
            more = ~same & (got != -1)
            left, at = left[more], at[more]
        return out

    def _words(self, codes: np.ndarray, n: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(size, starts, costs) of words that start among the first ``n`` codes, which of these no word stands for alone, and how far words reach from each.

        ``codes`` holds ``longest`` codes more, three at least.
        """
        strange, reach, found = np.ones(n, bool), np.arange(1, n + 1), []

        def words(size: int, starts: np.ndarray, cost: np.ndarray) -> None:
            if size == 1:
                strange[starts] = False
            reach[starts] = starts + size
            found.append((size, starts, cost))

        # by classes, as far as the first three characters have one
        of = self.classes[codes[: n + 2]]
        pair = of[:-1] << CLASS | of[1:]
        three = pair[:-1] << CLASS | of[2:]
        known = of > 0
        known = known[:-2] & known[1:-1] & known[2:]
        for size, index in enumerate((of[:n], pair[:n], three), 1):
            cost = self.short[size - 1][index]
            starts = np.flatnonzero((cost >= 0) & known)
            words(size, starts, cost[starts])
        slots = self.third[three]
        at = np.flatnonzero((slots >= 0) & known)
        slots = slots[at].astype(np.int64)
        # the others through the table
        odd = np.flatnonzero(~known)
        odd_slots = self.first[codes[odd]].astype(np.int64)
        for size in range(1, self.longest + 1):
            if size == 4:
                odd, odd_slots = np.concatenate([at, odd]), np.concatenate([slots, odd_slots])
            if size > 1:
                odd_slots = self._find((odd_slots + 1) << 21 | codes[odd + (size - 1)])
            there = np.flatnonzero(odd_slots >= 0)
            odd, odd_slots = odd[there], odd_slots[there]
            cost = self.costs[odd_slots]
            word = np.flatnonzero(cost >= 0)
            words(size, odd[word], cost[word])
        return found, strange, reach

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """Whether a word ends after each code (texts, each with ``END`` after it); ``END`` stands alone."""
        out, odd, begin, window = np.zeros(len(codes), bool), np.zeros(len(codes), bool), 0, WINDOW
        padded = np.append(codes, np.full(max(3, self.longest), END, codes.dtype))
        while begin < len(codes):
            n = min(window, len(codes) - begin)
            found, strange, reach = self._words(padded[begin : begin + n + max(3, self.longest)].astype(np.int64), n)
            free = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, n + 1)) + 1  # places that no word spans
            if not len(free):
                window *= 2
                continue
            whole, n = n, int(free[-1])
            out[begin : begin + n], odd[begin : begin + n] = self._cheapest(found, whole, strange[:n], free)
            begin, window = begin + n, WINDOW
        odd &= codes != END
        return out & ~(odd & np.append(odd[1:], False))  # unknown characters side by side are one word

    def _cheapest(self, found: list, found_to: int, strange: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word ends after each code of the segments that end at ``free``, and whether it is an unknown character."""
        n = len(strange)
        sizes = np.diff(free, prepend=0)
        most = min(STEPS, int(np.sort(sizes)[-FEW])) if len(sizes) >= FEW and n < 1 << 21 else 0
        at = np.arange(n)
        steps = at - np.repeat(free - sizes, sizes)
        if sizes.max() > most:
            steps[np.repeat(sizes > most, sizes)] = 1 << 11
        if n < found_to:
            found = [(size, starts[inside], cost[inside]) for size, starts, cost in found for inside in [starts < n]]
        alone = np.flatnonzero(strange)
        # an edge is a number: whether its segment is long, its step in it, its end, 31 less its size, its cost
        base = (steps << 51 if n < 1 << 21 else 0) | at << 30
        keys = np.concatenate([base[starts] + ((size << 51 if n < 1 << 21 else 0) + (size << 30) + ((31 - size) << 25)) + cost for size, starts, cost in [*found, (1, alone, np.full(len(alone), self.unknown, np.int32))]])
        keys.sort()
        back = np.zeros(n + 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[0] = cut[free] = True
        to = np.searchsorted(keys, 1 << 62) if n < 1 << 21 else 0
        self._side_by_side(keys[:to], back, cut)
        if to < len(keys):
            self._one_by_one(np.sort(keys[to:] & ((1 << 51) - 1)) if n < 1 << 21 else keys, back, cut)
        ends, at = np.zeros(n + 1, bool), free
        while len(at):
            ends[at] = True
            at = at - back[at]
            at = at[~cut[at]]
        return ends[1:], ends[1:] & strange & (back[1:] == 1)

    @staticmethod
    def _side_by_side(keys: np.ndarray, back: np.ndarray, cut: np.ndarray) -> None:
        """The size of the last word of the cheapest path to each end.  Costs carry 31 less that size in five low bits, so of equal ones the longer word is least."""
        if not len(keys):
            return
        steps, end = keys >> 51, keys >> 30 & ((1 << 21) - 1)
        less = keys >> 25 & 31
        start, more = end - 31 + less, (keys & ((1 << 25) - 1)) << 5 | less
        groups = np.append(0, np.flatnonzero(end[1:] != end[:-1]) + 1)
        to = end[groups]
        on = np.where(cut[to], 0, ~31)  # the next segment begins at no cost
        bounds = np.searchsorted(steps, np.arange(1, steps[-1] + 2))
        group_bounds = np.searchsorted(groups, bounds)
        best, sizes = np.zeros(len(back), np.int64), np.empty(len(groups), np.int64)
        for a, b, i, j in zip(bounds[:-1], bounds[1:], group_bounds[:-1], group_bounds[1:]):
            least = np.minimum.reduceat(best[start[a:b]] + more[a:b], groups[i:j] - a)
            best[to[i:j]] = least & on[i:j]
            sizes[i:j] = 31 - (least & 31)
        back[to] = sizes

    @staticmethod
    def _one_by_one(keys: np.ndarray, back: np.ndarray, cut: np.ndarray) -> None:
        """The same for segments of so many characters that few others are as long."""
        best, at, least = {}, -1, 0
        for end, more in zip((keys >> 30).tolist(), ((keys & ((1 << 25) - 1)) << 5 | keys >> 25 & 31).tolist()):
            if end != at:
                if at >= 0:
                    best[at], back[at] = 0 if cut[at] else least & ~31, 31 - (least & 31)
                at, least = end, 1 << 62
            begin = end - 31 + (more & 31)
            total = best.get(begin, 0) + more  # a segment begins at no cost
            if total < least:
                least = total
        back[at] = 31 - (least & 31)

    def counts(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row's words, the pieces into which they fall when they are joined and cut again, and how many come back whole."""
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = words.flatten().cast(pa.large_string())
        to = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, each.offset * 8) if len(each) else np.zeros(1, np.int64)
        data = each.buffers()[2].slice(int(to[0]), int(to[-1] - to[0])) if len(each) else b""
        to = to - to[0]
        text = np.frombuffer(data, np.uint8)
        if len(text) and text.max() > 127:
            to = np.append(0, np.cumsum(text & 0xC0 != 0x80))[to]
            text = np.frombuffer(bytes(data).decode().encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.cumsum(sizes)  # words up to each row's end
        rows = np.repeat(np.arange(len(sizes)), sizes)
        codes = np.full(len(text) + len(sizes), END, np.uint32)
        closes = to[last] + np.arange(len(sizes))  # where each row's END stands
        inside = np.ones(len(codes), bool)
        inside[closes] = False
        codes[inside] = text
        begins, ends = to[:-1] + rows, to[1:] + rows
        stops = np.flatnonzero(self.ends(codes)) + 1
        found = np.searchsorted(stops, ends)
        whole = (ends > begins) & (stops[found] == ends) & (np.append(0, stops)[found] == begins)
        empty = ends == begins  # of empty words side by side one counts
        again = empty & np.append(False, empty[:-1]) & (rows == np.append(-1, rows[:-1]))
        n_stops = np.diff(np.searchsorted(stops, closes, side="right"), prepend=0) - np.append(0, np.ones(max(len(sizes) - 1, 0), np.int64))[: len(sizes)]
        count = lambda of: np.bincount(rows[of], minlength=len(sizes)).astype(np.int64)
        return count(~again), n_stops, count(whole)
