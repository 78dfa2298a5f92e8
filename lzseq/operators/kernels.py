"""Parsing kernels on one bounded text: suffix array, LZ77 and relative LZ parses, decoding, exact search. Plain numpy."""

from __future__ import annotations

import numpy as np

#: (pos, len): len > 0 copies from pos, len = 0 is the literal byte pos.
Phrases = tuple[np.ndarray, np.ndarray]


#: Texts from which on they are parsed side by side.
SIDE_BY_SIDE = 64


def looked_up(keys: np.ndarray, asked: np.ndarray, side: str = "left") -> np.ndarray:
    """np.searchsorted() in the order of what is asked, so that it is found in memory that was just read."""
    by = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[by] = np.searchsorted(keys, asked[by], side)
    return out


class Packed:
    """As many symbols from each place on as a number holds, so that numbers compare as those parts do. 0 is the end, the last code a symbol that the alphabet doesn't have."""

    def __init__(self, alphabet: np.ndarray, spare: int = 0):
        """spare: bits above the symbols that are kept free."""
        self.code = np.full(256, len(alphabet) + 1, np.int64)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.bits = (len(alphabet) + 1).bit_length()
        self.width = (62 - spare) // self.bits
        self.keys: np.ndarray | None = None

    @classmethod
    def of(cls, symbols: np.ndarray) -> Packed:
        out = cls(np.flatnonzero(np.bincount(symbols, minlength=256)))
        out.keys = out.keys_of(symbols)
        return out

    def keys_of(self, symbols: np.ndarray) -> np.ndarray:
        return self.keys_of_codes(self.code[symbols])

    def keys_of_codes(self, codes: np.ndarray) -> np.ndarray:
        n, out, size = len(codes), codes, 1
        for bit in f"{self.width:b}"[1:]:  # numbers of so many symbols become ones of twice as many, and of one more where the width has it
            for other, more in ((out, size), (codes, 1))[: 1 + int(bit)]:
                out = out << (self.bits * more)
                out[: max(0, n - size)] |= other[size:]
                size += more
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols of two keys are the same from the first on."""
        x = a ^ b
        top = np.frexp((x & ~(x >> 1)).astype(np.float64))[1].astype(np.int64)  # without the second bit no number is rounded up
        return self.width - -(-top // self.bits)

    def common(self, other: np.ndarray) -> np.ndarray:
        """What each place has in common with an earlier one, up to width; 0 where that is -1."""
        n = self.equal(self.keys[other], self.keys)
        return np.where(other >= 0, n, 0)

    def ranges(self, keys: np.ndarray, asked: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where in sorted keys are those that begin with so many symbols of the asked ones."""
        rest = (np.int64(1) << (self.bits * (self.width - size))) - 1
        return looked_up(keys, asked & ~rest), looked_up(keys, asked | rest, "right")


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes in lexicographic order (a prefix comes before what it begins)."""
    if not text:
        return np.empty(0, np.int64)
    packed = Packed.of(np.frombuffer(text, np.uint8))
    return ordered(packed.keys, packed.width)


def ordered(keys: np.ndarray, width: int) -> np.ndarray:
    """Suffixes in order: sorted by packed keys of so many symbols, then by doubling those that aren't alone yet."""
    n = len(keys)
    order = np.argsort(keys)
    at, rank, key = np.arange(n), np.empty(n, np.int64), keys[order]
    while True:  # at: places in order that are to be settled, key: what their suffixes were sorted by
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.append(new[1:], True))]
        if not len(at):
            return order
        some = order[at]
        second = np.zeros(len(at), np.int64)
        inside = some + width < n
        second[inside] = rank[some[inside] + width] + 1
        key = rank[some] * (n + 1) + second
        by = np.argsort(key)
        order[at], key = some[by], key[by]
        width *= 2


def lcp_array(text: bytes, sa: np.ndarray) -> np.ndarray:
    """Common prefix lengths of suffixes next to each other in the suffix array; the first is 0."""
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    out, h = [0] * n, 0
    order, place = sa.tolist(), rank.tolist()
    for i in range(n):
        r = place[i]
        if r:
            j = order[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return np.array(out, np.int64)


def smaller_neighbours(sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text position the nearest smaller positions before and after it in suffix order, -1 where there is none.

    All positions at once: one whose candidate is larger goes on to that one's own candidate, behind which all are larger still.
    """
    n = len(sa)
    out = []
    for values in (sa, sa[::-1]):
        values = np.concatenate([[-1], values])
        at = np.arange(-1, n)
        at[0] = 0
        own = values[1:]
        live = np.flatnonzero(values[:-1] > own) + 1
        mine = values[live]
        while len(live):
            on = at[at[live]]
            at[live] = on
            more = values[on] > mine
            live, mine = live[more], mine[more]
        found = np.empty(n, np.int64)
        found[own] = values[at[1:]]
        out.append(found)
    return out[0], out[1]


def common_prefix(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    most = min(len(a) - i, len(b) - j)
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            if step == 1 and a[i + n] != b[j + n]:
                break
    return n


def interval(text: bytes, sa: np.ndarray, key: bytes, at: int, first: int = 0, end: int | None = None) -> tuple[int, int]:
    """The range of the suffix array, from first to before end, whose suffixes begin with key; at is a place in it. Grows from there by doubling, then halves."""
    n, ends = len(key), []
    for step, last in ((-1, first - 1), (1, len(sa) if end is None else end)):
        inside, jump = at, 1
        while (i := inside + step * jump) * step < last * step and text[sa[i] : sa[i] + n] == key:
            inside, jump = i, 2 * jump
        while jump > 1:
            jump //= 2
            if (i := inside + step * jump) * step < last * step and text[sa[i] : sa[i] + n] == key:
                inside = i
        ends.append(inside)
    return ends[0], ends[1] + 1


def leftmost_sources(text: bytes, sa: np.ndarray, keys: np.ndarray, packed: Packed, parts: list[bytes], asked: np.ndarray, rank: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first place in the text of each part, whose packed keys are asked and one of whose suffixes is at rank; sa ends with a number more. within: from where to before where in sa each is looked for."""
    size = np.array([len(x) for x in parts], np.int64)
    low, high = packed.ranges(keys, asked, np.minimum(size, packed.width))
    for k in np.flatnonzero(size > packed.width).tolist():
        low[k], high[k] = interval(text, sa[:-1], parts[k], int(rank[k]), *(int(x[k]) for x in within or ()))
    ends, back = np.unique(low * len(sa) + high, return_inverse=True)
    return np.minimum.reduceat(sa, np.stack(np.divmod(ends, len(sa)), 1).ravel())[::2][back]


def lz77(text: bytes, leftmost: bool = False) -> Phrases:
    """Greedy parse; a phrase is the longest earlier occurrence (it may run into itself), else a literal.

    Of equally long sources it takes the one after in suffix order, or, if leftmost, the first in the text. Lengths don't depend on that.
    """
    return lz77_all([text], leftmost)[0]


def lz77_all(texts: list[bytes], leftmost: bool = False) -> list[Phrases]:
    """lz77() of each text. Their suffixes are sorted together, by text and then in order, so that many short texts cost no more than one of their length."""
    sizes = np.array([len(x) for x in texts], np.int64)
    n = int(sizes.sum()) + len(texts)  # an end after each text
    ends = np.cumsum(sizes + 1) - 1
    begin = ends - sizes
    alphabet = np.flatnonzero(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    if len(texts) > 1 and len(alphabet) == 256:  # no byte is left for an end
        return [lz77(x, leftmost) for x in texts]
    end = bytes([int(np.setdiff1d(np.arange(256), alphabet)[0]) if len(alphabet) < 256 else 0])
    joined = end.join(texts) if len(texts) == 1 else end.join([*texts, b""])
    packed = Packed(alphabet, (len(texts) - 1).bit_length())
    codes = np.zeros(n, np.int64)
    codes[: len(joined)] = packed.code[np.frombuffer(joined, np.uint8)]
    codes[ends] = 0
    packed.keys = packed.keys_of_codes(codes)
    if len(texts) > 1:
        packed.keys |= np.repeat(np.arange(len(texts)) << (packed.bits * packed.width), sizes + 1)
    sa, width = ordered(packed.keys, packed.width), packed.width
    before, after = smaller_neighbours(sa)
    if len(texts) > 1:  # texts before have smaller positions; of texts after none is smaller
        before = np.where(before >= np.repeat(begin, sizes + 1), before, -1)
        after = np.where(after >= np.repeat(begin, sizes + 1), after, -1)
    common_p, common_q = packed.common(before), packed.common(after)
    length = np.maximum(common_p, common_q)
    source = np.where(common_q == length, after, before)
    step = np.where(length == width, 0, np.maximum(length, 1)).tolist()  # 0: to be looked at
    starts, i = [], 0
    while i < n:
        starts.append(i)
        more = step[i]
        if not more:
            p, q, limit = int(before[i]), int(after[i]), int(ends[np.searchsorted(ends, i)]) - i
            n_p, n_q = (int(c[i]) + (common_prefix(joined, x + width, joined, i + width) if c[i] == width else 0) for c, x in ((common_p, p), (common_q, q)))
            n_p, n_q = min(n_p, limit), min(n_q, limit)
            more = length[i] = max(n_p, n_q)
            source[i] = q if n_q == more else p
        i += more
    starts = np.array(starts, np.int64)
    starts = starts[codes[starts] > 0]
    length = length[starts]
    literals = length == 0
    of = np.searchsorted(ends, starts)
    pos = np.where(literals, 0, source[starts] - begin[of])
    pos[literals] = np.frombuffer(joined, np.uint8)[starts[literals]]
    copies = np.flatnonzero(length)
    if leftmost and len(copies):
        rank = np.empty(n, np.int64)
        rank[sa] = np.arange(n)
        at, first = starts[copies], begin[of[copies]]
        parts = [joined[a : a + k] for a, k in zip(at.tolist(), length[copies].tolist())]
        pos[copies] = leftmost_sources(joined, np.append(sa, n), packed.keys[sa], packed, parts, packed.keys[at], rank[at], (first, ends[of[copies]] + 1)) - first
    borders = np.searchsorted(of, np.arange(1, len(texts)))
    return list(zip(np.split(pos, borders), np.split(length, borders)))


def merged(phrases: Phrases, context: int, apart: bool = False) -> dict[str, np.ndarray]:
    """The phrases of one parse as operators.phrases.merge_short() merges them, which says what is merged; apart where copies have another source."""
    pos, length = phrases
    n = np.maximum(length, 1)
    long = n > 2 * context
    first = np.flatnonzero(long | np.append(True, long[:-1])[: len(long)])
    last = np.append(first[1:], len(n))[: len(first)] - 1
    end = np.cumsum(n)[last]
    start = np.append(0, end[:-1])[: len(first)]
    literal = ~long[first]
    if len(first) and not apart:
        literal[0] |= length[0] != 0
    return {"phrase_ix": np.arange(len(first)), "pos": pos[last], "len": end - start, "is_literal": literal, "text_start": start, "text_end": end}


class Reference:
    """A dictionary text with its suffix array, for relative parses."""

    def __init__(self, text: bytes):
        self.packed = Packed.of(np.frombuffer(text, np.uint8))
        self.text, self.padded = text, np.append(ordered(self.packed.keys, self.packed.width), len(text))
        self.sa = self.padded[:-1]
        self.keys = self.packed.keys[self.sa]
        self.packed.keys = None

    def longest(self, x: bytes, i: int) -> tuple[int, int, int]:
        """(a source, length, its rank) of the longest prefix of x[i:] in the text; of equal ones the smallest suffix."""
        text, sa = self.text, self.sa
        low, high, width = 0, len(sa), 64
        key = x[i : i + width]
        while low < high:
            mid = (low + high) // 2
            s = int(sa[mid])
            part = text[s : s + width]
            if part == key and len(key) == width and len(x) - i > width:
                width *= 4
                key = x[i : i + width]
                continue
            if part < key:
                low = mid + 1
            else:
                high = mid
        best, at = 0, -1
        for k in (low - 1, low):
            if 0 <= k < len(sa) and (n := common_prefix(text, int(sa[k]), x, i)) > best:
                best, at = n, k
        if best and at == low - 1:  # the first suffix of those with this prefix
            key, low, high = x[i : i + best], 0, at
            while low < high:
                mid = (low + high) // 2
                s = int(sa[mid])
                if text[s : s + best] < key:
                    low = mid + 1
                else:
                    high = mid
            at = low
        return (int(sa[at]) if best else -1), best, at

    def known(self, keys: np.ndarray) -> np.ndarray:
        """How many characters of packed keys the text has; the packed width stands for that many or more."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64)
        low = looked_up(self.keys, keys)
        above = self.packed.equal(self.keys[np.minimum(low, len(self.keys) - 1)], keys)
        below = self.packed.equal(self.keys[np.maximum(low - 1, 0)], keys)
        return np.maximum(above, below)

    def lengths(self, x: bytes) -> np.ndarray:
        """For each place of x how many characters from there the text has; the packed width stands for that many or more."""
        keys = self.packed.keys_of(np.frombuffer(x, np.uint8))
        return np.minimum(self.known(keys), np.arange(len(keys), 0, -1))

    def parse(self, x: bytes, leftmost: bool = True) -> Phrases:
        """Greedy parse of x into copies from the text and literals."""
        return self.parse_all([x], leftmost)[0]

    def parse_all(self, texts: list[bytes], leftmost: bool = True) -> list[Phrases]:
        """Greedy parses of texts. Many are parsed side by side, a phrase of each at a time; of few all places are looked up at once."""
        width, sizes = self.packed.width, np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(sizes + width) - sizes - width
        codes, joined = np.zeros(int((sizes + width).sum()), np.int64), b"".join(texts)
        symbols = np.frombuffer(joined, np.uint8)
        place = np.arange(len(joined)) + np.repeat(width * np.arange(len(texts)), sizes)
        codes[place] = self.packed.code[symbols]
        keys = self.packed.keys_of_codes(codes)
        end = begin + sizes
        if len(texts) < SIDE_BY_SIDE:
            known = np.zeros(len(codes), np.int64)
            known[place] = np.minimum(self.known(keys[place]), np.repeat(end, sizes) - place)
            starts, length, ranks = self._one_by_one(texts, begin.tolist(), known.tolist())
        else:
            starts, length, ranks = self._side_by_side(texts, begin, end, keys)
        text = np.searchsorted(begin, starts, "right") - 1
        pos = symbols[starts - width * text].astype(np.int64)
        copies = np.flatnonzero(length)
        if len(copies):
            asked, n, rank, at = keys[starts[copies]], length[copies], ranks[copies], (starts - width * text)[copies]
            if leftmost:
                pos[copies] = leftmost_sources(self.text, self.padded, self.keys, self.packed, [joined[a : a + k] for a, k in zip(at.tolist(), n.tolist())], asked, rank)
            else:
                plain = np.flatnonzero(rank < 0)
                rank[plain] = self.packed.ranges(self.keys, asked[plain], np.minimum(n, width)[plain])[0]
                pos[copies] = self.sa[rank]
        borders = np.searchsorted(text, np.arange(1, len(texts)))
        return list(zip(np.split(pos, borders), np.split(length, borders)))

    def _one_by_one(self, texts: list[bytes], begin: list[int], known: list[int]) -> Phrases:
        starts, length, ranks, width = [], [], [], self.packed.width
        for x, first in zip(texts, begin):
            i = 0
            while i < len(x):
                n, at = known[first + i], -1
                if n == width:
                    _, n, at = self.longest(x, i)
                starts.append(first + i)
                length.append(n)
                ranks.append(at)
                i += max(1, n)
        return np.array(starts, np.int64), np.array(length, np.int64), np.array(ranks, np.int64)

    def _side_by_side(self, texts: list[bytes], begin: np.ndarray, end: np.ndarray, keys: np.ndarray) -> Phrases:
        at, live, out = begin.copy(), np.flatnonzero(end > begin), [(np.empty(0, np.int64),) * 3]
        while len(live):
            here = at[live]
            n, rank = np.minimum(self.known(keys[here]), end[live] - here), np.full(len(live), -1)
            for k in np.flatnonzero(n == self.packed.width).tolist():
                _, n[k], rank[k] = self.longest(texts[live[k]], int(here[k] - begin[live[k]]))
            out.append((here, n, rank))
            at[live] += np.maximum(n, 1)
            live = live[at[live] < end[live]]
        starts, length, ranks = (np.concatenate(x) for x in zip(*out))
        by = np.argsort(starts)
        return starts[by], length[by], ranks[by]


def longest_previous(text: bytes) -> np.ndarray:
    """For each place the length of the longest part from there that also begins earlier."""
    near, packed = smaller_neighbours(suffix_array(text)), Packed.of(np.frombuffer(text, np.uint8))
    out = []
    for other in near:
        n = packed.common(other)
        for i in np.flatnonzero(n == packed.width).tolist():
            n[i] += common_prefix(text, int(other[i]) + packed.width, text, i + packed.width)
        out.append(n)
    return np.maximum(*out)


def matching_statistics(text: bytes, reference: Reference) -> np.ndarray:
    """For each place the length of the longest part from there that the reference has."""
    n = reference.lengths(text)
    for i in np.flatnonzero(n == reference.packed.width).tolist():
        n[i] = reference.longest(text, i)[1]
    return n


def transform(text: bytes, sa: np.ndarray) -> bytes:
    """The Burrows-Wheeler transform: the byte before each suffix in order, for the first suffix that of the end, 0."""
    b = np.frombuffer(b"\0" + text, np.uint8)
    return bytes([text[-1]]) + b[sa].tobytes() if text else b""


def decode(pos, length, reference: bytes | None = None) -> bytes:
    """The text of a parse, from itself or from a reference text."""
    out = bytearray()
    for p, n in zip(pos, length):
        if not n:
            out.append(p)
        elif reference is not None:
            out += reference[p : p + n]
        elif p + n <= len(out):
            out += out[p : p + n]
        else:  # the source runs into the phrase itself
            period = bytes(out[p:])
            out += (period * (n // len(period) + 1))[:n]
    return bytes(out)


def occurrences(text: bytes, pattern: bytes) -> list[int]:
    """All starts of the pattern, overlapping ones included."""
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def window_hashes(text: str, k: int) -> np.ndarray:
    """64-bit hashes of all parts of k characters of a text, in order: a polynomial over code points, mixed."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < k or k < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, power, width = c + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        out, done = np.zeros(len(c) - k + 1, np.uint64), 0
        while True:  # h has the hashes of parts of width characters; those that make up k are put together
            if k & width:
                out = out * power + h[done : done + len(out)]
                done += width
            if 2 * width > k:
                break
            h, power, width = h[:-width] * power + h[width:], power * power, 2 * width
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(31))


def best_alignment(read: str, window: str, most: int, separator: str | None = None) -> tuple[int, int, int, str] | None:
    """(start in the window, its characters, edits, CIGAR) of the whole read's closest place, None beyond `most` edits. Of places equally close the one that ends first."""
    return min(alignments(read, window, most, separator), key=lambda x: x[2], default=None)


def alignments(read: str, window: str, most: int, separator: str | None = None) -> list[tuple[int, int, int, str]]:
    """(start in the window, its characters, edits, CIGAR) of the whole read's closest place for each end within `most` edits, in the order of the ends.

    Places begin in the window's first 2 * most + 1 characters. Of alignments equally close there it is one with M before I
    before D from the end. A separator is in no place.
    """
    m, n, far = len(read), len(window), most + 1
    rows = [[0] * (n + 1)]  # rows[i][j]: edits of read[:i] with a part of the window that ends at j; far where no place can be
    for i in range(1, m + 1):
        above, row, c = rows[-1], [far] * (n + 1), read[i - 1]
        row[0] = min(far, i)
        for j in range(max(1, i - 2 * most), min(n, i + 3 * most) + 1):
            w = window[j - 1]
            if w != separator:
                row[j] = min(far, above[j - 1] + (c != w), above[j] + 1, row[j - 1] + 1)
        rows.append(row)
    found = []
    for end, edits in enumerate(rows[m]):
        if edits > most:
            continue
        i, j, cigar = m, end, []
        while i:
            here = rows[i][j]
            if j and window[j - 1] != separator and here == rows[i - 1][j - 1] + (read[i - 1] != window[j - 1]):
                i, j, op = i - 1, j - 1, "M"
            elif here == rows[i - 1][j] + 1:
                i, op = i - 1, "I"
            else:
                j, op = j - 1, "D"
            if cigar and cigar[-1][1] == op:
                cigar[-1][0] += 1
            else:
                cigar.append([1, op])
        found.append((j, end - j, edits, "".join(f"{x}{op}" for x, op in reversed(cigar))))
    return found
