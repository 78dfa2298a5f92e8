"""Periodic runs of words: stretches that repeat with a period of q words at least four times.

How many words equal the word q places on is counted for every lag q at once: for a frequent word by the exact
autocorrelation of its places (a Fourier transform), for a rare one by the differences of its places. Only lags with as
many matches as a run needs, beyond those that runs of a divisor of q explain, get a scan for islands of matches.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textkit import by_text, in_parts, joined, words_of

#: A run is so many words long at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A word is frequent if its occurrences squared are over so many times the length of a transform.
FREQUENT = 2
#: Bytes of texts that are looked at together, a text at least.
TOGETHER = 4 << 20

Run = tuple[int, int, int]  # start, length, period


def lag_counts(words: np.ndarray, most: int) -> np.ndarray:
    """For q from 0 to most, the number of places i with words[i] = words[i + q]; 0 for q = 0. words: small numbers from 0."""
    n, out = len(words), np.zeros(most + 1, np.int64)
    if most < 1:
        return out
    size = 1 << (n + most - 1).bit_length()
    times = np.bincount(words)
    frequent = np.flatnonzero(times * times > FREQUENT * size)
    if len(frequent):
        power = np.zeros(size // 2 + 1)
        for w in frequent:
            f = np.fft.rfft(words == w, size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    left = np.flatnonzero(times[sorted_words] ** 2 <= FREQUENT * size)
    step = 1
    while len(left):
        left = left[left + step < n]
        left = left[sorted_words[left] == sorted_words[left + step]]
        lag = order[left + step] - order[left]
        near = lag <= most  # a word's later places lie further on
        out += np.bincount(lag[near], minlength=most + 1)
        left = left[near]
        step += 1
    out[0] = 0
    return out


def stretches(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True that are `least` long or more."""
    padded = np.zeros(len(hit) + 2, np.int8)
    padded[1:-1] = hit
    edges = np.flatnonzero(np.diff(padded))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def within(a: int, end: int, known: list[tuple[list[int], list[int]]]) -> bool:
    """Whether one of the known stretches, each list of them in rising order, contains that from a to end."""
    for starts, ends in known:
        k = bisect.bisect_right(starts, a) - 1
        if k >= 0 and end <= ends[k]:
            return True
    return False


def islands(words: np.ndarray, q: int, least: int, known: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of places i with words[i] = words[i + q] that have `least` places or more and don't lie in known runs."""
    step, last, out = max(1, q // 8), len(words) - q, []
    at = np.arange(0, last, step)  # such a stretch holds least // step of these in a row, and ends before the next ones
    for a, b in zip(*(x.tolist() for x in stretches(words[at] == words[at + q], least // step))):
        a, b = a * step, (b - 1) * step + 1
        if within(a, b + q, known):
            continue
        low, high = max(0, a - step + 1), min(last, b + step - 1)
        for x, y in zip(*stretches(words[low:high] == words[low + q : high + q], least)):
            x, y = int(low + x), int(low + y)
            if not within(x, y + q, known):
                out.append((x, y))
    return out


def runs(words: np.ndarray) -> list[Run]:
    """All runs, by start and period."""
    n = len(words)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(LEAST_WORDS - lags, (LEAST_PERIODS - 1) * lags)
    counts = lag_counts(words, most)
    found: list[Run] = []
    by_period: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends, both rising
    for q in np.flatnonzero(counts >= need).tolist():
        if counts[q] < need[q]:  # what is left once matches inside runs of a divisor are taken off
            continue
        for a, b in islands(words, q, int(need[q]), [by_period[d] for d in by_period if q % d == 0]):
            end = b + q
            found.append((a, end - a, q))
            starts, ends = by_period.setdefault(q, ([], []))
            starts.append(a)
            ends.append(end)
            multiples = np.arange(q, min(most, end - a) + 1, q)
            counts[multiples] -= end - a - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the stated tail repeated, in a tenth of the ids; ids that are null have none."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def dropped(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    out = np.zeros(n, bool)
    for start, length, q in found:
        out[start + q : start + length] = True
    return out


def strongest(found: list[Run]) -> Run | None:
    """The run with the most repeats, exactly; ties go to the smaller start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def documents_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the strongest run (null without one), runs_sha256, collapsed_sha256 of every text.

    plant first replaces words by the fixed rule of `planted`. Null texts, empty ones and those without words have no
    runs and the digests of nothing; a null id plants nothing. A row depends on its id and text alone, so repeated rows
    repeat. Only doc_id and text are read. Time grows with a text's length times its logarithm, and with the
    lags that need a scan; memory with its length.
    """

    def run(texts, ids):
        rows = []
        for start, end in in_parts(texts, TOGETHER):
            known, index, ends = words_of(texts[start:end])
            kept, kept_ends, details = [], [0], []
            for k in range(end - start):
                at = index[ends[k] : ends[k + 1]]
                at = planted(at, ids[start + k]) if plant else at
                found = runs(np.unique(at, return_inverse=True)[1]) if len(at) >= LEAST_WORDS else []
                kept.append(at[~dropped(len(at), found)] if found else at)
                kept_ends.append(kept_ends[-1] + len(kept[-1]))
                details.append(found)
            spaced = pc.binary_join_element_wise(known.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
            for found, said in zip(details, joined(spaced, np.concatenate(kept), np.array(kept_ends))):
                best = strongest(found)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                rows.append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(said[:-1] if len(said) else said).hexdigest()))
        columns = list(zip(*rows)) or [()] * 7
        return [*(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])]

    return by_text(docs, run, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", with_id=True)
