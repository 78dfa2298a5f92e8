"""Periodic runs, against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lzseq.llm import runs

from .helpers import ODD, prose, table


def by_definition(w):
    """Every maximal stretch with a smallest period q and at least max(6, 4 q) words."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def mixed(rng, most):
    """Words among stretches that repeat, some of them within others."""
    k, out = rng.choice([1, 2, 3, 30]), []
    for _ in range(rng.randint(0, 8)):
        out += [rng.randrange(k) for _ in range(rng.randint(0, 9))]
        part = [rng.randrange(k) for _ in range(rng.randint(1, most))]
        out += (part * 9)[: rng.randint(1, 6 * most)]
    return out


@pytest.mark.parametrize("frequent", [2, 1e-9, 1e9])  # as it is, transforms only, differences only
def test_runs_follow_definition(frequent, monkeypatch):
    monkeypatch.setattr(runs, "FREQUENT", frequent)
    rng = random.Random(3)
    for k in range(400):
        w = mixed(rng, 40 if k % 10 == 0 else 7)
        ids = np.unique(np.array(w, int), return_inverse=True)[1]
        assert runs.runs(ids) == by_definition(w)
        n = len(w)
        assert runs.lag_counts(ids, n // 2).tolist() == [0, *(sum(a == b for a, b in zip(w, w[q:])) for q in range(1, n // 2 + 1))]


def expected(doc_id, text, plant):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
    found = by_definition(w)
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in out)
    return (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("plant", [False, True])
def test_documents_follow_definition(spark, plant, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 5_000)
    rng = random.Random(4)
    texts = [*(t for t in ODD if t is None or len(t) < 1000), *(" ".join(map(str, mixed(rng, 9))) for _ in range(60)), *(prose(rng, 40) for _ in range(60)), "Ab ab Ab ab Ab ab Ab ab x", "a a a a a b b b b b b b b", "\x1f \x1f\x0b\x1f \x1f \x1f \x1f"]
    got = runs.documents_runs(table(spark, texts), plant).collect()
    assert sorted(r[0] for r in got) == list(range(len(texts)))
    for r in got:
        assert tuple(r)[1:] == expected(r[0], texts[r[0]], plant)


def test_odd_tables(spark):
    assert runs.documents_runs(table(spark, [])).count() == 0
    got = {r.doc_id: r for r in runs.documents_runs(table(spark, ODD)).collect()}
    assert (got[7].n_runs, got[7].start, got[7].length, got[7].period, got[7].exponent_milli) == (1, 0, 20_000, 1, 20_000_000)
    assert all(got[k].n_runs == 0 and got[k].start is None and got[k].collapsed_sha256 == hashlib.sha256(b"").hexdigest() for k in range(3))
    twice = runs.documents_runs(table(spark, ["a b " * 9] * 3, ids=[5, 5, None]), plant=True).collect()
    assert len(twice) == 3 and len({tuple(r)[1:] for r in twice}) == 1


def test_long_text_of_one_word():
    w = np.zeros(400_000, int)
    w[100_000], w[300_000:] = 1, np.arange(100_000) % 50
    assert runs.runs(w) == [(0, 100_000, 1), (100_001, 199_999 + 1, 1), (300_000, 100_000, 50)]
