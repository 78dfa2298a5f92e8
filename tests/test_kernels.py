import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lzseq.operators import kernels as K

dna = st.text(alphabet="ACGT", max_size=60).map(str.encode)


@settings(max_examples=200, deadline=None)
@given(dna)
def test_suffix_array_sorts_suffixes(t):
    assert K.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=200, deadline=None)
@given(dna)
def test_lz77_is_greedy_and_decodes(t):
    pos, length = K.lz77(t, leftmost=True)
    assert K.decode(pos, length) == t
    i = 0
    for p, n in zip(pos, length):
        want = 0
        while i + want < len(t) and 0 <= t.find(t[i : i + want + 1]) < i:
            want += 1
        assert n == want and p == (t.find(t[i : i + n]) if n else t[i])
        i += max(1, n)
    other = K.lz77(t)
    assert list(other[1]) == list(length) and K.decode(*other) == t


@settings(max_examples=200, deadline=None)
@given(dna, st.text(alphabet="ACGTN", max_size=40).map(str.encode), st.booleans())
def test_relative_parse(reference, x, leftmost):
    pos, length = K.Reference(reference).parse(x, leftmost)
    assert K.decode(pos, length, reference) == x
    i = 0
    for n in length:
        assert x[i : i + n] in reference and (i + n == len(x) or x[i : i + n + 1] not in reference)
        i += max(1, n)


def test_worked_example():
    text = b"ACGTTGCAACACGTTGCAACACGTAGCAAC"
    assert list(zip(*map(list, K.lz77(text, True)))) == [(65, 0), (67, 0), (71, 0), (84, 0), (3, 1), (2, 1), (1, 1), (0, 1), (0, 2), (0, 14), (0, 1), (5, 5)]
    assert list(zip(*map(list, K.Reference(b"ACGTTGCAAC").parse(b"ACGTAGCAANC")))) == [(0, 4), (0, 1), (5, 4), (78, 0), (1, 1)]
    assert K.suffix_array(b"banana").tolist() == [5, 3, 1, 0, 4, 2]
    assert K.occurrences(text, b"AC") == [0, 8, 10, 18, 20, 28]


def test_edges():
    assert K.suffix_array(b"").tolist() == [] and K.suffix_array(b"A").tolist() == [0]
    assert [list(x) for x in K.lz77(b"")] == [[], []]
    assert list(zip(*map(list, K.lz77(b"AAAAA", True)))) == [(65, 0), (0, 4)]
    t = bytes(random.Random(1).choices(b"ACGT", k=500)) * 3
    sa = K.suffix_array(t)
    lcp = K.lcp_array(t, sa)
    assert all(lcp[i] == K.common_prefix(t, int(sa[i]), t, int(sa[i - 1])) for i in range(1, len(t)))


def test_a_block_is_parsed_by_columns():
    """No kernel steps over a block's characters one by one: a parse takes less than 80 plain loops over them."""
    rng = random.Random(7)
    text, other = (bytes(rng.choices(b"ACGT", k=200_000)) for _ in "ab")

    def seconds(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    loop = seconds(lambda: [x + 1 for x in text])
    assert seconds(lambda: K.lz77(text, True)) < 80 * loop
    reference = K.Reference(text)
    assert seconds(lambda: reference.parse(other)) < 80 * loop


def test_long_matches_of_packed_symbols():
    rng = random.Random(8)
    for alphabet in (b"A", b"ACGT", bytes(range(256))):
        part = bytes(rng.choices(alphabet, k=150))
        text, x = part + bytes(rng.choices(alphabet, k=90)) + part[:80] + part, part[3:140] + b"\xff" + part[:33] + part[-21:]
        reference = K.Reference(text)
        for leftmost in (False, True):
            pos, length = reference.parse(x, leftmost)
            assert K.decode(pos, length, text) == x
            assert K.decode(*K.lz77(text, leftmost)) == text
        assert all(p == text.find(text[p : p + n]) for p, n in zip(pos.tolist(), length.tolist()) if n)
        assert K.matching_statistics(x, reference).tolist() == [max(n for n in range(len(x) - i + 1) if x[i : i + n] in text) for i in range(len(x))]
        assert K.longest_previous(text).tolist() == [max(n for n in range(len(text) - i + 1) if text.find(text[i : i + n]) < i or not n) for i in range(len(text))]


def test_many_texts_are_parsed_side_by_side_as_one_by_one():
    rng = random.Random(9)
    reference = K.Reference(bytes(rng.choices(b"ACGT", k=3000)) + b"ACGT" * 30)
    texts = [b"", b"N", reference.text[50:300], *(bytes(rng.choices(b"ACGTN", k=rng.randrange(120))) + reference.text[k : k + k] for k in range(K.SIDE_BY_SIDE))]
    for leftmost in (False, True):
        for x, got in zip(texts, reference.parse_all(texts, leftmost), strict=True):
            assert [v.tolist() for v in got] == [v.tolist() for v in reference.parse(x, leftmost)]
            assert K.decode(*got, reference.text) == x
