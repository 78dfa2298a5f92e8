"""Alignment of two tokenizers' tokens over the same bytes.

B's tokens are kept as an index of byte intervals in rising order; for each token of A two bisections find those that it
overlaps. Gaps between tokens of B that no token of A spans are the borders of groups.

Texts are cut where a word's white space begins, which no token of either side crosses. Each different piece of a
batch is encoded and aligned once, many pieces in one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .lookups import common, with_rest, written
from .textkit import by_text, in_parts, joined, release

#: Bytes of texts that are looked at together, a text at least; pairs that a task sums before it hands them on.
TOGETHER, HELD = 4 << 20, 1_000_000
#: Id pairs whose counts are broadcast; those of others are joined.
MOST_COMMON = 1_000_000
#: Bytes of pieces that are encoded as one string, at least.
ENCODED_BYTES = 1 << 10
#: Pieces that a worker remembers, and their longest.
REMEMBERED, REMEMBERED_BYTES = 300_000, 48
SPACE, LINE = 0x20, 0x0A
#: The letter that stands for a space in B's pieces, in UTF-8.
MARK = "▁".encode()


def intervals(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens of these sizes in bytes, one after the other."""
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the range of tokens of B that it overlaps."""
    (a_start, a_end), (b_start, b_end) = intervals(a_sizes), intervals(b_sizes)
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")


def groups(low: np.ndarray, high: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered from 0: the gap after a token of B is a border unless some range goes on beyond it."""
    spans = np.zeros(n_b + 1, np.int64)
    np.add.at(spans, low, 1)
    np.add.at(spans, high - 1, -1)
    border = np.cumsum(spans)[: max(0, n_b - 1)] == 0
    of_b = np.concatenate([[0], np.cumsum(border)])[:n_b]
    return of_b[low], of_b


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def totals(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring ends."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])


@dataclass
class Pieces:
    """What is known of each different piece: numbers by piece, where its links and its text of groups lie."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_ends: np.ndarray
    links: np.ndarray
    said: pa.Array
    broken: np.ndarray

    def of(self, at: np.ndarray) -> Pieces:
        """The pieces at these places."""
        size = np.diff(self.link_ends)[at]
        links = self.links[ranges(self.link_ends[:-1][at], size)]
        return Pieces(self.n_a[at], self.n_b[at], self.n_groups[at], np.concatenate([[0], np.cumsum(size)]), links, self.said.take(pa.array(at)), self.broken[at])

    def and_(self, more: Pieces) -> Pieces:
        """These, then more."""
        n_a, n_b, n_groups, links, broken = (np.concatenate([getattr(self, k), getattr(more, k)]) for k in ("n_a", "n_b", "n_groups", "links", "broken"))
        return Pieces(n_a, n_b, n_groups, np.concatenate([self.link_ends, more.link_ends[1:] + self.link_ends[-1]]), links, pa.concat_arrays([self.said, more.said]), broken)


def no_pieces() -> Pieces:
    none = np.empty(0, np.int64)
    return Pieces(none, none, none, np.zeros(1, np.int64), none, pa.array([], pa.large_binary()), none.astype(bool))


class Aligner:
    """Byte-level BPE (a tokenizers JSON file) as A and a SentencePiece model with byte fallback, which puts a space first, as B."""

    def __init__(self, path_a: str, path_b: str):
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = {c: i for i, c in enumerate(byte_letters())}
        top = max(self.a.get_vocab().values()) + 1
        bytes_a = [b""] * top
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            bytes_a[i] = bytes(value[c] for c in t)
        self.size_b = self.b.vocab_size()
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        whole = np.frombuffer(b" ".join((b"", *bytes_b)), np.uint8)
        inside = np.ones(len(whole), bool)
        inside[np.cumsum([0, *(len(x) + 1 for x in bytes_b[:-1])])] = False
        if (begins_word(whole) & inside).any():
            raise ValueError(f"{path_b}: a token goes on after the white space that begins a word")
        self.bytes_a, self.bytes_b = (pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b))
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (bytes_a, bytes_b))
        ids_a, ids_b = range(top), range(self.size_b)
        self.places: dict[bytes, int] = {}
        self.seen, self.uses = no_pieces(), np.empty(0, np.int64)
        self.labels = pa.array([*(b"%d," % i for i in ids_a), *(b"%d|" % i for i in ids_a), *(b"%d," % i for i in ids_b), *(b"%d;" % i for i in ids_b)], pa.large_binary())

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for texts that begin with a space, one after the other; None if their bytes aren't the texts'."""
        texts = [p.decode() for p in parts]
        a = np.array([i for x in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in x.ids], np.int64)
        b = np.array([i for x in self.b.encode([t[1:] for t in texts], num_threads=1) for i in x], np.int64)
        data = b"".join(parts)
        for ids, sizes, known in ((a, self.sizes_a, self.bytes_a), (b, self.sizes_b, self.bytes_b)):
            if int(sizes[ids].sum()) != len(data) or joined(known, ids, np.array([0, len(ids)]))[0] != data:
                return None
        return a, b

    def _together(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of both for pieces, one after the other, and where each piece's ids end; None if that can't be told."""
        names = known.to_pylist()
        parts, lead = [b" a"], 2  # before a piece that doesn't begin with a space, too
        for x in names:
            if len(parts[-1]) >= ENCODED_BYTES and x[:1] == b" ":
                parts.append(x)
            else:
                parts[-1] += x
        got = self._encode(parts)
        if got is None:
            return None
        cuts = np.cumsum([lead, *map(len, names)])
        out = []
        for ids, sizes in zip(got, (self.sizes_a, self.sizes_b)):
            ends = np.cumsum(sizes[ids])
            at = np.searchsorted(ends, cuts)
            if (ends[at] != cuts).any():
                return None
            out.append((ids[at[0] + 1 :], at[1:] - at[0]))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def pieces(self, known: pa.Array) -> tuple[Pieces, np.ndarray]:
        """What is known of the pieces, and the place of each of them in it. Pieces that end in white space, or perhaps do, are encoded by themselves."""
        known = known.cast(pa.large_binary())
        at = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        data = np.frombuffer(known.buffers()[2] or b"", np.uint8)
        last = data[at[1:] - 1]
        before = data[np.maximum(at[1:] - 2, 0)]
        closed = ends_word(last, before)
        one, rest = np.flatnonzero(closed), np.flatnonzero(~closed)
        got = self._together(known.take(pa.array(one))) if len(one) else None
        if got is None:
            one, rest = one[:0], np.arange(len(known))
            got = (np.empty(0, np.int64),) * 4
        alone = [self._together(known.take(pa.array([k]))) for k in rest.tolist()]
        broken = np.concatenate([np.zeros(len(one), bool), np.array([x is None for x in alone], bool)])
        ids, ends = [], []
        for k in range(2):
            parts = [x[k] if x else np.empty(0, np.int64) for x in alone]
            ids.append(np.concatenate([got[k], *parts]))
            more = np.cumsum([len(x) for x in parts]) if parts else np.empty(0, np.int64)
            ends.append(np.concatenate([[0], got[2 + k], more + len(got[k])]).astype(np.int64))
        place = np.empty(len(known), np.int64)
        place[np.concatenate([one, rest])] = np.arange(len(known))
        return self._aligned(*ids, *ends, broken), place

    def _aligned(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, broken: np.ndarray) -> Pieces:
        low, high = overlaps(self.sizes_a[a], self.sizes_b[b])
        group_a, group_b = groups(low, high, len(b))
        n_links = high - low
        links = np.repeat(a, n_links) * self.size_b + b[ranges(low, n_links)]
        n_groups = int(group_b[-1]) + 1 if len(b) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        # A group's tokens of A stand before its tokens of B; the last of each side has the mark that ends it.
        items = np.empty(len(a) + len(b), np.int64)
        top = len(self.sizes_a)
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[np.cumsum(in_a) - 1], ends_b[np.cumsum(in_b) - 1] = True, True
        items[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + top * ends_a
        items[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * top + b + self.size_b * ends_b
        rows = self.labels.take(pa.array(items))
        starts = np.frombuffer(rows.buffers()[1], np.int64)[: len(items) + 1] if len(items) else np.zeros(1, np.int64)
        said = pa.Array.from_buffers(pa.large_binary(), len(broken), [None, pa.py_buffer(np.ascontiguousarray(starts[a_ends + b_ends]).tobytes()), rows.buffers()[2] if len(items) else pa.py_buffer(b"")])
        group_ends = np.concatenate([[0], np.cumsum(ends_b)])[b_ends]
        return Pieces(np.diff(a_ends), np.diff(b_ends), np.diff(group_ends), np.concatenate([[0], np.cumsum(n_links)])[a_ends], links, said, broken)

    def _place(self, pieces: pa.Array, index: np.ndarray) -> tuple[Pieces, np.ndarray]:
        """What is known of all pieces seen, and the place in it of each piece that index names. Short pieces that come again are remembered."""
        names = pieces.to_pylist()
        if len(self.places) > REMEMBERED:
            often = np.flatnonzero(self.uses >= np.median(self.uses) + 1)[: REMEMBERED // 2]
            new = np.full(len(self.uses), -1)
            new[often] = np.arange(len(often))
            self.places = {x: int(new[k]) for x, k in self.places.items() if new[k] >= 0}
            self.seen, self.uses = self.seen.of(often), np.ones(len(often), np.int64)
        at = np.array([self.places.get(x, -1) for x in names], np.int64)
        unseen = np.flatnonzero(at < 0)
        seen, first = self.seen, len(self.uses)
        if len(unseen):
            got, place = self.pieces(pieces.take(pa.array(unseen)))
            at[unseen] = first + place
            seen = seen.and_(got)
            short = np.array([len(names[k]) <= REMEMBERED_BYTES for k in unseen.tolist()])
            kept = np.flatnonzero(short)
            self.seen = self.seen.and_(got.of(place[kept]))
            self.places.update((names[k], first + i) for i, k in enumerate(unseen[kept].tolist()))
            self.uses = np.concatenate([self.uses, np.zeros(len(kept), np.int64)])
        np.add.at(self.uses, at[at < first], 1)
        return seen, at[index]

    def align(self, texts: list[bytes]) -> list[tuple]:
        """For each text (n_a, n_b, n_groups, n_links, groups_sha256, its id pairs a * size_b + b, how often each)."""
        plain = [b"" if not t or MARK in t else b" " + readable(t) for t in texts]
        pieces, ends = cut(plain)
        if not len(pieces):
            return [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        coded = pieces.dictionary_encode()
        known, at = self._place(coded.dictionary, coded.indices.to_numpy().astype(np.int64))
        sums = [totals(x[at], ends) for x in (known.n_a, known.n_b, known.n_groups)]
        broken = totals(known.broken[at].astype(np.int64), ends) > 0
        size = np.diff(known.link_ends)[at]
        links = known.links[ranges(known.link_ends[:-1][at], size)]
        link_ends = np.concatenate([[0], np.cumsum(size)])[ends]
        out = []
        for k, said in enumerate(joined(known.said, at, ends)):
            if broken[k] or not len(said):
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            keys, times = np.unique(links[link_ends[k] : link_ends[k + 1]], return_counts=True)
            out.append((*(int(x[k]) for x in sums), int(link_ends[k + 1] - link_ends[k]), hashlib.sha256(said[:-1]).hexdigest(), keys.tobytes(), times.astype(np.int64).tobytes()))
        return out


def readable(text: bytes) -> bytes:
    """Valid UTF-8 as it is."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()


def ends_word(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a letter that ends in these two bytes is surely no white space: ASCII above the space, or two bytes from U+00C0 on."""
    return (last > SPACE) & (last < 0x80) | (last >= 0x80) & (before >= 0xC3) & (before <= 0xDF)


def begins_word(b: np.ndarray) -> np.ndarray:
    """Whether a byte is a space or line feed after a letter that is surely no white space."""
    out = (b == SPACE) | (b == LINE)
    out[:1] = False
    out[1:] &= ends_word(b[:-1], np.concatenate([b[:1], b[:-2]]))
    return out


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, and where each text's end. A piece begins at a text's start and at a space or line feed after a letter that is surely no white space."""
    data = b"".join(texts)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    begins = begins_word(b)
    begins[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(b)).astype(np.int64).tobytes()), pa.py_buffer(data)])
    return pieces, np.searchsorted(starts, at)


_loaded: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of files and process."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every text, and pairs, times: its id pairs (a * size of B + b) and how often each, as 64-bit integers in binary.

    The files are read on every executor. Texts that are null or empty, and those whose tokens' bytes on either side
    aren't those of the text after a space, have zeros and ''. A row depends on its text alone, so repeated rows
    repeat. Only doc_id and text are read.
    """
    a, b = default_paths()
    a, b = path_a or a, path_b or b

    def run(texts):
        got = [x for start, end in in_parts(texts, TOGETHER) for x in load(a, b).align(texts[start:end])]
        columns = list(zip(*got)) or [()] * 7
        return [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *(pa.array(c, pa.binary()) for c in columns[5:])]

    return by_text(docs, run, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(at, np.concatenate(times).astype(np.float64), len(known)).astype(np.int64)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (links that hold it, over all documents), best (1 if no pair of its token of B has more, else 0). Each task sums its pairs first; a token of B has as many pairs as A has tokens at most."""

    def run(batches: Iterator[pa.RecordBatch]):
        keys, times, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(np.frombuffer(k, np.int64))
                times.append(np.frombuffer(t, np.int64))
                held += len(keys[-1])
            if held > 4 * HELD:
                k, t = _summed(keys, times)
                keys, times, held = [k], [t], len(k)
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t)], names=["pair", "n"])
                    keys, times, held = [], [], 0
        if held:
            k, t = _summed(keys, times)
            for start in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[start : start + 50_000]), pa.array(t[start : start + 50_000])], names=["pair", "n"])
        release()

    counts = aligned.where("n_links > 0").select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    token = F.col("pair") % size_b
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(token))).cast("bigint").alias("best"))


def cross_tokenizer_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_common: int = MOST_COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    n_best is the number of links whose pair no other pair of the same token of B exceeds over all documents (ties all
    count), count_sum the sum of the links' counts. Counts of the most_common commonest pairs are broadcast; documents
    that hold others get those by a join. Else as align_documents, whose result and counts are kept as tables in the
    shared folder.
    """
    a, b = default_paths()
    a, b = path_a or a, path_b or b
    spark = docs.sparkSession
    size_b = load(a, b).size_b
    aligned = written(align_documents(docs, a, b), "aligned")
    counts = written(pair_counts(aligned, size_b), "pairs")
    chosen, all_known = common(counts, most_common)
    rows = chosen.toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast((rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(np.int64)))
    kinds = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        pairs, n, best = known.value
        for batch in batches:
            n_best, count_sum, rest, rest_n, ends = [], [], [], [], [0]
            for k, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                k, t = np.frombuffer(k, np.int64), np.frombuffer(t, np.int64)
                at = np.minimum(np.searchsorted(pairs, k), max(0, len(pairs) - 1))
                hit = pairs[at] == k if len(pairs) else np.zeros(len(k), bool)
                n_best.append(int((best[at[hit]] * t[hit]).sum()))
                count_sum.append(int((n[at[hit]] * t[hit]).sum()))
                rest.append(k[~hit])
                rest_n.append(t[~hit])
                ends.append(ends[-1] + len(rest[-1]))
            left = pa.StructArray.from_arrays([pa.array(np.concatenate(rest)), pa.array(np.concatenate(rest_n))], names=["key", "times"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), batch.column("groups_sha256"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left).cast(kinds)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"])

    scored = aligned.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rest array<struct<key: bigint, times: bigint>>")
    return with_rest(scored, counts, "pair", {"n_best": F.col("best"), "count_sum": F.col("n")}, all_known)
