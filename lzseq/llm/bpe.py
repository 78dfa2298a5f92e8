"""Byte-pair encoding by a dynamic programme over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its encoding: of the vocabulary's tokens that end there
(found by an automaton over the vocabulary with suffix links), the one that the prefix's own last token before it
tolerates, that is, no merge across their border would have come earlier. Back-pointers then give the ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import by_text

#: Unicode's White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_spaces = regex.compile(f"[{SPACE}]+")
NEVER = 1 << 60
#: Entries in each of a cache's two generations, in the table of token pairs, and the longest text that is kept.
CACHED, CACHED_PAIRS, CACHED_CHARS = 250_000, 500_000, 48
#: Bytes of texts that are put together at once, a text at least.
TOGETHER = 4 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class WordBpe:
    """A BPE tokenizer with word ends, as described by a tokenizers JSON file: NFC, white space dropped, lower case, words split by the file's pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["post_processor"] or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: only lower-case BPE files with word ends are supported")
        self.suffix = model["end_of_word_suffix"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        # Normal forms, and whatever holds characters newer than Python's tables, follow the library's own tables.
        self.composed, self.lowered = tokenizers.normalizers.NFC().normalize_str, tokenizers.normalizers.Lowercase().normalize_str
        self.split_newer = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.has_special = regex.compile("|".join(map(regex.escape, self.special))).search
        vocabulary = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.token_text = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        # A symbol is a byte, plus 256 if its word ends there.
        symbols = {}
        for t, i in vocabulary.items():
            end = t.endswith(self.suffix) and len(t) > len(self.suffix)
            chars = [value[c] for c in (t.removesuffix(self.suffix) if end else t)]
            chars[-1] += 256 * end
            symbols[i] = "".join(map(chr, chars))
        top = max(vocabulary.values()) + 1
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.pairs: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank[z] >= 0:
                raise ValueError(f"{path}: two merges make the token {z}")
            self.rank[z], self.left[z], self.right[z] = r, x, y
            self.pairs[x, y] = r
        self.automaton = ahocorasick.Automaton()
        good: dict[int, bool] = {}
        for i in sorted(symbols, key=lambda i: self.rank[i]):  # a token that its own text isn't encoded as never comes out
            x, y = self.left[i], self.right[i]
            good[i] = x < 0 or good[x] and good[y] and self._apart(x, y, self.rank[i])
            if good[i]:
                self.automaton.add_word(symbols[i], (i, len(symbols[i])))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.cached, self.cached_pairs = CACHED, CACHED_PAIRS
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge across the border of tokens a and b comes before a, b or the rank before is reached.

        While tokens grow, the border has the right spine of a on one side and the left spine of b on the other. A merge
        across it wins over a later merge on either side; on equal ranks the one further left comes first.
        """
        rank, pairs = self.rank, self.pairs
        ends_a, ends_b = before, before
        while True:
            r = pairs.get((a, b))
            if r is not None and r < ends_a and (r <= ends_b if ends_b < before else r < ends_b):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:  # the younger of the two is taken apart; of one age, the right one is older in this walk back
                ends_a, a = ra, self.right[a]
            else:
                ends_b, b = rb, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        data = word.encode("utf-8", "replace")
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        n = len(text)
        last, back, fits = [-1] * (n + 1), [0] * (n + 1), self.fits
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = fits.get(key := before << 24 | token)
                if ok is None:
                    if len(fits) >= self.cached_pairs:
                        fits.clear()
                    ok = fits[key] = self._apart(before, token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def _keep(self, text: str, got: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
        """Puts into the young generation; a full one becomes the old one, so what is used often stays."""
        if len(text) <= CACHED_CHARS:
            if len(self.young) >= self.cached:
                self.young, self.old = {}, self.young
            self.young[text] = got
        return got

    def _of_ids(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.token_text[i] for i in ids]).encode()

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """Of a word of the pattern, which as a chunk is the same."""
        got = self.young.get(word) or self.old.get(word) or self._of_ids(self.encode_word(word))
        return self._keep(word, got)

    def _plain(self, chunk: str) -> tuple[bytes, bytes]:
        """Of a piece without special tokens."""
        newer = False
        if not chunk.isascii():
            chunk = self.composed(chunk)
            newer = any(unicodedata.category(c) == "Cn" for c in chunk)
            if "Σ" in chunk:  # lower case here is letter by letter, without the rule for a final sigma
                chunk = chunk.replace("Σ", "σ")
        if newer:
            words = [w for w, _ in self.split_newer(self.lowered(chunk))]
        else:
            chunk = chunk.lower()
            words = [chunk] if chunk.isalpha() else self.words(chunk)
        if len(words) == 1:
            return self._word(words[0])
        got = [self._word(w) for w in words]
        return b"".join([x[0] for x in got]), b" ".join([x[1] for x in got])

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Of a piece without ASCII white space."""
        got = self.young.get(chunk)
        if got is not None:
            return got
        got = self.old.get(chunk)
        if got is None:
            pieces = [chunk] if chunk.isascii() else _spaces.split(chunk)
            if "<" in chunk and self.has_special(chunk):
                pieces = [p for piece in pieces for p in self.split_special(piece)]
            parts = [self._of_ids([self.special[p]]) if p in self.special else self._plain(p) for p in pieces if p]
            got = parts[0] if len(parts) == 1 else (b"".join([x[0] for x in parts]), b" ".join([x[1] for x in parts if x[1]]))
        return self._keep(chunk, got)

    def encode_all(self, texts: list[str]) -> list[tuple[memoryview, memoryview]]:
        """For each text (ids as little-endian unsigned 32-bit integers, UTF-8 of the tokens' texts with spaces between).

        The texts' different pieces are encoded once and put together by Arrow.
        """
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        pieces = cut.flatten().dictionary_encode()
        got = list(map(self._chunk, pieces.dictionary.to_pylist()))

        def joined(parts: list[bytes]) -> tuple[list[int], memoryview]:
            rows = pa.array(parts, pa.large_binary()).take(pieces.indices)
            ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
            return ends[cut.offsets.to_numpy()].tolist(), memoryview(rows.buffers()[2] or b"").cast("B")

        (a, ids), (b, said) = joined([x[0] for x in got]), joined([x[1] + b" " if x[1] else b"" for x in got])
        return [(ids[a[i] : a[i + 1]], said[b[i] : max(b[i], b[i + 1] - 1)]) for i in range(len(texts))]

    def encode(self, text: str) -> tuple[bytes, bytes]:
        a, b = self.encode_all([text])[0]
        return bytes(a), bytes(b)

    def text_of(self, ids) -> str:
        """The text that ids stand for: word ends become spaces."""
        value = {c: b for b, c in enumerate(byte_letters())}
        out = bytearray()
        for i in ids:
            t = self.token_text[i]
            if i in self.special.values():
                out += t.encode()
                continue
            out += bytes(value[c] for c in t.removesuffix(self.suffix))
            if t.endswith(self.suffix) and len(t) > len(self.suffix):
                out += b" "
        return out.decode("utf-8", "replace").strip()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer for each path and process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def joined_lists(rows: list[pa.Array]) -> pa.Array:
    """Arrays of numbers as the rows of one list array."""
    values = pa.concat_arrays(rows) if rows else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids array<int> of every text.

    cached bounds the entries of each of a worker's caches (twice as many token pairs), which cost memory and save time.
    The file at path is read on every executor. Null and empty texts have no tokens and the digests of nothing. The
    result of a row depends on its text alone, so repeated rows repeat. Only doc_id and text are read.
    """
    path = path or default_path()

    def run(texts):
        bpe = load(path)
        bpe.cached, bpe.cached_pairs = cached, 2 * cached
        n, ids, digests, decoded = [], [], [], []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            for a, b in bpe.encode_all([t.decode("utf-8", "replace") for t in texts[start:end]]):
                n.append(len(a) // 4)
                digests.append(hashlib.sha256(a).hexdigest())
                decoded.append(hashlib.sha256(b).hexdigest())
                if with_ids:
                    ids.append(pa.array(np.frombuffer(a, "<i4")))
            start = end
        return [pa.array(n, pa.int64()), pa.array(digests), pa.array(decoded), *([joined_lists(ids)] if with_ids else [])]

    return by_text(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids; null ids are an empty text."""
    path = path or default_path()

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return pa.array([load(path).text_of(x or []) for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", text("ids").alias("text"))
