"""Personal data replaced by surrogates: keyed, of the same type, script, gender and format, the same one everywhere.

A surrogate is a keyed permutation of the values of the entity's format (a Feistel network over mixed digits with cycle
walking, conjugated with a shift so that nothing stays as it is). It hangs on the value alone, so different values of a
format get different surrogates on any number of machines without a shared table, and one value gets one surrogate in all
documents, however it is written (a phone number with or without its country code, an address short or long, a name with any
title or none). A family or given name that stands alone after the full name gets the same surrogate there. A surrogate that is
also an original stands in for another value there, which is replaced too; such cases are counted as collisions.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import bounded_batches, spread

# Given names by script and gender; their surrogates come from the same list.
GIVEN = {
    ("latin", "f"): "Alice Amanda Amelia Barbara Beatrice Camille Carmen Caroline Charlotte Claire Deborah Dorothy Elizabeth Emily Emma Florence Gabriela Hannah Helen Ingrid Isabella Jennifer Jessica Julia Karen Katharina Laura Linda Margaret Maria Mary Melissa Michelle Nancy Olivia Patricia Sandra Sarah Sophie Susan Victoria Yvonne".split(),
    ("latin", "m"): "Albert Alexander Andrew Anthony Benjamin Brian Carlos Charles Christopher Daniel David Edward Felipe Frederick George Gregory Heinrich James John Jonathan Joseph Juan Kenneth Kevin Lawrence Matthew Michael Nicholas Patrick Paul Peter Philippe Richard Robert Ronald Samuel Stephen Steven Thomas Timothy Walter William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Ирина Ксения Людмила Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Евгений Иван Константин Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κωνσταντίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Σπυρίδων".split(),
}
# Forms of address.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία")
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Letters at the end of a given name that carry its gender, which its surrogate keeps, at most; and what is permuted at least.
ENDING, STEM = 2, 3
# Small words within family names.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "du", "al", "bin", "ibn", "ter", "zu")
# Letters that are permuted among each other, by script: vowels, consonants.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αειουω", "βγδζθκλμνξπρστφχψ", "áéíóú", "äöü", "0123456789")
_alphabet = {c: i for i, a in enumerate(ALPHABETS) for c in a}
_value = {c: k for a in ALPHABETS for k, c in enumerate(a)}
_known = {n: (script, gender) for (script, gender), names in GIVEN.items() for n in names}
_name = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯΆΈΉΊΌΎΏЁ][a-zß-öø-ÿα-ωа-яάέήίόύώςё]+"
_one = rf"(?:[OD]['’]|Ma?c(?=[A-Z]))?{_name}"
_family = rf"(?:(?:{'|'.join(PARTICLES)})[ ]){{0,3}}{_one}(?:-{_one})?"
#: All kinds in one pass; what each really is, valid() decides.
PATTERN = re.compile(
    rf"""(?P<email>(?<![\w.+%-])[^\W_][\w.+%-]{{0,63}}@(?:[^\W_](?:[\w-]{{0,61}}[^\W_])?\.){{1,8}}[^\W\d_]{{2,24}}(?![\w-]))
|(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
|(?P<phone>(?<![\w.+/-])(?:\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\+(?!1[ .(-])\d{{1,3}}[ .-]?(?:\(\d{{1,5}}\)|\d{{1,5}})(?:[ -]?\d{{2,5}}){{1,4}})(?![\w/-]|\.\d))
|(?P<phone2>(?<![\w.+/-])(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?![\w/-]))
|(?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
|(?P<card>(?<![\w.-])(?:\d{{13,19}}|\d{{4}}(?P<gap>[ -])\d{{4}}(?P=gap)\d{{4}}(?P=gap)\d{{1,7}}|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?![\w-]))
|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]{{3,4}}:)[0-9A-Fa-f]{{3,4}}(?:::?[0-9A-Fa-f]{{1,4}}){{1,7}}(?:::)?(?![\w:]|\.\w))
|(?P<ip>(?<![\w.])\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?![\w]|\.\d))
|(?P<name>\b(?:(?:{"|".join(TITLES)})\.?[ ]{_family}(?:[ ]{_family}){{0,2}}|(?:{"|".join(n for v in GIVEN.values() for n in v)})(?:[ ][A-Z]\.)?[ ]{_family}))(?!\w)""",
    re.X,
)
#: What a document must have for PATTERN to find anything.
_any = re.compile(rf"@|\d[\d .)-]{{5}}|[0-9A-Fa-f]{{3}}::?[0-9A-Fa-f]|\b(?:{'|'.join(TITLES)}|{'|'.join(_known)})\b")


def luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    n = int("".join(str(int(c, 36)) for c in f"{account}{country}00"))
    return f"{98 - n % 97:02d}"


def valid(kind: str, text: str) -> bool:
    """Whether the match has the checks and ranges of its kind."""
    digits = re.sub(r"\D", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1
    if kind == "ip":
        return all(int(x) < 256 and str(int(x)) == x for x in text.split(".")) and text not in ("0.0.0.0", "127.0.0.1", "255.255.255.255")
    if kind == "ipv6":
        try:
            first = int(ipaddress.IPv6Address(text)) >> 112
        except ValueError:
            return False
        return 0x2000 <= first < 0x4000 or first >= 0xFC00
    if kind == "iban":
        s = text.replace(" ", "")
        return 15 <= len(s) <= 34 and iban_check(s[:2], s[4:]) == s[2:4]
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind in ("phone", "phone2"):
        return 8 <= len(digits) <= 15
    return True


def entities(text: str):
    """(kind, match) of every valid entity. What turns out to be none is gone over again from its second character, as it may begin too early."""
    at = 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        if valid(kind, m[0]):
            yield kind.rstrip("2"), m
            at = m.end()
        else:
            at = m.start() + 1


class Surrogates:
    """Keyed surrogates of values. The same key gives the same surrogates everywhere."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _round(self, tweak: bytes, i: int, x: int, n: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%s|%d|%d" % (tweak, i, x), "sha256"), "big") % n

    def _feistel(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for i in range(9, -1, -1) if back else range(10):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: bytes) -> int:
        """x in 0 .. n-1 to another such number, one to one; itself only for n = 1."""
        if n < 2:
            return x
        a = int(n**0.5) if n < 1 << 52 else 1 << n.bit_length() // 2
        a = max(2, a)
        b = -(-n // a)

        def walk(y, back):
            while True:
                y = self._feistel(y, a, b, tweak, back)
                if y < n:
                    return y

        shift = 1 + self._round(tweak, 99, n % (1 << 62), n - 1)
        return walk((walk(x, True) + shift) % n, False)

    def letters(self, text: str, tweak: bytes) -> str:
        """Letters and digits among their kind (script, vowel or consonant, digit), case and all other characters kept."""
        lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
        at = [i for i, c in enumerate(lower) if c in _alphabet]
        sizes = [len(ALPHABETS[_alphabet[lower[i]]]) for i in at]
        shape = bytes(_alphabet[lower[i]] for i in at)
        x, n = 0, 1
        for i, size in zip(at, sizes):
            x, n = x * size + _value[lower[i]], n * size
        x = self.permute(x, n, tweak + b"|" + shape)
        out = list(text)
        for i, size in zip(reversed(at), reversed(sizes)):
            x, k = divmod(x, size)
            c = ALPHABETS[_alphabet[lower[i]]][k]
            out[i] = c.upper() if text[i] != lower[i] else c
        return "".join(out)

    def digits(self, text: str, tweak: bytes, keep: Callable[[str], bool] = lambda s: True) -> str:
        """Another string of as many digits for which keep says the same as for this one."""
        n, want = 10 ** len(text), keep(text)
        x = self.permute(int(text), n, tweak)
        while keep(s := f"{x:0{len(text)}d}") != want:
            x = self.permute(x, n, tweak)
        return s

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.rpartition("@")
            labels, _, top = domain.rpartition(".")
            return f"{self.letters(local, b'local')}@{self.letters(labels, b'domain')}.{top}"
        if kind == "name":
            return self._name(text)
        if kind == "iban":
            s = text.replace(" ", "")
            account = self.letters(s[4:].lower(), b"iban" + s[:2].encode()).upper()
            return poured(s[:2] + iban_check(s[:2], account) + account, text)
        digits = re.sub(r"\D", "", text)
        if kind == "card":
            body = digits[0] + self.digits(digits[1:-1], b"card" + digits[:1].encode())
            return poured(body + str(luhn(body)), text)
        if kind == "ip":
            parts = [int(x) for x in text.split(".")]
            private = parts[0] == 10 or parts[:2] == [192, 168]
            kept = 1 if parts[0] == 10 else 2 if private else 0
            x, n = int.from_bytes(bytes(parts[kept:]), "big"), 256 ** (4 - kept)
            public = lambda p: 0 < p[0] < 224 and p[0] not in (10, 127) and list(p[:2]) != [192, 168]
            while True:
                x = self.permute(x, n, b"ip%d" % kept)
                new = [*parts[:kept], *x.to_bytes(4 - kept, "big")]
                if kept or public(new) == public(parts):
                    return ".".join(map(str, new))
        if kind == "ipv6":
            # Of the address's short form; a group keeps its number of digits, so the surrogate is a short form too.
            groups = str(ipaddress.IPv6Address(text)).split(":")
            at = [i for i, g in enumerate(groups) if i and g not in ("", "0")]
            x, n = 0, 1
            for i in at:
                low, high = 16 ** (len(groups[i]) - 1), 16 ** len(groups[i])
                x, n = x * (high - low) + int(groups[i], 16) - low, n * (high - low)
            x = self.permute(x, n, f"ipv6|{groups[0]}|{[len(g) * (g != '0') for g in groups]}".encode())
            for i in reversed(at):
                low, high = 16 ** (len(groups[i]) - 1), 16 ** len(groups[i])
                x, k = divmod(x, high - low)
                groups[i] = f"{low + k:x}"
            return ":".join(groups)
        if kind == "ssn":
            return poured(self.digits(digits, b"ssn", lambda s: valid("ssn", s)), text)
        kept = digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3] if text.startswith("+") else ""
        rest = digits[len(kept) :]
        plain = len(rest) == 10 and kept in ("", "1")  # one number, with or without the country's code
        return poured(kept + self.digits(rest, b"phone" + (b"1" if plain else kept.encode()), lambda s: plain and s[0] >= "2" and s[3] >= "2" or not plain and s[0] != "0"), text)

    def given(self, word: str) -> str:
        """A known given name becomes another of its script and gender; another name keeps its ending, which tells its gender, and changes letter by letter before."""
        if word in _known:
            names = GIVEN[_known[word]]
            return names[self.permute(names.index(word), len(names), "|".join(_known[word]).encode())]
        kept = max(0, min(ENDING, len(word) - STEM))
        while True:
            word = self.letters(word[: len(word) - kept], f"given{word[len(word) - kept :]}".encode()) + word[len(word) - kept :]
            if word not in _known:
                return word

    def family(self, word: str) -> str:
        """A family name letter by letter; what stands before it, such as O' or Mc, stays."""
        lead = re.match(r"[OD]['’]|Ma?c(?=[A-Z])", word)
        start = lead.end() if lead else 0
        return word[:start] + "-".join(self.letters(w, b"family") for w in word[start:].split("-"))

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(word, its surrogate) of a name. Titles and small words stay; the first of several names is a given one."""
        words = text.split(" ")
        out = [(words[0], words[0])] if words[0].rstrip(".") in TITLES and len(words) > 1 else []
        rest = words[len(out) :]
        first = len(rest) > 1 and rest[0] not in PARTICLES
        for i, w in enumerate(rest):
            out.append((w, w if w in PARTICLES else self.given(w) if first and i == 0 else self.family(w)))
        return out

    def _name(self, text: str) -> str:
        return " ".join(new for _, new in self.parts(text))

    def replace(self, text: str) -> tuple[str, dict[str, int], int]:
        """(text with surrogates, count of each kind, collisions).

        collisions are the values whose surrogate is also an original in the text. Words of names that stand alone are
        names too.
        """
        if not _any.search(text):
            return text, {}, 0
        found = [(kind, m.start(), m[0]) for kind, m in entities(text)]
        made = [self.of(kind, old) for kind, _, old in found]
        values = {canonical(kind, old): canonical(kind, new) for (kind, _, old), new in zip(found, made)}
        collisions = sum(new in values for new in values.values())
        spans = [(start, old, new) for (_, start, old), new in zip(found, made)]
        words: dict[str, str] = {}
        for (kind, _, old), new in zip(found, made):
            if kind == "name":
                words |= {w: x for w, x in zip(old.split(" "), new.split(" ")) if w != x and w not in words and len(w) > 2}
        if words:
            alone = re.compile(rf"(?<![\w@.'’-])(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})(?![\w@-])")
            ends, i, single = [(start, start + len(old)) for start, old, _ in spans], 0, []
            for m in alone.finditer(text):
                while i < len(ends) and ends[i][1] <= m.start():
                    i += 1
                if i == len(ends) or m.end() <= ends[i][0]:
                    single.append((m.start(), m[0], words[m[0]]))
            spans = sorted(spans + single)
        out, at, count = [], 0, {}
        for kind, _, _ in found:
            count[kind] = count.get(kind, 0) + 1
        for start, old, new in spans:
            out += [text[at:start], new]
            at = start + len(old)
        out.append(text[at:])
        return "".join(out), count, collisions


def canonical(kind: str, text: str) -> str:
    """One spelling of a value, by which mentions of it are known to be the same."""
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return f"phone:{digits[1:] if text.startswith('+1') and len(digits) == 11 else digits}"
    if kind in ("card", "ssn"):
        return f"{kind}:{re.sub(r'\D', '', text)}"
    if kind == "iban":
        return f"iban:{text.replace(' ', '')}"
    if kind == "ipv6":
        return f"ip:{ipaddress.IPv6Address(text)}"
    if kind == "name":
        title, _, rest = text.partition(" ")
        return f"name:{rest if rest and title.rstrip('.') in TITLES else text}"
    return f"{kind}:{text.lower() if kind == 'email' else text}"


def poured(characters: str, form: str) -> str:
    """The characters in the places of form's letters and digits."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in form)


#: For tests and for data without a secret of its own; production passes its own key.
DEFAULT_KEY = hashlib.sha256(b"lzseq surrogate key").digest()
_by_key: dict[bytes, Surrogates] = {}


def replaced(text: Column, key: bytes = DEFAULT_KEY) -> Column:
    """struct<text, kinds, n_entities, collisions> of a text column; null stays null with no entities."""

    @F.arrow_udf("text string, kinds map<string,int>, n_entities int, collisions int")
    def run(texts: pa.Array) -> pa.Array:
        s = _by_key.setdefault(key, Surrogates(key))
        got = [s.replace(t) if t else (t, {}, 0) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([list(g[1].items()) for g in got], pa.map_(pa.string(), pa.int32())), pa.array([sum(g[1].values()) for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
            names=["text", "kinds", "n_entities", "collisions"],
        )

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text, n_entities, kinds, collisions of every document, in one pass without a shuffle.

    Null and empty texts stay and have no entities. Repeated rows repeat, with the same surrogates. Only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession)
    r = spread(docs.select("doc_id", "text")).select("doc_id", replaced(F.col("text"), key).alias("r"))
    return r.select("doc_id", "r.text", "r.n_entities", F.array_join(F.array_sort(F.map_keys("r.kinds")), ",").alias("kinds"), "r.collisions")


def anonymised(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """The documents, all columns, with surrogates in text; n_chars, where there is one, is the new length. Null and empty texts stay as they are; repeated rows repeat, with the same surrogates."""
    bounded_batches(docs.sparkSession)
    out = docs.withColumn("text", replaced(F.col("text"), key)["text"])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
