"""Column functions: sequence clean-up, names and keys, formats, CIGAR, record text. All stay inside the JVM but those that keep some letters of a text: there a table of bytes is many times faster than a pattern."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters to the four bases, A to A, B to C and so on around.
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def _kept(text: Column, keep: str, table: bytes | None = None) -> Column:
    """The ASCII characters of a text that are in keep, by a table of what each byte becomes. No byte of another character is one of ASCII."""
    others = bytes(sorted(set(range(256)) - set(keep.encode())))

    @F.arrow_udf("string")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.translate(table, others) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())

    return kept(text)


def as_bases(text: Column) -> Column:
    """The ASCII letters of a text as bases."""
    return _kept(text, string.ascii_letters, bytes.maketrans(string.ascii_letters.encode(), (BASES + BASES).encode()))


def letters_and_breaks(text: Column) -> Column:
    """The ASCII letters and line feeds of a text."""
    return _kept(text, string.ascii_letters + "\n")


def ungapped(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(""))


def letters_only(text: Column) -> Column:
    """A strict FASTA sequence: other characters than letters go."""
    return F.regexp_replace(text, "[^A-Za-z]", "")


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S+)", 1)


def taxon(header: Column) -> Column:
    """The group name in a header of words: the second and third, or what there is; letters and digits only."""
    words = F.split(header, " ")
    clean = lambda i: F.regexp_replace(F.coalesce(F.get(words, F.lit(i)), F.lit("")), "[^A-Za-z0-9]", "")
    return F.when(F.size(words) >= 3, F.concat(clean(1), clean(2))).when(F.size(words) == 2, clean(1)).otherwise(clean(0))


def chromosome(header: Column) -> Column:
    """chr and what follows "chromosome" up to a comma; empty without that word."""
    low = F.lower(header)
    rest = F.regexp_replace(F.split_part(F.split_part(low, F.lit("chromosome"), F.lit(2)), F.lit(","), F.lit(1)), "[^a-z0-9]", "")
    return F.when(F.contains(low, F.lit("chromosome")), F.concat(F.lit("chr"), rest)).otherwise("")


def group_key(header: Column, most: int = 200) -> Column:
    """taxon_chromosome, at most so many characters."""
    return F.left(F.concat(taxon(header), F.lit("_"), chromosome(header)), F.lit(most))


def is_complete(header: Column) -> Column:
    return F.contains(F.lower(header), F.lit("complete genome"))


def file_safe(name: Column) -> Column:
    """A name without spaces and colons."""
    return F.translate(name, " :", "")


def padded(number: Column, width: int) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number)


def low_32_bits(number: Column) -> Column:
    return number.bitwiseAND(F.lit(4294967295).cast("bigint"))


def cigar_sum(cigar: Column, kinds: str) -> Column:
    """Sum of the lengths of a CIGAR's operations of these kinds; 0 for *."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(f"(\\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))


def cigar_aligned(cigar: Column) -> Column:
    return cigar_sum(cigar, "MIX=")


def cigar_clipped(cigar: Column) -> Column:
    return cigar_sum(cigar, "S")


def unmapped_record(name: Column) -> Column:
    """The SAM line of a read that is nowhere."""
    return F.concat(name, F.lit("\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"))


def is_unmapped(flag: Column) -> Column:
    """Exactly 4, as a primary hit that is nowhere; see mapped() for the bit."""
    return flag == 4


def mapped(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(4)) == 0


def hamming(a: Column, b: Column) -> Column:
    """Places where two texts of one length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def reverse_complement(seq: Column) -> Column:
    """The other strand; what isn't a base stays."""
    return F.reverse(F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa"))


def without_zeros(text: Column) -> Column:
    """The text; raises where it has a zero character, which parses and kernels can't tell from an end."""
    return F.when(F.contains(text, F.lit("\0")), F.raise_error(F.lit("a text has a zero character"))).otherwise(text)


def is_newline(symbol: Column) -> Column:
    return symbol.isin("\n", "\r")


def is_aligner_kernel(kind: Column) -> Column:
    """Whether reads are aligned in a kernel of this kind, so that it is written as FASTA; exact kernels are plain texts."""
    return F.upper(kind).isin("BLAST", "BOWTIE2", "BWA")


def first_places(text: Column, symbols: str) -> Column:
    """map of each of the symbols that the text has to its first place."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), (F.locate(c, text) - 1).alias("value")) for c in symbols))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] >= 0))


def base_name(path: Column) -> Column:
    """A file's name without folders and its ending, by which files of one collection are paired."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
