"""Column expressions on bases and tokens: alphabets, complements, packing and the invertible integer hash.

Everything here is built-in Spark functions. Additions stay below 2^63 under a mask, so they are safe in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 6 + "AC"
#: Folding of ambiguity codes to one base each.
AMBIGUOUS, FOLDED = "URYKMSWBDHV", "TTGGAGAACGT"


def dna_of(text: Column) -> Column:
    """Prose as bases: letters fold onto ACGT in turn, the full stop stays as a break, all else goes."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), LETTERS, BASES), "[^ACGT.]", "")


def upper_bases(token: Column) -> Column:
    return F.translate(F.upper(token), "U", "T")


def is_genomic(token: Column) -> Column:
    return token.rlike("^[ACGTUacgtu]+$")


def is_strict(token: Column) -> Column:
    return token.rlike("^[ACGTacgt]+$")


def genomic_prefix_length(token: Column) -> Column:
    return F.length(F.regexp_extract(token, "^[ACGTUacgtu]*", 0))


def fold_ambiguous(token: Column) -> Column:
    return F.translate(token, AMBIGUOUS, FOLDED)


def reverse_complement(token: Column) -> Column:
    return F.reverse(F.translate(token, "ACGT", "TGCA"))


def canonical(token: Column) -> Column:
    """The smaller, as text, of a token and its reverse complement."""
    return F.least(token, reverse_complement(token))


def code(token: Column) -> Column:
    """Two bits a base, the first base highest; up to 31 bases."""
    return F.conv(F.translate(F.upper(token), "ACGTU", "01233"), 4, 10).cast("long")


def key_bytes(length: int) -> int:
    """Bytes of a packed key: four bases a byte."""
    return (2 * length + 7) // 8


def pack(token: Column, length: int) -> Column:
    """The packed key as an integer: the code moved to the high end of its bytes; up to 31 bases."""
    return F.shiftleft(code(token), 2 * (4 * key_bytes(length) - length))


def unpack(key: Column, length: int) -> Column:
    bits = 2 * (4 * key_bytes(length) - length)
    return F.translate(F.lpad(F.conv(F.shiftrightunsigned(key, bits).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def _word_bases(length: int) -> list[int]:
    """Bases in each word of a packed key, with those that fill its last byte: 32 in all words but the first."""
    whole = 4 * key_bytes(length)
    later = (whole - 1) // 32
    return [whole - 32 * later, *[32] * later]


def pack_words(token: Column, length: int) -> list[Column]:
    """``pack`` for any length: a long for each eight bytes of the key, the first the highest."""
    digits = F.rpad(F.translate(F.upper(token), "ACGTU", "01233"), 4 * key_bytes(length), "0")
    out, at = [], 1
    for n in _word_bases(length):
        out.append(F.conv(F.substring(digits, at, n), 4, -10).cast("long"))
        at += n
    return out


def unpack_words(words: list[Column], length: int) -> Column:
    parts = (F.lpad(F.conv(F.hex(w), 16, 4), n, "0") for w, n in zip(words, _word_bases(length), strict=True))
    return F.translate(F.substring(F.concat(*parts), 1, length), "0123", "ACGT")


def spelled(code_: Column, length: int) -> Column:
    """The bases of a code of ``code``."""
    return F.translate(F.lpad(F.conv(code_.cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def packed_hex(token: Column, length: int) -> Column:
    return F.lpad(F.lower(F.hex(pack(token, length))), 2 * key_bytes(length), "0")


def mix64(x: Column, bases: int, seed: int = 42) -> Column:
    """A bijection of integers of 2 * ``bases`` bits (up to 31 bases): equal hashes mean equal codes."""
    if not 1 <= bases <= 31:
        raise ValueError("1 to 31 bases")
    mask = (1 << 2 * bases) - 1
    m = F.lit(mask)

    def shifted(c: Column, n: int) -> Column:
        return F.shiftleft(c, n).bitwiseAND(m)

    def plus(a: Column, b: Column) -> Column:
        return (a + b).bitwiseAND(m)

    steps = (
        lambda x: plus(F.bitwise_not(x).bitwiseAND(m), shifted(x, 21)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 24)),
        lambda x: plus(plus(x, shifted(x, 3)), shifted(x, 8)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)),
        lambda x: plus(plus(x, shifted(x, 2)), shifted(x, 4)),
        lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 28)),
        lambda x: plus(x, shifted(x, 31)),
    )
    # Each step uses its input several times, so it is bound as the variable of a function over one element: the expression grows by steps, not by powers.
    bound = F.array(plus(x, F.lit(seed & mask)))
    for step in steps:
        bound = F.transform(bound, step)
    return F.element_at(bound, 1)


def canonical_code(token: Column) -> Column:
    """The smaller code of a token and its reverse complement, of which only the text that sorts first is packed."""
    return code(canonical(upper_bases(token)))


def hash_of(token: Column, bases: int, seed: int = 42) -> Column:
    """The integer hash of a token or its reverse complement, whichever code is smaller."""
    return mix64(canonical_code(token), bases, seed)


def minimizer_offset(token: Column, k: int, m: int, seed: int = 42) -> Column:
    """Offset, from 0, of the leftmost m-mer of the smallest hash in a token of k bases."""
    hashes = F.transform(F.sequence(F.lit(1), F.lit(k - m + 1)), lambda i: hash_of(token.substr(i, F.lit(m)), m, seed))
    return F.array_position(hashes, F.array_min(hashes)) - 1


def minimizer_and_rest(token: Column, m: int, hasher: Callable[[Column], Column]) -> Column:
    """struct<minimizer, rest>: the leftmost m-mer of the smallest hash, and the token with a bar in its place; null if the token is shorter than m."""
    hashes = F.transform(F.sequence(F.lit(1), F.length(token) - m + 1), lambda i: hasher(token.substr(i, F.lit(m))))
    # Bound as a variable, so that the hashes are taken once.
    at = F.transform(F.array(hashes), lambda h: F.array_position(h, F.array_min(h)).cast("int"))
    found = F.transform(at, lambda i: F.struct(token.substr(i, F.lit(m)).alias("minimizer"), F.concat(token.substr(F.lit(1), i - 1), F.lit("|"), token.substr(i + m, F.length(token))).alias("rest")))
    return F.when(F.length(token) >= m, F.element_at(found, 1))


def stays_syncmer(token: Column, k: int, m: int, seed: int = 42) -> Column:
    """Whether the leftmost smallest m-mer of a token is its first or its last."""
    at = minimizer_offset(token, k, m, seed)
    return (at == 0) | (at == k - m)


def mutation_rate(j: Column, k: int) -> Column:
    """The rate of point mutations at which k-mer sets have similarity j."""
    return F.when(j == 0, F.lit(1.0)).otherwise(-F.log(2 * j / (1 + j)) / k)


def human_number(x: Column) -> Column:
    """With a suffix K, M, G or T."""
    out = F.format_string("%.1f", x.cast("double"))
    for power, suffix in ((3, "K"), (6, "M"), (9, "G"), (12, "T")):
        out = F.when(F.abs(x) >= 10**power, F.format_string(f"%.1f{suffix}", x / 10**power)).otherwise(out)
    return out


def time_magnitude(ns: Column) -> Column:
    """0 to 3 for nanoseconds to seconds: how often a time can be divided by 1000 before it is at most 1000."""
    x = ns.cast("double")
    return F.when(x > 1e6 * 1000, 3).when(x > 1e3 * 1000, 2).when(x > 1000, 1).otherwise(0)


def number(x: Column) -> Column:
    """A double where the text is a number, else null."""
    return x.try_cast("double")


def file_stem(path: Column) -> Column:
    """The last part of a path without its sequence-file suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(fa|fasta|fna|fq|fastq|fnq)?(\.gz)?$", "")
