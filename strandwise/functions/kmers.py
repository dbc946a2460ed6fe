"""Column expressions over bases, k-mers and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K_MIN, K_MAX, K_DEFAULT = 2, 32, 21


def clamp_k(k: int) -> int:
    return max(K_MIN, min(K_MAX, k))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal(bases: Column | str, n_as_a: bool = False) -> Column:
    """Upper case; letters other than ACGTN count as A, and N too with n_as_a."""
    return F.regexp_replace(F.upper(col(bases)), "[^ACGT]" if n_as_a else "[^ACGTN]", "A")


def complement(kmer: Column | str) -> Column:
    return F.translate(col(kmer), "ACGT", "TGCA")


def revcomp(kmer: Column | str) -> Column:
    return F.translate(F.reverse(col(kmer)), "ACGT", "TGCA")


def canonical(kmer: Column | str) -> Column:
    """The lexically smaller of a k-mer and its reverse complement; ACGT order is unsigned order of packed values."""
    return F.least(col(kmer), revcomp(kmer))


def roll_right(kmer: Column | str, base: Column) -> Column:
    return F.concat(F.substr(col(kmer), F.lit(2)), base)


def roll_left(kmer: Column | str, base: Column) -> Column:
    return F.concat(base, F.substr(col(kmer), F.lit(1), F.length(col(kmer)) - 1))


def base_at(kmer: Column | str, i: Column) -> Column:
    return F.substr(col(kmer), i + 1, F.lit(1))


def with_base(kmer: Column | str, i: Column, base: Column) -> Column:
    return F.overlay(col(kmer), base, i + 1, F.lit(1))


def pack(kmer: Column | str) -> Column:
    """Right-aligned 2-bit packing as BIGINT, for k up to 31; other letters count as A."""
    digits = F.translate(normal(kmer, n_as_a=True), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("bigint")


def pack_left(kmer: Column | str, clean: bool = False) -> Column:
    """Left-aligned 2-bit packing in a signed BIGINT, base i at bit 62 - 2i, for k up to 32; clean: there are but A, C, G and T."""
    k = F.length(col(kmer))
    digits = F.translate(col(kmer) if clean else normal(kmer, n_as_a=True), "ACGT", "0123")
    value = F.conv(digits, 4, 10)
    return F.when(k < 32, F.call_function("shiftleft", value.cast("bigint"), 64 - 2 * k)).otherwise(_signed(value.cast("decimal(20,0)")))


def _signed(unsigned: Column) -> Column:
    top = F.lit(str(2**63)).cast("decimal(20,0)")
    whole = F.lit(str(2**64)).cast("decimal(20,0)")
    return F.when(unsigned >= top, unsigned - whole).otherwise(unsigned).cast("bigint")


def unpack(packed: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(col(packed).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def unpack_left(packed: Column | str, k: int) -> Column:
    unsigned = F.when(col(packed) < 0, col(packed).cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(col(packed).cast("decimal(20,0)"))
    return F.substr(F.translate(F.lpad(F.conv(unsigned.cast("string"), 10, 4), 32, "0"), "0123", "ACGT"), F.lit(1), F.lit(k))


def hashed(packed: Column | str) -> Column:
    """A 64-bit mix of a packed k-mer."""
    return F.xxhash64(col(packed))


def count_ns(bases: Column | str) -> Column:
    return (F.length(col(bases)) - F.length(F.translate(col(bases), "Nn", ""))).cast("bigint")


def replace_ns(bases: Column | str, base: str = "A") -> Column:
    return F.translate(col(bases), "Nn", base * 2)


def gc(bases: Column | str) -> Column:
    return (F.length(col(bases)) - F.length(F.translate(col(bases), "GCgc", ""))).cast("bigint")


def error_probability(quality: Column | str, offset: int = 33) -> Column:
    return F.pow(F.lit(10.0), -(F.ascii(col(quality)) - offset) / 10.0)


def window_positions(bases: Column | str, k: int) -> Column:
    """0 .. length - k, empty for shorter reads."""
    n = F.length(col(bases))
    return F.when(n >= k, F.sequence(F.lit(0).cast("bigint"), (n - k).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fastq_text(name: Column | str, bases: Column | str, quals: Column | str) -> Column:
    return F.concat(col(name), F.lit("\n"), col(bases), F.lit("\n+\n"), col(quals))


def leads(kmer: Column | str) -> Column:
    """Whether a k-mer comes before its reverse complement, compared by groups of four bases, in each of which the last base weighs most."""
    groups = lambda x: F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 4).cast("int")), lambda g: F.reverse(F.rpad(F.substr(x, g * 4 + 1, F.lit(4)), 4, "A"))))
    return groups(col(kmer)) < groups(revcomp(kmer))


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mixed(value: Column | str) -> Column:
    """The 64-bit finaliser of MurmurHash3: xor-shifts and two multiplications that wrap around."""
    # fixed values: the shift and the factors of the published finaliser
    shift, first, second = 33, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
    fold = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    x = once(once(col(value).cast("bigint"), fold), lambda x: _times(x, first))
    return once(once(once(x, fold), lambda y: _times(y, second)), fold)


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^64, in decimals, since a product that wraps raises in ANSI mode."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    a, b = x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).cast("decimal(10,0)"), F.shiftrightunsigned(x, 32).cast("decimal(10,0)")
    part = lambda y, c: y * F.lit(str(c)).cast("decimal(10,0)")
    upper = ((part(a, high) + part(b, low)) % number(1 << 32)).cast("decimal(10,0)") * F.lit(str(1 << 32)).cast("decimal(10,0)")
    total = (part(a, low) + upper) % F.lit(str(1 << 64)).cast("decimal(21,0)")
    return once(total.cast("decimal(21,0)"), _signed)


def folded(packed: Column | str) -> Column:
    """The upper and lower 32 bits of a 64-bit value, xored into an INT."""
    x = col(packed)
    low = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def ceil_div(a: Column | str, b: Column | str) -> Column:
    """a / b, rounded up, for integers of which b is above 0."""
    return F.ceil(col(a) / col(b)).cast("bigint")


def mebibytes(size: Column | str) -> Column:
    return col(size).cast("double") / float(1 << 20)


#: Scalar helpers by the name under which register() makes them known to SQL: (arguments, result type, expression).
HELPERS = {
    "kmer_revcomp": ("s STRING", "STRING", "translate(reverse(s), 'ACGT', 'TGCA')"),
    "kmer_canonical": ("s STRING", "STRING", "least(s, translate(reverse(s), 'ACGT', 'TGCA'))"),
    "kmer_pack": ("s STRING", "BIGINT", "cast(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT)"),
    "phred_error": ("q STRING", "DOUBLE", "pow(10.0D, -(ascii(q) - 33) / 10.0D)"),
}


def register(spark) -> list[str]:
    """Make HELPERS functions of the session's SQL; Catalyst puts their bodies in place of the calls."""
    for name, (arguments, result, body) in HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(HELPERS)
