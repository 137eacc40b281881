"""Binary descriptors: BINARY columns, and arrays of unsigned 32-bit words (as
BIGINT) for computing.  Bit ``i`` of word ``j`` is dimension ``32 * j + i``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 32


def words_of_binary(key: Column, n_bytes: int) -> Column:
    """Words of a BINARY column of ``n_bytes``, any width; the last word may be short."""
    step = WORD_BITS // 8
    parts = [F.conv(F.hex(F.substring(key, at + 1, step)), 16, 10).cast("long") for at in range(0, n_bytes, step)]
    return F.array(*parts)


def hamming_words(a: Column, b: Column, n_words: int | None = None) -> Column:
    """Number of different bits (BIGINT) of two word arrays."""
    if n_words:
        bits = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n_words)]
        return reduce(lambda s, x: s + x, bits).cast("long")
    both = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x)


def checked_words(key: Column, n_bytes: int) -> Column:
    """:func:`words_of_binary`; raises where a width differs."""
    wrong = F.raise_error(F.lit(f"descriptor width is not {n_bytes} bytes")).cast("array<bigint>")
    return F.when(F.octet_length(key) == n_bytes, words_of_binary(key, n_bytes)).otherwise(wrong)


def dist_hamming(a: Column, b: Column, n_bytes: int) -> Column:
    """Bit distance of two BINARY columns; raises where a width differs."""
    fine = (F.octet_length(a) == n_bytes) & (F.octet_length(b) == n_bytes)
    bits = hamming_words(words_of_binary(a, n_bytes), words_of_binary(b, n_bytes), -(-n_bytes // 4))
    return F.when(fine, bits).otherwise(F.raise_error(F.lit(f"descriptor width is not {n_bytes} bytes")).cast("long"))


def sign_words(vec: Column, dim: int, center: list[float] | None = None) -> Column:
    """One bit a dimension: set where the component (less ``center``) is above 0."""
    words = []
    for at in range(0, dim, WORD_BITS):
        bits = []
        for i in range(at, min(dim, at + WORD_BITS)):
            x = vec[i].cast("double") - F.lit(center[i]) if center else vec[i].cast("double")
            bits.append(F.when(x > 0, F.lit(1 << (i - at))).otherwise(F.lit(0)).cast("long"))
        words.append(reduce(lambda s, x: s + x, bits))
    return F.array(*words)


def substring_of_words(words: Column, t: int, bits: int) -> Column:
    """The ``t``-th run of ``bits`` bits of a descriptor (``bits`` divides 32 or is 32 or 64)."""
    if bits > WORD_BITS:
        per = bits // WORD_BITS
        parts = [F.shiftleft(words[t * per + k], 32 * k) for k in range(per)]
        return reduce(lambda s, x: s.bitwiseOR(x), parts)
    per = WORD_BITS // bits
    return F.shiftright(words[t // per], (t % per) * bits).bitwiseAND(F.lit((1 << bits) - 1))
