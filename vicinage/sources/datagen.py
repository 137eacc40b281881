"""Synthetic vectors, made in the JVM.  Every number is a function of its seed, row and
dimension by way of digests, so any engine with SHA-256 and MD5 makes the same ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1): the first 32 bits of the MD5 of the parts, joined by ``/``."""
    return _number(F.md5(_name(*parts)), 1, 8) / float(1 << 32)


def normal(*parts: Column | str | int) -> Column:
    """About normal, of mean 0 and variance 1: the 16 words of 16 bits of a SHA-256,
    summed up and scaled (their sum is exact)."""
    digest = F.sha2(_name(*parts), 256)
    total = reduce(lambda a, b: a + b, [_number(digest, 4 * i + 1, 4) for i in range(16)])
    return (total / 65536.0 - 16 * 65535 / 131072.0) * (12 / 16) ** 0.5


def _name(*parts: Column | str | int) -> Column:
    return F.concat_ws("/", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]).cast("binary")


def _number(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def gaussian_clusters(spark: SparkSession, n: int, dim: int, n_clusters: int, *, kind: str = "float", spread: float | None = None, noise: float | None = None, seed: int = 42) -> DataFrame:
    """``id, cell, vec``: normal noise around centres that are uniform.

    ``float``: centres within +-``spread`` (10,000), ``vec array<float>``.  ``uint8``:
    centres within 0 to ``spread`` (255), rounded down and wrapped to a byte, ``vec
    array<int>``.  The noise's deviation is ``noise``; where that is not given, 1 for
    bytes and for floats uniform between 1 and 10 by cluster and dimension.  Centres
    and deviations follow from digests, so no table of them is needed; id ``i`` is of
    cluster ``i mod n_clusters``."""
    if kind not in ("float", "uint8"):
        raise ValueError(f"unknown kind: {kind!r}; 'float' or 'uint8'")
    spread = (10_000.0 if kind == "float" else 255.0) if spread is None else spread
    rows = spark.range(n).withColumn("cell", (F.col("id") % n_clusters).cast("int"))

    def component(i: int) -> Column:
        width = F.lit(noise if noise is not None else 1.0) if noise is not None or kind == "uint8" else 1.0 + 9.0 * unit(seed, "width", F.col("cell"), i)
        centre = unit(seed, "centre", F.col("cell"), i)
        value = (centre * 2 - 1 if kind == "float" else centre) * spread + normal(seed, F.col("id"), i) * width
        return value.cast("float") if kind == "float" else F.pmod(F.floor(value), F.lit(256)).cast("int")

    return rows.select("id", "cell", F.array(*[component(i) for i in range(dim)]).alias("vec"))


def flip_bits(words: DataFrame, n_words: int, flips: int, *, column: str = "vec", id_col: str = "id") -> DataFrame:
    """Near copies of descriptors: ``flips`` different bits, chosen by the id, are turned.

    Bit ``i`` of ``flips`` is place ``(17 * id + 13 * i) mod bits`` (13 is coprime to every power of two)."""
    bits = 32 * n_words
    out = []
    for j in range(n_words):
        word = F.col(column)[j]
        for i in range(flips):
            place = F.pmod(F.col(id_col) * 17 + 13 * i, F.lit(bits))
            here = F.floor(place / 32) == j
            word = word.bitwiseXOR(F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return words.withColumn(column, F.array(*out))
