"""Multi-index hashing for Hamming search.

Each descriptor is cut into ``m`` substrings; a row within ``radius`` of a query
agrees with it to within ``radius // m`` bits in some substring.  Candidates come
from an equi-join of the substrings' neighbour keys with the postings, or, where
there are too many neighbour keys, from the equivalent bit-count predicate.
Candidates are verified in full and ranked; ``radius`` only bounds where they are
looked for and does not filter what is found.  ``fit`` writes rows and postings once.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.binary import WORD_BITS, hamming_words, substring_of_words
from vicinage.operators.exact import check_k, smaller_broadcast, top_k
from vicinage.sources.staging import Staged
from vicinage.sources.storage import load_table, save_table

#: Neighbour keys a substring up to which they are enumerated and joined.
MOST_MASKS = 4096


def masks(bits: int, flips: int) -> list[int]:
    """XOR masks of all patterns of at most ``flips`` bits, as signed 64-bit numbers."""
    out = []
    for r in range(min(flips, bits) + 1):
        for at in itertools.combinations(range(bits), r):
            m = sum(1 << i for i in at)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def n_masks(bits: int, flips: int) -> int:
    return sum(math.comb(bits, r) for r in range(min(flips, bits) + 1))


@dataclass
class MIHIndex:
    m: int = 8
    n_words: int = 0
    rows: DataFrame | None = field(default=None, repr=False)
    postings: DataFrame | None = field(default=None, repr=False)

    def fit(self, data: DataFrame, n_words: int) -> MIHIndex:
        """``id, vec`` of ``n_words`` 32-bit words; raises where ``m`` does not cut
        the descriptor into equal substrings of whole bytes, at most 8 of them."""
        n_bytes = 4 * n_words
        if n_bytes < self.m or n_bytes % self.m or n_bytes // self.m > 8:
            raise ValueError(f"m={self.m} does not cut {n_bytes} bytes into equal parts of at most 8 bytes")
        if (8 * n_bytes // self.m) > WORD_BITS and (8 * n_bytes // self.m) != 64 or (8 * n_bytes // self.m) == 24:
            raise ValueError("substrings must be 8, 16, 32 or 64 bits wide")
        self.n_words = n_words
        self.rows = Staged(data.select("id", "vec"), "mih-rows").df
        self.postings = Staged(self._sorted(self._keys(self.rows, "vec").select("id", "t", "key")), "mih-postings").df
        return self

    def _sorted(self, postings: DataFrame) -> DataFrame:
        """Postings with equal keys lie together, in files sorted by key."""
        return postings.repartition("t", "key").sortWithinPartitions("t", "key")

    def save(self, path: str) -> None:
        if self.rows is None:
            raise RuntimeError("index is not built")
        meta = {"kind": "mih", "m": self.m, "n_words": self.n_words}
        save_table(self.rows, f"{path}/vectors", meta=meta)
        save_table(self._sorted(self.postings), f"{path}/postings", meta=meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MIHIndex:
        rows, meta = load_table(spark, f"{path}/vectors", kind="mih")
        return cls(meta["m"], meta["n_words"], rows, load_table(spark, f"{path}/postings", kind="mih")[0])

    @property
    def bits(self) -> int:
        return WORD_BITS * self.n_words // self.m

    def _keys(self, df: DataFrame, column: str) -> DataFrame:
        keys = F.array(*[substring_of_words(F.col(column), t, self.bits) for t in range(self.m)])
        return df.select("*", F.posexplode(keys).alias("t", "key"))

    def candidates(self, queries: DataFrame, radius: int = 8, *, plan: str | None = None) -> DataFrame:
        """Distinct ``qid, id``.  ``plan``: ``masks`` or ``bits``; by size if not given."""
        flips = radius // self.m
        plan = plan or ("masks" if n_masks(self.bits, flips) <= MOST_MASKS else "bits")
        asked = self._keys(queries.select("qid", "q"), "q").select("qid", "t", "key")
        if plan == "masks":
            patterns = F.lit(masks(self.bits, flips))
            probes = asked.select("qid", "t", F.explode(F.transform(patterns, lambda x: x.cast("long").bitwiseXOR(F.col("key")))).alias("key"))
            hits = probes.join(self.postings, ["t", "key"])
        else:
            asked = asked.withColumnRenamed("key", "qkey")
            near = F.bit_count(F.col("key").bitwiseXOR(F.col("qkey"))) <= flips
            hits = self.postings.join(smaller_broadcast(asked, 2).withColumnRenamed("t", "qt"), (F.col("t") == F.col("qt")) & near)
        return hits.select("qid", "id").distinct()

    def search(self, queries: DataFrame, k: int, radius: int = 8, *, plan: str | None = None) -> DataFrame:
        check_k(k)
        if self.rows is None:
            raise RuntimeError("index is not built")
        found = self.candidates(queries, radius, plan=plan)
        full = found.join(self.rows, "id").join(smaller_broadcast(queries.select("qid", "q"), self.n_words), "qid")
        return top_k(full.select("qid", "id", hamming_words(F.col("q"), F.col("vec"), self.n_words).alias("distance")), k)

    @property
    def nbytes(self) -> int:
        return 4 * self.n_words

    @property
    def n(self) -> int:
        return 0 if self.rows is None else self.rows.count()
