"""Document fingerprints of closed syncmers.

A k-mer of code points is a closed syncmer if the least of its s-mers stands at
its first or last place.  Whether a k-mer is chosen depends on nothing outside it,
so the same passage gives the same anchors wherever it stands.  A fingerprint is
all distinct anchors, each written as 8 hex digits, in the order in which they
first stand.  Two fingerprints are alike by the share of all their anchors that
both have, counting only anchors that match in position, that is, the longest
chain of common anchors in the same order.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.llm.shingles import mixed

#: Code points of a k-mer and of its s-mers.
K, S = 11, 4
#: Rows, and hex digits of fingerprints, that are put out at once.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 22
#: Code points that are hashed at once.
CHUNK = 1 << 17
#: Characters of a range of neighbouring documents: this, or so many times the square root of all, whatever is more.
RANGE_CHARS, RANGE_ROOTS = 1_000_000, 10
_P = np.uint64(0x9E3779B97F4A7C15)


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` places of ``x``, by doubling."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out, have, power, acc, at = x, 1, _P, None, 0
    left = n
    while left:
        if left & 1:
            if acc is None:
                acc, at = out, have
            else:
                size = len(x) - at - have + 1
                acc = acc[:size] * power + out[at : at + size]
                at += have
        left >>= 1
        if left:
            size = len(out) - have
            out = out[:size] * power + out[have : have + size]
            power = np.uint64(int(power) * int(power) & (2**64 - 1))
            have *= 2
    return mixed(acc)


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    extra = n - have
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def _anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers."""
    smers, kmers = _grams(codes, s), _grams(codes, k)
    width = k - s + 1
    least = _window_min(smers, width)
    at = np.flatnonzero((smers[: len(kmers)] == least) | (smers[width - 1 :] == least))
    return at, (kmers[at] >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, *, k: int = K, s: int = S) -> str:
    """'' for the empty text; a text without closed syncmers is one anchor of its own."""
    if not text:
        return ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = [_anchors(codes[start : start + CHUNK + k - 1], k, s)[1] for start in range(0, len(codes) - k + 1, CHUNK)]  # chunks overlap by a k-mer less one place
    hashes = np.concatenate(found) if found else np.empty(0, np.uint32)
    if not len(hashes):
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).hexdigest()
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)].astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 if just one is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f), ">u4").astype(np.uint32) for f in (a, b))
    both, at, places = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    places = places[np.argsort(at)]
    chain = len(places)
    if (np.diff(places) < 0).any():  # longest chain of common anchors in the same order
        tails: list[int] = []
        for place in places.tolist():
            i = bisect.bisect_left(tails, place)
            tails[i : i + 1] = [place]
        chain = len(tails)
    return chain / (len(x) + len(y) - len(both))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _constant(values: list, kind: str) -> Column:
    """A constant array, as one node of the plan however long it is."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_number(source: DataFrame, ranges: int) -> tuple[Column, int]:
    """Number of the range that an id lies in, from 0, and how many there are.

    Bounds are quantiles of the ids in two levels, each about the square root of the
    ranges: one list of quantiles of all ids, and one of each part between them.  An
    id is compared with two such lists instead of with every bound."""
    kind = source.schema["doc_id"].dataType.simpleString()
    parts = math.isqrt(ranges - 1) + 1
    each = -(-ranges // parts)
    quantiles = lambda n: F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)]), F.lit(max(10_000, 20 * n)))
    above = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    coarse: list = []
    if parts > 1:
        coarse = sorted(set(source.agg(quantiles(parts).alias("b")).first()["b"] or []))
    part = above(F.lit(coarse)) if coarse else F.lit(0)
    fine: list[list] = [[] for _ in range(len(coarse) + 1)]
    if each > 1:
        for r in source.where(F.col("doc_id").isNotNull()).groupBy(part.alias("part")).agg(quantiles(each).alias("b")).collect():  # one row a part
            fine[r["part"]] = sorted(set(r["b"] or []))
    starts = np.cumsum([0, *(len(x) + 1 for x in fine)]).tolist()
    number = _constant(starts, "int")[part] + above(_constant(fine, f"array<{kind}>")[part])
    return F.when(F.col("doc_id").isNull(), 0).otherwise(number).cast("int"), starts[-1]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The next document is that of the next larger id, after the last the first (a
    single document follows itself).  Ids are numbers.  Repeated ids follow one
    another in the order of their texts; null ids come first.  Null text is empty.
    Very long texts are hashed in chunks, whole.  An empty table gives no rows.
    Other columns of ``docs`` are ignored.

    Documents are dealt into ranges of ids and sorted within; the first id of each
    range is also sent to the range before, so every document meets its successor
    without any global order in one task.  Ranges and their size both grow with the
    square root of all characters: a million ranges of 100 MB stand for 100 TB.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = source.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    per_range = max(RANGE_CHARS, RANGE_ROOTS * math.isqrt(sizes["chars"]))
    number, ranges = _range_number(source, max(1, math.ceil(sizes["chars"] / per_range)))
    placed = source.withColumn("range", number)
    firsts = {r["range"]: None if r["has_null"] else r["least"] for r in placed.groupBy("range").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()}  # one row a range
    used = sorted(firsts)
    previous = dict(zip(used, [used[-1], *used[:-1]], strict=True))  # the first range's start follows the last range
    before = _constant([previous.get(r, 0) for r in range(ranges)], "int")[F.col("range")]
    is_first = F.col("doc_id").eqNullSafe(_constant([firsts.get(r) for r in range(ranges)], kind)[F.col("range")])
    copies = F.array_compact(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.when(is_first, F.struct(before.alias("at"), F.lit(True).alias("guest")))))
    dealt = placed.withColumn("copy", F.explode(copies)).select(F.col("copy.at").alias("at"), F.col("copy.guest").alias("guest"), "doc_id", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(used))
    ordered = dealt.repartition(tasks, "at").sortWithinPartitions("at", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit(doc_id, text: str, own: str, following: str, next_own: str) -> None:
            changed = edited(text, following)
            other = fingerprint(changed)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), sha, own, other, likeness(own, other), likeness(own, next_own)))

        def batch() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        last, id_type = None, pa.int64()  # last: range, id, text and fingerprint of the document before
        for rows in batches:
            id_type = rows.schema.field(2).type
            for at, guest, doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
                text = text.as_py()
                if guest and (last is None or last[0] != at):
                    continue  # a further copy of a guest that was used
                own = fingerprint(text)
                if last is not None and last[0] == at:
                    emit(last[1], last[2], last[3], text, own)
                last = None if guest else (at, doc_id, text, own)
                if len(out) >= BATCH_ROWS or sum(len(r[3]) + len(r[4]) for r in out) > BATCH_CHARS:
                    yield batch()
        if out:
            yield batch()

    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
