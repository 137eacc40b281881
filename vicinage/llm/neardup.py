"""Near-duplicate detection by banded MinHash with odd sketches.

1. One pass over the texts gives every document its shingle set's key, MinHash
   bands and an odd sketch: each MinHash sample flips one bit of a bitmap, so the
   XOR of two bitmaps counts the samples in which two documents differ.
2. Documents with equal sets become one vertex.
3. Vertices that share a band meet in a bucket.  A bucket links its members to a
   centre (another one in each band), never all pairs.  The popcount of the XOR of
   the sketches drops pairs that are far below the threshold; the rest are
   confirmed on the full shingle sets.
4. Connected components of the confirmed links.
5. Buckets whose members still lie in different components are compared member by
   member, in blocks, by sketch.  What may reach the threshold forms clusters, and
   these are compared on full sets, again in blocks.  Both steps hand on spanning
   links only, so rows stay in proportion to members.  After this every pair that
   shares a band is in one component or has been compared.

At the default of 42 bands of 6 rows a pair at a similarity of 0.8 shares no band
with a probability of 3e-6, one at 0.85 of 1e-9; the sketch filter keeps five
standard deviations below the threshold.

Skew: equal texts collapse in a map-side aggregate; the joins on a bucket or a centre
are plain equi-joins, which adaptive execution splits when one key is hot; new names
of components are broadcast as long as they are few, and beyond that those of the
components that many rows have.  Blocks of a hot bucket are dealt to many tasks, and
of two blocks that lie in the bucket's largest component no pair is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.llm.common import Staged
from vicinage.llm.shingles import batched, mixed, shingles, texts, word_hashes

ROWS, BANDS, SKETCH_BITS = 6, 42, 1024
#: Members of a block when a bucket is compared member by member.
BLOCK = 256
#: Up to so many ids, the ids whose sets are needed are broadcast (16 MB); beyond, joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of one name that make it hot.
HOT_ROWS = 1_000_000

_rng = np.random.default_rng(41)
_A = _rng.integers(1, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row a set; no set may be empty."""
    flat = np.concatenate(sets)
    flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), ROWS * BANDS), np.uint32)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, rows of ``sig`` by bands."""
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
        keys[:, b] = key
    return keys


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples: ``uint8[len(sig), SKETCH_BITS / 8]``."""
    slots = mixed(sig.astype(np.uint64) + (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    counts = np.zeros((len(sig), SKETCH_BITS), np.uint8)
    np.add.at(counts, (np.arange(len(sig))[:, None], slots.astype(np.int64)), 1)
    return np.packbits(counts & 1, axis=1)


def sketch_similarity(odd: np.ndarray | float) -> np.ndarray:
    """Jaccard similarity that an XOR population count stands for."""
    part = np.clip(1 - 2 * np.asarray(odd, float) / SKETCH_BITS, 1e-9, 1)
    differing = -SKETCH_BITS / 2 * np.log(part)
    return 1 - differing / (2 * ROWS * BANDS)


def most_odd_bits(threshold: float, deviations: float = 5.0) -> int:
    """XOR population count that a pair at ``threshold`` exceeds only by more
    than ``deviations`` standard deviations (of the samples and the bitmap)."""
    samples = ROWS * BANDS
    differing = 2 * samples * (1 - threshold)
    mean = SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS))
    slope = np.exp(-2 * differing / SKETCH_BITS)
    spread = np.sqrt((slope * 2) ** 2 * samples * threshold * (1 - threshold) + mean * (1 - 2 * mean / SKETCH_BITS) + 1)
    return int(min(SKETCH_BITS / 2, mean + deviations * spread))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``doc_id, n_shingles, key, bands, sketch``; the last three null without shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_shingles", "key", "bands", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for some in batched(texts(rows), lambda r: len(r[1]), 1 << 19):
                sets = [np.unique(shingles(word_hashes(t), width)) for _, t in some]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, bands, sketches = [None] * len(some), [None] * len(some), [None] * len(some)
                if full:
                    sig = signature([sets[k] for k in full])
                    for k, b, o in zip(full, band_keys(sig).view(np.int64), odd_sketch(sig), strict=True):
                        keys[k], bands[k], sketches[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), b, o.tobytes()
                columns = [pa.array([i for i, _ in some], rows.schema.field(0).type), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles long, key binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``v, items``: the sorted shingle hashes of a text as bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for some in batched(texts(rows), lambda r: len(r[1]), 1 << 20):
                items = [np.unique(shingles(word_hashes(t), width)).tobytes() for _, t in some]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], rows.schema.field(0).type), pa.array(items, pa.binary())], names=["v", "items"])

    return docs.select(F.col(id_col).alias("v"), F.col(text_col).alias("text")).mapInArrow(run, f"v {kind}, items binary")


def _odd_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int64")
    xor = np.bitwise_xor(np.frombuffer(b"".join(a), np.uint8), np.frombuffer(b"".join(b), np.uint8))
    return pd.Series(np.bitwise_count(xor.reshape(len(a), -1)).sum(axis=1).astype("int64"))


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    one = lambda x, y: len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _renamed(rows: DataFrame, key: str, names: DataFrame, n_names: int) -> DataFrame:
    """``rows`` joined with ``names`` (``key``, one row each), inner.  Few names are
    broadcast; of more, those that at least ``HOT_ROWS`` rows ask for are, so that
    no task gets all rows of one name."""
    if n_names <= BROADCAST_IDS:
        return rows.join(F.broadcast(names), key)
    hot = Staged(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= HOT_ROWS).select(key), "hot").df
    n = hot.count()
    if not n or n > BROADCAST_IDS:
        return rows.join(names, key)
    hot_rows, other_rows = rows.join(F.broadcast(hot), key, "left_semi"), rows.join(F.broadcast(hot), key, "left_anti")
    return hot_rows.join(F.broadcast(names.join(F.broadcast(hot), key, "left_semi")), key).unionByName(other_rows.join(names, key))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, c``: the smallest vertex that each vertex reaches.

    By contraction: every vertex takes its smallest neighbour (or itself), then
    that one's; the edges are renamed and those within a name vanish.  Stars, the
    common case, are done after one round, so edges are joined about once.  The
    smallest vertex of a component keeps its name throughout.  Rounds are written
    tables, dropped as soon as the next one is written."""
    left = Staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    names = Staged(vertices.select("v", F.col("v").alias("c")), "names")
    while not left.df.isEmpty():
        both = left.df.select("u", "v").union(left.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = Staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("p")), "near")
        n = near.df.count()
        named = Staged(_renamed(near.df, "p", near.df.select(F.col("v").alias("p"), F.col("p").alias("c")), n).select("v", "c"), "names")
        # names that change; a vertex whose name none of the edges has keeps it
        moved = named.df.where("v <> c").select(F.col("v").alias("c"), F.col("c").alias("next"))
        n_moved = moved.count()
        if n_moved <= BROADCAST_IDS:
            later = names.df.join(F.broadcast(moved), "c", "left").select("v", F.coalesce("next", "c").alias("c"))
        else:
            changed = _renamed(names.df, "c", moved, n_moved).select("v", F.col("next").alias("c"))
            later = names.df.join(moved.select("c"), "c", "left_anti").select("v", "c").unionByName(changed)
        after_names = Staged(later, "names")
        renamed = _renamed(_renamed(left.df, "u", named.df.select(F.col("v").alias("u"), F.col("c").alias("cu")), n), "v", named.df.select("v", F.col("c").alias("cv")), n)
        after = Staged(renamed.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), "edges")
        for done in (left, near, named, names):
            done.drop()
        left, names = after, after_names
    return names.df


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where ``100 * |A & B| >= percent * |A | B|`` on their
    sets of ``width``-word shingles; ``component_id`` is the smallest id that
    links reach, ``kept`` marks the document that has it.  Null and empty texts
    and texts without words have no shingles and no links.  Rows that share an
    id count as one document with all their links; a null id has no links and is
    kept.  Repeated rows give repeated results.  An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    most_odd = most_odd_bits(percent / 100)
    seen = Staged(signatures(docs, id_col, text_col, width), "signatures")
    # equal sets: one vertex, named by its smallest id; what hangs on the set is equal too
    nodes = Staged(
        seen.df.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("v"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    member = nodes.df.select("v", F.posexplode("bands").alias("band", "bucket"))
    # the centre of a bucket differs from band to band, so that large groups are tied together many times
    ranked = member.select("bucket", "v", F.xxhash64("band", "v").alias("rank"))
    centre = ranked.groupBy("bucket").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = Staged(ranked.join(centre, "bucket").select("bucket", "v", "n", (F.col("rank") == F.col("first")).alias("is_centre")), "buckets")
    centres = buckets.df.where("is_centre").groupBy("bucket").agg(F.min("v").alias("u"))
    pairs = buckets.df.join(centres, "bucket").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    near = _near(pairs, nodes.df, most_odd)
    links = _confirmed(near, docs, id_col, text_col, width, percent)
    vertices = buckets.df.select("v").distinct()
    first = components(vertices, links.df)
    links.drop()

    # buckets that still hold several components: compare their members in blocks
    labelled = buckets.df.select("bucket", "v").join(first, "v")
    sketches = nodes.df.select("v", "sketch")
    maybe = Staged(_blockwise(labelled, sketches, most_odd, None), "maybe")
    buckets.drop()
    last = first
    if not maybe.df.isEmpty():
        # what may be linked lies within one cluster of such pairs; clusters are compared on full sets
        ends = maybe.df.select("u").union(maybe.df.select("v")).distinct().withColumnRenamed("u", "v")
        clusters = components(ends, maybe.df).withColumnRenamed("c", "bucket")
        items = _sets_of(clusters.select("v"), docs, id_col, text_col, width)
        more = Staged(_blockwise(clusters.join(first, "v"), sketches.join(items.df, "v"), most_odd, percent), "links")
        items.drop()
        if not more.df.isEmpty():
            named = more.df.join(first.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").join(first, "v").select(F.col("cu").alias("u"), F.col("c").alias("v")).distinct()
            joined = components(named.select("u").union(named.select("v")).distinct().withColumnRenamed("u", "v"), named)
            last = first.join(joined.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select("v", F.coalesce("cc", "c").alias("c"))
    maybe.drop()
    of_key = nodes.df.select("key", "v").join(last, "v", "left").select("key", F.coalesce("c", "v").alias("c"))
    return (
        seen.df.select("doc_id", "n_shingles", "key")
        .join(of_key, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _near(pairs: DataFrame, nodes: DataFrame, most_odd: int) -> DataFrame:
    """The pairs whose sketches do not rule them out."""
    odd = F.pandas_udf(_odd_bits, "long")
    left, right = nodes.select(F.col("v").alias("u"), F.col("sketch").alias("a")), nodes.select("v", F.col("sketch").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(odd("a", "b") <= most_odd).select("u", "v")


def _sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> Staged:
    """``v, items`` of the vertices in ``wanted`` (``v``, written and distinct)."""
    ids = wanted.withColumnRenamed("v", "__wanted")
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("v"), F.col(text_col).alias("text")).join(ids, F.col("v") == F.col("__wanted"), "left_semi")
    return Staged(full_sets(texts, "v", "text", width), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> Staged:
    """The pairs that reach the threshold on their full sets, ``u, v``."""
    kept = Staged(pairs, "pairs")
    needed = Staged(kept.df.select("u").union(kept.df.select("v")).distinct().withColumnRenamed("u", "v"), "needed")
    items = _sets_of(needed.df, docs, id_col, text_col, width)
    left, right = items.df.select(F.col("v").alias("u"), F.col("items").alias("a")), items.df.select("v", F.col("items").alias("b"))
    common = F.pandas_udf(_common, "long")
    both = kept.df.join(right, "v").join(left, "u").select("u", "v", ((F.octet_length("a") + F.octet_length("b")) / 8).cast("long").alias("total"), common("a", "b").alias("common"))
    links = Staged(both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("u", "v").distinct(), "links")
    for done in (kept, needed, items):
        done.drop()
    return links


def _blockwise(members: DataFrame, payload: DataFrame, most_odd: int, percent: int | None) -> DataFrame:
    """Links ``u, v`` that connect what is linked within each bucket and across
    its components: a spanning forest of a block pair's links, at most one row a
    member, never all pairs.

    ``members``: ``bucket, v, c``; buckets of a single component are left out.
    ``payload``: ``v, sketch`` and, to confirm links on full sets (``percent`` given),
    ``items``; else a link is what the sketches do not rule out.  A bucket makes blocks
    of about ``BLOCK`` members, those of a component that fills a block by itself apart
    from the others, and each pair of blocks is a group of its own, but for pairs of
    two blocks of that component: it is linked already.  So a large group of copies
    with few others in its bucket costs rows in proportion to its members."""
    kind = members.schema["v"].dataType.simpleString()
    parts = members.groupBy("bucket", "c").agg(F.count("*").alias("m"))
    shape = parts.groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("n_main"), F.sum("m").alias("n")).where("n > n_main")
    # powers of two and one hash: a member's block is the same in all buckets of a size,
    # so the forests of buckets that share members share links
    number = lambda n: F.pow(F.lit(2), F.ceil(F.log2(F.ceil(n / BLOCK)))).cast("int")
    apart = F.when(F.col("n_main") >= BLOCK, F.col("n_main")).otherwise(0)
    shape = shape.select("bucket", "main", number(F.col("n") - apart).alias("others"), F.when(apart > 0, number(apart)).otherwise(0).alias("mains"))
    is_main, place = (F.col("c") == F.col("main")) & (F.col("mains") > 0), F.xxhash64("v")
    placed = members.join(shape, "bucket").withColumn("mine", F.when(is_main, F.col("others") + F.pmod(place, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    dealt = placed.join(payload, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "v", "c", "sketch", *(["items"] if percent else []))

    def links(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        g = g.drop_duplicates("v").sort_values("v", ignore_index=True)
        rows, cols = np.flatnonzero(g["mine"] == i), np.flatnonzero(g["mine"] == j)
        bits = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)
        c, ids = g["c"].to_numpy(), g["v"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["items"]] if percent else []
        # on full sets what is in one component is linked already; sketches only gather
        # pairs for that test, and there each member counts by itself
        root = np.unique(c, return_inverse=True)[1] if percent else np.arange(len(g))

        def joined(some: np.ndarray, others: np.ndarray, within: bool) -> list[tuple]:
            found = []
            for at, p in enumerate(some):
                q = others[at + 1 :] if within else others
                q = q[(c[q] != c[p]) & (root[q] != root[p])]
                if len(q):
                    q = q[np.bitwise_count(bits[q] ^ bits[p]).sum(axis=1, dtype=np.int64) <= most_odd]
                if percent and len(q):
                    sizes, mine = np.array([len(sets[k]) for k in q]), sets[p]
                    flat = np.concatenate([sets[k] for k in q])
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    common = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
                    q = q[100 * common >= percent * (sizes + len(mine) - common)]
                for k in q:
                    if root[k] != root[p]:
                        root[root == root[k]] = root[p]
                        found.append((min(ids[p], ids[k]), max(ids[p], ids[k])))
            return found

        if i == j:
            out = joined(rows, rows, True)
        else:  # links within a block are another group's; here they save links between the two
            joined(rows, rows, True), joined(cols, cols, True)
            out = joined(rows, cols, False)
        return pd.DataFrame(out, columns=["u", "v"])

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work, not bytes, sets their number
    return dealt.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(links, f"u {kind}, v {kind}").distinct()


def one_row_an_id(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row of each id, with all its columns; rows with a null id all stay.
    Of different rows with one id the one with the smallest hash stays."""
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1")
    ids = Staged(repeated.select("__id"), "repeated").df
    n = ids.count()
    if not n:  # ids are unique, as they should be: nothing moves
        return docs
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    single = docs.join(ids, F.col(id_col) == F.col("__id"), "left_anti")
    several = docs.join(ids, F.col(id_col) == F.col("__id"), "left_semi")
    first = several.groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*several.columns), F.xxhash64(*several.columns)).alias("__row"))
    return single.unionByName(first.select("__row.*"))
