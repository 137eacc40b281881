"""Sequence packing by minimum bin slack.

Every document becomes token ids plus a closing id.  Whole windows of a long
document go straight into sequences of their own; what is left of each document
(its tail, shorter than a window) waits in a pool.  A sequence is filled from
the pool by subset-sum dynamic programming over a bitset: bit ``s`` says that
some multiset of waiting lengths sums to ``s``.  The highest reachable bit at or
below the capacity is the fill of least slack, and walking the stored bitsets
backwards gives how often each length is used.

The plan is a narrow map: no shuffle, no collect.  Each input partition packs
its own rows in one pass with a bounded pool, and only its very last tokens can
miss a full window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: Tails that wait before sequences are filled, and that stay for later choice.
POOL_HIGH, POOL_LOW = 2048, 1024
#: Bytes of the text pieces whose ids a Python worker remembers (with what an entry takes
#: besides its text), code points of the longest one, and bytes of ids that a batch of
#: results holds.
CACHE_BYTES, CACHE_ENTRY, CACHE_CHARS, BATCH_BYTES = 80 << 20, 200, 48, 2 << 20


class PieceIds(dict):
    """Text piece -> its ids as little-endian unsigned 32-bit bytes.

    Added tokens of the vocabulary file (``<|endoftext|>``) are cut out first and
    have ids of their own, as in ``tokenizers``.  A piece is what stands between two
    single spaces, with the leading space.  The byte-level pattern always starts a
    new pre-token at a single space, so the ids of a text are the ids of its pieces
    one after another.  Words repeat, so most pieces are looked up and not merged again.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in _byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        # the merge engine; ids and merge order are those of the vocabulary file
        self._encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._added = {token: _pack_ids([i]) for token, i in added.items()}
        self._cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else None
        self._held, self._before = 0, {}

    def clear(self) -> None:
        self._held, self._before = 0, {}
        super().clear()

    def direct(self, text: str) -> bytes:
        return _pack_ids(self._encode(text))

    def __missing__(self, piece: str) -> bytes:
        ids = self._before.get(piece)
        if ids is None:
            ids = _pack_ids(self._encode(" " + piece))
        if len(piece) <= CACHE_CHARS:
            self._held += CACHE_ENTRY + 2 * len(piece) + len(ids)
            if self._held > CACHE_BYTES // 2:  # two generations: what is asked for again moves on
                self._held, self._before = 0, dict(self)
                super().clear()
            self[piece] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not any(token in text for token in self._added):
            return self._plain(text)
        parts = [x for x in self._cut.split(text) if x]
        return b"".join([self._added[x] if x in self._added else self._plain(x) for x in parts])

    def _plain(self, text: str) -> bytes:
        if "  " in text:  # a run of spaces is split by its length, not piece by piece
            return self.direct(text)
        first, *rest = text.split(" ")
        return self.direct(first) + b"".join(map(self.__getitem__, rest))


#: Pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, PieceIds] = {}


def _pack_ids(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that stands for it in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def piece_ids(vocabulary: str) -> PieceIds:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = PieceIds(vocabulary)
    return _LOADED[vocabulary]


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> how often it is used, for the multiset of the available lengths
    (``counts``) whose sum is the largest at or below ``capacity``.

    Ties between multisets go to the one with the longest lengths first."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, unit = min(counts[length], capacity // length), 1
        while left > 0:
            use = min(unit, left)
            grown = (reach | (reach << (use * length))) & mask
            if grown != reach:
                steps.append((length, use, reach))
                reach = grown
            left -= use
            unit *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, use, before in reversed(steps):
        if not before >> total & 1:
            used[length] += use
            total -= use * length
    return dict(used)


class Packer:
    """Packs one partition.  ``put`` and ``close`` return finished pieces:
    ``(doc_id, start, ids, doc_tokens, sequence, offset)``."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.n = self.tokens = 0

    def put(self, doc_id, ids: bytes) -> list[tuple]:
        total, done = len(ids) // 4, []
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            done.append((doc_id, start, ids[4 * start : 4 * (start + self.window)], total, self.sequence, 0))
            self.sequence += 1
        if total > whole:
            self._wait((doc_id, whole, ids[4 * whole :], total))
        if self.n >= POOL_HIGH:
            while self.n > POOL_LOW and self.tokens >= self.window:
                done += self._fill(self.window)
        return done

    def close(self) -> list[tuple]:
        """The rest: full windows first, then windows of the powers of two that
        add up to what is left, so that no sequence needs padding."""
        done = []
        while self.tokens >= self.window:
            done += self._fill(self.window)
        while self.tokens:
            done += self._fill(1 << (self.tokens.bit_length() - 1))
        return done

    def _wait(self, tail: tuple) -> None:
        self.pool[len(tail[2]) // 4].append(tail)
        self.n += 1
        self.tokens += len(tail[2]) // 4

    def _take(self, length: int) -> tuple:
        tails = self.pool[length]
        tail = tails.pop()
        if not tails:
            del self.pool[length]
        self.n -= 1
        self.tokens -= length
        return tail

    def _fill(self, capacity: int) -> list[tuple]:
        used = best_fill({k: len(v) for k, v in self.pool.items()}, capacity)
        tails = [self._take(length) for length in sorted(used, reverse=True) for _ in range(used[length])]
        slack = capacity - sum(len(t[2]) // 4 for t in tails)
        if slack:  # no multiset fits exactly: cut the shortest tail that covers the slack
            doc_id, start, ids, total = self._take(min(k for k in self.pool if k > slack))
            tails.append((doc_id, start, ids[: 4 * slack], total))
            self._wait((doc_id, start + slack, ids[4 * slack :], total))
        done, offset = [], 0
        for doc_id, start, ids, total in tails:
            done.append((doc_id, start, ids, total, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1
        return done


def pack(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, with ``with_ids``, the ids themselves.

    Null text counts as empty: such a document is the end id alone.  Every row
    is packed, repeated ids and texts too (each row's ids lie in pieces of its
    own).  Added tokens that stand in a text get their own ids.  A very long text
    is cut into whole windows and one tail.  An empty table gives no rows.  Other
    columns of ``docs`` are ignored.
    ``sequence_id`` is unique in the result: input partition, then a counter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", input_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer, id_type = piece_ids(vocabulary), Packer(window, TaskContext.get().partitionId() << 40), None

        def batch(done: list[tuple]) -> pa.RecordBatch:
            ids, starts, raw, totals, sequences, offsets = zip(*done, strict=True)
            long = lambda x: pa.array(x, pa.int64())
            columns = [pa.array(ids, id_type), long(starts), long([len(x) // 4 for x in raw]), long([zlib.crc32(x) for x in raw]), long(totals), long(sequences), long(offsets)]
            if with_ids:
                import numpy as np

                columns.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in raw], pa.list_(pa.int32())))
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def batches_of(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            done, held = [], 0
            for some in found:
                for piece in some:
                    done.append(piece)
                    held += len(piece[2]) + 100
                    if held >= BATCH_BYTES:
                        yield batch(done)
                        done, held = [], 0
            if done:
                yield batch(done)

        def packed() -> Iterator[list[tuple]]:
            nonlocal id_type
            for rows in batches:
                id_type = rows.schema.field(0).type
                for doc_id, text in zip(rows.column(0), rows.column(1), strict=True):
                    yield packer.put(doc_id.as_py(), known.text(text.as_py()) + end)
            yield packer.close()

        yield from batches_of(packed())

    return source.mapInArrow(run, schema)
