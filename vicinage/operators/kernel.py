"""The k nearest rows of a block of queries, kept while blocks of data pass.

A cheap screen rules pairs out, the rest gets exact distances: for L2 a matrix product
and for L1 and L-infinity sums in single precision, widened by their largest rounding
error; for L-infinity, once a query has ``k`` rows, bitmaps of the rows whose component
lies near enough, 64 rows a word; for bits the exact count in 64-bit words; in few
dimensions the boxes around runs of near rows, and around heaps of such boxes.  Nothing
within a query's k-th distance is ever dropped, and ties go to the smaller id.  Of equal
rows in a block only the ``k`` with the smallest ids are looked at.
"""

from __future__ import annotations

import numpy as np

#: Rows of data screened at once, pairs of a screen, candidates held before they are merged.
COLS, SCREEN, HELD = 4096, 1 << 17, 1 << 20
#: Components up to which boxes are used, rows of a box, boxes of a heap (a box around
#: boxes), and rows of a block cut into boxes.
BOX_DIM, BOX, HEAP, BOXED = 8, 32, 32, 1 << 15
#: Rows and queries of a block of bitmaps (which pay from four such blocks of queries on),
#: levels of a component (at most 252, in a byte), rows before the first block.
RANGED, RANGED_ASKED, LEVELS, UNRANGED = 1 << 14, 128, 250, 1 << 10
EPS = 2.0**-23
#: Largest component that single precision takes; squares stay finite.
LARGE = 1e15


def exact_distances(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row ``i`` of ``a`` to row ``i`` of ``b``; equal rows give equal ones."""
    if kind == "hamming":
        return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        d = a - b
    if kind == "l1":
        return np.abs(d, out=d).sum(1)
    if kind == "linf":
        return np.abs(d, out=d).max(1, initial=0.0)
    sq = np.square(d, out=d).sum(1)
    return np.sqrt(sq) if kind == "l2" else sq


def _packed(words: np.ndarray) -> np.ndarray:
    """Two 32-bit words in one of 64."""
    if words.shape[1] % 2:
        words = np.hstack([words, np.zeros((len(words), 1), np.int64)])
    return words[:, ::2].astype(np.uint64) | (words[:, 1::2].astype(np.uint64) << np.uint64(32))


def few_copies(ids: np.ndarray, x: np.ndarray, k: int, by_id: bool) -> np.ndarray | None:
    """Which rows to look at: of equal rows, in the order of ``ids``, the first ``k`` (of
    ``k`` different ids, if ``by_id``); none of the others can be among a query's ``k``
    nearest.  None where that is all."""
    if len(x) <= k:
        return None
    words = np.ascontiguousarray(x).view(np.uint64)
    odd = np.random.default_rng(1).integers(0, 1 << 63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = ((words ^ (words >> np.uint64(32))) * odd).sum(1, dtype=np.uint64)
    order = np.argsort(hashed, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(hashed[order]) != 0))
    counts = np.diff(np.append(starts, len(x)))
    many = counts > k
    if not many.any():
        return None
    rows, first = order[np.repeat(many, counts)], np.repeat(order[starts[many]], counts[many])
    equal = (words[rows] == words[first]).all(1)  # equal hashes are no proof
    fresh = equal & (np.append(True, np.diff(ids[rows]) != 0) | (rows == first)) if by_id else equal
    upto, own = np.cumsum(fresh), np.cumsum(counts[many]) - counts[many]
    keep = np.ones(len(x), bool)
    keep[rows[equal & (upto - np.repeat(upto[own], counts[many]) >= k)]] = False
    return keep


def boxed(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which runs of ``BOX``, and of ``HEAP`` of these, lie close
    together: halves by the widest component."""
    out, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= BOX:
            out.append(rows)
            continue
        widest = np.ptp(x[rows], axis=0).argmax()
        unit = BOX * HEAP if len(rows) > BOX * HEAP else BOX
        middle = max(unit, len(rows) // 2 // unit * unit)
        rows = rows[np.argpartition(x[rows, widest], middle)]
        left += [rows[middle:], rows[:middle]]
    return np.concatenate(out) if out else np.arange(0)


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat positions that are set; few are, so eight are looked at together."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    at, bit = np.nonzero(mask.reshape(-1, 8)[words])
    return words[at] * 8 + bit


class Nearest:
    """``most``: distances beyond it (one for all queries or one each) are left out."""

    def __init__(self, kind: str, qids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool = False, most=np.inf):
        self.kind, self.qids, self.q, self.k, self.exclude_self = kind, qids, q, k, exclude_self
        self.most = np.broadcast_to(np.asarray(most, np.float64), (len(qids),))
        self.far, self.ids = np.full((len(qids), k), np.inf), np.full((len(qids), k), np.iinfo(np.int64).max)
        self.bar = self.most.copy()
        self._held: list[tuple] = []
        self._count = self.seen = 0
        if kind == "hamming":
            self.narrow = not len(q) or (0 <= q.min() and q.max() < 1 << 32)
            self._q = None
        else:
            self.tame = np.isfinite(q).all() and (not q.size or np.abs(q).max() < LARGE)
            self._q = q.astype(np.float32) if self.tame else None
            self.size = (np.sqrt((q * q).sum(1)) if kind in ("l2", "l2sq") else np.abs(q).sum(1)) if self.tame else None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.qids):
            return
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        keep = few_copies(ids, x, self.k + self.exclude_self, self.exclude_self)
        if keep is not None:
            ids, x = ids[keep], x[keep]
        few = self.kind != "hamming" and x.shape[1] <= BOX_DIM and len(ids) > BOX and np.isfinite(x).all() and np.isfinite(self.q).all()
        plain = self.kind == "linf" and not few and len(self.qids) >= 4 * RANGED_ASKED and np.isfinite(x).all() and np.isfinite(self.q).all()
        at = 0
        while at < len(ids):
            ranged = plain and len(ids) - at > UNRANGED and np.isfinite(self.bar).all()
            step = BOXED if few else min(RANGED, 4 * max(self.seen, UNRANGED)) if ranged else UNRANGED if plain else COLS
            (self._boxes if few else self._ranges if ranged else self._screen)(ids[at : at + step], x[at : at + step])
            self._merge()
            at += step
            self.seen += step

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids, distances."""
        r, c = np.nonzero(np.isfinite(self.far))
        return self.qids[r], self.ids[r, c], self.far[r, c]

    def _hold(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, cols: np.ndarray) -> None:
        """Take the exact distances of pairs that passed a screen."""
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            far, i = exact_distances(self.kind, self.q[r], x[c]), ids[c]
            good = np.isfinite(far) & ((far < self.bar[r]) | ((far == self.bar[r]) & (i < self.ids[r, -1])))
            if self.exclude_self:
                good &= self.qids[r] != i
            if good.any():
                self._held.append((r[good], i[good], far[good]))
                self._count += int(good.sum())
                if self._count >= HELD:
                    self._merge()

    def _merge(self) -> None:
        if not self._held:
            return
        rows, ids, far = (np.concatenate(part) for part in zip(*self._held, strict=True))
        self._held, self._count = [], 0
        used = np.unique(rows)
        r = np.concatenate([rows, np.repeat(used, self.k)])
        i = np.concatenate([ids, self.ids[used].ravel()])
        f = np.concatenate([far, self.far[used].ravel()])
        by = np.lexsort((i, f, r))
        r = r[by]
        first = np.searchsorted(r, used)
        keep = by[np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < self.k]
        self.far[used], self.ids[used] = f[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)
        self.bar[used] = np.minimum(self.most[used], self.far[used, -1])

    # ------------------------------------------------------------------ screens
    def _ranges(self, ids: np.ndarray, x: np.ndarray) -> None:
        """L-infinity: a row is near only if each of its components lies within the k-th
        distance.  Components become levels between quantiles, and a bitmap a level holds
        the rows below it, so two bitmaps give the rows of a range of levels."""
        padded = -len(ids) % 64
        some = np.sort(x[:: max(1, len(x) // (4 * LEVELS))], axis=0)
        edges = np.ascontiguousarray(some[:: max(1, len(some) // LEVELS)][:LEVELS].T)
        levels = np.arange(len(edges[0]) + 2, dtype=np.uint8)
        below = []
        for j, edge in enumerate(edges):
            of = np.pad(np.searchsorted(edge, x[:, j], "right").astype(np.uint8), (0, padded), constant_values=255)
            below.append(np.packbits(of[None] < levels[:, None], axis=1, bitorder="little").view(np.uint64))
        reach = self.bar[:, None] + 1e-12 * (self.bar[:, None] + np.abs(self.q)) + 1e-300  # more than rounding takes
        for at in range(0, len(self.qids), RANGED_ASKED):
            q, far = self.q[at : at + RANGED_ASKED], reach[at : at + RANGED_ASKED]
            near, upper, lower = (np.empty((len(q), len(below[0][0])), np.uint64) for _ in range(3))
            near.fill(np.iinfo(np.uint64).max)
            for j, edge in enumerate(edges):
                np.take(below[j], np.searchsorted(edge, q[:, j] + far[:, j], "right") + 1, axis=0, out=upper, mode="clip")
                np.take(below[j], np.searchsorted(edge, q[:, j] - far[:, j], "right"), axis=0, out=lower, mode="clip")
                np.bitwise_xor(upper, lower, out=upper)
                np.bitwise_and(near, upper, out=near)
            r, c = np.nonzero(near)
            word, bit = np.nonzero(np.unpackbits(near[r, c].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            self._hold(r[word] + at, ids, x, c[word] * 64 + bit)

    def _screen(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, SCREEN // len(ids))
        make = self._bits(x) if self.kind == "hamming" else self._single(x)
        need = self.k + self.exclude_self
        for at in range(0, len(self.qids), step):
            d, slack, bar = make(at, at + step)  # of the screen, in its own unit
            open_ = ~np.isfinite(bar)
            if open_.any() and need < len(ids):  # what lies beyond the k-th of these rows cannot be among the nearest
                bar = np.where(open_, np.partition(d, need - 1, axis=1)[:, need - 1] + slack, bar)
            top = bar + slack
            if d.dtype.kind == "u":
                top = np.clip(top, -1, np.iinfo(d.dtype).max)
                none = top < 0
                mask = d <= top.astype(d.dtype)[:, None]
                if none.any():
                    mask[none] = False
            else:
                top = np.where(np.isnan(top), np.inf, top)
                mask = d <= top[:, None].astype(d.dtype)
            flat = _set(mask)
            if len(flat):
                rows, cols = np.divmod(flat, len(ids))
                self._hold(rows + at, ids, x, cols)

    def _bits(self, x: np.ndarray):
        narrow = self.narrow and 0 <= x.min() and x.max() < 1 << 32
        if self._q is None or self._q[0] != narrow:
            self._q = (narrow, (_packed(self.q) if narrow else self.q.view(np.uint64)).T.copy())
        q, w = self._q[1], (_packed(x) if narrow else np.ascontiguousarray(x).view(np.uint64)).T.copy()
        kind = np.uint8 if 64 * len(w) < 256 else np.uint16 if 64 * len(w) < 1 << 16 else np.uint32

        def make(a: int, b: int):
            d = np.bitwise_count(q[0, a:b, None] ^ w[0][None])
            if kind is not np.uint8 or len(w) > 1:
                d = d.astype(kind)
            for j in range(1, len(w)):
                d += np.bitwise_count(q[j, a:b, None] ^ w[j][None])
            return d, 0, self.bar[a:b]

        return make

    def _single(self, x: np.ndarray):
        square = self.kind in ("l2", "l2sq")
        if not self.tame or not np.isfinite(x).all() or np.abs(x).max(initial=0.0) >= LARGE:
            return self._double(x)
        dim = x.shape[1]
        size = np.sqrt((x * x).sum(1)) if square else np.abs(x).sum(1)
        if square:
            xt, xn = np.ascontiguousarray(x.T, np.float32) * np.float32(-2), (size * size).astype(np.float32)

            def make(a: int, b: int):
                d = self._q[a:b] @ xt
                d += xn[None]
                d += (self.size[a:b] ** 2).astype(np.float32)[:, None]
                slack = EPS * (dim + 8) * (self.size[a:b] + size.max()) ** 2 + 1e-37
                bar = self.bar[a:b]
                return d, slack, bar * bar if self.kind == "l2" else bar

            return make
        xt = np.ascontiguousarray(x.T, np.float32)
        fold = np.add if self.kind == "l1" else np.maximum

        def make(a: int, b: int):
            some = self._q[a:b]
            d, part = np.zeros((len(some), len(x)), np.float32), np.empty((len(some), len(x)), np.float32)
            for j in range(dim):
                np.subtract(some[:, j, None], xt[j][None], out=part)
                np.abs(part, out=part)
                fold(d, part, out=d)
            bar = self.bar[a:b]
            known = np.where(np.isfinite(bar), bar, self.size[a:b] + size.max())
            return d, EPS * ((dim + 4) * known + 4 * (self.size[a:b] + size.max())) + 1e-37, bar

        return make

    def _double(self, x: np.ndarray):
        def make(a: int, b: int):
            some = self.q[a:b]
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.stack([exact_distances(self.kind, np.broadcast_to(v, x.shape), x) for v in some])
            d[np.isnan(d)] = np.inf
            return d, 0.0, self.bar[a:b]

        return make

    def _away(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least distances of queries (rows) to boxes (columns)."""
        bound = np.zeros((len(q), len(lo)))
        for j in range(lo.shape[1]):
            away = np.maximum(lo[None, :, j] - q[:, j, None], q[:, j, None] - hi[None, :, j])
            np.maximum(away, 0, out=away)
            bound = np.maximum(bound, away) if self.kind == "linf" else bound + (away if self.kind == "l1" else away * away)
        if self.kind == "l2":
            np.sqrt(bound, out=bound)
        bound *= 1 - 1e-9
        return bound

    def _boxes(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A query looks into its nearest box, the others of that heap, then those of the heaps within its reach."""
        order = boxed(x)
        ids, x = ids[order], x[order]
        cuts = np.arange(0, len(x), BOX)
        lo, hi = np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)
        tops = np.arange(0, len(cuts), HEAP)
        heaps = np.minimum.reduceat(lo, tops), np.maximum.reduceat(hi, tops)
        step = max(1, (1 << 21) // max(len(tops), HEAP))
        for at in range(0, len(self.qids), step):
            q, bar = self.q[at : at + step], self.bar[at : at + step]
            bound = self._away(q, *heaps)
            home, near = bound.argmin(1), []
            by = np.argsort(home, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(home[by])) + 1):
                top = tops[home[rows[0]]]
                inner = self._away(q[rows], lo[top : top + HEAP], hi[top : top + HEAP])
                rank = inner.argsort(1)
                near.append((rows, top + rank, np.take_along_axis(inner, rank, 1)))
            first, then = 0, 1
            while first < HEAP:  # the nearest box, and then as many as before, within what these have left
                for rows, boxes, inner in near:
                    r, b = np.nonzero(inner[:, first:then] <= np.minimum(bar[rows], np.finfo(np.float64).max)[:, None])
                    self._look(rows[r] + at, boxes[r, first + b], ids, x)
                self._merge()
                first, then = then, 2 * then
            bound[np.arange(len(q)), home] = np.inf
            for top, reach in zip(tops, bound.T, strict=True):
                rows = np.flatnonzero(reach <= np.minimum(bar, np.finfo(np.float64).max))
                r, b = np.nonzero(self._away(q[rows], lo[top : top + HEAP], hi[top : top + HEAP]) <= np.minimum(bar[rows], np.finfo(np.float64).max)[:, None])
                self._look(rows[r] + at, top + b, ids, x)
            self._merge()

    def _look(self, rows: np.ndarray, boxes: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Queries meet the rows of a box each."""
        step = max(1, (1 << 16) // BOX)
        for at in range(0, len(rows), step):
            cols = (boxes[at : at + step, None] * BOX + np.arange(BOX)).ravel()
            of = np.repeat(rows[at : at + step], BOX)
            if cols.max() >= len(x):  # the last box is not full
                of, cols = of[cols < len(x)], cols[cols < len(x)]
            self._hold(of, ids, x, cols)
            if self._count >= HELD // 8:
                self._merge()
