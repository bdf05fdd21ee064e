"""The k nearest of a block of rows among blocks that come one after another, exactly.

A product in single precision, whose error is bounded, leaves the few pairs that may be near enough. Their squared distances
are then taken in double precision, rounded to nine digits; ties go to the smaller id."""

from __future__ import annotations

import numpy as np

#: Rows of queries and of candidates that are compared at once.
TILE = (1024, 2048)
#: Numbers of one side whose pairs are taken together in double precision.
PAIR_CELLS = 1 << 20
DIGITS = 9


def _wide(x: np.ndarray, first: np.ndarray | float, second: np.ndarray | float, kind: type) -> np.ndarray:
    """``x`` and two columns more, in ``kind``."""
    out = np.empty((len(x), x.shape[1] + 2), kind)
    out[:, :-2], out[:, -2], out[:, -1] = x, first, second
    return out


class Block:
    """Rows in ascending order of ids (for each label, if labels are kept apart). Rows with a number that isn't finite have
    no neighbours and are none."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        fine = np.isfinite(x).all(axis=1)
        self.ids, self.labels, self.x = (ids, labels, x) if fine.all() else (ids[fine], labels[fine], x[fine])
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.most = self.square.max(initial=0.0)

    def spans(self) -> dict:
        """Where the rows of each label begin and end."""
        at = [0, *(np.flatnonzero(self.labels[1:] != self.labels[:-1]) + 1).tolist(), len(self.labels)]
        return {self.labels[a]: (a, b) for a, b in zip(at, at[1:]) if b > a}


class Nearest:
    """``d2``, ``ids`` and ``labels`` of the nearest so far, a row for each query; distances not yet found are infinite."""

    def __init__(self, queries: Block, k: int):
        n = len(queries.ids)
        self.queries, self.k, self.d2 = queries, k, np.full((n, k), np.inf)
        self.ids, self.labels = np.zeros((n, k), queries.ids.dtype), np.full((n, k), None, object)

    def see(self, block: Block, same_label: bool) -> None:
        if same_label:
            mine, theirs = self.queries.spans(), block.spans()
            pairs = [(*mine[label], *theirs[label]) for label in mine if label in theirs]
        else:
            pairs = [(0, len(self.queries.ids), 0, len(block.ids))]
        single = max(self.queries.most, block.most) < 1e30
        wide = _wide(block.x, 1, block.square, np.float32) if single else None
        for a, b, c, d in pairs:
            for i in range(a, b, TILE[0]):
                for j in range(c, d, TILE[1]):
                    self._tile(slice(i, min(i + TILE[0], b)), block, slice(j, min(j + TILE[1], d)), wide)

    def _near(self, q: slice, block: Block, c: slice, kind: type, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all pairs that the nearest may need, and of some others."""
        own, dim = self.queries.square[q], self.queries.x.shape[1]
        known = self.d2[q, -1]
        limit = np.minimum(known, 2.1 * (own + block.most) + 1)  # no pair is farther apart
        # Half the last digit kept, and the bound of the error of dim + 2 products and their sum.
        slack = 10.0**-DIGITS + 1.1 * (dim + 8) * np.finfo(kind).eps / 2 * (2 * own + 2 * block.most + limit)
        over = _wide(-2 * self.queries.x[q], own - limit - slack, 1, kind) @ wide.T
        if np.isinf(known).any() and over.shape[1] > self.k:
            # One of the k + 1 smallest may be the row itself, the others bound what is near.
            cut = np.minimum(0, np.partition(over, self.k, axis=1)[:, self.k] + 2 * slack).astype(kind)
            return np.divmod(np.flatnonzero(over <= cut[:, None]), over.shape[1])
        some = np.flatnonzero(over.min(axis=1) <= 0)
        rows, columns = np.divmod(np.flatnonzero(over[some] <= 0), over.shape[1])
        return some[rows], columns

    def _tile(self, q: slice, block: Block, c: slice, wide: np.ndarray | None) -> None:
        x, ids = self.queries.x[q], self.queries.ids[q]
        near_x, near_ids = block.x[c], block.ids[c]
        many = len(x) * (len(near_x) // 64 + 2 * (self.k + 1))
        rows, columns = self._near(q, block, c, np.float32, wide[c]) if wide is not None else (np.empty(many + 1, int), None)
        if len(rows) > many:
            rows, columns = self._near(q, block, c, np.float64, _wide(near_x, 1, block.square[c], np.float64))
        itself = ids[rows] == near_ids[columns]
        # Rows with many candidates as near as the nearest (copies), or with an id that repeats, are compared with all.
        whole = (np.bincount(rows, minlength=len(x)) > 64 + 4 * (self.k + 1)) | (np.bincount(rows[itself], minlength=len(x)) > 1)
        pairs = ~itself & ~whole[rows]
        rows, columns = rows[pairs], columns[pairs]
        step = max(1, PAIR_CELLS // max(1, x.shape[1]))
        d2 = [np.empty(0)]
        for a in range(0, len(rows), step):
            gap = x[rows[a : a + step]] - near_x[columns[a : a + step]]
            d2.append(np.round(np.einsum("ij,ij->i", gap, gap), DIGITS))
        rows, columns = [rows], [columns]
        for row in np.flatnonzero(whole):
            gap = near_x - x[row]
            all_d2 = np.round(np.einsum("ij,ij->i", gap, gap), DIGITS)
            all_d2[near_ids == ids[row]] = np.inf
            first = np.argsort(all_d2, kind="stable")[: self.k]
            first = first[np.isfinite(all_d2[first])]
            rows.append(np.full(len(first), row))
            columns.append(first)
            d2.append(all_d2[first])
        rows, columns, d2 = np.concatenate(rows) + q.start, np.concatenate(columns), np.concatenate(d2)
        last = self.d2[rows, -1]
        better, equal = d2 < last, np.flatnonzero(d2 == last)
        better[equal] = near_ids[columns[equal]] < self.ids[rows[equal], -1]
        if better.any():
            columns = columns[better]
            self._merge(rows[better], d2[better], near_ids[columns], block.labels[c][columns])

    def _merge(self, rows: np.ndarray, d2: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        some = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(some, self.k)])
        d2 = np.concatenate([d2, self.d2[some].ravel()])
        ids = np.concatenate([ids, self.ids[some].ravel()])
        labels = np.concatenate([labels, self.labels[some].ravel()])
        order = np.lexsort((d2, rows))
        r, d = rows[order], d2[order]
        if ((r[1:] == r[:-1]) & (d[1:] == d[:-1]) & np.isfinite(d[1:])).any():
            rank, found = np.zeros(len(ids), int), np.isfinite(d2)
            rank[found] = np.unique(ids[found], return_inverse=True)[1]
            order = np.lexsort((rank, d2, rows))
            r = rows[order]
        first = order[np.arange(len(r)) - np.searchsorted(r, r) < self.k]
        for mine, new in ((self.d2, d2), (self.ids, ids), (self.labels, labels)):
            mine[some] = new[first].reshape(-1, self.k)
