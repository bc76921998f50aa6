"""The best of each query while blocks of scores stream past, and what the searches share that score in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The ``k`` best of each of ``n`` queries, by falling score and then by id; NaN comes first. ``least`` is the score below which a row is no longer taken."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.query, self.score, self.whole, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0), None

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, whole: np.ndarray | None = None) -> None:
        """``whole`` has the scores before they were rounded."""
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        whole = np.concatenate([self.whole, score[len(self.score) :] if whole is None else whole])
        ids = ids if self.id is None else np.concatenate([self.id, ids])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, np.where(np.isnan(score), -np.inf, -score), query))
        query = query[order]
        counts = np.bincount(query, minlength=self.n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = order[place < self.k]
        self.query, self.score, self.whole, self.id = query[place < self.k], score[kept], whole[kept], ids[kept]
        last = place == self.k - 1
        self.least[query[last]] = np.nan_to_num(score[order[last]], nan=np.inf)


def ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all elements one list after the other) of a column of lists without nulls."""
    return lengths(column), column.flatten().to_numpy(zero_copy_only=False)


def taken(best: list[Best], names: list[np.ndarray], kinds: list[pa.DataType]):
    """Batches (query, doc, score) of what was kept; ``names`` has the names of each one's queries."""
    for b, name in zip(best, names, strict=True):
        for at in range(0, len(b.query), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(name[b.query[part]].tolist(), kinds[0]), pa.array(b.id[part].tolist(), kinds[1]), pa.array(b.score[part], pa.float64())], ["query", "doc", "score"])
