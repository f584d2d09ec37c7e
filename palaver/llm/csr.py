"""Sparse matrices by compressed rows, and their products row by row (Gustavson)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Scalar products computed at a time.
PRODUCTS = 4_000_000


@dataclass
class Csr:
    """Row i has ``data[starts[i]:starts[i + 1]]`` in the columns ``columns[...]`` of as many."""

    starts: np.ndarray
    columns: np.ndarray
    data: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        """Columns as rows, by a counting sort."""
        counts = np.bincount(self.columns, minlength=self.width)
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        return Csr(_starts(counts), rows[order], self.data[order], self.height)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def intervals(ends: np.ndarray) -> Csr:
    """Incidence of consecutive intervals and the cells that they cover.

    Row i covers the cells from the end of the one before it, 0 at first, up to its own.
    """
    width = int(ends[-1]) if len(ends) else 0
    starts = np.concatenate([[0], ends]).astype(np.int64)
    return Csr(starts, np.arange(width), np.ones(width, dtype=np.int32), width)


def memberships(group: np.ndarray, groups: int) -> Csr:
    """Incidence of items and the one group that each is in."""
    ones = np.ones(len(group), dtype=np.int32)
    return Csr(np.arange(len(group) + 1), group, ones, groups)


def row_products(
    left: Csr, right: Csr, products: int = PRODUCTS
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``left @ right`` as blocks of ``(row, column, value)``, rows and columns ascending.

    Gustavson: a row of the product is the sum of the rows of ``right`` that the row of
    ``left`` names.  A block is as many whole rows as take about ``products`` scalar
    products, so memory follows that number and not the size of the result.
    """
    lengths = np.diff(right.starts)[left.columns]
    done = _starts(lengths)[left.starts]
    at = 0
    while at < left.height:
        end = int(np.searchsorted(done, done[at] + products, side="right")) - 1
        end = max(end, at + 1)
        a, b = left.starts[at], left.starts[end]
        many = lengths[a:b]
        total = int(many.sum())
        first = right.starts[left.columns[a:b]] - (np.cumsum(many) - many)
        place = np.repeat(first, many) + np.arange(total)
        rows = np.repeat(np.arange(at, end), np.diff(done[at : end + 1]))
        columns = right.columns[place]
        values = np.repeat(left.data[a:b], many) * right.data[place]
        yield _added(rows, columns, values, right.width)
        at = end


def _added(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of one place added up, in order of place."""
    if not len(rows):
        return rows, columns, values
    key = rows * np.int64(max(width, 1)) + columns
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, rows, columns, values = key[order], rows[order], columns[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    if len(first) == len(key):
        return rows, columns, values
    return rows[first], columns[first], np.add.reduceat(values, first)
