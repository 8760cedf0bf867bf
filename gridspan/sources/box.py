"""What the array sources share: coordinate filters that narrow a scan to a box before tasks are planned."""

from __future__ import annotations

from math import prod

from pyspark.sql.datasource import DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Cells(InputPartition):
    """Chunks of one task."""

    def __init__(self, cells):
        super().__init__(cells)
        self.cells = cells


class CellRange(InputPartition):
    """A run of the chunks of a box of chunks, in C order, by two numbers: a plan of many tasks stays small."""

    def __init__(self, first: tuple[int, ...], sizes: tuple[int, ...], start: int, stop: int):
        super().__init__((start, stop))
        self.first, self.sizes, self.start, self.stop = first, sizes, start, stop

    @property
    def cells(self):
        for k in range(self.start, self.stop):
            cell = []
            for f, n in zip(reversed(self.first), reversed(self.sizes), strict=True):
                k, i = divmod(k, n)
                cell.append(f + i)
            yield tuple(reversed(cell))


#: Tasks of a scan at most; beyond that each gets more chunks.
MOST_TASKS = 100_000


def cell_ranges(first: tuple[int, ...], sizes: tuple[int, ...], each: int) -> list[CellRange]:
    """The chunks from ``first``, so many in each dimension, as tasks of ``each`` chunks or more."""
    total = prod(sizes)
    each = max(1, each, -(-total // MOST_TASKS))
    return [CellRange(first, sizes, i, min(total, i + each)) for i in range(0, total, each)] or [CellRange(first, sizes, 0, 0)]


class BoxReader(DataSourceReader):
    """A reader of an array with the coordinate columns ``dims``; ``low`` and ``high`` (exclusive) bound what is asked."""

    def bound(self, dims, shape) -> None:
        self.dims, self.low, self.high = tuple(dims), [0] * len(shape), list(shape)

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.dims and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                k = self.dims.index(name)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[k] = max(self.low[k], f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[k] = min(self.high[k], f.value + (not isinstance(f, LessThan)))
            yield f  # Spark evaluates it as well


def grouped(cells: list, each: int) -> list[Cells]:
    """Tasks of so many chunks; one empty task if there are none."""
    each = max(1, each)
    return [Cells(cells[i : i + each]) for i in range(0, len(cells), each)] or [Cells([])]
