"""NumPy functions over stacks of equal-size planes, through Arrow and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples of a stack at most, unless one plane has more.
STACK_SAMPLES = 1 << 20


def mapped(planes: DataFrame, work: Callable[..., dict[str, np.ndarray]], outputs: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """``planes`` with array columns ``outputs``: work(stack of shape (n, h, w), rows of columns ``more``) for planes of equal size together."""
    keep = planes.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in planes.schema.fields), *(f"`{o}` array<double>" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                sizes: dict[tuple[int, int], list[int]] = {}
                for i, size in enumerate(zip(b["h"].to_pylist(), b["w"].to_pylist(), strict=True)):
                    sizes.setdefault(size, []).append(i)
                done: dict[str, list] = {o: [None] * b.num_rows for o in outputs}
                for (h, w), rows in sizes.items():
                    step = max(1, STACK_SAMPLES // (h * w))
                    for k in range(0, len(rows), step):
                        part = rows[k : k + step]
                        flat = [np.stack([np.asarray(b[name][i].values, float) for i in part]) for name in ("v", *more)]
                        got = work(flat[0].reshape(-1, h, w), *flat[1:])
                        for o in outputs:
                            for i, plane in zip(part, got[o], strict=True):
                                done[o][i] = plane.reshape(-1)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(done[o], pa.list_(pa.float64())) for o in outputs)], names=[*keep, *outputs])

    return planes.mapInArrow(run, schema)
