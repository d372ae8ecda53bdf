"""Sequential work over sorted partitions: rows of a key in their order, batch by batch.

A partition holds whole keys, sorted; a kernel takes its batches one after the other and carries what it must
remember of the current key over the borders of batches.  So a key with any share of all rows is
streamed by one task, as work in sequence must be, and memory follows the state and not the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, by: list[str], order: list[str], kernel: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Applies a kernel to partitions sorted by ``by`` and ``order``; no key is in two partitions.

    Rows are dealt by a hash of the keys, never by the keys themselves: where rows lie by their keys already, Spark drops
    such a step from the plan, and as a kernel asks for no distribution, adaptive execution may then merge the parts of
    a union one by one, or cut those of a skewed join, so that a key's rows are worked through apart.
    """
    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInPandas(kernel, schema)


def by_key(start: Callable, step: Callable, names: list[str], key: str) -> Callable:
    """A kernel that makes a row of each row: ``step(state, row)`` gives the next state and the row, ``start()`` a key's first state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if getattr(row, key) != now:
                    now, state = getattr(row, key), start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return run
