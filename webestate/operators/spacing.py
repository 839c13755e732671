"""Attempts that are some minutes apart: of attempts in order of time, the first counts, then each that comes at least
``minutes`` after the last one that counted.

The count is sequential, but it can be put together from parts. A stretch of time is summed up as a table: for each time
at which counting may enter it, how many attempts count and when the last one was. Counting enters a stretch less than
``minutes`` after its begin or at the next attempt, so the table holds the attempts of those minutes and one more. Tables of
following stretches join into one of the same form, in any grouping. So days are counted in parallel, a key with most
attempts is spread over as many tasks as it has days, and stored tables of earlier runs are joined with those of a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webestate.operators.experience import seconds

MINUTE, DAY = 60_000_000, 86_400_000_000
#: Begin of a stretch, times of entry, attempts that count from there, and the last of them. Times are microseconds.
STATE = "begin bigint, starts array<bigint>, counts array<bigint>, lasts array<bigint>"
Table = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def stretch_table(begin: int, times: np.ndarray, spacing: int) -> Table:
    """The table of one stretch; ``times`` are sorted and distinct."""
    after = np.searchsorted(times, times + spacing)
    counts, last = np.ones(len(times), dtype=np.int64), np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            counts[i], last[i] = counts[after[i]] + 1, last[after[i]]
    n = int(np.searchsorted(times, begin + spacing)) + 1
    return begin, times[:n], counts[:n], times[last[:n]]


def joined_tables(a: Table, b: Table, spacing: int) -> Table:
    """The table of two stretches, ``a`` before ``b``."""
    begin, starts, counts, lasts = a
    _, starts_b, counts_b, lasts_b = b
    at = np.searchsorted(starts_b, lasts + spacing)
    more = at < len(starts_b)
    counts, lasts = counts.copy(), lasts.copy()
    counts[more], lasts[more] = counts[more] + counts_b[at[more]], lasts_b[at[more]]
    if len(starts) and starts[-1] >= begin + spacing:
        return begin, starts, counts, lasts
    n = int(np.searchsorted(starts_b, begin + spacing)) + 1  # entries of b that are early enough to be entries of both
    return begin, *(np.concatenate((x, y[:n])) for x, y in ((starts, starts_b), (counts, counts_b), (lasts, lasts_b)))


def _table(keys: dict[str, pa.ChunkedArray | pa.Array], table: Table) -> pa.Table:
    begin, *lists = table
    return pa.table({**keys, "begin": pa.array([begin], pa.int64()), **{n: pa.array([x.tolist()], pa.list_(pa.int64())) for n, x in zip(("starts", "counts", "lasts"), lists, strict=True)}})


def spaced_states(attempts: DataFrame, keys: list[str], at: str, minutes: int, days: int = 1) -> DataFrame:
    """``*keys, begin, starts, counts, lasts``: one table for each key and stretch of ``days`` with an attempt.

    Attempts at one instant are one. Rows without a time are left out. Null keys are a key.
    """
    spacing, width = minutes * MINUTE, days * DAY
    if not 0 < spacing <= width:
        raise ValueError("a stretch must be at least as long as the spacing, which must be positive")
    time = seconds(at)
    distinct = attempts.where(F.col(at).isNotNull()).select(*keys, time.alias("_t"), (F.floor(time / width) * width).cast("bigint").alias("begin")).distinct()

    def run(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        times = np.sort(group.column("_t").to_numpy())
        return _table({k: first.column(k) for k in keys}, stretch_table(first.column("begin")[0].as_py(), times, spacing))

    return distinct.groupBy(*keys, "begin").applyInArrow(run, _schema(distinct, keys))


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), STATE])


def merged_states(states: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """One table for each key. Stretches of one key must not overlap; tables of any number of runs can come together."""
    spacing = minutes * MINUTE

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.select(["begin", "starts", "counts", "lasts"]).to_pylist()]
        total: Table | None = None
        for r in sorted(rows, key=lambda r: r["begin"]):
            table = (r["begin"], *(np.asarray(r[c], dtype=np.int64) for c in ("starts", "counts", "lasts")))
            if total is not None and table[0] == total[0]:
                raise ValueError("two tables of one stretch")
            total = table if total is None else joined_tables(total, table, spacing)
        if total is not None:
            yield from _table({name: pa.array([k.as_py()], k.type) for name, k in zip(keys, key, strict=True)}, total).to_batches()

    return states.groupBy(*keys).applyInArrow(run, _schema(states, keys))


def spaced_counts(merged: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, spaced_n, first_at, last_at`` (counted attempts) from one table for each key."""
    def when(c: str) -> Column:
        return F.timestamp_micros(F.get(c, F.lit(0))).cast("timestamp_ntz")

    return merged.select(*keys, F.get("counts", F.lit(0)).alias("spaced_n"), when("starts").alias("first_at"), when("lasts").alias("last_at"))


def count_spaced(attempts: DataFrame, keys: list[str], at: str, minutes: int, days: int = 1) -> DataFrame:
    """Attempts of each key that are at least ``minutes`` apart."""
    return spaced_counts(merged_states(spaced_states(attempts, keys, at, minutes, days), keys, minutes), keys)
