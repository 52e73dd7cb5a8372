"""Many small groups in one call: what a group costs is its rows, not a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins, in columns that are sorted together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that none of them ends inside a group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        cut = int(starts(*(b[k].to_numpy() for k in keys))[-1])
        if held and (cut or (held[-1][list(keys)].iloc[-1].to_numpy() != b[list(keys)].iloc[0].to_numpy()).any()):
            yield pd.concat([*held, b[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield b[:cut].reset_index(drop=True)
        held.append(b[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def in_chunks(df: DataFrame, keys: Sequence[str], call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """As ``groupBy(keys).applyInPandas``, but ``call`` gets many whole groups at once, sorted by ``keys``, then ``order``.

    A task holds a batch and the group that is open, so its memory follows the
    largest group, as before. Keys are not null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in whole_groups(batches, keys):
            yield call(chunk)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
