"""Streaming operators: chunk packing with carried state, and running extremes of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.packed import StreamPacker

PACKED = "stream string, n_limbs long, data binary"


def pack_stream(chunks: DataFrame) -> DataFrame:
    """Packs limbs that arrive in chunks: stream, seq, limbs (array<long>), final.

    State of a stream: the next number due, limbs that came early, and the odd limb that waits. A chunk
    is packed when all before it were; ``final`` ends a stream and its state.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, odd, early = state.get if state.exists else (0, -1, [])
        held = {e[0]: (e[1], e[2]) for e in early}
        for f in frames:
            for r in f.itertuples():
                held[int(r.seq)] = ([int(x) for x in r.limbs], bool(r.final))
        packer = StreamPacker(None if odd < 0 else odd)
        data, n, ended = b"", 0, False
        while due in held:
            limbs, final = held.pop(due)
            data += packer.add(np.array(limbs, dtype=np.uint64), final)
            n, due, ended = n + len(limbs), due + 1, ended or final
        if ended:
            state.remove()
        else:
            state.update((due, -1 if packer.waiting is None else packer.waiting, [(k, v[0], v[1]) for k, v in sorted(held.items())]))
        if data:
            yield pd.DataFrame({"stream": [key[0]], "n_limbs": [n], "data": [data]})

    state = "due long, odd long, early array<struct<seq: long, limbs: array<long>, final: boolean>>"
    return chunks.groupBy("stream").applyInPandasWithState(step, PACKED, state, "append", GroupStateTimeout.NoTimeout)


def sample_windows(samples: DataFrame, time: str = "ts", value: str = "value", key: str = "rank", delay: str = "10 minutes", width: str = "5 minutes", guard: float | None = None) -> DataFrame:
    """Minimum, maximum, count and an alert flag of samples by key and window; works on a stream or a table."""
    marked = samples.withWatermark(time, delay) if samples.isStreaming else samples
    low = F.min(value)
    alert = F.lit(False) if guard is None else low < guard
    out = marked.groupBy(F.window(time, width).alias("w"), key).agg(low.alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), alert.alias("alert"))
    return out.select(key, F.col("w.start").alias("start"), "low", "high", "n", "alert")


def high_water(samples: DataFrame, key: str, order: str, free: str) -> DataFrame:
    """Largest drop of free memory from the first sample of each key."""
    return samples.groupBy(key).agg((F.min_by(free, order) - F.min(free)).alias("drop"))
