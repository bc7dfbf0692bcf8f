"""Scene cuts on a stream of frames: one carried state a video, the signature of the frame before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_cuts(signatures: DataFrame, threshold: float) -> DataFrame:
    """From a stream (video, frame, level) the frames whose level is more than threshold off that of the frame before.

    Frames of a micro-batch are taken in order; the last one's number and level are the state. A frame that comes after a
    later one is held against nothing and gives no row. Pandas frames hold one micro-batch of one video.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values("frame").itertuples():
            if last is None or row.frame > last[0]:
                if last is not None and row.frame == last[0] + 1 and abs(row.level - last[1]) > threshold:
                    out.append((key[0], row.frame, abs(row.level - last[1])))
                last = (int(row.frame), float(row.level))
        state.update(last)
        yield pd.DataFrame(out, columns=["video", "frame", "diff"])

    return signatures.groupBy("video").applyInPandasWithState(step, "video string, frame long, diff double", "frame long, level double", "append", GroupStateTimeout.NoTimeout)
