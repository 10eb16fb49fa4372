"""Bands that arrive one by one: masks handed on between micro-batches.

Input rows are (blob_id, band, content), in order of band within a key. The state of a key
is the last mask and family, so a band that needs its predecessor's mask is decoded also
if that came in an earlier batch. It is one row a key, however long the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.codec import reading
from rasterloom.codec.model import RasterError
from rasterloom.functions.blobs import ERROR

OUT = f"blob_id long, band int, values array<double>, valid binary, {ERROR}"


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    family, mask = state.get if state.exists else (0, None)
    mask = None if mask is None else np.frombuffer(mask, np.uint8) != 0
    rows = []
    for frame in frames:
        for blob_id, band, content in frame.sort_values("band")[["blob_id", "band", "content"]].itertuples(index=False):
            try:
                own = reading.family(content)
                info, values, found = reading.decode(content, mask if own == family else None)
                family, mask = own, found
                rows.append((blob_id, band, values.reshape(-1), None if found is None else found.astype(np.uint8).tobytes(), None, None))
            except RasterError as e:
                rows.append((blob_id, band, None, None, e.kind, e.message))
    state.update((family, None if mask is None else mask.astype(np.uint8).tobytes()))
    yield pd.DataFrame(rows, columns=["blob_id", "band", "values", "valid", "error_kind", "error_message"])


def decode_stream(bands: DataFrame) -> DataFrame:
    """Samples of each band as it arrives; errors are rows and leave the state as it was."""
    keyed = bands.select("blob_id", "band", "content").groupBy("blob_id")
    return keyed.applyInPandasWithState(_step, OUT, "family int, mask binary", "append", GroupStateTimeout.NoTimeout)
