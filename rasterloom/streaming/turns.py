"""Bands of many sets that arrive in any order, each decoded when its turn comes.

State by set: the number of the next band with the mask that is handed on to it, and bands that came too early,
still compressed. Both expire after a time without use, so that sets that never end, or never begin, don't stay.
The session needs a state store for this (``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterloom.codec import bands, reading
from rasterloom.codec.model import RasterError
from rasterloom.functions.blobs import ERROR, INFO, INFO_NAMES, info_row

HOUR_MS = 3_600_000


class InTurn(StatefulProcessor):
    """names: of the key's column and of the output's. Two rows of one band: the first that is seen counts."""

    def __init__(self, names: list[str], keep_ms: int):
        self.names, self.keep_ms = names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "band int, family int, mask binary", self.keep_ms)
        self.early = handle.getMapState("early", "band int", "content binary", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn = self.next.get() if self.next.exists() else (0, 0, None)
        turn, family, mask = int(turn[0]), int(turn[1]), turn[2]
        out = []
        for frame in rows:
            for band, content in zip(frame["band"], frame["content"]):
                if pd.isna(band) or content is None:
                    out.append(self._row(key, None if pd.isna(band) else int(band), None, RasterError("InvalidArgument", "a row without a band or content")))
                elif band < turn:
                    out.append(self._row(key, int(band), None, RasterError("InvalidArgument", "the band's turn is over")))
                elif not self.early.containsKey((int(band),)):
                    self.early.updateValue((int(band),), (bytes(content),))
        start = turn
        while self.early.containsKey((turn,)):
            content = bytes(self.early.getValue((turn,))[0])
            self.early.removeKey((turn,))
            try:
                own = reading.family(content)
                inherited = None if mask is None or family != own else np.frombuffer(mask, np.uint8) != 0
                b = bands.decode(content, inherited)
                family, mask = own, None if b.mask is None else b.mask.astype(np.uint8).tobytes()
                out.append(self._row(key, turn, b, None))
            except RasterError as e:
                family, mask = 0, None
                out.append(self._row(key, turn, None, e))
            turn += 1
        if turn != start:
            self.next.update((turn, family, mask))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def _row(self, key, band, b, error):
        info = info_row(None if b is None else b.info, error)
        values = None if b is None else b.values.reshape(-1)
        mask = None if b is None or b.mask is None else b.mask.astype(np.uint8).tobytes()
        return [key[0], band, values, mask, *[info[n] for n in INFO_NAMES], info["error_kind"], info["error_message"]]

    def close(self) -> None:
        pass


def decode_in_turn(stream: DataFrame, key: str = "blob_id", keep_ms: int = HOUR_MS) -> DataFrame:
    """key, band, values, valid, metadata or error of bands (key, band, content) that arrive in any order.

    A band is decoded once all before it (from 0) were, with the mask that they hand on; until then it is held. A
    band that can't be decoded hands on no mask. A band that comes again after its turn, or without a number or content,
    is an error row. Sets unused for keep_ms are forgotten, with what they hold. The key may be of any type.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, band int, values array<double>, valid binary, {INFO}, {ERROR}"
    names = [key, "band", "values", "valid", *INFO_NAMES, "error_kind", "error_message"]
    rows = stream.select(key, "band", "content").groupBy(key)
    return rows.transformWithStateInPandas(statefulProcessor=InTurn(names, keep_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
