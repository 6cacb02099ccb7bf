"""Running sums over a stream of vectors: an extension, as sums of partitions merge whenever they come.

    sums = RunningSums()
    query = sums.start(stream_of_id_and_v, checkpoint)     # foreachBatch
    sums.count, sums.total, sums.gram                       # so far

Every micro-batch is one vectors.vector_products; only its D x D sums meet on the driver. A batch that is delivered
again after a failure is known by its number and not added twice while this object lives; `state` and `restore`
carry the sums over a restart together with the last number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from loom.operators.vectors import vector_products


class RunningSums:
    def __init__(self) -> None:
        self.count, self.total, self.gram, self.last = 0, None, None, -1

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds the rows (id, v) of micro-batch `number`, once."""
        if number <= self.last:
            return
        n, s, g = vector_products(batch.select("v"))
        if n:
            self.count += n
            self.total = s if self.total is None else self.total + s
            self.gram = g if self.gram is None else self.gram + g
        self.last = number

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def covariance(self) -> np.ndarray:
        """Uncentred: sum of outer products over the number of rows."""
        if not self.count:
            raise ValueError("no rows so far")
        return self.gram / self.count

    def state(self) -> dict:
        return {"count": self.count, "last": self.last, "total": None if self.total is None else self.total.tolist(), "gram": None if self.gram is None else self.gram.tolist()}

    @classmethod
    def restore(cls, state: dict) -> "RunningSums":
        out = cls()
        out.count, out.last = state["count"], state["last"]
        out.total, out.gram = (None if state[k] is None else np.array(state[k]) for k in ("total", "gram"))
        return out
