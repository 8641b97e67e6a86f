"""A visitor called on every node of a tree in order, stopping at its first error."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.distributed import number_rows, single_value
from corpusloom.session import store

_SCHEMA = "position long, idx long, url string, value string, error string"


def visit_nodes(tree: DataFrame, visitor: Callable[[dict], str | None], breadth_first: bool = False) -> DataFrame:
    """``position, idx, url, value, error`` of the visited nodes of a tree.

    ``visitor`` gets a node's columns by name; what it returns is ``value``. Nodes come in depth-first or
    breadth-first order, each task working on one range of positions. The first exception ends the visit: its node is
    the last row and carries the message in ``error``. Ranges behind it may have begun by then, so effects outside of
    the result have to bear repetition, as with any retried task; their rows are not in the result.
    """
    order = [F.col(c) for c in (["level", "order_key"] if breadth_first else ["order_key"])]
    nodes = number_rows(tree.filter("reachable"), order, "position").drop("order_key", "reachable")

    def visit(batches):
        for batch in batches:
            done = {name: [] for name in ("position", "idx", "url", "value", "error")}
            for row in batch.to_pylist():
                value = error = None
                try:
                    value = visitor({k: v for k, v in row.items() if k != "position"})
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
                for name, cell in zip(done, (row["position"], row["idx"], row["url"], value, error)):
                    done[name].append(cell)
                if error is not None:
                    break
            yield pa.RecordBatch.from_pydict(done, schema=_ARROW)
            if done["error"] and done["error"][-1] is not None:
                return

    ranged = nodes.repartitionByRange("position").sortWithinPartitions("position")
    visited = store(ranged.mapInArrow(visit, _SCHEMA), "visited-nodes")
    stop = single_value(visited.where("error IS NOT NULL"), F.min("position"))
    return visited.where(F.col("position") <= F.coalesce(stop, F.col("position")))


_ARROW = pa.schema(
    [("position", pa.int64()), ("idx", pa.int64()), ("url", pa.string()), ("value", pa.string()), ("error", pa.string())]
)
