"""The visible set as a stream: images, their true sizes as they become known, and saves change what is shown.

Events: (id, at, kind, origin, width, height). An ``image`` brings its origin and the size that the page says, a
``size`` the true one, ``saved`` takes it out. A change is a row (id, change, longest_side): 1 for an image that comes
into view, -1 for one that leaves it, both when its size changes in view. The sum of changes of an image says whether it
is shown, so a table of results is kept up by adding, and equals what operators.view.visible says of the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import _parse_datatype_string

from ..operators.view import Gates

CHANGES = "id bigint, change int, longest_side int"
_CELL = "origin string, page_side int, true_side int, saved boolean, shown int, until bigint"
DAY_MS = 86_400_000


def _shut(gates: Gates) -> frozenset[str]:
    return frozenset(o for o, on in (("source", gates.source_only), ("video", gates.video_posters), ("meta", gates.meta_images), ("other", gates.other_posts)) if not on)


class _Cells(StatefulProcessor):
    """State of an image: what is known of it, and the side that it is shown with. It goes a while after its last event,
    by a timer in event time; each event sets the timer anew."""

    def __init__(self, gates: Gates, kept_ms: int):
        self.shut, self.least, self.kept_ms = _shut(gates), gates.least_pixels, kept_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", _CELL)

    def _side(self, origin, page_side, true_side, saved) -> int | None:
        """The longest side if the image is in view, 0 if that isn't known; None if it isn't in view."""
        if page_side is None or saved or (origin or "dom") in self.shut:
            return None
        side = page_side if true_side is None else true_side
        return side if side == 0 or side >= self.least else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        origin, page_side, true_side, saved, shown, until = self.cell.get() if self.cell.exists() else (None, None, None, False, None, None)
        out, frame = [], pd.concat(list(rows))
        if until is not None:
            self.handle.deleteTimer(until)
        until = max(until or 0, int(frame["at"].max().timestamp() * 1000) + self.kept_ms)
        self.handle.registerTimer(until)
        longest = lambda r: max((int(v) for v in (r["width"], r["height"]) if not pd.isna(v)), default=0)
        for r in frame.sort_values("at", kind="stable").to_dict("records"):
            if r["kind"] == "image":
                origin, page_side = r["origin"], longest(r)
            elif r["kind"] == "size":
                true_side = longest(r)
            elif r["kind"] == "saved":
                saved = True
        now = self._side(origin, page_side, true_side, saved)
        if now != shown:
            out += [(key[0], -1, shown)] if shown is not None else []
            out += [(key[0], 1, now)] if now is not None else []
        self.cell.update((origin, page_side, true_side, saved, now, until))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cell.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "change", "longest_side"]).astype({"id": "int64", "change": "int32", "longest_side": "int32"})


def changes(events: DataFrame, gates: Gates = Gates(), kept_ms: int = DAY_MS, delay: str = "10 minutes") -> DataFrame:
    """events: a stream, ``at`` a timestamp. Needs the RocksDB state store. An image without an event for ``kept_ms`` is
    forgotten; if it comes again it counts as new."""
    rows = events.where("id IS NOT NULL").withWatermark("at", delay)
    return rows.groupBy("id").transformWithStateInPandas(_Cells(gates, kept_ms), _parse_datatype_string(CHANGES), "Append", "eventTime")
