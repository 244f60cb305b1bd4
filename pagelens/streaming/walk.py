"""The slide walk as a state machine over recorded polls of a page: one step function, run over a batch or a stream.

A poll is what the page looked like at one look: (page_id, seq, at: timestamp, elapsed_ms, url, signature, has_next,
has_previous, images, extra, source). images: array of (url, origin) that a sweep finds; extra: what a full sweep finds
besides (backgrounds); source: URLs of the source. The first poll of a page begins its walk; each later one comes after a
click, some 20 ms after the one before.

A step ends when the signature has changed or after 120 ms. The walk ends at a change of page, at 30 steps of a pass,
at 900 ms, when no control is left, or at 1,200 ms, whatever it is at; it then sweeps in full and reads the source with
the numbering that it has just then, so that a walk that ends going back puts those finds first.

Results: (page_id, n, kind, url, origin, order, text): an ``image`` at its first sight, or a ``note`` of the log.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import _parse_datatype_string

from ..config import DEFAULT, ExtractConfig

RESULT = "page_id bigint, n int, kind string, url string, origin string, order bigint, text string"
# Waits and limits in ms, and texts as users of the log know them.
POLL_MS, SETTLE_MS, BACKSTOP_MS, BLOCK = 20, 120, 1200, 1000
LABELS = {"previous": "前へ", "next": "次へ"}
NOT_HERE = "カルーセル送りの対象サイトではないため実行しない"
LEFT = "[ERR] クリックでページが遷移したため中断"
LIMIT = "上限に達したため終了 (%s %d回送り)"
NO_CONTROL, CONTROL_GONE = "「%s」ボタンが無いため送りは未実行", "「%s」ボタンが消えたため終了 (%d回送り)"
THEN, STEP, TIME_UP = "%s / %sへ", "%s%d回目: +%d件 %dms", "時間切れ"

Put = Callable[[str], bool]


class Walk:
    """One page's walk. ``state`` holds what it knows besides the URLs seen, as plain values."""

    def __init__(self, state: dict | None, put: Put, config: ExtractConfig = DEFAULT):
        self.put, self.config, self.ui = put, config, re.compile(config.ui_asset)
        self.state = state or {"stage": "new", "n": 0, "forward": 0, "block": 0, "within": 0, "found": 0}
        self.rows: list[tuple] = []

    @property
    def over(self) -> bool:
        return self.state["stage"] == "over"

    def _emit(self, kind: str, url=None, origin=None, order=None, text=None) -> None:
        self.rows.append((self.state["n"], kind, url, origin, order, text))
        self.state["n"] += 1

    def _sweep(self, images: list) -> None:
        s = self.state
        for url, origin in images:
            if not url or self.ui.search(url) or not self.put(url):
                continue
            if s["block"]:
                order, s["within"] = s["within"] - s["block"] * BLOCK, s["within"] + 1
            else:
                order, s["forward"] = s["forward"], s["forward"] + 1
            s["found"] += 1
            self._emit("image", url, origin or "dom", order)

    def _hand_off(self, reason: str, poll: dict) -> None:
        self._sweep(poll["images"] + poll["extra"])
        self._emit("note", text=reason)
        self._sweep([(u, "source") for u in poll["source"]])
        self.state = {"stage": "over", "n": self.state["n"]}

    def _label(self) -> str:
        return LABELS[self.state["passes"][self.state["pass"]]]

    def _begin_pass(self) -> None:
        s = self.state
        s.update(steps=0, within=0, block=int(s["passes"][s["pass"]] == "previous"))

    def _step(self, poll: dict) -> None:
        """Clicks, or ends the pass or the walk."""
        s = self.state
        while True:
            if s["steps"] >= self.config.max_steps or poll["elapsed_ms"] > self.config.budget_ms:
                return self._hand_off(LIMIT % (self._label(), s["steps"]), poll)
            if poll[f"has_{s['passes'][s['pass']]}"]:
                break
            reason = CONTROL_GONE % (self._label(), s["steps"]) if s["steps"] else NO_CONTROL % self._label()
            if s["pass"] + 1 == len(s["passes"]):
                return self._hand_off(reason, poll)
            s["pass"] += 1
            self._emit("note", text=THEN % (reason, self._label()))
            self._begin_pass()
        s.update(stage="settling", before=poll["signature"], waited=0, since=s["found"], steps=s["steps"] + 1)
        if s["block"]:
            s.update(block=s["steps"], within=0)

    def see(self, poll: dict) -> None:
        s = self.state
        if s["stage"] == "over":
            return
        if s["stage"] == "new":
            at = urlsplit(poll["url"] or "")
            slide = re.search(r"[?&]img_index=(\d+)", poll["url"] or "")
            s.update(identity=identity(poll["url"]), passes=["previous", "next"] if slide and int(slide[1]) >= 3 else ["next"], **{"pass": 0})
            self._sweep(poll["images"] + poll["extra"])
            if not any((at.hostname or "") == h or (at.hostname or "").endswith("." + h) for h in self.config.carousel_hosts):
                return self._hand_off(NOT_HERE, poll)
            self._begin_pass()
            return self._step(poll)
        s["waited"] += POLL_MS
        if identity(poll["url"]) != s["identity"]:
            return self._hand_off(LEFT, poll)
        if poll["signature"] == s["before"] and s["waited"] < SETTLE_MS:
            return None
        self._sweep(poll["images"])
        self._emit("note", text=STEP % (self._label(), s["steps"], s["found"] - s["since"], s["waited"]))
        return self._step(poll)

    def time_up(self, poll: dict) -> None:
        if not self.over:
            self._hand_off(TIME_UP, poll)


def identity(url: str | None) -> str:
    return re.sub(r"[?#].*$", "", url or "", flags=re.S)


def _polls(frame: pd.DataFrame) -> Iterator[dict]:
    pairs = lambda v: [(x["url"], x["origin"]) for x in v] if v is not None else []
    for r in frame.sort_values(["elapsed_ms", "seq"], kind="stable").to_dict("records"):
        yield {"elapsed_ms": int(r["elapsed_ms"]), "url": r["url"], "signature": r["signature"], "has_next": bool(r["has_next"]), "has_previous": bool(r["has_previous"]), "images": pairs(r["images"]), "extra": pairs(r["extra"]), "source": list(r["source"]) if r["source"] is not None else []}


def _frame(key: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(key, *r) for r in rows], columns=[c.split()[0] for c in RESULT.split(", ")])
    return out.astype({"order": "Int64"})


def _in_time(polls: DataFrame) -> DataFrame:
    """Polls that a walk can still see: what comes after the backstop doesn't count, and bounds what a page holds."""
    known = polls.where(F.col("page_id").isNotNull() & (F.col("elapsed_ms") <= BACKSTOP_MS))
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_next", "has_previous")})


def walked(polls: DataFrame, config: ExtractConfig = DEFAULT) -> DataFrame:
    """The walks of recorded pages, whole. A page's polls are one group: some 60, as a walk has 1,200 ms."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        walk, last = Walk(None, lambda u: not (u in seen or seen.add(u)), config), None
        for last in _polls(frame):
            walk.see(last)
            if walk.over:
                break
        walk.time_up(last)
        return _frame(key[0], walk.rows)

    return _in_time(polls).drop("at").groupBy("page_id").applyInPandas(run, RESULT)


class _Walks(StatefulProcessor):
    """State of a page: its walk as JSON with the last poll, and the URLs seen. Both go when the walk is over; a mark
    that it is over stays for ten minutes of event time, as later polls are no new walk."""

    KEPT_MS = 600_000

    def __init__(self, config: ExtractConfig):
        self.config = config

    def init(self, handle) -> None:
        self.handle = handle
        self.walk = handle.getValueState("walk", "json string")
        self.seen = handle.getMapState("seen", "url string", "yes boolean")

    def _put(self, url: str) -> bool:
        if self.seen.containsKey((url,)):
            return False
        self.seen.updateValue((url,), (True,))
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        held = json.loads(self.walk.get()[0]) if self.walk.exists() else None
        if held is None:
            first = int((frame["at"] - pd.to_timedelta(frame["elapsed_ms"], unit="ms")).min().timestamp() * 1000)
            self.handle.registerTimer(first + BACKSTOP_MS)
            held = {"state": None, "last": None, "first": first}
        walk = Walk(held["state"], self._put, self.config)
        for poll in _polls(frame):
            if walk.over:
                break
            walk.see(poll)
            held["last"] = poll
        yield self._save(key, walk, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.walk.get()[0]) if self.walk.exists() else None
        if held is None or expiredTimerInfo.getExpiryTimeInMs() > held["first"] + BACKSTOP_MS:
            self.walk.clear()
            yield _frame(key[0], [])
            return
        walk = Walk(held["state"], self._put, self.config)
        walk.time_up(held["last"])
        yield self._save(key, walk, held)

    def _save(self, key, walk: Walk, held: dict) -> pd.DataFrame:
        held["state"] = walk.state
        if walk.over:
            held["last"] = None
            self.seen.clear()
            self.handle.registerTimer(held["first"] + self.KEPT_MS)
        self.walk.update((json.dumps(held),))
        return _frame(key[0], walk.rows)

    def close(self) -> None:
        pass


def walking(polls: DataFrame, config: ExtractConfig = DEFAULT, delay: str = "0 seconds") -> DataFrame:
    """The same of a stream, rows of each page coming in order. Needs the RocksDB state store.

    The backstop is a timer in event time, so a page whose polls cease is handed over once the watermark has passed it.
    """
    rows = _in_time(polls).withWatermark("at", delay)
    return rows.groupBy("page_id").transformWithStateInPandas(_Walks(config), _parse_datatype_string(RESULT), "Append", "eventTime")
