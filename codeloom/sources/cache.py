"""Frames that a client reads again and again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class FetchCache:
    """Keeps what a route gave for some time; of several routes the first that works counts."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock = seconds, clock
        self._kept: dict[str, tuple[float, DataFrame]] = {}

    def fetch(self, key: str, *routes: Callable[[], DataFrame]) -> DataFrame:
        """The kept frame of a key, or that of the first route that plans; if none does, the last one's error."""
        now = self.clock()
        if key in self._kept:
            since, frame = self._kept[key]
            if now - since < self.seconds:
                return frame
            self.drop(key)
        error: Exception | None = None
        for route in routes:
            try:
                frame = route()
                frame.schema  # noqa: B018  plans now
            except Exception as problem:  # noqa: BLE001  the next route is tried
                error = problem
                continue
            self._kept[key] = now, frame.cache()
            return frame
        raise error or LookupError(f"no route for {key}")

    def drop(self, key: str) -> None:
        self._kept.pop(key)[1].unpersist()
