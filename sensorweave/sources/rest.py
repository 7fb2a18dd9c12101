"""Paged REST feeds as a Spark data source, with retries, windows that are halved when they fail, and replay from files.

Registered as `sensor_rest`. Options: `pages` (a folder of recorded answers, for replay and tests) or
`url` with `sensors` (comma-joined), `start`, `end` and `spacing` (seconds between calls); a partition is a sensor (or a recorded file).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sensor_id long, ts timestamp, value double, flagged boolean"
#: Rows of a full page, shortest window that is still halved, attempts and longest wait.
PAGE, SHORTEST, ATTEMPTS, LONGEST_WAIT = 1000, timedelta(days=7), 4, 60.0


class FeedError(RuntimeError):
    """An answer that is none; `wait` is what the server asks for, `lasting` says that asking again won't help."""

    def __init__(self, text: str, wait: float | None = None, lasting: bool = False):
        super().__init__(text)
        self.wait, self.lasting = wait, lasting


def with_retries(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer of one of ATTEMPTS calls; waits as long as asked, else twice as long each time."""
    for k in range(ATTEMPTS):
        try:
            return call()
        except FeedError as e:
            if k + 1 == ATTEMPTS or e.lasting:
                raise
            sleep(min(LONGEST_WAIT, e.wait if e.wait is not None else 2.0**k))
    raise AssertionError


def paged(fetch: Callable[[int], dict]) -> Iterator[dict]:
    """Results of page 1, 2, ... up to the first short one."""
    page = 1
    while True:
        rows = fetch(page).get("results") or []
        yield from rows
        if len(rows) < PAGE:
            return
        page += 1


def by_offset(fetch: Callable[[int, int], list[dict]], size: int = PAGE) -> Iterator[dict]:
    """Records from offset 0 on, `size` at a time, up to the first short answer."""
    at = 0
    while rows := fetch(at, size):
        yield from rows
        if len(rows) < size:
            return
        at += size


def located(fetch: Callable[[int], dict], box: tuple[float, float, float, float]) -> Iterator[tuple]:
    """(id, name, lat, lon) of the paged locations within a box (lon, lat, lon, lat); the first of an id wins."""
    seen = set()
    for row in paged(fetch):
        lat, lon = _at(row, "coordinates", "latitude"), _at(row, "coordinates", "longitude")
        inside = lat is not None and lon is not None and box[1] <= lat <= box[3] and box[0] <= lon <= box[2]
        if inside and row.get("id") not in seen:
            seen.add(row.get("id"))
            yield row.get("id"), row.get("name"), float(lat), float(lon)


def within_budget(ids: list, fetch: Callable[[object], list], seconds: float, clock: Callable[[], float] = time.monotonic) -> tuple[list, list]:
    """Rows of each id in turn, and the ids that the time did not reach or that failed."""
    rows, left, end = [], [], clock() + seconds
    for i in ids:
        try:
            if clock() >= end:
                raise TimeoutError
            rows += fetch(i)
        except (FeedError, TimeoutError):
            left.append(i)
    return rows, left


def spaced(fetch: Callable, seconds: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable:
    """fetch, never called sooner than `seconds` after its last call began."""
    last: list[float] = []

    def call(*args):
        if last and (wait := last[0] + seconds - clock()) > 0:
            sleep(wait)
        last[:] = [clock()]
        return fetch(*args)

    return call


def windowed(fetch: Callable[[datetime, datetime], list[dict]], start: datetime, end: datetime) -> list[dict]:
    """The span's rows; a failing span is halved until SHORTEST, hours that both halves have come once."""
    try:
        return fetch(start, end)
    except FeedError:
        if end - start <= SHORTEST:
            raise
    middle = start + (end - start) / 2
    seen, out = set(), []
    for row in windowed(fetch, start, middle) + windowed(fetch, middle, end):
        at = stamp(row)
        if at not in seen:
            seen.add(at)
            out.append(row)
    return out


def _at(row: dict, *path: str):
    """What stands under a path of keys; None where it breaks off."""
    for key in path:
        row = row.get(key) if isinstance(row, dict) else None
    return row


def stamp(row: dict) -> str | None:
    return _at(row, "period", "datetimeFrom", "utc")


def parsed(sensor: int, row: dict) -> tuple | None:
    """A reading; None without a time or with one that can't be read. A value that is no number is null."""
    try:
        ts = datetime.fromisoformat(stamp(row) or "")
    except ValueError:
        return None
    try:
        value = float(row["value"])
    except (KeyError, TypeError, ValueError):
        value = None
    return sensor, ts, value, _at(row, "flagInfo", "hasFlags") is True


class Part(InputPartition):
    def __init__(self, sensor: int, path: str | None = None):
        self.sensor, self.path = sensor, path


class SensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Part]:
        if folder := self.options.get("pages"):
            return [Part(int(f.split("-")[0]), os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".json")]
        return [Part(int(s)) for s in self.options["sensors"].split(",")]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path:
            with open(part.path) as f:
                rows = json.load(f).get("results") or []
        else:
            rows = windowed(lambda a, b: self._span(part.sensor, a, b), datetime.fromisoformat(self.options["start"]), datetime.fromisoformat(self.options["end"]))
        for row in rows:
            if (x := parsed(part.sensor, row)) is not None:
                yield x

    def _span(self, sensor: int, a: datetime, b: datetime) -> list[dict]:
        from urllib.error import HTTPError, URLError
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        def call(page: int) -> dict:
            query = urlencode({"datetime_from": a.isoformat(), "datetime_to": b.isoformat(), "limit": PAGE, "page": page})
            try:
                with urlopen(Request(f"{self.options['url']}/sensors/{sensor}/hours?{query}", headers={"X-API-Key": self.options.get("key", "")}), timeout=30) as f:
                    return json.load(f)
            except HTTPError as e:
                raise FeedError(str(e), float(e.headers.get("x-ratelimit-reset", 1)) if e.code == 429 else None, 400 <= e.code < 500 and e.code not in (408, 429)) from e
            except (URLError, TimeoutError) as e:
                raise FeedError(str(e)) from e

        one = spaced(call, float(self.options.get("spacing", 0)))
        return list(paged(lambda page: with_retries(lambda: one(page))))


class SensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SensorReader:
        return SensorReader(self.options)


def first_that_answers(*sources: Callable[[], list]) -> tuple[list, str]:
    """Rows of the first source that has any, and the failures before it; never raises."""
    errors = []
    for source in sources:
        try:
            if rows := source():
                return rows, "; ".join(errors)
            errors.append("no rows")
        except Exception as e:  # noqa: BLE001  a failure is a value here
            errors.append(str(e))
    return [], "; ".join(errors)
