"""A live feed as a streaming source with a fallback, registered as `sensor_feed`.

Each batch is one poll. The driver asks the primary for its first page, which tells the number of records, and plans a partition for each page;
where the primary fails, it plans one for each place of the fallback. Tasks share a budget of calls: a poll has at most
`calls` of them, its partitions share what the plan leaves, and `spacing` seconds lie between calls whatever the number of tasks, as each
waits its turn. The fallback has a limit of `seconds`: a place whose turn comes later is left out. What was left out, or failed, comes as rows
that name the error; a poll never fails the stream.

Rows are texts as sent (place, stamp, value, source, error); `readings` turns them into values. Options: `replay` (a folder with a folder of
recorded answers for each poll: primary-<offset>.json and place-<id>.json, no file being a failure), or `url` (and `key`, `fallback_url`), with `places`
(comma-joined), `every` (seconds between polls), `page`, `calls`, `spacing`, `seconds`. Offsets are numbers of polls.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import indices
from .rest import FeedError, _at, with_retries

FEED_SCHEMA = "poll long, place string, stamp string, value string, source string, error string"
#: Records of a page, calls of a poll, seconds between calls, seconds of the fallback, seconds between polls.
DEFAULTS = {"page": 1000, "calls": 60, "spacing": 0.0, "seconds": 20.0, "every": 900}


class Replay:
    """Recorded answers of a poll."""

    def __init__(self, folder: str, poll: int):
        self.folder = os.path.join(folder, str(poll))

    def get(self, name: str) -> dict:
        try:
            with open(os.path.join(self.folder, f"{name}.json")) as f:
                answer = json.load(f)
        except OSError as e:
            raise FeedError(f"{name}: no answer", lasting=True) from e
        if "error" in answer:
            raise FeedError(str(answer["error"]), lasting=bool(answer.get("lasting")))
        return answer

    def page(self, offset: int, size: int) -> dict:
        return self.get(f"primary-{offset}")

    def place(self, name: str) -> dict:
        return self.get(f"place-{name}")


class Http:
    """The feeds themselves."""

    def __init__(self, options: dict):
        self.options = options

    def get(self, url: str, **query) -> dict:
        from urllib.error import HTTPError, URLError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        try:
            with urlopen(f"{url}?{urlencode(query)}", timeout=10) as f:
                answer = json.load(f)
        except HTTPError as e:
            raise FeedError(str(e), float(e.headers.get("x-ratelimit-reset", 1)) if e.code == 429 else None, 400 <= e.code < 500 and e.code not in (408, 429)) from e
        except (URLError, TimeoutError, ValueError) as e:
            raise FeedError(str(e)) from e
        if answer.get("status") not in (None, "ok"):
            raise FeedError(str(answer.get("data")), lasting=True)
        return answer

    def page(self, offset: int, size: int) -> dict:
        return self.get(self.options["url"], **{"api-key": self.options.get("key", ""), "format": "json", "limit": size, "offset": offset})

    def place(self, name: str) -> dict:
        return self.get(f"{self.options['fallback_url']}/{name}/", token=self.options.get("fallback_key", "")).get("data") or {}


class Part(InputPartition):
    """A page (offset) or a place of a poll, and its share: calls, turn among the poll's tasks, end of the fallback's time."""

    def __init__(self, poll: int, kind: str, at, calls: int = 1, turn: int = 0, turns: int = 1, end: float | None = None, held: list | None = None, error: str | None = None):
        self.poll, self.kind, self.at, self.calls, self.turn, self.turns, self.end, self.held, self.error = poll, kind, at, calls, turn, turns, end, held, error


def _limited(call: Callable[[], dict], part: Part, spacing: float, sleep: Callable, clock: Callable) -> dict:
    """One of the part's calls that answers; the n-th of a task's calls starts `spacing` times the tasks after the one before, the first at its turn."""
    made: list[int] = []

    def one() -> dict:
        if part.end is not None and clock() >= part.end:
            raise FeedError("out of time", lasting=True)
        if len(made) >= part.calls:
            raise FeedError("no answer within the budget of calls", lasting=True)
        sleep(spacing * (part.turn if not made else part.turns))
        made.append(1)
        return call()

    return with_retries(one, lambda s: sleep(0 if spacing else s))


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time):
        self.options = dict(options)
        number = {k: type(v)(float(self.options.get(k, v))) for k, v in DEFAULTS.items()}
        self.page, self.calls, self.spacing, self.seconds, self.every = (number[k] for k in DEFAULTS)
        self.places = [p for p in self.options.get("places", "").split(",") if p]
        self.sleep, self.clock = sleep, clock

    def _feed(self, poll: int) -> Replay | Http:
        return Replay(self.options["replay"], poll) if "replay" in self.options else Http(self.options)

    def initialOffset(self) -> dict:
        return {"poll": 0 if "replay" in self.options else int(self.clock() // self.every) - 1}

    def latestOffset(self) -> dict:
        if folder := self.options.get("replay"):
            return {"poll": sum(1 for x in os.listdir(folder) if x.isdigit())}
        return {"poll": int(self.clock() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """A plan of the newest poll, for a live feed; of each recorded one, for a replay."""
        polls = range(start["poll"], end["poll"]) if "replay" in self.options else range(end["poll"] - 1, end["poll"])
        return [p for poll in polls for p in self.planned(poll)]

    def planned(self, poll: int) -> list[Part]:
        first = Part(poll, "page", 0, max(1, min(4, self.calls // 2)))
        feed = self._feed(poll)
        try:
            answer = _limited(lambda: feed.page(0, self.page), first, self.spacing, self.sleep, self.clock)
            records = answer.get("records") or []
            if not records:
                raise FeedError("no records")
        except FeedError as e:
            return self._fallback(poll, str(e), self.calls - first.calls)
        total = int(answer.get("total", len(records)))
        offsets = list(range(self.page, total, self.page))
        some, rest = offsets[: self.calls - first.calls], offsets[self.calls - first.calls :]
        share = max(1, (self.calls - first.calls) // max(1, len(some)))
        parts = [Part(poll, "page", k, share, i, len(some)) for i, k in enumerate(some)]
        return [Part(poll, "held", 0, held=records), *parts, *[Part(poll, "error", k, error=f"page at {k} beyond the budget of calls") for k in rest]]

    def _fallback(self, poll: int, error: str, calls: int) -> list[Part]:
        end = self.clock() + self.seconds
        some, rest = self.places[: max(0, calls)], self.places[max(0, calls) :]
        share = max(1, calls // max(1, len(some)))
        parts = [Part(poll, "place", p, share, i, len(some), end) for i, p in enumerate(some)]
        return [Part(poll, "error", None, error=f"primary: {error}"), *parts, *[Part(poll, "error", p, error=f"{p} beyond the budget of calls") for p in rest]]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.kind == "error":
            yield part.poll, str(part.at) if part.at is not None else None, None, None, None, part.error
            return
        feed = self._feed(part.poll)
        try:
            if part.kind == "place":
                row = _limited(lambda: feed.place(part.at), part, self.spacing, self.sleep, self.clock)
                value = _at(row, "iaqi", "pm25", "v")
                yield part.poll, str(part.at), _at(row, "time", "iso"), None if value is None else str(value), "fallback", None
                return
            records = part.held if part.held is not None else _limited(lambda: feed.page(part.at, self.page), part, self.spacing, self.sleep, self.clock).get("records") or []
        except FeedError as e:
            yield part.poll, str(part.at), None, None, "fallback" if part.kind == "place" else "primary", str(e)
            return
        for r in records:
            field = lambda *names: next((str(r[k]) for k in names if r.get(k) is not None), None)  # noqa: E731, B023
            if (code := field("pollutant_id", "pollutant")) is None or code.upper().translate({46: None, 95: None}) == "PM25":
                yield part.poll, field("station", "place"), field("last_update"), field("avg_value", "pollutant_avg", "value"), "primary", None


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_feed"

    def schema(self) -> str:
        return FEED_SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def _valued(rows: DataFrame) -> DataFrame:
    """rows with ts and number, both as values; number is null where a row carries no usable one."""
    local_ = F.to_utc_timestamp(F.try_to_timestamp("stamp", F.lit("dd-MM-yyyy HH:mm:ss")), "Asia/Kolkata")
    ts = F.when(F.col("source") == "primary", local_).otherwise(F.expr("try_cast(stamp as timestamp)"))
    number = indices.number(F.col("value"))
    value = F.when(F.col("error").isNull(), F.when(F.col("source") == "primary", number).otherwise(indices.concentration_of(number)))
    return rows.select("poll", "place", ts.alias("ts"), value.alias("value"), "source", "error")


def readings(rows: DataFrame) -> DataFrame:
    """(poll, place, ts, value, source) of the rows that carry a usable value: local stamps to UTC, numbers of the primary as they are, indices of the fallback as concentrations."""
    return _valued(rows).where("value is not null").drop("error")


def status(rows: DataFrame, places: int, now: Column, stale: int = 6) -> DataFrame:
    """A row a poll: ok, source, reporting, places, observed, and the errors; a poll is ok if a place reports and its newest reading is at most `stale` hours old."""
    good = lambda c: F.when(F.col("value").isNotNull(), F.col(c))
    out = _valued(rows).groupBy("poll").agg(
        F.max(good("source")).alias("source"), F.count_distinct(good("place")).alias("reporting"), F.max(good("ts")).alias("observed"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors")
    )
    error = F.when(F.col("reporting") == 0, "no place reports a value").when(F.col("observed") < now - F.make_dt_interval(hours=F.lit(stale)), "the newest reading is not current")
    return out.select("poll", error.isNull().alias("ok"), "source", "reporting", F.lit(places).alias("places"), "observed", F.concat_ws("; ", F.nullif(F.col("errors"), F.lit("")), error).alias("error"))
