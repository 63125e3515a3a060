"""Stateful operators: circuit breaker, seen set, windows and sessions.

The circuit breaker is one step function over a small state. In batch the rows are sorted by key and time inside
partitions and folded in one pass of constant memory; in a stream the same step runs in ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, WINDOW_S, OPEN_S = 5, 60.0, 30.0


def breaker_step(state: tuple, ts: float, ok: bool) -> tuple[tuple, str, bool]:
    """(state, name, let through): closed; open after five failures in a minute; after half a minute one probe.

    State: name, times of recent failures, time of opening."""
    name, fails, opened = state
    if name == "open" and ts - opened >= OPEN_S:
        name = "half_open"
    if name == "open":
        return (name, fails, opened), name, False
    if ok:
        return ("closed", (), 0.0), "closed", True
    if name == "half_open":
        return ("open", (), ts), "open", True
    fails = (*[f for f in fails if ts - f < WINDOW_S], ts)
    if len(fails) >= FAILURES:
        return ("open", (), ts), "open", True
    return ("closed", fails, 0.0), "closed", True


CLOSED = ("closed", (), 0.0)


def ema_step(state: float | None, value: float, old: float = 0.7) -> float:
    return value if state is None else state * old + value * (1 - old)


def fold(df: DataFrame, key: str, order: list[str], cols: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """Rows of each key in order through ``step(state, row) -> (state, values)``. A key's rows stream through one
    task one batch at a time; only its state is held."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k != now:
                    now, state = k, start()
                state, values = step(state, r)
                rows.append((k, *values))
            yield pd.DataFrame(rows, columns=names)

    picked = df.where(F.col(key).isNotNull()).select(key, *[c for c in dict.fromkeys([*order, *cols]) if c != key])
    return picked.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, out)


def circuit_breaker(events: DataFrame, key: str = "user_id", ts: str = "s", ok: str = "ok", tie: str = "event_id") -> DataFrame:
    """(key, event, state, passed) of each request: events have the second ``ts`` and whether they went well."""
    def step(state, r):
        state, name, passed = breaker_step(state, getattr(r, ts), bool(getattr(r, ok)))
        return state, (getattr(r, tie), name, passed)

    kind = events.schema[key].dataType.simpleString()
    return fold(events, key, [ts, tie], [ok], lambda: CLOSED, step, f"{key} {kind}, {tie} bigint, state string, passed boolean")


def circuit_breaker_stream(events: DataFrame, key: str = "user_id", forget_ms: int | None = None) -> DataFrame:
    """The same over a stream of (key, event_id, s, ok). With ``forget_ms`` a key's state goes after so long without
    events; that needs a trigger that goes on, as a run over what's available would wait for it for ever."""
    shape = f"{key} bigint, event_id bigint, state string, passed boolean"

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, fails, opened = state.get if state.exists else ("closed", [], 0.0)
        at = (name, tuple(fails), opened)
        parts = list(batches)  # one micro-batch of one key, limited by the source's trigger options
        rows = []
        for r in pd.concat(parts).sort_values(["s", "event_id"]).itertuples(index=False):
            at, name, passed = breaker_step(at, r.s, bool(r.ok))
            rows.append((k[0], r.event_id, name, passed))
        state.update((at[0], list(at[1]), at[2]))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(rows, columns=[key, "event_id", "state", "passed"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(run, shape, "name string, fails array<double>, opened double", "append", timeout)


def ttl_cache(events: DataFrame, key: str, what: str, ts: str, tie: str, keep_s: float = 3600.0) -> DataFrame:
    """(key, event, hit): whether what an event asks for was in its key's cache; an entry lasts ``keep_s`` seconds from when
    it was made, and a hit doesn't prolong it. State: the entries that haven't run out."""

    def step(state: dict, r):
        now, name = getattr(r, ts), getattr(r, what)
        hit = name in state and now - state[name] < keep_s
        if not hit:
            state = {k: v for k, v in state.items() if now - v < keep_s} | {name: now}
        return state, (getattr(r, tie), hit)

    kind = events.schema[key].dataType.simpleString()
    return fold(events, key, [ts, tie], [what], dict, step, f"{key} {kind}, {tie} bigint, hit boolean")


def monitor_step(state: tuple, text: str, status: int | None, least: float, keywords: tuple[str, ...], notify: str) -> tuple[tuple, tuple]:
    """(state, (change, ratio, found, lost)): a check of a page against its last. Another text is a change of content if at
    least ``least`` of its lines differ and, where that is asked for, a keyword came or went; the same text with another
    status is a change of status. State: digest, text (100,000 characters of it), status."""
    import hashlib
    from difflib import SequenceMatcher

    digest, old, before = state
    new = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    change, ratio, found, lost = None, None, [], []
    if digest and new != digest:
        ratio = round(SequenceMatcher(None, old.splitlines(), text.splitlines()).ratio(), 4)
        if 1.0 - ratio >= least:
            a, b = old.lower(), text.lower()
            found, lost = ([k for k in keywords if (k.lower() in b) is up and (k.lower() in a) is not up] for up in (True, False))
            if not (keywords and ((notify == "keyword_added" and not found) or (notify == "keyword_removed" and not lost))):
                change = "content_changed"
    elif before and status is not None and status != before and notify in ("status_change", "any_change"):
        change = "status_changed"
    return (new, text[:100_000], status), (change, ratio, ",".join(found), ",".join(lost))


def monitored(checks: DataFrame, key: str, text: str, status: str, order: list[str], least: float = 0.05, keywords: tuple[str, ...] = (), notify: str = "any_change") -> DataFrame:
    """(key, event, change, ratio, found, lost) of each check; the last of ``order`` is the event's number."""

    def step(state, r):
        code = getattr(r, status)
        state, values = monitor_step(state, getattr(r, text) or "", None if code is None or code != code else int(code), least, keywords, notify)
        return state, (getattr(r, order[-1]), *values)

    kind = checks.schema[key].dataType.simpleString()
    return fold(checks, key, order, [text, status], lambda: ("", "", None), step, f"{key} {kind}, {order[-1]} bigint, change string, ratio double, found string, lost string")


def slots_step(slots: int, load: float, most: int) -> int:
    """Tasks that a load in percent allows: one fewer above 75, one alone above 90, one more below 50."""
    return 1 if load >= 90 else max(1, slots - 1) if load >= 75 else min(most, slots + 1) if load < 50 else slots


def adaptive_slots(events: DataFrame, key: str, load: str, ts: str, tie: str, most: int = 8) -> DataFrame:
    """(key, event, slots) by ``slots_step`` from ``most`` on."""

    def step(state: int, r):
        state = slots_step(state, getattr(r, load), most)
        return state, (getattr(r, tie), state)

    kind = events.schema[key].dataType.simpleString()
    return fold(events, key, [ts, tie], [load], lambda: most, step, f"{key} {kind}, {tie} bigint, slots int")


def cron_after(cron: str, after):
    """The first minute later than ``after`` that a cron line of five fields allows; None for a line that none does. As
    usual, where both day fields are restricted either may match."""
    from datetime import timedelta

    fields = cron.split()
    if len(fields) != 5:
        return None
    sets = []
    for text, low, high in zip(fields, (0, 0, 1, 1, 0), (59, 23, 31, 12, 7)):
        got: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            try:
                first, last = (low, high) if a == "*" else (int(a), int(b) if b else high if step else int(a))
                got |= set(range(first, last + 1, int(step) if step else 1))
            except ValueError:
                return None
        sets.append({x for x in got if low <= x <= high})
    minutes, hours, days, months, weekdays = sets
    weekdays = {x % 7 for x in weekdays}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    either = fields[2] != "*" and fields[4] != "*"
    for _ in range(366 * 8 + 1):  # days to look at: a 29th of February comes within eight years
        dom, dow = at.day in days, (at.weekday() + 1) % 7 in weekdays
        if at.month in months and ((dom or dow) if either else (dom and dow)):
            for h in sorted(x for x in hours if x >= at.hour):
                for m in sorted(x for x in minutes if h > at.hour or x >= at.minute):
                    return at.replace(hour=h, minute=m)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    return None


def cron_next(df: DataFrame, id_col: str, cron: str, after: str) -> DataFrame:
    """(id, next_run) of schedules given as cron lines; null for a line that can't be read."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [cron_after(c, t.to_pydatetime()) if c and t is not pd.NaT else None for c, t in zip(b[cron], b[after])]
            yield pd.DataFrame({id_col: b[id_col], "next_run": pd.Series(found, dtype="datetime64[us]")})

    return df.select(id_col, cron, after).mapInPandas(run, f"{id_col} {kind}, next_run timestamp_ntz")


def seen_stream(urls: DataFrame, key: str = "url", ts: str = "ts", keep: str = "2 hours") -> DataFrame:
    """First sight of each key; keys are forgotten after ``keep``."""
    return urls.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def counts_stream(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and kind; rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sliding_counts_stream(events: DataFrame, ts: str = "ts", by: str = "user_id", width: str = "60 seconds", every: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, every), by).agg(F.count("*").alias("n")).select(F.col("window.end").alias("end"), by, "n")


def session_stream(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), by, "n")


def ndjson_sink(df: DataFrame, path: str, checkpoint: str):
    """A stream as lines of JSON, each micro-batch closed by a status line of its own file set."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
