"""Ordered keyed state over shuffled logs: work pools that lease runs of chunks, and queues of exclusive writes.

Rows of a key are kept until the watermark has passed their time and are then taken in order of (ts, seq), so that a log
that arrives out of order within the watermark gives the rows that it gives in order. State is one value per key: what is
kept of it is bounded by what is open (leases, runs, queued writes, live rows), not by the length of the log.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from heapq import merge

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STAGES = ("crawl", "digest", "render", "merge")
#: Rows that wait are sorted this many at a time, and read back in blocks.
RUN, BLOCK = 65_536, 1_024


class Runs:
    """A set of whole numbers as disjoint runs [from, to), in order."""

    def __init__(self, runs: list[list[int]] | None = None) -> None:
        self.runs = [list(r) for r in runs or []]

    def add(self, n: int) -> None:
        k = bisect_right(self.runs, n, key=lambda r: r[0])
        if k and self.runs[k - 1][1] > n:
            return
        left, right = k > 0 and self.runs[k - 1][1] == n, k < len(self.runs) and self.runs[k][0] == n + 1
        if left and right:
            self.runs[k - 1][1] = self.runs.pop(k)[1]
        elif left:
            self.runs[k - 1][1] = n + 1
        elif right:
            self.runs[k][0] = n
        else:
            self.runs.insert(k, [n, n + 1])

    def missing(self, start: int, count: int) -> list[tuple[int, int]]:
        """(from, count) of the runs of start .. start + count - 1 that are not in the set."""
        out, at, end = [], start, start + count
        for a, b in self.runs[max(0, bisect_right(self.runs, start, key=lambda r: r[0]) - 1) :]:
            if a >= end:
                break
            if a > at:
                out.append((at, min(a, end) - at))
            at = max(at, b)
        return out + [(at, end - at)] if at < end else out


class Pool:
    """A pool of `size` chunks. An ask gets the last given-back run of which something is missing, else the next `want` new
    chunks as a lease; a lease older than `lease` ms gives its missing runs back at the next ask. A given-back run is handed
    out as it was given back and is not leased again."""

    def __init__(self, size: int, lease: int, kept: dict | None = None) -> None:
        kept = kept or {}
        self.size, self.lease, self.next = size, lease, kept.get("next", 0)
        self.held, self.ready, self.received = kept.get("held", []), kept.get("ready", []), Runs(kept.get("received"))

    def kept(self) -> dict:
        return {"next": self.next, "held": self.held, "ready": self.ready, "received": self.received.runs}

    def ask(self, now: int, want: int) -> tuple[int, int] | None:
        late = [h for h in self.held if now - h[2] > self.lease]
        self.held = [h for h in self.held if now - h[2] <= self.lease]
        self.ready += [list(r) for start, count, _ in late for r in self.received.missing(start, count)]
        while self.ready:
            start, count = self.ready.pop()
            if self.received.missing(start, count):
                return start, count
        if self.next >= self.size:
            return None
        start, count = self.next, min(max(1, want), self.size - self.next)
        self.next += count
        self.held.append([start, count, now])
        return start, count

    def submit(self, chunk: int) -> None:
        if 0 <= chunk < self.size:
            self.received.add(chunk)


class Queue:
    """Exclusive writes of one ledger in the order they were asked for. A write is (id, stages, chapters; None: all). The head
    runs as soon as no live row of its stages and chapters is in the way; those behind a blocked head wait, as text, since
    they may be many. A write that finds its way clear when it is asked for runs at once."""

    def __init__(self, kept: dict | None = None) -> None:
        kept = kept or {}
        self.queue, self.live = deque(kept.get("queue", [])), {tuple(k): None for k in kept.get("live", [])}
        self.head = json.loads(self.queue[0]) if self.queue else None

    def kept(self) -> dict:
        return {"queue": list(self.queue), "live": [list(k) for k in self.live]}

    def blockers(self, write: list) -> list[str]:
        _, stages, chapters = write
        return sorted(f"{c}:{s}" for c, s in self.live if s in stages and (chapters is None or c in chapters))

    def ask(self, write: list) -> tuple[str, str]:
        rows = self.blockers(write)
        if not rows:
            return "ran", ""
        self.queue.append(json.dumps(write))
        self.head = self.head or write
        return "queued", summary(rows)

    def row(self, chapter: int, stage: str, live: bool) -> None:
        if live:
            self.live[chapter, stage] = None
        else:
            self.live.pop((chapter, stage), None)

    def tick(self) -> list[str]:
        """Ids of the writes that run now."""
        out = []
        while self.head and not self.blockers(self.head):
            out.append(self.head[0])
            self.queue.popleft()
            self.head = json.loads(self.queue[0]) if self.queue else None
        return out


def summary(rows: list[str]) -> str:
    if len(rows) > 4:
        return f"{len(rows)} row(s) in the way, e.g. {', '.join(rows[:4])}"
    return f"{len(rows)} row(s) in the way: {', '.join(rows)}"


def _place(row: list) -> tuple[int, int]:
    return row[0], row[1]


class Ordered(StatefulProcessor):
    """Hands the rows of a key to take() in order of (ms, seq), once the watermark has passed them. A key has one timer, at
    its earliest waiting row: when it runs out, all rows that are due are taken at once."""

    out: list[str]
    fields: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("ms", LongType()), StructField("row", StringType())]))
        self.state = handle.getValueState("state", StructType([StructField("kept", StringType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, first = [], None
        for batch in rows:
            columns = [batch[c].tolist() for c in ("ms", "seq", *self.fields)]
            new += map(list, zip(*columns, strict=True))
            first = min(columns[0] if first is None else [first, *columns[0]])
            if len(new) >= RUN:
                new = self._put_by(new)
        if new:
            self.waiting.appendList([(r[0], json.dumps(r)) for r in new])
        if first is not None:
            set_for = self.timer.get()[0] if self.timer.exists() else None
            if set_for is None or first < set_for:
                if set_for is not None:
                    self.handle.deleteTimer(set_for)
                self._wait_for(first)
        yield from ()

    def _put_by(self, rows: list[list]) -> list[list]:
        """The rows that still go to the list of waiting ones."""
        return rows

    def _put_by_due(self, until: int) -> list[Iterator[list]]:
        """Rows that were put by and are due, in order."""
        return []

    def _put_by_left(self) -> list[int]:
        """Times of the first rows that stay put by, once those that are due have been read."""
        return []

    def _wait_for(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        every = [(x[0], x[1]) for x in self.waiting.get()]
        due = sorted((json.loads(row) for ms, row in every if ms <= until), key=_place)
        left = [(ms, row) for ms, row in every if ms > until]
        model = self.begin(json.loads(self.state.get()[0]) if self.state.exists() else None)
        out: list[tuple] = []
        for row in merge(due, *self._put_by_due(until), key=_place):
            out += self.take(model, dict(zip(("ms", "seq", *self.fields), row, strict=True)))
            if len(out) >= BLOCK:
                yield self._frame(key, out)
                out = []
        self.state.update((json.dumps(model.kept()),))
        self.waiting.clear()
        self.timer.clear()
        if left:
            self.waiting.put(left)
        if later := [ms for ms, _ in left] + self._put_by_left():
            self._wait_for(min(later))
        if out:
            yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.out])

    def begin(self, kept: dict | None) -> Pool | Queue:
        raise NotImplementedError

    def take(self, model: Pool | Queue, row: dict) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Merged(Ordered):
    """For logs of which much may come at once: every RUN rows of a key are put by as a sorted run, in blocks of BLOCK rows,
    and the runs are merged block by block. A task holds a run while rows come in and a block of each run while they are
    handed on, not the log of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.blocks = handle.getMapState("blocks", StructType([StructField("run", LongType()), StructField("block", LongType())]), StructType([StructField("rows", StringType())]))
        self.runs = handle.getValueState("runs", StructType([StructField("runs", StringType())]))

    def _waiting_runs(self) -> list[list[int]]:
        """Number, first block, number of blocks and first ms of each run."""
        return json.loads(self.runs.get()[0]) if self.runs.exists() else []

    def _put_by(self, rows: list[list]) -> list[list]:
        rows.sort(key=_place)
        runs, starts = self._waiting_runs(), range(0, len(rows), BLOCK)
        number = runs[-1][0] + 1 if runs else 0
        for k, at in enumerate(starts):
            self.blocks.updateValue((number, k), (json.dumps(rows[at : at + BLOCK]),))
        self.runs.update((json.dumps([*runs, [number, 0, len(starts), rows[0][0]]]),))
        return []

    def _put_by_due(self, until: int) -> list[Iterator[list]]:
        self.reading = self._waiting_runs()
        return [self._read(run, until) for run in self.reading]

    def _read(self, run: list[int], until: int) -> Iterator[list]:
        """The rows of a run up to a time. Blocks that are read go, and the run begins with what is left."""
        while run[1] < run[2]:
            place = (run[0], run[1])
            rows = json.loads(self.blocks.getValue(place)[0])
            n = bisect_right(rows, until, key=lambda r: r[0])
            yield from rows[:n]
            if n < len(rows):
                run[3] = rows[n][0]
                if n:
                    self.blocks.updateValue(place, (json.dumps(rows[n:]),))
                return
            self.blocks.removeKey(place)
            run[1] += 1

    def _put_by_left(self) -> list[int]:
        left = [run for run in self.reading if run[1] < run[2]]
        self.runs.update((json.dumps(left),))
        return [run[3] for run in left]


class PoolLog(Ordered):
    out = ["seq", "start", "count"]
    fields = ["kind", "n"]

    def __init__(self, size: int, lease: int) -> None:
        self.size, self.lease = size, lease

    def begin(self, kept: dict | None) -> Pool:
        return Pool(self.size, self.lease, kept)

    def take(self, model: Pool, row: dict) -> list[tuple]:
        if row["kind"] == "ask":
            return [(row["seq"], *(model.ask(row["ms"], row["n"]) or (-1, 0)))]
        if row["kind"] == "submit":
            model.submit(row["n"])
        return []


class QueueLog(Ordered):
    out = ["seq", "id", "outcome", "blocked"]
    fields = ["kind", "write", "chapter", "stage"]

    def begin(self, kept: dict | None) -> Queue:
        return Queue(kept)

    def take(self, model: Queue, row: dict) -> list[tuple]:
        if row["kind"] == "write":
            write = json.loads(row["write"])
            return [(row["seq"], write[0], *model.ask(write))]
        if row["kind"] == "tick":
            return [(row["seq"], i, "ran", "") for i in model.tick()]
        model.row(row["chapter"], row["stage"], row["kind"] == "live")
        return []


class PoolRuns(Merged, PoolLog):
    pass


class QueueRuns(Merged, QueueLog):
    pass


def _ordered(log: DataFrame, processor: Ordered, kind: str, late: str) -> DataFrame:
    own = log.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return own.groupBy("key").transformWithStateInPandas(processor, kind, "append", "EventTime")


def pool_leases(log: DataFrame, size: int, lease_seconds: int = 180, late: str = "10 minutes") -> DataFrame:
    """log: key (pool), seq (order among equal times), ts, kind (ask, submit), n (chunks wanted, or the chunk that is home).
    Returns key, seq, start, count of every ask; -1 and 0 if nothing is left."""
    own = log.select("key", F.col("seq").cast("long").alias("seq"), "ts", "kind", F.col("n").cast("long").alias("n"))
    return _ordered(own, PoolRuns(size, lease_seconds * 1000), "key long, seq long, start long, count long", late)


def write_queue(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """log: key (ledger), seq, ts, kind (write, live, free, tick), write (JSON: id, stages, chapters or null), chapter, stage.
    Returns key, seq, id, outcome (ran, queued) and, of queued ones, what is in the way."""
    own = log.select("key", F.col("seq").cast("long").alias("seq"), "ts", "kind", "write", F.coalesce("chapter", F.lit(-1)).cast("long").alias("chapter"), F.coalesce("stage", F.lit("")).alias("stage"))
    return _ordered(own, QueueRuns(), "key long, seq long, id string, outcome string, blocked string", late)
