"""Ordered state over shuffled logs against plain simulations, and one tick of the queue against a fold."""

import datetime as dt
import json
import random

from taleweave.operators import queue as qu
from taleweave.plans import chapters as plans
from taleweave.scratch import fresh_path
from taleweave.streaming import live, pools

START = dt.datetime(2024, 1, 1)


def streamed(spark, rows, schema, files):
    """The rows in files that a stream reads one by one, and a last one that lets the watermark pass."""
    path = fresh_path(spark, "log")
    for part in files:
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled_files(r, n, closing):
    """Places of n rows in three files, each row at most two files from its place, and the closing rows last."""
    cut = [[k for k in range(n) if k * 3 // n == f] for f in range(3)]
    mixed = [x for pair in (cut[0] + cut[1], cut[2]) for x in r.sample(pair, len(pair))]
    return [mixed[: n // 2], mixed[n // 2 :], *[[n + k] for k in range(closing)]]


def simulated_pool(events, size, lease):
    """Chunk by chunk with a plain set."""
    nxt, held, ready, received, out = 0, [], [], set(), {}
    missing = lambda a, n: [k for k in range(a, a + n) if k not in received]
    for ms, seq, kind, n in sorted(events):
        if kind == "submit":
            received.add(n)
            continue
        for h in [h for h in held if ms - h[2] > lease]:
            held.remove(h)
            run = []
            for k in [*missing(h[0], h[1]), None]:
                if run and k != run[-1] + 1 if k is not None else run:
                    ready.append((run[0], len(run)))
                    run = []
                if k is not None:
                    run.append(k)
        got = None
        while ready and got is None:
            x = ready.pop()
            got = x if missing(*x) else None
        if got is None and nxt < size:
            got = (nxt, min(max(1, n), size - nxt))
            held.append((*got, ms))
            nxt += got[1]
        out[seq] = got or (-1, 0)
    return out


def test_runs_against_sets():
    r = random.Random(4)
    for _ in range(300):
        runs, plain = pools.Runs(), set()
        for _ in range(r.randint(0, 30)):
            n = r.randrange(40)
            runs.add(n)
            plain.add(n)
        a, n = r.randrange(45), r.randrange(20)
        assert [k for s, c in runs.missing(a, n) for k in range(s, s + c)] == [k for k in range(a, a + n) if k not in plain]
        assert all(x[1] < y[0] for x, y in zip(runs.runs, runs.runs[1:], strict=False))


def test_pools_on_a_shuffled_log(spark):
    r = random.Random(9)
    rows, logs = [], {}
    for k in range(240):
        ms = k * 20_000 // 3 * 3
        kind = r.choice(["ask", "ask", "submit"])
        pool, n = r.randrange(3), r.randrange(1, 8) if kind == "ask" else r.randrange(40)
        rows.append((pool, k, START + dt.timedelta(milliseconds=ms), kind, n))
        logs.setdefault(pool, []).append((ms, k, kind, n))
    rows += [(99, 1_000 + k, START + dt.timedelta(days=9 + k), "submit", 0) for k in range(2)]
    stream = streamed(spark, rows, "key long, seq long, ts timestamp, kind string, n long", shuffled_files(r, 240, 2))
    got = live.drained(pools.pool_leases(stream, 60, 180, "2 hours"), fresh_path(spark, "stream"), state_store=live.ROCKS)
    want = sorted((p, s, *x) for p, log in logs.items() for s, x in simulated_pool(log, 60, 180_000).items())
    assert sorted(tuple(x) for x in got.collect()) == want
    assert any(x[2] == -1 for x in want) and len(want) > 100


def test_queue_on_a_shuffled_log(spark):
    r = random.Random(11)
    rows, want, state = [], [], {}
    for k in range(260):
        key, kind = r.randrange(2), r.choice(["write", "live", "live", "free", "free", "tick"])
        chapter, stage = r.randrange(4), r.choice(pools.STAGES)
        write = [f"w{k}", r.sample(pools.STAGES, r.randint(1, 4)), r.choice([None, r.sample(range(4), r.randint(1, 2))])]
        rows.append((key, k, START + dt.timedelta(seconds=40 * (k // 2)), kind, json.dumps(write) if kind == "write" else None, chapter, stage))
        queue, busy = state.setdefault(key, ([], set()))
        clash = lambda w: sorted(f"{c}:{s}" for c, s in busy if s in w[1] and (w[2] is None or c in w[2]))  # noqa: B023, E731
        if kind == "write":
            if clash(write):
                queue.append(write)
            want.append((key, k, write[0], "queued" if clash(write) else "ran", len(clash(write))))
        elif kind == "tick":
            while queue and not clash(queue[0]):
                want.append((key, k, queue.pop(0)[0], "ran", 0))
        elif kind == "live":
            busy.add((chapter, stage))
        else:
            busy.discard((chapter, stage))
    rows += [(99, 1_000 + k, START + dt.timedelta(days=9 + k), "tick", None, None, None) for k in range(2)]
    stream = streamed(spark, rows, "key long, seq long, ts timestamp, kind string, write string, chapter long, stage string", shuffled_files(r, 260, 2))
    got = live.drained(pools.write_queue(stream, "3 hours"), fresh_path(spark, "stream"), state_store=live.ROCKS)
    shape = lambda x: (x.key, x.seq, x.id, x.outcome, int(x.blocked.split(" ")[0]) if x.blocked else 0)
    assert sorted(map(shape, got.collect())) == sorted(want)
    assert {w[3] for w in want} == {"ran", "queued"} and pools.summary(list("abcde")) == "5 row(s) in the way, e.g. a, b, c, d"


def test_one_tick_against_a_fold(spark):
    r = random.Random(6)
    now = 10_000
    tasks = list({(q, c, t, s): (q, c, t, s, r.choice(["assigned", "running", "pending", "done"]), r.sample(["a", "b", "c"], r.randint(0, 2)), now - r.choice([10, 500])) for q in range(6) for c in range(4) for t in range(2) for s in qu.STAGES if r.random() < 0.25}.values())
    beats = [(q, w, now - r.choice([5, 29, 30, 90]), r.choice([None, 0, 1, 2])) for q in range(6) for w in "abc"]
    writes = [(q, k, f"x{q}{k}", r.choice([list(qu.STAGES), r.sample(qu.STAGES, r.randint(1, 2))]), r.choice([None, r.sample(range(4), r.randint(1, 2))])) for q in range(7) for k in range(6)]
    fresh = {(q, w) for q, w, ts, _ in beats if now - ts < 30}
    want = []
    for q in range(7):
        waiting = False
        for q_, k, i, stages, chapters in writes:
            if q_ != q:
                continue
            reach = [t for t in tasks if t[0] == q and t[4] in ("assigned", "running") and t[3] in stages and (chapters is None or t[1] in chapters)]
            racing = any(any((q, h) in fresh for h in t[5]) or t[3] == "digest" and now - t[6] < 120 for t in reach)
            racing |= len(stages) == 4 and any((q, w) in fresh and b == q and c is not None and (chapters is None or c in chapters) for b, w, _, c in beats)
            outcome = "behind" if waiting else "head" if racing else "run"
            waiting |= racing
            ids = sorted(f"{t[1]}/{t[3]}/{t[2]}" for t in reach)
            note = "" if outcome == "run" else "a worker is still on it" if not ids else f"{len(ids)} row(s) in the way" + (", e.g. " if len(ids) > 4 else ": ") + ", ".join(ids[:4])
            want.append((q, k, i, outcome, note))
    got = qu.ticked(
        spark.createDataFrame(writes, "queue int, at int, id string, stages array<string>, chapters array<int>"),
        spark.createDataFrame(tasks, "queue int, chapter int, take int, stage string, state string, holders array<string>, updated int"),
        spark.createDataFrame(beats, "queue int, worker string, ts int, chapter int"), now,
    )
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert {w[3] for w in want} == {"run", "head", "behind"}


def test_queries_against_simulations(spark, data):
    """Over the whole log but its last moment, which the watermark does not pass."""
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", plans.F.col("ts").cast("timestamp"))
    stamp = lambda r: int(r.ts.timestamp() * 1000)
    leases = plans.lease_log(events).collect()
    last = max(map(stamp, leases))
    want = []
    for key in {r.key for r in leases}:
        log = [(stamp(r), r.seq, r.kind, r.n) for r in leases if r.key == key and stamp(r) < last]
        want += [(key, seq, *x) for seq, x in simulated_pool(log, 200, 180_000).items()]
    got = [tuple(r) for r in plans.pool_stream(spark, data).collect()]
    assert sorted(set(got) & set(want)) == sorted(want) and len(got) - len(want) <= 1

    writes = sorted(plans.write_log(events).collect(), key=lambda r: (stamp(r), r.seq))
    want = []
    for key in {r.key for r in writes}:
        queue, busy = [], set()
        for r in writes:
            if r.key != key or stamp(r) >= last:
                continue
            if r.kind == "write":
                w = json.loads(r.write)
                clash = any(s in w[1] and (w[2] is None or c in w[2]) for c, s in busy)
                queue += [w] * clash
                want.append((key, r.seq, w[0], "queued" if clash else "ran"))
            elif r.kind == "live":
                busy.add((r.chapter, r.stage))
            elif r.kind == "free":
                busy.discard((r.chapter, r.stage))
            else:
                while queue and not any(s in queue[0][1] and (queue[0][2] is None or c in queue[0][2]) for c, s in busy):
                    want.append((key, r.seq, queue.pop(0)[0], "ran"))
    got = [tuple(r)[:4] for r in plans.write_stream(spark, data).collect()]
    assert sorted(set(got) & set(want)) == sorted(want) and len(got) - len(want) <= 5
    assert {w[3] for w in want} == {"ran", "queued"}


def test_liveness_query_against_a_walk(spark, data):
    """Each user's beats in order: online after a silence, offline when it begins; silences up to the last beat of all."""
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", plans.F.col("ts").cast("timestamp")).collect()
    beats, silence, want = {}, 6 * 3_600_000, set()
    for e in events:
        beats.setdefault(e.user_id, []).append(int(e.ts.timestamp() * 1000))
    end = max(max(x) for x in beats.values())
    for user, times in beats.items():
        last = None
        for ms in sorted(times):
            if last is None or ms > last + silence:
                if last is not None:
                    want.add((user, "offline", last + silence))
                want.add((user, "online", ms))
            last = ms
        if last + silence < end:
            want.add((user, "offline", last + silence))
    got = {(r.worker, r.state, int(r["at"].timestamp() * 1000)) for r in plans.liveness_stream(spark, data).collect()}
    shift = {a[2] - b[2] for a in got for b in want if a[:2] == b[:2] == next(iter(want))[:2]} if got != want else set()
    assert got == want, (len(got), len(want), sorted(shift)[:3])


def test_a_write_meets_sums_and_not_rows(spark):
    """Twenty writes over all chapters and two hundred held rows: one row a write, whatever is in its way."""
    writes = spark.range(20).selectExpr("0L as queue", "id as at", "array('digest', 'merge') as stages", "cast(if(id < 19, null, array(3L, 4L)) as array<long>) as chapters")
    rows = spark.range(200).selectExpr("0L as queue", "'digest' as stage", "id % 50 as chapter", "concat('r', lpad(string(id), 3, '0')) as row", "id = 7 as races")
    got = {r["at"]: r for r in qu._reach(writes, rows).collect()}
    assert len(got) == 20 == qu._reach(writes, rows).count()
    assert (got[0].racing, got[0].in_way, got[0].shown) == (True, 200, ["r000", "r001", "r002", "r003"])
    assert (got[19].racing, got[19].in_way, got[19].shown) == (False, 8, ["r003", "r004", "r053", "r054"])


def test_a_key_has_one_timer(monkeypatch):
    """A hundred waiting rows of a key set one timer, at the first of them; what is left after it sets the next."""
    import pandas as pd

    class Value:
        def __init__(self):
            self.x = None

        exists = lambda self: self.x is not None
        get = lambda self: self.x
        update = lambda self, x: setattr(self, "x", x)
        clear = lambda self: setattr(self, "x", None)

    class Many:
        def __init__(self):
            self.x = []

        get = lambda self: iter(self.x)
        appendValue = lambda self, x: self.x.append(x)  # noqa: E731, N815
        appendList = lambda self, x: self.x.extend(x)  # noqa: E731, N815
        put = lambda self, x: setattr(self, "x", list(x))
        clear = lambda self: setattr(self, "x", [])

    class Handle:
        def __init__(self):
            self.timers = []

        getListState = lambda self, *a: Many()  # noqa: E731, N815
        getValueState = lambda self, *a: Value()  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815
        deleteTimer = lambda self, ms: self.timers.remove(ms)  # noqa: E731, N815

    class Now:
        getCurrentWatermarkInMs = lambda self: 1049  # noqa: E731, N815

    log, handle = pools.PoolLog(200, 1000), Handle()
    log.init(handle)
    rows = pd.DataFrame({"seq": range(100), "ts": 0, "kind": "ask", "n": 1, "ms": [1000 + (k * 37) % 100 for k in range(100)]})
    assert list(log.handleInputRows((1,), iter([rows[:50], rows[50:]]), None)) == [] and handle.timers == [1000]
    out = list(log.handleExpiredTimer((1,), Now(), None))
    assert len(out) == 1 and len(out[0]) == 50 and handle.timers == [1000, 1050] and len(list(log.waiting.get())) == 50


def test_a_long_log_waits_in_sorted_runs(monkeypatch):
    """Rows that come at once are put by in blocks, few of them are read at a time, and what is not due stays, over two timers."""
    import pandas as pd

    class Value:
        x = None
        exists = lambda self: self.x is not None
        get = lambda self: self.x
        update = lambda self, x: setattr(self, "x", x)
        clear = lambda self: setattr(self, "x", None)

    class Many:
        def __init__(self):
            self.x = []

        get = lambda self: iter(self.x)
        appendList = lambda self, x: self.x.extend(x)  # noqa: E731, N815
        put = lambda self, x: setattr(self, "x", list(x))
        clear = lambda self: setattr(self, "x", [])

    class Blocks(dict):
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__  # noqa: N815

    class Handle:
        def __init__(self):
            self.timers, self.blocks = [], Blocks()

        getListState = lambda self, *a: Many()  # noqa: E731, N815
        getValueState = lambda self, *a: Value()  # noqa: E731, N815
        getMapState = lambda self, *a: self.blocks  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815
        deleteTimer = lambda self, ms: self.timers.remove(ms)  # noqa: E731, N815

    def now(until):
        return type("Now", (), {"getCurrentWatermarkInMs": lambda self: until})()

    monkeypatch.setattr(pools, "RUN", 100)
    monkeypatch.setattr(pools, "BLOCK", 8)
    r = random.Random(3)
    rows = [(1_000 + r.randrange(3_000), k, r.choice(["ask", "ask", "submit"]), r.randrange(1, 6)) for k in range(730)]
    log, handle = pools.PoolRuns(300, 400), Handle()
    log.init(handle)
    frame = pd.DataFrame(rows, columns=["ms", "seq", "kind", "n"])
    assert list(log.handleInputRows((1,), iter([frame[k : k + 50] for k in range(0, 730, 50)]), None)) == []
    assert len(list(log.waiting.get())) == 30 and len(handle.blocks) == 7 * 13 and handle.timers == [min(x[0] for x in rows)]
    frames = list(log.handleExpiredTimer((1,), now(2_500), None))
    assert handle.timers[-1] == min(x[0] for x in rows if x[0] > 2_500) and 0 < len(handle.blocks) < 7 * 13
    frames += log.handleExpiredTimer((1,), now(9_000), None)
    assert not handle.blocks and not list(log.waiting.get()) and max(map(len, frames)) <= 8
    want = simulated_pool([(ms, k, kind, n) for ms, k, kind, n in rows], 300, 400)
    assert {x.seq: (x.start, x.count_) for f in frames for x in f.rename(columns={"count": "count_"}).itertuples()} == want


def test_queries_put_long_logs_by(spark):
    assert issubclass(pools.PoolRuns, pools.Merged) and issubclass(pools.QueueRuns, pools.Merged)
    queue = pools.Queue()
    queue.row(1, "crawl", True)
    for k in range(3):
        assert queue.ask([f"w{k}", ["crawl"], None])[0] == "queued"
    again = pools.Queue(json.loads(json.dumps(queue.kept())))
    again.row(1, "crawl", False)
    assert [type(x) for x in queue.queue] == [str] * 3 and again.tick() == ["w0", "w1", "w2"] and again.tick() == []
