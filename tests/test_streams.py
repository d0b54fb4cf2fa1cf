"""Streaming breakers and the dedup store of bounded size, against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import dedup, evict
from newsloom.streaming.breakers import BreakerStream

START = datetime(2024, 1, 1)


def fetches(seed, n):
    """feed_id, event_id, ts, failed, with bursts, pauses and equal times."""
    random.seed(seed)
    at, out = 0, []
    for i in range(n):
        at += random.choice([0, 1, 30, 90, 400, 2000])
        out.append((random.randrange(4), i, START + timedelta(seconds=at), random.random() < 0.75))
    return out


def breaker(rows, mark, threshold, minutes):
    """What a breaker does with rows before mark, one event after the other."""
    out, state = [], {}
    for feed, event, ts, failed in sorted((r for r in rows if r[2] < mark), key=lambda r: (r[2], r[1])):
        failures, until = state.get(feed, (0, None))
        if until and until < ts:
            out.append((feed, None, until, "close", 0, None))
            failures, until = 0, None
        if failed:
            failures += 1
            if failures >= threshold:
                kind, until = "extend" if until else "open", ts + timedelta(minutes=minutes)
                out.append((feed, event, ts, kind, failures, until))
        else:
            if until:
                out.append((feed, event, ts, "close", 0, None))
            failures, until = 0, None
        state[feed] = (failures, until)
    return out + [(feed, None, until, "close", 0, None) for feed, (_, until) in state.items() if until and until < mark]


def test_breaker_over_restarts(spark, tmp_path):
    rows = fetches(3, 160)
    schema = "feed_id long, event_id long, ts timestamp, failed boolean"
    cuts = [rows[:60], rows[60:61], rows[61:]]
    # what is late by less than the watermark's delay comes in a later run
    cuts[1].append(cuts[0].pop(58))
    stream = BreakerStream(str(tmp_path), late="20 minutes", minutes=10)
    counts = []
    for part in cuts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(stream.events)
        stream.run(spark)
        counts.append(stream.result(spark).count())
    mark = max(r[2] for r in rows) - timedelta(minutes=20)
    got = sorted(map(tuple, stream.result(spark).collect()), key=repr)
    want = breaker(rows, mark, 3, 10)
    assert got == sorted(want, key=repr) and {r[3] for r in want} == {"open", "extend", "close"} and {r[1] is None for r in want if r[3] == "close"} == {True, False}
    assert 0 < counts[0] <= counts[1] < counts[2]
    # a run without new events adds nothing
    stream.run(spark)
    assert stream.result(spark).count() == len(got)


def test_store_of_bounded_size(spark):
    random.seed(9)
    base = [" ".join(random.choice("abcdefgh") * 3 + str(random.randrange(50)) for _ in range(30)) for _ in range(25)]
    rows = [(3 * i + 1, "t", random.choice([*base, "", "one two"]) + random.choice(["", "", " more words that differ %d" % random.randrange(9)]), random.random() < 0.9) for i in range(150)]
    articles = spark.createDataFrame(rows, "arrival long, title string, body string, publishable boolean")
    signed = dedup.signatures(articles)
    bands = {r.arrival: set(r.b) for r in signed.select("arrival", dedup.band_keys(F.col("signature")).alias("b")).collect()}
    for places, block in ((10, 7), (1, 50_000), (25, 40)):
        store, want = [], {}
        for arrival, _, _, publishable in rows:
            want[arrival] = any(bands[arrival] & bands[x] for x in store)
            if publishable and not want[arrival]:
                store.append(arrival)
                if len(store) > places:
                    del store[: max(1, places // 10)]
        got = evict.bounded_first_wins(signed, places, block=block)
        assert {r.arrival: r.is_duplicate for r in got.collect()} == want
        if places == 10:
            everything = {r.arrival: r.is_duplicate for r in dedup.first_wins(signed).collect()}
            assert everything != want  # what has left the store is met no more
    assert evict.bounded_first_wins(signed.limit(0), 10).count() == 0


def test_runs_of_the_bounded_store(spark, monkeypatch):
    """A long chain of decisions costs no round each; runs that were tried from the right store are not decided again."""
    random.seed(12)
    base = [" ".join(random.choice("abcdefgh") * 3 + str(random.randrange(50)) for _ in range(12)) for _ in range(12)]
    rows = [(7 * i, "t", random.choice(base) if random.random() < 0.4 else "own %d words %d of %d it" % (i, i, i), random.random() < 0.95) for i in range(600)]
    signed = dedup.signatures(spark.createDataFrame(rows, "arrival long, title string, body string, publishable boolean"))
    bands = {r.arrival: set(r.b) for r in signed.select("arrival", dedup.band_keys(F.col("signature")).alias("b")).collect()}
    kept = [(k, ["0:x%d" % k] + ["%d:%032x" % (i, k) for i in range(1, 25)]) for k in range(23)]
    asked, again = [], []
    checkpointed, decided = evict.checkpointed, evict._marked
    monkeypatch.setattr(evict, "checkpointed", lambda df: asked.append(1) or checkpointed(df))
    monkeypatch.setattr(evict, "_marked", lambda *a: again.append(1) or decided(*a))
    for given in ([], kept):
        store, want = [set(b) for _, b in given], {}
        del store[: evict.gone(len(given), 20)]
        for arrival, _, _, publishable in rows:
            want[arrival] = any(bands[arrival] & x for x in store)
            if publishable and not want[arrival]:
                store.append(bands[arrival])
                if len(store) > 20:
                    del store[:2]
        asked.clear(), again.clear()
        got = evict.bounded_first_wins(signed, 20, block=100, store=spark.createDataFrame(given, evict.STORE) if given else None)
        assert {r.arrival: r.is_duplicate for r in got.collect()} == want and 20 < sum(want.values()) < 400
        assert len(asked) == 3 and len(again) < 4


def test_a_feed_waits_for_one_timer(monkeypatch):
    """Timers follow the batches of a feed, not its events; each event is taken once the watermark has passed it."""
    import pandas as pd

    from newsloom.streaming import breakers

    class Held(list):
        exists = lambda self: bool(self)
        get = lambda self: self[0] if self and self.value else iter(list(self))
        value = False

        def appendList(self, x):  # noqa: N802
            self.extend(x)

        def put(self, x):
            self[:] = x

        def update(self, x):
            self[:], self.value = [x], True

    timers = set()
    p = breakers.BreakerProcessor(3, 10)
    p.handle, p.waiting, p.breaker = type("H", (), {"registerTimer": staticmethod(timers.add)}), Held(), Held()
    rows = fetches(5, 400)
    micros = lambda t: int((t - START).total_seconds() * 1e6)
    one = [(0, e, ts, f) for _, e, ts, f in rows]
    list(p.handleInputRows((0,), iter([pd.DataFrame([(micros(t), e, f) for _, e, t, f in one], columns=["at", "event_id", "failed"])]), None))
    assert len(timers) == 1
    out, fired, end = [], 0, one[-1][2] - timedelta(minutes=5)
    for mark in (one[100][2], one[101][2], end):
        at = micros(mark) // 1000
        while due := sorted(t for t in timers if t < at):
            timers.discard(due[0])
            fired += 1
            for pdf in p.handleExpiredTimer((0,), type("T", (), {"getCurrentWatermarkInMs": staticmethod(lambda at=at: at)}), None):
                out += pdf[["event_id", "at", "kind"]].astype(object).where(pdf.notna(), None).values.tolist()
    want = [[e, micros(t), k] for _, e, t, k, *_ in breaker(one, end, 3, 10)]
    assert sorted(map(repr, out)) == sorted(map(repr, want)) and fired < 10


def test_signatures_take_few_words_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dedup, "WORDS", 5)
    lists = [["a"] * n for n in (3, 2, 1, 9, 0, 0, 4, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(lists)], names=["arrival", "words"])
    parts = list(dedup._parts(batch.slice(1)))
    assert [x for p in parts for x in p.column(1).to_pylist()] == lists[1:] and [p.num_rows for p in parts] == [2, 1, 4, 1]
