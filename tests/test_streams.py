"""Streams over a folder must give what the batch operators give."""

import datetime
import random
import types

import pytest
from pyspark.sql import functions as F

from gatewise.operators import decide as D
from gatewise.streaming import decisions as S


@pytest.fixture
def folder(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(hours=5 * i), i % 4, ["a", "b"][i % 2], float(i), f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, kind string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def batch(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_decisions(spark, folder):
    def decide(df):
        return D.decide(df.withColumn("score", (F.col("event_id") * 17).cast("int")), "score", 700, 300).select("event_id", "rating", "category", "decision")
    got = S.available_rows(S.decide_stream(stream(spark, folder), decide), "t_decide", "append")
    assert sorted(got.collect()) == sorted(decide(batch(spark, folder)).collect())


def test_windows_are_closed_and_their_state_goes(spark, folder):
    want = {(r["window_start"], r["kind"]): r["n"] for r in S.window_rates(batch(spark, folder), "ts", "kind", "value", "1 day", "1 day").collect()}
    for files in (None, many_files(spark, folder)):
        said = []
        out = S.closed_rows(stream(spark, folder) if files is None else one_by_one(spark, files), "ts", "1 day", "t_rates", lambda e: S.window_rates(e, "ts", "kind", "value", "1 day"), said)
        assert {(r["window_start"], r["kind"]): r["n"] for r in out.collect()} == want and out.count() == len(want)
        assert said[0].state_rows > 0 and said[1] == S.Ran(0, 0)  # windows wait until the closing pass
    rates = S.window_rates(stream(spark, folder), "ts", "kind", "value", "1 day", "1 day")
    closed = {(r["window_start"], r["kind"]): r["n"] for r in S.available_rows(rates, "t_closed", "append").collect()}
    assert closed and len(closed) < len(want) and closed.items() <= want.items()


def test_sliding_windows_are_closed(spark, folder):
    out = S.closed_rows(stream(spark, folder), "ts", "1 day", "t_sliding", lambda e: S.window_rates(e, "ts", "kind", "value", "2 days", slide="1 day"))
    want = S.window_rates(batch(spark, folder), "ts", "kind", "value", "2 days", "1 day", "1 day")
    assert sorted(out.collect()) == sorted(want.collect())


def test_sessions(spark, folder):
    said = []
    got = S.closed_rows(stream(spark, folder), "ts", "1 day", "t_sessions", lambda e: S.sessions(e, "ts", "user_id", "21 hours"), said)
    want = S.sessions(batch(spark, folder), "ts", "user_id", "21 hours", "1 day")
    assert sorted(got.collect()) == sorted(want.collect())
    assert said[1].state_rows == 0


def test_resent_events_are_dropped(spark, folder):
    twice = stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert S.available_rows(S.drop_resent(twice, "ts", ["event_id"], "1 hour").select("event_id"), "t_once", "append").count() == 60


def many_files(spark, folder):
    many = f"{folder}/many"
    rows = spark.read.parquet(f"{folder}/events.parquet").collect()
    for k in range(0, len(rows), 20):  # in order of time
        spark.createDataFrame(rows[k : k + 20], "event_id bigint, ts timestamp_ntz, user_id bigint, kind string, value double, props string").coalesce(1).write.mode("append").parquet(many)
    return many


def one_by_one(spark, files):
    return spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files).withColumn("ts", F.col("ts").cast("timestamp"))


def test_latest_over_several_files(spark, folder):
    files = many_files(spark, folder)
    by_aggregate = S.available_rows(S.latest_rows(one_by_one(spark, files), "user_id", "ts", "event_id", "props"), "t_rows", "update")
    by_state = S.available_rows(S.latest_state(one_by_one(S.state_session(spark), files), "user_id", "ts", "event_id", "props"), "t_state", "update")
    for updates in (by_aggregate, by_state):
        assert {r["key"]: r["payload"] for r in S.newest_update(updates).collect()} == {0: "p56", 1: "p57", 2: "p58", 3: "p59"}
    assert by_aggregate.count() > 4  # an update per file


def labelled(stream):
    return S.label_events(stream, "user_id", "ts", "event_id", "value", F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0)


def test_labels_mature_once_each(spark, folder):
    """Equal to a plain loop, for one file and for several, with decisions that have no report; nothing is kept at the end."""
    hours = {i: 5 * i for i in range(60)}
    want = {}
    for i in range(0, 60, 3):
        reports = [j for j in range(0, 60, 5) if j % 4 == i % 4 and 0 <= hours[j] - hours[i] <= 48]
        want[i] = (reports[0], float(reports[0])) if reports else (None, None)
    assert None in {r for r, _ in want.values()}
    session = S.state_session(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != session.conf.get("spark.sql.streaming.stateStore.providerClass")
    for source in (stream(session, folder), one_by_one(session, many_files(spark, folder))):
        said = []
        out = S.closed_rows(labelled(source), "at", "1 day", "t_labels", lambda e: S.mature_labels(e, 2), said).collect()
        assert len(out) == len(want) and {r["decision_id"]: (r["report_id"], r["amount"]) for r in out} == want
        assert said[0].state_rows > 0 and said[1] == S.Ran(0, 0)
    table = S.first_reports(labelled(batch(spark, folder)), 2)
    assert {r["decision_id"]: (r["report_id"], r["amount"]) for r in table.collect()} == want


def test_late_reports_are_counted(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, day, tzinfo=datetime.timezone.utc)
    schema = "key bigint, decision boolean, id bigint, at timestamp, amount double"
    files = str(tmp_path / "late")
    for rows in ([(1, True, 1, at(1), None), (2, True, 2, at(20), None)], [(3, False, 9, at(20), 1.0)], [(1, False, 3, at(2), 5.0), (2, False, 4, at(21), 6.0), (2, False, 5, at(21), 7.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
    session, said = S.state_session(spark), []
    source = session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    out = S.closed_rows(source, "at", "1 day", "t_late", lambda e: S.mature_labels(e, 3), said).collect()
    assert {r["decision_id"]: (r["report_id"], r["amount"]) for r in out} == {1: (None, None), 2: (4, 6.0)}
    assert sum(r.late for r in said) == 1  # the report of day 2 came after the watermark had closed decision 1


class Kept:
    """State of one key, with the calls that reach it."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.calls, _ = self.calls + 1, self.timers.add(at)

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def appendList(self, more):
        self.calls, self.rows = self.calls + 1, self.rows + more

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.put([])


def test_a_key_of_many_rows_costs_a_few_calls_a_batch(monkeypatch):
    """Before, every row had a timer and an entry of its own, and every timer read all rows of its key."""
    monkeypatch.setattr(S, "SLICE", 700)
    rng, span = random.Random(3), 5_000_000
    rows = sorted((rng.randrange(60_000_000), k, rng.random() < 0.6) for k in range(6_000))
    kept, out, clock = Kept(), [], types.SimpleNamespace(now=0, getCurrentWatermarkInMs=lambda: clock.now)
    maturing = S._Maturing(span)
    maturing.init(kept)
    for k in [*range(0, len(rows), 2_000), None]:
        if k is not None:
            part = rng.sample(rows[k : k + 2_000], 2_000)
            assert list(maturing.handleInputRows((7,), iter([(7, d, i, at, None if i % 9 == 0 else float(i), None) for at, i, d in part]), None)) == []
        clock.now = rows[k][0] // 1000 if k is not None else 10**9  # the watermark, behind all that comes later
        while due := [t for t in kept.timers if t <= clock.now]:
            kept.timers.remove(min(due))
            out += maturing.handleExpiredTimer((7,), clock, types.SimpleNamespace(getExpiryTimeInMs=lambda at=min(due): at))
    reports = [(at, i) for at, i, d in rows if not d]
    want = {}
    for at, i, d in rows:
        if d:
            first = min((r for r in reports if at <= r[0] <= at + span), default=(None, None))
            want[i] = (at, first[1], first[0], None if first[1] is None or first[1] % 9 == 0 else float(first[1]))
    assert len(out) == len(want) and {r.decision_id: (r.decided_at, r.report_id, r.reported_at, r.amount) for r in out} == want
    assert kept.rows == [] and kept.timers == set() and kept.calls < 60
