"""The queue as a state machine, as a stream and over a table."""

import json
import random

from tessera.streaming import events as S
from tessera.streaming import queue as Q

MINUTE = 60_000


def event(seq, kind, minute, work="w", **more):
    return {"job_type": "t", "work": work, "seq": seq, "at": int(minute * MINUTE), "event": kind} | more


def run(events, until=None, **how):
    works, out = {}, []
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        e = dict.fromkeys(Q.EVENT_NAMES) | e
        work = works.setdefault((e["job_type"], e["work"]), Q.Work(**how))
        work.handle(e)
        out += work.rows((e["job_type"], e["work"]))
    for key, work in works.items():
        if until is not None:
            work.pass_time(int(until * MINUTE))
            out += work.rows(key)
    return [dict(zip(Q.JOB_NAMES, r)) for r in out]


def last(changes):
    return {c["job_id"]: c for c in changes}


def test_requests_become_one_job():
    jobs = last(run([event(1, "enqueue", 0, job_id="a", priority=5, payload='{"x": 1, "batch_id": "b1"}', due=9), event(2, "enqueue", 1, job_id="b", priority=3, max_attempts=7, payload='{"y": 2, "batch_id": "b2"}', due=4)]))
    assert list(jobs) == ["a"] and jobs["a"]["coalesced"] == 1 and (jobs["a"]["priority"], jobs["a"]["max_attempts"], jobs["a"]["due"]) == (3, 7, 4)
    assert json.loads(jobs["a"]["payload"]) == {"x": 1, "y": 2, "batch_ids": ["b1", "b2"], "batch_id": "b2"}
    assert Q.merged_payload('{"a": 1}', "[2]") == "[2]" and Q.merged_payload(None, None) == "{}"


def test_a_running_job_has_one_follow_up():
    jobs = last(run([event(1, "enqueue", 0, job_id="a"), event(2, "claim", 1), event(3, "enqueue", 2, job_id="b"), event(4, "enqueue", 3, job_id="c"), event(5, "claim", 3.5, job_id="nobody")]))
    assert {i: (j["status"], j["replaces"], j["coalesced"]) for i, j in jobs.items()} == {"a": ("running", None, 0), "b": ("queued", "a", 1)}


def test_failures_wait_or_end():
    base = [event(1, "enqueue", 0, job_id="a", max_attempts=2), event(2, "claim", 1), event(3, "fail", 2, error="boom")]
    assert last(run(base))["a"]["status"] == "retry_wait"
    assert last(run([*base, event(4, "claim", 3)]))["a"] | {"payload": ""} == last(run([*base, event(4, "claim", 3, job_id="a")]))["a"] | {"payload": ""}
    again = [*base, event(4, "claim", 3), event(5, "fail", 4, error="bang")]
    assert last(run(again))["a"]["status"] == "failed" and last(run(again))["a"]["attempts"] == 2
    assert last(run(again, until=4 + 14 * 24 * 60))["a"]["status"] == "archived"
    assert last(run([*again, event(6, "retry", 5, job_id="a")]))["a"]["status"] == "queued"
    fresh = last(run([*base[:2], event(3, "fail", 2, retry=False), event(4, "enqueue", 3, job_id="b")]))
    assert fresh["a"]["status"] == "failed" and fresh["b"]["status"] == "queued" and fresh["b"]["replaces"] is None


def test_time_ends_stuck_runs():
    base = [event(1, "enqueue", 0, job_id="a"), event(2, "claim", 1)]
    assert last(run(base, until=15.9))["a"]["status"] == "running"
    stuck = run(base, until=16)
    assert [c["status"] for c in stuck] == ["queued", "running", "retry_wait", "queued"] and stuck[-1]["error"] == "stuck"
    assert [c["status"] for c in run(base, until=46, stuck_ms=45 * MINUTE, stuck_is="requeued")] == ["queued", "running", "queued"]
    late = last(run([*base, event(3, "succeed", 20)]))["a"]
    assert late["status"] == "queued"  # the run was taken away before it ended
    assert run([event(1, "none", 0), event(2, "claim", 1)]) == []
    assert last(run([event(1, "enqueue", 0, job_id="a", due=5 * MINUTE), event(2, "claim", 4), event(3, "cancel", 6)]))["a"]["status"] == "canceled"


def made(n, works=7):
    rng = random.Random(8)
    out = []
    for i in range(n):
        e = event(i, rng.choice(["enqueue", "enqueue", "claim", "claim", "succeed", "fail", "cancel"]), rng.random() * 300, work=f"w{rng.randrange(works)}")
        out.append(e | ({"job_id": f"j{i}", "priority": rng.randrange(5), "payload": json.dumps({"k": i}), "max_attempts": 2} if e["event"] == "enqueue" else {}))
    return out


def plain(changes):
    return sorted(json.dumps({k: None if v != v else v for k, v in c.items()}, sort_keys=True) for c in changes)


def test_replay_of_a_table(spark):
    events = made(600)
    frame = spark.createDataFrame([tuple((dict.fromkeys(Q.EVENT_NAMES) | e)[c] for c in Q.EVENT_NAMES) for e in events], Q.EVENT).repartition(5)
    got = Q.replay(frame, until=400 * MINUTE)
    assert plain(r.asDict() for r in got.collect()) == plain(run(events, until=400))
    assert {(r.job_id, r.status) for r in Q.latest(got).collect()} == {(i, c["status"]) for i, c in last(run(events, until=400)).items()}
    assert Q.replay(frame.limit(0)).count() == 0
    single = spark.createDataFrame([("t", None, "a", 0, "enqueue"), ("t", None, "b", 0, "enqueue"), ("t", None, None, 0, "claim")], "job_type string, work string, job_id string, at long, event string")
    assert sorted((r.job_id, r.status) for r in Q.replay(single).collect()) == [("a", "queued"), ("b", "queued")]


def test_stream_with_a_restart(spark, tmp_path):
    """Files of events, in time, over two runs; then an event far ahead, so that timers fire."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "in"
        folder.mkdir()
        events = sorted(made(60, 3), key=lambda e: (e["at"], e["seq"]))
        ahead = event(10_000, "enqueue", 60 * 24 * 30, work="other", job_id="late")

        def feed(name, part):
            (folder / name).write_text("\n".join(map(json.dumps, part)))
            stream = Q.run_queue(S.watch_folder(spark, str(folder), Q.EVENT, per_trigger=1), late="0 seconds")
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            assert q.awaitTermination(200)

        feed("1.json", events[:30])
        feed("2.json", [*events[30:], ahead])
        feed("3.json", [event(10_001, "claim", 60 * 24 * 31, work="other", job_id="nobody")])
        got = [r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        expected = run(events, until=60 * 24 * 30) + run([ahead])
        assert {(c["job_id"], c["status"], c["attempts"], c["coalesced"]) for c in got} == {(c["job_id"], c["status"], c["attempts"], c["coalesced"]) for c in expected}
    finally:
        spark.conf.unset(key)

