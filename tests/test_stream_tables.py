"""Streams over tables stored as folders: empty, growing, late and out-of-order files."""
import datetime as dt
import os
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from baitline.session import checkpoint_dir
from baitline.streaming import jobs

START = dt.datetime(2024, 1, 1, 12)


def write(folder, name, events):
    """events: (event_id, minutes after START, user_id); file order is arrival order."""
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({
        "event_id": pa.array([e[0] for e in events], pa.int64()),
        "ts": pa.array([START + dt.timedelta(minutes=e[1]) for e in events], pa.timestamp("us")),
        "user_id": pa.array([e[2] for e in events], pa.int64()),
        "event_type": pa.array(["view"] * len(events)), "value": pa.array([1.0] * len(events)),
        "props": pa.array(["{}"] * len(events))}), os.path.join(folder, name))


@pytest.fixture
def sf(tmp_path):
    return str(tmp_path / "sf")


@pytest.fixture
def job(spark):
    return os.path.join(checkpoint_dir(spark), "test-jobs", uuid.uuid4().hex)


RUNNERS = [jobs.run_stream_reports, jobs.run_verdict_windows, jobs.run_sliding_windows, jobs.run_sessions,
           jobs.run_history, jobs.run_dedup]


def event(i, minute, user=7):
    """A message that is accepted (templates 6 and 25 are plain sentences)."""
    return (30 * i + 6, minute, user)


@pytest.mark.parametrize("run", RUNNERS)
def test_a_table_without_rows_gives_no_rows(spark, sf, run):
    write(f"{sf}/events.parquet", "part-0.parquet", [])
    result = run(spark, sf)
    assert result.collect() == [] and result.columns


def test_a_table_without_files_gives_no_rows(spark, sf):
    os.makedirs(f"{sf}/events.parquet")
    assert jobs.run_sessions(spark, sf).collect() == []
    assert jobs.run_history(spark, sf).collect() == []


@pytest.mark.parametrize("run", RUNNERS)
def test_folder_tables_count_like_one_file(spark, sf, tmp_path, run):
    rows = [event(i, 7 * i, i % 3) for i in range(24)]
    for k in range(3):
        write(f"{sf}/events.parquet", f"part-{k}.parquet", rows[k::3])
    write(sf, "events_old.parquet", [event(900, 1)])                    # another table: not read
    one = str(tmp_path / "one")
    write(one, "events.parquet", rows)
    assert sorted(map(tuple, run(spark, sf).collect())) == sorted(map(tuple, run(spark, one).collect()))


def sessions_of(events, gap=30):
    """(user, first minute, last minute + gap, number) by hand; a gap that is just reached goes on."""
    out = []
    for user in {e[2] for e in events}:
        times = sorted(e[1] for e in events if e[2] == user)
        group = [times[0]]
        for t in times[1:]:
            if t - group[-1] > gap:
                out.append((user, group[0], group[-1] + gap, len(group)))
                group = []
            group.append(t)
        out.append((user, group[0], group[-1] + gap, len(group)))
    return sorted(out)


def seen(result):
    def minute(text):
        return int((dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S") - START).total_seconds() // 60)
    return sorted((r.user_id, minute(r.session_start), minute(r.session_end), r.n_messages) for r in result.collect())


def test_sessions_over_runs_with_late_and_out_of_order_files(spark, sf, job):
    """Every run resumes: open sessions go on growing, closed ones stay, none overlap or count twice."""
    loads = [
        [event(1, 0), event(2, 20), event(3, 5, 8)],
        [event(4, 40), event(5, 10), event(6, 25, 8)],                  # out of order, within the hour
        [event(7, 200), event(8, 205, 8)],                              # closes the first sessions
        [event(9, 190), event(10, 230), event(11, 170, 8)],             # late, but not behind the watermark
    ]
    so_far = []
    for k, load in enumerate(loads):
        write(f"{sf}/events.parquet", f"part-{k}.parquet", load)
        so_far += load
        assert seen(jobs.run_sessions(spark, sf, job)) == sessions_of(so_far)
    assert seen(jobs.run_sessions(spark, sf, job)) == sessions_of(so_far)   # nothing new: the same sessions


def test_rows_behind_the_watermark_do_not_reopen_a_session(spark, sf, job):
    write(f"{sf}/events.parquet", "part-0.parquet", [event(1, 0), event(2, 600)])
    jobs.run_sessions(spark, sf, job)
    write(f"{sf}/events.parquet", "part-1.parquet", [event(3, 10), event(4, 610)])
    assert seen(jobs.run_sessions(spark, sf, job)) == sessions_of([event(1, 0), event(2, 600), event(4, 610)])


def test_micro_batches_give_the_same_sessions(spark, sf, job):
    rows = [event(i, 9 * i, i % 2) for i in range(30)]
    for k in range(5):
        write(f"{sf}/events.parquet", f"part-{k}.parquet", rows[6 * k:6 * k + 6])
        time.sleep(1.1)                                                  # files are read in the order of their times
    stream = jobs.message_stream(spark, sf, max_files=1)
    got = jobs.run_session_counts(jobs.stream_session_counts(jobs.stream_reports(stream)), f"{job}/out", f"{job}/ckpt")
    assert seen(got) == sessions_of(rows)


def test_windows_resume_on_their_folder(spark, sf, job):
    write(f"{sf}/events.parquet", "part-0.parquet", [event(i, i) for i in range(5)])
    assert sum(r.n_messages for r in jobs.run_verdict_windows(spark, sf, job).collect()) == 5
    write(f"{sf}/events.parquet", "part-1.parquet", [event(9, 3), event(10, 5000)])
    rows = jobs.run_verdict_windows(spark, sf, job).collect()
    assert sorted(r.n_messages for r in rows) == [1, 6]                  # the open day grew, nothing was counted twice


def test_history_resumes_and_keeps_the_newest(spark, sf, job):
    write(f"{sf}/events.parquet", "part-0.parquet", [event(i, i) for i in range(6)])
    assert jobs.run_history(spark, sf, job).count() == 6
    write(f"{sf}/events.parquet", "part-1.parquet", [event(i, i) for i in range(6, 12)])
    got = {r.msg_id: r["rank"] for r in jobs.run_history(spark, sf, job).collect()}
    assert got == {event(i, 0)[0]: 12 - i for i in range(4, 12)}


def test_the_shared_folder_without_a_setting(spark, monkeypatch):
    """Without spark.checkpoint.dir the warehouse is used; nothing is set on the session."""
    from baitline import session

    class Conf:
        @staticmethod
        def get(key, *default):
            return default[0] if key == "spark.checkpoint.dir" else spark.conf.get(key, *default)

    class Session:
        conf = Conf
    assert session.checkpoint_dir(Session) == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    assert session.work_folder(Session, "a", "b").startswith(session.checkpoint_dir(Session) + "/a/b-")
