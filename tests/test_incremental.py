import pytest

from murmur.operators import incremental
from murmur.operators.incremental import Ledger, StaleLease, hand_on, hand_on_lease
from tests.conftest import AT, TABLES


def test_lease_is_exclusive_and_expires(spark, tmp_path):
    now = [100.0]
    one, two = (Ledger(spark, f"file://{tmp_path}/l", lambda: now[0]) for _ in range(2))
    one.add([1, 2, 3])
    two.add([2, 3])
    lease = one.lease(most=2, seconds=10)
    assert lease.items == (1, 2)
    assert two.lease() is None  # item 3 rests on the states of 1 and 2
    now[0] = 111
    assert two.states() == {1: "pending", 2: "pending", 3: "pending"}
    newer = two.lease()
    assert newer.items == (1, 2, 3) and newer.token > lease.token
    with pytest.raises(StaleLease):
        one.done(lease)
    two.done(newer)
    with pytest.raises(StaleLease):
        two.done(newer)
    assert set(one.states().values()) == {"done"} and one.lease() is None


def test_release_and_a_writer_that_died(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", lambda: 1e12)
    ledger.add([5])
    lease = ledger.lease(seconds=1e6)
    ledger.release(lease)
    (tmp_path / "l/log/.half").write_text('{"kind": "do')  # its writer died before it took a number
    other = Ledger(spark, f"file://{tmp_path}/l", lambda: 1e12)
    assert other.states() == {5: "pending"}
    assert other.lease().items == (5,)


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_one_writer_gets_a_number(spark, tmp_path, scheme):
    one, two = (Ledger(spark, f"{scheme}{tmp_path}/l") for _ in range(2))
    assert one._append(0, {"kind": "add", "items": [1]}) and not two._append(0, {"kind": "add", "items": [2]})
    assert [e["items"] for e in two._entries()] == [[1]]
    assert two._append(1, {"kind": "add", "items": [2]}) and [e["items"] for e in one._entries()] == [[1], [2]]


def _three_runs(spark):
    frame = spark.createDataFrame([(i, i, 100 + i, "v", "a", "t", 0, AT, None) for i in (1, 2, 3)], TABLES["comments"])
    return frame, spark.createDataFrame([(i, AT, AT, "succeeded") for i in (1, 2, 3)], TABLES["fetch_runs"])


def test_a_stale_writer_changes_nothing(spark, tmp_path):
    comments, runs = _three_runs(spark)
    root, now = f"file://{tmp_path}/r", [0.0]
    slow = Ledger(spark, root, lambda: now[0])
    slow.add([1, 2, 3])
    lease = slow.lease(seconds=5)
    now[0] = 6.0
    expected = [(1, 101), (2, 102), (3, 103)]
    assert sorted(map(tuple, hand_on(comments, runs, root, most=1, clock=lambda: now[0]).collect())) == expected
    # the first worker wakes up and writes all of its results
    assert hand_on_lease(comments, slow, lease) is False
    assert sorted(map(tuple, hand_on(comments, runs, root, clock=lambda: now[0]).collect())) == expected


def test_states_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MERGED", 2)
    rows = [(i, 1 + i % 9, 50 + i % 4, "v", "a", "t", 0, AT.replace(minute=i % 7), None) for i in range(40)]
    comments = spark.createDataFrame(rows, TABLES["comments"])
    runs = spark.createDataFrame([(i, AT, AT, "succeeded") for i in range(1, 10)], TABLES["fetch_runs"])
    whole = sorted(map(tuple, hand_on(comments, runs).collect()))
    root = f"file://{tmp_path}/r"
    assert sorted(map(tuple, hand_on(comments, runs, root, most=1).collect())) == whole
    assert len(Ledger(spark, root).finished()) == 9 and len(Ledger(spark, root).finished()[-1]["states"]) < 6


def test_stages_and_crash_give_the_same(spark, odd_tables, tmp_path):
    comments, runs = spark.read.parquet(f"{odd_tables}/comments.parquet"), spark.read.parquet(f"{odd_tables}/fetch_runs.parquet")
    whole = sorted(map(tuple, hand_on(comments, runs).collect()))
    assert whole
    root, now = f"file://{tmp_path}/r", [0.0]
    crashed = Ledger(spark, root, lambda: now[0])
    crashed.add([1, 3])
    crashed.lease(seconds=5)  # this worker dies
    now[0] = 6.0
    assert sorted(map(tuple, hand_on(comments, runs, root, most=1, clock=lambda: now[0]).collect())) == whole
    # nothing is pending: results are read, not computed again
    assert sorted(map(tuple, hand_on(comments.limit(0), runs, root, clock=lambda: now[0]).collect())) == whole


def test_later_runs_add_to_earlier_results(spark, tmp_path):
    later = AT.replace(day=9)
    rows = [(1, 1, 10, "v", "a", "t", 0, AT, None), (2, 2, 10, "v", "a", "t", 0, AT, None), (3, 3, 10, "v", "a", "t2", 0, AT, later), (4, 3, 11, "v", "a", "t", 0, None, None)]
    frame = spark.createDataFrame(rows, TABLES["comments"])
    runs = lambda *ids: spark.createDataFrame([(i, AT, AT, "Succeeded") for i in ids], TABLES["fetch_runs"])
    root = f"file://{tmp_path}/r"
    assert sorted(map(tuple, hand_on(frame.where("run_id < 2"), runs(1), root).collect())) == [(1, 10)]
    assert sorted(map(tuple, hand_on(frame, runs(1, 2, 3), root).collect())) == [(1, 10), (3, 10), (3, 11)]
