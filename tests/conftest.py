import sys
from datetime import datetime, timezone
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from murmur.session import session

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "8", "6g", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made


def connect(folder):
    """DuckDB with every table of the folder as a view."""
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return db


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return float(value) if hasattr(value, "as_tuple") else value


def same(frame, db, sql):
    """Asserts that the frame and the SQL give the same columns and rows."""
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[n]) for n in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


AT = datetime(2026, 1, 5, 10, tzinfo=timezone.utc)
TABLES = {
    "comments": "row_id long, run_id long, comment_id long, video_id string, author string, text string, likes long, published_at timestamp, updated_at timestamp",
    "videos": "video_id string, title string, channel string, url string, published_at timestamp",
    "fetch_runs": "run_id long, started_at timestamp, finished_at timestamp, status string",
    "comment_labels": "row_id long, label string, rater int",
    "abuse_labels": "row_id long, abusive int",
    "polarity": "word string, polarity double",
    "stop_word": "word string",
    "given_name": "word string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, kind string, video_id string",
    "test_items": "item_id long, text string, task string",
}


def write_tables(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """Nulls in every column that may hold them, empty, blank and very long texts, ties, repeated rows, a dominant author."""
    later = datetime(2026, 1, 6, 10, tzinfo=timezone.utc)
    long = "The quick brown camera records a voice track. " * 150
    run = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = [None, "", "   ", "\n", long, "x" * 70000, "Best best best audio ever! Great sound.", "Best best best audio ever! Great sound.", "Call me on (525) 555-0139 or mail ann@mail.example", "Ｂｅｓｔ ａｕｄｉｏ", "Best audio", "cannot stop", "don't end.Next", "日本語のテキスト", "😀😀", "https://a.b/c", "shut your mouth you fool", f"{run} mu", "wonder wonder wonder kettle", "wonder wonder wonder lamp"]
    comments = [(i, 1 + i % 3, i // 2, None if i % 11 == 5 else f"v{i % 2}", ["Ann", " ann ", None, "", "Anonymous"][i % 5], t, None if i % 4 == 0 else i % 3, AT if i % 3 else None, later if i % 3 == 0 or i % 5 == 0 else None) for i, t in enumerate(texts)]
    comments += [(100 + i, 2, 50 + i, "v0", "Busy", "same text again", 7, AT, None) for i in range(30)] + [(200, 2, 50, "v0", "Busy", "same text again", 7, AT, None)]
    rows = {
        "comments": comments,
        "videos": [("v0", None, "c", "https://youtu.be/abcdef12?x=1", AT), ("v1", "t", None, "youtube.com/watch?v=abcdef", None), ("v2", "t", "c", None, None), ("v3", "t", "c", "https://www.youtube.com/watch?v=abc_def-12", None)],
        "fetch_runs": [(1, AT, AT, "SUCCEEDED"), (2, AT, None, None), (3, AT, AT, "succeeded"), (4, AT, AT, "failed")],
        "abuse_labels": [(16, 1), (6, 0), (7, 0), (10, None), (999, 1), (0, 1)],
        "polarity": [("best", 1.0), ("great", 0.8), ("fool", -0.9)],
        "stop_word": [("the",), ("a",), ("you",), ("your",)],
        "given_name": [("ann",), ("bruno",)],
        "documents": [(i, t, "en", "s", None, "post", "v0") for i, t in enumerate([*texts, f"so {run.upper()}, mu", "<|endoftext|> café é ﬁ"])],
        "test_items": [(1, f"say {run} again", "t"), (2, "too short", "t"), (3, None, "t"), (4, "", "t")],
    }
    return write_tables(spark, tmp_path_factory.mktemp("odd"), rows)
