"""The jobs: two runs over growing input, against counts made in plain Python."""

import hashlib
import os
import re
import subprocess
import sys

import pytest

from jobs import common, passage_store, track_report
from jobs import queries as job_queries

DOCS = "doc_id long, text string, lang string, batch long, sha int"
LONG = "a line that is long enough to be a passage of text"


def docs(spark, rows):
    """With columns whose names clash with the store's."""
    return spark.createDataFrame([(i, t, lang, 9, 9) for i, t, lang in rows], DOCS)


def stand(spark, out):
    return {(r["sha"], r["doc_id"], r["passage_no"], r["lang"], r["batch"]) for r in passage_store.stored(spark, out).collect()}


def wanted(batches):
    """sha -> owner, batch by batch."""
    known, out = set(), set()
    for number, rows in enumerate(batches):
        found = {}
        for i, text, lang in rows:
            lines = [x.strip(" ") for x in re.sub("[ \t]{2,}", " ", re.sub("[ \t]+\n", "\n", text or "")).strip().split("\n")]
            for k, line in enumerate(x for x in lines if x):
                alnum = sum(c.isalnum() for c in line)
                if len(line) >= 30 and 1 - alnum / len(line) <= 0.8:
                    sha = hashlib.sha256(line.encode()).hexdigest()
                    found[sha] = min(found.get(sha, (i, k, lang)), (i, k, lang))
        out |= {(sha, i, k, lang, number) for sha, (i, k, lang) in found.items() if sha not in known}
        known |= set(found)
    return out


FIRST = [(1, f"{LONG}\n\n{LONG} two\nshort", "en"), (2, f"{LONG}\n{LONG}  three \t\n" + "-" * 40, "en"), (3, None, "de"), (4, "", None), (5, f"{LONG} five", None)]
SECOND = [(7, f"{LONG} five\n{LONG} seven", "de"), (7, f"{LONG} five\n{LONG} seven", "de"), (0, f"{LONG}\nÜber {LONG}", "de"), (8, "x", "fr")]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_passages_over_growing_input(spark, tmp_path, few):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    settings = {"few_keys": few}
    docs(spark, FIRST).coalesce(1).write.parquet(source)
    passage_store.run(spark, source, out, mark, settings)
    assert stand(spark, out) == wanted([FIRST])
    passage_store.run(spark, source, out, mark, settings)  # nothing new
    assert stand(spark, out) == wanted([FIRST])
    docs(spark, SECOND).coalesce(1).write.mode("append").parquet(source)
    passage_store.run(spark, source, out, mark, settings)
    assert stand(spark, out) == wanted([FIRST, SECOND])
    report = {(r["batch"], r["lang"]): r for r in passage_store.reports(spark, out).collect()}
    assert sum(r["documents"] for k, r in report.items() if k[0] == 1) == len(SECOND)  # only what is new was read
    assert report[0, "en"]["documents"] == 2 and report[0, "en"]["noise"] == 2 and report[0, "de"]["passages"] == 0 and report[0, None]["stored"] == 1
    assert report[1, "de"]["passages"] == 6 and report[1, "de"]["stored"] == 2 and report[1, "fr"]["noise"] == 1


def test_a_batch_that_was_cut_short(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    docs(spark, FIRST).coalesce(1).write.parquet(source)
    passage_store.run(spark, source, out, mark)
    docs(spark, SECOND).coalesce(1).write.mode("append").parquet(source)

    def fails(df, path, by, kind="parquet"):
        common_write(df, path, by, kind)
        raise RuntimeError("lost after the write, before the batch was done")

    common_write = common.replace_partitions
    monkeypatch.setattr(common, "replace_partitions", fails)
    with pytest.raises(Exception, match="lost after the write"):
        passage_store.run(spark, source, out, mark)
    monkeypatch.undo()
    passage_store.run(spark, source, out, mark)
    assert stand(spark, out) == wanted([FIRST, SECOND])
    assert passage_store.reports(spark, out).where("batch = 1").count() == 2


def test_passages_of_an_empty_table(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    docs(spark, []).write.parquet(source)
    passage_store.run(spark, source, out, mark)
    docs(spark, FIRST).coalesce(1).write.mode("append").parquet(source)
    passage_store.run(spark, source, out, mark)
    assert {r[:4] for r in stand(spark, out)} == {r[:4] for r in wanted([FIRST])}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(spark, rows):
    """(hour, user, type, value) rows, one minute apart."""
    made = spark.createDataFrame([(k, h, u, t, v) for k, (h, u, t, v) in enumerate(rows)], "event_id long, h long, user_id long, event_type string, value double")
    return made.selectExpr("event_id", "timestampadd(MINUTE, h * 60 + event_id % 60, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "user_id", "event_type", "value")


def test_daily_report(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(0, 1, "view", 50.0), (0, 1, "click", 150.0), (1, 1, "click", 100.0), (2, 1, "click", 90.0), (22, 1, "view", 160.0), (25, 1, "error", 10.0), (30, 2, "view", 1.0), (60, 2, "view", None), (None, 3, "view", 1.0), (5, None, "view", 1.0)]
    events(spark, rows).write.parquet(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        track_report.run(spark, source, out)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    row = lambda r: (str(r["day"]), r["cls"], r["tracks"], r["frames"], r["entered"], r["left"], r["occlusions"], r["occluded_frames"])
    first = {row(r) for r in track_report.stored(spark, out).collect()}
    want = {("2024-01-01", "click", 1, 3, 0, 1, 0, 0), ("2024-01-01", "view", 1, 1, 1, 0, 1, 19), ("2024-01-02", "error", 1, 1, 0, 1, 0, 0), ("2024-01-02", "view", 1, 1, 0, 0, 0, 0), ("2024-01-03", "view", 1, 1, 0, 0, 1, 29)}
    assert first == want
    # More events come; only the later days are done again, with the state from before them.
    events(spark, [*rows, (61, 2, "view", 200.0), (1, 9, "view", 5.0)]).write.mode("overwrite").parquet(source)
    track_report.run(spark, source, out, {"first_day": "2024-01-03"})
    assert {row(r) for r in track_report.stored(spark, out).collect()} == want - {("2024-01-03", "view", 1, 1, 0, 0, 1, 29)} | {("2024-01-03", "view", 1, 2, 1, 0, 1, 29)}
    events(spark, []).write.mode("overwrite").parquet(source)
    track_report.run(spark, source, str(tmp_path / "none"))
    assert track_report.stored(spark, str(tmp_path / "none")).count() == 0


def test_unknown_settings():
    with pytest.raises(ValueError, match="unknown settings"):
        common.settings_of("track_report", {"lines": 3})


def test_command_line(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, FIRST).write.parquet(source)
    job = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs", "passage_store.py")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    for n in (5, 0):
        done = subprocess.run([sys.executable, job, "--documents", source, "--output", out, "--checkpoint", str(tmp_path / "mark"), "--set", "least_chars=30"], env=env, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-2000:]
        assert (f"read {n} documents" if n else "nothing new") in done.stderr
    assert stand(spark, out) == wanted([FIRST])


@pytest.mark.parametrize("name", sorted(job_queries.queries()))
def test_registered_job_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    ours, theirs = job_queries.queries()[name](spark, data).toPandas(), con.sql(job_queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    plain = lambda f: sorted(tuple(str(v)[:10] if c == "day" else str(v) for c, v in zip(sorted(f.columns), r, strict=True)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert plain(ours) == plain(theirs)


def test_lines_lose_blanks_only_whatever_their_place(spark):
    """A line that begins or ends with the digits of its own number keeps them, and loses its blanks."""
    lines = [f"{n}{n} line number {n} of this document, whose reference is {n}" for n in range(12)]
    docs = spark.createDataFrame([(1, "en", "\n".join(f"\t{line} "[n % 2 :] for n, line in enumerate(lines)).replace("\t", " "))], "doc_id long, lang string, text string")
    found = passage_store.passages(docs, {"least_chars": 30, "most_marks": 0.8}).orderBy("passage_no").collect()
    assert [r["text"] for r in found] == lines
