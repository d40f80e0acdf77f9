"""Daily report of tracks: presence, line crossings and occlusions by day and class.

    python jobs/track_report.py --events IN --output OUT [--set first_day='"2024-01-03"']

For those who watch tracked objects: an hour is a frame, a user a track, and the last event of an
hour is the track's state (class and position). For each day and class: tracks and frames seen,
crossings of the line into and out of the zone, and occlusions that ended, with their frames.

    OUT/day=D   cls, tracks, frames, entered, left, occlusions, occluded_frames

A run replaces the days from first_day to last_day (all, where they are null), so that running again
gives the same. State runs on over midnight, so the frames before first_day are read as well; those
after last_day are not. Events without time, user or type take no part.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from siftwork.operators import tracks

REPORT = "cls string, tracks long, frames long, entered long, left long, occlusions long, occluded_frames long, day date"


def frames_of(events: DataFrame) -> DataFrame:
    """(track_id, frame, cls, x): the last event of each track and hour.

    An aggregate that combines before the shuffle: a track that has a third of all events comes to
    one row for each of its hours, which is what the windows over a track then hold.
    """
    state = F.max_by(F.struct(F.col("event_type").alias("cls"), F.col("value").cast("double").alias("x")), F.col("event_id")).alias("_s")
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    return rows.groupBy(F.col("user_id").cast("long").alias("track_id"), hour.alias("frame")).agg(state).select("track_id", "frame", "_s.*")


def day_of(frame) -> F.Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(frame / 24).cast("int"))


def report(frames: DataFrame, settings: dict) -> DataFrame:
    """One row for each day and class that has frames."""
    key = [day_of(F.col("frame")).alias("day"), "cls"]
    seen = frames.groupBy(*key).agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("frames"))
    crossed = tracks.line_crossings(frames, F.col("x") - settings["line"])
    crossed = crossed.groupBy(*key).agg(F.count_if(F.col("direction") == "in").alias("entered"), F.count_if(F.col("direction") == "out").alias("left"))
    hidden = tracks.occlusions(frames.where(F.col("cls") != settings["lost"]), settings["least_gap"])
    back = hidden.select("track_id", F.col("end").alias("frame"), "gap").join(frames.select("track_id", "frame", "cls"), ["track_id", "frame"])
    back = back.groupBy(*key).agg(F.count("*").alias("occlusions"), F.sum("gap").alias("occluded_frames"))
    out = seen.join(crossed, ["day", "cls"], "left").join(back, ["day", "cls"], "left")
    return out.select("cls", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tracks", "frames", "entered", "left", "occlusions", "occluded_frames")], "day")


def stored(spark: SparkSession, output: str, kind: str = "orc") -> DataFrame:
    return spark.read.schema(REPORT).format(kind).load(output)


def run(spark: SparkSession, events: str, output: str, settings: dict | None = None) -> None:
    """Report the days of the settings from `events` (Parquet with event_id, ts, user_id, event_type, value)."""
    settings = common.settings_of("track_report", settings)
    with common.during(spark, spark__sql__session__timeZone="UTC"):
        frames = frames_of(spark.read.parquet(events))
        day = day_of(F.col("frame"))
        if settings["last_day"]:
            frames = frames.where(day <= F.lit(settings["last_day"]).cast("date"))
        rows = report(frames, settings)
        if settings["first_day"]:
            rows = rows.where(F.col("day") >= F.lit(settings["first_day"]).cast("date"))
        common.replace_partitions(rows, output, ["day"], settings["format"])
        done = stored(spark, output, settings["format"])
        if settings["first_day"]:
            done = done.where(F.col("day") >= F.lit(settings["first_day"]).cast("date"))
        if settings["last_day"]:
            done = done.where(F.col("day") <= F.lit(settings["last_day"]).cast("date"))
        total = done.agg(F.count("*"), F.count_distinct("day"), F.coalesce(F.sum("frames"), F.lit(0))).first()
    common.log.info("read %s; wrote %d rows of %d days, from %d frames, to %s", events, *total, output)


if __name__ == "__main__":
    common.main("track_report", "Reports tracks by day and class.", ["events", "output"], run)
