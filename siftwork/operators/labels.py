"""Box labels, manifests and leak-free splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_labels(lines: DataFrame, classes: int) -> DataFrame:
    """Lines (image_id, line_no, line) of 'class cx cy w h' with the first issue that applies, or null."""
    parts = F.split(F.trim("line"), r"\s+")
    num = lambda k: F.expr(f"try_cast(try_element_at(_p, {k}) AS DOUBLE)")
    rows = lines.where(F.trim("line") != "").withColumn("_p", parts)
    rows = rows.withColumn("cls_id", F.expr("try_cast(try_element_at(_p, 1) AS INT)")).withColumns({n: num(k) for n, k in zip(("cx", "cy", "w", "h"), (2, 3, 4, 5), strict=True)})
    values = [F.col(n) for n in ("cx", "cy", "w", "h")]
    missing = F.col("cls_id").isNull() | F.greatest(*[v.isNull().cast("int") for v in values]).cast("boolean")
    outside = F.greatest(*[(~v.between(0, 1)).cast("int") for v in values]).cast("boolean")
    edge = 1e-3
    over = (F.col("cx") - F.col("w") / 2 < -edge) | (F.col("cy") - F.col("h") / 2 < -edge) | (F.col("cx") + F.col("w") / 2 > 1 + edge) | (F.col("cy") + F.col("h") / 2 > 1 + edge)
    issue = (
        F.when(F.size("_p") != 5, "bad_field_count").when(missing, "unparseable")
        .when(~F.col("cls_id").between(0, classes - 1), "bad_class_id").when(outside, "out_of_range")
        .when((F.col("w") <= 0) | (F.col("h") <= 0), "degenerate_box").when(over, "box_out_of_frame")
    )
    return rows.withColumn("issue", issue).drop("_p")


def parse_mot(lines: DataFrame) -> DataFrame:
    """MOT rows of (line); blank and # lines are skipped, fewer than six fields are an error."""
    p = F.split(F.trim("line"), r"\s*,\s*")
    rows = lines.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#"))).withColumn("_p", p)
    field = lambda k, kind: F.expr(f"try_cast(try_element_at(_p, {k}) AS {kind})")
    first = F.when(F.size("_p") < 6, F.raise_error(F.concat(F.lit("MOT row with fewer than 6 fields: "), "line"))).otherwise(field(1, "BIGINT"))
    return rows.select(
        first.alias("frame"), field(2, "BIGINT").alias("track_id"), field(3, "DOUBLE").alias("x"), field(4, "DOUBLE").alias("y"), field(5, "DOUBLE").alias("w"), field(6, "DOUBLE").alias("h"),
        F.coalesce(field(7, "DOUBLE"), F.lit(1.0)).alias("conf"), F.coalesce(field(8, "INT"), F.lit(0)).alias("cls_id"), F.coalesce(field(9, "DOUBLE"), F.lit(1.0)).alias("visibility"),
    ).withColumn("ignore", F.col("visibility") < 0.30)


def to_mot(rows: DataFrame) -> DataFrame:
    """Lines of MOT rows, sorted by frame and track."""
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,%d,%.3f", "frame", "track_id", "x", "y", "w", "h", "conf", "cls_id", "visibility")
    return rows.orderBy("frame", "track_id").select(line.alias("line"))


def to_yolo(rows: DataFrame, width: float, height: float, ignored: bool = False) -> DataFrame:
    """YOLO lines of MOT rows: clipped to the frame, boxes of a pixel or less dropped."""
    rows = rows if ignored else rows.where(~F.col("ignore"))
    x1, y1 = F.greatest(F.col("x"), F.lit(0.0)), F.greatest(F.col("y"), F.lit(0.0))
    x2, y2 = F.least(F.col("x") + F.col("w"), F.lit(width)), F.least(F.col("y") + F.col("h"), F.lit(height))
    ok = rows.withColumn("_w", x2 - x1).withColumn("_h", y2 - y1).withColumn("_x", x1).withColumn("_y", y1).where("_w > 1 AND _h > 1")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls_id"), (F.col("_x") + F.col("_w") / 2) / width, (F.col("_y") + F.col("_h") / 2) / height, F.col("_w") / width, F.col("_h") / height)
    return ok.select("frame", "track_id", line.alias("line"))


def sample_frames(frames: DataFrame, fps: float, target: float = 2.0, most: int = 400, least_blur: float = 5.0) -> DataFrame:
    """Every stride-th frame that is sharp enough, the first `most` of a video; odd rates count as 30."""
    rate = fps if 1 <= fps <= 240 else 30.0
    stride = max(1, round(rate / target))
    kept = frames.where((F.col("frame") % stride == 0) & (F.col("blur") >= least_blur))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("video").orderBy("frame"))).where(F.col("_n") <= most).drop("_n")


def enrich(manifest: DataFrame, boxes: DataFrame, crowded: int = 15) -> DataFrame:
    """n_objects and classes of each image; more than `crowded` objects are heavy occlusion if unknown."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("n_objects"), F.array_join(F.array_sort(F.collect_set("cls")), ";").alias("classes"))
    out = manifest.join(per, "image_id", "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0))).withColumn("classes", F.coalesce("classes", F.lit("")))
    heavy = (F.col("occlusion") == "unknown") & (F.col("n_objects") > crowded)
    return out.withColumn("occlusion", F.when(heavy, "heavy").otherwise(F.col("occlusion")))


def leaks(manifest: DataFrame, key: str = "scene_id") -> DataFrame:
    """Keys in more than one split."""
    return manifest.groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def assert_no_leak(manifest: DataFrame) -> DataFrame:
    for key in ("scene_id", "source_video"):
        if found := leaks(manifest, key).orderBy(key).limit(5).collect():
            raise ValueError(f"{key} in several splits: {[r[key] for r in found]}")
    return manifest


def assign_splits(manifest: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """(scene_id, split): scenes, larger and rarer lighting first, go where the deficit is largest.

    A fold over the scenes, whose number is that of recordings and not of rows.
    """
    scene = manifest.groupBy("scene_id", "lighting").agg(F.count("*").alias("n"))
    by = Window.partitionBy("scene_id").orderBy(F.desc("n"), "lighting")
    scene = scene.withColumn("_t", F.sum("n").over(Window.partitionBy("scene_id"))).withColumn("_r", F.row_number().over(by)).where("_r = 1")
    bucket = scene.groupBy("lighting").agg(F.count("*").alias("_b"))
    turn = Window.partitionBy("lighting").orderBy(F.desc("_t"), F.xxhash64(F.lit(seed), "scene_id"))
    scene = scene.join(bucket, "lighting").withColumn("_turn", F.row_number().over(turn))
    order = scene.agg(F.array_sort(F.collect_list(F.struct("_turn", "_b", "lighting", "scene_id", F.col("_t").alias("n")))).alias("s"), F.sum("_t").alias("total"))
    a, b, c = ratios
    fold = f"""
      aggregate(s, named_struct('c', array(0D, 0D, 0D), 'o', CAST(array() AS ARRAY<STRUCT<scene_id:STRING,split:STRING>>)), (acc, x) ->
        named_struct(
          'c', transform(acc.c, (v, i) -> v + IF(i = {_PICK.format(a=a, b=b, c=c)}, x.n, 0)),
          'o', concat(acc.o, array(named_struct('scene_id', string(x.scene_id), 'split', element_at(array('train', 'val', 'test'), 1 + {_PICK.format(a=a, b=b, c=c)}))))),
        acc -> acc.o)"""
    return order.select(F.inline(F.expr(fold)))


#: Index of the split with the largest shortfall against its share, the first among equals.
_PICK = "int(array_position(array({a}D - acc.c[0] / total, {b}D - acc.c[1] / total, {c}D - acc.c[2] / total), array_max(array({a}D - acc.c[0] / total, {b}D - acc.c[1] / total, {c}D - acc.c[2] / total))) - 1)"


def dataset_hash(manifest: DataFrame) -> DataFrame:
    """12 digits that change with any change of id, split or count of a row, whatever the order.

    Hashes of rows are summed, which combines before the shuffle; nothing is collected or sorted.
    """
    row = F.concat_ws("|", "image_id", "split", "n_objects")
    sums = manifest.select(F.xxhash64(row).alias("a"), F.xxhash64(row, F.lit("second")).cast("decimal(20,0)").alias("b"))
    total = sums.agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.sum("b").alias("s"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", "n", "x", "s"), 256), 1, 12).alias("hash"))
