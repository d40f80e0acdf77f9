"""Stored index and cache, scans of large groups, spans in whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import asof, detection, ingest, metrics, reports, retrieval, scan
from siftwork.sources import files, lexical_index, vector_cache


def test_a_stored_index_leaves_out_ranges_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 4)
    monkeypatch.setattr(lexical_index, "PROBES", 2)
    r = random.Random(1)
    word = lambda: f"w{min(int(r.expovariate(0.05)), 200)}"
    rows = [(i, " ".join(word() for _ in range(r.randint(3, 60)))) for i in range(300)] + [(300, "rare rare w1"), (301, "rare w2 w3"), (302, None), (303, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "rare w1"), (2, "w0 w1 w2 w0"), (3, "unknown"), (4, ""), (5, "w150 w160")], "qid long, text string")
    path = str(tmp_path / "index")
    mark = lexical_index.write(docs, path)
    index = lexical_index.Index(spark, path, mark)
    row = lambda x: (x["qid"], x["id"], round(x["score"], 5), x["rank"])
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for k in (1, 10):
        assert {row(x) for x in index.search(asked, k).collect()} == {row(x) for x in retrieval.bm25(plain, asked, k).collect()}
    hits = index._hits(asked)
    opened = index.ranges(hits, 1).join(hits, ["qid", "range"]).count()
    assert 0 < opened < hits.count()
    assert lexical_index.fingerprint(docs.orderBy(F.desc("id"))) == mark
    for other in (lexical_index.fingerprint(docs.where("id > 0")), lexical_index.fingerprint(docs, {"k1": 2.0})):
        with pytest.raises(ValueError, match="stale"):
            lexical_index.Index(spark, path, other)
    empty = lexical_index.write(docs.limit(0), path)  # replaces it
    assert lexical_index.Index(spark, path, empty).search(asked).count() == 0


def test_cache_keeps_the_last_writer(spark, tmp_path):
    path, r = str(tmp_path / "cache"), random.Random(2)
    make = lambda rows: spark.createDataFrame(rows, "key string, seq long, vec array<double>, model string")
    state = {}
    for batch in range(3):
        rows = [(r.choice([None, *"abcdefgh"]), r.randrange(5), [float(batch), r.random()], "m") for _ in range(12)]
        best = {}
        for key, seq, vec, _ in rows:
            if key is not None:
                best[key] = max(best.get(key, (seq, vec)), (seq, vec))
        state |= {k: v for k, (_, v) in best.items()}
        for _ in range(2):  # again, as after a failure
            vector_cache.put(make(rows), path, batch)
        assert {x["key"]: list(x["vec"]) for x in vector_cache.latest(spark, path).collect()} == state
        if batch == 0:
            old = dict(state)
    assert {x["key"]: list(x["vec"]) for x in vector_cache.latest(spark, path, upto=0).collect()} == old
    asked = spark.createDataFrame([("a",), ("zz",), ("zz",)], "key string")
    assert [x["key"] for x in vector_cache.missing(asked, spark, path).collect()] == ["zz", "zz"]
    # A write that fails leaves what was there.
    with pytest.raises(Exception, match="lost"):
        vector_cache.put(make([("a", 9, [9.9], "m")]).withColumn("vec", F.when(F.col("seq") > 0, F.raise_error(F.lit("lost")).cast("array<double>"))), path, 3)
    assert {x["key"]: list(x["vec"]) for x in vector_cache.latest(spark, path).collect()} == state
    vector_cache.compact(spark, path, str(tmp_path / "small"))
    assert {x["key"]: list(x["vec"]) for x in vector_cache.latest(spark, str(tmp_path / "small")).collect()} == state


GROUPS = "g string, o double, v double"


def grouped(seed=3):
    r = random.Random(seed)
    rows = [("big", float(k), r.random()) for k in r.sample(range(5000), 900)] + [("small", float(k), r.random()) for k in range(20)] + [(None, float(k), 1.0) for k in range(150)] + [("one", None, 2.0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("own", [True, False])
def test_running_sums_and_maxima_in_pieces(spark, own):
    rows = grouped()
    df = spark.createDataFrame(rows, GROUPS).repartition(5)
    found = scan.running(df, ["g"], [F.desc("o")], -F.col("o"), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("sum", F.lit(1))}, own=own, least=100)
    assert found.columns == ["g", "o", "v", "s", "m", "n"]
    want = {}
    for g in {g for g, _, _ in rows}:
        seen = []
        for _, o, v in sorted((x for x in rows if x[0] == g), key=lambda x: -(x[1] if x[1] is not None else -1)):
            now = [*seen, v] if own else seen
            want[g, o] = (round(sum(now), 9), max(now), len(now)) if now else (None, None, None)
            seen.append(v)
    assert {(x["g"], x["o"]): (None if x["s"] is None else round(x["s"], 9), x["m"], x["n"]) for x in found.collect()} == want


def test_no_window_holds_a_large_group(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").cast("double").alias("o"))
    cut, large = scan.pieces(df, ["g"], F.col("o"), least=500)
    most = cut.groupBy("g", "_piece").count().agg(F.max("count")).first()[0]
    assert large and most < 150
    assert not scan.pieces(df, ["g"], F.col("o"), least=2500)[1]
    numbers = [x["n"] for x in scan.numbered(df, [], ["o"], F.col("o"), "n", least=500).orderBy("o").collect()]
    assert numbers == list(range(1, 3001))


def test_smoothing_takes_all_rows(spark, monkeypatch):
    rows = [("c", k, 1.0) for k in range(2000)] + [("r", k, float(k % 7)) for k in range(1500)] + [("x", 5, 3.0)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    for least in (200_000, 300):
        monkeypatch.setattr(scan, "LEAST", least)
        found = {x["g"]: x["rate"] for x in reports.smoothed_rate(df, "g", "o", "v", keep=0.999).collect()}
        want = 0.0
        for k in range(1500):
            want = float(k % 7) if not k else 0.999 * want + 0.001 * (k % 7)
        assert found["c"] == 1.0 and found["x"] == 3.0 and abs(found["r"] - want) < 1e-6


def test_curves_and_ranks_in_pieces(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice("aaaab"), round(r.random(), 3), *r.choice([(1, 0), (0, 1), (0, 0)])) for _ in range(3000)]
    results = spark.createDataFrame(rows, "cls string, conf double, tp int, fp int")
    n_gt = spark.createDataFrame([("a", 1500), ("b", 0)], "cls string, n_gt long")
    ap = lambda: {x["cls"]: x["ap"] for x in detection.average_precision(detection.pr_curve(results, n_gt)).collect()}
    p95 = lambda: {x["cls"]: x["p95"] for x in metrics.nearest_rank_p95(results, "conf", "cls").collect()}
    whole = ap(), p95()
    for c, value in whole[1].items():
        own = sorted(x[1] for x in rows if x[0] == c)
        assert value == own[int(0.95 * len(own)) - 1]
    monkeypatch.setattr(scan.pieces, "__defaults__", (100,))
    monkeypatch.setattr(scan.running, "__defaults__", (True, 100))
    monkeypatch.setattr(scan.at_rank, "__defaults__", (100,))
    assert (ap(), p95()) == whole


def test_rows_of_a_csv_file_in_many_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b\n" + "".join(f"x{k};{k}\n" for k in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = files.read_csv_documents(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((x["row_no"], x["text"]) for x in rows) == [(k + 1, f"Row {k + 1} -- a: x{k}; b: {k}") for k in range(500)]


CHUNKS = "chunk_id long, doc_id string, section string, text string"


@pytest.mark.parametrize("few", [20_000, 1])
def test_grades_from_whole_texts(spark, monkeypatch, few):
    monkeypatch.setattr(ingest, "FEW_SPANS", few)
    chunks = spark.createDataFrame(
        [
            (1, "d", "s", "Before it: The  Quick brown\nfox jumps over it all."), (2, "d", "s", "only beside"), (3, "d", "t", "elsewhere"), (4, "e", None, "the quick brown fox jumps over them, no section"),
            (5, "e", None, "beside nothing"), (6, "f", "s", "quick brown foxes"), (7, "f", "s", None), (8, "g", "u", "one two three four five six. fox"),
        ],
        CHUNKS,
    )
    spans = spark.createDataFrame([(1, "ick brown fox jumps ov", 3), (1, "ree four fi", 2), (2, "fox", 2), (2, "two three four", 2), (2, "three four five", 2), (3, "not anywhere in it", 3)], "qid long, span string, grade int")
    found = {(x["qid"], x["chunk_id"]): x["grade"] for x in ingest.resolve_grades(spans, chunks).collect()}
    assert found == {(1, 1): 3, (1, 4): 3, (1, 2): 1, (1, 8): 2, (2, 1): 2, (2, 4): 2, (2, 6): 2, (2, 8): 2}
    r = random.Random(6)
    every = [" ".join(r.choice("abc") * r.randint(1, 2) for _ in range(30)) for _ in range(40)]
    bodies = spark.createDataFrame(list(enumerate(every)), "chunk_id long, body string")
    cuts = {every[r.randrange(40)][at : at + r.randint(1, 15)].strip() for at in (r.randrange(30) for _ in range(60))} - {""}
    asked = spark.createDataFrame(list(enumerate(sorted(cuts))), "span_id long, span string")
    got = {(x["span_id"], x["chunk_id"]) for x in ingest.contained(asked, bodies).distinct().collect()}
    assert got == {(k, c) for k, s in enumerate(sorted(cuts)) for c, body in enumerate(every) if s in body}


@pytest.mark.parametrize("least", [scan.LEAST, 50])
def test_last_row_before(spark, least):
    r = random.Random(8)
    left = [(k, r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(60)])) for k in range(400)]
    right = [(r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(0, 60, 3)]), r.choice([None, 1.5, 2.5]), k % 4) for k in range(120)]
    found = asof.last_before(spark.createDataFrame(left, "id int, g string, at int"), spark.createDataFrame(right, "g string, at int, v double, w int"), ["g"], "at", ["v", "w"], least)
    assert found.columns == ["id", "g", "at", "v", "w"]
    low = lambda v: (v is not None, v or 0)  # noqa: E731  null is the smallest
    for x in found.collect():
        fit = [(at, low(v), w, v) for g, at, v, w in right if g is not None and g == x["g"] and at is not None and x["at"] is not None and at <= x["at"]]
        best = max(fit) if fit else (None, None, None, None)
        assert (x["v"], x["w"]) == (best[3], best[2])
    assert found.count() == len(left)


def test_rows_within_a_window(spark):
    r = random.Random(9)
    left, right = ([(r.choice("ab"), r.randint(-50, 200)) for _ in range(150)] for _ in range(2))
    found = asof.within(spark.createDataFrame(left, "g string, f int"), spark.createDataFrame(right, "g string, p int"), ["g"], F.col("f"), F.col("p"), 7)
    assert sorted((x["g"], x["f"], x["p"], x["_far"]) for x in found.collect()) == sorted((g, f, p, f - p) for g, f in left for h, p in right if g == h and 0 <= f - p <= 7)


def test_postings_are_shuffled_once_into_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "RANGE_DOCS", 4)
    docs = spark.range(200).selectExpr("id", "concat('w', id % 50, ' w', id % 7, ' w', id % 7) AS text")
    path = tmp_path / "index"
    index = lexical_index.Index(spark, str(path), lexical_index.write(docs, str(path)))
    buckets = list((path / "blocks").glob("bucket=*"))
    assert buckets and all(len(list(b.glob("*.parquet"))) == 1 for b in buckets)  # a task holds all blocks of its bucket
    asked = spark.createDataFrame([(1, "w3 w3 w10"), (2, "w49")], "qid long, text string")
    rows = lambda df: {(x["qid"], x["id"], x["score"], x["rank"]) for x in df.collect()}
    assert rows(index.search(asked, 6)) == rows(retrieval.bm25(docs, asked, 6))
