"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

Two collections of HALVES half keys, each of HALF_ROWS minhashes, give HALVES^2 table keys: the
pairs of a half key of the first with one of the second. 2 * HALVES * HALF_ROWS = 32 minhashes
serve 64 tables of 4 rows; banding without pairs would need 256. A pair of texts with similarity s
misses all tables with a chance near 2 * (1 - s^2)^8: 7e-5 at 0.85, 3e-6 at 0.9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common
from siftwork.llm.components import components

HALVES, HALF_ROWS = 8, 2
#: Buckets up to this size are compared pair by pair; larger ones through a central member, then in blocks.
SMALL_BUCKET = 24
#: Members of a block in the exact pass over large buckets, and their shingles, as expected.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18


def word_bytes() -> np.ndarray:
    """Bytes that belong to words: all but the blank and 0x09 to 0x0D."""
    member = np.ones(256, bool)
    member[[0x20, *range(0x09, 0x0E)]] = False
    return member


def shingles_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows end to end, and how many each row has; none for no words."""
    data, offsets = common.buffer_of(column)
    words, row = common.words_of(data, offsets, word_bytes(), common.ascii_lower())
    joined = words.copy()
    for k in range(1, size):
        joined[:-k] = common.mix64(joined[:-k] * np.uint64(0x9FB21C651E98DF25) + words[k:] * np.uint64(2 * k + 1))
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    for low, n in zip(*(x[(count > 0) & (count < size)].tolist() for x in (first, count)), strict=True):
        whole = np.array([n], np.uint64)  # the whole sequence as one shingle
        for w in words[low : low + n]:
            whole = common.mix64(whole * np.uint64(0x9FB21C651E98DF25) + w)
        joined[low] = whole[0]
    held = np.where(count >= size, count - size + 1, count > 0)
    flat = joined[np.arange(len(row)) - first[row] < held[row]]
    ends = np.cumsum(held)
    for low, high in zip((ends - held).tolist(), ends.tolist(), strict=True):
        flat[low:high].sort()
    new = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    new[(ends - held)[held > 0]] = True
    return flat[new], np.diff(np.append(0, np.cumsum(new))[np.append(0, ends)])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; empty for no words."""
    flat, held = shingles_of(column, size)
    return np.split(flat, np.cumsum(held)[:-1]) if len(held) else []


def set_names(flat: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set of shingles_of(); 0 for an empty one."""
    out = np.zeros((2, len(held)), np.uint64)
    full = np.flatnonzero(held)
    if len(full):
        start = (np.cumsum(held) - held)[full]
        out[0, full] = np.add.reduceat(common.mix64(flat), start)
        out[1, full] = np.bitwise_xor.reduceat(common.mix64(flat + np.uint64(77)), start)
    return out[0].astype(np.int64), out[1].astype(np.int64)


def _salts() -> np.ndarray:
    return common.mix64(np.arange(1, 2 * HALVES * HALF_ROWS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def signatures(flat: np.ndarray, held: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys of each non-empty set; rows of empty sets are zero."""
    out = np.zeros((len(held), 2 * HALVES), np.uint64)
    full = np.flatnonzero(held)
    if not len(full):
        return out
    start = (np.cumsum(held) - held)[full]
    for k, salt in enumerate(_salts()):
        low = np.minimum.reduceat((flat ^ salt) * np.uint64(0xD6E8FEB86659FD93), start)
        column = out[full, k // HALF_ROWS]
        out[full, k // HALF_ROWS] = common.mix64(column * np.uint64(0x9FB21C651E98DF25) + low + np.uint64(k))
    return out


def _signature_table(docs: DataFrame, size: int) -> DataFrame:
    """n_shingles, a 128-bit name of the set and the half keys of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                flat, held = shingles_of(part.column(1), size)
                halves = signatures(flat, held).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * 2 * HALVES), pa.array(halves.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in (held, *set_names(flat, held))], lists], schema=schema)

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, "doc_id long, n_shingles long, set_a long, set_b long, halves array<long>")


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """The full shingle set of each row."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                flat, held = shingles_of(part.column(1), size)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=schema)

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, "id long, shingles array<long>")


def _alike(inter, a, b, percent: int):
    return F.lit(100) * inter >= F.lit(percent) * (a + b - inter)


def with_sets(pairs: DataFrame, sets: DataFrame, rows: DataFrame | None = None, sides: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """pairs (a, b), or `rows` made from them, with the full sets of `sides`, as _sa and _sb.

    An id that is in very many pairs, as the centre of a large group is, has its set copied to as
    many salts as its pairs would fill shares of 1 / common.HOT.
    """
    total = pairs.count()
    share = max(256, total // common.HOT)
    out = pairs if rows is None else rows
    for own in sides:
        other = "b" if own == "a" else "a"
        many = pairs.groupBy(F.col(own).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > share)
        many = F.broadcast(many.select("id", F.ceil(F.col("n") / share).cast("int").alias("_salts")))
        full = sets.join(many, "id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        full = full.select(F.col("id").alias(own), "_salt", F.col("shingles").alias(f"_s{own}"))
        out = out.join(many.withColumnRenamed("id", own), own, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
        out = out.join(full, [own, "_salt"]).drop("_salt")
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    out = with_sets(pairs, sets)
    inter = F.size(F.array_intersect("_sa", "_sb"))
    return out.where(_alike(inter, F.size("_sa"), F.size("_sb"), percent)).select("a", "b")


def shared_counts(flat: np.ndarray, size: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Common shingles of each row of `first` with each of `second`.

    `flat` has the shingles of all rows end to end, `size` how many each has.
    """
    n = len(size)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    values, inverse = np.unique(flat, return_inverse=True)
    inter = np.zeros((len(first), len(second)), np.float32)
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    at_first, at_second = np.full(n, -1), np.full(n, -1)
    at_first[first], at_second[second] = np.arange(len(first)), np.arange(len(second))
    for low in range(0, len(values), 8192):  # columns of the two membership matrices
        a, b = np.searchsorted(inverse, [low, low + 8192])
        width = min(8192, len(values) - low)
        one = np.zeros((len(first), width), np.float32)
        two = np.zeros((len(second), width), np.float32)
        rows, cols = owner[a:b], inverse[a:b] - low
        own = at_first[rows] >= 0
        one[at_first[rows[own]], cols[own]] = 1
        own = at_second[rows] >= 0
        two[at_second[rows[own]], cols[own]] = 1
        inter += one @ two.T
    return inter


def joining(ids, comp, first, second, hit) -> list[tuple[int, int]]:
    """Of the hits (rows of `first` by rows of `second`), links that are enough to join the same components."""
    root = {c: c for c in comp.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = find(int(comp[first[i]])), find(int(comp[second[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[first[i]]), int(ids[second[j]])))
    return out


def _linked_in_block(ids, flat, size, halves, comp, side, percent: int) -> list[tuple[int, int]]:
    """Spanning links between rows of the two sides (0 and 1; on one side, all) of one block pair."""
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1) if (side == 1).any() else first
    inter = shared_counts(flat, size, first, second)
    union = size[first][:, None] + size[second][None, :] - inter
    # A link counts where the two share a table: both a half key of the first and of the second kind.
    shared_a = np.zeros(inter.shape, bool)
    shared_b = np.zeros(inter.shape, bool)
    for k in range(HALVES):
        shared_a |= halves[first, k][:, None] == halves[second, k][None, :]
        shared_b |= halves[first, HALVES + k][:, None] == halves[second, HALVES + k][None, :]
    hit = (100 * inter >= percent * union) & shared_a & shared_b & (comp[first][:, None] != comp[second][None, :])
    return joining(ids, comp, first, second, hit)


def links(docs: DataFrame, scratch: common.Scratch, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signature table of all rows, (id, component) of the doc_ids that have links or copies).

    1. Rows with the same shingle set are one node, named by the smallest doc_id; a doc_id with
       several sets links their nodes.
    2. Table keys with up to SMALL_BUCKET nodes give all pairs; larger ones give pairs with their
       most central node only, central being a member of many and large buckets.
    3. Pairs are verified on the full sets, and components are taken.
    4. Exact pass for the large buckets: families (components of the pairs with centres) are parted by
       size; nodes outside their family's largest component meet those of a like size, block by
       block inside tasks. Only links that join components come out. No candidate is dropped.
    """
    signs = scratch.keep(_signature_table(docs.where(F.col("doc_id").isNotNull()), words))
    full = signs.where("n_shingles > 0")
    name = ["set_a", "set_b", "n_shingles"]
    nodes = scratch.keep(full.groupBy(*name).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min("halves").alias("halves")))
    # Each row's node: its own id, unless others have the same set.
    copies = nodes.where("n > 1").select(*name, "n", F.col("id").alias("_node"))
    in_rows = signs.count()
    copied = common.dealt_join(full.select("doc_id", *name), copies, name, in_rows).select("doc_id", "_node")
    copied = scratch.keep(copied.where("doc_id != _node").distinct())
    # A doc_id with several texts links all that they are in.
    several = scratch.keep(full.select("doc_id", *name).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    tied = common.small_join(copied, several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("_node").alias("b"))
    pair = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda i: F.transform(F.sequence(F.lit(HALVES), F.lit(2 * HALVES - 1)), lambda j: F.xxhash64(i, j, F.col("halves")[i], F.col("halves")[j])))))
    keyed = nodes.select("id", "n_shingles", pair.alias("key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    in_tables = shared.agg(F.sum("n")).first()[0] or 0
    members = scratch.keep(common.dealt_join(keyed, shared, ["key"], in_tables))

    small = members.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("_id"), F.col("n_shingles").alias("_size"))
    close = F.lit(100) * F.least("n_shingles", "_size") >= F.lit(percent) * F.greatest("n_shingles", "_size")
    pairs = small.join(other, "key").where((F.col("id") < F.col("_id")) & close).select(F.col("id").alias("a"), F.col("_id").alias("b"))
    hot = members.where(F.col("n") > SMALL_BUCKET)
    any_hot = not hot.isEmpty()
    if any_hot:
        weight = hot.groupBy("id").agg(F.sum("n").alias("weight"))
        top = F.max(F.struct("weight", (-F.col("id")).alias("_less")))
        centres = hot.join(weight, "id").groupBy("key").agg((-top["_less"]).alias("_centre"), F.count("*").alias("n"))
        spokes = common.dealt_join(hot.drop("n"), scratch.keep(centres), ["key"], in_tables).where(F.col("id") != F.col("_centre"))
        spokes = scratch.keep(spokes.select(F.col("id").alias("a"), F.col("_centre").alias("b")).distinct())
        pairs = pairs.union(spokes.select("a", "b"))
    pairs = scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = scratch.keep(set_table(common.small_join(docs.select("doc_id", "text"), wanted, "doc_id", "left_semi"), words))
    found = scratch.keep(_verified(pairs, sets, percent).union(tied))
    grouped = components(found, scratch)
    scratch.free(shared, members)
    if any_hot:
        family = components(spokes.select("a", "b"), scratch).select("id", F.col("component").alias("family"))
        here = family.join(grouped, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component"))
        here = here.join(nodes.select("id", F.col("n_shingles").alias("size"), "halves"), "id")
        found = scratch.keep(found.union(_exact_pass(*meetings(here, percent / 100, scratch), sets, percent)))
        grouped = components(found, scratch)
    # Ids of copies take the component of the set's name.
    of = copies.groupBy("_node").agg(F.sum("n").alias("n")).join(grouped, F.col("_node") == F.col("id"), "left").select("_node", "n", F.coalesce("component", "_node").alias("component"))
    one = common.small_join(copied, several, "doc_id", "left_anti")
    joined = common.dealt_join(one, scratch.keep(of), ["_node"], in_rows).select(F.col("doc_id").alias("id"), "component")
    return signs, grouped.unionByName(joined)


def meetings(here: DataFrame, ratio: float, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Block pairs in which the sets (family, id, size, component, ...) of a family may link, but for those within a component.

    Sets are parted by size into classes, of which only equal or neighbouring ones hold sizes with a
    ratio of `ratio` or more. Sets outside the family's largest component (side 0) meet those of their classes (side 1).
    Either side is cut into blocks of BLOCK rows or BLOCK_SHINGLES shingles, as expected, and each pair
    of blocks is a group of its own, so that a set goes out once for each block of the other side.
    Returns the rows of both sides, with family, class, _first, _second and _side, and the ids among them.
    """
    width = -math.log(max(1e-6, ratio)) * (1 + 1e-9)
    here = scratch.keep(here.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / width)))
    share = here.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = share.groupBy("family").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    largest = scratch.keep(largest.where("parts > 1").select("family", F.col("most.component").alias("largest"), "n"))
    here = scratch.keep(common.dealt_join(here, largest, ["family"], here.count()).drop("n"))
    rest = here.where("component != largest").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    plan = here.groupBy("family", "class").agg(blocks.alias("blocks"), F.count("*").alias("n"))
    plan = plan.join(rest.groupBy("family", "class").agg(blocks.alias("rest_blocks"), F.count("*").alias("_n")), ["family", "class"])
    plan = scratch.keep(plan.withColumn("n", F.greatest("n", "_n")).drop("_n"))
    count = 3 * here.count()
    at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_rest = common.dealt_join(rest, plan, ["family", "class"], count).select("*", each("blocks").alias("_second")).withColumn("_first", at("rest_blocks", 1)).withColumn("_side", F.lit(0))
    as_all = common.dealt_join(here, plan, ["family", "class"], count).select("*", each("rest_blocks").alias("_first")).withColumn("_second", at("blocks", 2)).withColumn("_side", F.lit(1))
    live = here.join(plan.select("family", "class"), ["family", "class"], "left_semi").select("id").union(rest.select("id"))
    return as_rest.unionByName(as_all), scratch.keep(live.distinct())


def _exact_pass(every: DataFrame, live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of a family, from the rows of meetings()."""
    own = common.small_join(sets, live, "id", "left_semi")
    every = every.join(own, "id").where(F.size("shingles") == F.col("size"))
    every = every.select("family", "class", "_first", "_second", "_side", "id", "component", "halves", "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(group: pa.Table) -> pa.Table:
        side = group.column("_side").to_numpy()
        if not (side == 0).any() or not (side == 1).any():
            return schema.empty_table()
        flat = pa.concat_arrays([c.flatten() for c in group.column("shingles").chunks]).to_numpy()
        size = np.concatenate([pa.compute.list_value_length(c).to_numpy() for c in group.column("shingles").chunks]).astype(np.int64)
        halves = pa.concat_arrays([c.flatten() for c in group.column("halves").chunks]).to_numpy().reshape(-1, 2 * HALVES)
        found = _linked_in_block(group.column("id").to_numpy(), flat, size, halves, group.column("component").to_numpy(), side, percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return every.groupBy("family", "class", "_first", "_second").applyInArrow(block, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts link where 100 * |intersection| >= percent * |union| of their sets of `words`-word
    shingles. A text with fewer words is one shingle; one without words (or null) has none and
    links with nothing. component_id is the smallest doc_id reachable. Rows with the same doc_id
    are one node, also with several texts. A row without doc_id takes no part: component_id null, kept true.
    """
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs, grouped = links(docs, scratch, words, percent)
    out = signs.select("doc_id", "n_shingles").join(grouped.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = docs.where(F.col("doc_id").isNull())
    extra = _signature_table(lost, words).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return scratch.tie(out.unionByName(extra))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, that near_duplicates() keeps.

    The ids to drop go to the texts, never the texts to the ids, if they are few; of rows that
    repeat the kept doc_id, all stay with their text.
    """
    result = near_duplicates(docs, words, percent)
    dropped = result._siftwork_scratch.keep(result.where(~F.col("kept")).select("doc_id").distinct())
    out = common.small_join(docs, dropped, "doc_id", "left_anti")
    return result._siftwork_scratch.tie(out.select(*docs.columns))
