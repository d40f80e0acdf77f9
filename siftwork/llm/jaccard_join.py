"""Exact Jaccard join of shingle sets in their metric space.

The distance of two sets is 1 - |intersection| / |union|, which obeys the triangle inequality. Two
sets link within REACH = 1 - percent / 100. Of the links, what matters are the components.

* The smallest id of the sets that share a minhash is a candidate pivot. Of those with which a set
  shares most minhashes, hence the nearest by that estimate, the distance is taken; a set within the
  level's cell radius of it belongs to its Voronoi cell, and every other set is a pivot itself.
* The pivots are joined exactly: pivots p and q with radii R whose cells may hold a link are within
  REACH + R(p) + R(q), so that they share one of the first shingles of each, in one order of all
  shingles; the wider a cell, the more of its pivot's shingles count. The order puts frequent
  shingles last.
* Pivots within REACH of each other link. Where they are not, but near enough for a link between
  their members, and their components still differ, the triangle inequality gives each cell a window:
  only members at least d(p, q) - REACH - R(q) from their pivot p can link into q's cell. These
  boundary sets are the input of the next level, whose cells are half as wide; on the last level, which
  comes at once when few sets are left, cells hold one set each and nothing stays open.

Full sets are larger than their texts, so that they move only for pairs and families that sketches leave: the parities of
the shingles by residue (`sketches`), in which two sets differ in no more places than they differ in shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm import common, neardup
from siftwork.llm.components import components

#: Minhashes by which a set meets candidate pivots; so many it shares with the one it is measured against.
LANDMARKS, SHARED = 6, 2
#: Cell radius of the first level as a share of REACH, levels at most, and the sets from which on a level has cells.
CELL, LEVELS, CELLS_FROM = 0.25, 4, 10_000
#: A shingle list up to this size gives all pairs; larger ones are joined in blocks.
SMALL_LIST = 24
#: Share of a set, its smallest hashes, that is counted to find frequent shingles: where no more of a set is frequent than of
#: it is not among its first shingles, none of the first is. From so many sets on; so many shingles are named.
COUNTED, FREQUENT_FROM, FREQUENT = 0.35, 8, 1 << 16
#: One more shingle is named for each so many of all sets, as those that are frequent grow with the sets; but no more than so many.
FREQUENT_OF, FREQUENT_MOST = 2000, 1 << 22
#: Full sets that move at once: at least so many bytes, else so many for each shingle of all sets (a set has 8 for each).
AT_ONCE, AT_ONCE_OF = 64 << 20, 2
#: Rows of a long list that meet in one step; shorter lists are packed to about as many.
LIST_ROWS = 4096
#: Words of sketches that are compared in one step.
SKETCH_WORDS = 1 << 19
#: Far above the rounding of a distance, far below the difference of two.
SLACK = 1e-9
#: Columns of postings.
_POSTING = {"s": (pa.int64(), "long"), "id": (pa.int64(), "long"), "size": (pa.int32(), "int"), "need": (pa.float32(), "float"), "radius": (pa.float64(), "double")}


def _set_names(docs: DataFrame, words: int) -> DataFrame:
    """n_shingles, a 128-bit name of the set and LANDMARKS minhashes of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("marks", pa.list_(pa.int64()))])
    salts = common.mix64(np.arange(1, LANDMARKS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                flat, size = neardup.shingles_of(part.column(1), words)
                marks = np.zeros((len(size), LANDMARKS), np.uint64)
                if len(full := np.flatnonzero(size)):
                    start = (np.cumsum(size) - size)[full]
                    for k, salt in enumerate(salts):
                        marks[full, k] = np.minimum.reduceat((flat ^ salt) * np.uint64(0xD6E8FEB86659FD93), start)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * LANDMARKS), pa.array(marks.reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in (size, *neardup.set_names(flat, size))], lists], schema=schema)

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, "doc_id long, n_shingles long, set_a long, set_b long, marks array<long>")


def first_bits(frequent: np.ndarray) -> np.ndarray:
    """Whether one of the frequent shingles has these first bits; most others have none of theirs."""
    bits = min(max(20, (16 * len(frequent) - 1).bit_length()), 24)
    out = np.zeros(1 << bits, bool)
    out[frequent >> np.uint64(64 - bits)] = True
    return out


def places(flat: np.ndarray, size: np.ndarray, frequent: np.ndarray, maybe: np.ndarray | None = None) -> np.ndarray:
    """The place of each shingle of all sets in its own set, in the order of all shingles: frequent ones last, else by value."""
    start = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(start, size)
    if not len(frequent) or not len(flat):
        return place
    maybe = first_bits(frequent) if maybe is None else maybe
    last = np.flatnonzero(maybe[flat >> np.uint64(65 - len(maybe).bit_length())])
    last = last[frequent[np.minimum(np.searchsorted(frequent, flat[last]), len(frequent) - 1)] == flat[last]]
    if len(last):
        known = np.zeros(len(flat) + 1, np.int64)
        known[last + 1] = 1
        np.cumsum(known, out=known)  # how many before
        before = known[:-1] - np.repeat(known[start], size)
        own = np.repeat(known[start + size] - known[start], size)
        at = np.zeros(len(flat), bool)
        at[last] = True
        place = np.where(at, np.repeat(size, size) - own + before, place - before)
    return place


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set's shingles in the order of all shingles; both inputs sorted."""
    out = np.empty_like(shingles)
    out[places(shingles, np.array([len(shingles)]), frequent)] = shingles
    return out


def _postings(docs: DataFrame, words: int, reach: Column, frequent: np.ndarray, columns: tuple[str, ...] = tuple(_POSTING)) -> DataFrame:
    """`columns` of (s, id, size, need, radius): the first shingles of each row's set; `need` is the distance from which s counts."""
    schema = pa.schema([(c, _POSTING[c][0]) for c in columns])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = first_bits(frequent)
        for batch in batches:
            for part in common.slices(batch, "_text"):
                flat, size = neardup.shingles_of(part.column(1), words)
                far = part.column(2).to_numpy(zero_copy_only=False)
                count = np.where(size > 0, np.minimum(np.floor(far * size + SLACK).astype(np.int64) + 1, size), 0)
                place = places(flat, size, frequent, maybe)
                first = place < np.repeat(count, size)
                s, place, row = flat[first].view(np.int64), place[first], np.repeat(np.arange(len(size)), count)
                made = {"s": s}
                if "need" in columns:  # rounded down: a posting may count a little too early, never too late
                    made["need"] = np.nextafter((place / np.maximum(size[row], 1)).astype(np.float32), np.float32(-1))
                if "id" in columns:
                    made["id"], made["radius"] = (part.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 3))
                    made["size"] = size[row].astype(np.int32)
                for low in range(0, len(row), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(made[c][low : low + (1 << 16)]) for c in columns], schema=schema)

    wanted = docs.select("doc_id", F.col("text").alias("_text"), reach.cast("double").alias("_reach"), F.col("radius").cast("double").alias("radius"))
    return common.arrow_map(wanted, kernel, ", ".join(f"{c} {_POSTING[c][1]}" for c in columns))


def sketches(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A sketch of each set: by residue of the shingles, whether their number is odd; a bit or two a shingle, 64 at least."""
    bits = np.left_shift(64, np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64))
    start = np.cumsum(bits) - bits
    at = np.repeat(start, size) + (flat & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    offsets = pa.array(np.append(start, bits.sum()) // 8, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(np.packbits(odd, bitorder="little"))])


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words of all sketches end to end, and the first and the number of each row."""
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint64) if data.ctypes.data % 8 == 0 else data.copy().view(np.uint64), (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row) of fewer bits: residues of residues."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


def _places_apart(words: np.ndarray, first: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the sketches of rows a and b differ, pair by pair: at most as many as shingles are in one set only."""
    out = np.zeros(len(a), np.int64)
    kind = width[a] << 32 | width[b]
    for k in np.unique(kind).tolist():
        of = np.flatnonzero(kind == k)
        least = min(k >> 32, k & 0xFFFFFFFF)
        one, two = (_folded(words[first[x[of]][:, None] + np.arange(w)], least) for x, w in ((a, k >> 32), (b, k & 0xFFFFFFFF)))
        out[of] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def most_apart(both: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Shingles that may be in one set only, of sets with `both` shingles in all and a distance of `far` at most; rounded up."""
    far = np.minimum(far, 1.0)
    return far * both / (2 - far) + 0.5


def _sketch_table(docs: DataFrame, words: int) -> DataFrame:
    """id, size and sketch of each row's set."""
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text"):
                flat, size = neardup.shingles_of(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int32()), sketches(flat, size)], schema=schema)

    return common.arrow_map(docs.select("doc_id", F.col("text").alias("_text")), kernel, "id long, size int, sketch binary")


def _sketched(pairs: DataFrame, docs: DataFrame, words: int, scratch: common.Scratch) -> DataFrame:
    """Of the pairs (a, b, far) those whose sketches do not rule out that they are within `far`, with the shingles (held) of both."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    table = scratch.keep(_sketch_table(common.small_join(docs, ids, "doc_id", "left_semi"), words))
    met = neardup.with_sets(pairs, table.select("id", F.struct("size", "sketch").alias("shingles")))
    met = met.select("a", "b", "far", *[F.col(f"_s{x}.{c}").alias(f"_{c}{x}") for x in "ab" for c in ("size", "sketch")])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("held", pa.int64())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            both = (batch.column(3).to_numpy().astype(np.int64) + batch.column(5).to_numpy())
            apart = _places_apart(*_words_of(pa.concat_arrays([batch.column(4), batch.column(6)])), np.arange(n), np.arange(n, 2 * n))
            near = pa.array(apart <= most_apart(both, batch.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(both).filter(near)], schema=schema)

    left = common.arrow_map(met, kernel, "a long, b long, held long")
    return scratch.keep(left.groupBy("a", "b").agg(F.max("held").alias("held")))


def _at_once(held: int) -> int:
    return max(AT_ONCE, AT_ONCE_OF * held)


def _measured(pairs: DataFrame, docs: DataFrame, words: int, held: tuple[int, int], scratch: common.Scratch) -> DataFrame:
    """pairs (a, b, far) with inter and union of their full sets, those within `far` at least; of an id with several sets, for each.

    Pairs whose sets are more than what moves at once (`held`: shingles and rows in all) are first looked at by their sketches; those
    that are left are measured in as many rounds as it takes. Pairs that are few enough to broadcast go to the sets of one side
    where these are made, so that a set moves once for each of its pairs; else both sides are shuffled.
    """
    pairs, rounds = scratch.keep(pairs), 1
    if 16 * pairs.count() * held[0] > _at_once(held[0]) * held[1]:
        pairs = _sketched(pairs, docs, words, scratch)
        rounds = max(1, -(-8 * (pairs.agg(F.sum("held")).first()[0] or 0) // _at_once(held[0])))
    found = []
    for k in range(rounds):
        some = pairs.select("a", "b") if rounds == 1 else scratch.keep(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k).select("a", "b"))
        sets = lambda x: neardup.set_table(common.small_join(docs, some.select(F.col(x).alias("doc_id")).distinct(), "doc_id", "left_semi"), words)  # noqa: B023, E731  called at once
        if some.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
            first = sets("a").select(F.col("id").alias("a"), F.col("shingles").alias("_sa")).join(F.broadcast(some), "a")
        else:
            first = neardup.with_sets(some, sets("a"), None, ("a",))
        out = neardup.with_sets(some, sets("b"), first, ("b",))
        inter = F.size(F.array_intersect("_sa", "_sb"))
        found.append(scratch.keep(out.select("a", "b", inter.alias("inter"), (F.size("_sa") + F.size("_sb") - inter).alias("union")).where("inter > 0")))
    return functools.reduce(DataFrame.union, found)


def _apart() -> Column:
    return F.lit(1.0) - F.col("inter") / F.col("union")


def _close_sizes(a: Column, b: Column, far: Column) -> Column:
    return F.least(a, b) >= (F.lit(1.0 - SLACK) - far) * F.greatest(a, b)


def links_of_block(ids, flat, size, comp, radius, side, percent: int) -> tuple[list[tuple[int, int]], dict[int, float]]:
    """Of a block pair: links that join components, and for each pivot the ring from which its members may link on.

    Rows of side 0 meet those of side 1; `flat` holds the shingles of all rows end to end.
    """
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inter = neardup.shared_counts(flat, size, first, second)
    union = size[first][:, None] + size[second][None, :] - inter
    other = comp[first][:, None] != comp[second][None, :]
    hit = (100 * inter >= percent * union) & other
    rings: dict[int, float] = {}
    if radius.any():
        reach = 1 - percent / 100
        apart = 1 - inter.astype(np.float64) / union
        may = other & ~hit & (apart <= reach + radius[first][:, None] + radius[second][None, :] + SLACK)
        for i, j in zip(*np.nonzero(may), strict=True):
            for x, y in ((first[i], second[j]), (second[j], first[i])):
                ring = float(apart[i, j] - reach - radius[y])
                rings[int(ids[x])] = min(ring, rings.get(int(ids[x]), ring))
    return neardup.joining(ids, comp, first, second, hit), rings


def _cells(marks: DataFrame, docs: DataFrame, several: DataFrame, words: int, percent: int, cell: float, held: tuple[int, int], scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(links of sets with candidate pivots; members (id, home, r) of the cells) from the sets' minhashes."""
    keyed = marks.select("id", F.posexplode("marks").alias("_k", "_m")).select("id", F.xxhash64("_k", "_m").alias("key"))
    lead = scratch.keep(keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    total = lead.agg(F.sum("n")).first()[0] or 0
    met = common.dealt_join(keyed, lead, ["key"], total).where("id != lead").groupBy("id", "lead").agg(F.count("*").alias("n"))
    best = met.where(F.col("n") >= SHARED).groupBy("id").agg(F.max(F.struct("n", (-F.col("lead")).alias("less"))).alias("best"))
    near = _measured(best.select(F.col("id").alias("a"), (-F.col("best.less")).alias("b"), F.lit(max(cell, 1 - percent / 100) + SLACK).alias("far")), docs, words, held, scratch)
    # Ids with several sets stand alone. A pivot is in no cell itself.
    close = near.where(_apart() <= cell).select("a", "b", _apart().alias("r")) if cell > 0 else near.select("a", "b", F.lit(0.0).alias("r")).limit(0)
    for side in ("a", "b"):
        close = common.small_join(close, several.select(F.col("doc_id").alias(side)), side, "left_anti")
    close = scratch.keep(close)
    inner = close.select(F.col("a").alias("b")).distinct()
    pivots = scratch.keep(close.groupBy("b").agg(F.count("*").alias("n")).join(inner, "b", "left_anti"))
    chosen = common.dealt_join(close, pivots, ["b"], close.count()).groupBy("a").agg(F.min(F.struct("r", "b")).alias("best"))
    return _alike(near, percent), scratch.keep(chosen.select(F.col("a").alias("id"), F.col("best.b").alias("home"), F.col("best.r").alias("r")))


def _alike(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.col("inter") * 100 >= F.col("union") * percent).select("a", "b")


def _frequent(docs: DataFrame, words: int, held: tuple[int, int], scratch: common.Scratch) -> np.ndarray:
    """The most frequent shingles, counted among the smallest hashes of every set; they decide the work, never the result."""
    low = _postings(docs.withColumn("radius", F.lit(0.0)), words, F.lit(COUNTED), np.zeros(0, np.uint64), ("s",))
    often = low.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = scratch.keep(often.orderBy(F.desc("n"), "s").limit(max(FREQUENT, min(held[0] // FREQUENT_OF, FREQUENT_MOST))).select("s")).toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).astype(np.uint64))


def joining_of_list(ids, comp, size, radius, sketch: pa.Array, first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Links enough to join what the sketches allow: rows of `first` and of `second` that may be within reach, and their radii, of another component."""
    words, start, width = _words_of(sketch)
    label, out = np.arange(len(ids)), []
    kinds = [(one, rows) for one in np.unique(width).tolist() for rows in [words[start[width == one][:, None] + np.arange(one)]]]
    place = np.zeros(len(ids), np.int64)
    for one, _ in kinds:
        place[width == one] = np.arange((width == one).sum())
    for one, rows in kinds:
        for two, others in kinds:
            i, j, least = first[width[first] == one], second[width[second] == two], min(one, two)
            if not len(i) or not len(j):
                continue
            a, b = _folded(rows[place[i]], least), _folded(others[place[j]], least)
            step = max(1, SKETCH_WORDS // (len(j) * least))
            for low in range(0, len(i), step):
                some = i[low : low + step]
                apart = np.bitwise_count(a[low : low + step, None] ^ b[None]).sum(axis=2, dtype=np.int64)
                most = most_apart(size[some][:, None] + size[j][None].astype(np.int64), reach + SLACK + radius[some][:, None] + radius[j][None])
                may = (apart <= most) & (np.abs(size[some][:, None] - size[j][None]) <= most) & (comp[some][:, None] != comp[j][None])
                for k in np.flatnonzero(may.any(axis=1)).tolist():
                    x = some[k]
                    for other in np.unique(label[j[may[k]]]).tolist():
                        if other != label[x]:
                            out.append((int(ids[x]), int(ids[other])))
                            label[label == other] = label[x]
    return out


def _families(long: DataFrame, docs: DataFrame, words: int, reach: float, scratch: common.Scratch) -> DataFrame:
    """(id, family) of the sets in long lists (s, id, size, radius, component, n): a list's sets are of one only where their sketches allow a link.

    A list of more than LIST_ROWS sets is cut into blocks, of which each pair meets in a step of its own.
    """
    ids = long.select(F.col("id").alias("doc_id")).distinct()
    table = _sketch_table(common.small_join(docs, scratch.keep(ids), "doc_id", "left_semi"), words)
    cut, packs = F.ceil(F.col("n") / LIST_ROWS).cast("int"), F.lit(1 + long.count() // LIST_ROWS)
    rows = long.select("s", "id", "size", "radius", "component", cut.alias("_cut")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_cut")).cast("int"))
    rows = rows.withColumn("_pack", F.when(F.col("_cut") == 1, F.pmod(F.xxhash64("s"), packs)).otherwise(F.col("s"))).join(table, ["id", "size"])
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1))).withColumn("_first", F.least("_own", "_other")).withColumn("_second", F.greatest("_own", "_other"))
    rows = rows.select("_pack", "_cut", "_first", "_second", "s", "id", "size", "radius", "component", "_own", "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def lists(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("s").combine_chunks()
        s, ids, size, radius, comp, own = (group.column(c).to_numpy() for c in ("s", "id", "size", "radius", "component", "_own"))
        least, found = group.column("_first")[0].as_py(), []
        cuts = np.r_[0, np.flatnonzero(np.diff(s)) + 1, len(s)].tolist()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(low, high)
            if (comp[at] == comp[low]).all():
                continue
            # Of two blocks, each row of one meets all of the other; within one block all meet.
            first = np.flatnonzero(own[at] == least)
            second = np.flatnonzero(own[at] != least) if group.column("_second")[0].as_py() != least else first
            if len(first) and len(second):
                found += joining_of_list(ids[at], comp[at], size[at], radius[at], group.column("sketch").chunk(0).slice(low, high - low), first, second, reach)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    found = scratch.keep(rows.groupBy("_pack", "_cut", "_first", "_second").applyInArrow(lists, "a long, b long"))
    return components(found, scratch).select("id", F.col("component").alias("family"))


def _in_blocks(long: DataFrame, known: DataFrame, docs: DataFrame, words: int, percent: int, far: float, scratch: common.Scratch) -> DataFrame:
    """(a, b, ring): links of pivots that share a long list, with b; and rings of pivots, without.

    Sets of long lists are of one family where their sketches allow links; they meet as neardup.meetings() deals them.
    """
    here = long.drop("component").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    here = scratch.keep(here.select("s", "id", "size", "radius", "component", "n"))
    family = _families(here, docs, words, 1 - percent / 100, scratch)
    here = here.select("id", "size", "radius", "component").distinct().join(family, "id")
    every, live = neardup.meetings(here, 1 - far, scratch)
    sets = neardup.set_table(common.small_join(docs, live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), words)
    every = every.join(sets, "id").where(F.size("shingles") == F.col("size"))
    every = every.select("family", "class", "_first", "_second", "_side", "id", "component", "radius", "shingles")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ring", pa.float64())])

    def block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("_side").to_numpy()
        if not (side == 0).any() or not (side == 1).any():
            return schema.empty_table()
        lists = group.column("shingles").chunk(0)
        size = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        found, rings = links_of_block(group.column("id").to_numpy(), lists.flatten().to_numpy(), size, group.column("component").to_numpy(), group.column("radius").to_numpy(), side, percent)
        rows = [(a, b, None) for a, b in found] + [(a, None, ring) for a, ring in rings.items()]
        return pa.table([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return scratch.keep(every.groupBy("family", "class", "_first", "_second").applyInArrow(block, "a long, b long, ring double"))


def _semi(posts: DataFrame, shingles: DataFrame, free: Column) -> DataFrame:
    """Postings that are `free` or have one of `shingles`, which are broadcast if they are few."""
    if shingles.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        found = F.broadcast(shingles.withColumn("_known", F.lit(True)))
        return posts.join(found, "s", "left").where(free | F.col("_known").isNotNull()).drop("_known")
    return posts.where(free).unionByName(posts.where(~free).join(shingles, "s", "left_semi"))


def _level(docs: DataFrame, marks: DataFrame, several: DataFrame, links: DataFrame, words: int, percent: int, cell: float, further: bool, held: tuple[int, int], scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(`links` and those of this level, ids (doc_id) that may have links left) for the sets of `docs`."""
    reach = 1 - percent / 100
    landmarks, members = _cells(marks, docs, several, words, percent, cell * reach, held, scratch)
    # What is known to be one component may be too little, never too much: at first a set and its candidate pivot.
    known = components(scratch.keep(links.union(landmarks)), scratch) if further else landmarks.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()
    links = scratch.keep(links.union(landmarks))
    wide = scratch.keep(members.groupBy("home").agg(F.max("r").alias("radius")))
    widest = wide.agg(F.max("radius")).first()[0] or 0.0
    roles = members.select(F.col("id").alias("doc_id"), F.lit(None).cast("double").alias("_radius"), F.lit(True).alias("_inner"))
    roles = scratch.keep(roles.union(wide.select("home", "radius", F.lit(False))))
    pivots = common.small_join(docs, roles, "doc_id", "left").where(~F.coalesce("_inner", F.lit(False)))
    pivots = pivots.select("doc_id", "text", F.coalesce("_radius", F.lit(0.0)).alias("radius"))
    often = _frequent(docs, words, held, scratch)
    first = functools.partial(_postings, pivots, words, F.lit(reach + widest) + F.col("radius"), often)
    counted, posts = first(("s",)), first()
    if widest > 0:  # beyond REACH, a shingle counts only where a wide pivot has it as well
        of_wide = _postings(pivots.where("radius > 0"), words, F.lit(reach + widest) + F.col("radius"), often, ("s",))
        of_wide = scratch.keep(of_wide.distinct())
        counted, posts = (_semi(x, of_wide, F.col("need") <= reach + SLACK) for x in (first(("s", "need")), posts))
    shared = scratch.keep(counted.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    few = shared.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    lists = posts.join(F.broadcast(shared), "s") if few else common.dealt_join(posts, shared, ["s"], total)
    lists = scratch.keep(common.small_join(lists, known, "id", "left").withColumn("component", F.coalesce("component", "id")))

    short = lists.where(F.col("n") <= SMALL_LIST)
    right = short.select("s", *[F.col(c).alias(f"_{c}") for c in ("id", "size", "need", "radius", "component")])
    far = F.lit(reach + SLACK) + F.col("radius") + F.col("_radius")
    may = (F.col("id") < F.col("_id")) & (F.col("component") != F.col("_component")) & (F.col("need") <= far) & (F.col("_need") <= far) & _close_sizes(F.col("size"), F.col("_size"), far)
    pairs = scratch.keep(short.join(right, "s").where(may).select(F.col("id").alias("a"), F.col("_id").alias("b"), far.alias("far")).distinct())
    measured = _measured(pairs.groupBy("a", "b").agg(F.max("far").alias("far")), docs, words, held, scratch)
    links = scratch.keep(links.union(_alike(measured, percent)))
    rings = scratch.keep(links.select(F.col("a").alias("home"), F.lit(0.0).alias("ring")).limit(0))
    if widest > 0:
        apart = scratch.keep(measured.join(pairs, ["a", "b"]).where((F.col("inter") * 100 < F.col("union") * percent) & (_apart() <= F.col("far"))).select("a", "b", _apart().alias("apart")))
        for own, other in (("a", "b"), ("b", "a")):
            ring = F.col("apart") - reach - F.coalesce("radius", F.lit(0.0))
            rings = rings.union(common.small_join(apart, wide.withColumnRenamed("home", other), other, "left").select(F.col(own).alias("home"), ring.alias("ring")))
    long = lists.where(F.col("n") > SMALL_LIST)
    if not long.isEmpty():
        found = _in_blocks(long, components(links, scratch), docs, words, percent, min(1.0, reach + 2 * widest), scratch)
        links = scratch.keep(links.union(found.where("b IS NOT NULL").select("a", "b")))
        rings = rings.union(found.where("b IS NULL").select("a", "ring"))
    rings = scratch.keep(rings.groupBy("home").agg(F.min("ring").alias("ring")))
    inside = members.join(rings, "home").where(F.col("r") >= F.col("ring") - SLACK).select(F.col("id").alias("doc_id"))
    scratch.free(shared, lists)
    return links, scratch.keep(inside.union(rings.where(F.col("ring") <= SLACK).select("home")))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Texts link where 100 * |intersection| >= percent * |union| of their sets of `words`-word
    shingles; no link between different sets is missed but those within a component. A text with
    fewer words is one shingle; one without words (or null) has none and links with nothing.
    component_id is the smallest doc_id reachable. Rows with the same doc_id are one node, also with
    several texts. A row without doc_id takes no part: component_id null. An empty table gives no rows.
    Shingles are compared by 64-bit hashes.
    """
    scratch = common.Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lost, docs = docs.where(F.col("doc_id").isNull()), docs.where(F.col("doc_id").isNotNull())
    names = scratch.keep(_set_names(docs, words))
    full, name = names.where("n_shingles > 0"), ["set_a", "set_b", "n_shingles"]
    nodes = scratch.keep(full.groupBy(*name).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.min("marks").alias("marks")))
    # Each row's node is the smallest doc_id with its set; a doc_id with several sets links them.
    rows = names.count()
    held = (names.agg(F.sum("n_shingles")).first()[0] or 0), max(rows, 1)
    copies = common.dealt_join(full.select("doc_id", *name), nodes.where("n > 1").select(*name, "n", F.col("id").alias("_node")), name, rows)
    copies = scratch.keep(copies.where("doc_id != _node").select("doc_id", "_node").distinct())
    several = scratch.keep(full.select("doc_id", *name).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    tied = common.small_join(copies, several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("_node").alias("b"))
    single = scratch.keep(common.small_join(copies, several, "doc_id", "left_anti"))
    links = scratch.keep(tied)
    if single.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        sets = docs.join(F.broadcast(single.select("doc_id")), "doc_id", "left_anti")
    else:  # the nodes may be few enough to go to the texts
        sets = common.small_join(docs, scratch.keep(nodes.select(F.col("id").alias("doc_id")).union(several).distinct()), "doc_id", "left_semi")
    marks = nodes.select("id", "marks")
    for level in range(LEVELS):
        most = marks.limit(CELLS_FROM + 1).count()
        cell = CELL / 2**level if most > CELLS_FROM and level < LEVELS - 1 else 0.0
        links, left = _level(sets, marks, several, links, words, percent, cell, level > 0, held, scratch)
        if left.isEmpty():
            break
        sets = common.small_join(sets, left.distinct(), "doc_id", "left_semi")
        marks = marks.join(left.distinct().withColumnRenamed("doc_id", "id"), "id", "left_semi")
    grouped = components(links, scratch)
    node_of = single.groupBy("_node").agg(F.count("*").alias("n")).join(grouped, F.col("_node") == F.col("id"), "left").select("_node", "n", F.coalesce("component", "_node").alias("component"))
    of_copies = common.dealt_join(single, scratch.keep(node_of), ["_node"], rows).select("doc_id", "component")
    grouped = grouped.select(F.col("id").alias("doc_id"), "component").unionByName(of_copies)
    out = names.select("doc_id", "n_shingles").join(grouped, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    extra = _set_names(lost, words).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return scratch.tie(out.unionByName(extra))
