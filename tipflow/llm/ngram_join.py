"""Operator 1: n-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct 5-word shingles.  Two documents
link when ``den * |a & b| >= num * |a | b|`` (3/4 unless said otherwise); the classes
are the connected components of the links.

1. Routing (Spark).  Two linked sets of size n and m share at least ``num/den * max(n, m)``
   shingles, so in any global order of the shingles they share one of the first
   ``n - ceil(n * num/den) + 1`` of each.  Every distinct set is sent to the blocks of these
   shingles.  The order puts shingles that are common in some part of the corpus last;
   the list of common shingles is a bounded hint (``HINTS``), and any list gives the same links.
2. Search (R-tree).  The shingles of a set are hashed into groups, a power of two of about a
   quarter of its size; the set is the point of its group counts.  A block's points are searched by
   size class (powers of two): a class's tree holds its own sets and those of the next class, whose
   groups fold onto the class's.  The tree packs the points into leaves and nodes with the largest
   coordinates and the smallest size below them.  The sum of the coordinate minima of a query and a
   node bounds the overlap with everything below it, and prunes what cannot link.
3. Verification.  Surviving pairs are intersected exactly, unless links found before already
   join the two: such a pair cannot change a component.

Points are a small part of the shingles, so both rounds search points first and make and move the
shingles only of sets that are in a surviving pair.  Blocks of more than ``CHUNK`` sets are cut into
chunks.  The first round searches, for each set, only its largest block, chunk by chunk, and joins
the chunks by a few sets that go to all of them.  The second round takes every block that still
holds more than one component: its sets outside the block's largest component meet all others, chunk
by chunk, so a tree never holds more than two chunks.  A pair is passed over in a block if both
sets name an earlier block that holds them both (each row carries the first ``FIRSTS`` blocks of its
set); it had its turn there.  So a group of near copies of any size costs rows in proportion to
its size, and no pair of different components that shares a block is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipflow.llm.common import (
    BATCH_ROWS, SHINGLE, U64, Identity, anti_join, collected, identity, named, shift, shingle_sets, slices, small_batches, utf8,
    written)
from tipflow.llm.components import components

NUM, DEN = 3, 4            # similarity of 0.75
MIN_GROUPS, MAX_GROUPS = 64, 1 << 14  # coordinates of a point
FANOUT = 16                # points of a leaf, leaves of a node
CHUNK = 1024               # sets that one tree holds
FIRSTS = 32                # earlier blocks that a row names
BROADCAST_ROWS = 50_000    # of at most 320 bytes (16 MB)
HINTS = 200_000            # common shingles that are ordered last (bounds the broadcast: 16 bytes each)
LOCAL_REPEATS = 3          # a shingle counts as common if so many sets of one task's portion hold it
PORTION = 1 << 22          # shingles of a portion

_PROFILE = "kind int, id long, check long, a long, k1 long, k2 long, n int, point binary"
_PREFIX = "key long, id long, n int, hot long"


def _groups(n: int) -> int:
    """Coordinates for a set of n shingles: the same for a whole size class."""
    return min(MAX_GROUPS, max(MIN_GROUPS, 1 << max(0, n.bit_length() - 2)))


def _point(shingles: np.ndarray) -> np.ndarray:
    """Group counts of a set, in the narrowest type that holds them."""
    groups = _groups(len(shingles))
    counts = np.bincount((shingles & U64(groups - 1)).astype(np.int64), minlength=groups)
    most = counts.max()
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _unpack(point: bytes, n: int) -> np.ndarray:
    return np.frombuffer(point, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(point) // _groups(n)])


def _folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(-1, groups).sum(0, dtype=np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(batch, row, set) for each row, in slices of bounded size."""
    for batch in batches:
        text = batch.column("text")
        row = 0
        for a, b in slices(utf8(text)[1]):
            for s in shingle_sets(text.slice(a, b - a), k):
                yield batch, row, s
                row += 1


def profile(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (id, check, doc_id, key, size, point) of every row; kind 1: (shingle, local count) of common shingles."""

    def run(batches):
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def common():
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                often = counts >= LOCAL_REPEATS
                rows.extend((1, v, 0, c, None, None, 0, None) for v, c in zip(shift(values[often]).tolist(), counts[often].tolist()))
                held.clear()
                seen.clear()

        for batch, i, s in _sets(batches, k):
            ident = Identity.halves(s)
            rows.append((0, *ident, *(batch.column(c)[i].as_py() for c in ("doc_id", "k1", "k2")), len(s),
                         _point(s).tobytes() if len(s) else None))
            if ident not in seen:
                seen.add(ident)
                held.append(s)
                size += len(s)
                if size >= PORTION:
                    common()
                    size = 0
            if len(rows) >= BATCH_ROWS:
                yield from _tables(rows)
                rows = []
        common()
        yield from _tables(rows)

    return docs.select("doc_id", "text", "k1", "k2").mapInArrow(run, _PROFILE)


def _tables(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BATCH_ROWS`` rows at most."""
    for i in range(0, len(rows), BATCH_ROWS):
        yield _table(rows[i:i + BATCH_ROWS])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["kind", "id", "check", "a", "k1", "k2", "n", "point"])


def prefixes(docs: DataFrame, hints, ident_of: Identity, k: int, num: int, den: int) -> DataFrame:
    """(key, id, n, hot) of the first shingles of each set, once per task for equal sets."""

    def run(batches):
        values, counts = hints.value
        seen: set[int] = set()
        out: list[tuple] = []
        size = 0
        for _, _, s in _sets(batches, k):
            n = len(s)
            if not n:
                continue
            ident = ident_of(s)
            if ident in seen:
                continue
            if len(seen) < 1_000_000:  # only saves work: later steps take equal sets as one
                seen.add(ident)
            take = n - (n * num + den - 1) // den + 1
            hot = np.zeros(n, np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                hot = np.where(values[at] == s, counts[at], 0)
            if hot.any():
                order = np.lexsort((s, hot))[:take]
                first, hot = s[order], hot[order]
            else:
                first, hot = s[:take], hot[:take]
            out.append((first, hot, ident, n))
            size += take
            if size >= 200_000:
                yield _prefix_batch(out)
                out, size = [], 0
        if out:
            yield _prefix_batch(out)

    return docs.select("text").mapInArrow(run, _PREFIX)


def _prefix_batch(out: list[tuple]) -> pa.RecordBatch:
    lengths = [len(x[0]) for x in out]
    return pa.RecordBatch.from_arrays(
        [pa.array(shift(np.concatenate([x[0] for x in out]))),
         pa.array(np.repeat(np.array([x[2] for x in out], np.int64), lengths)),
         pa.array(np.repeat(np.array([x[3] for x in out], np.int32), lengths)),
         pa.array(np.concatenate([x[1] for x in out]))], names=["key", "id", "n", "hot"])


def blocks(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, n, cnt): blocks of two sets or more, one of each lot with the same members."""
    near = Window.partitionBy("key").orderBy("n", "id")
    cold = (prefix.where("hot = 0")
            .withColumn("before", F.lag("n").over(near)).withColumn("after", F.lead("n").over(near))
            # a set whose neighbours by size are too far off links with nothing here
            .where(f"before * {den} >= n * {num} or n * {den} >= after * {num}")
            .select("key", "id", "n"))
    warm = prefix.where("hot > 0").select("key", "id", "n")
    members = written(cold.unionAll(warm).distinct(), "members")
    stats = (members.groupBy("key")
             .agg(F.count("*").alias("cnt"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("total"))
             .where("cnt > 1"))
    kept = stats.groupBy("cnt", "total").agg(F.min("key").alias("key")).select("key", "cnt")
    return written(members.join(kept, "key"), "blocks")


BITMAP = 1 << 26  # bits of the filter of wanted doc_ids (bounds its broadcast: 8 MB)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Filter of ``ids (hash)`` with ``BITMAP`` bits."""
    words = collected(ids.select(F.pmod("hash", F.lit(BITMAP)).alias("bit"))
                      .groupBy(F.shiftright("bit", 6).alias("word"))
                      .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    out = np.zeros(BITMAP >> 6, np.int64)
    out[words["word"]] = words["bits"]
    return out.view(U64)


def shingles_of(docs: DataFrame, ids: DataFrame, rows: DataFrame, ident_of: Identity, k: int) -> tuple:
    """(id, shingles) of at least the given ids, made from one doc_id's text each, or from those without doc_id,
    and the broadcast to destroy once the result is no longer needed.

    Texts are not shuffled: a filter of bounded size picks the rows.  It may pick more.  Rows that
    repeat a doc_id may repeat an id.
    """
    first = rows.join(ids, "id").groupBy("id").agg(F.min("a").alias("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(first.select(F.xxhash64("doc_id").alias("hash"))))

    def run(batches):
        held: dict[int, bytes] = {}
        size = 0
        for batch in batches:
            at = batch.column("hash").to_numpy().astype(np.int64) % BITMAP
            wanted = (bits.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            for _, _, s in _sets([batch.filter(pa.array(wanted))], k):
                if len(s):
                    held[ident_of(s)] = s.tobytes()
                    size += s.nbytes
                if size > 8 << 20:
                    yield _shingle_batch(held)
                    held, size = {}, 0
        if held:
            yield _shingle_batch(held)

    return docs.select("text", F.xxhash64("doc_id").alias("hash")).mapInArrow(run, "id long, shingles binary"), bits


def _shingle_batch(held):
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.binary())],
                                      names=["id", "shingles"])


class Tree:
    """R-tree over count vectors, packed bottom-up: points, leaves, nodes of ``FANOUT``."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # sort-tile packing: slabs by size, then by the coordinate that varies most
        order = np.argsort(sizes, kind="stable")
        slab = FANOUT * max(1, int(np.sqrt(len(sizes) / FANOUT)))
        axis = int(np.argmax(points.var(0))) if len(points) else 0
        self.order = np.concatenate([part[np.argsort(points[part, axis], kind="stable")]
                                     for part in np.split(order, range(slab, len(order), slab))])
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            high, least = self.levels[-1]
            cuts = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(least, cuts)))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Members that may link with the query, best bound first."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            bound = np.minimum(high[at], point).sum(1, dtype=np.int64)
            # |a & b| >= num / (num + den) * (|a| + |b|)
            passes = (num + den) * bound >= num * (size + least[at])
            at, bound = at[passes], bound[passes]
            if depth and len(at):
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        ratio = bound / (size + self.levels[0][1][at] - np.minimum(bound, size))
        best = np.argsort(-ratio, kind="stable")
        return self.order[at[best]]


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of a sorted set with each of the others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    hits = one[at] == every
    return np.add.reduceat(hits.astype(np.int64), np.cumsum([0] + [len(x) for x in others[:-1]]))


def _classes(sizes: np.ndarray, points: list[np.ndarray]):
    """(members, tree, points, which are of this class) of each size class with the next one."""
    level = np.array([int(n).bit_length() for n in sizes])
    for c in np.unique(level):
        members = np.flatnonzero((level == c) | (level == c + 1))
        if len(members) > 1:
            groups = _groups((1 << int(c)) - 1)
            stack = np.stack([_folded(points[i], groups) for i in members])
            yield members, Tree(stack, sizes[members]), stack, level[members] == c


class Chunk:
    """Rows (key, chunk, id, grp, query, home, firsts, ...) that meet in one tree."""

    def __init__(self, rows: list[dict]):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.group = np.unique(np.array([r["grp"] for r in rows], np.int64), return_inverse=True)[1]
        self.query = np.array([r["query"] for r in rows])
        self.home = np.array([r["home"] for r in rows])
        key, last = rows[0]["key"], np.iinfo(np.int64).max
        # blocks before this one
        self.before = np.full((len(rows), FIRSTS), last)
        for i, r in enumerate(rows):
            early = [k for k in r["firsts"] if k < key]
            self.before[i, :len(early)] = early
        self.early = (self.before != last).sum(1)

    def pairs(self, sizes: np.ndarray, points: list[np.ndarray], num: int, den: int):
        """(q, candidates of other components, best bound first) of each query that has some."""
        for members, tree, stack, own in _classes(sizes, points):
            for i in np.flatnonzero(self.query[members]):
                q = members[i]
                near = tree.search(stack[i], sizes[q], num, den)
                near = members[near[own[near] | own[i]]]  # pairs of the next class have their turn
                near = near[(self.group[near] != self.group[q]) & (self.home[near] | self.home[q])]
                if len(near) and self.early[q]:
                    near = near[~np.isin(self.before[near], self.before[q, :self.early[q]]).any(1)]
                if len(near):
                    yield q, near


def link(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the sets of one chunk: those whose query flag is set against all.

    ``grp`` says which sets are known to be joined already.
    """
    chunk = Chunk(rows)
    group = chunk.group
    shingles = [np.frombuffer(r["shingles"], U64) for r in rows]
    sizes = np.array([len(s) for s in shingles], np.int64)
    found = []
    for q, near in chunk.pairs(sizes, [_point(s) for s in shingles], num, den):
        while len(near):
            # the best candidate of each other component, at most 64 at a time; the rest comes later
            tries = near[np.sort(np.unique(group[near], return_index=True)[1])][:64]
            shared = overlaps(shingles[q], [shingles[j] for j in tries])
            for j in tries[den * shared >= num * (sizes[q] + sizes[tries] - shared)]:
                if group[j] != group[q]:
                    found.append((int(chunk.ids[q]), int(chunk.ids[j])))
                    group[group == group[j]] = group[q]
            near = near[~np.isin(near, tries)]
            near = near[group[near] != group[q]]
    return found


def possible(rows: list[dict], num: int, den: int) -> np.ndarray:
    """Which sets of one chunk the points leave some link to another component."""
    sizes = np.array([r["n"] for r in rows], np.int64)
    out = np.zeros(len(rows), bool)
    for q, near in Chunk(rows).pairs(sizes, [_unpack(r["point"], r["n"]) for r in rows], num, den):
        out[near] = out[q] = True
    return out


def _trees(batches: Iterator[pa.RecordBatch]):
    """Rows of each (key, chunk) of sorted batches, one for each id, if there are two or more."""
    held: dict[int, dict] = {}
    at = None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["chunk"]) != at:
                if len(held) > 1:
                    yield list(held.values())
                held, at = {}, (row["key"], row["chunk"])
            held[row["id"]] = row
    if len(held) > 1:
        yield list(held.values())


def _by_chunk(work: DataFrame) -> DataFrame:
    return work.repartition("key", "chunk").sortWithinPartitions("key", "chunk")


def search(work: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of chunks with shingles -> links (u, v); equal (key, chunk) meet in one tree."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for rows in _trees(batches):
            out.extend(link(rows, num, den))
            if len(out) > 50_000:
                yield _links(out)
                out.clear()
        if out:
            yield _links(out)

    return _by_chunk(work).mapInArrow(run, "u long, v long")


_WORK = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()),
                   ("query", pa.bool_()), ("home", pa.bool_()), ("firsts", pa.list_(pa.int64()))])


def sift(work: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of chunks with n and point -> the rows that the points do not rule out, without these."""

    def run(batches):
        for rows in _trees(batches):
            keep = possible(rows, num, den)
            if keep.any():
                kept = [r for r, k in zip(rows, keep) if k]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in kept], f.type) for f in _WORK],
                                                 schema=_WORK)

    return _by_chunk(work).mapInArrow(
        run, "key long, chunk long, id long, grp long, query boolean, home boolean, firsts array<long>")


def _links(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                       pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])


def _first_round():
    """Places (chunk, home) of a set in its block: its own chunk; all chunks for about 8 sets of a large block."""
    chunks = F.ceil(F.col("cnt") / CHUNK)
    own = F.pmod(F.xxhash64("id"), chunks)
    pivot = F.pmod(F.xxhash64("id", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("cnt") / 8))) == 0
    every = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1),
                        lambda c: F.struct(c.alias("chunk"), (c == own).alias("home")))
    one = F.array(F.struct(own.alias("chunk"), F.lit(True).alias("home")))
    return F.when((F.col("cnt") > CHUNK) & pivot, every).otherwise(one)


def _second_round():
    """Places of a set: chunk i of the main component meets chunk j of the others (``query``), and these
    each other.  A pair counts where one of the two is at home, so each has its turn in one tree."""
    mains = F.ceil((F.col("cnt") - F.col("others")) / CHUNK)
    rest = F.ceil(F.col("others") / CHUNK)
    zero = F.lit(0).cast("long")
    main, other = F.pmod(F.xxhash64("id"), mains), F.pmod(F.xxhash64("id"), rest)

    def place(chunk, home):
        return F.struct(chunk.alias("chunk"), F.lit(home).alias("home"))

    with_others = F.transform(F.sequence(zero, rest - 1), lambda j: place(main * rest + j, True))
    with_mains = F.transform(F.sequence(zero, mains - 1), lambda i: place(i * rest + other, False))
    among = F.transform(F.sequence(zero, rest - 1), lambda j: place(
        mains * rest + F.least(other, j) * rest + F.greatest(other, j), True))
    return (F.when(F.col("cnt") <= CHUNK, F.array(place(zero, True)))
            .when(F.col("query"), F.concat(with_mains, among)).otherwise(with_others))


def rooted(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, a, k1, k2, n, root) of every row of ``docs (doc_id, text, k1, k2)``: its set, doc_id, key, size and component."""
    if 2 * num < den:  # size classes meet the next class only
        raise ValueError(f"similarity {num}/{den} is below 1/2")
    spark = docs.sparkSession
    small_batches(spark)
    seen = written(profile(docs, k), "profile")
    ident_of = identity(seen.where("kind = 0").select("id", "check"))
    sets = named(seen.where("kind = 0"), ident_of)
    rows = sets.select("id", "a", "k1", "k2", "n")
    common = (seen.where("kind = 1").groupBy("id").agg(F.sum("a").alias("cnt"))
              .orderBy(F.desc("cnt"), "id").limit(HINTS))
    common = collected(common)
    values = common["id"].astype(np.int64).view(U64)
    order = np.argsort(values)
    hints = spark.sparkContext.broadcast((values[order], common["cnt"][order]))
    block = blocks(prefixes(docs, hints, ident_of, k, num, den), num, den)
    hints.destroy()  # blocks are written

    points = written(sets.where("n > 0").select("id", "n", "point").dropDuplicates(["id"])
                     .join(block.select("id").distinct(), "id"), "points")

    def search_in(work: DataFrame) -> DataFrame:
        """Links in ``work (key, chunk, id, grp, query, home, firsts)``: points first, then the shingles of what is left."""
        left = written(sift(work.join(points, "id"), num, den), "sifted")
        made, bits = shingles_of(docs, left.select("id").distinct(), rows, ident_of, k)
        # rows of a bounded size: few of them go to the shingles, more of them meet these in a shuffle
        small = left.count() <= BROADCAST_ROWS
        links = written(search(made.join(F.broadcast(left) if small else left, "id"), num, den), "links")
        bits.destroy()
        return links

    # Round 1: each set in its largest block, with a few sets of the block in every chunk.
    own = block.groupBy("id").agg(F.max(F.struct("cnt", "key")).alias("best")).select("id", "best.cnt", "best.key")
    none = F.array().cast("array<long>")
    links = search_in(own.select("key", F.explode(_first_round()).alias("p"), "id", F.col("id").alias("grp"),
                                 F.lit(True).alias("query"), none.alias("firsts"))
                      .select("key", "p.chunk", "id", "grp", "query", "p.home", "firsts"))
    joined = components(links)

    # Round 2: blocks that hold more than one component.
    member = block.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "grp", F.coalesce("root", "id")).drop("root")
    parts = member.groupBy("key", "grp").agg(F.count("*").alias("part"))
    several = parts.groupBy("key").agg(F.max(F.struct("part", "grp")).alias("top"), F.count("*").alias("parts"),
                                       (F.sum("part") - F.max("part")).alias("others")
                                       ).where("parts > 1").select("key", F.col("top.grp").alias("main"), "others")
    rest = written(member.join(several, "key").withColumn("query", F.col("grp") != F.col("main")), "open")
    firsts = rest.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRSTS).alias("firsts"))
    links = links.unionAll(search_in(
        rest.join(firsts, "id").select(
            "key", F.explode(_second_round()).alias("p"), "id", "grp", "query",
            F.filter("firsts", lambda first: first < F.col("key")).alias("firsts"))
        .select("key", "p.chunk", "id", "grp", "query", "p.home", "firsts")))
    joined = components(links)

    return rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "id")))


def classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs (doc_id, text)``.

    component_id is the smallest doc_id reachable over links, itself included.  Null, empty
    and word-free texts have 0 shingles, link with nothing, and carry their own doc_id.
    Rows with a null doc_id take part in links; a component of such rows alone has a null
    component_id.  Repeated rows each give a row.  Other columns are not read.
    An empty table gives an empty result.  Similarities below 1/2 raise ValueError.
    """
    none = F.lit(None).cast("long")
    docs_in = rooted(docs.select("doc_id", "text", none.alias("k1"), none.alias("k2")), k, num, den)
    least = docs_in.where("n > 0").groupBy("root").agg(F.min("a").alias("component_id"))
    linked = docs_in.where("n > 0").join(least, "root")
    alone = docs_in.where("n = 0").withColumn("component_id", F.col("a"))
    cols = [F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id"]
    return linked.select(*cols).unionAll(alone.select(*cols))


def keep_one(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each class of ``docs (doc_id, text, ...)``, with all its columns.

    The row with the smallest doc_id stays, one without doc_id only if the class has no other; ties
    go by a hash of the row, and of rows equal in all columns one stays.  Rows without words link with
    nothing and all stay.  A row is known by 128 bits of a hash of all its columns, so rows that repeat a
    doc_id or have none are judged each by itself.  An empty table gives an empty result.
    """
    key = [F.xxhash64(F.lit(i), *docs.columns).alias(f"k{i}") for i in (1, 2)]
    rows = rooted(docs.select("doc_id", "text", *key), k, num, den).where("n > 0").select("root", "a", "k1", "k2")
    order = F.struct(F.col("a").isNull().alias("none"), "a", "k1", "k2")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select("root", "best.k1", "best.k2").select(
        "root", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    # the rows that go, and those kept of which there are copies
    marks = written(rows.join(best, "root").groupBy("k1", "k2").agg(
        F.max((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("stays"), F.count("*").alias("copies"))
        .where("not stays or copies > 1").select(F.col("k1").alias("_mark_1"), F.col("k2").alias("_mark_2"), "stays"), "marks")
    marked = (key[0] == F.col("_mark_1")) & (key[1] == F.col("_mark_2"))
    out = anti_join(docs, marks.drop("stays"), marked)
    copies = marks.where("stays").drop("stays")
    if copies.isEmpty():
        return out
    return out.unionAll(docs.join(copies, marked, "left_semi").dropDuplicates())
