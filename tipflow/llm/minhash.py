"""Operator 12: near duplicates by MinHash signatures, banding, verification and star components.

A document's set holds the hashes of its distinct 3-word shingles.  Two documents link when
``den * |a & b| >= num * |a | b|`` (17/20 unless said otherwise); the classes are the connected
components of the links.

* Signature: ``BANDS * ROWS`` minima of a set under universal hashes ``(a * x + b) mod 2**64``, a odd,
  of which the upper 32 bits count.  Equal sets are signed and compared once.
* Banding: sets whose signatures agree in all ``ROWS`` values of a band meet in a block.  At a
  similarity of 0.85 two sets miss all 32 bands of 4 once in 2 * 10**10 pairs.
* Signature verification: pairs of a block whose signatures agree in less than ``SIEVE`` of the values
  go (a pair at 0.85 is lost once in 10**10).  It runs in numpy over blocks cut into chunks of 1,024
  sets; the pairs themselves are never written.
* What is left is confirmed on the full sets, unless links found before already join the two:
  such a pair cannot change a component.
* Components: alternating large-star and small-star.

The first round searches, for each set, only its largest block, chunk by chunk, with a few sets of
the block in every chunk.  The second takes every block that still holds several components: its
sets outside the largest meet all others.  So a group of near copies of any size costs rows
in proportion to its size, and no pair of different components that shares a block is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import U64, Identity, identity, named, shingle_sets, slices, utf8, written
from tipflow.llm.components import components
from tipflow.llm.ngram_join import (
    BROADCAST_ROWS, FIRSTS, Chunk, _by_chunk, _first_round, _links, _second_round, _trees, overlaps, shingles_of)

SHINGLE = 3
NUM, DEN = 17, 20       # similarity of 0.85
BANDS, ROWS = 32, 4
SIEVE = 0.6             # least share of equal signature values
SEEN = 200_000          # sets that a task remembers as signed (only saves work)

_rng = np.random.Generator(np.random.PCG64(1205))
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)
_PROFILE = "id long, check long, a long, n int, signature binary"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each (not empty) set, one row each."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B)):
        out[:, i] = np.minimum.reduceat((every * a + b) >> U64(32), starts)
    return out


def profile(docs: DataFrame, k: int) -> DataFrame:
    """(id, check, doc_id, size, signature) of every row; the signature once for equal sets of a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(utf8(text)[1], 1 << 18):
                sets = list(shingle_sets(text.slice(a, b - a), k))
                halves = [Identity.halves(s) for s in sets]
                new = {}
                for i, (h, s) in enumerate(zip(halves, sets)):
                    if len(s) and h not in seen:
                        new.setdefault(h, i)
                seen.update(new)
                if len(seen) > SEEN:
                    seen.clear()
                signed = [None] * len(sets)
                if new:
                    for i, row in zip(new.values(), signatures([sets[i] for i in new.values()])):
                        signed[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()),
                     ids.slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(signed, pa.binary())], names=["id", "check", "a", "n", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PROFILE)


def blocks(sets: DataFrame) -> DataFrame:
    """(key, id, cnt): bands that two sets or more share, one of each lot with the same members."""
    width = 4 * ROWS
    bands = sets.select("id", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("signature", 1 + b * width, width)) for b in range(BANDS)])).alias("key"))
    shared = (bands.groupBy("key").agg(F.count("*").alias("cnt"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("total"))
              .where("cnt > 1"))
    kept = shared.groupBy("cnt", "total").agg(F.min("key").alias("key")).select("key", "cnt")
    return written(bands.join(kept, "key"), "blocks")


class Block(Chunk):
    """Rows of a block's chunk; the pairs whose signatures agree enough to be confirmed."""

    def __init__(self, rows: list[dict]):
        super().__init__(rows)
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.signatures = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint32).reshape(len(rows), -1)

    def near(self, q: int, num: int, den: int) -> np.ndarray:
        """Members of other components that may link with set q, the most alike first."""
        n, sizes = self.sizes[q], self.sizes
        open_ = (self.group != self.group[q]) & (self.home | self.home[q])
        open_ &= (den * np.minimum(n, sizes) >= num * np.maximum(n, sizes))
        at = np.flatnonzero(open_)
        if len(at) and self.early[q]:  # they had their turn in an earlier block
            at = at[~np.isin(self.before[at], self.before[q, :self.early[q]]).any(1)]
        alike = (self.signatures[at] == self.signatures[q]).sum(1)
        some = alike >= SIEVE * self.signatures.shape[1]
        return at[some][np.argsort(-alike[some], kind="stable")]


def possible(rows: list[dict], num: int, den: int) -> np.ndarray:
    """Which sets of one chunk the signatures leave some link to another component."""
    block = Block(rows)
    out = np.zeros(len(rows), bool)
    for q in np.flatnonzero(block.query):
        near = block.near(q, num, den)
        out[near] = True
        out[q] |= bool(len(near))
    return out


def link(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the sets of one chunk, confirmed on the full sets."""
    block = Block(rows)
    group, found = block.group, []
    shingles = [np.frombuffer(r["shingles"], U64) for r in rows]
    for q in np.flatnonzero(block.query):
        near = block.near(q, num, den)
        while len(near):
            # the most alike of each other component, at most 64 at a time; the rest comes later
            tries = near[np.sort(np.unique(group[near], return_index=True)[1])][:64]
            shared = overlaps(shingles[q], [shingles[j] for j in tries])
            for j in tries[den * shared >= num * (block.sizes[q] + block.sizes[tries] - shared)]:
                if group[j] != group[q]:
                    found.append((int(block.ids[q]), int(block.ids[j])))
                    group[group == group[j]] = group[q]
            near = near[~np.isin(near, tries)]
            near = near[group[near] != group[q]]
    return found


_WORK = [("key", pa.int64()), ("chunk", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()), ("query", pa.bool_()),
         ("home", pa.bool_()), ("firsts", pa.list_(pa.int64())), ("n", pa.int32()), ("signature", pa.binary())]
_WORK_SPARK = ("key long, chunk long, id long, grp long, query boolean, home boolean, firsts array<long>, n int, "
               "signature binary")


def sift(work: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of chunks -> those that the signatures do not rule out."""
    schema = pa.schema(_WORK)

    def run(batches):
        for rows in _trees(batches):
            kept = [r for r, k in zip(rows, possible(rows, num, den)) if k]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in kept], f.type) for f in schema], schema=schema)

    return _by_chunk(work).mapInArrow(run, _WORK_SPARK)


def confirm(work: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of chunks with their shingles -> links (u, v)."""

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


def classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs (doc_id, text)``.

    component_id is the smallest doc_id reachable over links, itself included; kept says that
    it is the row's own.  Texts of fewer than k words are one shingle.  Null, empty and word-free texts
    have 0 shingles, link with nothing and are kept.  Rows with a null doc_id take part in links; they
    are kept only in a component of such rows alone (null component_id), all of them, as no id tells
    them apart.  Repeated rows each give a row.  Other columns are not read.  An empty table gives
    an empty result.  Similarities below 4/5 raise ValueError: the bands are chosen for higher ones.
    """
    if 5 * num < 4 * den:
        raise ValueError(f"similarity {num}/{den} is below 4/5")
    seen = written(profile(docs, k), "profile")
    ident_of = identity(seen.select("id", "check"))
    every = named(seen, ident_of)
    rows = every.select("id", "a", "n")
    signed = every.where("signature is not null").select("id", "n", "signature").dropDuplicates(["id"])
    block = blocks(signed)
    # rows of the second round hold the signatures of sets in some block only
    known = written(signed.join(block.select("id").distinct(), "id"), "signatures")

    def search_in(work: DataFrame) -> DataFrame:
        left = written(sift(work.join(known, "id"), num, den), "sifted")
        made, bits = shingles_of(docs, left.select("id").distinct(), rows, ident_of, k)
        small = left.count() <= BROADCAST_ROWS
        links = written(confirm(made.join(F.broadcast(left) if small else left, "id"), num, den), "links")
        bits.destroy()
        return links

    own = block.groupBy("id").agg(F.max(F.struct("cnt", "key")).alias("best")).select("id", "best.cnt", "best.key")
    links = search_in(own.select("key", F.explode(_first_round()).alias("p"), "id", F.col("id").alias("grp"),
                                 F.lit(True).alias("query"), F.array().cast("array<long>").alias("firsts"))
                      .select("key", "p.chunk", "id", "grp", "query", "p.home", "firsts"))
    joined = components(links)

    member = block.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "grp", F.coalesce("root", "id")).drop("root")
    sizes = member.groupBy("key", "grp").agg(F.count("*").alias("part"))
    several = (sizes.groupBy("key").agg(F.max(F.struct("part", "grp")).alias("top"), F.count("*").alias("parts"),
                                        (F.sum("part") - F.max("part")).alias("others"))
               .where("parts > 1").select("key", F.col("top.grp").alias("main"), "others"))
    rest = written(member.join(several, "key").withColumn("query", F.col("grp") != F.col("main")), "open")
    # at most BANDS blocks a set
    firsts = rest.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRSTS).alias("firsts"))
    links = links.unionAll(search_in(
        rest.join(firsts, "id").select("key", F.explode(_second_round()).alias("p"), "id", "grp", "query",
                                       F.filter("firsts", lambda first: first < F.col("key")).alias("firsts"))
        .select("key", "p.chunk", "id", "grp", "query", "p.home", "firsts")))
    joined = components(links)

    rooted = rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("a").alias("component_id"))
    cols = [F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id",
            F.col("a").eqNullSafe(F.col("component_id")).alias("kept")]
    return rooted.where("n > 0").join(least, "root").select(*cols).unionAll(
        rows.where("n = 0").withColumn("component_id", F.col("a")).select(*cols))


def oracle_sql(k: int = SHINGLE, num: int = NUM, den: int = DEN) -> str:
    """The same classes as DuckDB SQL: all pairs that share a shingle, least doc_id by label propagation."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
sets as (
  select distinct doc_id, unnest([array_to_string(words[i:i + {k - 1}], ' ')
         for i in range(1, greatest(len(words) - {k - 1}, 1) + 1)]) as s
  from w where len(words) > 0),
n as (select doc_id, count(*) as n from sets group by doc_id),
h as (select doc_id, n, hash(s) as s from sets join n using (doc_id)),
links as (
  select a.doc_id as u, b.doc_id as v
  from h a join h b on a.s = b.s and a.doc_id <> b.doc_id and {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id
  having {den} * count(*) >= {num} * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select u, u as v from links union select r.u, l.v from reach r join links l on l.u = r.v),
roots as (select u, min(v) as root from reach group by u)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, doc_id) as component_id,
       coalesce(root, doc_id) = doc_id as kept
from w left join n using (doc_id) left join roots on u = doc_id
"""
