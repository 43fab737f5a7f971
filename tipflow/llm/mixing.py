"""Operator 8 [native]: mix sources to target weights by Sainte-Lague apportionment.

Only DataFrame expressions: no Python code runs on rows.

* A source's weight follows from its rank by code point (null last): ``WEIGHTS`` repeating.
  The sources share ``SHARE`` times the words of all documents by weight; a target stops at
  ``REPEAT`` times its source's size and the excess is shared anew by weight.
* The words to take are cut into blocks of ``BLOCK`` words.  Sainte-Lague gives the blocks to
  the sources by highest quotients ``target / (2 s + 1)``, and each source's blocks to its
  shards by highest quotients of their sizes: an integer quota for each shard.
* A shard's documents form a stream in seeded order; the quota takes the first blocks of this
  stream, around again if it exceeds the stream.  A document takes the words it has in them.

A source is cut into shards of about ``SHARD_DOCS`` documents by the seeded hash of doc_id and
text, so a source with a third of all rows is only more shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipflow.llm.common import WORD_PATTERN, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 16
SHARD_DOCS = 2_000
SEED = "mix-1"


def seeded(doc_id: str, text: str, seed: str) -> Column:
    """Order of a row by its doc_id and text, so that rows which share a doc_id, or have none, still spread."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"),
                          F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``(source, source_size, ...)``, one row a source.

    With caps c and weights w, targets are min(c, w * level); sorted by c / w, the level is the
    largest of (total - caps before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    # row_number starts at 1: the first source has the first weight
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight)
    before = (Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    level = ((share * F.sum("source_size").over(every)
              - repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return out.withColumn("target", F.least(F.col("weight") * F.col("level"),
                                            (repeat * F.col("source_size")).cast("double"))).drop("level")


def apportion(votes: DataFrame, group: list[str], name: list[str], vote: str, seats: str) -> DataFrame:
    """Adds ``quota``: the Sainte-Lague share of ``seats`` by highest quotients vote / (2 s + 1).

    With n rows in a group and v votes a seat on average, every row surely gets the seats whose
    quotients exceed those at v * seats / (seats - n), and none beyond those at
    v * seats / (seats + n).  Only the seats between, about 3 for each row, are ranked one by one.
    Ties go by ``name``.  Groups without votes get 0.
    """
    every = Window.partitionBy(*group)
    out = (votes.withColumn("_all", F.sum(vote).over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
           .withColumn("_low", F.when(F.col(seats) > F.col("_n"), F.greatest(F.lit(0), F.floor(
               F.col(vote) * (F.col(seats) - F.col("_n")) / F.col("_all") + 0.5) - 1)).otherwise(F.lit(0)).cast("long"))
           .withColumn("_high", F.floor(F.col(vote) * (F.col(seats) + F.col("_n")) / F.col("_all") + 0.5
                                        ).cast("long") + 1)
           .withColumn("_left", F.col(seats) - F.sum("_low").over(every)))
    ranked = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *[F.col(c).asc_nulls_last() for c in name])
    won = (out.where((F.col("_all") > 0) & (F.col(vote) > 0))
           .withColumn("_seat", F.explode(F.sequence("_low", "_high")))
           .withColumn("_quotient", F.col(vote) / (2 * F.col("_seat") + 1))
           .withColumn("_rank", F.row_number().over(ranked))
           .groupBy(*dict.fromkeys(group + name), "_low", "_left").agg(
               F.count(F.when(F.col("_rank") <= F.col("_left"), 1)).alias("_won"))
           .select(*[F.col(c).alias("_" + c) for c in dict.fromkeys(group + name)],
                   (F.col("_low") + F.col("_won")).alias("quota")))
    same = None
    for c in dict.fromkeys(group + name):
        test = F.col(c).eqNullSafe(F.col("_" + c))
        same = test if same is None else same & test
    return votes.join(won, same, "left").select(*votes.columns, F.coalesce("quota", F.lit(0)).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs (doc_id, text, source)``.

    size counts the words of the whole text (null: 0); taken counts the words that the mix takes
    of the row, repeats included, at most ``repeat`` times its size.  Null sources are one source;
    null and repeated doc_ids are rows like others (equal rows give equal result rows in some order).
    Other columns are not read.  An empty table gives an empty result.  Reruns agree.
    """
    sized = written(docs.select("doc_id", "source", seeded("doc_id", "text", seed).alias("order"), F.coalesce(
        F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")),
                      weights, share, repeat)
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    sources = apportion(sources, [], ["source"], "target", "blocks").select(
        F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("seats"),
        F.ceil(F.col("rows") / shard_docs).alias("shards"))
    sources = written(sources, "sources")
    placed = (sized.join(sources, F.col("source").eqNullSafe(F.col("_source")))
              .withColumn("shard", F.conv(F.substring("order", 1, 15), 16, 10).cast("long") % F.col("shards"))
              .drop("_source", "shards"))
    shards = placed.groupBy("source", "shard", "seats").agg(F.sum("size").alias("shard_size"))
    shards = (apportion(shards, ["source"], ["source", "shard"], "shard_size", "seats")
              .withColumn("quota", F.least(F.col("quota") * block, repeat * F.col("shard_size")))
              .withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size")))
                          .otherwise(F.lit(0)))
              .withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size"))
              .select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "passes", "rest"))
    before = (Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(before), F.lit(0))))
    return (placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
            .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")))


def oracle_sql(weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK,
               shard_docs: int = SHARD_DOCS, seed: str = SEED) -> str:
    """The same mix as DuckDB SQL; Sainte-Lague here ranks every block's quotient, without the shortcut."""
    order = f"md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, '')))"
    weight = f"([{', '.join(map(str, weights))}])[(row_number() over (order by source nulls last) - 1) % {len(weights)} + 1]"
    return f"""
with sized as (
  select doc_id, source, {order} as ord,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
src as (
  select source, sum(size)::bigint as source_size, count(*) as n, {weight} as weight from sized group by source),
lev as (
  select *, ({share} * sum(source_size) over ()
     - {repeat} * coalesce(sum(source_size) over before, 0))::double
     / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as lv
  from src
  window before as (order by source_size::double / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)),
tgt as (
  select source, source_size, n, least(weight * (max(lv) over ()), ({repeat} * source_size)::double) as target from lev),
blk as (select *, round(sum(target) over () / {block})::bigint as blocks from tgt),
seat as (
  select source, row_number() over (order by target / (2 * s + 1) desc, source nulls last) as r, blocks
  from blk, unnest(range(0, ceil({repeat} * source_size / {block})::bigint + 2)) as u(s) where target > 0),
won as (select source, count(*) as seats from seat where r <= blocks group by source),
srcq as (select b.*, coalesce(w.seats, 0) as seats from blk b left join won w on b.source is not distinct from w.source),
placed as (
  select d.*, q.source_size, q.target, q.seats,
         ('0x' || substr(ord, 1, 15))::bigint % ceil(q.n / {shard_docs})::bigint as shard
  from sized d join srcq q on d.source is not distinct from q.source),
sh as (select source, shard, seats, sum(size)::bigint as shard_size from placed group by all),
shseat as (
  select source, shard, seats,
         row_number() over (partition by source order by shard_size / (2 * s + 1) desc, shard) as r
  from sh, unnest(range(0, seats + 1)) as u(s) where shard_size > 0),
shwon as (select source, shard, count(*) as q from shseat where r <= seats group by all),
shq as (
  select sh.source, sh.shard, sh.shard_size,
         least(coalesce(q, 0) * {block}, {repeat} * sh.shard_size) as quota
  from sh left join shwon w on sh.source is not distinct from w.source and sh.shard = w.shard)
select p.doc_id, p.size, p.source_size, p.target,
  (case when shard_size > 0 then quota // shard_size else 0 end * p.size
   + greatest(0, least(p.size, case when shard_size > 0 then quota % shard_size else 0 end
       - coalesce(sum(p.size) over (partition by p.source, p.shard order by ord, doc_id, size
                                    rows between unbounded preceding and 1 preceding), 0))))::bigint as taken
from placed p join shq q on p.source is not distinct from q.source and p.shard = q.shard
"""
