"""Operator 6: benchmark decontamination by size-partitioned MinHash containment.

An item contaminates a document when ``den * |item & doc| >= num * |item|`` over their sets of
distinct 5-word shingles (3/4 unless said otherwise), however long the document is.

* Items are partitioned by the power of two of their set size.  An item's sketch is its smallest
  shingle hashes (bottom-k MinHash); the partition sets k.  Containment leaves at most
  ``n - ceil(n * num/den)`` of an item's shingles outside the document, so with k one more than
  that for the partition's largest size, a contaminated document holds one of the sketch: the
  search misses nothing, whatever the sizes.
* Every shingle of every document is looked up in the sketches; hits are verified by the exact
  containment of the item's whole set.
* An item of fewer than k words is its whole word sequence, which is looked up among the documents'
  windows of as many words.
* If the items' sets are under ``BROADCAST_BYTES`` (measured), each task holds them and the
  documents are not shuffled.  Otherwise sketches and shingles meet in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import (
    SHINGLE, U64, Identity, anti_join, collected, grams, shift, slices, utf8, word_hashes, written)

NUM, DEN = 3, 4
BROADCAST_BYTES = 64 << 20
NULL_ITEM = -1 << 63
_HIT = "item_id long, shared long, item_shingles long"


def sketch_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Sketch length of the size partition of n: from 2**j to 2**(j+1) - 1 shingles."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - -(-top * num // den) + 1)


def window_sets(column, k: int, shorter: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, int]]:
    """(set, words) of each row: hashes of its k-word windows, or of all its words if they are fewer than k;
    and of its windows of the ``shorter`` lengths."""
    data, at = utf8(column)
    for a, b in slices(at):
        words, begin = word_hashes(data, at[a:b + 1])
        every = {n: grams(words, begin, n)[0] for n in {k, *shorter}} if len(words) else {}
        for x, y in zip(begin[:-1].tolist(), begin[1:].tolist()):
            n = y - x
            parts = [every[m][x:y - m + 1] for m in {k, *shorter} if m <= n]
            if 0 < n < k and n not in shorter:
                parts.append(grams(words[x:y], np.array([0, n]), n)[0][:1])
            yield (np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)), n


def item_sets(items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(item_id, n, words, shingle, sketched): one row for each shingle of each item row."""

    def run(batches):
        for batch in batches:
            ids, sizes, lengths, hashes, marks = [], [], [], [], []
            for i, (s, n_words) in enumerate(window_sets(batch.column("text"), k)):
                if len(s):
                    ids.append(batch.column("item_id")[i].as_py())
                    sizes.append(len(s))
                    lengths.append(min(n_words, k))
                    hashes.append(s)
                    marks.append(np.arange(len(s)) < sketch_length(len(s), num, den))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                     *(pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in (sizes, lengths)),
                     pa.array(shift(np.concatenate(hashes))), pa.array(np.concatenate(marks))],
                    names=["item_id", "n", "words", "shingle", "sketched"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, n long, words long, shingle long, sketched boolean")


class Index:
    """Items in memory: sketch hashes in order with their items, and each item's set."""

    def __init__(self, rows):
        keys = rows["shingle"].astype(np.int64).view(U64)
        ids, place = np.unique(rows["item"], return_inverse=True)
        order = np.lexsort((keys, place))
        keys, place, marks = keys[order], place[order], rows["sketched"].astype(bool)[order]
        self.ids = ids
        self.sets = np.split(keys, np.cumsum(np.bincount(place, minlength=len(ids)))[:-1]) if len(ids) else []
        order = np.argsort(keys[marks], kind="stable")
        self.sketch, self.owner = keys[marks][order], place[marks][order]

    def hits(self, one: np.ndarray, num: int, den: int):
        """(item, shared, size) of the items that the document's set contains."""
        if not len(self.sketch) or not len(one):
            return
        a, b = np.searchsorted(self.sketch, one, "left"), np.searchsorted(self.sketch, one, "right")
        found = {int(x) for i in np.flatnonzero(b > a) for x in self.owner[a[i]:b[i]]}
        for item in sorted(found):
            own = self.sets[item]
            shared = int((one[np.minimum(np.searchsorted(one, own), len(one) - 1)] == own).sum())
            if den * shared >= num * len(own):
                yield int(self.ids[item]), shared, len(own)


def _sets(batches, k, shorter):
    for batch in batches:
        row = 0
        text = batch.column("text")
        for a, b in slices(utf8(text)[1]):
            for s, _ in window_sets(text.slice(a, b - a), k, shorter):
                yield batch, row, s
                row += 1


def _in_tasks(docs: DataFrame, index: Index, k: int, shorter: tuple[int, ...], num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        out = []
        for batch, i, s in _sets(batches, k, shorter):
            out.extend((batch.column("doc_id")[i].as_py(), *hit) for hit in shared.value.hits(s, num, den))
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_HIT}")


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                      names=["doc_id", "item_id", "shared", "item_shingles"])


def _by_join(docs: DataFrame, sets: DataFrame, k: int, shorter: tuple[int, ...], num: int, den: int) -> DataFrame:
    def run(batches):
        for batch, i, s in _sets(batches, k, shorter):
            if len(s):
                n = len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc_id")[i].as_py()] * n, pa.int64()),
                     pa.array(["%d:%d" % Identity.halves(s)] * n), pa.array(shift(s))], names=["doc_id", "set_id", "shingle"])

    every = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id string, shingle long")
    # only shingles of some item are of use: the rest stops at this join
    useful = written(every.join(sets.select("shingle").distinct(), "shingle", "left_semi"), "useful")
    of_set = useful.select("set_id", "shingle").distinct()
    near = (of_set.join(sets.where("sketched").select("item", "shingle"), "shingle")
            .select("set_id", "item").distinct())
    hits = (near.join(sets.select("item", "n", "shingle"), "item").join(of_set, ["set_id", "shingle"])
            .groupBy("set_id", "item", "n").agg(F.count("*").alias("shared")).where(f"{den} * shared >= {num} * n"))
    # a row holds each of its shingles once, so this counts equal rows
    rows = useful.groupBy("doc_id", "set_id", "shingle").agg(F.count("*").alias("rows")).groupBy(
        "doc_id", "set_id").agg(F.max("rows").alias("rows"))
    return (rows.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).join(hits, "set_id")
            .select("doc_id", F.col("item").alias("item_id"), "shared", F.col("n").alias("item_shingles")))


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every item found in every document.

    ``docs (doc_id, text)``, ``items (item_id, text)``; words are lower-cased (A-Z).  An item of fewer
    than k words is one shingle, all its words in order, and found wherever these stand in a document.
    Null and word-free texts hit nothing.  Rows of ``items`` with equal item_id count as one item with the
    shingles of all; null item_ids are one item.  Each repeated row of ``docs`` gives its hits.  Other
    columns are not read.  An empty table on either side gives an empty result.
    """
    raw = written(item_sets(items, k, num, den), "windows")
    shorter = tuple(sorted(r[0] for r in raw.where(F.col("words") < k).select("words").distinct().collect()))
    # equal item_ids: one set, with its size taken anew
    whole = written(raw.groupBy(F.coalesce("item_id", F.lit(NULL_ITEM)).alias("item"), "shingle").agg(
        F.max("n").alias("own"), F.max("sketched").alias("sketched")), "items")
    sizes = whole.groupBy("item").agg(F.count("*").alias("n"))
    # merged rows: every shingle is sketched, which can only find more
    sets = written(whole.join(sizes, "item").select(
        "item", "n", "shingle", (F.col("sketched") | (F.col("own") < F.col("n"))).alias("sketched")), "items")
    if sets.count() * 17 <= broadcast_bytes:
        out = _in_tasks(docs, Index(collected(sets.select("item", "shingle", "sketched"))), k, shorter, num, den)
    else:
        out = _by_join(docs, sets, k, shorter, num, den)
    return out.withColumn("item_id", F.when(F.col("item_id") != NULL_ITEM, F.col("item_id"))).withColumn(
        "containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` without the rows whose text contains an item, with all columns.

    A row is judged by its text (told apart by 64 bits), so rows that repeat a doc_id or have none are
    judged each by itself.  An empty table of documents or items leaves docs as they are.
    """
    bad = written(contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, k, num, den).select(
        F.col("doc_id").alias("_text_hash")).distinct(), "contaminated")
    return anti_join(docs, bad, F.xxhash64("text") == F.col("_text_hash"))


def _sql_words(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate({column}, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+')"


def oracle_sql(k: int = SHINGLE, num: int = NUM, den: int = DEN) -> str:
    """The same search as DuckDB SQL over the words themselves."""
    def shingles(table, ident):
        return f"""select distinct {ident}, unnest([array_to_string(w[i:i + {k - 1}], ' ')
            for i in range(1, greatest(len(w) - {k - 1}, 1) + 1)]) as s
          from {table} where len(w) >= {k}"""
    return f"""
with dw as (select doc_id, {_sql_words('text')} as w from documents),
bw as (select item_id, {_sql_words('text')} as w from benchmark),
d as ({shingles('dw', 'doc_id')}), b as ({shingles('bw', 'item_id')}),
n as (select item_id, count(*) as n from b group by item_id)
select doc_id, item_id, count(*)::bigint as shared, any_value(n)::bigint as item_shingles,
       count(*)::double / any_value(n) as containment
from d join b using (s) join n using (item_id)
group by doc_id, item_id having {den} * count(*) >= {num} * any_value(n)
union all
select doc_id, item_id, 1, 1, 1.0
from dw join bw on contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(bw.w, ' ') || ' ')
where len(bw.w) between 1 and {k - 1}
"""
