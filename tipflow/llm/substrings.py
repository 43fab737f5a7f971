"""Operator 7: substring deduplication by hashing lines or paragraphs.

* Units are lines, or paragraphs (runs of lines between blank ones).  A line is also cut after the
  ends of its sentences (``. ! ?`` and white space), so a passage inside a longer line is found by its
  sentences; a line without such an end is one sentence.  A unit is normalised to its words, A-Z
  lower-cased, one space apart.  Sentences under ``SENTENCE_WORDS`` and lines or paragraphs under
  ``MIN_WORDS`` words are left alone.
* Runs of sentences across lines are units too: from each sentence start on, and back from each
  sentence end, until ``RUN_WORDS`` words are reached.  So a long passage of short sentences or
  lines is found.
* A 128-bit digest of the normalised unit, with its place, goes to Spark; the digests are grouped
  over all documents (partial aggregation first, so a unit that a third of all documents share is
  small) and the occurrence with the smallest (doc_id, offset) stays.  Units are made from the texts
  twice, not stored: the second time only those that a filter of bounded size lets through as
  repeated, which then meet the places that stay.
* All other occurrences are removals, with offsets in the original text (code points, end exclusive).
  A repeated line and its repeated sentences are removals each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import _SPACE, U64, mix, shift, slices, utf8, word_hashes, written
from tipflow.llm.ngram_join import BITMAP, _bitmap

MIN_WORDS = 25
SENTENCE_WORDS = 12
RUN_WORDS = 25
_STEP_A, _STEP_B = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def _powers(step: int, n: int) -> np.ndarray:
    base = np.full(max(n, 1), U64(step))
    base[0] = 1
    return np.multiply.accumulate(base)


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


def _breaks(text: np.ndarray, kind: str) -> np.ndarray:
    """The bytes between units: line breaks, for sentences also white space after their ends."""
    breaks = text == 10
    if kind in ("sentence", "run"):
        breaks[1:] |= _SPACE[text[1:]] & _ENDS[text[:-1]]
    return breaks


def _begins(breaks: np.ndarray, kind: str) -> np.ndarray:
    """Where units begin in a text of such breaks (each ends before the break of the next, or at the end)."""
    after = np.flatnonzero(breaks) + 1
    if kind == "paragraph":
        after = after[np.diff(np.r_[0, after]) <= 1]  # an empty line stands before
    return np.r_[0, after]


def _digests(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of the word sequence of each unit."""
    count = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], count)
    out = []
    for step, salt in ((_STEP_A, 0), (_STEP_B, 0x5851F42D4C957F2D)):
        part = mix(words ^ U64(salt)) * _powers(step, int(count.max(initial=0)))[place]
        total = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
        out.append(shift(mix(total[first[1:]] - total[first[:-1]] + count.astype(U64))))
    return out


def _run_digests(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """The digests of ``_digests`` for word ranges that may overlap."""
    out = []
    for step, salt in ((_STEP_A, 0), (_STEP_B, 0x5851F42D4C957F2D)):
        part = mix(words ^ U64(salt)) * _powers(step, len(words))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(part, dtype=U64)])
        back = _powers(pow(step, -1, 1 << 64), len(words))[start]
        out.append(shift(mix((total[stop] - total[start]) * back + (stop - start).astype(U64))))
    return out


def _runs(first: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and the one after the last, of the shortest runs that reach ``least`` words.

    They begin or end at every sentence with words, stay in its row and have two sentences at least.
    """
    worded = np.flatnonzero(np.diff(first))
    after = np.searchsorted(first, first[worded] + least)
    before = np.searchsorted(first, first[worded + 1] - least, "right") - 1
    begin, end = np.r_[worded, before], np.r_[after, worded + 1]
    ok = (begin >= 0) & (end < len(first)) & (end - begin > 1)
    begin, end = begin[ok], end[ok]
    ok = rows[begin] == rows[end - 1]
    return tuple(np.unique(np.stack([begin[ok], end[ok]]), axis=1))


def _found(data: np.ndarray, at: np.ndarray, kind: str, least: int):
    """(row, start, end, words, d1, d2) of the units of a slice that have ``least`` words."""
    lo = at[0]
    breaks = [_breaks(data[x:y], kind) for x, y in zip(at[:-1], at[1:])]
    begins = [_begins(b, kind) + x for b, x in zip(breaks, at[:-1])]
    rows = np.repeat(np.arange(len(begins)), [len(x) for x in begins])
    edge = np.concatenate([*begins, at[-1:]]).astype(np.int64)
    words, first = word_hashes(data, edge)
    count = np.diff(first)
    use = count >= least
    start, end = edge[:-1], edge[1:]
    if kind == "line":  # a line without a sentence end inside is a sentence
        inner = np.concatenate([[0], np.cumsum(np.concatenate(
            [_breaks(data[x:y], "sentence") & ~b for b, x, y in zip(breaks, at[:-1], at[1:])]))])
        use &= inner[end - lo] > inner[start - lo]
    if kind == "run":
        use, stop = _runs(first, rows, least)
        last = stop - 1
    else:
        use = last = np.flatnonzero(use)
    if not len(use):
        return None
    broken = np.concatenate(breaks)
    start, end, row = start[use], end[last], rows[use]
    end = end - broken[end - 1 - lo]
    # code points: bytes that begin a character, counted from each row's start
    chars = np.concatenate([[0], np.cumsum((data[lo:at[-1]] & 0xC0) != 0x80)])
    zero = chars[at[row] - lo]
    if kind == "run":
        count, digests = first[stop] - first[use], _run_digests(words, first[use], first[stop])
    else:
        count, digests = count[use], [d[use] for d in _digests(words, first)]
    return row, chars[start - lo] - zero, chars[end - lo] - zero, count.astype(np.int64), *digests


def units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS,
          sentence_words: int | None = SENTENCE_WORDS, run_words: int | None = RUN_WORDS, wanted=None) -> DataFrame:
    """(doc_id, hash, start, end, words, d1, d2) of every unit with enough words.

    ``unit`` is line or paragraph; ``sentence_words=None`` takes no sentences, ``run_words=None`` no runs.
    ``wanted``, a broadcast filter of d1, leaves out the units whose bit is not set.
    """
    kinds = [(unit, min_words)]
    if sentence_words is not None:
        kinds.append(("sentence", sentence_words))
    if run_words is not None:
        kinds.append(("run", run_words))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for a, b in slices(at):
                for kind, least in kinds if at[b] > at[a] else ():
                    got = _found(data, at[a:b + 1], kind, least)
                    if got is not None and wanted is not None:
                        bit = got[-2] % BITMAP
                        some = (wanted.value[bit >> 6] >> (bit & 63).astype(U64)) & U64(1) == 1
                        got = [column[some] for column in got]
                    if got is not None and len(got[0]):
                        row = pa.array(got[0] + a)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(row), batch.column("hash").take(row), *map(pa.array, got[1:])],
                            names=["doc_id", "hash", "start", "end", "words", "d1", "d2"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(
        run, "doc_id long, hash long, start long, end long, words long, d1 long, d2 long")


def _removals(docs: DataFrame, unit: str, min_words: int, sentence_words: int | None,
              run_words: int | None) -> DataFrame:
    how = (unit, min_words, sentence_words, run_words)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    kept = written(units(docs, *how).groupBy("d1", "d2").agg(F.count("*").alias("number"), F.min(place).alias("kept"))
                   .where("number > 1").select("d1", "d2", "kept"), "kept")
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(kept.select(F.col("d1").alias("hash"))))
    found = units(docs, *how, wanted)
    return found.join(kept, ["d1", "d2"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("start") == F.col("kept.start"))))


def removals(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS,
             sentence_words: int | None = SENTENCE_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_id, kept_start) of every repeated unit but the earliest.

    Null doc_ids rank last.  Rows that repeat a doc_id hold the same occurrence where their offsets
    agree.  Null, empty and word-free texts have no units.  Other columns are not read.  An
    empty table gives an empty result.
    """
    return _removals(docs, unit, min_words, sentence_words, run_words).select(
        "doc_id", "start", "end", "words", F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.start").alias("kept_start"))


def deduplicated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS,
                 sentence_words: int | None = SENTENCE_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """``docs`` with the removals cut out of text (each with the break after it); all rows stay.

    Adds ``removed``: the spans cut, in original offsets and order; they may nest and overlap.  Every
    word cut has an equal one in an earlier place that stays.
    """
    spans = (_removals(docs, unit, min_words, sentence_words, run_words).groupBy(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"))
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("_own"))
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash")), "left").select(
        "_row", F.coalesce("_spans", F.array().cast(_SPANS)).alias("removed"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            fields = dict(zip(names, batch.column("_row").flatten()))
            removed = batch.column("removed")
            texts = [_cut(t, s) for t, s in zip(fields["text"].to_pylist(), removed.to_pylist())]
            fields["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*fields.values(), removed], names=[*names, "removed"])

    return rows.mapInArrow(run, docs.select("*").schema.add("removed", rows.schema["removed"].dataType))


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _cut(text: str | None, spans: list[dict]) -> str | None:
    """The text without the spans (in order of start) and the break after each."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts.append(text[at:s["start"]])
        at = max(at, s["end"] + 1)
    return "".join([*parts, text[at:]]) if spans else text


def oracle_sql(min_words: int = MIN_WORDS, sentence_words: int = SENTENCE_WORDS, run_words: int = RUN_WORDS) -> str:
    """The same removals of lines, sentences and runs as DuckDB SQL, by the normalised text itself."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ends = "[.!?][\\x20\\x09\\x0B-\\x0D]"

    def pieces(name, text, least, only):
        return f"""{name}0 as (select doc_id, string_split({text}, chr(10)) as p from documents where text is not null),
{name}1 as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from {name}0),
{name}2 as (select *, coalesce(sum(length(piece) + 1) over (partition by doc_id order by i
              rows between unbounded preceding and 1 preceding), 0)::bigint as start from {name}1),
{name}3 as (select doc_id, start, start + length(piece) as "end",
    regexp_extract_all(translate(piece, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from {name}2 where {only}),
{name} as (select doc_id, start, "end", len(w) as words, array_to_string(w, ' ') as unit from {name}3
           where len(w) >= {least})"""

    cut = f"regexp_replace(text, '([.!?])[\\x20\\x09\\x0B-\\x0D]', '\\1' || chr(10), 'g')"
    return f"""
with {pieces('sentence', cut, sentence_words, 'true')},
{pieces('line', 'text', min_words, f"regexp_matches(piece, '{ends}')")},
worded as (select doc_id, start, "end", w, sum(len(w)) over (partition by doc_id order by start)::bigint as upto
           from sentence3 where len(w) > 0),
counted as (select *, upto - len(w) as past from worded),
spans as (
  select a.doc_id, a.past, b.upto, a.start, b."end" from counted a asof join counted b
    on a.doc_id = b.doc_id and a.past + {run_words} <= b.upto where a.start < b.start
  union
  select a.doc_id, b.past, a.upto, b.start, a."end" from counted a asof join counted b
    on a.doc_id = b.doc_id and a.upto - {run_words} >= b.past where b.start < a.start),
texts as (select doc_id, flatten(list(w order by start)) as every from worded group by doc_id),
run as (select doc_id, start, "end", upto - past as words, array_to_string(every[past + 1:upto], ' ') as unit
        from spans join texts using (doc_id)),
ranked as (select *, first_value(doc_id) over o as kept_doc_id, first_value(start) over o as kept_start
           from (select * from sentence union all select * from line union all select * from run) u
           window o as (partition by unit order by doc_id, start))
select doc_id, start, "end"::bigint as "end", words, kept_doc_id, kept_start from ranked
where doc_id <> kept_doc_id or start <> kept_start
"""
