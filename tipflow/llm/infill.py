"""Operator 13: fill-in-the-middle transformation by block rotation in place.

A text is cut after two of its units into prefix, middle and suffix; a unit is a word with the
white space before it, and white space at the end is a unit of its own.  Cuts and form follow from
a seeded hash of the doc_id, so reruns agree.

* The cuts are found by one scan of the UTF-8 bytes (white space is ASCII, so a cut never falls
  into a character).
* The text becomes one bytearray ``<P>prefix<M>middle<S>suffix``.  Two neighbouring blocks change
  places by a rotation: each is reversed, then both together (three reversals, by swaps of bounded
  size).  ``psm`` rotates middle and suffix; ``spm`` rotates the suffix before all the rest.
* Restoring finds the sentinels, rotates the same blocks back and cuts the sentinels out.

A text that holds a sentinel stays plain, so a sentinel in an output is never part of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tipflow.llm.common import slices, utf8

SEED = 42
RATE = 50        # percent of the texts that are transformed
SPM = 80         # percent of these in the order suffix, prefix, middle
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
SWAP = 1 << 16   # bytes that a reversal swaps at once

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def reverse(data: np.ndarray, a: int, b: int) -> None:
    """Reverse ``data[a:b]`` in place."""
    while b - a > 1:
        n = min(SWAP, (b - a) // 2)
        head = data[a:a + n].copy()
        data[a:a + n] = data[b - n:b][::-1]
        data[b - n:b] = head[::-1]
        a, b = a + n, b - n


def rotate(data: np.ndarray, a: int, m: int, b: int) -> None:
    """Let the blocks ``data[a:m]`` and ``data[m:b]`` change places."""
    reverse(data, a, m)
    reverse(data, m, b)
    reverse(data, a, b)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where each unit of a text's bytes ends."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def choices(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The four seeded numbers of a document; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def split(data: bytes, doc_id: int | None, seed: int, rate: int, spm: int
          ) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    view = np.frombuffer(data, np.uint8)
    ends = unit_ends(view)
    n = len(ends)
    h1, h2, h3, h4 = choices(doc_id, seed)
    if not n or h3 % 100 >= rate or any(s in data for s in (PREFIX, MIDDLE, SUFFIX)):
        return n, "plain", None, None, data
    x, y = (0 if k == 0 else int(ends[k - 1]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    out = bytearray(data)
    for at, mark in ((y, SUFFIX), (x, MIDDLE), (0, PREFIX)):  # from behind, so the cuts before stay valid
        out[at:at] = mark
    middle, suffix = x + len(PREFIX), y + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(np.frombuffer(out, np.uint8), 0 if form == "spm" else middle, suffix, len(out))
    return n, form, characters(view[:x]), characters(view[x:y]), bytes(out)


def join(output: bytes, form: str) -> bytes:
    """The text of one output."""
    if form == "plain":
        return output
    data = bytearray(output)
    begin = data.find(PREFIX) if form == "spm" else data.find(SUFFIX)
    end = len(data) if form == "spm" else data.find(MIDDLE)
    if form == "spm":  # suffix | prefix, middle
        rotate(np.frombuffer(data, np.uint8), 0, begin, end)
    else:              # prefix, suffix | middle
        rotate(np.frombuffer(data, np.uint8), begin, end, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = data.find(mark)
        del data[at:at + len(mark)]
    return bytes(data)


def _rows(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, texts) of a batch, of bounded size unless a text is longer."""
    column = batch.column(name)
    data, at = utf8(column)
    for a, b in slices(at):
        yield a, b, [data[at[i]:at[i + 1]].tobytes() for i in range(a, b)]


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs (doc_id, text)``.

    n counts the units.  form is ``plain`` (output is the text; lengths null), ``psm`` or ``spm``.
    Null texts count as empty; empty texts and texts that hold a sentinel are plain.  One unit, all
    units or none may be prefix, middle or suffix.  Repeated rows each give a row; equal doc_ids
    draw the same numbers, and null ones those of an empty id.  Other columns are not read.  An
    empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in _rows(batch, "text"):
                n, form, prefix, middle, out = zip(*[
                    split(t, i, seed, rate, spm) for t, i in zip(texts, ids.slice(a, b - a).to_pylist())])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(out)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs (output, form, ...)`` with ``restored``: the text, rebuilt from output and form alone.

    A null output counts as empty.  Other columns pass through; one of the name restored is replaced.
    """
    outputs = outputs.drop("restored")
    schema = StructType([*outputs.schema.fields, StructField("restored", StringType())])

    def run(batches):
        for batch in batches:
            forms = batch.column("form").to_pylist()
            for a, b, texts in _rows(batch, "output"):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, _strings([join(t, f) for t, f in zip(texts, forms[a:b])])],
                    names=[*rows.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)


def oracle_sql() -> str:
    return rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, t, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {RATE} THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:least(c1, c2)], '') AS p,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
