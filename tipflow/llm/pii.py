"""Operator 4: personal data by fixed forms and bootstrapped contextual extraction.

* Base: e-mail, IP, card and phone forms over the whole text, leftmost and non-overlapping per
  kind; matches that fail their test (parts, digits, Luhn) are dropped without retries.
* Bootstrapping: base matches are seed entities.  Every seed, and every other token group with
  digits or an at sign (candidate), has lexical patterns: its two words to the left, and its word
  on either side.  Spark holds the graph of distinct (pattern, instance) edges and scores it in
  rounds: a pattern's confidence for a kind is the score of its instances of the kind over their number,
  plus the instances that speak against it, plus one.  Against it are candidates that do not fit the
  kind (``_fits``) and seeds of other kinds.  Candidates that fit but are not accepted may be unseen
  forms: bare digits count ``BARE`` each, others the logarithm of their number.  A candidate's score is
  the noisy-or of its confident patterns; those that score enough count as instances in the next round.
* A candidate in the context of a confident pattern whose instance was accepted is added, if it
  fits the kind (``_fits``) and overlaps no base match.

Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import slices, utf8, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SEEDS = 3          # distinct instances that a pattern must have
MIN_CONFIDENCE = 0.7   # of a pattern
MIN_SCORE = 0.7        # of a candidate
BARE = 0.1             # weight of a fitting candidate of bare digits that is not accepted

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does: a later start in the run fails as the first did.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[0-9().+-]+\Z")
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&"
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """Leftmost matches: each at sign with the run of local characters before it, from the last match on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end), kinds numbered as in KINDS, in order."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or at sign, stripped of punctuation; numeric ones one space apart are one."""
    taken = sorted((a, b) for _, a, b in base)
    spans: list[tuple[int, int]] = []
    found = _MARK.search(text) if text else None
    while found:
        start = found.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = found.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        a, b = start, end
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if (spans and spans[-1][1] + 1 == a and text[a - 1] == " " and _NUMERIC.match(text, spans[-1][0], spans[-1][1])
                and _NUMERIC.match(text, a, b)):
            spans[-1] = (spans[-1][0], b)
        elif a < b:
            spans.append((a, b))
        found = _MARK.search(text, end)
    i = 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in taken[i:i + 1 + len(KINDS)]):
            yield a, b


def _words(part: str) -> list[str]:
    return [w for w in (x.strip(_EDGE).lower() for x in part.split()) if w]


def _last_words(text: str, low: int, high: int, number: int) -> list[str]:
    """The last words of a part of the text; it is read from its end as far as they need."""
    size = 64
    while number:
        begin = max(low, high - size)
        whole = begin
        while begin > low and whole < high and not text[whole - 1].isspace():
            whole += 1  # the first word may be cut
        words = _words(text[whole:high])
        if len(words) >= number or begin == low:
            return words[-number:]
        size *= 4
    return []


def _first_word(text: str, low: int, high: int) -> list[str]:
    size = 64
    while True:
        end = whole = min(high, low + size)
        while end < high and whole > low and not text[whole].isspace():
            whole -= 1
        words = _words(text[low:whole])
        if words or end == high:
            return words[:1]
        size *= 4


def patterns(text: str, spans: list[tuple[int, int]]) -> Iterator[list[str]]:
    """Of each span: two words to the left; a word on either side (lower-cased, without punctuation).

    A span is at least a word, so what stands beyond the second one before and the first one
    after is never read: the time is linear.
    """
    ends = sorted((b, a) for a, b in spans)
    starts = sorted(spans)
    for start, end in spans:
        left, at = [], start
        while len(left) < 2:
            i = bisect.bisect_right(ends, (at, len(text)))
            b, a = ends[i - 1] if i else (0, 0)
            left = _last_words(text, b, at, 2 - len(left)) + left
            left = _last_words(text, a, b, 2 - len(left)) + left
            if not i:
                break
            at = a
        i = bisect.bisect_left(starts, (end, end))
        a, b = starts[i] if i < len(starts) else (len(text), len(text))
        right = _first_word(text, end, a) or _first_word(text, a, b)
        out = []
        if len(left) > 1:
            out.append(f"{left[-2]} {left[-1]} _")
        if left and right:
            out.append(f"{left[-1]} _ {right[0]}")
        yield out


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_OCCURRENCES = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_OCC_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, base, seen): base spans, and all seeds and candidates (kind -1) with their patterns."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            base, seen = [], []
            for a, b in slices(utf8(column)[1]):
                for text in column.slice(a, b - a).to_pylist():
                    spans = base_spans(text)
                    base.append([{"kind": k, "start": x, "end": y} for k, x, y in spans])
                    every = spans + [(-1, x, y) for x, y in candidates(text, spans)]
                    seen.append([{"kind": k, "start": x, "end": y, "instance": text[x:y].lower(),
                                  "patterns": p} for (k, x, y), p in zip(every, patterns(text, [e[1:] for e in every]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(base, _SPAN_TYPE),
                                              pa.array(seen, _OCC_TYPE)], names=["doc_id", "hash", "base", "seen"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(
        run, f"doc_id long, hash long, base {_SPANS}, seen {_OCCURRENCES}")


def _fits(kind: Column, instance: Column) -> Column:
    """What a candidate must have to be of a kind: an at sign, or digits enough for the kind."""
    digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    return (F.when(kind == 0, F.contains(instance, F.lit("@"))).when(kind == 1, (digits >= 4) & F.contains(instance, F.lit(".")))
            .when(kind == 2, digits >= 12).otherwise((digits >= 7) & (digits <= 15)))


def bootstrap(found: DataFrame) -> DataFrame:
    """Spans that the contexts add: (doc_id, hash, added) for the rows of ``_scan`` that get some."""
    places = found.where("size(seen) > 0").select("doc_id", "hash", F.explode("seen").alias("s")).select(
        "doc_id", "hash", "s.*")
    edges = written(places.select("kind", "instance", F.explode("patterns").alias("pattern"))
                    .groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    loose = edges.where("kind < 0").select("pattern", "instance")
    loose_kind, bare = F.col("kind") < 0, ~F.col("instance").rlike("[^0-9]")
    rest = edges.groupBy("pattern").agg(F.array(*[F.struct(
        F.count_if(F.when(loose_kind, ~_fits(F.lit(k), F.col("instance"))).otherwise(F.col("kind") != k)).alias("against"),
        F.count_if(loose_kind & _fits(F.lit(k), F.col("instance")) & bare).alias("bare"),
        F.count_if(loose_kind & _fits(F.lit(k), F.col("instance")) & ~bare).alias("formed"))
        for k in range(len(KINDS))]).alias("rest"))
    scores, confident = seeds, None
    for _ in range(ROUNDS):
        confident = written(
            edges.select("pattern", "instance", (loose_kind & bare).alias("bare"), (loose_kind & ~bare).alias("formed"))
            .join(scores, "instance").groupBy("pattern", "kind")
            .agg(F.sum("score").alias("sum"), F.count("*").alias("number"), F.count_if("bare").alias("bare"),
                 F.count_if("formed").alias("formed")).where(F.col("number") >= MIN_SEEDS)
            .join(rest, "pattern").withColumn("rest", F.element_at("rest", F.col("kind") + 1))
            .withColumn("confidence", F.col("sum") / (
                F.col("number") + F.col("rest.against") + BARE * (F.col("rest.bare") - F.col("bare"))
                + F.log1p(F.col("rest.formed") - F.col("formed")) + 1))
            .where(F.col("confidence") >= MIN_CONFIDENCE).select("pattern", "kind", "confidence"), "patterns")
        accepted = (loose.join(confident, "pattern").where(_fits(F.col("kind"), F.col("instance")))
                    .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
                    .where(F.col("score") >= MIN_SCORE))
        best = accepted.groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("b")).select(
            "instance", (-F.col("b.col2")).alias("kind"), F.col("b.score").alias("score"))
        scores = seeds.unionAll(written(best, "instances"))
    new = places.where("kind < 0").select("doc_id", "hash", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    hits = (new.join(confident.select("pattern", "kind"), "pattern").join(scores.select("instance", "kind"), ["instance", "kind"])
            .select("doc_id", "hash", "kind", "start", "end").distinct())
    return hits.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))


BROADCAST_BYTES = 32 << 20


def _small(added: DataFrame) -> DataFrame:
    """Added spans, written, and broadcast if they are measured to be small: the texts are not shuffled then."""
    added = written(added, "added")
    rows, spans = added.agg(F.count("*"), F.sum(F.size("added"))).first()
    return F.broadcast(added) if 64 * rows + 32 * (spans or 0) <= BROADCAST_BYTES else added


def _joined(left: DataFrame, added: DataFrame) -> DataFrame:
    to = added.select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), "added")
    return left.join(to, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")), "left").drop(
        "_doc", "_hash")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every row of ``docs (doc_id, text)``; arrays of (kind, start, end).

    base is in order of kind, then start; added is null where the contexts add nothing.  Null and empty
    texts have no spans.  Rows with equal doc_id and text share their added spans; each row answers by
    itself.  Null doc_ids are rows like others.  Other columns are not read.  An empty table gives an
    empty result.
    """
    found = written(_scan(docs), "pii")
    return _joined(found.select("doc_id", "hash", "base"), bootstrap(found)).drop("hash")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets, and n_chars taken anew.

    Spans that overlap are replaced together, under the kind of the first.  All rows and columns stay;
    a null text stays null.
    """
    found = written(_scan(docs), "pii")
    # the row travels as one struct, so no name of its columns can clash
    marked = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64("text").alias("hash"))
    marked = _joined(marked, _small(bootstrap(found))).select("_row", "added")
    names = docs.columns

    def run(batches):
        for batch in batches:
            fields = dict(zip(names, batch.column("_row").flatten()))
            column, added = fields["text"], batch.column("added").to_pylist()
            out: list[str | None] = []
            for a, b in slices(utf8(column)[1]):
                for i, text in enumerate(column.slice(a, b - a).to_pylist()):
                    spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in added[a + i] or ()]
                    out.append(mask(text, spans))
            if "n_chars" in fields:
                fields["n_chars"] = pa.array([None if t is None else len(t) for t in out], fields["n_chars"].type)
            fields["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=names)

    return marked.mapInArrow(run, docs.schema)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
