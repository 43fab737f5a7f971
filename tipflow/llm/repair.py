"""Operator 11: conversation structure repair with a survivor-coalescence Viterbi.

A conversation is repaired by the cheapest edits that leave roles of the form ``(s?(ua)+)?``
(initials): keep a row, give it the role user or assistant, delete it, insert an empty turn.  Equal
costs go to the least string of edit initials.

* ``Survivors`` holds the best path into each state of the role automaton.  Paths are a tree of
  backpointers with reference counts: a dead path frees its own part, and as soon as all survivors
  share an ancestor, the edits up to there are final and leave the tree.  A survivor that another
  one undercuts by more than any future can cost it (``PENALTY``) dies, so survivors meet early;
  where ties stay open, the open suffixes stay whole, however long.
* Ties compare complete open suffixes.  These are never prefixes of one another (an insert is kept
  with the row after it, so each step ends with a row's letter), so their order after a step
  follows from their order before it and the step's letters; it is carried along, not recomputed.
* A conversation of at most ``PIECE_ROWS`` rows and ``PIECE_BYTES`` is repaired in one go, as the
  sorted rows stream by.  Longer ones are cut into pieces by a range partition, so one that holds
  a third of all rows is many tasks.  A piece is solved once for each state it may begin in; the
  results are the steps of the same Viterbi over pieces, which fixes the states between them;
  then each piece is repaired on its own.  Only few numbers a piece pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipflow.llm.common import written

PIECE_ROWS = 4096
PIECE_BYTES = 16 << 20
BROADCAST_IDS = 100_000  # long conversations that are broadcast (of at most 32 bytes)
OUT_BYTES = 4 << 20      # of an output batch
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that end a conversation


def _moves(initial: str, cut: bool, gone: bool) -> list[list[tuple[int, int, str]]]:
    """For each state the (next state, cost, letters) of a row.

    One insert before a row is enough: two return to where they began.  An insert before a deleted
    row loses against one after it.
    """
    out = []
    for p in STATES:
        best = {p: (DELETE, "D")}
        before = [] if gone else [(p, 0, "")] + [(q, INSERT, "I") for x, q in NEXT[p].items() if x in ROLE]
        for at, cost, letters in before:
            for x, q in NEXT[at].items():
                cost_here = cost + CUT * cut + (x != initial) * REROLE
                if x == initial or x in ROLE:
                    step = (cost_here, letters + ("K" if x == initial else "R"))
                    best[q] = min(best.get(q, step), step)
        out.append([(q, cost, letters) for q, (cost, letters) in best.items()])
    return out


MOVES = {(x, cut, gone): _moves(x, cut, gone) for x in ("s", "u", "a", "") for cut in (False, True) for gone in (False, True)}


def _penalties() -> list[list[int]]:
    """[q][p]: what the futures of p cost more from q, at most."""
    at = [[0] * 4 for _ in STATES]
    while True:
        new = [[max([INSERT * (len(TAIL[q]) - len(TAIL[p]))] + [
            min(c2 - c + at[q2][p2] for q2, c2, _ in table[q]) for table in MOVES.values() for p2, c, _ in table[p]])
            for p in STATES] for q in STATES]
        if new == at:
            return at
        at = [[max(x, y) for x, y in zip(a, b)] for a, b in zip(at, new)]


PENALTY = _penalties()


class Node:
    """A step of a path: its letters, the step before, and the steps that refer to it."""

    __slots__ = ("parent", "letters", "after")

    def __init__(self, parent, letters):
        self.parent, self.letters, self.after = parent, letters, set()


class Survivors:
    """The best paths into each state; ``decided`` collects the letters of the steps that are final."""

    def __init__(self, start: int = START):
        self.root = Node(None, None)
        self.paths = [(start, 0, self.root)]  # by the order of their open suffixes
        self.decided: list = []

    def step(self, table) -> None:
        """``table[state]``: (next state, cost, letters); letters of equal states may not be prefixes."""
        best: dict[int, tuple] = {}
        for place, (state, cost, _) in enumerate(self.paths):
            for to, more, letters in table[state]:
                key = (cost + more, place, letters)
                if to not in best or key < best[to]:
                    best[to] = key
        old = self.paths
        alive = [(place, letters, to, cost) for to, (cost, place, letters) in best.items()
                 if not any(c + PENALTY[q][to] < cost for q, (c, _, _) in best.items())]
        self.paths = []
        for place, letters, to, cost in sorted(alive):
            parent = old[place][2]
            node = Node(parent, letters)
            parent.after.add(node)
            self.paths.append((to, cost, node))
        for _, _, node in old:  # free what no survivor refers to
            while not node.after and node.parent is not None:
                node.parent.after.discard(node)
                node = node.parent
        while len(self.root.after) == 1:  # all survivors share this step
            self.root = self.root.after.pop()
            self.root.parent = None
            self.decided.append(self.root.letters)

    def open(self, node: Node) -> list:
        """Letters of the open steps of a path."""
        out = []
        while node is not self.root:
            out.append(node.letters)
            node = node.parent
        return out[::-1]

    def finish(self) -> tuple[int, int, list]:
        """(state, cost without the inserts of the end, all letters that were not taken yet) of the best path."""
        _, _, state, cost, node = min((c + INSERT * len(TAIL[s]), place, s, c, n)
                                      for place, (s, c, n) in enumerate(self.paths))
        return state, cost, self.decided + self.open(node)


def _follow(state: int, letters: str, role: str) -> Iterator[tuple[int, str | None, str]]:
    """(state after, role of the repaired turn, letter) of a row's letters; the role of a deleted row is None."""
    for letter in letters:
        if letter == "D":
            yield state, None, letter
            continue
        x = role[:1] if letter == "K" else "a" if state == USER else "u"
        state = NEXT[state][x]
        yield state, role if letter == "K" else ROLE[x], letter


class Faults:
    """Faults of rows in order, and what is needed to join pieces."""

    def __init__(self, seen=()):
        self.seen = set(seen)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None      # initials of the first and last row
        self.low = self.high = None        # least and greatest turn

    def kind(self, turn, initial: str, digest: str, blank: bool, cut: bool) -> tuple[str, bool, bool]:
        """Count a row; its key of ``MOVES``."""
        again = digest in self.seen
        self.seen.add(digest)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        return initial if initial in ("s", "u", "a") else "", cut and not again, blank or again

    def join(self, later: Faults) -> None:
        """Add the rows of the next piece (whose duplicates know of this one)."""
        self.blank += later.blank
        self.duplicate += later.duplicate
        self.truncated += later.truncated
        self.illegal += later.illegal
        if self.first is None:
            self.first = later.first
        elif later.first is not None:
            self.illegal += self.last + later.first not in ("su", "ua", "au")
        self.last = later.last if later.last is not None else self.last
        if later.low is not None:
            self.turns += later.turns - (later.low == self.high)
            self.low = later.low if self.low is None else self.low
            self.high = later.high

    def totals(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


# --- Spark ----------------------------------------------------------------------------------

CHUNK = ("conv_id long, piece long, audit string, turns array<struct<role string, text string>>, gaps long, blank long, "
         "duplicate long, truncated long, illegal long, cost long")
_CHUNK = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("audit", pa.string()),
                    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
                   + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])


def rows_of(conversations: DataFrame, dropped: Column) -> DataFrame:
    """What the repair asks of each row; null roles and texts read as one space, dropped rows have neither."""
    kept = ~F.coalesce(dropped, F.lit(False))
    body = F.rtrim("text", F.lit(SPACE))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return (conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kept, F.coalesce("role", F.lit(" "))).alias("role"), F.when(kept, F.coalesce("text", F.lit(" "))).alias("text"))
        .withColumns({"initial": F.substring("role", 1, 1), "digest": digest, "blank": body == "",
                      "cut": (body != "") & ~F.substring(body, -1, 1).isin(".", "!", "?")}))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys in sorted batches; each run is to be read before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            for a in range(0, len(batch), 256):
                yield from batch.slice(a, 256).to_pylist()

    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _out(chunks: Iterator[tuple], schema: pa.Schema, size=lambda row: 100) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in chunks:
        held.append(row)
        total += size(row)
        if total > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _bytes(row: tuple) -> int:
    return 100 + len(row[2]) + sum(40 + len(t["text"]) for t in row[3])


class _Writer:
    """Repaired turns and letters of rows, as their edits get final."""

    def __init__(self, state: int = START):
        self.state, self.letters, self.turns, self.waiting = state, [], [], []

    def add(self, role: str, text: str) -> None:
        self.waiting.append((role, text))

    def take(self, decided: list[str]) -> None:
        for (role, text), letters in zip(self.waiting, decided):
            self._put(letters, role, text)
        del self.waiting[:len(decided)]

    def _put(self, letters: str, role: str, text: str) -> None:
        for self.state, new, letter in _follow(self.state, letters, role):
            self.letters.append(letter)
            if new is not None:
                self.turns.append({"role": new, "text": "" if letter == "I" else text})

    def end(self, tail: str) -> None:
        self._put(tail, "", "")


def _whole(batches):
    """Sorted rows of short conversations -> one chunk each."""

    def chunks():
        for (conv,), rows in _groups(batches, ["conv_id"]):
            faults, paths, out = Faults(), Survivors(), _Writer()
            for r in rows:
                if r["role"] is None:  # dropped
                    continue
                paths.step(MOVES[faults.kind(r["turn"], r["initial"], r["digest"], r["blank"], r["cut"])])
                out.add(r["role"], r["text"])
                out.take(paths.decided)
                paths.decided.clear()
            state, cost, letters = paths.finish()
            out.take(letters)
            out.end(TAIL[state])
            yield (conv, None, "".join(out.letters), out.turns, *faults.totals(), cost + INSERT * len(TAIL[state]))

    return _out(chunks(), _CHUNK, _bytes)


_SOLVED = ("conv_id long, piece long, steps array<struct<entry int, exit int, cost long, rank int>>, "
           "counts array<long>, first string, last string")
_SOLVED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()),
    ("steps", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))),
    ("counts", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string())])


def _seeded(rows: Iterator[dict]) -> tuple[Faults, dict | None, Iterator[dict]]:
    """Faults that know the digests of earlier pieces, the piece's ends, and its rows (markers stand before them)."""
    from itertools import chain
    faults, ends = Faults(), None
    for r in rows:
        if r["pos"] >= 0:
            return faults, ends, chain([r], rows)
        if r["pos"] == -1:
            faults.seen.add(r["digest"])
        else:
            ends = r
    return faults, ends, iter(())


def _solve(batches):
    """Sorted rows of pieces -> what each piece costs from each state to each state, and the order of its paths."""

    def pieces():
        for (conv, piece), rows in _groups(batches, ["conv_id", "piece"]):
            faults, _, rows = _seeded(rows)
            each = [Survivors(s) for s in STATES]
            for r in rows:
                table = MOVES[faults.kind(r["turn"], r["initial"], r["digest"], r["blank"], r["cut"])]
                for paths in each:
                    paths.step(table)
            found = [(s, e, cost, "".join(paths.decided + paths.open(node)))
                     for s, paths in enumerate(each) for e, cost, node in paths.paths]
            order = {letters: i for i, letters in enumerate(sorted({f[3] for f in found}))}
            steps = [{"entry": s, "exit": e, "cost": cost, "rank": order[letters]} for s, e, cost, letters in found]
            yield (conv, piece, steps, [faults.blank, faults.duplicate, faults.truncated, faults.illegal, faults.turns,
                                        faults.low, faults.high], faults.first, faults.last)

    return _out(pieces(), _SOLVED_ARROW, lambda row: 1000)


_CHOSEN = "conv_id long, piece long, entry int, exit int, tail string, totals array<long>"
_CHOSEN_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()),
                           ("tail", pa.string()), ("totals", pa.list_(pa.int64()))])


def _choose(batches):
    """Sorted solved pieces of long conversations -> states before and after each piece; totals with the last one."""

    def chosen():
        for (conv,), rows in _groups(batches, ["conv_id"]):
            faults, paths, waiting = Faults(), Survivors(), []
            for r in rows:
                table = [[(x["exit"], x["cost"], (x["rank"], s, x["exit"])) for x in r["steps"] if x["entry"] == s]
                         for s in STATES]
                paths.step(table)
                here = Faults()
                here.blank, here.duplicate, here.truncated, here.illegal, here.turns, here.low, here.high = r["counts"]
                here.first, here.last = r["first"], r["last"]
                faults.join(here)
                waiting.append(r["piece"])
                # the last piece waits for the totals
                while len(waiting) > 1 and paths.decided:
                    _, entry, leave = paths.decided.pop(0)
                    yield conv, waiting.pop(0), entry, leave, "", None
            state, cost, letters = paths.finish()
            tail = TAIL[state]
            for piece, (_, entry, leave) in zip(waiting, letters):
                last = piece == waiting[-1]
                yield (conv, piece, entry, leave, tail if last else "",
                       [*faults.totals(), cost + INSERT * len(tail)] if last else None)

    return _out(chosen(), _CHOSEN_ARROW)


def _rebuild(batches):
    """Sorted rows of pieces, with their chosen ends -> one chunk each."""

    def chunks():
        for (conv, piece), rows in _groups(batches, ["conv_id", "piece"]):
            faults, ends, rows = _seeded(rows)
            paths, out = Survivors(ends["entry"]), _Writer(ends["entry"])
            for r in rows:
                paths.step(MOVES[faults.kind(r["turn"], r["initial"], r["digest"], r["blank"], r["cut"])])
                out.add(r["role"], r["text"])
                out.take(paths.decided)
                paths.decided.clear()
            node, = (n for s, _, n in paths.paths if s == ends["exit"])
            out.take(paths.open(node))
            out.end(ends["tail"])
            yield (conv, piece, "".join(out.letters), out.turns, *(ends["totals"] or [None] * 6))

    return _out(chunks(), _CHUNK, _bytes)


def _by_piece(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "pos")


def _long(rows: DataFrame, parts: int) -> DataFrame:
    """Chunks of the long conversations, cut into about ``parts`` pieces."""
    cuts = ["conv_id", "turn", "digest", "tie"]
    placed = written(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *cuts).sortWithinPartitions(*cuts)
        .withColumn("piece", F.spark_partition_id().cast("long"))
        .withColumn("pos", F.monotonically_increasing_id() - F.shiftleft(F.col("piece"), 33)).drop("tie"), "pieces")
    texts = placed.select("conv_id", "piece", "digest").distinct()
    # digests that an earlier piece holds, once for each later piece that holds them too
    first = (texts.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.max("piece").alias("last"))
             .where("first < last").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")) & (F.col("piece") > F.col("first"))
    earlier = texts.join(first, same).select("conv_id", "piece", "digest", F.lit(-1).cast("long").alias("pos"))
    narrow = placed.select("conv_id", "piece", "pos", "turn", "initial", "digest", "blank", "cut")
    solved = _by_piece(narrow.unionByName(earlier, allowMissingColumns=True)).mapInArrow(_solve, _SOLVED)
    chosen = written(solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(
        _choose, _CHOSEN), "chosen")
    ends = chosen.withColumn("pos", F.lit(-2).cast("long"))
    whole = (placed.unionByName(earlier, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True))
    return _by_piece(whole).mapInArrow(_rebuild, CHUNK)


def parts(conversations: DataFrame, dropped: Column | None = None, piece_rows: int = PIECE_ROWS,
          piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """``repaired`` of the short conversations and of the long ones, if there are any."""
    rows = rows_of(conversations, F.lit(False) if dropped is None else dropped)
    heavy = written(rows.where("role is not null").groupBy("conv_id")
                    .agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 40).alias("bytes"))
                    .where((F.col("n") > piece_rows) | (F.col("bytes") > piece_bytes)), "long")
    count, n, total = heavy.agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    ids = heavy.select(F.col("conv_id").alias("long_id"))
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(ids, is_long, "left_anti") if count else rows
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(_whole, CHUNK)
    if not count:
        return short, None
    return short, _long(rows.where("role is not null").join(ids, is_long, "left_semi"),
                        max(-(-n // piece_rows), -(-total // piece_bytes)))


def repaired(conversations: DataFrame, dropped: Column | None = None, piece_rows: int = PIECE_ROWS,
             piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Repaired conversations, in chunks: one of a short conversation, one a piece of a long one.

    ``conversations`` has (conv_id, turn, role, text); other columns are not read.  Columns: conv_id,
    piece (null if the conversation is one chunk, else the order of its chunks), audit (edit
    initials), turns (role, text), and with the last chunk gaps, blank, duplicate, truncated, illegal
    (counts of faults before the repair) and cost, null elsewhere.

    Rows stand by turn (nulls first), rows of one turn by the MD5 of role and text.  Null roles
    and texts count as one space, an empty role fits no place, a null conv_id is a conversation like
    others, repeated rows are duplicates.  Rows for which ``dropped`` holds do not take part, but a conversation of
    only such rows gives a chunk with no turns.  An empty table gives an empty result.
    """
    short, long = parts(conversations, dropped, piece_rows, piece_bytes)
    return short if long is None else short.unionByName(long)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated",
                          "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _hash_chunks(batches):
    """Sorted chunks of long conversations -> one row each; the text is hashed as it streams by."""
    import hashlib

    def rows():
        for (conv,), chunks in _groups(batches, ["conv_id"]):
            sha, audit, begun, totals = hashlib.sha256(), [], False, None
            for c in chunks:
                audit.append(c["audit"])
                for t in c["turns"]:
                    sha.update((("\n" if begun else "") + t["role"] + ":" + t["text"]).encode())
                    begun = True
                totals = c if c["cost"] is not None else totals
            yield (conv, *(totals[x] for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                   "".join(audit), sha.hexdigest())

    return _out(rows(), _DIGEST_ARROW, lambda row: 200 + len(row[7]))


def digests(short: DataFrame, long: DataFrame | None) -> DataFrame:
    """One row a conversation: its counts, cost, whole audit and the SHA-256 of its repaired ``role:text`` lines."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = short.select("conv_id", *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    if long is None:
        return out
    return out.unionByName(long.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hash_chunks, _DIGEST))
