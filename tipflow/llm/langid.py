"""Operator 2: language identification with interpolated Kneser-Ney character models.

* Text is lower-cased; runs of anything but letters become one space.  A model sees characters
  with three characters of context (the text starts after spaces).
* Spark counts the character 4-grams of every language over all labelled documents.  From the
  counts each language gets an interpolated Kneser-Ney model: absolute discounts estimated from
  counts of one and two, lower orders from continuation counts, and a uniform base.
* Models of less than ``MODEL_BYTES`` (measured) are broadcast: the 4-grams of all languages stand in
  one array sorted by hash, with the log probabilities of each language beside it, and a directory
  over the leading hash bits; a text's 4-grams are looked up all at once.  4-grams that no language
  saw back off through the models.
* Larger models stay tables: the texts' 4-grams, counted per text, get their probabilities order by
  order through joins with the counts.  Both ways use all counts and give the same results.
* A text gets the language of lowest cross-entropy in bits a character.  The score is the softmax
  of the negative cross-entropies; its temperature maximises the likelihood of the calibration rows.
* Rejection, per language: the excess of the cross-entropy over the language's median, divided by
  sqrt(a + b / length), beyond a limit.  The constant part a holds what does not average out in long
  texts (topic, markup); a and b are fitted to the medians of the absolute excess in bands of
  length, so single odd texts do not move them.  The limit is the ``QUANTILE`` of the divided excess
  times ``SLACK`` (1 + ``FEW`` / sqrt(number of rows)), wider the fewer they are.  All languages
  together count as ``POOLED`` further rows of each language.
* Temperature and rejection are calibrated on labelled rows that the models have not counted: one in
  ``CALIBRATION`` by the hash of the text, so copies stay together; rejection on those of them that
  are classified correctly.  Texts without letters are rejected too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tipflow.llm.common import U64, collected, slices, utf8, written

ORDER = 4
UNKNOWN = "und"
SLACK, FEW = 1.5, 12.0
QUANTILE, POOLED = 0.99, 50.0
MAD = 1.4826  # standard deviations in a median absolute deviation
ACCURACY = 10_000  # of quantiles: ranks are right to one in so many
CALIBRATION = 8
# A larger model is joined, not broadcast.
MODEL_BYTES = 64 << 20
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
PORTION = 1 << 22
_SPREAD = U64(0x9E3779B97F4A7C15)  # odd: multiplying is a reversible hash
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-gram of each character, where each text's characters begin, and its letters.

    A character takes 16 bits; those beyond the first plane are folded into it.
    """
    low = [(t or "").lower() for t in texts]
    # three spaces stand before each text: the context of its first character
    codes = np.frombuffer(("   " + "   ".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in low], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 3)])
    letter = _letters()[codes]
    letters = np.add.reduceat(letter, begin[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    pad = np.zeros(len(codes), bool)
    for i in range(3):
        pad[begin[:-1] + i] = True
    keep = letter | pad
    keep[1:] |= letter[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    symbols = np.where(letter, (codes ^ (codes >> 16)) & 0xFFFF, 32)[keep].astype(U64)
    grams = symbols.copy()
    for i in range(1, ORDER):
        grams[i:] |= symbols[:-i] << U64(16 * i)
    own = ~pad[keep]
    at = place[begin]
    return grams[own], at - 3 * np.arange(len(at)), letters


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
    column = batch.column("text")
    for a, b in slices(utf8(column)[1]):
        yield a, column.slice(a, b - a).to_pylist()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, cnt) over all rows of ``docs (text, lang)``."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def close():
            for lang, parts in held.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)),
                     pa.array(counts.astype(np.int64))], names=["lang", "gram", "cnt"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, texts in _texts(batch):
                grams, at, _ = characters(texts)
                for i in range(len(texts)):
                    held.setdefault(langs[row + i], []).append(grams[at[i]:at[i + 1]])
                size += len(grams)
                if size >= PORTION:
                    yield from close()
                    size = 0
        yield from close()

    return (docs.select("text", "lang").mapInArrow(run, "lang string, gram long, cnt long")
            .groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt")))


class KneserNey:
    """One language: per order sorted grams with probabilities, sorted contexts with back-off weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.base = 1.0 / alphabet
        order = np.argsort(grams)
        tables = [(grams[order], counts[order].astype(float))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before the gram
            tables.append(np.unique(tables[-1][0] & U64((1 << 16 * k) - 1), return_counts=True))
        self.orders: list[tuple] = []
        for keys, values in tables[::-1]:
            ones, twos = (values == 1).sum(), (values == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, place = np.unique(keys >> U64(16), return_inverse=True)
            total = np.bincount(place, values)
            back = discount * np.bincount(place) / total
            lower = self.probability(len(self.orders), keys & U64((1 << 16 * len(self.orders)) - 1))
            p = np.maximum(values - discount, 0) / total[place] + back[place] * lower
            self.orders.append((keys, p, contexts, back))

    def probability(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each k-gram after the characters before it."""
        if k == 0:
            return np.full(len(grams), self.base)
        keys, p, contexts, back = self.orders[k - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = p[at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            lost = grams[miss]
            at = np.minimum(np.searchsorted(contexts, lost >> U64(16)), len(contexts) - 1)
            weight = np.where(contexts[at] == lost >> U64(16), back[at], 1.0)
            out[miss] = weight * self.probability(k - 1, lost & U64((1 << 16 * (k - 1)) - 1))
        return out


class Model:
    """All languages: 4-grams sorted by hash, a directory over the leading bits, bits of each language."""

    def __init__(self, langs: list[str], place: np.ndarray, grams: np.ndarray, number: np.ndarray):
        """From (place in langs, gram, count) columns."""
        self.langs = langs
        alphabet = len(np.unique(grams & U64(0xFFFF))) + 1
        self.each = []
        for i in range(len(langs)):
            own = place == i
            self.each.append(KneserNey(grams[own], number[own], alphabet))
        every = np.unique(grams)
        hashes = every * _SPREAD
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.bits = np.stack([-np.log2(m.probability(ORDER, every[order])) for m in self.each], 1)
        self.shift = U64(64 - max(8, (2 * len(every)).bit_length()))
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each 4-gram's last character in each language."""
        want = grams * _SPREAD
        last = len(self.hashes) - 1
        at = np.minimum(self.first[want >> self.shift], last)
        open_ = np.flatnonzero(self.hashes[at] < want)
        while len(open_):  # a few steps: a directory slot holds half an entry on average
            open_ = open_[at[open_] < last]
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] < want[open_]]
        out = self.bits[at]
        miss = np.flatnonzero(self.hashes[at] != want)
        if len(miss):
            lost, place = np.unique(grams[miss], return_inverse=True)
            out[miss] = np.stack([-np.log2(m.probability(ORDER, lost)) for m in self.each], 1)[place]
        return out


class Tables:
    """All languages as tables of counts per order, for a model that is too large to broadcast."""

    def __init__(self, counts: DataFrame, langs: list[str], alphabet: int):
        self.langs, self.base = langs, 1.0 / alphabet
        tables = [counts.select("lang", "gram", F.col("cnt").alias("value"))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before the gram
            tables.append(written(tables[-1].groupBy("lang", _suffix(k).alias("gram")).agg(F.count("*").alias("value")),
                                  "continuations"))
        self.orders = tables[::-1]
        self.discounts: list[dict[str, float]] = []
        for values in self.orders:
            rows = values.groupBy("lang").agg(F.count_if(F.col("value") == 1), F.count_if(F.col("value") == 2)).collect()
            self.discounts.append({lang: ones / (ones + 2 * twos) if ones and twos else 0.5 for lang, ones, twos in rows})

    def bits(self, grams: DataFrame) -> DataFrame:
        """(gram, cost): bits of the last character of each of the distinct ``grams (gram)`` in each language."""
        lower = None
        for k in range(1, ORDER + 1):
            values = self.orders[k - 1]
            seen = values.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("seen"))
            contexts = (values.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("context"))
                        .agg(F.sum("value").alias("total"), F.count("*").alias("kinds")).groupBy("context")
                        .agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("total", "kinds")))).alias("known")))
            want = grams.select(_suffix(k).alias("gram")).distinct()
            want = (want.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("suffix", _suffix(k - 1))
                    .join(seen, "gram", "left").join(contexts, "context", "left"))
            if lower is not None:
                want = want.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            each = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(self.discounts[k - 1][lang]).alias("discount"),
                                      F.lit(i + 1).alias("place")) for i, lang in enumerate(self.langs)])
            lower = written(want.select("gram", F.transform(each, lambda x: self._probability(x, k)).alias("p")),
                            "probabilities")
        return lower.select("gram", F.transform("p", lambda p: -F.log2(p)).alias("cost"))

    def _probability(self, x: Column, k: int) -> Column:
        below = F.lit(self.base) if k == 1 else F.element_at("below", x["place"])
        value = F.coalesce(F.try_element_at("seen", x["lang"]).cast("double"), F.lit(0.0))
        known = F.try_element_at("known", x["lang"])
        return F.when(known.isNull(), below).otherwise(
            F.greatest(value - x["discount"], F.lit(0.0)) / known["total"]
            + x["discount"] * known["kinds"] / known["total"] * below)


def _suffix(k: int) -> Column:
    """The last k characters of a gram."""
    return F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))


def train(docs: DataFrame, broadcast_bytes: int = MODEL_BYTES) -> Model | Tables | None:
    """Models from all rows of ``docs (text, lang)`` with a lang; None if there are no characters."""
    counts = written(gram_counts(docs.where("lang is not null and text is not null")), "grams")
    langs = {r[0]: r[1] for r in counts.groupBy("lang").count().collect()}
    if not langs:
        return None
    distinct = counts.select("gram").distinct().count()
    # per 4-gram a hash and the bits of each language; per language keys, probabilities and contexts of all orders
    if distinct * (8 + 8 * len(langs)) + 48 * sum(langs.values()) <= broadcast_bytes:
        names = sorted(langs)
        place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
        got = collected(counts.select(place.cast("int").alias("place"), "gram", "cnt"))
        return Model(names, got["place"], got["gram"].astype(np.int64).view(U64), got["cnt"])
    return Tables(counts, sorted(langs), counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF).cast("long"))).distinct().count() + 1)


def _joined_entropies(docs: DataFrame, model: Tables, keep: list[str]) -> DataFrame:
    """As ``entropies``, by joining the 4-grams of the texts with the model's tables."""
    kept = docs.select(*keep, "text", F.monotonically_increasing_id().alias("_entry"))
    schema = docs.select(*keep).schema.add("_entry", "long").add("letters", "long").add("chars", "long").add(
        "grams", ArrayType(StructType().add("gram", "long").add("n", "long")))
    grams_type = pa.struct([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            names = [*keep, "_entry"]
            for row, texts in _texts(batch):
                grams, at, letters = characters(texts)
                each = [np.unique(grams[x:y], return_counts=True) for x, y in zip(at[:-1], at[1:])]
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([g for g, _ in each]).view(np.int64)),
                     pa.array(np.concatenate([n for _, n in each]).astype(np.int64))], fields=list(grams_type))
                ends = np.cumsum([0, *[len(g) for g, _ in each]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, len(texts)) for c in names]
                    + [pa.array(letters), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    names=[*names, "letters", "chars", "grams"])

    rows = written(kept.mapInArrow(run, schema), "texts")
    grams = rows.select("_entry", F.explode("grams").alias("g")).select("_entry", "g.gram", "g.n")
    costs = model.bits(grams.select("gram").distinct())
    total = grams.join(costs, "gram").groupBy("_entry").agg(F.array(
        *[F.sum(F.element_at("cost", i + 1) * F.col("n")) for i in range(len(model.langs))]).alias("total"))
    none = F.array(*[F.lit(0.0) for _ in model.langs])
    return rows.drop("grams").join(total, "_entry", "left").select(
        *keep, "letters", "chars", F.coalesce(F.transform("total", lambda t: t / F.col("chars")), none).alias("bits"))


def entropies(docs: DataFrame, model: Model | Tables | None, keep: list[str]) -> tuple:
    """(keep..., letters, chars, bits): bits holds the cross-entropy of the whole text per language; and the
    model's broadcast, if there is one, to destroy when the rows are written.

    ``keep`` names other columns than text.
    """
    if isinstance(model, Tables):
        return _joined_entropies(docs, model, keep), None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    schema = docs.select(*keep).schema
    schema = schema.add("letters", "long").add("chars", "long").add("bits", ArrayType(DoubleType()))

    def run(batches):
        model = shared.value
        for batch in batches:
            letters, chars, bits = [], [], []
            for _, texts in _texts(batch):
                grams, at, found = characters(texts)
                n = np.diff(at)
                letters.append(found)
                chars.append(n)
                total = np.zeros((len(texts), len(model.langs) if model else 0))
                if model is not None and len(grams):
                    some = np.flatnonzero(n)
                    total[some] = np.add.reduceat(model.cost(grams), at[:-1][some], axis=0) / n[some, None]
                bits.append(total)
            if not len(batch):
                continue
            flat = np.concatenate(bits)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.concatenate(letters)), pa.array(np.concatenate(chars)),
                                                   lists], names=[*keep, "letters", "chars", "bits"])

    return kept.mapInArrow(run, schema), shared


def _softmax(bits: Column, temperature: float, at: Column) -> Column:
    """Share of the language at the 1-based place ``at``."""
    return 1 / F.aggregate(bits, F.lit(0.0), lambda s, b: s + F.exp(
        F.lit(temperature * np.log(2)) * (F.element_at(bits, at) - b)))


def _spread(bands: list[tuple[float, float, float]]) -> tuple[float, float]:
    """a and b, neither negative, of variance = a + b / chars, from (1 / chars, variance, weight) of bands.

    Least squares of the relative errors.
    """
    x, v, n = np.array(bands).T
    a, b = 0.0, float(np.average(v / x, weights=n))
    for _ in range(20):
        w = n / np.maximum(a + b * x, 1e-9) ** 2
        s0, s1, s2, t0, t1 = w.sum(), (w * x).sum(), (w * x * x).sum(), (w * v).sum(), (w * x * v).sum()
        det = s0 * s2 - s1 * s1
        a, b = ((s2 * t0 - s1 * t1) / det, (s0 * t1 - s1 * t0) / det) if det > 1e-9 * s0 * s2 else (0.0, t1 / s2)
        if a < 0:
            a, b = 0.0, t1 / s2
        elif b < 0:
            a, b = t0 / s0, 0.0
    return float(a), float(b)


def _limits(right: DataFrame, best: Column, number: int) -> list[tuple[float, float, float, float]]:
    """(median, a, b, limit) of each language, from calibration rows that are classified correctly.

    A language without such rows rejects nothing.
    """
    right = right.select("_best", best.alias("bits"), F.col("chars").cast("double").alias("chars"))
    centre = {r[0]: r[1] for r in right.groupBy("_best").agg(F.percentile_approx("bits", 0.5, ACCURACY)).collect()}
    nothing = (float("inf"), 0.0, 1.0, float("inf"))
    if not centre:
        return [nothing] * number

    def of(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("_best"))

    excess = F.col("bits") - of([centre.get(i + 1, 0.0) for i in range(number)])
    band = F.floor(F.log2("chars"))
    right = right.withColumn("excess", excess).withColumn("band", F.floor(F.log2("chars")))
    band = [F.avg(1 / F.col("chars")), F.percentile_approx(F.abs("excess"), 0.5, ACCURACY), F.count("*")]

    def bands(rows, first: int, weight: float = 1.0) -> list[tuple[float, float, float]]:
        return [(r[first], max((MAD * r[first + 1]) ** 2, 1e-6), weight * r[first + 2]) for r in rows]

    every = bands(right.groupBy("band").agg(*band).collect(), 1)
    total = sum(n for _, _, n in every)
    pooled = min(POOLED, total)
    own: dict[int, list] = {}
    for r in right.groupBy("_best", "band").agg(*band).collect():
        own.setdefault(r[0], []).extend(bands([r], 2))
    shared = [(x, v, n * pooled / total) for x, v, n in every]
    spread = {i: _spread(rows + shared) for i, rows in own.items()}
    a, b = ([spread.get(i + 1, (0.0, 1.0))[j] for i in range(number)] for j in (0, 1))
    right = right.withColumn("far", F.col("excess") / F.sqrt(of(a) + of(b) / F.col("chars")))
    quantile = F.percentile_approx("far", QUANTILE, ACCURACY)
    common = right.agg(quantile).first()[0]
    out = [nothing] * number
    for i, most, n in right.groupBy("_best").agg(quantile, F.count("*")).collect():
        most = (n * most + pooled * common) / (n + pooled)
        wide = SLACK * (1 + FEW / min(total, n + pooled) ** 0.5)
        out[i - 1] = (centre[i], a[i - 1], b[i - 1], wide * max(most, 1.0))
    return out


def identify(docs: DataFrame, labelled: Column, keep: list[str], broadcast_bytes: int = MODEL_BYTES) -> DataFrame:
    """(keep..., lang_pred, score, cross_entropy, rejected, learned) of every row of ``docs (text, lang)``.

    ``labelled`` says from which rows to learn (those with a null lang never count).  lang_pred is a
    learned language, or ``und`` (score 0, rejected) for null texts, texts without a letter, and
    everything if nothing could be learned, which learned tells; ties go to the first language by code point.
    Repeated rows count and answer each by itself.  Other columns than text, lang, those of
    ``labelled`` and ``keep`` are not read.  An empty table gives an empty result.
    """
    learn = F.coalesce(labelled, F.lit(False)) & F.col("lang").isNotNull()
    kept_back = learn & (F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)) == 0)
    model = train(docs.where(learn & ~kept_back), broadcast_bytes) or train(docs.where(learn), broadcast_bytes)
    langs = F.array(*[F.lit(x) for x in model.langs]) if model else F.array().cast("array<string>")
    scored, shared = entropies(docs.withColumn("_lang", F.col("lang")).withColumn("_learn", kept_back), model,
                               [*keep, "_lang", "_learn"])
    scored = written(scored.withColumn("_best", F.when(
        (F.col("letters") > 0) & (F.size("bits") > 0),
        F.array_position("bits", F.array_min("bits")).cast("int"))), "entropies")
    if shared is not None:
        shared.destroy()
    has = F.col("_best").isNotNull()  # element_at at a null place need not be null
    best = F.when(has, F.element_at("bits", F.col("_best")))
    pred = F.when(has, F.element_at(langs, F.col("_best")))
    known = scored.where(F.col("_learn") & F.col("_best").isNotNull())
    likelihood = [F.sum(F.log(F.greatest(F.lit(1e-12), _softmax(
        F.col("bits"), t, F.array_position(langs, F.col("_lang")).cast("int"))))).alias(str(i))
        for i, t in enumerate(TEMPERATURES)] if model else []
    temperature = 1.0
    if model:
        found = known.where(F.array_contains(langs, F.col("_lang"))).agg(*likelihood).first()
        if found[0] is not None:
            temperature = TEMPERATURES[max(range(len(TEMPERATURES)), key=lambda i: found[i])]
        right = known.where(pred == F.col("_lang"))
        median, a, b, limit = (F.element_at(F.array(*[F.lit(x) for x in column]), F.col("_best"))
                               for column in zip(*_limits(right, best, len(model.langs))))
        far = (best - median) / F.sqrt(a + b / F.col("chars"))
        rejected = F.when(has, far > limit).otherwise(True)
        score = F.when(has, _softmax(F.col("bits"), temperature, F.col("_best"))).otherwise(0.0)
    else:
        rejected, score = F.lit(True), F.lit(0.0)
    return scored.select(*keep, F.coalesce(pred, F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"),
                         best.alias("cross_entropy"), rejected.alias("rejected"), F.lit(model is not None).alias("learned"))
