"""Models against plain versions of their formulas, and on hosts held out."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipflow.llm import langid, quality, queries, stats, urls
from tipflow.llm.common import crc_fold, table

SF = "/root/testdata/sf0.001"


def grams_of(text):
    low, out, before = (text or "").lower(), [], " "
    seen = "   "
    for c in low:
        c = c if c.isalpha() else " "
        if c == " " and before == " ":
            continue
        seen += c
        out.append(seen[-4:])
        before = c
    return out


class Plain:
    """Interpolated Kneser-Ney over characters, straight from its definition, with dictionaries."""

    def __init__(self, counts, alphabet):
        self.alphabet = alphabet
        self.tables = {4: counts}
        for k in (3, 2, 1):
            self.tables[k] = collections.Counter(g[1:] for g in self.tables[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, t in self.tables.items():
            ones, twos = (sum(v == n for v in t.values()) for n in (1, 2))
            self.discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.total[k], self.kinds[k] = collections.Counter(), collections.Counter()
            for g, v in t.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / self.alphabet
        lower = self.p(gram[1:])
        total = self.total[k].get(gram[:-1])
        if not total:
            return lower
        d = self.discount[k]
        return (max(self.tables[k].get(gram, 0) - d, 0) + d * self.kinds[k][gram[:-1]] * lower) / total


def test_kneser_ney_by_its_definition(spark):
    docs = table(spark, SF, "documents").select("doc_id", F.substring("text", 1, 1500).alias("text"), "lang").where("doc_id < 120")
    learned = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(langid.CALIBRATION)) != 0).collect()}
    rows = docs.collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.doc_id in learned and r.lang is not None:
            counts[r.lang].update(grams_of(r.text))
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    models = {lang: Plain(c, alphabet) for lang, c in counts.items()}
    for how in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r for r in langid.identify(docs, F.lit(True), ["doc_id"], **how).collect()}
        for r in rows[:40]:
            grams = grams_of(r.text)
            if not any(c.isalpha() for c in r.text or ""):
                assert got[r.doc_id].lang_pred == "und"
                continue
            bits = {lang: -sum(math.log2(m.p(g)) for g in grams) / len(grams) for lang, m in models.items()}
            best = min(bits, key=lambda x: (bits[x], x))
            assert got[r.doc_id].lang_pred == best
            assert got[r.doc_id].cross_entropy == pytest.approx(bits[best], rel=1e-9)


def test_discriminant_by_its_definition(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = stats.measured(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "features").collect()
    label = {r.doc_id: r.quality for r in labels.where("quality in (0, 1)").collect()}
    held = {r.doc_id for r in docs.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("h")).where("h").collect()}
    x = {r.doc_id: np.array(r.features) for r in rows}
    learn = [i for i in x if i in label and i not in held]
    every = np.array([x[i] for i in learn])
    center, scale = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-12))
    z = {c: np.array([(x[i] - center) / scale for i in learn if label[i] == c]) for c in (0, 1)}
    cov = {c: np.cov(z[c].T, bias=True) for c in (0, 1)}
    pooled = sum(len(z[c]) * cov[c] for c in (0, 1)) / len(learn)
    pooled = (1 - quality.RIDGE) * pooled + quality.RIDGE * np.eye(len(pooled)) * np.trace(pooled) / len(pooled)

    def log_density(v, c):
        s = (1 - quality.SHRINK) * cov[c] + quality.SHRINK * pooled
        d = v - z[c].mean(0)
        return -0.5 * (d @ np.linalg.solve(s, d) + np.linalg.slogdet(s)[1]) + np.log(len(z[c]) / len(learn))

    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, SF).collect()}
    assert got.keys() == x.keys()
    for i, v in x.items():
        v = (v - center) / scale
        want = 1 / (1 + math.exp(-max(-500, min(500, log_density(v, 1) - log_density(v, 0)))))
        assert got[i].score == pytest.approx(want, abs=1e-6)


def test_urls_of_hosts_held_out(spark):
    rows = {r.suffixes: r for r in urls.held_out_accuracy(table(spark, "/root/testdata/sf0.1", "pages"), queries.URL_RULES).collect()}
    assert rows[True].urls == rows[False].urls > 0
    assert all(0 <= r.accuracy <= 1 for r in rows.values())
    assert all(r.accuracy > r.base for r in rows.values())
    none = urls.held_out_accuracy(table(spark, SF, "pages").where("false"), queries.URL_RULES).collect()
    assert [(r.urls, r.accuracy) for r in none] == [(0, None)] * 2
