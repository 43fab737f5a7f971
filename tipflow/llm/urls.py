"""Operator 3: URL filter by rules and boosted trees on lexical features.

* Rules (verdict, host, path) hold for their host and its subdomains where the URL's path starts with
  the rule's; the longest rule wins.
* Other URLs get the verdict of gradient-boosted trees on lexical features: lengths, depth, digit
  ratio, entropy, parameter counts, and statistics of the host's suffixes (last label, last two)
  over all URLs.  The trees learn from labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tipflow.llm import gbt
from tipflow.llm.common import collected, written
from tipflow.llm.quality import scored

CUT = 0.5
# The trees learn from at most so many labelled URLs: those with the smallest hashes.
SAMPLE = 50_000
LEXICAL = ("length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "hyphens", "entropy",
           "host_entropy", "parameters", "query_length", "fragment", "secure", "longest_token")
SUFFIXES = ("log_urls", "mean_length", "mean_digits")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null.  Of equally long ones the first
    by text; ``rules`` is a short literal list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    after, _, fragment = url.partition("#")
    query = after.partition("?")[2]
    digits = sum(c.isdigit() for c in url)
    tokens = [t for t in path.replace("-", "/").replace("_", "/").replace(".", "/").split("/") if t]
    return [len(url), len(host), len(path), host.count(".") + 1 if host else 0, sum(bool(s) for s in path.split("/")),
            digits / max(len(url), 1), sum(c.isdigit() for c in host), host.count("-"), _entropy(url), _entropy(host),
            sum(bool(p) for p in query.split("&")), len(query), float(bool(fragment)), float(url.startswith("https:")),
            max(map(len, tokens), default=0)]


def features(urls: DataFrame) -> DataFrame:
    """``urls (url, host, path, ...)`` with ``features``: LEXICAL, then SUFFIXES of both suffixes."""
    names = urls.columns
    schema = urls.select("*").schema.add("lexical", ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.array([list(map(float, lexical(*r))) for r in rows], pa.list_(pa.float64()))],
                names=[*names, "lexical"])

    out = written(urls.mapInArrow(run, schema).withColumn("_last", F.substring_index("host", ".", -1))
                  .withColumn("_two", F.substring_index("host", ".", -2)), "urls")
    for key in ("_last", "_two"):
        counts = out.groupBy(F.col(key).alias("_suffix")).agg(F.array(
            F.log1p(F.count("*")), F.avg(F.element_at("lexical", 1)), F.avg(F.element_at("lexical", 6))).alias("_" + key))
        out = out.join(counts, F.col(key) == F.col("_suffix")).drop("_suffix", key)
    return out.withColumn("features", F.concat("lexical", "__last", "__two")).drop("lexical", "__last", "__two")


def train(rows: DataFrame, sample: int = SAMPLE) -> gbt.Boosted:
    """Trees for blocking from ``rows (url, features, verdict)``; rows without a verdict teach nothing."""
    got = collected(rows.where("verdict is not null").select("features", (F.col("verdict") == "block").cast("double").alias("y"))
                    .orderBy(F.xxhash64("features"), "features", "y").limit(sample))
    x = np.array(got["features"].tolist(), float).reshape(len(got["y"]), -1 if len(got["y"]) else len(LEXICAL))
    return gbt.fit(x, got["y"].astype(float))


def held_out_accuracy(pages: DataFrame, rules: list[Rule], folds: int = 5, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """(suffixes, urls, accuracy, base): how the trees judge rule-decided URLs of hosts that they have not seen.

    One host in ``folds``, by its hash, is held out with all its URLs.  One row with the suffix
    statistics among the features and one without; base is the share of the larger class.  Null where
    no URL is held out.
    """
    host, path = parts(F.col("url"))
    decided = (pages.select("url", host.alias("host"), path.alias("path"))
               .withColumn("verdict", matched(F.col("host"), F.col("path"), rules)["verdict"]).where("verdict is not null"))
    rows = written(features(decided).select("host", "verdict", "features"), "features")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("host"), F.lit(folds)) == 0)
    out = None
    for suffixes in (True, False):
        mine = rows if suffixes else rows.withColumn("features", F.slice("features", 1, len(LEXICAL)))
        model = train(mine.where("not held"), sample)
        blocked = (F.col("score") >= cut) if len(model.feature) else F.lit(False)
        share = F.avg((F.col("verdict") == "block").cast("double"))
        got = scored(mine.where("held"), model, ["verdict"]).agg(
            F.count("*").alias("urls"), F.avg((blocked == (F.col("verdict") == "block")).cast("double")).alias("accuracy"),
            F.greatest(share, 1 - share).alias("base")).select(F.lit(suffixes).alias("suffixes"), "urls", "accuracy", "base")
        out = got if out is None else out.unionAll(got)
    return out


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, cut: float = CUT,
          sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages (page_id, url)``.

    The trees learn from the URLs that a rule decides, and from ``labelled (url, verdict)`` if given.
    verdict is the rule's; else block if the score (probability of block) reaches ``cut``, else allow.
    Null URLs, and URLs without ``://``, have an empty host and path, no rule, and are scored as they are.
    Without labelled URLs every score is 0.5 and the verdict allow.  Repeated rows and null page_ids
    each give a row.  Other columns are not read.  An empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn(
        "_match", matched(F.col("host"), F.col("path"), rules))
    urls = urls.select("page_id", "url", "host", "path", "_match.rule", "_match.verdict", F.lit(True).alias("own"))
    if labelled is not None:
        more = labelled.where("verdict is not null").select(
            F.lit(None).cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"),
            F.lit(None).cast("string").alias("rule"), "verdict", F.lit(False).alias("own"))
        urls = urls.unionByName(more)
    rows = written(features(urls), "features")
    model = train(rows, sample)
    out = scored(rows.where("own"), model, ["page_id", "host", "path", "rule", "verdict"])
    learned = F.when((F.col("score") >= cut) & F.lit(bool(len(model.feature))), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "score")
