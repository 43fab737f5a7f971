"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tipflow.llm import decontaminate, langid, mixing, ngram_join, pii, quality, rules, substrings, urls, warc


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 0), (7, None), (None, 1), (9, 1), (99, 1)],
                                 "doc_id long, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one two"),
                                  (5, "not in any text of these at all")], "item_id long, text string")


def test_ngram_join(nasty, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.classes(nasty).collect()}
    assert got[(1, 10)] == got[(2, 10)] == got[(3, 10)] == got[(None, 10)] == 1
    assert got[(4, 0)] == 4 and got[(5, 0)] == 5 and got[(6, 0)] == 6 and got[(None, 0)] is None
    assert got[(7, 1)] == got[(8, 1)] == 7
    assert {v for (k, _), v in got.items() if k in (9, 10)} == {9}
    assert ngram_join.classes(nasty).count() == 15
    assert ngram_join.classes(empty).collect() == []


def test_keep_one_keeps_columns(nasty):
    kept = ngram_join.keep_one(nasty)
    assert kept.columns == nasty.columns
    assert sorted(x for (x,) in rows(kept, "doc_id") if x is not None) == [1, 4, 5, 6, 7, 9, 11, 12]
    assert rows(kept.where("doc_id is null"), "text") == [(None,)]  # its only other row is a copy of 1


def test_language(nasty, empty):
    got = langid.identify(nasty, F.lit(True), ["doc_id"])
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.count() == 15
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (4, 5, 6, 12))
    assert by[11].lang_pred == "fr" and by[1].lang_pred == "en" and 0 <= by[1].score <= 1
    assert langid.identify(empty, F.lit(True), ["doc_id"]).collect() == []
    unlearned = langid.identify(nasty, F.lit(False), ["doc_id"])
    assert {(r.lang_pred, r.score, r.rejected) for r in unlearned.collect()} == {("und", 0.0, True)}


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.net/x?y=1", 1.0), (1, "http://A.net/x?y=1", 1.0), (None, None, None), (2, "", 2.0), (3, "no scheme", 1.0),
         (4, "x://EXAMPLE.net/en/9#f", 0.0), (5, "http://net?a", 0.0), (6, "http://b.org/fr/" + "z" * 200_000, 0.0)],
        "page_id long, url string, score double")
    got = rows(urls.judge(pages, [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"),
                                  urls.Rule("allow", "org", "/fr/")]), "page_id", "host", "rule", "verdict")
    assert (1, "a.net", "net/", "block") in got and len(got) == 8
    assert (4, "example.net", "example.net/en/", "allow") in got
    assert [r[1:3] for r in got if r[0] in (None, 2, 3)] == [("", None)] * 3
    assert [r[2] for r in got if r[0] == 5] == [None]  # an empty path does not start with /
    assert urls.judge(pages.where("false"), [urls.Rule("block", "net")]).collect() == []


def test_pii(nasty, empty, spark):
    assert pii.find(nasty).count() == 15 and pii.find(empty).collect() == []
    more = nasty.withColumn("text", F.when(F.col("doc_id") == 7, "mail a.b@c.de now").otherwise(F.col("text")))
    masked = pii.masked(more)
    assert masked.columns == nasty.columns and masked.count() == 15
    assert rows(masked.where("doc_id = 7"), "text", "n_chars", "size") == [("mail <email> now", 16, "six")]
    assert rows(masked.where("doc_id in (4, 5)"), "doc_id", "text") == [(4, ""), (5, None)]


def test_warc(spark):
    big, small = "é" * 600, "x" * 900
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nx: y", big, "q"), (2, None, big, "q"), (2, None, big, "q"), (3, "u", small, "q"), (4, "u", small, "q"),
         (5, "u", None, "q"), (6, "", "", None), (None, "ü", big, None), (None, "u", "z" * 2000, None)],
        "page_id long, url string, html string, valid string")
    got = warc.archive(pages)
    assert got.count() == 9 and got.where("not valid").count() == 0
    assert rows(got, "page_id", "record_type", "refers_to", "payload_bytes") == sorted([
        (1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (3, "response", None, 900),
        (4, "response", None, 900), (5, "response", None, 0), (6, "response", None, 0), (None, "revisit", 2, 1200),
        (None, "response", None, 2000)], key=repr)
    assert warc.archive(pages.where("false")).collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(nasty, empty, items, limit):
    got = rows(decontaminate.contaminated(nasty, items, broadcast_bytes=limit), "doc_id", "item_id", "shared")
    assert got == sorted([(i, 1, 4) for i in (1, 2, 2, 3, None)] + [(7, 4, 1), (8, 4, 1)], key=repr)
    assert decontaminate.contaminated(empty, items, broadcast_bytes=limit).collect() == []
    assert decontaminate.contaminated(nasty, items.where("false"), broadcast_bytes=limit).collect() == []


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_short_items_inside_long_documents(spark, limit):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, long + " Fox JUMPS over " + long), (2, "fox jumps"), (3, "fox over jumps"), (4, "jumps"), (5, long)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "fox jumps over"), (2, "fox  jumps"), (3, "JUMPS"), (4, "w7 w8 w9 w10"), (5, "w7 w9"),
                                   (6, "w1 w2 w3 w4 w5"), (7, "")], "item_id long, text string")
    got = rows(decontaminate.contaminated(docs, items, broadcast_bytes=limit), "doc_id", "item_id", "shared", "item_shingles")
    assert got == sorted([(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (1, 3, 1, 1), (2, 3, 1, 1), (3, 3, 1, 1), (4, 3, 1, 1),
                          (1, 4, 1, 1), (5, 4, 1, 1), (1, 6, 1, 1), (5, 6, 1, 1)], key=repr)


def test_decontaminated_columns(nasty, items):
    kept = decontaminate.clean(nasty, items)
    assert kept.columns == nasty.columns
    assert sorted(x for (x,) in rows(kept, "doc_id") if x is not None) == [4, 5, 6, 9, 10, 11, 12]


def test_substrings(nasty, empty):
    got = rows(substrings.removals(nasty), "doc_id", "start", "kept_doc_id")
    assert got == sorted([(2, 0, 1), (2, 0, 1), (3, 0, 1), (None, 0, 1)], key=repr)
    out = substrings.deduplicated(nasty, sentence_words=2)
    assert out.columns == [*nasty.columns, "removed"] and out.count() == 15
    assert rows(out.where("doc_id = 11"), "text") == [("été à l'école\n",)]
    assert substrings.removals(empty).collect() == []


def test_mixing(nasty, empty):
    got = mixing.mix(nasty, block=1)
    assert got.count() == 15 and got.where("taken > 2 * size or taken < 0").count() == 0
    assert rows(got.where("doc_id in (4, 5, 6)"), "size", "taken") == [(0, 0)] * 3
    assert mixing.mix(empty).collect() == []
    assert rows(mixing.mix(nasty.where("size(split(text, ' ')) < 1")), "taken") == []


def test_quality(nasty, empty, labels):
    held = F.col("doc_id") == 9
    got = quality.classify(nasty, labels, held)
    assert got.count() == 15 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert rows(got.where("held_out"), "doc_id") == [(9,)]
    assert quality.classify(empty, labels, held).collect() == []
    assert {r.score for r in quality.classify(nasty, labels.where("quality = 1"), held).collect()} == {1.0}
    assert {r.score for r in quality.classify(nasty, labels.where("false"), held).collect()} == {0.5}


def test_rules(nasty, empty, labels):
    got = rules.judge(nasty, labels)
    assert got.count() == 15
    by = {r.doc_id: r for r in got.collect()}
    assert by[5].n_words == 0 and by[5].base_failed and not by[5].kept
    assert by[11].n_dup_lines == 2 and by[11].n_repeat_words == by[11].n_words == 9
    assert not by[9].base_failed and by[9].n_words == 120_000
    assert rules.judge(empty, labels).collect() == []
    unlabelled = rules.judge(nasty, labels.where("false"))
    assert unlabelled.where("kept = base_failed").count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_long_url(spark):
    """A URL that encodes to more than two megabytes."""
    got = warc.archive(pages_of(spark, [(1, "http://a/" + "é" * 350_000, "x" * 1200), (2, "http://b/", "x" * 1200)])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.valid) for r in got) == [(1, "revisit", 2, True), (2, "response", None, True)]


def test_mixing_spreads_rows_without_doc_id(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id").cast("long"),
                                 F.concat(F.lit("a b c "), "id").alias("text"), F.lit("s").alias("source"))
    shard = F.conv(F.substring(mixing.seeded("doc_id", "text", "x"), 1, 15), 16, 10).cast("long") % 8
    assert df.groupBy(F.col("doc_id").isNull(), shard).count().count() == 16
    got = mixing.mix(df, shard_docs=50).collect()
    assert len(got) == 400 and abs(sum(r.taken for r in got) - got[0].target) <= 16 * 8


def test_pipeline_stages_on_rows_that_share_or_lack_a_doc_id(spark, empty):
    """Repeated and null doc_ids with unrelated texts, no labels at all, and empty tables."""
    import corpus_pipeline

    def text(i):
        return " ".join(f"t{i}w{j} word{(i * 7 + j) % 13}" for j in range(30))

    docs = spark.createDataFrame(
        [(5, text(1), None, "a", 1), (5, text(2), None, "a", 1), (9, text(2), None, "a", 1), (None, text(3), None, "a", 1),
         (None, text(3) + " tail", None, "b", 1), (6, text(4), None, None, 1), (6, text(4), None, None, 1), (None, None, None, None, None),
         (3, text(1) + " end", None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")

    def kept(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    assert kept(corpus_pipeline.language(spark, docs, "")) == kept(docs)
    got = kept(ngram_join.keep_one(docs))
    one_of_three = [x for x in got if x[0] is None and x[1] is not None]
    assert len(one_of_three) == 1 and one_of_three[0][1].startswith("t3w0")
    assert [x for x in got if x not in one_of_three] == sorted(
        [(3, text(1) + " end"), (5, text(2)), (6, text(4)), (None, None)], key=repr)
    items = spark.createDataFrame([(1, " ".join(text(3).split()[4:30])), (2, " ".join(text(2).split()[:20]))], "item_id long, text string")
    assert kept(decontaminate.clean(docs, items)) == sorted(
        [(3, text(1) + " end"), (5, text(1)), (6, text(4)), (6, text(4)), (None, None)], key=repr)
    sf = "/root/testdata/sf0.001"
    nothing = empty.select(*docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).collect() == []


def test_join_hands_python_bounded_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in names}
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat('a b c d ', id, repeat(' word', if(id < 100, 40000, 1))) as text")
    try:
        for k in names:
            spark.conf.unset(k)
        assert ngram_join.classes(docs).count() == 3000
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in got) == 3000 and max(r.n for r in got) <= 1000
    assert max(r.bytes for r in got) < 8 << 20  # 20 MB of long texts
