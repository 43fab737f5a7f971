"""Fill-in-middle: SQL is checked in test_queries; here a plain version, edge cases and round trips."""

import hashlib
import random
import re

import numpy as np

from tipflow.llm import infill, queries

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rotation_in_place(monkeypatch):
    monkeypatch.setattr(infill, "SWAP", 3)
    for n in range(12):
        for a in range(n + 1):
            for m in range(a, n + 1):
                for b in range(m, n + 1):
                    data = np.arange(n)
                    infill.rotate(data, a, m, b)
                    want = [*range(a), *range(m, b), *range(a, m), *range(b, n)]
                    assert data.tolist() == want


def test_split_and_join_on_random_texts():
    rnd = random.Random(3)
    forms = set()
    for i in range(5000):
        text = "".join(rnd.choice(["a", "é", " ", "\n", "\x0b", "<", "S", ">", "<S", "𝄞", "\x1c", "\xa0", "\x85"])
                       for _ in range(rnd.randint(0, 30)))
        n, form, prefix, middle, out = infill.split(text.encode(), i, 42, 50, 80)
        assert (n, form, prefix, middle, out.decode()) == brute(i, text)
        assert infill.join(out, form).decode() == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_operator_on_edge_cases(nasty, empty, spark):
    more = [(i, t) for i in range(100, 130) for t in ("", " ", "x", "a <M> b", " lead and trail \t", "ünï\ncödé ")]
    df = nasty.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = infill.restore(infill.transform(df))
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    want = [(r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert infill.transform(nasty).count() == 15
    assert infill.restore(infill.transform(empty)).collect() == []


def test_query_restores_every_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_fill_in_middle(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == brute(r.doc_id, texts[r.doc_id])[:4]
