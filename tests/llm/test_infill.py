import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binlens.llm.infill import UnitIndex, cut_batch, fill_in_middle, restore

D = "/root/testdata/sf0.01"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(i, text):
    """The contract, one text at a time."""
    text = text or ""
    digest = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_kernel_against_regular_expressions():
    rng = random.Random(1)
    parts = ["a", "Z", "bc", "é", "ß", "—", "\U0001f600", " ", "\n", "0", "`", "{", "@", "[", "\x00", "Ā", "\x7f"]
    for turn in range(300):
        texts = ["".join(rng.choice([*parts, "Ab" * rng.randint(1, 9)]) for _ in range(rng.choice([0, 0, 1, 2, 7, 60]))) for _ in range(rng.randint(1, 12))]
        array = pa.array(["cut off", *texts, "also cut off"])[1:-1] if turn % 2 else pa.array(texts)
        x, y = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
        forms = [rng.choice(["plain", "psm", "spm"]) for _ in texts]
        for t, h1, h2, form, r in zip(texts, x.tolist(), y.tolist(), forms, cut_batch(array, x, y, forms).to_pylist()):
            units = UNIT.findall(t)
            a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
            p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
            want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            lengths = (None, None) if form == "plain" else (len(p), len(m))
            assert (r["n"], r["output"], (r["prefix_chars"], r["middle_chars"])) == (len(units), want, lengths)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_words_meet(block):
    data = ("abc défè " * 30 + "xyz" * 50).encode()
    raw, offsets = np.frombuffer(data, np.uint8), np.array([0, 17, 17, 40, len(data)])
    a, b = UnitIndex(raw, offsets, block=block), UnitIndex(raw, offsets)
    assert (a.ends == b.ends).all() and (a.leads == b.leads).all()


def test_query_against_the_contract(spark):
    from binlens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_fill_in_middle"](spark, D).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n, form, prefix, middle, output = slow(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(d.text or ""))


def test_odd_rows(spark, odd, odd_rows, empty):
    marked = spark.createDataFrame([(900 + k, t) for k, t in enumerate(["a <P> b", "<S>", "x<M", "<<P", "tail <", "tail <S", "S>", "P>a<"] * 6)], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionAll(marked)
    out = fill_in_middle(odd.unionByName(marked, allowMissingColumns=True))
    out = out.withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = sorted(repr((r.doc_id, *slow(r.doc_id, r.text), r.text or "")) for r in rows.collect())
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in out) == want
    assert fill_in_middle(empty).collect() == []
    assert {r.form for r in out} == {"plain", "psm", "spm"}
