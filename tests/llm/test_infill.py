import hashlib
import random

import numpy as np
import pytest
from llm_texts import ODD_COLUMNS, prose
from pyspark.sql import functions as F

from glebe.llm import infill


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(docs):
    filled = infill.fill_in_middle(docs, carry=["doc_id", "text"])
    got = infill.restore(filled.withColumn("kept", F.col("output"))).select(
        "doc.doc_id", "doc.text", "n", "form", "prefix_chars", "middle_chars", "kept", "restored").collect()
    for r in got:
        assert tuple(r)[2:7] == plainly(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    return got


def test_odd_documents(spark, odd_docs, no_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    assert check(no_docs) == []
    whole = infill.fill_in_middle(odd_docs)
    assert whole.schema["doc"].dataType.names == odd_docs.columns


def test_many_forms_and_letters(spark):
    rng = random.Random(3)
    pieces = ["a", "<", ">", "P>", "<S", "é", "λ", "漢", "😀", "\n", " ", "\x00", "<P>"]
    rows = [(i, "".join(rng.choices(pieces, [9, 3, 3, 2, 2, 3, 3, 3, 3, 1, 2, 1, 0.1], k=rng.randrange(0, 40)))) for i in range(3000)]
    got = check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_bytes_move_alike_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abé漢😀<>", k=rng.randrange(0, 30))) for _ in range(60)]
    forms = np.array([("plain", "psm", "spm")[i % 3] if t else "plain" for i, t in enumerate(texts)], object)
    cuts = [sorted(rng.randrange(len(t) + 1) for _ in range(2)) if f != "plain" else [0, 0] for t, f in zip(texts, forms, strict=True)]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    results = []
    for block in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(infill, "BLOCK", block)
        out, out_ends = infill._scatter(data, ends, forms, np.array([len(t) for t in texts]), *np.array(cuts).T)
        back, back_ends = infill._gather(out, out_ends, forms)
        assert back.tobytes() == data.tobytes() and (back_ends == ends).all()
        results.append(out.tobytes())
    assert len(set(results)) == 1


def test_null_and_broken_outputs(spark):
    rows = [(1, None, "plain", "x"), (2, "", "plain", "y"), (3, "<P>ab<S>c<M>d", "psm", "z"), (4, "<S>ab<P>c<M>d", "spm", None)]
    df = spark.createDataFrame(rows, "id int, output string, form string, extra string").coalesce(1)
    got = {r.id: (r.restored, r.extra) for r in infill.restore(df).collect()}
    assert got == {1: (None, "x"), 2: ("", "y"), 3: ("abdc", "z"), 4: ("cdab", None)}
    for broken in ("<P>ab<S>c", "<S>a<P>b<M>c", "x<P>a<S>b<M>c"):
        with pytest.raises(Exception, match="marks of its form"):
            infill.restore(spark.createDataFrame([(broken, "psm")], "output string, form string")).collect()


def test_columns_with_names_of_the_operator(spark):
    clash = "cuts string, first string, second string, form string, output string, n string, text_ string"
    df = spark.createDataFrame([(1, prose(1, 30), *"abcdefg")], f"doc_id bigint, text string, {clash}")
    row = infill.fill_in_middle(df).first()
    assert (row.doc.form, row.doc.output, row.doc.n) == ("d", "e", "f") and row.output == plainly(1, row.doc.text)[4]
    assert ODD_COLUMNS  # the documents of the other tests carry those
