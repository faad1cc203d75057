import re

import pytest
from llm_texts import prose

from glebe.llm import quality
from glebe.llm.quality import Condition, Rule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    texts += ["a\n a\na\n\n\x0b\n \nb", "ab cd " * 300, "x y z " * 3, " ".join(map(str, range(8))) + " q " + " ".join(map(str, range(8))),
              "😀 # é&<", "\x1f\x85 \xa0a", prose(1, 50) + "\n" + prose(1, 50) + " " + prose(2, 9)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in quality.text_statistics(frame).select("doc.i", *OWN).collect()}
    assert got == {i: plain_statistics(t) for i, t in enumerate(texts)}


def labelled_docs(spark, extra=0):
    rows, labels = [], []
    for i in range(400):
        text = prose(i, 60)
        if i % 5 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 5 == 1:
            text = " ".join(w + " the the" for w in text.split())
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(i % 5 > 1), 0))
        elif i % 10 == 0:
            labels.append((i, 0, 0))
    rows += [(1000, None), (1001, ""), (1002, "short text")]
    labels += [(None, 1, 0), (3, None, 0), (7, 1, 1), (1000, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_rules_generalise_to_unlabelled_documents(spark):
    docs, labels = labelled_docs(spark)
    judged, rules = quality.judge(docs, labels)
    assert 1 <= len(rules) <= 3
    kept = {r.doc_id: r.kept for r in judged.select("doc.doc_id", "kept").collect()}
    assert all(kept[i] == (i % 5 > 1) for i in range(400))
    assert not any(kept[i] for i in (1000, 1001, 1002))
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == sum(kept.values())


def test_without_usable_labels_only_the_base_rules_hold(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one_kind = spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one_kind):
        judged, rules = quality.judge(odd_docs, labels)
        assert rules == []
        kept = [(r.text, r.kept) for r in judged.select("doc.text", "kept").collect()]
        for text, ok in kept:
            n, _, _, _, repeated = plain_statistics(text)
            assert ok == (n >= 20 and 100 * repeated <= 30 * n)
    assert quality.keep_good(odd_docs, none).columns == odd_docs.columns
    assert quality.keep_good(no_docs, one_kind).count() == 0


def test_verdict_is_one_expression_in_order(spark):
    rules = [Rule((Condition("symbols_per_word", False, 0.5), Condition("n_words", True, 100.0))), Rule((Condition("mean_word_chars", False, 9.0),))]
    assert str(rules[0]) == "symbols_per_word > 0.5 and n_words <= 100"
    frame = spark.createDataFrame([(50, 0, 1.0, 4.0), (500, 0, 1.0, 4.0), (500, 0, 0.0, 9.5), (5, 0, 0.0, 4.0)],
                                  "n_words int, n_repeat_words int, symbols_per_word double, mean_word_chars double")
    assert [r[0] for r in frame.select(quality.verdict(rules)).collect()] == [False, True, False, False]


def test_noise_is_pruned(spark):
    """Labels without any relation to the text give no rule."""
    docs = spark.createDataFrame([(i, prose(i, 40 + i % 30)) for i in range(300)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int((i * 7919) % 13 > 4), 0) for i in range(300)], "doc_id int, quality int, toxic int")
    assert quality.judge(docs, labels)[1] == []


@pytest.mark.parametrize("operator", ["statistics", "verdict"])
def test_no_python_in_the_plan(spark, operator):
    docs, labels = labelled_docs(spark)
    frame = quality.text_statistics(docs) if operator == "statistics" else quality.judge(docs, labels)[0]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_mixed_kind_does_not_end_the_learning(spark):
    """Long texts are mostly of low quality, but not enough for a rule; texts full of marks are all."""
    rows = [(i, prose(i, 150 + i % 40)) for i in range(300)] + [(1000 + i, prose(i, 40 + i % 9)) for i in range(300)]
    rows += [(2000 + i, " ".join(w + "##" for w in prose(i, 45).split())) for i in range(100)]
    labels = [(i, int(i % 20 < 3 if i < 300 else i < 2000), 0) for i, _ in rows if i % 3]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    judged, _ = quality.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in judged.select("doc.doc_id", "kept").collect()}
    assert not any(kept[2000 + i] for i in range(100))
    assert sum(kept[1000 + i] for i in range(300)) >= 290


def test_many_kinds_are_all_learned(spark):
    """More kinds of low quality than a dozen, each a band of word counts that no other rule reaches."""
    rows, labels = [], []
    for i in range(2400):
        band = i % 32
        rows.append((i, prose(i, 30 + 12 * band)))
        labels.append((i, int(band % 2 == 0), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    judged, rules = quality.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert len(rules) > 12
    right = sum(r.kept == (r.doc_id % 2 == 0) for r in judged.select("doc.doc_id", "kept").collect())
    assert right >= 0.95 * 2400
