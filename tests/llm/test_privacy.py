import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glebe.llm import privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1@.+- (5)_é\n0", max_size=60))
def test_spans_are_those_of_the_plain_patterns(text):
    assert privacy.personal_spans(text) == plain_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x@y", "@", ".d", "1.2.3.4", "1.2.3", ".5", "256.1.1.1", "4111 1111 1111 1111", "-1", "+1 (555) 010-9999", "+", " ", "é",
                                 "4111111111111111", "007.1.1.1"]), max_size=14))
def test_spans_of_pieces_run_together(parts):
    assert privacy.personal_spans("".join(parts)) == plain_spans("".join(parts))


def test_very_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1 " * 200_000, "a@" * 100_000, "+1" * 100_000, "a" * 300_000 + "@", "1.1." * 50_000):
        privacy.personal_spans(text)


def corpus(spark):
    rows = [(i, f"filler w{i} meet Zorblax, at zor@x.com about item{i} today") for i in range(8)]
    rows += [(100 + i, f"so Zorblax; thing{i}") for i in range(3)]
    rows += [(200 + i, f"meet us today about filler at something {i}") for i in range(50)]
    rows += [(300, None), (301, ""), (302, "only other@y.org here")]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def test_terms_that_disclose_a_value_are_found_everywhere(spark):
    spans = {r.doc_id: r.s for r in privacy.all_spans(corpus(spark), ["doc_id"]).select(
        "doc.doc_id", privacy.spans_text(F.col("spans")).alias("s")).collect()}
    assert len(spans) == 64
    assert all(spans[i] == "term:15:23,email:27:36" for i in range(8))
    assert all(spans[100 + i] == "term:3:11" for i in range(3))
    assert spans[302] == "email:5:16"
    assert all(spans[i] == "" for i in spans if i >= 200 and i != 302)


def test_support_and_threshold(spark):
    few = corpus(spark).filter("doc_id not between 4 and 99")
    assert all("term" not in r.s for r in privacy.all_spans(few, ["doc_id"]).select(
        privacy.spans_text(F.col("spans")).alias("s")).collect())
    # In 8 of 11 texts the term stands with the value.
    strict = privacy.all_spans(corpus(spark), ["doc_id"], disclosure=0.8)
    assert all("term" not in r.s for r in strict.select(privacy.spans_text(F.col("spans")).alias("s")).collect())


def plainly_disclosing(texts, disclosure, value_z, kind_z):
    """{(term, entity)} by counting different texts one by one."""

    def least(hits, of, z):
        p = hits / of
        return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)

    having, together, values = Counter(), Counter(), Counter()
    for text in {t or "" for t in texts}:
        spans = plain_spans(text)
        words = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]

        def term(m):
            return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group().strip(".,;:!?()[]{}<>\"'"))

        having.update({term(m) for m in words} - {""})
        if spans:
            free = {term(m) for m in words if not any(s < m.end() and m.start() < e for _, s, e in spans)} - {""}
            held = {f"{k}:{text[s:e].lower()}" for k, s, e in spans}
            values.update(held)
            together.update((t, entity) for t in free for entity in held | {k for k, _, _ in spans} | {"any"})
    return {(t, entity) for (t, entity), n in together.items() if (":" not in entity or values[entity] > 1)
            and least(n, having[t], value_z if ":" in entity else kind_z) >= disclosure}


def test_terms_equal_plain_counts(spark, odd_docs):
    rng = random.Random(7)
    values = ["zor@x.com", "1.2.3.4", "+1 (555) 010-9999", "4111 1111 1111 1111", "a.b@example.org"]
    texts = [None, ""] + [r.text for r in odd_docs.collect()]
    for i in range(400):
        words = [f"w{rng.randrange(60) if rng.random() < 0.8 else rng.randrange(3000)}" for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.3:
            v = rng.randrange(5)
            words[rng.randrange(len(words))] = values[v] + rng.choice(["", ",", "x"])
            words.append(f"Name{v}." if rng.random() < 0.8 else "other")
        texts += [" ".join(words)] * rng.choice([1, 1, 1, 2, 30])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(5)
    for disclosure in (0.3, 0.5, 0.8):
        got = privacy.disclosing_terms(privacy.find_personal(docs, ["doc_id"]), docs, disclosure=disclosure)
        wanted = plainly_disclosing(texts, disclosure, privacy.VALUE_Z, privacy.KIND_Z)
        assert {(r.term, r.entity) for r in got.collect()} == wanted
        assert wanted or disclosure == 0.8


def test_copies_count_once(spark):
    rows = [(i, "filler Zorblax, at zor@x.com") for i in range(40)] + [(99, "Zorblax is nice")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert all("term" not in r.s for r in privacy.all_spans(docs, ["doc_id"]).select(
        privacy.spans_text(F.col("spans")).alias("s")).collect())


def test_sanitised_texts(spark):
    out = {r.doc_id: r.text for r in privacy.sanitise(corpus(spark)).collect()}
    assert out[0] == "filler w0 meet [...] at [email] about item0 today"
    assert out[100] == "so [...] thing0" and out[300] is None and out[301] == ""
    assert out[200] == "meet us today about filler at something 0"
    plain = privacy.sanitise(corpus(spark), labels={"email": "", "term": ""}).filter("doc_id = 0").first().text
    assert plain == "filler w0 meet  at  about item0 today"


def test_odd_and_no_documents(odd_docs, no_docs):
    clean = privacy.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns and clean.schema == odd_docs.schema
    texts = {(r.doc_id, r.row): r.text for r in clean.collect()}
    before = {(r.doc_id, r.row): r.text for r in odd_docs.collect()}
    assert {k for k in texts if texts[k] != before[k]} == {(10, None)}
    assert texts[(10, None)].endswith("mail me: [email] or [phone]")
    assert privacy.all_spans(odd_docs, ["doc_id"]).count() == odd_docs.count()
    assert privacy.sanitise(no_docs).count() == 0
