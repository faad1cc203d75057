import random

from llm_texts import prose

from glebe.llm import chunks


def spans_of(frame):
    return [r.asDict() for r in chunks.repeated_spans(chunks.numbered(frame, "doc_id", "text")).collect()]


def plain_chunks(texts):
    """(row, id, start, end, words, first rows) of runs of repeated chunks, rows in order."""
    seen, out = {}, []
    for row, (i, text) in enumerate(texts):
        data = (text or "").encode()
        (cuts,), _, _ = chunks.cut_texts([data])
        assert cuts[0] == 0 and cuts[-1] == len(data) and cuts == sorted(set(cuts))
        run, own = None, set()
        for a, b in zip(cuts, cuts[1:]):
            piece = data[a:b]
            first = seen.get(piece) if piece not in own else i
            own.add(piece)
            if first is None:
                run = None
                continue
            start, end = len(data[:a].decode()), len(data[:b].decode())
            if run is None:
                run = {"id": i, "start": start, "words": 0, "first_ids": set()}
                out.append(run)
            run["end"] = end
            run["words"] += len(piece.split())
            run["first_ids"].add(first)
        for piece in own:
            seen.setdefault(piece, i)
    return [r for r in out if r["words"] >= chunks.LEAST_WORDS]


def corpus():
    rng = random.Random(2)
    passages = [prose(1000 + i, 60) for i in range(5)]
    texts = []
    for i in range(60):
        words = prose(i, rng.randrange(30, 300))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words = words[:at] + " " + passages[i % 5] + " " + words[at:]
        texts.append((i, words))
    texts += [(100, texts[1][1]), (101, "ünï " * 200), (102, None), (103, ""), (104, prose(7, 3)), (105, "x" * 3000), (106, "é" * 3000 + " " + texts[3][1])]
    return texts


def test_spans_match_plain_chunks(spark):
    texts = corpus()
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    got = sorted((s["id"], s["start"], s["end"], s["words"], tuple(s["first_ids"])) for s in spans_of(frame))
    wanted = sorted((s["id"], s["start"], s["end"], s["words"], tuple(sorted(s["first_ids"]))) for s in plain_chunks(texts))
    assert got == wanted and wanted


def test_passages_are_caught_and_clean_texts_left_alone(spark):
    texts = corpus()
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    spans = spans_of(frame)
    caught = {s["id"] for s in spans} | {i for s in spans for i in s["first_ids"]}
    planted = {i for i in range(60) if i % 3 == 0} | {1, 100, 101, 106, 3}
    assert caught == planted


def test_cuts_do_not_hang_on_neighbours_and_resist_insertions():
    a, b = prose(1, 400).encode(), prose(2, 400).encode()
    alone = chunks.cut_texts([a])[0][0]
    assert chunks.cut_texts([b, a, b"", a])[0] == [chunks.cut_texts([b])[0][0], alone, [0], alone]
    pieces = {a[x:y] for x, y in zip(alone, alone[1:])}
    moved = a[:500] + b"inserted words here " + a[500:]
    cuts = chunks.cut_texts([moved])[0][0]
    changed = [moved[x:y] for x, y in zip(cuts, cuts[1:]) if moved[x:y] not in pieces]
    assert sum(map(len, changed)) < 400


def test_a_chunk_of_a_third_of_all_rows(spark):
    common = prose(7777, 40)
    rows = [(i, prose(i, 50) + " " + common + " " + prose(500 + i, 20)) if i % 3 == 0 else (i, prose(i, 50)) for i in range(300)]
    spans = spans_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6))
    assert len({s["id"] for s in spans}) == 99 and all(s["words"] <= 45 for s in spans)


def test_texts_without_their_repeats(spark, odd_docs, no_docs):
    p = prose(40, 80)
    rows = spark.createDataFrame([(1, p), (2, "start " + p + " end"), (3, None), (4, p)], "doc_id int, text string").coalesce(1)
    out = {r.doc_id: r.text for r in chunks.drop_repeats(rows).collect()}
    assert out[1] == p and out[3] is None and out[4] == ""
    assert out[2].startswith("start ") and out[2].endswith("end") and len(out[2]) < 0.5 * len(p)
    odd = chunks.drop_repeats(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    assert chunks.drop_repeats(no_docs).count() == 0 and spans_of(no_docs) == []


def passages_of(texts, spark):
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    return {r.id: r for r in chunks.repeated_passages(chunks.numbered(frame, "doc_id", "text")).collect()}


def test_short_passages_are_found_whole(spark):
    planted = {1000 + i: prose(5000 + i, 51) for i in range(60)}
    texts = [(i - 1000, prose(i, 30) + " <" + p + "> " + prose(i + 100, 30)) for i, p in planted.items()]
    texts += [(i, prose(i + 7000, 40) + " (" + p + ") " + prose(i + 8000, 40)) for i, p in planted.items()]
    got, of = passages_of(texts, spark), dict(texts)
    assert sorted(got) == sorted(planted)
    for i, span in got.items():
        covered = of[i][span.start:span.end].split()
        # The words at both ends differ by their bracket and stay; all between are in the span.
        assert covered == planted[i].split()[1:-1] and span.words == 49 and span.first_ids == [i - 1000]


def test_passages_grow_past_a_chunk_of_another_text(spark):
    common, passage = prose(1, 8), prose(2, 60)
    whole = passage[:150] + " " + common + " " + passage[150:]
    texts = [(0, prose(3, 20) + " " + common + " " + prose(4, 20)), (1, prose(5, 20) + " " + whole + " " + prose(6, 20)),
             (2, prose(7, 20) + " " + whole + " " + prose(8, 20))]
    span = passages_of(texts, spark)[2]
    at = texts[2][1].index(whole)
    assert at - 2 <= span.start <= at and at + len(whole) <= span.end <= at + len(whole) + 2


def test_texts_without_white_space(spark):
    rng = random.Random(3)
    glyphs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = glyphs(150)
    texts = [(1, glyphs(400) + passage + glyphs(300)), (2, glyphs(133) + passage + glyphs(90)), (3, glyphs(500))]
    got = passages_of(texts, spark)
    assert list(got) == [2] and (got[2].start, got[2].end) == (133, 283) and got[2].words >= 16


def test_matches_beyond_the_first_reach(spark, monkeypatch):
    monkeypatch.setattr(chunks, "REACH", 3)
    p = prose(11, 60)
    texts = [(1, "start " + p + " end"), (2, "other words " + p + " more")]
    span = passages_of(texts, spark)[2]
    assert texts[1][1][span.start:span.end].strip() == p
