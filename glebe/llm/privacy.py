"""Personal data and information-theoretic sanitisation.

Personal data are found by their form. Which further terms reveal them is told from the corpus, by co-occurrence in whole
texts: a term that stands in several different texts with a protected entity, and hardly ever without it, discloses that
entity. Entities are the protected values themselves, their kinds, and personal data of any kind. With P(entity | term) =
texts with both / texts with the term, the pointwise mutual information of term and entity is log2 P(entity | term) -
log2 P(entity), that is the entity's information content less the log2 of 1 / P(entity | term). A term discloses the entity
if at most a fraction of the entity's information stays hidden, that is if P(entity | term) reaches the threshold. Rare
terms tell P badly, so its lower confidence bound has to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.llm.common import in_batches, rows_of, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Least share of the texts with a term that hold the entity.
DISCLOSURE = 0.5
#: Normal quantiles of the lower bound of that share. Of a value 90 %, so that two texts of two suffice; kinds are common
#: and meet many terms by chance, so theirs is 99 %, for which it takes six of six.
VALUE_Z, KIND_Z = 1.28, 2.33
#: Terms that a task counts before it passes the counts on.
_HELD_TERMS = 200_000
#: Groups of terms whose counts travel packed; a group is added up by one task.
_BUCKETS = 1024
#: Bits of the Bloom filter that preselects words: 256 KB at any size. Overfull, it only passes more words to the join.
FILTER_BITS = 21
_SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digit runs are taken whole, so these never try a run again from its middle.
_MAY_BE_IP = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKS = b".,;:!?()[]{}<>\"'"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def personal_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of emails, IP addresses, card and phone numbers, by start, then kind as listed.

    Per kind the leftmost matches that do not overlap; a match that fails its check is dropped. Offsets count code
    points; the end is exclusive. Kinds may overlap one another.
    """
    found = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    if _MAY_BE_IP.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) 
                  if all(_at_most_255(p) for p in m.group().split("."))]
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = [int(c) for c in match.group() if c not in " -"]
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *match.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _emails(text: str):
    """Spans of addresses: for each @ the longest local part before it and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def _at_most_255(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def _luhn(digits: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct terms of a text; words that touch a span are none."""
    found, at = set(), 0
    ordered = sorted((start, end) for _, start, end in spans)
    for m in _WORD.finditer(text):
        while at < len(ordered) and ordered[at][1] <= m.start():
            at += 1
        if all(start >= m.end() or end <= m.start() for start, end in ordered[at:at + len(KINDS)]):
            found.add(_term(m.group()))
    return sorted(found - {""})


def _term(word: str) -> str:
    """A word without the marks around it, A-Z lower-cased."""
    return word.encode().strip(_MARKS).lower().decode()


def find_personal(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """(doc, mark, base, values, terms): per row its carried columns, a digest of its text, the spans found by form, their
    distinct values as kind:value, and, where there are any, all terms of the text.

    A null text has none. Rows are handled one by one, whatever their ids.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in carry))
    kind = docs.select(doc.alias("doc")).schema[0].dataType

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            base, values, terms = [], [], []
            for text in batch.column("text").to_pylist():
                spans = personal_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                values.append(sorted({f"{k}:{text[s:e].lower()}" for k, s, e in spans}))
                terms.append(_terms(text, spans) if spans else [])
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array(base, _spans_type()), pa.array(values, lists), pa.array(terms, lists)],
                ["doc", "mark", "base", "values", "terms"])

    text = text_or_empty(text_col)
    schema = T.StructType([T.StructField("doc", kind), T.StructField("mark", T.StringType())])
    for name, form in (("base", _SPANS), ("values", "array<string>"), ("terms", "array<string>")):
        schema.add(name, T.DataType.fromDDL(form))
    return in_batches(docs.select(doc.alias("doc"), F.md5(text).alias("mark"), text.alias("text")), found, schema)


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE,
                     value_z: float = VALUE_Z, kind_z: float = KIND_Z) -> DataFrame:
    """Staged (term, entity): terms that disclose an entity, by exact counts of different texts over the whole corpus.

    Entities are values ("kind:value"), kinds, and "any". Copies of one text count once, in the texts that hold term and
    entity and in those that hold the term.
    """
    texts = stage(found.filter(F.size("values") > 0).select("mark", "values", "terms").dropDuplicates(["mark"]), "personal-texts")
    # A value of one text cannot be told from the text's other words.
    shared = texts.select(F.explode("values").alias("entity")).groupBy("entity").count().filter("count > 1").select("entity")
    of_values = texts.select("terms", F.explode("values").alias("entity")).join(shared, "entity").select(
        "entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count("*").alias("together"))
    holds = [F.exists("values", _is_a(kind)).alias(kind) for kind in KINDS]
    sums = [F.struct(F.lit(kind).alias("entity"), F.count_if(kind).alias("together")) for kind in KINDS]
    of_kinds = texts.select(*holds, F.explode("terms").alias("term")).groupBy("term").agg(F.array(
        *sums, F.struct(F.lit("any").alias("entity"), F.count("*").alias("together"))).alias("sums"))
    # What even a term without other texts could not reach is out before texts are read.
    together = of_kinds.select("term", F.inline("sums")).withColumn("z", F.lit(kind_z)).unionByName(
        of_values.withColumn("z", F.lit(value_z))).filter(_least_share(F.col("together"), F.col("together"), F.col("z")) >= disclosure)
    together = stage(together, "together")
    held = text_frequencies(docs, together.select("term").distinct(), found, text_col)
    told = together.join(held, "term").filter(_least_share(F.col("together"), F.col("texts"), F.col("z")) >= disclosure)
    return stage(told.select("term", "entity"), "disclosing")


def _is_a(kind: str):
    return lambda value: value.startswith(f"{kind}:")


def _least_share(hits: Column, of: Column, z: Column) -> Column:
    """The lower bound of a share by Wilson's interval; that of nothing is 0."""
    of, zz = F.greatest(of, F.lit(1)), z * z
    share = hits / of
    spread = z * F.sqrt(share * (1 - share) / of + zz / (4 * of * of))
    return (share + zz / (2 * of) - spread) / (1 + zz / of)


def text_frequencies(docs: DataFrame, terms: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, texts): in how many different texts each of the terms stands; ``found`` has the digests of all texts.

    Texts are not shuffled. Tasks count terms in texts that occur once; texts that a Bloom filter of the digests of copies
    passes hand on their terms, and are counted after their copies are dropped.
    """
    bits = _bloom(terms, "term")
    if not bits:
        return docs.sparkSession.createDataFrame([], "term string, texts bigint")
    copied = _bloom(found.groupBy("mark").count().filter("count > 1"), "mark")

    def counted(batches):
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa

        lists = pa.list_(pa.string())
        shape = (pa.string(), pa.int32(), lists, pa.list_(pa.int64()))

        def rows(out):
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape, strict=True)], ["mark", "bucket", "terms", "n"])

        def packed(counts):
            dealt: dict[int, list] = {}
            for item in counts.items():
                dealt.setdefault(crc32(item[0].encode()) % _BUCKETS, []).append(item)
            return rows([(None, bucket, *zip(*items, strict=True)) for bucket, items in dealt.items()])

        counts, seen = Counter(), set()
        for batch in batches:
            out = []
            texts = [(mark, text.encode().split()) for text, mark in rows_of(batch, "text", "mark")]
            passing = _passing(set().union(*(words for _, words in texts)), bits)
            for mark, words in texts:
                hits = {passing[word] for word in passing.keys() & words}
                if not _holds(copied, mark.encode()):
                    counts.update(hits)
                elif hits and mark not in seen:
                    if len(seen) < _HELD_TERMS:
                        seen.add(mark)
                    out.append((mark, None, sorted(hits), None))
            yield rows(out)
            if len(counts) > _HELD_TERMS:
                yield packed(counts)
                counts = Counter()
        yield packed(counts)

    def summed(table):
        from collections import Counter

        import pyarrow as pa

        counts = Counter()
        for terms_, n in rows_of(table, "terms", "n"):
            for term, times in zip(terms_, n, strict=True):
                counts[term] += times
        return pa.table([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "texts"])

    text = text_or_empty(text_col)
    told = stage(in_batches(docs.select(text.alias("text"), F.md5(text).alias("mark")), counted,
                            "mark string, bucket int, terms array<string>, n array<bigint>"), "frequencies")
    once = told.filter("mark is null").groupBy("bucket").applyInArrow(summed, "term string, texts bigint")
    copies = told.filter("mark is not null").dropDuplicates(["mark"]).select(
        F.explode("terms").alias("term"), F.lit(1).cast("bigint").alias("texts"))
    return once.unionAll(copies).groupBy("term").agg(F.sum("texts").alias("texts")).join(terms, "term", "left_semi")


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, mark, places): where each of the terms stands in which text, without a shuffle of texts.

    Words pass a Bloom filter of the terms, and what passes is joined with the terms themselves.
    """
    bits = _bloom(terms, "term")
    shape = "term string, mark string, places array<struct<start:int,end:int>>"
    if not bits:
        return docs.sparkSession.createDataFrame([], shape)

    def holding(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            texts = [(text, mark, text.encode().split()) for text, mark in rows_of(batch, "text", "mark")]
            passing = _passing(set().union(*(words for _, _, words in texts)), bits)
            for text, mark, words in texts:
                hits = passing.keys() & words
                places: dict[str, list] = {}
                for m in _WORD.finditer(text) if hits else ():
                    if (word := m.group().encode()) in hits:
                        places.setdefault(passing[word], []).append({"start": m.start(), "end": m.end()})
                out += [(term, mark, at) for term, at in places.items()]
            columns = zip(*out, strict=True) if out else ((), (), ())
            types = (pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["term", "mark", "places"])

    text = text_or_empty(text_col)
    hits = in_batches(docs.select(text.alias("text"), F.md5(text).alias("mark")), holding, shape)
    return hits.join(terms, "term", "left_semi")


def _bloom(rows: DataFrame, column: str) -> bytes:
    """A Bloom filter of a column, empty if there are no rows; at most 2^FILTER_BITS / 8 bytes come to the driver."""
    hashed = rows.select(F.xxhash64(column).alias("h"))
    mask = F.lit((1 << FILTER_BITS) - 1)
    places = hashed.select(F.explode(F.array(*(
        F.shiftrightunsigned("h", i * FILTER_BITS).bitwiseAND(mask) for i in range(3)))).alias("at"))
    found = places.groupBy(F.shiftright("at", 3).alias("byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("bits")).collect()
    bits = bytearray((1 << FILTER_BITS) // 8 if found else 0)
    for r in found:
        bits[r.byte] = r.bits
    return bytes(bits)


def _holds(bits: bytes, key: bytes) -> bool:
    """Whether a Bloom filter may hold a text."""
    from xxhash import xxh64_intdigest

    h, mask = xxh64_intdigest(key, 42), (1 << FILTER_BITS) - 1
    places = (h & mask, (h >> FILTER_BITS) & mask, (h >> 2 * FILTER_BITS) & mask)
    return bool(bits) and all(bits[at >> 3] >> (at & 7) & 1 for at in places)


def _passing(found: set[bytes], bits: bytes) -> dict[bytes, str]:
    """The words whose term the Bloom filter holds, with the term."""
    terms = {word: word.strip(_MARKS).lower() for word in found}
    return {word: term.decode() for word, term in terms.items() if term and _holds(bits, term)}


def all_spans(docs: DataFrame, carry: list[str], text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc, base, spans): per row its carried columns, the spans found by form, and all spans.

    ``spans`` adds to ``base`` every place of a disclosing term, in whichever text it stands, as kind "term"; both
    are sorted by start, then kind. Texts are not shuffled: added spans are joined by the digest of the text.
    """
    found = stage(find_personal(docs, carry, text_col), "personal")
    terms = disclosing_terms(found, docs, text_col, disclosure).select("term").distinct()
    places = term_spans(docs, terms, text_col).select("mark", F.explode("places").alias("at"))
    spans = places.select("mark", F.struct(F.lit("term").alias("kind"), "at.start", "at.end").alias("span")).distinct()
    # Staged, so that Spark knows its size: the rows that carry texts are only shuffled if it is large.
    added = stage(spans.groupBy("mark").agg(F.collect_list("span").alias("added")), "added")
    both = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    ordered = F.array_sort(both, lambda a, b: F.coalesce(
        F.nullif(F.signum(a.start - b.start), F.lit(0.0)), F.signum(_rank(a.kind) - _rank(b.kind))).cast("int"))
    return found.join(added, "mark", "left").select("doc", "base", ordered.alias("spans"))


def _rank(kind):
    return F.array_position(F.array(*(F.lit(k) for k in (*KINDS, "term"))), kind)


def _spans_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def sanitise(docs: DataFrame, text_col: str = "text", labels: dict[str, str] | None = None,
             disclosure: float = DISCLOSURE) -> DataFrame:
    """The rows with personal data generalised to a label of their kind and disclosing terms removed.

    ``labels`` gives the text put in place of each kind; an empty one removes. Spans that overlap become the label
    of the first. Columns are those of the input; a null text stays null, and a text without spans stays as it is.
    """
    put = {**{kind: f"[{kind}]" for kind in KINDS}, "term": "[...]", **(labels or {})}
    columns = docs.columns
    spans = all_spans(docs, columns, text_col, disclosure)
    schema = spans.select("doc").schema[0].dataType

    def cleaned(batches):
        import pyarrow as pa

        for batch in batches:
            doc = batch.column("doc")
            texts = []
            for text, found in rows_of(batch, "text", "spans"):
                if not found:
                    texts.append(text)
                    continue
                parts, done = [], 0
                for span in found:
                    if span["start"] >= done:
                        parts += [text[done:span["start"]], put[span["kind"]]]
                    done = max(done, span["end"])
                texts.append("".join([*parts, text[done:]]))
            fields = [pa.array(texts, f.type) if f.name == text_col else doc.field(i)
                      for i, f in enumerate(doc.type)]
            yield pa.RecordBatch.from_arrays(fields, [f.name for f in doc.type])

    return in_batches(spans.select("doc", F.col(f"doc.{text_col}").alias("text"), "spans"), cleaned, schema)


def spans_text(spans) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
