import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glebe.sources import archives, landing

MARK = b"PK\x03\x04"


class Pipe(io.RawIOBase):
    """A target that cannot seek, so that sizes follow the members."""

    def __init__(self):
        self.data = b""

    def writable(self):
        return True

    def write(self, part):
        self.data += bytes(part)
        return len(part)


def table(draw, n):
    cells = ["x", "é", '"a;b"', '"two\nlines"', f'"{MARK.decode()}"', ""]
    return "annee;produit\n" + "".join(f"{i};{draw.choice(cells)}\n" for i in range(n))


def archive_files(draw):
    def packed(members, method=zipfile.ZIP_DEFLATED, target=None, comment=b""):
        target = target or io.BytesIO()
        with zipfile.ZipFile(target, "w", method) as z:
            z.comment = comment
            for name, body in members:
                z.writestr(name, body)
        return target.data if isinstance(target, Pipe) else target.getvalue()

    members = [(f"m{i}.csv", table(draw, draw.randrange(40))) for i in range(5)]
    inner = packed(members[:2])
    large = io.BytesIO()
    with zipfile.ZipFile(large, "w", zipfile.ZIP_DEFLATED) as z, z.open("l.csv", "w", force_zip64=True) as stream:
        stream.write(table(draw, 30).encode())
    damaged = bytearray(packed(members))
    damaged[len(damaged) // 3] ^= 0xFF
    return {
        "deflated": packed([*members, ("read.txt", "x"), ("last.CSV", "annee;produit\n1;z\n")]),
        "stored": packed(members, zipfile.ZIP_STORED), "streamed": packed(members, target=Pipe()),
        "nested": packed([("in.zip", inner), *members[:2], ("in2.zip", inner)], zipfile.ZIP_STORED),
        "prefix": b"#!/bin/sh\n" + MARK + b" junk" + packed(members), "comment": packed(members, comment=b"said so"),
        "large": large.getvalue(), "names": packed([(MARK.decode() + "a.csv", "annee;produit\n1;y\n"), *members]),
        "damaged": bytes(damaged), "short": packed(members)[:-30], "none": packed([("read.txt", "x")]), "no members": packed([]),
        "empty": b"", "text": b"no archive", "mark alone": MARK, "end alone": b"PK\x05\x06",
    }


@pytest.mark.parametrize("size", [37, 1 << 20])
def test_members_at_any_split(spark, tmp_path, size):
    """Members of files cut at any byte, as archives that are held whole give them."""
    for name, data in archive_files(random.Random(3)).items():
        (tmp_path / name).write_bytes(data)
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    dialect = landing.QUOTE_DIALECT

    def found(frame):
        def of(row):
            # Both ways refuse the damaged member; the words differ.
            return (row.path.rsplit("/", 1)[1].replace("%20", " "), row.member or "", row.entete, row.cellules,
                    row.error and row.member is None and row.error, row.error is not None)
        return sorted(map(of, frame.collect()), key=repr)

    want = found(archives.unpack(whole, dialect))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = found(archives.unpack_files(spark, str(tmp_path), dialect))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r[0] for r in want} >= {"deflated", "nested", "large", "names", "text"}
    assert got == want


def test_members_of_one_archive_run_in_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(40):
            z.writestr(f"m{i}.csv", "annee;produit\n" + "".join(f"{j};p{i}\n" for j in range(50)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = archives.unpack_files(spark, str(tmp_path / "a.zip"), landing.QUOTE_DIALECT)
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("member").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1 and sum(t.n for t in tasks) == 40
