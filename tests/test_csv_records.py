import csv
import io
import itertools
import random

import pytest
from pyspark.sql import functions as F

from glebe.sources import csv_records, landing
from helpers import rows

CELLS = ["", "a", "5\" pipe", "x;y", "two\nlines", "say \"so\"", "\"", "\n", "\"\n\"", ";\n;", "\n\n\n", "é"]


def written(rows, separator=";"):
    out = io.StringIO()
    csv.writer(out, delimiter=separator, lineterminator="\n").writerows(rows)
    return out.getvalue()


def test_records_at_all_block_borders(spark):
    """One to three borders between any lines of a text, and a border at each line."""
    draw = random.Random(5)
    table = [["k", "v", "w"]] + [[f"r{i}", draw.choice(CELLS), draw.choice(CELLS)] for i in range(7)]
    lines = written(table).split("\n")[:-1]
    assert len(lines) > len(table)
    cuts = [c for n in range(4) for c in itertools.combinations(range(1, len(lines)), n)] + [tuple(range(1, len(lines)))]
    rows = []
    for number, cut in enumerate(cuts):
        # Blocks far apart and line numbers that rise within a block only, as those of a scan do.
        for i, value in enumerate(lines):
            block = sum(i >= c for c in cut)
            rows.append((f"f{number}", "f", block * 1000, (7 - block) * 10_000 + i, value))
    given = spark.createDataFrame(rows, "path string, name string, block long, line long, value string").repartition(5)
    records = csv_records.csv_records(given, ";")
    heads = records.filter("first").groupBy("value").count().collect()
    assert [(r.value, r["count"]) for r in heads] == [(lines[0], len(cuts))]
    got = records.groupBy("value").agg(F.count_distinct("path").alias("files"), F.count("*").alias("n")).collect()
    want = [[*r] for r in csv.reader(io.StringIO("\n".join(lines), newline=""), delimiter=";")]
    assert sorted(next(csv.reader(io.StringIO(r.value, newline=""), delimiter=";")) for r in got) == sorted(want)
    assert all(r.files == len(cuts) and r.n == len(cuts) for r in got)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_same_rows_as_a_reader_of_whole_files(spark, tmp_path, small_splits):
    """Any text of quotes, separators and breaks, also such that no writer would leave. The files end without a line end:
    in a cell that is never closed, that reader keeps it and this one does not."""
    draw = random.Random(11)
    for i in range(60):
        body = "".join(draw.choice('aab;;""\n') for _ in range(draw.choice([3, 40, 300])))
        (tmp_path / f"f{i:02}.csv").write_text("k;v;w\n" + body + "z")
    (tmp_path / "empty.csv").write_text("")
    files = str(tmp_path / "*.csv")
    schema = "k string, v string, w string"
    whole = (spark.read.schema(schema).option("header", True).option("sep", ";").option("escape", '"')
             .option("multiLine", True).csv(files).select("*", F.col("_metadata.file_name").alias("_name")))
    lines = csv_records.file_lines(spark, [files], "UTF-8")
    assert lines.select("path", "block").distinct().count() > 150
    split = csv_records.parsed_records(csv_records.csv_records(lines, ";"), schema, ";").drop("_file")

    def listed(frame):
        return sorted((tuple(r) for r in frame.collect()), key=repr)

    assert listed(split) == listed(whole)


def test_one_file_is_shared_by_many_tasks(spark, tmp_path, small_splits):
    table = [["annee", "produit", "marche"]] + [["2024", f"CHOU\n{i}", "LY\"ON"] for i in range(300)]
    text = written(table, ",").replace("\n", "\r\n")
    (tmp_path / "rnm_2024.csv").write_bytes(text.encode("utf-8"))
    manifest = landing.quote_manifest(spark, str(tmp_path / "*.csv"))
    assert manifest.first().coupe
    quotes = landing.read_quotes(spark, manifest)
    assert sorted(r.produit for r in quotes.collect()) == sorted(f"CHOU\n{i}" for i in range(300))
    assert {r.marche for r in quotes.select("marche").distinct().collect()} == {"LY\"ON"}
    lines = csv_records.file_lines(spark, [str(tmp_path / "rnm_2024.csv")], "UTF-8")
    assert lines.select(F.spark_partition_id()).distinct().count() > 50


def test_long_cells_and_lines(spark):
    rows = [("f", "f", 0, 0, "k;v"), ("f", "f", 0, 1, '"' + 'x""' * 200_000), ("f", "f", 9, 2, ";" * 200_000),
            ("f", "f", 9, 3, 'y";z'), ("f", "f", 9, 4, ";" * 200_000), ("f", "f", 9, 5, '"a";' * 50_000 + '"open'),
            ("f", "f", 20, 6, "never closed")]
    given = spark.createDataFrame(rows, "path string, name string, block long, line long, value string")
    got = csv_records.csv_records(given, ";").select(F.length("value").alias("n"), "first").collect()
    want = [len(rows[0][4]), sum(len(r[4]) for r in rows[1:4]) + 2, 200_000, len(rows[5][4]) + 1 + len(rows[6][4])]
    assert sorted(r.n for r in got) == sorted(want)
    assert [r.n for r in got if r.first] == [3]


def test_no_lines(spark):
    given = spark.createDataFrame([], "path string, name string, block long, line long, value string")
    assert csv_records.csv_records(given, ";").count() == 0


def test_whole_records_are_put_together_once(spark, tmp_path):
    """Years of files and rows both read the records; neither cuts them again."""
    (tmp_path / "a_2019.csv").write_text('annee;date;produit;marche;prix_moyen\n;2019-01-02;"a\nb";m;1,5\n;2019-01-03;c;"m\n2";2\n')
    quotes = landing.read_quotes(spark, landing.quote_manifest(spark, str(tmp_path / "a_2019.csv")))
    assert "Window" not in quotes._jdf.queryExecution().optimizedPlan().toString()
    assert rows(quotes.select("annee", "produit", "marche", "prix_moyen"), "produit") == [(2019, "a\nb", "m", 1.5), (2019, "c", "m\n2", 2.0)]
