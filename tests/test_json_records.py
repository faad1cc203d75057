import json
import random

import pytest

from glebe.sources import json_records, records

TEXTS = ["", "a", "}", "{", "]", "[", '"', '"}', '\\', '\\"', "},{", '"features": [', "x}features", "é}", "\\u007d", "a\nb", ", "]


def thing(draw, depth=0):
    kind = draw.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return draw.choice(TEXTS)
    if kind < 3:
        return draw.choice([None, True, 1.5, 7])
    if kind == 3:
        return [thing(draw, depth + 1) for _ in range(draw.randrange(3))]
    return {draw.choice(["k", "features", "data", "}", "a\"b"]) + str(i): thing(draw, depth + 1) for i in range(draw.randrange(4))}


def record(draw, number):
    return {"id": number, "features": [{"features": []}], **{f"f{i}": thing(draw) for i in range(draw.randrange(4))}}


def dumped(draw, value):
    return json.dumps(value, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 1]))


@pytest.fixture
def small_splits(spark):
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def found(spark, path, key):
    rows = json_records.json_records(spark, str(path), key).collect()
    out = {}
    for row in rows:
        out.setdefault(row.path.rsplit("/", 1)[1], []).append(json.loads(row.value))
    return {name: sorted(got, key=lambda r: r["id"]) for name, got in out.items()}


@pytest.mark.parametrize("size", [3, 61, 1 << 20])
@pytest.mark.parametrize("key", [None, "features"])
def test_records_at_any_border(spark, tmp_path, small_splits, key, size):
    """Random records, shifted against the splits by leading blanks, as a parser of whole files reads them."""
    draw = random.Random(size)
    want = {}
    for number in range(8 if size == 3 else 60):
        listed = [record(draw, i) for i in range(draw.randrange(5))]
        around = [("type", "}"), ("crs", {"properties": {"features": [{"id": -1}]}}), ("links", [{"id": -2}, {"id": -3}])]
        draw.shuffle(around)
        whole = listed if key is None else dict([*around[:2], (key, listed), *around[2:]])
        text = " " * draw.randrange(40) + dumped(draw, whole) + draw.choice(["", "\n", "\n\n"])
        (tmp_path / f"f{number}").write_bytes(text.encode())
        if listed:
            want[f"f{number}"] = listed
    small_splits(size)
    assert found(spark, tmp_path, key) == want


def test_odd_files(spark, tmp_path):
    texts = {
        "one": ' {"id": 1, "a": {"b": {}}}', "several": '{"id": 1}\n{"id": 2}', "empty": "", "blank": " \n", "none": "[]",
        "broken": '[{"id": 1}, {"id": 2', "cut": '[{"id": 1}, {"id": 2}', "scalars": '[1, "a}", {"id": 1}, null, {"id": 2}]',
        "twice": '[{"id": 1},{"id": 1}]', "mark": '﻿[{"id": 1}]', "open string": '[{"id": 1}, {"id": "}, {}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {n: [r["id"] for r in rows] for n, rows in found(spark, tmp_path, None).items()}
    assert {n.replace("%20", " "): ids for n, ids in got.items()} == {
        "one": [1], "several": [1, 2], "broken": [1], "cut": [1, 2], "scalars": [1, 2], "twice": [1, 1], "mark": [1],
        "open string": [1]}


def test_lists_without_the_key(spark, tmp_path):
    (tmp_path / "a").write_text('{"other": [{"id": 1}], "deep": {"data": [{"id": 2}]}}')
    (tmp_path / "b").write_text('[{"data": [{"id": 3}]}]')
    (tmp_path / "c").write_text("<html>}</html>")
    assert found(spark, tmp_path, "data") == {}


def test_a_file_that_is_no_json_is_rejected(spark, tmp_path):
    (tmp_path / "a").write_text("<html>no {} service</html>")
    (tmp_path / "b").write_text('[{"latitude": 1, "longitude": 2, "daily": {"time": ["2024-01-01"]}}]')
    rows, rejected = records.read_weather(spark, str(tmp_path), layout="array")
    assert rows.count() == 1
    assert [r.contenu for r in records.weather_rejects(rejected).collect()] == ["<html>no {"]


def test_a_large_collection_is_read_by_many_tasks(spark, tmp_path, small_splits):
    features = [{"type": "Feature", "properties": {"ID_PARCEL": str(i)},
                 "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}} for i in range(2000)]
    text = json.dumps({"type": "FeatureCollection", "features": features})
    (tmp_path / "c.json").write_text(text)
    small_splits(len(text) // 16)
    read = records.read_features(spark, str(tmp_path), "collection")
    assert sorted(int(r.properties["ID_PARCEL"]) for r in read.collect()) == list(range(2000))
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() >= 16


def test_pieces_are_staged_in_chunks(spark, tmp_path, monkeypatch):
    """What is stored, joined and put in order are some chunks of a file, not three pieces a feature."""
    features = [{"type": "Feature", "properties": {"ID_PARCEL": str(i)}, "geometry": {"type": "Point", "coordinates": [0, 1]}}
                for i in range(3000)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    paths, new_path = [], json_records.scratch_path

    def noted(*args):
        paths.append(new_path(*args))
        return paths[-1]

    monkeypatch.setattr(json_records, "scratch_path", noted)
    read = records.read_features(spark, str(tmp_path), "collection")
    assert sorted(int(r.properties["ID_PARCEL"]) for r in read.collect()) == list(range(3000))
    assert paths and all(1 <= spark.read.parquet(path).count() <= 10 for path in paths)


@pytest.mark.parametrize("size", [1, 50, 400])
@pytest.mark.parametrize("key", [None, "features"])
def test_records_of_several_chunks(spark, tmp_path, monkeypatch, key, size):
    """Chunks within one split: records that lie in many, lists that open and close in any, escapes at every place."""
    monkeypatch.setattr(json_records, "CHUNK_BYTES", size)
    draw, want = random.Random(size), {}
    for number in range(30):
        listed = [record(draw, i) | {"\\" * (i % 4) + '"features': '\\"features\\": [' * i} for i in range(draw.randrange(6))]
        around = [("before", [{"id": -1}, {"features": [{"id": -2}]}]), ('x"features', [{"id": -3}]), ("after", {"}": [{"id": -4}]})]
        whole = listed if key is None else dict([*around[:number % 4], (key, listed), *around[number % 4:]])
        (tmp_path / f"f{number}").write_text(dumped(draw, whole))
        if listed:
            want[f"f{number}"] = listed
    assert found(spark, tmp_path, key) == want
