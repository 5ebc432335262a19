from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import csv_records, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(seed: int, end: str, rows: int = 120) -> tuple[str, list[list[str]]]:
    draw = random.Random(seed)
    field = lambda: "".join(draw.choice(['"', ",", end, "é", "ab", "x ", '""', "7"]) for _ in range(draw.choice([0, 1, 3, 9, 60])))
    table = [[f"k{i}", field(), field()] for i in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["key", "a", "b"], *table])
    return out.getvalue(), table


def none_of(text: str) -> str | None:
    return None if text in readers.NULL_TOKENS else text


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
@pytest.mark.parametrize("limit", [csv_records.BROADCAST_BLOCKS, 0])
def test_quoted_breaks_across_splits(spark, tmp_path, small_splits, monkeypatch, seed, end, limit):
    monkeypatch.setattr(csv_records, "BROADCAST_BLOCKS", limit)
    want = []
    for part in range(2):
        text, table = written(seed * 10 + part, end)
        (tmp_path / f"{part}.csv").write_bytes(text.encode())
        want += [(f"{k}", none_of(a), none_of(b)) for k, a, b in table]
    df = readers.read_csv(spark, str(tmp_path), infer=False)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    if limit:
        assert df.rdd.getNumPartitions() > 4


def test_a_field_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "line, with \"\"quotes\"\"\n" * 200
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n\n2,z\n3,"{long}"')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).orderBy("a").collect()
    text = long.replace('""', '"')
    assert [tuple(r) for r in rows] == [(1, text), (2, "z"), (3, text)]


@pytest.mark.parametrize("line", ['3,"x\ny",5', '3'])
def test_ragged_records_are_an_error(spark, tmp_path, small_splits, line):
    path = tmp_path / "ragged.csv"
    path.write_text(f'a,b\n1,"p\nq"\n{line}\n')
    with pytest.raises(ValueError, match="1 rows"):
        readers.read_csv(spark, str(path))


def test_how_files_are_read(spark, tmp_path, small_splits):
    kinds = {"lines": 'a,b\n1,"x"\n2,5" pipe\n', "records": 'a,b\n1,"x\ny"\n', "whole": 'a,b\n1,"x\ry"\n'}
    for kind, text in kinds.items():
        path = tmp_path / f"{kind}.csv"
        path.write_bytes(text.encode())
        assert csv_records.needs_records(spark, str(path), ",")[0] == kind
    assert [r.b for r in readers.read_csv(spark, str(tmp_path / "lines.csv")).orderBy("a").collect()] == ["x", '5" pipe']
    assert readers.read_csv(spark, str(tmp_path / "whole.csv")).first()["b"] == "x\ry"


@pytest.mark.parametrize("text, inside, want", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"",c"', False, False), ('5" x', False, False),
    ("a", True, True), ('a"', True, False), ('a"",b', True, True), ('a","b', True, True), ('"', False, True), ('""', False, False), ('"', True, False),
])
def test_state_after_a_line(text, inside, want):
    assert csv_records.ends_inside(text, inside, ",") is want


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "head.csv").write_text('"a\nb",c\n')
    df = readers.read_csv(spark, str(tmp_path / "head.csv"))
    assert df.columns == ["a\nb", "c"] and df.agg(F.count("*")).first()[0] == 0
