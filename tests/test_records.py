"""Split reading of CSV files against Spark's reader of whole files and Python's csv module."""

from __future__ import annotations

import csv
import io
import random

import pytest

from sourcegauge.sources.records import line_end, records
from sourcegauge.sources.upload import read_csv


def _file(rows, seed, sep=",", end="\n"):
    rng = random.Random(seed)
    pieces = ["a", "b c", "", "x" * 30, 'q"q', "1,5", "l\nm", "\n", "\n\n", '"', "é", "|;", '",\n"']
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["subid", "two\nlines", "c", "d"])
    for i in range(rows):
        w.writerow([f"S{i:05d}", *("".join(rng.choice(pieces) for _ in range(rng.randrange(3))) for _ in range(3))])
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def use(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return [tuple(c or "" for c in r[:-1]) for r in df.orderBy("ord").collect()]


def parsed(text, sep=","):
    return [tuple(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r][1:]


@pytest.mark.parametrize("block", [64, 700, 10**8])
@pytest.mark.parametrize("sep, end", [(",", "\n"), ("|", "\r\n")])
def test_blocks_give_the_records_of_the_file(spark, tmp_path, small_blocks, block, sep, end):
    """However a file is cut, also inside headers and cells, all records come out whole and in order."""
    text = _file(300, block, sep, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    small_blocks(block)
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["subid", "two\nlines", "c", "d", "ord"]
    assert rows_of(df) == parsed(text, sep)
    if block < 10**8:
        assert df.rdd.getNumPartitions() > 5


def test_equals_the_reader_of_whole_files(spark, tmp_path, small_blocks):
    """Cells with stray quotes, and text behind closing quotes, are read as Spark's own reader reads them."""
    body = 'S1,5" pipe,"a ""b"" c",x\nS2,"open\nand ""closed""","","end"\nS3,a"b"c,"x"tail,"y\n\nz"\nS4,,,\nS5,"one\n","two\n","three\n"\n' * 40
    (tmp_path / "b.csv").write_text("subid,p,q,r\n" + body)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "b.csv"))
    small_blocks(100)
    assert rows_of(read_csv(spark, str(tmp_path / "b.csv"))) == [tuple(c or "" for c in r) for r in whole.collect()]


def test_several_files_blank_lines_and_marks(spark, tmp_path, small_blocks):
    (tmp_path / "u").mkdir()
    for i in range(4):
        (tmp_path / f"u/{i}.csv").write_bytes(b"\xef\xbb\xbf\r\n  \n" * (i % 2) + f'subid,"p\nq"\r\n\r\nA{i},"1\n2"\r\n\nB{i},3'.encode())
    small_blocks(20)
    df = read_csv(spark, str(tmp_path / "u"))
    assert df.columns == ["subid", "p\nq", "ord"]
    assert rows_of(df) == [r for i in range(4) for r in ((f"A{i}", "1\n2"), (f"B{i}", "3"))]
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    assert rows_of(read_csv(spark, str(tmp_path / "open.csv")))[0][0] == "1"
    (tmp_path / "inch.csv").write_text('5" size;b\n1;2\n')
    assert read_csv(spark, str(tmp_path / "inch.csv")).columns == ['5" size', "b", "ord"]
    (tmp_path / "none.csv").write_text("\n  \n")
    with pytest.raises(ValueError, match="no data"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_line_end():
    ends = line_end(",")
    for line, outside, inside in [('a,"b', True, False), ('a"b', False, False), ('"a""', True, False), ('"a","', True, True), ("x", False, True),
                                  ('""', False, True), ('a","b', True, True), ('"', True, False), ('5",3', False, False)]:
        assert (ends(line, False), ends(line, True)) == (outside, inside), line
    assert ends('"' + "x" * 10**6 + "," * 10**6, False) and not ends('"a",' * 10**5, False)


def test_blocks_are_read_by_many_tasks(spark, tmp_path, small_blocks):
    text = "subid,note\n" + "".join(f'S{i:06d},"first\nsecond, {i}"\n' for i in range(20000))
    (tmp_path / "c.csv").write_text(text)
    small_blocks(30000)
    found = records(spark, str(tmp_path / "c.csv"), ",")
    assert found.count() == 20000 and found.select("block").distinct().count() > 10
    assert rows_of(read_csv(spark, str(tmp_path / "c.csv"))) == parsed(text)
