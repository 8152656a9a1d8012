"""Line order and separators over many files and blocks."""

from __future__ import annotations

import pytest
from conftest import records

from tidemark.sources import readers


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 64 bytes, several of them by one task."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_rules_are_numbered_over_files_and_blocks(spark, tmp_path, small_blocks):
    lines = [[f"{f}-{i}-" + "x" * (i % 9) for i in range(n)] for f, n in enumerate((70, 0, 1, 200))]
    for f, part in enumerate(lines):
        (tmp_path / f"rules{f}.txt").write_text("".join(f"{line}\x01\n" for line in part))
    read = readers.read_rules(spark, str(tmp_path), ["name", "other"])
    assert readers.read_lines(spark, str(tmp_path)).select("_file", "_block").distinct().count() > 20
    wanted = [{"rule_no": i, "name": line, "other": ""} for i, line in enumerate(sum(lines, []))]
    assert records(read, "rule_no") == wanted


def test_each_file_has_its_own_separator(spark, tmp_path, small_blocks):
    texts = {
        "a": "1\x01one\x01\n2\x01a,b\x01\n" + "3\x01" + "x" * 100 + "\x01\n4\x01\n",
        "b": "5,five\n6,six,more\n7\n",
        "c": "no separator\n\nsecond, line\n",
        "d": "",
        "e": "8\teight\t\n9\t\t\n",
        "f": "\n10,ten\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    rows = {(r["id"], r["word"]) for r in records(readers.read_delimited_files(spark, str(tmp_path), ["id", "word"]))}
    assert rows == {
        ("1", "one"), ("2", "a,b"), ("3", "x" * 100), ("4", ""), ("5", "five"), ("6", "six"), ("7", ""),
        ("no separator", ""), ("", ""), ("second, line", ""), ("8", "eight"), ("9", ""), ("10,ten", ""),
    }


def test_one_file_equals_the_plain_reader(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"1\x01a\xff\x01\n2\x01\n\x01\x01b\x01\n")
    fields = ["x", "y", "z"]
    plain, many = readers.read_delimited(spark, str(tmp_path), fields), readers.read_delimited_files(spark, str(tmp_path), fields)
    assert records(plain, "x", "y") == records(many, "x", "y")


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    assert readers.read_rules(spark, str(tmp_path)).count() == 0
    assert readers.read_delimited_files(spark, str(tmp_path), ["a"]).count() == 0
