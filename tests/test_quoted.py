"""The splittable reader of quoted files against the csv module."""

import csv
import random

import pytest

from sentspark.sources import readers as R
from sentspark.sources.quoted import ends_inside


def content(n=300, seed=1):
    rng = random.Random(seed)
    kinds = ['a "q" b', "line\nbreak, with\n\n\"quotes\"\nand\tsep", "\r\n windows", '"', '""', "\n", "plain", " lead", "tail ", "é漢👍", "\\", "x" * 500, '"\n"']
    return [(str(i), rng.choice(kinds), rng.choice(["SUBJ", "OBJ"])) for i in range(n)]


def written(path, rows, separator, end):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=separator, lineterminator=end)
        out.writerow(["sentence_id", "sentence", "label"])
        out.writerows(rows)
    return str(path)


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    before = {n: spark.conf.get(n) for n in names}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [40, 130, 1000, 1 << 27])
@pytest.mark.parametrize("separator, end", [("\t", "\n"), (",", "\r\n")])
def test_any_blocks_give_the_rows(spark, tmp_path, small_blocks, size, separator, end):
    rows = content()
    path = written(tmp_path / "one.txt", rows, separator, end)
    small_blocks(size)
    if size < 1 << 27:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
    got = R.read_delimited(spark, path, separator=separator, line_breaks=True).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_many_files_each_with_a_header(spark, tmp_path, small_blocks):
    small_blocks(90)
    rows = []
    for i in range(4):
        part = [(f"{i}-{a}", b, c) for a, b, c in content(40, i)]
        written(tmp_path / f"{i}.tsv", part, "\t", "\n")
        rows += part
    written(tmp_path / "empty.tsv", [], "\t", "\n")
    got = R.read_delimited(spark, str(tmp_path), separator="\t", line_breaks=True)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert got.select("label").distinct().count() == 2


def test_blank_lines_unclosed_quotes_and_stray_quotes(spark, tmp_path, small_blocks):
    path = tmp_path / "odd.csv"
    path.write_text('sentence_id,sentence,label\n\n1,a 5" pipe,SUBJ\n2,"x"y,OBJ\n\n3,,SUBJ\n4,"",OBJ\n5,"never\nclosed,OBJ\n')
    for size in (8, 1 << 27):
        small_blocks(size)
        got = {r[0]: (r[1], r[2]) for r in R.read_delimited(spark, str(path), line_breaks=True).collect()}
        assert got["1"] == ('a 5" pipe', "SUBJ") and got["2"] == ('"x"y', "OBJ") and got["3"] == (None, "SUBJ")
        assert got["4"][1] == "OBJ" and got["5"][0].startswith("never\nclosed") and len(got) == 5


def test_states_of_lines():
    for line, inside, want in [("a,b", False, False), ('a,"b', False, True), ('"a""', False, True), ('"a"""', False, False), ('x",b"', False, False),
                               ('b",c', True, False), ('b"",c', True, True), ('b","c', True, True), ("plain", True, True), ("", True, True), ("", False, False)]:
        assert ends_inside(line, ",", inside) == want, line
