import csv
import io

import pytest

from siftwright.sources import answers, tabular


def test_separator_and_header(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿Report of May;;\nPart No;Description;Finish\nA1;\"x; y\";z\n;;\nB2;q\nC3;r;s;extra\n", encoding="utf-8")
    df = tabular.read_table(spark, str(p))
    assert df.columns == ["row_id", "Part No", "Description", "Finish"]
    assert [tuple(r)[1:] for r in df.orderBy("row_id").collect()] == [("A1", "x; y", "z"), ("B2", "q", ""), ("C3", "r", "s")]


def test_names():
    assert tabular.distinct_names(["a", "", "a", "a"]) == ["a", "column_2", "a_1", "a_2"]


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "t.xlsx")
    df = spark.createDataFrame([("A1", 'a "b" & <c>'), ("B2", None)], "code string, text string")
    tabular.write_workbook(df, p, ["code", "text", "missing"])
    back = tabular.read_table(spark, p)
    assert back.columns == ["row_id", "code", "text", "missing"]
    assert sorted(tuple(r)[1:] for r in back.collect()) == [("A1", 'a "b" & <c>', ""), ("B2", "", "")]
    assert [n for n, _ in tabular.sheets(open(p, "rb").read())] == ["Sheet1"]
    with pytest.raises(ValueError):
        tabular.write_workbook(df, p, ["code"], rows=1)


def test_delimited_sink(spark, tmp_path):
    p = str(tmp_path / "out.csv")
    tabular.write_delimited(spark.createDataFrame([("A1", None)], "code string, text string"), p, ["code", "text", "more"])
    parts = sorted((tmp_path / "out.csv").glob("part*.csv"))
    text = "".join(part.read_text(encoding="utf-8") for part in parts)
    assert text.splitlines() == ["\ufeffcode,text,more", 'A1,,']


def test_delimited_text_reads_as_the_csv_module_does(spark, tmp_path):
    text = '\ufeff\n\nCatalogue\n\nPart,Text,Size\nA1,"Milw 14""x1/8"" Disc",3\n\nB2,"two\nlines, one cell",4\nC3,"  kept ",\n,,\nD4,plain,5,extra\n'
    p = tmp_path / "t.csv"
    p.write_text(text, encoding="utf-8", newline="")
    grid = list(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")))
    want = [tuple((r + [""] * 3)[:3]) for r in grid[grid.index(["Part", "Text", "Size"]) + 1 :] if any(c.strip() for c in r)]
    df = tabular.read_table(spark, str(p))
    assert df.columns == ["row_id", "Part", "Text", "Size"]
    assert [tuple(r)[1:] for r in df.orderBy("row_id").collect()] == want
    again = str(tmp_path / "again.csv")
    tabular.write_delimited(df, again, ["Part", "Text", "Size"])
    body = "".join(x.read_text(encoding="utf-8") for x in sorted((tmp_path / "again.csv").glob("part*.csv")))
    assert [tuple(r) for r in csv.reader(io.StringIO(body.lstrip("\ufeff"), newline=""))] == [("Part", "Text", "Size"), *want]
    many = tmp_path / "m.csv"
    many.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(5000)))
    assert tabular.read_delimited(spark, str(many), line_breaks=False).count() == 5000
    empty = tmp_path / "e.csv"
    empty.write_text("")
    assert tabular.read_table(spark, str(empty)).count() == 0


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError):
        tabular.read_table(spark, "x.pdf")


def test_answers_are_asked_once(spark):
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string").withColumn("key", answers.key(F.lit("p"), F.col("prompt")))
    cache = answers.ask(asked.filter("prompt = 'a'"), str.upper)
    hit, miss = answers.split(asked, cache)
    assert [r["answer"] for r in hit.collect()] == ["A"] and {r["prompt"] for r in miss.collect()} == {"b"}
    assert {r["answer"] for r in answers.ask(miss, lambda p: 1 // 0).collect()} == {None}
