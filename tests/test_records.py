from __future__ import annotations

import csv
import random

import pytest

from plurality.sources import records, survey


def written(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["a", "b", "c d", "e", "id"])
        w.writerows(rows)
    return str(path)


def odd_rows(n, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "b", ",", "\n", '"', " ", "é", "\r\n", "'", '""', "\\", "日本"]
    field = lambda: "" if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) + "x"
    return [[field() for _ in range(4)] + [str(i)] for i in range(n)]


@pytest.mark.parametrize("size", [500, 3000, 1 << 27])
def test_blocks_cut_anywhere(spark, tmp_path, size):
    """One file with line breaks, quotes and separators in fields, one of them longer than many blocks."""
    rows = odd_rows(1200)
    rows[600][1] = "start" + "line, \"x\"\n" * 1500 + "end"
    path = written(tmp_path / "f.csv", rows)
    with records.block_bytes(spark, size):
        blocks = records.lines(spark, path).select("block").distinct().count()
        out = records.read(spark, path)
        got = sorted(map(tuple, out.collect()), key=lambda r: int(r[4]))
        own = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
        assert out.columns == own.columns and got == sorted(map(tuple, own.collect()), key=lambda r: int(r[4]))
    assert got == [tuple(x or None for x in r) for r in rows]
    assert (blocks > 30) == (size < 1 << 27)


def test_blocks_run_in_many_tasks(spark, tmp_path):
    path = written(tmp_path / "f.csv", odd_rows(2000))
    with records.block_bytes(spark, 2000):
        assert records.lines(spark, path).rdd.getNumPartitions() > 20
        plan = records.records(spark, path)._jdf.queryExecution().toString()
    assert "multiLine" not in plan and "Exchange SinglePartition" not in plan


def test_several_files_and_ends_of_line(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    rows = odd_rows(300, seed=3)
    for i in range(3):
        written(folder / f"{i}.csv", [[x.replace("\r\n", "\n") for x in r] for r in rows[100 * i : 100 * i + 100]], end="\r\n")
    (folder / "3.csv").write_text("a,b,c d,e,id\n\n")
    with records.block_bytes(spark, 800):
        got = sorted(map(tuple, records.read(spark, str(folder)).collect()), key=lambda r: int(r[4]))
    assert got == [tuple(x.replace("\r\n", "\n") or None for x in r) for r in rows]


def test_header_of_several_lines_and_short_records(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('﻿"first\nname",b,"c ""d"""\n1\n\n2,"",3,4\n')
    out = records.read(spark, str(path))
    assert out.columns == ["first\nname", "b", 'c "d"']
    assert sorted(map(tuple, out.collect())) == [("1", None, None), ("2", None, "3")] or sorted(map(tuple, out.collect())) == [("1", None, None), ("2", "", "3")]
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        records.read(spark, str(empty))


def test_record_ids(spark):
    raw = [("d", "q", "{'A': 1, 'B': 3}", "{}", "5"), ("d", "q", "{'A': 1, 'B': 1}", "{}", "9"), ("d", "q", "{'A': 1}", "{'x': 'y'}", None), ("d|", "q", "{'A': 1}", "{}", None), ("d", "|q", "{'A': 1}", "{}", None)]
    df = spark.createDataFrame(raw, "dataset_name string, input_template string, human_answer string, group_prompt_variable_map string, group_size string")
    cells = survey.to_cells(df, "pop")
    ids = [r.record_id for r in cells.collect()]
    assert all(len(i) == 32 for i in ids) and ids[0] == ids[1] and len(set(ids)) == 4
    one = survey.one_per_record(cells)
    assert one.columns == cells.columns and one.count() == 4
    assert one.filter(one.record_id == ids[0]).first().group_size == 9


def test_topline_meta_comes_back(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "system string, mean double")
    meta = spark.createDataFrame([("run", 3, [0.5, 1.0], {"k": "v"})], "name string, n long, grid array<double>, params map<string,string>")
    survey.write_topline(table, str(tmp_path / "t"), meta)
    assert sorted(map(tuple, survey.read_topline(spark, str(tmp_path / "t")).collect())) == [("a", 1.5), ("b", 2.5)]
    back = survey.read_meta(spark, str(tmp_path / "t"), "name string, n long, grid array<double>, params map<string,string>")
    assert back.collect() == meta.collect()
