"""Mixed contexts: cells, states and votes against plain Python, and odd inputs."""

import csv
import datetime
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from oracle_compare import rows_of
from pyspark.sql import functions as F

from questloom.operators import context as X
from questloom.plans import q_context
from questloom.sources import files as S


def files(root, content):
    for name, text in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(5)
    wide = ",".join(f"c{i}" for i in range(40))
    return files(tmp_path_factory.mktemp("context"), {
        "a.csv": "﻿id, name ,note\n" + "".join(f"{i},n{i % 7},{rng.choice(['', ' ', 'x', '3.5'])}\n" for i in range(500)),
        "deep/b c.csv": f'{wide}\n' + "".join(",".join(str(rng.randrange(9)) for _ in range(40)) + "\n" for _ in range(30)),
        "short.csv": 'k,v,w\n1\n2,"a,b"\n3,"say ""hi""",z,extra\n\n',
        "head.csv": "only,header\n",
        "empty.csv": "",
        "parts/part-00000-x.csv": "p,q\n1,2\n", "parts/part-00001-x.csv": "p,q\n3,4\n5,6\n", "parts/part-00002-x.csv": "p,q\n",
        "note.md": "not,a,table\n",
    })


def brute(root_dir):
    """Cells by the csv module, part files of a folder together."""
    import os

    out = defaultdict(list)
    for at, _, names in os.walk(root_dir):
        for name in sorted(names):
            if not name.endswith(".csv"):
                continue
            path = os.path.relpath(os.path.join(at, name), root_dir)
            path = path.split("/part-")[0]
            with open(os.path.join(at, name), encoding="utf-8-sig", newline="") as f:
                lines = [r for r in csv.reader(f) if r]
            for row in lines[1:]:
                for i, column in enumerate(lines[0]):
                    out[path, column.strip()].append((row[i] or None) if i < len(row) else None)
    return out


def test_cells_of_every_file_in_one_job(spark, folder):
    got = defaultdict(list)
    for r in X.csv_cells(spark, folder).collect():
        got[r.path, r.column].append(r.value)
    want = brute(folder)
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in want.items()}


def test_joined_headers_give_the_same(spark, folder, monkeypatch):
    small = sorted(map(repr, X.csv_cells(spark, folder).collect()))
    monkeypatch.setattr(X, "SMALL_HEADERS", -1)
    assert sorted(map(repr, X.csv_cells(spark, folder).collect())) == small


def test_sources(spark, folder):
    got = {r.path: r.summary for r in X.csv_sources(spark, folder).collect()}
    assert got["a.csv"] == "CSV 'a.csv': 3 cols x 500 rows (view: a)"
    assert got["deep/b c.csv"] == "CSV 'deep/b c.csv': 40 cols x 30 rows (view: deep__b_c)"
    assert got["head.csv"] == "CSV 'head.csv': 2 cols x 0 rows (view: head)"
    assert got["parts"] == "CSV 'parts': 2 cols x 3 rows (view: parts)"
    assert "empty.csv" not in got and "note.md" not in got


def cells(spark, rows):
    return spark.createDataFrame([("s", "t", 0, c, v) for c, v in rows], "path string, type string, ordinal int, column string, value string")


def test_states_against_python(spark):
    rng = random.Random(9)
    long = "y" * 5000
    rows = [("hot", "same" if rng.random() < 0.7 else rng.choice(["a", "B", "7", " ", "", None, long, long + "z"])) for _ in range(3000)]
    rows += [("num", str(i - 50)) for i in range(100)] + [("none", None)] * 4 + [("tie", v) for v in ("b", "a", "a", "b", "c")]
    got = {r.column: r for r in X.column_states(cells(spark, rows).repartition(7)).collect()}
    by = defaultdict(list)
    for c, v in rows:
        by[c].append(v)
    for c, values in by.items():
        there = [v for v in values if v is not None and v.strip()]
        r = got[c]
        assert (r.rows, r.missing, r.distinct_count) == (len(values), len(values) - len(there), len(set(there)))
    assert got["hot"].common == "same" and got["tie"].common == "a"
    assert got["num"].common is None and (got["num"].lo, got["num"].hi, got["num"].is_key) == (-50.0, 49.0, True)
    assert not got["none"].is_key and not got["none"].constant and got["none"].numeric_count == 0
    sketch = {r.column: r for r in X.column_states(cells(spark, rows), exact=False).collect()}
    for c, r in got.items():
        assert (sketch[c].rows, sketch[c].missing, sketch[c].lo, sketch[c].hi) == (r.rows, r.missing, r.lo, r.hi)
        assert abs(sketch[c].distinct_count - r.distinct_count) <= 0.15 * r.distinct_count + 1


def test_long_values_count_like_short_ones(spark):
    head = "z" * 200
    columns = {
        "one": [head + " a document"], "most": ["x" * 201] * 3 + ["short"] * 2 + [head] * 2, "least": [head + "b", head + "a", head + "aa", "zz", " "],
        "hot": [head * 30] * 500 + ["a"] * 499, "number": [" " * 300 + "7", "0" * 300 + "8.5", "-1"], "partly": ["1" + "_1" * 250, "-" + "9" * 201, head, head, None],
        "spaces": [" " * 300, "\t" * 201, None], "links": ["1" + "_1" * 20_000 + "x", "." + "5" * 20_000], "accents": ["é" * 201, "z" * 300, "漢" * 250],
    }
    rows = [(c, v) for c, vs in columns.items() for v in vs]
    got = {r.column: r for r in X.column_states(cells(spark, rows).repartition(5)).collect()}
    numbers = {"number": [7.0, 8.5, -1.0], "partly": [float("1" * 251), -float("9" * 201)], "links": [float("." + "5" * 20_000)]}
    for c, values in columns.items():
        there = Counter(v for v in values if v is not None and v.strip())
        want = numbers.get(c, [])
        common = min(there, key=lambda v: (-there[v], v.encode())) if len(want) < there.total() else None
        r = got[c]
        assert (r.rows, r.missing, r.distinct_count) == (len(values), len(values) - there.total(), len(there))
        assert (r.numeric_count, r.common) == (len(want), common), c
        assert (r.lo, r.hi) == ((pytest.approx(min(want), abs=1e-4), pytest.approx(max(want), abs=1e-4)) if want else (None, None))


def test_long_values_as_in_sql(spark):
    rng = random.Random(3)
    parts = ["a", "7", "1" * 150, "x" * 199, "x" * 200, "0" * 201, " "]
    rows = [(c, "".join(rng.choices(parts, k=rng.randrange(4))) or None) for c in "abcdef" for _ in range(60)] + [("g", "1" * 250), ("h", "y" * 400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE cells(path VARCHAR, type VARCHAR, ordinal INT, \"column\" VARCHAR, value VARCHAR)")
    con.executemany("INSERT INTO cells VALUES ('s', 't', 0, ?, ?)", rows)
    got = X.column_states(cells(spark, rows)).drop("ordinal")
    cur = con.execute(q_context._states("SELECT * FROM cells"))
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_no_cells(spark):
    none = spark.createDataFrame([], "path string, type string, ordinal int, column string, value string")
    assert X.column_states(none).count() == 0 and X.type_votes(none).count() == 0 and X.column_hints(none).count() == 0


def test_votes(spark):
    columns = {
        "whole": ["1", "-2", " 3 ", "", None], "huge": ["99999999999999999999", "1"], "real": ["1.5", "2", "1e3"], "bool": ["true", "FALSE"],
        "iso": ["2024-02-29", "2023-1-5"], "moment": ["2024-01-02T03:04:05.678", "2024-01-02"], "us": ["12/31/2024", "1/2/2024"],
        "eu": ["31/12/2024", "1/2/2024"], "dots": ["31.12.2024"], "bad": ["31/31/2024"], "mixed": ["1", "x"], "blank": ["", None],
    }
    got = {r.column: (r.type_name, r.form) for r in X.type_votes(cells(spark, [(c, v) for c, vs in columns.items() for v in vs])).collect()}
    assert got == {
        "whole": ("bigint", ""), "huge": ("double", ""), "real": ("double", ""), "bool": ("boolean", ""), "iso": ("date", "iso"),
        "moment": ("timestamp_ntz", "iso"), "us": ("date", "month/day"), "eu": ("date", "day/month"), "dots": ("date", "day.month"),
        "bad": ("string", ""), "mixed": ("string", ""), "blank": ("string", ""),
    }


def test_a_share_of_misfits_becomes_null(spark, tmp_path):
    root = files(tmp_path, {"t.csv": "a,d\n" + "".join(f"{i},{i % 12 + 1}/{i % 28 + 1}/2024\n" for i in range(99)) + "oops,never\n"})
    strict = X.scan_csv_voted(spark, root)
    assert dict(strict.dtypes) == {"a": "string", "d": "string"}
    loose = X.scan_csv_voted(spark, root, share=0.9)
    assert dict(loose.dtypes) == {"a": "bigint", "d": "date"}
    rows = loose.collect()
    assert len(rows) == 100 and sum(r.a is None for r in rows) == 1 and sum(r.d is None for r in rows) == 1
    assert {r.d for r in rows if r.a == 30} == {datetime.date(2024, 7, 3)}


def test_json_sources(spark):
    rows = [("j/a.json", '{"records":[{"x":1,"y":[1,2]},{"x":null}]}'), ("j/2.json", '[[1],[2]]'), ("j/c.json", "7"), ("j/d.json", "{"), ("j/e.json", None)]
    df = spark.createDataFrame(rows, "file string, body string")
    got = {r.path: r.summary for r in X.json_sources(df, "file", "body").collect()}
    assert got == {
        "j/a.json": "JSON 'j/a.json': dict, depth 5, records table: a (view: j__a_records)", "j/2.json": "JSON 'j/2.json': list, depth 3 (view: j__2)",
        "j/c.json": "JSON 'j/c.json': scalar, depth 1 (view: j__c)", "j/d.json": "JSON 'j/d.json': invalid, depth 0 (view: j__d)",
        "j/e.json": "JSON 'j/e.json': invalid, depth 0 (view: j__e)",
    }
    cells_of = sorted((r.column, r.value) for r in X.json_cells(df, "file", "body").filter(F.col("path") == "j/a.json").collect() if r.value)
    assert cells_of == [("x", "1"), ("y", "[1,2]")]


def test_written_cells_come_back(spark, tmp_path):
    rows = [(1, 'say "hi", twice'), (2, "back\\slash"), (3, 'end"'), (4, "a,b")]
    folder = str(tmp_path / "out")
    S.write_answer_csv(spark.createDataFrame(rows, "k long, v string").coalesce(1), folder)
    part = next((tmp_path / "out").glob("part-*.csv"))
    with open(part, newline="") as f:
        assert [(int(k), v) for k, v in list(csv.reader(f))[1:]] == rows
    assert sorted(map(tuple, S.scan_csv(spark, folder, "k long, v string").collect())) == rows
    assert sorted(map(tuple, X.scan_csv_voted(spark, folder).collect())) == rows


def test_repeated_keys_and_odd_json(spark):
    rows = [("a", '{"k":1,"k":2}'), ("b", "[]"), ("c", '{"records":[]}'), ("d", ""), ("e", "[null,3]")]
    df = spark.createDataFrame(rows, "path string, value string")
    got = Counter(r.path for r in X.json_cells(df, "path", "value").collect())
    assert set(got) <= {"a"} and got["a"] >= 1
    assert {r.path: r.hint for r in X.json_hints(df, "path", "value").collect()}["c"] == "records"
