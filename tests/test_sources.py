import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.plans.profile import run_profile
from plumbline.sources.tables import _ends_inside, as_json, read_table, validate, write_findings


def _write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


CSV = (
    'id,name,score,when,flag,note\n'
    '1,Zoë,1.5,2024-01-02,true,"two\nlines, ""quoted"""\n'
    '2,NA,inf,2024-01-03,false,null\n'
    '3,Bob,N/A,,True,x\n'
)


def test_types_and_missing_markers(spark, tmp_path):
    df = read_table(spark, _write(tmp_path / "t.csv", CSV), multiline=True)
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "score": "double", "when": "date", "flag": "boolean", "note": "string"}
    rows = df.orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Zoë", None, "Bob"]
    assert rows[0]["note"] == 'two\nlines, "quoted"'
    assert [r["score"] for r in rows] == [1.5, float("inf"), None]
    assert rows[0]["when"] == date(2024, 1, 2) and rows[2]["when"] is None


def test_other_encoding(spark, tmp_path):
    df = read_table(spark, _write(tmp_path / "t.csv", "größe,ort\n1,Köln\n2,Bonn\n", "iso-8859-1"))
    assert df.columns == ["größe", "ort"]
    assert [r["ort"] for r in df.orderBy("größe").collect()] == ["Köln", "Bonn"]


def test_numbers_of_all_kinds(spark, tmp_path):
    text = "a,b,c,d\n1,1e3,-.5,2024-01-02 03:04:05\n-2,2,3.,2024-01-02T00:00:00\n99999999999,-inf,7,\n"
    df = read_table(spark, _write(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "timestamp"}
    assert df.where("a = 99999999999").first()["b"] == float("-inf")


def test_schema_saves_the_inference(spark, tmp_path):
    df = read_table(spark, _write(tmp_path / "t.csv", "a,b\n1,x\nbad,y\n"), schema="a int, b string")
    assert [r["a"] for r in df.collect()] == [1, None]


def test_empty_column_and_empty_table(spark, tmp_path):
    df = read_table(spark, _write(tmp_path / "t.csv", "a,b\n1,\n2,NA\n"))
    assert dict(df.dtypes)["b"] == "string" and df.where("b IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        validate(read_table(spark, _write(tmp_path / "e.csv", "a,b\n")))


def test_paths_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, "table.xlsx")
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))


def test_parquet_and_frames(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    for source in (str(tmp_path / "t.parquet"), df):
        assert read_table(spark, source).where("x IS NULL").count() == 1


def test_findings_as_json(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 2.5, datetime(2024, 3, 4, 5), True, [1.0], None)],
        "i int, x double, t timestamp, ok boolean, v array<double>, none string")
    write_findings(df, str(tmp_path / "out"))
    line = "".join(p.read_text() for p in (tmp_path / "out").iterdir() if p.name.endswith(".json"))
    wanted = {"i": 1, "x": 2.5, "t": "2024-03-04", "ok": True, "v": [1.0], "none": None}
    assert json.loads(line) == wanted and json.loads(as_json(df).first()["json"]) == wanted
    write_findings(df, str(tmp_path / "table"), "parquet")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_replacement_character_in_valid_utf8(spark, tmp_path):
    path = tmp_path / "marked.csv"
    _write(path, "name,note\nZoë,lost \ufffd\n")
    row = read_table(spark, str(path)).first()
    assert (row["name"], row["note"]) == ("Zoë", "lost \ufffd")


def test_quoted_line_breaks_without_being_told(spark, tmp_path):
    path = _write(tmp_path / "t.csv", CSV)
    df = read_table(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "score": "double", "when": "date", "flag": "boolean", "note": "string"}
    assert [r["note"] for r in df.orderBy("id").collect()] == ['two\nlines, "quoted"', None, "x"]
    assert run_profile(spark, path, only=["basic_stats"]).tables["table_shape"].first()["n_rows"] == 3


def test_line_breaks_between_even_quotes(spark, tmp_path):
    path = _write(tmp_path / "t.csv", 'a,b,c\n5" pipe,"one\ntwo",6" pipe\n' + f'x,"{"long " * 20000}\n",y\n')
    assert [(r["a"], r["b"].strip()[-3:], r["c"]) for r in read_table(spark, path).collect()] == [
        ('5" pipe', "two", '6" pipe'), ("x", "ong", "y")]


def test_long_cells_with_and_without_line_breaks(spark, tmp_path):
    whole, broken = '""'.join(["long "] * 20000), "two\nlines"
    for name, cell in (("whole", whole), ("broken", broken)):
        path = _write(tmp_path / f"{name}.csv", f'a,b,c\n1,"x, ""{cell}""",\n,,"y"\n')
        rows = read_table(spark, path).orderBy(F.col("a").desc_nulls_last()).collect()
        assert [tuple(r) for r in rows] == [(1, f'x, "{cell.replace(chr(34) * 2, chr(34))}"', None), (None, None, "y")]


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('5" pipe,x', False, False), ('end",x', False, False),
    ('end","x', True, True), ('""', False, True), ('"a ""b"" c', True, False), ('"', True, False), ('a,"b""', True, False), ("", False, True),
])
def test_where_a_line_leaves_a_cell(line, outside, inside):
    assert (_ends_inside(line, False), _ends_inside(line, True)) == (outside, inside)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_to(size):
        for n, v in zip(names, (size, 1)):
            spark.conf.set(n, v)

    yield set_to
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [60, 500])
def test_records_over_the_borders_of_splits(spark, tmp_path, small_splits, size):
    cells = ['plain', '', '5" pipe', '"quoted, ""well"""', '"two\nlines"', '"a\n\n""b""\nc,d"', 'Zoë', '"long ' + "word\n" * 60 + '"']
    rows = [(i, cells[i % len(cells)], cells[(i // 3) % len(cells)]) for i in range(60)]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(3):
        own = rows[part::3]
        _write(folder / f"part-{part}.csv", "id,a,b\n" + "".join(f"{i},{a},{b}\n" for i, a, b in own))
    small_splits(size)
    table = read_table(spark, str(folder))
    plain = lambda c: None if c == "" else c[1:-1].replace('""', '"') if c[0] == '"' else c
    assert sorted(tuple(r) for r in table.collect()) == [(i, plain(a), plain(b)) for i, a, b in rows]
    latin = _write(tmp_path / "l.csv", "größe,b\n" + "".join(f'{i},"ü\n{i}"\n' for i in range(12)), "iso-8859-1")
    assert sorted((r["größe"], r["b"]) for r in read_table(spark, latin).collect()) == [(i, f"ü\n{i}") for i in range(12)]


def test_a_stray_quote_leaves_the_file_to_many_tasks(spark, tmp_path, small_splits):
    path = _write(tmp_path / "t.csv", "id,a\n" + '0,5" pipe\n' + "".join(f'{i},"x\ny"\n' for i in range(1, 400)))
    small_splits(500)
    table = read_table(spark, path)
    assert table.count() == 400 and len({r["f"] for r in table.select(F.input_file_name().alias("f")).distinct().collect()}) > 4
    assert read_table(spark, path, multiline=False).count() == 1 + 2 * 399
