import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftframe.operators.enrich import header_translations, mapped_values, normalized_value
from siftframe.operators.profile import profile, profile_frame
from siftframe.operators.rowid import renumber, with_row_index
from siftframe.sources import readers, writers
from siftframe.sources.readers import read_table

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows, shared):
    """A minimal workbook; strings found in ``shared`` are stored there, others inline."""

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v in shared:
            return f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_excel(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Id", "Name", "Ok"], [1, "Ana", True], [2.5, None, False]], ["Id", "Name", "Ana"]))
    (tmp_path / "b.xlsx").write_bytes(workbook([["Id", "Name"], [7, "Bo"]], []))
    df = readers.read_table(spark, str(tmp_path), " .XLSX ")
    assert df.columns == ["Id", "Name", "Ok"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "Ana", "True"), ("2.5", None, "False"), ("7", "Bo", None)]


def test_excel_keeps_every_cell(spark, tmp_path):
    shared = ["Id", "Name", "Name_2"]
    (tmp_path / "a.xlsx").write_bytes(workbook([["Id", "Name", "Name", "Name_2"], [1, 2, 3, 4], [5, 6, 7, 8, 9, 10]], shared))
    df = readers.read_table(spark, str(tmp_path), "xlsx")
    assert df.columns == ["Id", "Name", "Name_3", "Name_2", "Unnamed: 4", "Unnamed: 5"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "2", "3", "4", None, None), ("5", "6", "7", "8", "9", "10")]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text,n\n1,"a ""quoted"", b\nline",NA\n2,N/A,nan\n3,na, 5\n')
    rows = readers.read_table(spark, str(path), "csv").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "quoted", b\nline', None), ("2", None, None), ("3", "na", " 5")]


def test_csv_encoding(spark, tmp_path):
    latin, utf8 = tmp_path / "l.csv", tmp_path / "u.csv"
    latin.write_bytes("name\nJosé\n".encode("latin-1"))
    utf8.write_bytes("name\nJosé\n".encode())
    for path in (latin, utf8):
        assert readers.read_csv(spark, str(path), encoding="auto").first()["name"] == "José"


def test_json(spark, tmp_path):
    records, lines, columns = tmp_path / "r.json", tmp_path / "l.json", tmp_path / "c.json"
    records.write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    columns.write_text('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}')
    assert [tuple(r) for r in readers.read_table(spark, str(records), "json").collect()] == [(1, "x"), (2, None)]
    assert readers.read_table(spark, str(lines), "json", lines=True).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, str(columns), "json")
    with pytest.raises(ValueError):
        readers.read_table(spark, "x", "hdf5")


def test_sinks(spark, tmp_path, messy):
    writers.write_csv(messy, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"))
    assert "row_index" not in back.columns and back.count() == 8
    assert back.where("`Cust ID` = 'K02'").first()["Cust Name"] == "  Ben Okoro  "
    writers.write_json(messy, str(tmp_path / "json"))
    assert readers.read_json(spark, str(tmp_path / "json"), lines=True).where("`Cust Name` is null").count() == 1


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    scan = spark.read.parquet(str(tmp_path / "p"))
    assert readers.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_header_rules(spark, messy):
    got = {r["column"]: r for r in header_translations(profile_frame(messy, profile(messy))).collect()}
    assert got["Cust ID"]["standardized_name"] == "customer_id"
    assert got["Ctn Wgt"]["clean_datatype"] == "float"
    assert got["Txn Amt"]["standardized_name"] == "transaction_amount"
    assert got["Dt Joined"]["clean_datatype"] == "datetime"
    assert got["Material"]["clean_datatype"] == "str"
    assert got["Material"]["description"].startswith("(Heuristic fallback) Auto-standardized")


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Org. Cotton (GOTS)", "organic_cotton"), ("ctn", "standard_cotton"), ("Polyester (recycled)", "recycled_polyester"),
        ("types", "polyester"), ("Recycled WOOL", "recycled_wool"), ("unpaid", "completed"), (" S ", "completed"), ("F", "failed"),
        ("awaiting", "pending"), ("p", "pending"), ("Some-Other  value!", "some_other_value"), ("", ""),
    ],
)
def test_value_rules(spark, value, expected):
    assert spark.range(1).select(normalized_value(F.lit(value))).first()[0] == expected


def test_function_with_fallback(spark):
    df = spark.createDataFrame([("a",), ("Paid",), ("a",), (None,)], "v string")
    got = mapped_values(df, "v", lambda s: s.map({"a": "first"}.get))
    assert sorted(map(tuple, got.collect())) == [("Paid", "completed"), ("a", "first")]


def test_cells_of_column_documents_carry_nothing_else(spark, tmp_path):
    """A VARIANT taken out of an object has the names of all rows with it: memory grew with the square of a document."""
    (tmp_path / "a.json").write_text(json.dumps({"n": {str(i): i for i in range(5000)}, "t": {str(i): None if i % 2 else f"v{i}" for i in range(5000)}}))
    cells = readers._column_cells(spark, str(tmp_path)).select("cell").collect()
    assert len(cells) == 10000
    assert max(len(r["cell"].metadata) for r in cells if r["cell"] is not None) < 20
    df = read_table(spark, str(tmp_path), "json", orient="columns")
    assert sorted(map(tuple, df.collect())) == sorted(((i, None if i % 2 else f"v{i}") for i in range(5000)), key=lambda r: r[0])


def test_json_columns_as_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": [1, 2, null], "b": {"0": "x", "2": "z"}}')
    df = read_table(spark, str(tmp_path), "json", orient="columns")
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x"), (2, None), (None, "z")]


def test_json_by_columns(spark, tmp_path):
    one = {"name": {"0": "Ana", "1": None, "2": 'a "b"\nc'}, "n": {"0": 1, "1": 2, "2": 3}, "x": {"0": 1.5, "1": 2, "2": None}, "ok": {"0": True, "1": False}, "mixed": {"0": 1, "1": "one", "2": [1]}}
    two = {"n": {"a": 7}, "more": {"a": "m"}}
    (tmp_path / "1.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "2.json").write_text(json.dumps(two))
    df = read_table(spark, str(tmp_path), "json", orient="columns")
    assert sorted(df.columns) == sorted({*one, *two})
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "x": "double", "ok": "boolean", "mixed": "string", "more": "string"}
    rows = {r["n"]: r for r in df.collect()}
    assert len(rows) == 4 and (rows[1]["name"], rows[1]["x"], rows[1]["ok"], rows[1]["mixed"]) == ("Ana", 1.5, True, "1")
    assert (rows[2]["name"], rows[2]["x"], rows[2]["mixed"]) == (None, 2.0, "one")
    assert (rows[3]["name"], rows[3]["ok"], rows[3]["x"]) == ('a "b"\nc', None, None) and rows[7]["more"] == "m"
    with pytest.raises(ValueError, match="orientation"):
        read_table(spark, str(tmp_path), "json", orient="split")


def test_row_numbers_beside_any_column_names(spark, tmp_path):
    names = ["_path", "_start", "_mid", "_block", "_local", "_offset", "_size", "_tie", "_first", "_last"]
    spark.createDataFrame([tuple(range(k, k + 10)) for k in range(50)], ", ".join(f"{n} int" for n in names)).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for numbered in (with_row_index(df), with_row_index(df.repartition(3)), with_row_index(df, "_path", unique_integer=True), with_row_index(df, ["_tie", "_mid"])):
        assert numbered.columns == [*names, "row_index"]
        rows = numbered.collect()
        assert sorted(r["row_index"] for r in rows) == list(range(50))
    assert all(r["row_index"] == r["_path"] for r in rows)
    left = renumber(numbered.where("_path % 3 = 0")).collect()
    assert sorted(r["row_index"] for r in left) == list(range(17)) and all(r["_path"] == 3 * r["row_index"] for r in left)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_large_csv_files_are_split(spark, tmp_path, ends):
    cells = ['plain', 'a "quoted" word', 'two\nlines', 'x,y', '"', '\n\n', '', 'é', 'many\n' * 200, None]
    rows = [(str(k), cells[(k * 7) % 10], cells[(k * 3) % 9]) for k in range(3000)]
    quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(x in v for x in '",\n') else v
    (tmp_path / "in").mkdir()
    for name, part in (("a", rows[:2500]), ("b", rows[2500:])):
        text = ends.join(["id,one,\"two\nnames\"", *(",".join(map(quoted, r)) for r in part)]) + ends
        (tmp_path / "in" / f"{name}.csv").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_csv(spark, str(tmp_path / "in"), place=True)
        got = df.collect()
        tasks = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 10 and df.columns[:3] == ["id", "one", "two\nnames"]
    ordered = sorted(got, key=lambda r: (r["_file"], r["_block"], r["_line"]))
    assert [tuple(r)[:3] for r in ordered] == [tuple(v or None for v in r) for r in rows]
    if ends == "\n":
        whole = readers.read_csv(spark, str(tmp_path / "in"))
        assert whole.columns == df.columns[:3]
        assert sorted(map(str, map(tuple, whole.collect()))) == sorted(str(tuple(r)[:3]) for r in got)


def test_csv_with_unpaired_quotes_is_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{k},x\n" for k in range(2000)) + '9999,5" pipe\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2001 and rows[-1]["v"] == '5" pipe'
