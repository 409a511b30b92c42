import zipfile

import fixtures as X
import pytest
from attrlink import load_inputs, load_reference, match_values, read_table
from attrlink.schema import MissingColumns
from attrlink.sources import sample, sinks, snapshot
from attrlink.sources.tables import with_row_ids
from attrlink.sources.xlsx import column_index

HEADERS = ["Category", "Sub-Category", "Attribute Name", "Preset values"]


def test_row_ids_follow_files_and_keep_gaps(spark, tmp_path):
    for name, rows in (("b", [("4",), ("5",)]), ("a", [("0",), ("1",), ("2",), ("3",)])):
        spark.createDataFrame(rows, "v string").coalesce(1).write.mode("append").csv(f"{tmp_path}/{name}")
    df = spark.read.schema("v string").option("recursiveFileLookup", True).csv(str(tmp_path))
    got = {r.v: r.row_id for r in with_row_ids(df).collect()}
    assert got == {str(i): i for i in range(6)}
    rows = spark.createDataFrame([(str(i),) for i in range(20)], "v string").repartition(1)
    assert sorted(r.row_id for r in with_row_ids(rows).collect()) == list(range(20))


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_row_ids_do_not_depend_on_splits(spark, tmp_path, kind):
    rows = spark.range(20_000).selectExpr("cast(id AS string) AS v", "repeat('x', 50) AS w").coalesce(1)
    rows.write.option("parquet.block.size", 65536).format(kind).save(f"{tmp_path}/t")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "20000000")
        spark.conf.set(names[1], "2")
        df = spark.read.schema("v string, w string").format(kind).load(f"{tmp_path}/t")
        numbered = with_row_ids(df)
        spark.conf.set(names[0], "100000")
        spark.conf.set(names[1], "8")
        got = {r.v: r.row_id for r in numbered.select("v", "row_id").collect()}
        again = {r.v: r.row_id for r in with_row_ids(df).select("v", "row_id").collect()}
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert got == again == {str(i): i for i in range(20_000)}


def test_reference_csv(spark, tmp_path):
    path = tmp_path / "ref.csv"
    path.write_text('Category,Sub-Category,Attribute Name,Preset values\nA,B,C,"EAO, 02"\n,,,lost\n A ,B,C,24.0\n', encoding="utf-8")
    rows = load_reference(read_table(spark, str(path))).orderBy("row_id").collect()
    assert [(r.row_id, r.category, r.preset_value, r.normalized) for r in rows] == [
        (0, "A", "EAO, 02", "eao, 02"), (2, "A", "24.0", "24.0")
    ]
    assert rows[0].composite_key == "A|B|C" and rows[0].has_commas
    with pytest.raises(MissingColumns):
        load_reference(read_table(spark, str(path)).drop("Category"))


def test_inputs_json(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"Structure": "A", "Full Structure": "B", "Attribute Name": "C", "Attribute value": 24}\n')
    row = load_inputs(read_table(spark, str(path))).first()
    assert (row.input_id, row.category, row.sub_category, row.attribute_name, row.input_value) == (0, "A", "B", "C", "24")


def write_xlsx(path, rows):
    """The parts of a workbook that matter: shared strings, inline strings, numbers, gaps."""
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        line = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                line.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif c % 2:
                line.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                shared.append(f"<si><t>{v}</t></si>")
                line.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
        cells.append(f'<row r="{r}">{"".join(line)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(shared)}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    assert [column_index(r) for r in ("A1", "Z9", "AA10", "AB1")] == [0, 25, 26, 27]
    write_xlsx(tmp_path / "a.xlsx", [HEADERS, ["A", "B", "C", "10kΩ"], [None, "B", "C", 24]])
    write_xlsx(tmp_path / "b.xlsx", [HEADERS[::-1], ["5", "C", "B", "A"]])
    df = read_table(spark, f"{tmp_path}/*.xlsx", "xlsx")
    assert df.columns == HEADERS
    assert {tuple(r) for r in df.collect()} == {("A", "B", "C", "10kΩ"), (None, "B", "C", "24"), ("A", "B", "C", "5")}
    one = load_reference(read_table(spark, f"{tmp_path}/a.xlsx"))
    assert [(r.row_id, r.preset_value) for r in one.orderBy("row_id").collect()] == [(0, "10kΩ"), (1, "24")]


def test_xlsx_headers_that_differ(spark, tmp_path):
    write_xlsx(tmp_path / "a.xlsx", [HEADERS, ["A", "B", "C", "10kΩ"]])
    write_xlsx(tmp_path / "b.xlsx", [["Note", *HEADERS], ["odd", "A", "B", "C", "24"]])
    write_xlsx(tmp_path / "c.xlsx", [["Note", "Note", "Maker"], ["one", "two", "EAO"]])
    df = read_table(spark, f"{tmp_path}/*.xlsx", "xlsx")
    assert df.columns == [*HEADERS, "Note", "Note_1", "Maker"]
    assert {tuple(r) for r in df.collect()} == {
        ("A", "B", "C", "10kΩ", None, None, None),
        ("A", "B", "C", "24", "odd", None, None),
        (None, None, None, None, "one", "two", "EAO"),
    }
    reference = load_reference(df).orderBy("preset_value").collect()
    assert [(r.preset_value, r.Note) for r in reference] == [("10kΩ", None), ("24", "odd")]
    named = read_table(spark, f"{tmp_path}/*.xlsx", "xlsx", columns=["Maker", "Category"])
    assert {tuple(r) for r in named.collect()} == {(None, "A"), ("EAO", None)}


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshot.read_snapshot(spark, path) is None
    assert snapshot.snapshot_info(spark, path).first()["exists"] is False
    rows = X.PRESETS + [(40, " ", "", "", "blank key")]
    calls = []

    def source():
        calls.append(1)
        return X.presets(spark, rows)

    first = snapshot.load_or_build(spark, path, source)
    again = snapshot.load_or_build(spark, path, source)
    assert len(calls) == 1 and first.count() == again.count() == 33
    assert snapshot.refresh(again, path).count() == 32
    info = snapshot.snapshot_info(spark, path).first()
    assert info["exists"] and info["bytes"] > 0 and info["modified"] is not None


def test_upsert(spark):
    reference = load_reference(X.presets(spark))
    changes = X.presets(spark, [(0, "Switches", "Push Button", "Brand", " EAO, 03 "), (100, "N", "N", "N", "new")])
    deleted = spark.createDataFrame([(31,)], "row_id long")
    rows = {r.row_id: r for r in snapshot.upsert(reference, changes, deleted).collect()}
    assert len(rows) == 32 and 31 not in rows
    assert (rows[0].preset_value, rows[0].normalized) == ("EAO, 03", "eao, 03")
    assert rows[100].normalized == "new" and rows[1].preset_value == "24V"


def test_csv_and_report(spark, tmp_path):
    results = match_values(X.inputs(spark), X.presets(spark))
    sinks.write_csv(results, f"{tmp_path}/csv")
    back = read_table(spark, f"{tmp_path}/csv", "csv")
    assert back.count() == 13 and back.filter("original_input = 'EAO, 02'").count() == 1
    parts = sinks.write_report(results, f"{tmp_path}/report")
    assert parts == ["comparison_results", "summary", "status_breakdown", "category_analysis"]
    table = read_table(spark, f"{tmp_path}/report/comparison_results", "csv")
    assert "Matched Preset Value" in table.columns and table.count() == 13


def test_sample_does_not_depend_on_partitions(spark):
    one = sample.sample_inputs(spark, 500).collect()
    other = sample.draw(spark.range(0, 500, 1, 7), "id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    assert {r.category for r in one} == set(sample.POOLS["category"])
    assert {r.input_value for r in one} == set(sample.POOLS["input_value"])


def test_stream(spark, tmp_path):
    from attrlink.streaming.files import match_stream

    X.inputs(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(X.inputs(spark).schema).parquet(f"{tmp_path}/in")
    run = match_stream(stream, X.presets(spark), f"{tmp_path}/out", f"{tmp_path}/state", max_matches=3)
    run.awaitTermination(120)
    assert run.exception() is None
    assert spark.read.parquet(f"{tmp_path}/out").count() == 13
