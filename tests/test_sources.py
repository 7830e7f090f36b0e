"""Readers, writers and streams."""

import json
import zipfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyspark.sources import files, office, statements
from tallyspark.streaming import usage as stream


def test_inventory(spark, tmp_path):
    for name, text in [("a.txt", "x"), ("sub/b.txt", "x"), ("Generated/c.txt", "y")]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = files.supporting_files(spark, str(tmp_path), ["Generated"]).collect()
    assert len(rows) == 2 and len({r["sha256"] for r in rows}) == 1 and rows[0]["sha256"].isupper()


def test_master_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("h:0001", 1, D("10.00"), "line 1\nline 2, \"q\"")], "transaction_id string, sequence int, money_in decimal(18,2), narration string")
    header = spark.createDataFrame([("s.pdf", "ABC", D("100.00"))], "source string, source_sha256 string, opening_balance decimal(18,2)")
    files.write_master(rows, header, str(tmp_path / "m"))
    back = files.read_master(spark, str(tmp_path / "m")).collect()
    assert len(back) == 1 and back[0]["narration"] == "line 1\nline 2, \"q\"" and back[0]["opening_balance"] == D("100.00") and back[0]["bank"] == "ambank"


def test_usage_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"id": "a", "status": "started"}\n{broken\n{"id": "b", "usage": {"input_tokens": 3}}\n')
    assert sorted(r["id"] for r in files.read_usage(spark, str(tmp_path / "u.jsonl")).collect()) == ["a", "b"]


def test_last_valid_turn(spark):
    turn = lambda n: json.dumps({"type": "turn.completed", "usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 1}})
    lines = spark.createDataFrame([("f", 1, turn(5)), ("f", 2, turn(7)), ("f", 3, turn(-1)), ("f", 4, "{")], "path string, line_no int, value string")
    assert files.reported_usage(lines).first()["usage"]["input_tokens"] == 7


def test_office_units(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Payee</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>12.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.bin").write_bytes(b"?")
    units = office.read_units(spark.read.format("binaryFile").load(str(tmp_path))).cache()
    rows = {r["path"].rpartition("/")[2]: r for r in units.collect()}
    assert rows["a.xlsx"]["text"] == "A1=Payee | B1=12.5" and rows["b.xlsx"]["error"] and rows["c.bin"]["error"] == "unsupported format"
    assert {(r["column_name"], r["row_no"], r["value"]) for r in office.cells(units.filter("error is null")).collect()} == {("A", 1, "Payee"), ("B", 1, "12.5")}


def test_statement_rows(spark):
    layout = statements.Layout("plain", {"date": (0, 50), "narration": (50, 200), "money_in": (200, 250), "money_out": (250, 300), "balance": (300, 400)})
    words = [("s", 1, 1, 10, "01/12"), ("s", 1, 1, 60, "PAY"), ("s", 1, 1, 90, "ALI"), ("s", 1, 1, 210, "1,000.00"), ("s", 1, 1, 310, "1,100.00"), ("s", 1, 2, 60, "note"), ("s", 1, 3, 60, "FEE"), ("s", 1, 3, 260, "5.00"), ("s", 1, 3, 310, "1,095.00")]
    got = statements.statement_rows(spark.createDataFrame(words, "source string, page int, line int, x int, text string"), layout).orderBy("sequence").collect()
    assert [(r["narration"], r["money_in"], r["money_out"], r["date_text"]) for r in got] == [("PAY ALI\nnote", D("1000.00"), D("0.00"), "01/12"), ("FEE", D("0.00"), D("5.00"), "01/12")]


def test_exactly_one_layout(spark):
    rows = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "x", True), ("b", "y", True), ("c", "x", False)], "source string, layout string, passed boolean")
    got = {r["source"]: (r["layout"], r["error"]) for r in statements.one_passing_layout(rows).collect()}
    assert got == {"a": ("x", None), "b": (None, "several layouts pass"), "c": (None, "no layout passes")}


def test_overlapping_words(spark):
    boxes = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 60.0, 10.0), ("s", 1, 2, 55.0, 5.0, 90.0, 12.0), ("s", 2, 1, 0.0, 0.0, 10.0, 10.0), ("s", 2, 2, 10.5, 0.0, 20.0, 10.0)], "source string, page int, i int, x0 double, y0 double, x1 double, y1 double")
    assert [r["page"] for r in statements.overlapping_words(boxes).collect()] == [1]


def test_stream_keeps_the_best_event(spark, tmp_path):
    schema = "id string, seq int, status string, tokens int"
    (tmp_path / "in").mkdir()
    target = str(tmp_path / "best")

    def feed(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("id", "seq", "status", "tokens"), r))) for r in rows))
        q = stream.keep_best(stream.events_stream(spark, str(tmp_path / "in"), schema), target, str(tmp_path / "cp"), "id", F.col("tokens").isNotNull(), F.col("status") == "finished", ["seq"]).trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed("1.json", [("a", 1, "finished", 5), ("b", 1, "started", None)])
    feed("2.json", [("a", 2, "started", None), ("b", 2, "finished", None)])
    assert {r["id"]: r["seq"] for r in stream.best_table(spark, target).collect()} == {"a": 1, "b": 2}
    feed("3.json", [("c", 1, "finished", 1), ("b", 3, "finished", 2)])
    table = {"a": 1, "b": 3, "c": 1}
    assert {r["id"]: r["seq"] for r in stream.best_table(spark, target).collect()} == table
    assert sorted(stream.lists(spark, target)) == [1, 2]  # the last two only
    again = spark.createDataFrame([("c", 1, "finished", 1), ("b", 3, "finished", 2)], schema)
    stream.upsert_best(target, "id", F.col("tokens").isNotNull(), F.col("status") == "finished", ["seq"])(again, 2)
    assert {r["id"]: r["seq"] for r in stream.best_table(spark, target).collect()} == table
    assert stream.best_table(spark, target, before=2).count() == 2
