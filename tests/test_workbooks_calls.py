"""Workbooks written and read back by the tasks; calls to the outside with failures, hanging calls and a rerun."""

import time
import zipfile

from corpusloom.operators import calls
from corpusloom.sources import workbooks as W


def test_round_trip_and_odd_files(spark, tmp_path):
    rows = [(1, "a <b> & \"c\"", None), (2, "  spaces ", "é🙂"), (3, "", "line\nbreak")]
    df = spark.createDataFrame(rows, "id long, name string, note string").coalesce(1)
    assert [r["rows"] for r in W.write_workbooks(df, f"file://{tmp_path}/w").collect()] == [3]
    got = W.read_workbook(spark, f"file://{tmp_path}/w")
    assert got.columns == ["id", "name", "note"] and sorted(map(tuple, got.collect())) == [(str(i), n, t or "") for i, n, t in rows]
    (tmp_path / "w" / "zz.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "w" / "y.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<broken")
        z.writestr("xl/_rels/workbook.xml.rels", "<r/>")
    assert W.workbook_rows(spark, f"file://{tmp_path}/w").where("error is not null").count() == 2
    assert W.read_workbook(spark, f"file://{tmp_path}/w").count() == 3


def test_shared_strings_types_gaps_and_sheets(spark, tmp_path):
    main, rel = W._MAIN[1:-1], W._REL[1:-1]
    (tmp_path / "s").mkdir()
    with zipfile.ZipFile(tmp_path / "s" / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Two" r:id="b"/><sheet name="One" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Title</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AB2" t="b"><v>1</v></c></row><row r="3"/><row r="5"><c r="B5" t="s"><v>1</v></c><c t="str"><f>x</f><v>sum</v></c></row></sheetData></worksheet>')
    rows = [tuple(r)[1:4] for r in W.workbook_rows(spark, f"file://{tmp_path}/s").collect()]
    assert rows == [("Two", 2, ["", "Title", *[""] * 25, "1"]), ("Two", 5, ["", "rich", "sum"]), ("One", 1, ["7"])]
    table = W.read_workbook(spark, f"file://{tmp_path}/s")
    assert table.columns[:3] == ["Column_0", "Title", "Column_2"] and [tuple(r)[:3] for r in table.collect()] == [("", "rich", "sum")]
    assert [W.column_number(f"{W.column_name(n)}9") for n in range(2000)] == list(range(2000))


def test_calls_fail_hang_and_are_resumed(spark, tmp_path):
    log = f"file://{tmp_path}/log"

    def call(broken):
        def outside(key, payload):
            n = int(key)
            if broken and n % 5 == 1:
                raise RuntimeError("refused")
            if broken and n % 5 == 2:
                time.sleep(3)
            return payload.upper()

        return outside

    rows = [(str(k), f"p{k}") for k in range(20)] + [("3", "p3"), (None, "x")]
    requests = spark.createDataFrame(rows, "key string, payload string")
    first = calls.call_all(requests, call(True), tasks=2, threads=4, timeout=0.3, attempts=2, pause=0.01).selectExpr("*", "1 AS run")
    first.write.parquet(log)
    got = {r["key"]: (r["status"], r["attempts"]) for r in spark.read.parquet(log).collect()}
    assert got == {str(k): ("failed", 2) if k % 5 == 1 else ("timed_out", 2) if k % 5 == 2 else ("ok", 1) for k in range(20)}
    again = calls.resume(requests, spark.read.parquet(log))
    assert {r["key"] for r in again.collect() if r["key"]} == {str(k) for k in range(20) if k % 5 in (1, 2)}
    calls.call_all(again, call(False), tasks=2, attempts=1).selectExpr("*", "2 AS run").write.mode("append").parquet(log)
    final = calls.latest(spark.read.parquet(log)).collect()
    assert {(r["key"], r["result"], r["run"]) for r in final} == {(str(k), f"P{k}", 2 if k % 5 in (1, 2) else 1) for k in range(20)}
