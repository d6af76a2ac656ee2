import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import by
from panelyard import config as cfg
from panelyard.sources import archives, feeds, schedules, tables
from panelyard.sources.text_files import keyword_line_scan, read_text_files


def test_csv_and_parquet(spark, frame, tmp_path):
    df = frame("cert string, repdte date, x double", [("1", "2024-03-31", 1.5), ("2", "2024-06-30", None)])
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        tables.sink_table(df, path)
        back = tables.scan_table(spark, path)
        assert back.columns == ["CERT", "REPDTE", "X"] and back.count() == 2
    with pytest.raises(ValueError):
        tables.scan_table(spark, "t.xlsx")


def test_only_touched_partitions_are_replaced(spark, frame, tmp_path):
    path = str(tmp_path / "p.parquet")
    schema = "CERT string, REPDTE date, X double"
    tables.sink_table(frame(schema, [("1", "2024-03-31", 1.0), ("1", "2024-06-30", 2.0)]), path, ["REPDTE"])
    tables.sink_table(frame(schema, [("1", "2024-06-30", 9.0)]), path, ["REPDTE"])
    assert {str(r["REPDTE"]): r["X"] for r in spark.read.parquet(path).collect()} == {"2024-03-31": 1.0, "2024-06-30": 9.0}


def test_union_and_missing_files(spark, frame, tmp_path):
    for name, schema, rows in (("a", "CERT string, X double", [("1", 1.0)]), ("b", "cert string, y double", [("2", 2.0)])):
        tables.sink_table(frame(schema, rows), str(tmp_path / f"{name}.parquet"))
    got = by(tables.scan_tables(spark, [str(tmp_path / "b.parquet"), str(tmp_path / "a.parquet")]), "CERT")
    assert (got["1"]["X"], got["1"]["Y"], got["2"]["Y"]) == (1.0, None, 2.0)
    with pytest.raises(FileNotFoundError):
        tables.scan_tables(spark, [])
    assert tables.scan_tables(spark, [], "DATE date").count() == 0


def test_files_of_one_shape_are_one_scan(spark, frame, tmp_path):
    paths = []
    for i in range(60):
        schema = ("CERT string, X double", "cert string, y double", "CERT string, X double")[i % 3]
        paths.append(str(tmp_path / f"f{i}.{'csv' if i % 3 == 2 else 'parquet'}"))
        tables.sink_table(frame(schema, [(str(i), float(i))]), paths[-1])
    df = tables.scan_tables(spark, paths)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3
    got = by(df, "CERT")
    assert len(got) == 60 and (got["3"]["X"], got["4"]["Y"], got["5"]["X"], got["4"]["X"]) in [(3.0, 4.0, 5.0, None), ("3.0", 4.0, "5.0", None)]


def test_a_large_date_gets_several_files_and_small_ones_share_a_task(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    rows = spark.range(300_000).selectExpr("id", "uuid() AS text", "IF(id % 10 < 8, 0, id % 40) AS day")
    tables.sink_table(rows, path, ["day"], file_bytes=2 << 20)
    names = list((tmp_path / "r.parquet").glob("day=*/*.parquet"))
    per_day = {d: sum(f"day={d}" == n.parent.name for n in names) for d in (0, 9, 38)}
    assert per_day[0] >= 3 and per_day[38] == 1 and len(names) < 20, per_day
    assert spark.read.parquet(path).count() == 300_000


def test_promote_and_audit(frame):
    df = frame("a string, b string, c string", [("1", "x", "3"), (None, "2", "4")])
    assert dict(tables.promote_numeric_columns(df, ["c"]).dtypes) == {"a": "double", "b": "string", "c": "string"}
    got = by(tables.field_audit(df, ["A", "B", "Z"], ["A", "B"]), "FIELD")
    assert [(got[f]["STATUS"], got[f]["NON_NULL"]) for f in ("A", "B", "Z")] == [("returned", 1), ("returned", 2), ("unknown", 0)]
    with pytest.raises(ValueError, match="Z"):
        tables.field_audit(df, ["Z"], strict=True)


def write_zip(path, parts):
    with zipfile.ZipFile(path, "w") as archive:
        for name, lines in parts.items():
            archive.writestr(name, "\r\n".join("\t".join(cells) for cells in lines))


def test_schedules(spark, tmp_path):
    write_zip(tmp_path / "Call Bulk All Schedules 06302023.zip", {
        "Schedule RCCI 06302023(1 of 2).txt": [["IDRSSD", "RCONA570", "OTHER"], ["", "Loans to 3 months", "x"],
                                              ["10", "100", "1"], ["11", "", "2"]],
        "Schedule RCCI 06302023(2 of 2).txt": [["IDRSSD", "RCONA571", "RCONA570"], ["", "Later loans", "second"],
                                              ["10", "7.5", "999"], ["12", "bad", "5"]],
        "Schedule RCL 06302023.txt": [["IDRSSD", "RCFD3450"], ["", "Swaps"], ["10", "50"]],
    })
    lines = schedules.archive_lines(spark, str(tmp_path), cfg.REPRICING_SCHEDULES + ["Schedule RCCI"])
    assert lines.rdd.getNumPartitions() == 1  # small members share a partition
    assert schedules.archive_lines(spark, str(tmp_path), ["Schedule RCCI"], pack_bytes=0).rdd.getNumPartitions() == 2
    cells = schedules.schedule_cells(lines)
    wanted = ["RCONA570", "RCONA571"]
    got = by(schedules.schedule_table(schedules.schedule_facts(cells, wanted), wanted), "IDRSSD")
    assert {k: (r["RCONA570"], r["RCONA571"]) for k, r in got.items()} == {"10": (100.0, 7.5), "11": (None, None), "12": (None, None)}
    assert str(got["10"]["REPDTE"]) == "2023-06-30"
    labels = by(schedules.schedule_labels(cells), "CODE")
    assert labels["RCONA571"]["LABEL"] == "Later loans" and "IDRSSD" not in labels
    swaps = schedules.read_schedules(spark, str(tmp_path), cfg.DERIVATIVE_SCHEDULES, ["RCFD3450"]).collect()
    assert [(r["IDRSSD"], r["RCFD3450"]) for r in swaps] == [(10, 50.0)]


def test_schedule_lines_stay_single_rows(spark, tmp_path):
    """The wide way gives the rows of the long one; a line is one row of what is written, whatever the number of codes."""
    codes = [f"RCON{i:04d}" for i in range(12)]
    for day, third in (("06302023", "3"), ("20230930", "bad")):
        write_zip(tmp_path / f"Call Bulk {day}.zip", {
            "Schedule B(2 of 2).txt": [["IDRSSD", *codes[5:], codes[6]], ["", *["x"] * 8], ["10", *"1234567", "0.5"], ["10", *"9" * 7, "8"],
                                       ["", *"1111111", "1"], ["11", "", third]],
            "Schedule B(1 of 2).txt": [["OTHER", "IDRSSD", *codes[:6]], ["", "", *["x"] * 6], ["a", '"10"', *"123456"], ["a", "12", *"nan 1"]],
            "Schedule A.txt": [["IDRSSD", codes[11]]],
            "Schedule C.txt": [["IDRSSD", codes[0]], ["", "x"], ["13", "7"]],
        })
    patterns = ["Schedule C", "Schedule A", "Schedule B"]
    lines = schedules.archive_lines(spark, str(tmp_path), patterns)
    long = schedules.schedule_table(schedules.schedule_facts(schedules.schedule_cells(lines, codes), codes, patterns), codes)
    found = schedules.read_schedules(spark, str(tmp_path), patterns, codes)
    assert found.columns == long.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, long.collect()))
    assert schedules.schedule_rows(lines, codes, patterns).count() == 2 * (4 + 2 + 1)


def test_code_map():
    assert schedules.collect_codes({"a": {"x": "RCON1234", "y": "short"}, "b": "RCFD9999", "c": {"x": "RCON1234"}, "d": 5}) == [
        "RCON1234", "RCFD9999"]


@pytest.mark.parametrize("name, report, status, year", [
    ("/d/Call 03312025.zip", "2025-03-31", "2025-03-31", 2025), ("fin_20241231.parquet", "2024-12-31", "2024-12-31", 2024),
    ("sod_2023.parquet", None, None, 2023), ("x.txt", None, None, None)])
def test_file_dates(frame, name, report, status, year):
    row = frame("n string", [(name,)]).select(
        schedules.report_date_from_name("n"), schedules.status_date_from_name("n"), schedules.year_from_name("n")).first()
    assert [str(v) if v and i < 2 else v for i, v in enumerate(row)] == [report, status, year]


FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:d="http://schemas.example.org/d" xmlns:m="http://schemas.example.org/m">
<entry><content type="application/xml"><m:properties><d:NEW_DATE m:type="Edm.DateTime">2024-03-28T00:00:00</d:NEW_DATE>
<d:BC_1MONTH m:type="Edm.Double">4.17</d:BC_1MONTH><d:BC_10YEAR m:type="Edm.Double">3.79</d:BC_10YEAR></m:properties></content></entry></feed>"""


def test_yield_feed(spark, frame, tmp_path):
    (tmp_path / "y.xml").write_text(FEED)
    rows = [feeds.read_yield_xml(spark, str(tmp_path / "y.xml")).first(), feeds.yield_xml_rows(frame("xml string", [(FEED,)])).first()]
    for row in rows:
        assert (str(row["DATE"]), row["YC_1MO"], row["YC_10YR"], row["YC_2YR"]) == ("2024-03-28", 4.17, 3.79, None)


def test_observations(frame):
    payload = '{"observations":[{"date":"2024-01-02","value":"5.40"},{"date":"2024-01-03","value":"."},{"date":"bad","value":"1"}]}'
    got = feeds.series_observations(frame("series string, payload string", [("IORB", payload)])).orderBy("DATE").collect()
    assert [(str(r["DATE"]), r["VALUE"]) for r in got] == [("2024-01-02", 5.4), ("2024-01-03", None)]


def test_registry_layouts(frame):
    docs = ['{"fields":["cik","name","ticker"],"data":[[19617,"J","jpm"],[1,"short"]]}',
            '{"0":{"cik_str":320193,"ticker":"aapl","title":"A"},"1":{"cik_str":12345678901,"ticker":"long","title":"B"},"2":{"ticker":""}}']
    got = {r["TICKER"]: r["CIK"] for r in feeds.registry_json(frame("payload string", [(d,) for d in docs])).collect()}
    assert got == {"JPM": "0000019617", "AAPL": "0000320193", "LONG": "12345678901"}


def test_arrays_are_padded(spark):
    df = spark.range(1).select(F.struct(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit("x")).alias("b")).alias("s"))
    assert [tuple(r) for r in feeds.parallel_arrays_to_rows(df, "s").collect()] == [(1, "x"), (2, None)]


def test_filings(frame):
    rows = frame("CIK long, SEQ int, FORM string, ACCESSION string, DOCUMENT string",
                 [(7, i, form, acc, "d.htm") for i, (form, acc) in enumerate((("10-q", "0-1"), ("8-K", "0-2"), ("10-K", ""), ("10-K", "0-3-4"), ("10-K", "0-5")))])
    got = feeds.filing_filter_limit(rows, ["10-K", "10-Q"], 2, [F.col("SEQ")]).orderBy("SEQ").collect()
    assert [r["FILING_URL"].rsplit("/", 3)[1:] for r in got] == [["7", "01", "d.htm"], ["7", "034", "d.htm"]]


def test_keyword_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First line\r\n  has MATURITY here \nnone\nre.pricing")
    got = keyword_line_scan(read_text_files(spark, str(tmp_path)), ["maturity", "e.p"]).orderBy("line_number").collect()
    assert [(r["line_number"], r["snippet"]) for r in got] == [(2, "has MATURITY here"), (4, "re.pricing")]


def test_latin1_tables_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("ONE.CSV", '#ID_RSSD ,NM_LGL,X\r\n1,"Crédit, ""Sud""",5\r\n\r\n2,Müller\r\n'.encode("latin-1"))
        archive.writestr("TWO.CSV", "ID_RSSD,NM_LGL\n9,second member\n")
        archive.writestr("note.txt", "x")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:
        archive.writestr("b.csv", "ID_RSSD,Y\n3,y\n")
    df = archives.latin1_table(spark, str(tmp_path))
    got = by(df, "ID_RSSD")
    assert set(got) == {"1", "2", "3"} and got["1"]["NM_LGL"] == 'Crédit, "Sud"' and got["3"]["Y"] == "y" and got["3"]["NM_LGL"] is None
    assert got["1"]["line_number"] == 1 and got["1"][archives.MALFORMED] is None and got["2"][archives.MALFORMED] == "2,Müller"
    (tmp_path / "empty").mkdir()
    assert archives.latin1_table(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        archives.archive_lines(spark, str(tmp_path / "none")).count()


def test_written_archives_hold_their_lines_in_order(spark, tmp_path):
    rows = [(f"a{k % 3}.zip", f"p{k % 2}.txt", k, f"é line {k}") for k in range(900)]
    paths = archives.write_archives(spark.createDataFrame(rows, "archive string, part string, line_number bigint, line string").repartition(5), str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a0.zip", "a1.zip", "a2.zip"] and not list(tmp_path.glob("*.draft"))
    got = archives.archive_lines(spark, paths).collect()
    want = {}
    for archive, part, _, line in rows:
        want.setdefault((archive, part), []).append(line)
    for (archive, part), lines in want.items():
        found = sorted((r["line_number"], r["line"]) for r in got if r["path"].endswith(archive) and r["part"] == part)
        assert [line for _, line in found] == lines
