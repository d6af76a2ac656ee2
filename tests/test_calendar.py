from conftest import by
from panelyard.plans.calendar import source_status, source_windows


def test_windows(spark):
    rows = source_windows(spark, "2026-03-20").collect()
    periods = {}
    for r in rows:
        periods.setdefault(r["SOURCE"], []).append(r["PERIOD"])
    assert periods["financials"][0] == "20070331" and periods["financials"][-1] == "20251231"
    assert len(periods["ffiec"]) == 24
    assert periods["sod"] == [str(y) for y in range(2010, 2025)] and periods["treasury"] == ["2022", "2023", "2024", "2025"]


def test_lags(frame):
    files = frame("SOURCE string, PATH string", [
        ("financials", "/raw/universe_financials_20240930.parquet"), ("financials", "/raw/universe_financials_20241231.parquet"),
        ("ffiec", "/raw/Call Bulk All Schedules 09302024.zip"), ("sod", "/raw/sod_2023.parquet"), ("treasury", "/raw/yields_2024.parquet"),
        ("other", "/raw/readme.txt")])
    got = by(source_status(files, "2026-03-20"), "SOURCE")
    assert {s: (r["LAG"], r["UNIT"]) for s, r in got.items() if r["STATUS"] == "OK"} == {
        "financials": (4, "Q"), "ffiec": (5, "Q"), "sod": (1, "Y"), "treasury": (1, "Y")}
    assert got["other"]["STATUS"] == "MISS" and got["financials"]["TARGET"] == "2025-12-31"
