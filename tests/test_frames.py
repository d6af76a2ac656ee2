import datetime

from conftest import by
from panelyard.catalog.frames import Frames

LINE = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def lines(spark, path):
    day = datetime.datetime(2000, 5, 1)
    rows = [(1, 1, 7, 1, 10.0, 100.0, 0.0, 0.05, "R", "F", day), (2, 1, 7, 2, 20.0, 50.0, 0.1, 0.0, "A", "F", day),
            (3, 1, 8, 3, 30.0, None, 0.0, 0.0, "N", "O", day), (4, 1, None, 4, 5.0, 1.0, 0.0, 0.0, "N", "O", None)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{path}/lineitem.parquet")
    return Frames(spark, str(path))


def below_the_shuffle(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    return plan[plan.index("Exchange"):]


def test_narrow_lines_are_sent_and_summed_once(spark, tmp_path):
    df = lines(spark, tmp_path).financials
    assert "Aggregate" not in below_the_shuffle(df)
    got = by(df, "__s")
    assert (got["7"]["DEPDOM"], got["7"]["ASSET"], got["7"]["DEPUNA"], got["7"]["RSSDHCR"]) == (150.0, 155.0, 100.0, 2)
    assert (got["8"]["DEPDOM"], got["8"]["DEPUNA"], got["None"]["DEPDOM"], got["None"]["REPDTE"]) == (None, 0.0, 1.0, None)


def test_codes_of_a_filer_come_with_one_shuffle(spark, tmp_path):
    frames = lines(spark, tmp_path)
    df, lines_again = frames.codes(["A", "B"]), frames.codes(["A", "B"])
    assert sorted((str(r["IDRSSD"]), r["CODE"], r["VALUE"]) for r in df.collect()) == [
        ("7", "A", 50.0), ("7", "B", 100.0), ("8", "B", None), ("None", "B", 1.0)]
    assert "Aggregate" not in below_the_shuffle(lines_again.groupBy("IDRSSD", "REPDTE").count())
