"""Queries over window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.fragments import FRAGMENTS, GROUP, HISTORY, PEERS, lag, pct_rank
from panelyard.catalog.frames import BANDS
from panelyard.catalog.registry import query
from panelyard.operators import windows as W
from panelyard.operators.aggregates import share_of_total
from panelyard.operators.ordered import Rank, add_ranks
from panelyard.plans import checks, indices, outflow, treasury
from panelyard.session import cut_lineage

KEYS = ["CERT", "REPDTE"]


@query("pct_rank_quarter", "CERT REPDTE:d UP:r DOWN:r OPEN:r",
       f"SELECT CERT, REPDTE, {pct_rank('BRO', 'REPDTE', '0.5e0')} AS UP, coalesce(1.0e0 - {pct_rank('DDT', 'REPDTE')}, 0.5e0) AS DOWN, "
       f"{pct_rank('RSSDHCR', 'REPDTE')} AS OPEN FROM v_panel")
def pct_rank_quarter(f):
    ranks = [Rank("BRO", "UP", fill=0.5), Rank("DDT", "DOWN", flip=True, fill=0.5), Rank("RSSDHCR", "OPEN")]
    return add_ranks(f.panel, ["REPDTE"], ranks, KEYS)


FRAGMENTS["v_banded"] = f"SELECT *, {PEERS} AS PEER_GROUP FROM v_panel"


@query("pct_rank_peer", "CERT REPDTE:d P:r FLIPPED:r",
       f"SELECT CERT, REPDTE, 100.0e0 * {pct_rank('BRO', GROUP, '0.5e0')} AS P, "
       f"100.0e0 * coalesce(1.0e0 - {pct_rank('RSSDHCR', GROUP)}, 0.5e0) AS FLIPPED FROM v_banded")
def pct_rank_peer(f):
    ranks = [Rank("BRO", "P", scale=100.0, fill=0.5), Rank("RSSDHCR", "FLIPPED", flip=True, scale=100.0, fill=0.5)]
    return add_ranks(indices.with_peer_group(f.panel, BANDS), ["REPDTE", "PEER_GROUP"], ranks, KEYS)


@query("pct_rank_sliced", "l_orderkey l_linenumber:i l_partkey R:r PLACE:i",
       "SELECT l_orderkey, l_linenumber, l_partkey, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) "
       "+ (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0e0) / count(*) OVER (PARTITION BY l_returnflag) AS R, "
       "rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS PLACE FROM lineitem")
def pct_rank_sliced(f):
    """Three groups that each hold a third of all lines: the form for groups of any size."""
    lines = cut_lineage(f.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
                        .withColumn("__key", F.monotonically_increasing_id()))  # generated keys are written first
    ranks = [Rank("l_quantity", "R"), Rank("l_extendedprice", "PLACE", "competition")]
    return add_ranks(lines, ["l_returnflag"], ranks, ["__key"])


@query("lag_k", "CERT REPDTE:d L1:r L4:r", f"SELECT CERT, REPDTE, {lag('DEPDOM')} AS L1, {lag('DEPDOM', 4)} AS L4 FROM v_panel")
def lag_k(f):
    return f.panel.select(*KEYS, W.lagged("DEPDOM").alias("L1"), W.lagged("DEPDOM", 4).alias("L4"))


@query("growth", "CERT REPDTE:d DEP_GROWTH_QOQ:r DEP_GROWTH_YOY:r", "v_dyn")
def growth(f):
    return f.panel.select(*KEYS, W.growth("DEPDOM").alias("DEP_GROWTH_QOQ"), W.growth("DEPDOM", 4).alias("DEP_GROWTH_YOY"))


@query("rolling_std", "CERT REPDTE:d DEP_GROWTH_VOL_4Q:r", "v_dyn")
def rolling_std(f):
    df = f.panel.select(*KEYS, W.growth("DEPDOM").alias("g"))
    return df.select(*KEYS, W.rolling_std("g").alias("DEP_GROWTH_VOL_4Q"))


@query("rolling_peak_drawdown", "CERT REPDTE:d DEP_PEAK:r DEP_DRAWDOWN_4Q:r", "v_dyn")
def rolling_peak_drawdown(f):
    return f.panel.select(*KEYS, W.rolling_peak("DEPDOM").alias("DEP_PEAK"), W.drawdown("DEPDOM").alias("DEP_DRAWDOWN_4Q"))


@query("lead_growth", "CERT REPDTE:d DEP_GROWTH_QOQ:r NEXT_DEP_GROWTH_QOQ:r", "v_next")
def lead_growth(f):
    return outflow.next_growth(f.panel)


@query("next_quarter_observed", "CERT REPDTE:d NEXT_Q_OBSERVED:b", "v_next")
def next_quarter_observed(f):
    return f.panel.select(*KEYS, W.next_quarter_observed().alias("NEXT_Q_OBSERVED"))


@query("series_change_bp", "REPDTE:d YC_2YR_QOQ_CHANGE_BP:r YC_2YR_YOY_CHANGE_BP:r YC_10Y_3M_SLOPE_BP_QOQ_CHANGE_BP:r "
       "YC_10Y_2Y_SLOPE_BP_YOY_CHANGE_BP:r", "v_regime")
def series_change_bp(f):
    return treasury.regime_by_date(f.panel, f.yields)


@query("share_of_total", "CERT REPDTE:d SHARE:r", "SELECT CERT, REPDTE, DEPDOM / sum(DEPDOM) OVER (PARTITION BY REPDTE) AS SHARE FROM v_panel")
def share(f):
    return share_of_total(f.panel, ["REPDTE"], "DEPDOM", "SHARE")


@query("latest_snapshot", "CERT REPDTE:d DEPDOM:r BRO:r",
       "SELECT CERT, REPDTE, DEPDOM, BRO FROM v_panel QUALIFY row_number() OVER (PARTITION BY CERT ORDER BY REPDTE DESC) = 1")
def latest_snapshot(f):
    return W.latest_snapshot(f.panel)


@query("competition_rank", "CERT REPDTE:d PLACE:i ENTITY_RANK:i SHARE_AT_MOST:r",
       "SELECT CERT, REPDTE, CASE WHEN BRO IS NOT NULL THEN rank() OVER (PARTITION BY REPDTE ORDER BY BRO DESC NULLS LAST) END AS PLACE, "
       "CASE WHEN BRO IS NOT NULL THEN rank() OVER (PARTITION BY REPDTE ORDER BY BRO NULLS LAST) END AS ENTITY_RANK, "
       "CASE WHEN BRO IS NOT NULL THEN count(BRO) OVER (PARTITION BY REPDTE ORDER BY BRO NULLS LAST) / count(*) OVER (PARTITION BY REPDTE) END "
       "AS SHARE_AT_MOST FROM v_panel")
def competition_rank(f):
    ranks = [Rank("BRO", "PLACE", "competition"), Rank("BRO", "ENTITY_RANK", "ascending"), Rank("BRO", "__m", "at_most")]
    ranked = add_ranks(f.panel, ["REPDTE"], ranks, KEYS)
    sizes = f.panel.groupBy("REPDTE").agg(F.count(F.lit(1)).alias("__n"))  # one row per report date
    return ranked.join(sizes, "REPDTE").withColumn("SHARE_AT_MOST", F.col("__m") / F.col("__n"))


@query("row_pair_checks", "CERT REPDTE:d CHECK",
       f"SELECT CERT, REPDTE, 'RSSDHCR_CHANGE' AS \"CHECK\" FROM (SELECT *, lag(RSSDHCR) {HISTORY} AS h FROM v_panel) WHERE RSSDHCR <> h")
def row_pair_checks(f):
    return checks.run_checks(f.panel, [checks.date_order, checks.holder_changes])


@query("keep_first_last", "o_custkey FIRST_KEY LAST_KEY LAST_PRICE",
       "SELECT o_custkey, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS FIRST_KEY, arg_max(o_orderkey, {'d': o_orderdate, "
       "'k': o_orderkey}) AS LAST_KEY, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS LAST_PRICE FROM orders GROUP BY 1")
def keep_first_last(f):
    orders = f.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    first = W.keep_first(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("FIRST_KEY"))
    last = W.keep_last(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", F.col("o_orderkey").alias("LAST_KEY"), F.col("o_totalprice").alias("LAST_PRICE"))
    return first.join(last, "o_custkey")
