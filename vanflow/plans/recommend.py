"""The recommendation run: all routes of a date in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.config import CLAMPS, SPLITS, Clamps, Splits
from vanflow.operators import allocate, explain, lanes, scoring
from vanflow.operators.calibration import calibrate
from vanflow.session import cut_lineage, small_side


@dataclass(frozen=True)
class Run:
    """Frames of one run, from thresholds to allocated rows."""

    calibration: DataFrame
    candidates: DataFrame
    rows: DataFrame
    allocated: DataFrame


def recommend(
    history: DataFrame,
    demand: DataFrame,
    journey: DataFrame,
    date: str,
    multipliers: DataFrame | None = None,
    done_routes: DataFrame | None = None,
    c: Clamps = CLAMPS,
    splits: Splits = SPLITS,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Run:
    """Calibrate, generate candidates in five lanes, merge, and allocate van stock.

    ``history`` holds purchases before the date. Routes in ``done_routes`` are
    skipped, as are routes without van items or planned customers. Frames that
    several lanes read are materialised once.
    """
    van = lanes.van_items(demand, date)
    targets = lanes.journey_customers(journey, date)
    if done_routes is not None:
        van = van.join(done_routes.select("RouteCode"), "RouteCode", "left_anti")
        targets = targets.join(done_routes.select("RouteCode"), "RouteCode", "left_anti")
    van = small_side(materialise(van))
    targets = small_side(
        materialise(targets.join(van.select("RouteCode").distinct(), "RouteCode", "left_semi"))
    )

    calibration = small_side(materialise(calibrate(history, c, splits, materialise)))
    planned = history.join(targets, ["RouteCode", "CustomerCode"], "left_semi")
    # stored before filtering: pushed-down filters would repeat the scoring expressions
    scored = materialise(scoring.score_pairs(planned, calibration, date, c))
    history_picks = materialise(lanes.history_lane(scored, van, c))

    large_enough = small_side(materialise(lanes.large_enough_routes(history, c)))
    comparable = history.join(large_enough, "RouteCode", "left_semi")
    weights = materialise(lanes.lookalike_weights(comparable, calibration, date))
    nearest = materialise(lanes.peers(weights, targets, calibration, c, splits))
    peer_picks = materialise(lanes.peer_lane(nearest, weights, van, calibration, c))

    means = history.groupBy(*lanes.PAIR).agg(F.avg("TotalQuantity").alias("mean_qty"))
    names = materialise(lanes.item_names(demand, history))
    basket_picks = lanes.basket_lane(
        history_picks,
        history_picks.select(*lanes.PAIR).unionByName(peer_picks.select(*lanes.PAIR)),
        lanes.confident_pairs(history, calibration, splits),
        means, van, calibration, names, c,
    )

    activity = materialise(lanes.customer_activity(history, targets, date))
    top = lanes.top_van_items(van, c.seed_top_k)
    reactivated = lanes.reactivation_lane(activity, top, calibration, c)
    seeded = lanes.seed_lane(targets, activity, top, calibration, c)

    made = history_picks
    for lane in (peer_picks, basket_picks, reactivated, seeded):
        made = made.unionByName(lane)
    candidates = explain.explain(made)
    if multipliers is not None:
        candidates = allocate.apply_feedback(candidates, multipliers)
    candidates = materialise(candidates)
    rows = allocate.shape_rows(
        allocate.merge_and_rank(candidates), calibration, names,
        lanes.customer_names(history), date, lanes.global_item_names(demand, history),
    )
    rows = materialise(rows)
    return Run(calibration, candidates, rows, allocate.allocate_van_load(rows))
