"""Signals: why an item is recommended and how its quantity was set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.functions.numeric import py_round
from vanflow.functions.text import fixed

SIGNAL_TYPE = "struct<kind:string,detail:string,weight:double,evidence:map<string,string>>"
SIGNALS_TYPE = f"array<{SIGNAL_TYPE}>"


def _text(value: Column) -> Column:
    return value.cast("string")


def number(value: Column, digits: int) -> Column:
    return fixed(py_round(value, digits), digits)


def percent(value: Column) -> Column:
    return F.concat(number(value * 100, 0), F.lit("%"))


def sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _text(p) for p in parts])


def signal(kind: str, detail: Column, weight: Column, **evidence: Column) -> Column:
    """One reason; null weight is read as zero."""
    pairs: list[Column] = []
    for name, value in evidence.items():
        pairs += [F.lit(name), _text(value)]
    facts = F.create_map(*pairs) if pairs else F.expr("map()")
    return F.struct(
        F.lit(kind).alias("kind"),
        detail.alias("detail"),
        F.coalesce(weight.cast("double"), F.lit(0.0)).alias("weight"),
        facts.cast("map<string,string>").alias("evidence"),
    ).cast(SIGNAL_TYPE)


def present(*signals: Column) -> Column:
    """The non-null signals, in order."""
    return F.filter(F.array(*signals), lambda s: s.isNotNull()).cast(SIGNALS_TYPE)


def no_signals() -> Column:
    return F.array().cast(SIGNALS_TYPE)


def history_signals() -> Column:
    """Reasons of a history pick, from its scored columns."""
    iv, tv, ds, cycle = (F.col(c) for c in ("item_visits", "total_visits", "days_since", "cycle_days"))
    share = iv / tv
    missed = ds / cycle - 1.0
    cv = F.greatest(F.lit(0.0), (1.0 - F.col("consistency")) / 0.7)
    usual, recent = F.col("usual_cycle"), F.col("recent_cycle")
    trend = F.col("trend_type")
    regular = F.when(
        share >= F.col("frequency_floor"),
        signal(
            "regular_buyer", sentence("Bought on ", iv, " of last ", tv, " visits."),
            F.least(F.lit(1.0), share + 0.1), item_visits=iv, total_visits=tv,
        ),
    )
    timing = F.when(
        missed >= 1.0,
        signal(
            "overdue",
            sentence(number(missed + 1.0, 1), " cycles overdue (", ds, "d since last buy)."),
            F.least(F.lit(1.0), 0.4 + 0.2 * missed),
            cycles_missed=py_round(missed, 2), days_since=ds,
        ),
    ).when(
        F.col("timing") >= 0.6,
        signal(
            "due_now", sentence("Last bought ", ds, "d ago; typical cycle is ", cycle, "d."),
            F.col("timing"), timing=py_round("timing", 3), cycle_days=cycle,
        ),
    )
    steady = F.when(
        F.col("consistency") >= 0.75,
        signal(
            "consistent_pattern",
            sentence("Very regular buying pattern (variability ", percent(cv), ")."),
            0.4 * F.col("consistency"), cv=py_round(cv, 3), consistency=py_round("consistency", 3),
        ),
    )

    def cycle_moved(kind: str, words: tuple[str, str], weight: float) -> Column:
        return signal(
            kind, sentence(words[0], usual, "d to ", recent, "d."), F.lit(weight),
            historical_cycle=usual, recent_cycle=recent, trend_factor=F.col("trend_factor"),
        )

    trending = F.when(
        trend.startswith("ACCELERATING"),
        cycle_moved("trending_up", ("Buying faster lately -- cycle shrank from ", ""), 0.4),
    ).when(
        trend.startswith("DECLINING"),
        cycle_moved("trending_down", ("Buying slower lately -- cycle grew from ", ""), 0.3),
    )
    return present(regular, timing, steady, trending)


def history_qty_signals(qty: Column) -> Column:
    weighted, trend = F.col("weighted_qty"), F.col("trend_factor")
    detail = sentence(
        "Recency-weighted avg ", number(weighted, 1), " (raw avg ", number(F.col("avg_qty"), 1),
        ") x trend ", number(trend, 2), " -> ", qty, " (clamped to perfect zone).",
    )
    return present(
        signal(
            "qty_derivation", detail, F.lit(1.0),
            raw_avg=py_round("avg_qty", 2), recency_weighted_avg=py_round("weighted_qty", 2),
            trend_factor=py_round(trend, 3), expected_actual=py_round(weighted * trend, 2),
            van_cap=F.col("van_qty"), recommended=qty,
        )
    )


def peer_signals() -> Column:
    score, buyers = F.col("peer_score"), F.col("peer_buyers")
    detail = sentence(
        "Customers with similar baskets to yours buy this item (similarity-weighted score ",
        percent(score), ", ", buyers, " peers).",
    )
    return present(
        signal(
            "lookalike_peer", detail, F.least(F.lit(1.0), score),
            similarity_score=py_round(score, 4), n_peers_considered=F.col("peers_considered"),
            n_peer_buyers=buyers, floor=py_round("score_floor", 4),
        )
    )


def peer_qty_signals() -> Column:
    median, buyers = F.col("median_qty"), F.col("peer_buyers")
    detail = sentence(
        "Similarity-weighted median qty across ", buyers, " lookalike peers is ",
        number(median, 0), " units.",
    )
    return present(
        signal(
            "qty_derivation", detail, F.lit(1.0),
            peer_weighted_median_qty=py_round(median, 2), n_peer_buyers=buyers,
            van_cap=F.col("van_qty"),
        )
    )


def basket_signals(anchor_name: Column) -> Column:
    conf = F.col("confidence")
    detail = sentence("Often bought with ", anchor_name, " (co-purchase rate ", percent(conf), ").")
    return present(
        signal("basket_complement", detail, conf, anchor=F.col("anchor"), confidence=py_round(conf, 3))
    )


def basket_qty_signals() -> Column:
    median = F.col("median_qty")
    detail = sentence("Median co-purchased quantity is ", number(median, 0), " units.")
    return present(
        signal("qty_derivation", detail, F.lit(1.0), median_qty=py_round(median, 2),
               van_cap=F.col("van_qty"))
    )


def reactivation_signals() -> Column:
    days = F.col("days_since")
    detail = sentence(
        "No visits in ", days, "d -- offering top route items to restart the relationship."
    )
    return present(signal("reactivation", detail, F.lit(1.0), days_since_any_purchase=days))


def first_visit_signals() -> Column:
    detail = F.lit("First-time customer on this route -- seeding popular van items.")
    return present(signal("first_visit", detail, F.lit(1.0)))


def seed_qty_signals(qty: Column) -> Column:
    detail = sentence("Fixed seed qty of ", qty, " for a first-time customer -- low-risk starter.")
    return present(
        signal("qty_derivation", detail, F.lit(1.0), seed_qty=qty, van_cap=F.col("van_qty"))
    )


def feedback_signal(multiplier: Column, source: Column, confidence: Column, n: Column) -> Column:
    pct = (multiplier - 1.0) * 100.0
    detail = sentence(
        F.when(pct >= 0, "Boosted").otherwise("Dampened"), " by ", number(F.abs(pct), 0),
        "% based on driver outcomes (", source, " lane, ", n, " attributed recs on this route).",
    )
    return signal(
        "feedback_adjusted", detail, py_round(F.least(F.lit(1.0), F.abs(multiplier - 1.0)), 4),
        multiplier=py_round(multiplier, 4), source=source, confidence=py_round(confidence, 4),
    )


def normalised(signals: Column) -> Column:
    """Weights scaled to sum to one and rounded to four decimals."""
    total = F.aggregate(
        signals, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), s.weight)
    )
    return F.transform(
        signals,
        lambda s: F.struct(
            s.kind.alias("kind"), s.detail.alias("detail"),
            py_round(F.when(total > 0, s.weight / total).otherwise(s.weight), 4).alias("weight"),
            s.evidence.alias("evidence"),
        ),
    )


def headline(signals: Column, k: int) -> Column:
    """Details of the k strongest signals; equal weights keep their order."""
    keyed = F.transform(
        signals,
        lambda s, i: F.struct((-s.weight).alias("w"), i.alias("i"), s.detail.alias("detail")),
    )
    top = F.slice(F.array_sort(keyed), 1, k)
    return F.array_join(F.transform(top, lambda s: s.detail), " ")


def confidence(signals: Column) -> Column:
    """Mean weight, raised when up to three signals corroborate."""
    n = F.size(signals)
    total = F.aggregate(
        signals, F.lit(0.0), lambda acc, s: acc + F.greatest(F.lit(0.0), s.weight)
    )
    boost = F.least(F.lit(1.0), F.sqrt(n / 3.0))
    value = F.least(F.lit(1.0), total / n * (0.7 + 0.3 * boost))
    return F.when((n == 0) | (total <= 0), 0.0).otherwise(py_round(value, 4))


def explain(candidates: DataFrame) -> DataFrame:
    """Turn raw item and quantity signals into the published explanation columns."""
    everything = F.concat("item_signals", "qty_signals")
    return candidates.withColumns(
        {
            "signals": normalised(everything),
            "why_item": headline(F.col("item_signals"), 2),
            "why_quantity": headline(F.col("qty_signals"), 1),
            "confidence": confidence(everything),
        }
    ).drop("item_signals", "qty_signals")
