"""Prompt-context tables and answer checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vanflow.catalog import loop
from vanflow.catalog import sqlbase as sb
from vanflow.catalog import supervise as sp
from vanflow.catalog.helpers import shared
from vanflow.operators import prompts as pt
from vanflow.operators import supervision as sv
from vanflow.sources import fixtures as fx


def recs(s, d, by=fx.OF_ROUTE):
    """Recommendations whose names carry quotes, apostrophes and breaks."""
    return loop.recs(s, d, by).withColumn(
        "ItemName", F.concat(F.col("ItemName"), F.lit(' 6" Chef\'s\nchoice biscuit')))


def _stops(s, d):
    """Lines per stop, counted by hash: the largest code of a session is then sought among stops, as texts are compared by sorting."""
    return loop.sessions(s, d).groupBy("session_id", "route_code", "date", "customer_code").agg(F.count(F.lit(1)).alias("n"))


def answers(s, d):
    """One model answer per session: plain, fenced, partial or broken by day."""
    base = _stops(s, d).groupBy("session_id", "route_code", "date").agg(
        F.max("customer_code").alias("c"), F.sum("n").alias("n"))
    body = F.concat(
        F.lit('{"route_summary": "Customer-'), "c", F.lit(' led, Customer-999999 lagged", "critical_issues": ["'),
        F.col("n").cast("string"), F.lit(' lines"]}'))
    day = F.dayofmonth("date") % 4
    text = (
        F.when(day == 0, body)
        .when(day == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(day == 2, F.lit('{"route_summary": "quiet day"}'))
        .otherwise("no answer today"))
    return base.select("session_id", "route_code", text.alias("answer"))


def _parsed(s, d):
    out = pt.parse_answers(answers(s, d), "answer", "route_analysis")
    return out.select("session_id", "valid", "route_summary",
                      F.array_join("critical_issues", ";").alias("critical_issues"),
                      F.size("supervisor_priorities").alias("priorities"))


def _all_answers(s, d):
    """The answers of every layout: each field filled, fenced, only the first field, or no JSON, by day."""
    base = shared("answer-sessions", s, d, lambda: _stops(s, d).groupBy("session_id", "date").agg(
        F.max("customer_code").alias("c")))  # one reading of the sessions for all layouts
    day = F.dayofmonth("date") % 4
    rows = []
    for kind, fields in pt.ANSWERS.items():
        filled = [
            F.concat(F.lit(f'"{n}": "{n} '), "c", F.lit('"')) if t == "string"
            else F.concat(F.lit(f'"{n}": ["{n} '), "c", F.lit('", "more"]')) for n, t in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *filled), F.lit("}"))
        text = (
            F.when(day == 0, body)
            .when(day == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(day == 2, F.concat(F.lit("{"), filled[0], F.lit("}")))
            .otherwise("no answer today"))
        rows.append(base.select("session_id", F.lit(kind).alias("kind"), text.alias("answer")))
    return rows


def _all_parsed(s, d):
    """Each of the four layouts, parsed; one row per session, kind and field, its items joined."""
    out = []
    for rows, (kind, fields) in zip(_all_answers(s, d), pt.ANSWERS.items()):
        values = [
            F.struct(F.lit(n).alias("field"), (F.col(n) if t == "string" else F.array_join(n, ";")).alias("value"))
            for n, t in fields]
        parsed = pt.parse_answers(rows, "answer", kind)
        out.append(parsed.select("session_id", "kind", "valid", F.inline(F.array(*values))))
    return reduce(lambda a, b: a.unionByName(b), out)


def _scrubbed(s, d):
    known = loop.sessions(s, d).select("route_code", "customer_code")
    return pt.scrub_codes(answers(s, d), known, ["session_id"], "answer")


def _customer_prompts(s, d):
    """A customer's two tables are made and joined where the customer's lines lie."""
    by = fx.OF_CUSTOMER
    return shared("customer-prompts", s, d, lambda: pt.customer_prompts(
        sp.scores(s, d), pt.customer_history(recs(s, d, by)), pt.current_visit(loop.sessions(s, d, by))),
        lambda df: fx.cut_in_place(s, d, df))


QUERIES = {
    "P1_customer_history": lambda s, d: pt.customer_history(recs(s, d)),
    "P2_current_visit": lambda s, d: pt.current_visit(loop.sessions(s, d)),
    "P3_route_performance": lambda s, d: pt.route_performance(sp.scores(s, d)),
    "P4_van_load_status": lambda s, d: pt.van_load_status(recs(s, d)),
    "P5_recommendation_blocks": lambda s, d: pt.recommendation_blocks(recs(s, d)),
    "P6_pre_visit_facts": lambda s, d: pt.pre_visit_facts(loop.recs(s, d)),
    "P7_route_prompts": lambda s, d: pt.route_prompts(
        sv.session_summary(sp.scores(s, d)), pt.route_performance(sp.scores(s, d))),
    "P7_customer_prompts": _customer_prompts,
    "P7_planning_prompts": lambda s, d: pt.planning_prompts(recs(s, d)),
    "P7_pre_visit_prompts": lambda s, d: pt.pre_visit_prompts(loop.recs(s, d)),
    "P8_parsed_answers": _parsed,
    "P8_parsed_answers_all_layouts": _all_parsed,
    "P9_scrubbed_codes": _scrubbed,
}


def _num(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {sb.rint(x, digits)})"


def _right(x: str, w: int) -> str:
    return f"printf('%{w}s', {x})"


def _name(x: str, w: int) -> str:
    return f"printf('%-{w}s', substr(replace(replace(replace({x}, '\"', 'inch'), '''', ''), chr(10), ' '), 1, {w}))"


_RN = """rn AS (SELECT * REPLACE (ItemName || ' 6" Chef''s' || chr(10) || 'choice biscuit' AS ItemName) FROM recs)"""
_NL = "chr(10)"
_PERF = f"""pf AS (SELECT session_id, route_code, date, 'Customer | Score | Items | Actual | Recommended | Accuracy' || {_NL} ||
    string_agg(customer_code || ' | ' || {_right(_num('score', 0), 5)} || ' | ' || {_right('CAST(total_items AS VARCHAR)', 5)} || ' | '
      || {_right('CAST(total_actual AS VARCHAR)', 6)} || ' | ' || {_right('CAST(total_recommended AS VARCHAR)', 11)} || ' | '
      || {_num('CASE WHEN total_recommended > 0 THEN total_actual / total_recommended * 100 ELSE 0 END', 0)} || '%',
      {_NL} ORDER BY visit_sequence, customer_code) AS text FROM cs WHERE visited GROUP BY ALL)"""
_ANS = f"""an0 AS (SELECT session_id, route_code, date, MAX(customer_code) AS c, COUNT(*) AS n FROM sitems GROUP BY ALL),
an1 AS (SELECT *, '{{"route_summary": "Customer-' || c || ' led, Customer-999999 lagged", "critical_issues": ["' || n || ' lines"]}}' AS body FROM an0),
an AS (SELECT session_id, route_code, c, n, day(date) % 4 AS k, CASE day(date) % 4 WHEN 0 THEN body
    WHEN 1 THEN '```json' || {_NL} || body || {_NL} || '```' WHEN 2 THEN '{{"route_summary": "quiet day"}}' ELSE 'no answer today' END AS answer FROM an1)"""

_LAYOUTS = ", ".join(
    f"('{kind}', {i}, '{name}', {str(t == 'string').lower()})" for kind, fields in pt.ANSWERS.items() for i, (name, t) in enumerate(fields))

ORACLES = {
    "P1_customer_history": sb.with_(*sb.TO_RECS, _RN, """tp AS (SELECT *, row_number() OVER (PARTITION BY TrxDate, RouteCode, CustomerCode
      ORDER BY PriorityScore DESC, ItemCode) AS rk FROM rn)""") + f"""SELECT TrxDate, RouteCode, CustomerCode,
      'ItemCode | ItemName | Tier | Priority | Freq% | DaysLastBuy | CycleDays' || {_NL} || string_agg(substr(ItemCode, 1, 8) || ' | '
      || {_name('ItemName', 18)} || ' | ' || substr(Tier, 1, 3) || ' | ' || {_right(_num('PriorityScore', 1), 8)} || ' | '
      || {_right(_num('FrequencyPercent', 0), 5)} || '% | ' || {_right('CAST(DaysSinceLastPurchase AS VARCHAR)', 11)} || ' | '
      || {_right(_num('PurchaseCycleDays', 1), 9)}, {_NL} ORDER BY rk) AS text FROM tp WHERE rk <= 12 GROUP BY TrxDate, RouteCode, CustomerCode""",
    "P2_current_visit": sb.with_(*sb.TO_SESS) + f"""SELECT session_id, customer_code,
      'ItemCode | ItemName | Actual | Recommended | Accuracy' || {_NL} || string_agg(item_code || ' | ' || {_name('item_name', 20)} || ' | '
      || {_right('CAST(actual_qty AS VARCHAR)', 6)} || ' | ' || {_right('CAST(recommended_qty AS VARCHAR)', 11)} || ' | '
      || {_num('CASE WHEN recommended_qty > 0 THEN actual_qty / recommended_qty * 100 ELSE 0 END', 0)} || '%', {_NL} ORDER BY item_code)
      || {_NL} || 'TOTAL | ' || repeat(' ', 20) || ' | ' || {_right('CAST(SUM(actual_qty) AS VARCHAR)', 6)} || ' | '
      || {_right('CAST(SUM(recommended_qty) AS VARCHAR)', 11)} || ' | ' || {_num('SUM(actual_qty) / greatest(SUM(recommended_qty), 1) * 100', 0)} || '%' AS text
      FROM sitems GROUP BY session_id, customer_code""",
    "P3_route_performance": sp._O + f", {_PERF} SELECT * FROM pf",
    "P4_van_load_status": sb.with_(*sb.TO_RECS, _RN, """vl AS (SELECT TrxDate, RouteCode, ItemCode, MAX(ItemName) AS ItemName, MAX(VanLoad) AS v,
        CAST(SUM(RecommendedQuantity) AS BIGINT) AS r FROM rn GROUP BY ALL),
      vr AS (SELECT *, row_number() OVER (PARTITION BY TrxDate, RouteCode ORDER BY v DESC, ItemCode) AS rk FROM vl)""")
    + f"""SELECT TrxDate, RouteCode, 'ItemCode | ItemName | VanQty | RecQty | Status' || {_NL} || string_agg(ItemCode || ' | ' || {_name('ItemName', 20)}
      || ' | ' || {_right('CAST(v AS VARCHAR)', 6)} || ' | ' || {_right('CAST(r AS VARCHAR)', 6)} || ' | ' || CASE WHEN r = 0 THEN 'NO DEMAND'
      WHEN v >= r THEN 'OK' WHEN v >= r * 0.8 THEN 'TIGHT' ELSE 'SHORT' END, {_NL} ORDER BY rk) AS text FROM vr WHERE rk <= 15 GROUP BY TrxDate, RouteCode""",
    "P5_recommendation_blocks": sb.with_(*sb.TO_RECS, _RN, f"""ci AS (SELECT *, dense_rank() OVER (PARTITION BY TrxDate, RouteCode ORDER BY CustomerCode) AS cr,
        row_number() OVER (PARTITION BY TrxDate, RouteCode, CustomerCode ORDER BY PriorityScore DESC, ItemCode) AS rk FROM rn),
      bl AS (SELECT TrxDate, RouteCode, CustomerCode, {_NL} || '--- ' || CustomerCode || ' (' || substr(MAX(CustomerName), 1, 20) || ') ---' || {_NL}
        || 'ItemCode | ItemName | Qty | Tier | Priority | Freq% | DaysLast | Cycle' || {_NL} || string_agg(substr(ItemCode, 1, 8) || ' | ' || {_name('ItemName', 18)}
        || ' | ' || {_right('CAST(RecommendedQuantity AS VARCHAR)', 3)} || ' | ' || substr(Tier, 1, 3) || ' | ' || {_right(_num('PriorityScore', 1), 8)} || ' | '
        || {_right(_num('FrequencyPercent', 0), 5)} || '% | ' || {_right('CAST(DaysSinceLastPurchase AS VARCHAR)', 8)} || ' | '
        || {_right(_num('PurchaseCycleDays', 0), 5)}, {_NL} ORDER BY rk) AS block FROM ci WHERE cr <= 12 AND rk <= 5 GROUP BY TrxDate, RouteCode, CustomerCode)""")
    + f"SELECT TrxDate, RouteCode, string_agg(block, {_NL} ORDER BY CustomerCode) AS text FROM bl GROUP BY TrxDate, RouteCode",
    "P6_pre_visit_facts": sb.with_(*sb.TO_RECS) + f"""SELECT TrxDate, RouteCode, CustomerCode, COUNT(*) AS total_items,
      CAST(SUM(RecommendedQuantity) AS BIGINT) AS total_qty, string_agg('  Item: ' || ItemCode || ' — ' || ItemName || {_NL} || '  Recommended qty: '
      || RecommendedQuantity || ' | Tier: ' || Tier || ' | Source: ' || Source || {_NL} || '  Facts: ' || concat_ws(', ',
      'buys every ' || {_num('PurchaseCycleDays', 1)} || ' days', CASE WHEN DaysSinceLastPurchase <> 0 THEN 'last bought ' || DaysSinceLastPurchase || ' days ago' END,
      CASE WHEN FrequencyPercent <> 0 THEN 'buys this on ' || {_num('FrequencyPercent', 1)} || '% of visits' END,
      CASE WHEN TrendFactor <> 1 THEN 'trend factor ' || {_num('TrendFactor', 2)} END)
      || COALESCE({_NL} || '  Why recommended: ' || WhyItem, '') || {_NL} || '  Why this quantity: ' || WhyQuantity, {_NL} || {_NL} ORDER BY ItemCode) AS items_text,
      COALESCE(string_agg('- ' || ItemCode || ': ' || WhyItem, {_NL} ORDER BY ItemCode), 'No additional context') AS context
      FROM recs GROUP BY TrxDate, RouteCode, CustomerCode""",
    "P7_route_prompts": sp._O + f""", {_PERF} SELECT session_id, route_code, date, 'Route ' || route_code || ' on ' || CAST(date AS VARCHAR) || {_NL}
      || 'Visited ' || visited_customers || ' of ' || total_customers || ' customers (' || {_num('visited_customers / greatest(total_customers, 1) * 100', 1)} || '%).' || {_NL}
      || 'Sold ' || total_actual || ' of ' || total_recommended || ' units (' || {_num('total_actual / greatest(total_recommended, 1) * 100', 1)} || '%).' || {_NL}
      || COALESCE(text, 'No visited customer data') AS prompt FROM ssum LEFT JOIN pf USING (session_id, route_code, date)""",
    "P8_parsed_answers": sb.with_(*sb.TO_SESS, _ANS) + """SELECT session_id, k <> 3 AS valid, CASE WHEN k IN (0, 1) THEN 'Customer-' || c
      || ' led, Customer-999999 lagged' WHEN k = 2 THEN 'quiet day' ELSE '' END AS route_summary,
      CASE WHEN k IN (0, 1) THEN n || ' lines' ELSE '' END AS critical_issues, 0 AS priorities FROM an""",
    "P8_parsed_answers_all_layouts": sb.with_(*sb.TO_SESS, _ANS) + f"""SELECT session_id, kind, k <> 3 AS valid, field,
      CASE WHEN k IN (0, 1) OR k = 2 AND i = 0 THEN field || ' ' || c || CASE WHEN plain THEN '' ELSE ';more' END ELSE '' END AS value
      FROM an CROSS JOIN (VALUES {_LAYOUTS}) AS layouts(kind, i, field, plain)""",
    "P9_scrubbed_codes": sb.with_(*sb.TO_SESS, _ANS) + """SELECT session_id, replace(replace(answer, 'Customer-999999', '[customer]'),
      'Customer-' || c, c) AS answer FROM an""",
}

ORACLES |= {
    "P7_customer_prompts": sp._O + f""" SELECT session_id, route_code, date, customer_code, 'Customer ' || customer_code || ' of route ' || route_code
      || ' on ' || CAST(date AS VARCHAR) || {_NL} || 'Score ' || {_num('score', 1)} || '%, coverage ' || {_num('coverage', 1)} || '%, accuracy '
      || {_num('accuracy', 1)} || '%.' || {_NL} || 'Before this visit:' || {_NL} || COALESCE(h.text, 'No historical data') || {_NL}
      || 'This visit:' || {_NL} || COALESCE(v.text, 'No sales data') AS prompt FROM cs
      LEFT JOIN ({ORACLES["P1_customer_history"]}) AS h ON TrxDate = date AND RouteCode = route_code AND CustomerCode = customer_code
      LEFT JOIN ({ORACLES["P2_current_visit"]}) AS v USING (session_id, customer_code)""",
    "P7_planning_prompts": sb.with_(*sb.TO_RECS, """it AS (SELECT TrxDate, RouteCode, ItemCode, MAX(VanLoad) AS v, SUM(RecommendedQuantity) AS r
        FROM recs GROUP BY ALL),
      st AS (SELECT TrxDate, RouteCode, COUNT(*) FILTER (v > 0) AS n, CAST(SUM(v) AS BIGINT) AS v, CAST(SUM(r) AS BIGINT) AS r FROM it GROUP BY ALL),
      dm AS (SELECT TrxDate, RouteCode, COUNT(DISTINCT CustomerCode) AS c FROM recs GROUP BY ALL)""")
    + f"""SELECT TrxDate, RouteCode, 'Plan of route ' || RouteCode || ' on ' || CAST(TrxDate AS VARCHAR) || {_NL} || 'Van: ' || n || ' items, ' || v
      || ' units.' || {_NL} || vl.text || {_NL} || 'Demand: ' || c || ' customers, ' || r || ' units.' || {_NL} || cr.text AS prompt
      FROM st JOIN dm USING (TrxDate, RouteCode) LEFT JOIN ({ORACLES["P4_van_load_status"]}) AS vl USING (TrxDate, RouteCode)
      LEFT JOIN ({ORACLES["P5_recommendation_blocks"]}) AS cr USING (TrxDate, RouteCode)""",
    "P7_pre_visit_prompts": sb.with_(*sb.TO_RECS, "nm AS (SELECT TrxDate, RouteCode, CustomerCode, MAX(CustomerName) AS name FROM recs GROUP BY ALL)")
    + f"""SELECT TrxDate, RouteCode, CustomerCode, 'Visit to ' || CustomerCode || ' (' || COALESCE(NULLIF(name, ''), CustomerCode) || '), route '
      || RouteCode || ', on ' || CAST(TrxDate AS VARCHAR) || {_NL} || total_items || ' items, ' || total_qty || ' units.' || {_NL} || items_text || {_NL}
      || 'Reasons:' || {_NL} || context AS prompt FROM nm JOIN ({ORACLES["P6_pre_visit_facts"]}) AS f USING (TrxDate, RouteCode, CustomerCode)""",
}
