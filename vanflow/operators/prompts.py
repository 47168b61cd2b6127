"""Text tables that give a language model its context, and the checks on its answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.config import PROMPTS, PromptLimits
from vanflow.functions.numeric import first_ranked, py_round
from vanflow.functions.text import fixed, prompt_safe

VISIT = ["TrxDate", "RouteCode", "CustomerCode"]

# answer layouts: text fields default to "", lists to empty
ANSWERS = {
    "customer_analysis": (
        ("customer_code", "string"), ("performance_summary", "string"),
        ("supervisor_instructions", "array<string>"), ("strengths", "array<string>"),
        ("weaknesses", "array<string>"),
    ),
    "route_analysis": (
        ("route_code", "string"), ("route_summary", "string"),
        ("supervisor_priorities", "array<string>"),
        ("high_performers_with_practices", "array<string>"), ("critical_issues", "array<string>"),
    ),
    "planning_insights": (
        ("route_summary", "string"), ("priority_customers", "array<string>"),
        ("van_load_alerts", "array<string>"), ("opportunities", "array<string>"),
        ("quick_tips", "array<string>"),
    ),
    "pre_visit_briefing": (
        ("briefing", "string"), ("key_items", "array<string>"), ("heads_up", "string"),
    ),
}

ROUTE_TEMPLATE = (
    "Route {route_code} on {date}\n"
    "Visited {visited_customers} of {total_customers} customers ({coverage_percentage:.1f}%).\n"
    "Sold {total_actual} of {total_recommended} units ({quantity_achievement:.1f}%).\n"
    "{actual_data}"
)

CUSTOMER_TEMPLATE = (
    "Customer {customer_code} of route {route_code} on {date}\n"
    "Score {score:.1f}%, coverage {coverage:.1f}%, accuracy {accuracy:.1f}%.\n"
    "Before this visit:\n{history}\n"
    "This visit:\n{visit}"
)

PLANNING_TEMPLATE = (
    "Plan of route {route_code} on {date}\n"
    "Van: {van_items} items, {van_quantity} units.\n{van_load}\n"
    "Demand: {total_customers} customers, {total_recommended} units.\n{recommendations}"
)

PRE_VISIT_TEMPLATE = (
    "Visit to {customer_code} ({customer_name}), route {route_code}, on {date}\n"
    "{total_items} items, {total_quantity} units.\n{items}\n"
    "Reasons:\n{context}"
)


def left(text: Column, width: int) -> Column:
    """A text, padded behind, without a formatter as in `right`."""
    shown = F.coalesce(text, F.lit("null"))
    return F.rpad(shown, F.greatest(F.length(shown), F.lit(width)), F.lit(" "))


def right(text: Column, width: int) -> Column:
    """A number's text, padded; a formatter costs many times as much a cell."""
    shown = F.coalesce(text, F.lit("null"))
    return F.lpad(shown, F.greatest(F.length(shown), F.lit(width)), F.lit(" "))


def rounded_text(value: Column, digits: int) -> Column:
    """Half-even decimal text; zeros may be signed and, like other values a decimal cannot show, go through the formatter."""
    number = py_round(value, digits)
    plain = number.cast(f"decimal(18,{digits})").cast("string")
    return F.when((number > 0) & (number < 1e15), plain).otherwise(fixed(number, digits))


def name_cell(c: str, width: int) -> Column:
    return left(F.substring(prompt_safe(F.col(c)), 1, width), width)


def joined_lines(df: DataFrame, keys: Sequence[str], order: Sequence[Column], line: Column) -> DataFrame:
    """Lines of a group in order, one text per group; groups are capped by their table's limit."""
    point = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], line.alias("line"))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda p: p.line), "\n")
        .alias("lines")
    )


def _with_header(df: DataFrame, keys: Sequence[str], header: str, name: str = "text") -> DataFrame:
    return df.select(*keys, F.concat(F.lit(header + "\n"), "lines").alias(name))


def customer_history(recs: DataFrame, limits: PromptLimits = PROMPTS) -> DataFrame:
    """A customer's strongest items."""
    order = [F.desc("PriorityScore"), F.asc("ItemCode")]
    top = first_ranked(recs, VISIT, order, limits.items_per_customer)
    line = F.concat_ws(
        " | ",
        F.substring("ItemCode", 1, 8), name_cell("ItemName", 18),
        F.substring(F.coalesce("Tier", F.lit("N/A")), 1, 3),
        right(rounded_text(F.col("PriorityScore"), 1), 8),
        F.concat(right(rounded_text(F.col("FrequencyPercent"), 0), 5), F.lit("%")),
        right(F.col("DaysSinceLastPurchase").cast("string"), 11),
        right(rounded_text(F.col("PurchaseCycleDays"), 1), 9),
    )
    lines = joined_lines(top, VISIT, [F.col("_rank")], line)
    return _with_header(
        lines, VISIT, "ItemCode | ItemName | Tier | Priority | Freq% | DaysLastBuy | CycleDays"
    )


def _accuracy(actual: Column, recommended: Column) -> Column:
    pct = F.when(recommended > 0, actual / recommended * 100).otherwise(0.0)
    return F.concat(rounded_text(pct, 0), F.lit("%"))


def current_visit(items: DataFrame) -> DataFrame:
    """Sold against recommended per item, closed by a total."""
    keys = ["session_id", "customer_code"]
    act, rec = F.col("actual_qty"), F.col("recommended_qty")
    cell = lambda c, w: right(c.cast("string"), w)
    line = F.concat_ws(
        " | ", F.col("item_code"), name_cell("item_name", 20), cell(act, 6), cell(rec, 11),
        _accuracy(act, rec),
    )
    body = items.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("item_code", line.alias("line")))),
                lambda p: p.line,
            ), "\n",
        ).alias("lines"),
        F.sum("actual_qty").alias("a"), F.sum("recommended_qty").alias("r"),
    )
    share = F.col("a") / F.greatest(F.col("r"), F.lit(1)) * 100
    total = F.concat_ws(
        " | ", F.lit("TOTAL"), F.lit(" " * 20), cell(F.col("a"), 6), cell(F.col("r"), 11),
        F.concat(rounded_text(share, 0), F.lit("%")),
    )
    header = F.lit("ItemCode | ItemName | Actual | Recommended | Accuracy")
    return body.select(*keys, F.concat_ws("\n", header, "lines", total).alias("text"))


def route_performance(scores: DataFrame) -> DataFrame:
    """One line per visited customer, in visit order."""
    keys = ["session_id", "route_code", "date"]
    cell = lambda c, w: right(F.col(c).cast("string"), w)
    line = F.concat_ws(
        " | ", F.col("customer_code"), right(rounded_text(F.col("score"), 0), 5),
        cell("total_items", 5), cell("total_actual", 6), cell("total_recommended", 11),
        _accuracy(F.col("total_actual"), F.col("total_recommended")),
    )
    lines = joined_lines(
        scores.filter("visited"), keys, [F.col("visit_sequence"), F.col("customer_code")], line
    )
    return _with_header(lines, keys, "Customer | Score | Items | Actual | Recommended | Accuracy")


def van_load_lines(recs: DataFrame) -> DataFrame:
    """Van and recommended quantity per item with its supply status."""
    per = recs.groupBy("TrxDate", "RouteCode", "ItemCode").agg(
        F.max("ItemName").alias("ItemName"), F.max("VanLoad").alias("van_qty"),
        F.sum("RecommendedQuantity").alias("rec_qty"),
    )
    van, rec = F.col("van_qty"), F.col("rec_qty")
    status = (
        F.when(rec == 0, "NO DEMAND").when(van >= rec, "OK").when(van >= rec * 0.8, "TIGHT")
        .otherwise("SHORT")
    )
    return per.withColumn("status", status)


def van_load_status(recs: DataFrame, limits: PromptLimits = PROMPTS) -> DataFrame:
    keys = ["TrxDate", "RouteCode"]
    order = [F.desc("van_qty"), F.asc("ItemCode")]
    top = first_ranked(van_load_lines(recs), keys, order, limits.van_items)
    line = F.concat_ws(
        " | ", F.col("ItemCode"), name_cell("ItemName", 20),
        right(F.col("van_qty").cast("string"), 6), right(F.col("rec_qty").cast("string"), 6), "status",
    )
    lines = joined_lines(top, keys, [F.col("_rank")], line)
    return _with_header(lines, keys, "ItemCode | ItemName | VanQty | RecQty | Status")


def recommendation_blocks(recs: DataFrame, limits: PromptLimits = PROMPTS) -> DataFrame:
    """Blocks of the route's first customers with their strongest items."""
    keys = ["TrxDate", "RouteCode"]
    customers = recs.select(*VISIT).distinct()
    first = first_ranked(customers, keys, [F.asc("CustomerCode")], limits.customers, "_c")
    top = first_ranked(
        recs.join(first.select(*VISIT), VISIT, "left_semi"), VISIT,
        [F.desc("PriorityScore"), F.asc("ItemCode")], limits.items_per_block,
    )
    line = F.concat_ws(
        " | ",
        F.substring("ItemCode", 1, 8), name_cell("ItemName", 18),
        right(F.col("RecommendedQuantity").cast("string"), 3), F.substring("Tier", 1, 3),
        right(rounded_text(F.col("PriorityScore"), 1), 8),
        F.concat(right(rounded_text(F.col("FrequencyPercent"), 0), 5), F.lit("%")),
        right(F.col("DaysSinceLastPurchase").cast("string"), 8),
        right(rounded_text(F.col("PurchaseCycleDays"), 0), 5),
    )
    named = top.groupBy(*VISIT).agg(F.max("CustomerName").alias("CustomerName"))
    blocks = joined_lines(top, VISIT, [F.col("_rank")], line).join(named, VISIT)
    title = F.concat(
        F.lit("\n--- "), "CustomerCode", F.lit(" ("),
        F.substring(prompt_safe(F.col("CustomerName")), 1, 20), F.lit(") ---"),
    )
    header = F.lit("ItemCode | ItemName | Qty | Tier | Priority | Freq% | DaysLast | Cycle")
    block = F.concat_ws("\n", title, header, "lines")
    return joined_lines(blocks, keys, [F.col("CustomerCode")], block).withColumnRenamed("lines", "text")


def pre_visit_facts(recs: DataFrame) -> DataFrame:
    """Item facts of a visit; parts without a value are left out."""
    def fact(c: str, text: Column) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col(c) != 0), text)

    s = lambda c: F.col(c).cast("string")
    facts = F.concat_ws(
        ", ",
        fact("PurchaseCycleDays", F.concat(F.lit("buys every "), s("PurchaseCycleDays"), F.lit(" days"))),
        fact("DaysSinceLastPurchase",
             F.concat(F.lit("last bought "), s("DaysSinceLastPurchase"), F.lit(" days ago"))),
        fact("FrequencyPercent",
             F.concat(F.lit("buys this on "), s("FrequencyPercent"), F.lit("% of visits"))),
        F.when(F.col("TrendFactor") != 1.0, F.concat(F.lit("trend factor "), s("TrendFactor"))),
    )
    def optional(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    block = F.concat_ws(
        "\n",
        F.concat(F.lit("  Item: "), "ItemCode", F.lit(" — "), F.coalesce("ItemName", F.lit(""))),
        F.concat(F.lit("  Recommended qty: "), s("RecommendedQuantity"), F.lit(" | Tier: "), "Tier",
                 F.lit(" | Source: "), "Source"),
        optional("  Facts: ", facts),
        optional("  Why recommended: ", F.col("WhyItem")),
        optional("  Why this quantity: ", F.col("WhyQuantity")),
    )
    reason = F.when(
        F.coalesce("WhyItem", F.lit("")) != "", F.concat(F.lit("- "), "ItemCode", F.lit(": "), "WhyItem")
    )
    rows = F.array_sort(F.collect_list(F.struct("ItemCode", block.alias("block"), reason.alias("why"))))
    grouped = recs.groupBy(*VISIT).agg(
        rows.alias("_r"), F.sum("RecommendedQuantity").alias("total_qty"),
        F.count(F.lit(1)).alias("total_items"),
    )
    context = F.array_join(F.filter(F.transform("_r", lambda r: r.why), lambda w: w.isNotNull()), "\n")
    return grouped.select(
        *VISIT, "total_items", "total_qty",
        F.array_join(F.transform("_r", lambda r: r.block), "\n\n").alias("items_text"),
        F.when(context == "", "No additional context").otherwise(context).alias("context"),
    )


_PLACEHOLDER = re.compile(r"\{(\w+)(?::\.(\d)f)?\}")


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` and ``{name:.Nf}`` placeholders from columns."""
    parts: list[Column] = []
    at = 0
    for match in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[at:match.start()]))
        value = values[match.group(1)]
        digits = match.group(2)
        text = rounded_text(value, int(digits)) if digits else value.cast("string")
        parts.append(F.coalesce(text, F.lit("")))
        at = match.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def route_prompts(summary: DataFrame, performance: DataFrame, template: str = ROUTE_TEMPLATE) -> DataFrame:
    """Route analysis prompt per session."""
    keys = ["session_id", "route_code", "date"]
    joined = summary.join(performance, keys, "left")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)) * 100
    values = {
        "route_code": F.col("route_code"), "date": F.col("date"),
        "visited_customers": F.col("visited_customers"), "total_customers": F.col("total_customers"),
        "coverage_percentage": share("visited_customers", "total_customers"),
        "total_actual": F.col("total_actual"), "total_recommended": F.col("total_recommended"),
        "quantity_achievement": share("total_actual", "total_recommended"),
        "actual_data": F.coalesce("text", F.lit("No visited customer data")),
    }
    return joined.select(*keys, render(template, values).alias("prompt"))


def customer_prompts(
    scores: DataFrame, history: DataFrame, visits: DataFrame, template: str = CUSTOMER_TEMPLATE
) -> DataFrame:
    """Customer analysis prompt per session and customer, visited or not.

    ``history`` is keyed by date, route and customer, ``visits`` by session and
    customer; each has one ``text`` a key, a missing one is named as such.
    """
    keys = ["session_id", "route_code", "date", "customer_code"]
    before = history.select(
        F.col("TrxDate").alias("date"), F.col("RouteCode").alias("route_code"),
        F.col("CustomerCode").alias("customer_code"), F.col("text").alias("_history"))
    now = visits.select("session_id", "customer_code", F.col("text").alias("_visit"))
    joined = scores.select(*keys, "score", "coverage", "accuracy").join(
        before, ["date", "route_code", "customer_code"], "left").join(now, ["session_id", "customer_code"], "left")
    values = {c: F.col(c) for c in ("customer_code", "route_code", "date", "score", "coverage", "accuracy")}
    values["history"] = F.coalesce("_history", F.lit("No historical data"))
    values["visit"] = F.coalesce("_visit", F.lit("No sales data"))
    return joined.select(*keys, render(template, values).alias("prompt"))


def planning_prompts(
    recs: DataFrame, template: str = PLANNING_TEMPLATE, limits: PromptLimits = PROMPTS
) -> DataFrame:
    """Planning prompt per route and day: van stock against demand, and the customers' strongest items.

    Totals cover all items and customers; the two tables are cut to their limits.
    """
    keys = ["TrxDate", "RouteCode"]
    stock = van_load_lines(recs).groupBy(*keys).agg(
        F.sum((F.col("van_qty") > 0).cast("int")).alias("van_items"), F.sum("van_qty").alias("van_quantity"),
        F.sum("rec_qty").alias("total_recommended"))
    demand = recs.groupBy(*keys).agg(F.countDistinct("CustomerCode").alias("total_customers"))
    joined = (
        stock.join(demand, keys)
        .join(van_load_status(recs, limits).withColumnRenamed("text", "van_load"), keys, "left")
        .join(recommendation_blocks(recs, limits).withColumnRenamed("text", "recommendations"), keys, "left"))
    names = ("van_items", "van_quantity", "van_load", "total_customers", "total_recommended", "recommendations")
    values = {"route_code": F.col("RouteCode"), "date": F.col("TrxDate")} | {c: F.col(c) for c in names}
    return joined.select(*keys, render(template, values).alias("prompt"))


def pre_visit_prompts(recs: DataFrame, template: str = PRE_VISIT_TEMPLATE) -> DataFrame:
    """Briefing prompt per planned visit; a customer without a name goes by its code."""
    names = recs.groupBy(*VISIT).agg(F.max("CustomerName").alias("_name"))
    joined = pre_visit_facts(recs).join(names, VISIT)
    named = F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col("CustomerCode"))
    values = {
        "customer_code": F.col("CustomerCode"), "customer_name": named, "route_code": F.col("RouteCode"),
        "date": F.col("TrxDate"), "total_items": F.col("total_items"), "total_quantity": F.col("total_qty"),
        "items": F.col("items_text"), "context": F.col("context"),
    }
    return joined.select(*VISIT, render(template, values).alias("prompt"))


def strip_fences(text: Column) -> Column:
    """Drop code-fence lines from answers that open with one."""
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(trimmed, r"(?m)^[ \t]*```[^\n]*(\n|$)", "")
    return F.when(trimmed.startswith("```"), bare).otherwise(trimmed)


def parse_answers(df: DataFrame, text_col: str, kind: str) -> DataFrame:
    """Answers as typed columns; missing fields take their defaults.

    ``valid`` is false where the text is not a JSON object.
    """
    fields = ANSWERS[kind]
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    body = strip_fences(F.col(text_col))
    parsed = df.withColumn("_a", F.from_json(body, f"{schema}, _bad string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    ok = F.col("_a._bad").isNull() & F.col("_a").isNotNull() & body.startswith("{")
    return parsed.select(
        *df.columns, ok.alias("valid"),
        *[F.coalesce(F.col(f"_a.{n}"), empty[t]).alias(n if n not in df.columns else f"answer_{n}")
          for n, t in fields],
    )


def scrub_codes(
    df: DataFrame, known: DataFrame, id_cols: Sequence[str], text_col: str,
    scope: Sequence[str] = ("route_code",),
) -> DataFrame:
    """Replace ``Customer-<n>`` by n where the scope knows it, else by [customer].

    ``known`` holds (scope..., customer_code). Mentions are looked up by join and
    the text is put together again from its pieces.
    """
    pattern = r"Customer-(\d+)"
    pieces = df.select(
        *id_cols, *[c for c in scope if c not in id_cols], text_col,
        F.split(text_col, pattern).alias("_pieces"),
        F.regexp_extract_all(text_col, F.lit(pattern), 1).alias("_codes"),
    )
    mentions = pieces.select(
        *id_cols, *[c for c in scope if c not in id_cols],
        F.posexplode("_codes").alias("_pos", "_code"),
    )
    codes = known.select(*scope, F.col("customer_code").alias("_code")).distinct().withColumn(
        "_known", F.lit(True)
    )
    resolved = mentions.join(codes, [*scope, "_code"], "left").groupBy(*id_cols).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "_pos", F.when(F.col("_known"), F.col("_code")).otherwise("[customer]").alias("r")))),
            lambda p: p.r,
        ).alias("_new")
    )
    rebuilt = F.array_join(
        F.transform(
            "_pieces", lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit("")))
        ), "",
    )
    return pieces.join(resolved, list(id_cols), "left").select(
        *id_cols, F.when(F.col("_new").isNull(), F.col(text_col)).otherwise(rebuilt).alias(text_col)
    )

