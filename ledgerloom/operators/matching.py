"""Which of an order's own line items a task means.

Rules, first that applies: exactly one item carries the task's product id; the best
title overlap is at least 0.45 and leads the runner-up by at least 0.15; the order
has exactly one item; else no item.

The items of an ordinary order - ``FEW`` at most - are one row, which every task of the order reads.  An order
may also hold a third of all rows.  There nothing is gathered: ids are matched by an equi-join to counted ids, and
titles, as distinct word sets, by a similarity join with a falling threshold (``set_matching``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cells import let
from ledgerloom.functions.text import title_tokens
from ledgerloom.operators.lookups import lookup, lookup_rows, matching, unused
from ledgerloom.operators.set_matching import MIN_LEAD, MIN_SCORE, clear_winners
from ledgerloom.session import pin

ORDER_KEY = ["platform", "order_id"]
FEW = 64  # items of an order that are read as one row; more are matched by joins, with the same result


def _wish(tasks: DataFrame) -> tuple[Column, Column]:
    """The product id and the title a task gives."""
    return F.lower(F.coalesce("sku", F.lit(""))), F.coalesce(F.nullif("product_name", F.lit("")), "product_link")


def _rule(by_id: Column, by_words: Column, alone: Column) -> Column:
    return F.when(by_id, "sku").when(by_words, "title").when(alone, "single").otherwise("none")


def _in_small_orders(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """The rules for orders of at most ``FEW`` items."""
    sku, words, shown, title = (unused(c, tasks) for c in ("_sku", "_words", "_shown", "_title"))
    item = F.struct("item_index", F.lower("product_id").alias("id"), "title")

    def worded(i: Column) -> Column:
        return F.struct(i["item_index"].alias("item_index"), i["id"].alias("id"), title_tokens(i["title"]).alias("words"))

    # Words take several times the room of their title, so titles are shuffled and cut where they arrive.
    sku_of, title_of = _wish(tasks)
    asking = tasks.withColumns({sku: sku_of, title: title_of})
    found = lookup_rows(asking, items, ORDER_KEY, item, shown, lambda rows: F.transform(rows, worded))
    found = found.withColumn(words, title_tokens(F.col(title)))

    def scored(i: Column) -> Column:
        # Words are distinct, so the sizes give the union; 0 when either has none.
        both = F.size(F.col(words)) + F.size(i["words"])
        score = let(F.size(F.array_intersect(F.col(words), i["words"])), lambda common: F.when(common > 0, common / (both - common)).otherwise(F.lit(0.0)))
        return F.struct(score.alias("score"), i["item_index"].alias("item_index"))

    def answer(facts: Column) -> Column:
        hits, (best, second) = facts["hits"], (F.get(facts["best"], F.lit(n)) for n in (0, 1))
        by_id = F.size(hits) == 1
        by_words = (best["score"] >= MIN_SCORE) & (best["score"] - F.coalesce(second["score"], F.lit(0.0)) >= MIN_LEAD)
        alone = F.size(facts["best"]) == 1
        chosen = F.when(by_id, F.get(hits, F.lit(0))["item_index"]).when(by_words | alone, best["item_index"])
        return F.struct(
            chosen.alias("item_index"), _rule(by_id, by_words, alone).alias("match_rule"), F.when(~by_id & by_words, best["score"]).alias("score")
        )

    known = F.coalesce(F.col(shown), F.array().cast(found.schema[shown].dataType))
    facts = F.struct(
        F.filter(known, lambda i: (i["id"] == F.col(sku)) & (F.col(sku) != "")).alias("hits"),
        F.sort_array(F.transform(known, scored), asc=False).alias("best"),
    )
    # As a generator, so that the scores are worked out once for all columns.
    return found.select(*tasks.columns, F.inline(F.transform(F.array(facts), answer)))


def _in_large_orders(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """The rules by joins alone, for orders of more than one item.  They are applied to the distinct wishes (id and
    words) of an order; whole task rows are shuffled once, to receive the answer."""
    by_sku = (
        items.where(F.col("product_id") != "")
        .groupBy(*ORDER_KEY, F.lower("product_id").alias("sku"))
        .agg(F.count(F.lit(1)).alias("_hits"), F.min("item_index").alias("_sku_item"))
        .where("_hits = 1")
        .drop("_hits")
    )
    titles = (
        items.select(*ORDER_KEY, "item_index", title_tokens(F.col("title")).alias("tokens"))
        .groupBy(*ORDER_KEY, "tokens")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("item_index").alias("item"))
    )
    sku, words = (unused(c, tasks) for c in ("_sku", "_words"))
    sku_of, title_of = _wish(tasks)
    keyed = tasks.withColumns({sku: sku_of, words: title_tokens(title_of)})
    wishes = pin(keyed.select(*ORDER_KEY, F.col(sku).alias("sku"), F.col(words).alias("tokens")).distinct())
    by_title = clear_winners(wishes.select(*ORDER_KEY, "tokens").distinct(), titles, ORDER_KEY)
    by_title = by_title.select(*ORDER_KEY, "tokens", F.col("item").cast(items.schema["item_index"].dataType).alias("_title_item"), "score")
    found = lookup(lookup(wishes, by_sku, [*ORDER_KEY, "sku"]), by_title, [*ORDER_KEY, "tokens"])
    by_id, by_words = F.col("_sku_item").isNotNull(), F.col("_title_item").isNotNull()
    answers = found.select(
        *ORDER_KEY,
        F.col("sku").alias(sku),
        F.col("tokens").alias(words),
        F.coalesce("_sku_item", "_title_item").alias("item_index"),
        _rule(by_id, by_words, F.lit(False)).alias("match_rule"),
        F.when(~by_id, F.col("score")).alias("score"),
    )
    return lookup(keyed, answers, [*ORDER_KEY, sku, words]).drop(sku, words)


def match_line_items(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks with ``item_index``, ``match_rule`` (sku, title, single, none) and ``score``.

    ``score`` is the title overlap where that rule decided.  Two tasks may mean the
    same item.  A null platform or order is no order.
    """
    sizes = items.groupBy(*ORDER_KEY).agg(F.count(F.lit(1)).alias("_n"))
    large = pin(sizes.where(F.col("_n") > FEW).select(*ORDER_KEY))
    if large.isEmpty():
        return _in_small_orders(tasks, items)
    small = _in_small_orders(matching(tasks, large, ORDER_KEY, keep=False), matching(items, large, ORDER_KEY, keep=False))
    return small.unionByName(_in_large_orders(matching(tasks, large, ORDER_KEY), matching(items, large, ORDER_KEY)))
