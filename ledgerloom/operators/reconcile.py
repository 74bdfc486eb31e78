"""Attaching a confirmation page's entries to the items that were submitted.

An entry belongs to an item of its order by product id; else, when its text holds
the item's title.  The first entry by position wins; of entries at one position, the
first by its values.

The entries of an ordinary page - ``FEW`` at most - are one row, which every submitted item of the order reads.  Larger
pages are never gathered; their products are matched by joins and their titles by pieces, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import LETTER_RETURN_ID, RMA_RETURN_ID, amount_in_text, flat, return_id
from ledgerloom.operators.lookups import lookup, lookup_rows, matching, unused
from ledgerloom.operators.positions import row_numbers
from ledgerloom.schemas import FAILED, PLACED, SUPPORT_NEEDED
from ledgerloom.session import pin

ORDER_KEY = ["platform", "order_id"]
FEW = 64  # entries of a page that are read as one row
PIECE_CHARS = 8
_ENTRY = ("position", "product_id", "return_id_text", "refund_text")


def _shown_text(*parts: str | Column) -> Column:
    return flat(F.concat_ws(" ", *parts))


def _entries(confirmations: DataFrame) -> DataFrame:
    text = _shown_text("title", "return_id_text", "refund_text")
    return confirmations.select(
        *ORDER_KEY, "product_id", "position", text.alias("_text"), F.struct(*_ENTRY).alias("_entry")
    )


def _pieces(text: Column, size: Column, starts: Column) -> Column:
    """Hashes of the distinct pieces of a text at the given places, each with its order, so that a piece is one number."""
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64("_order", text.substr(i, size))))


def _side_by_side(length: Column, size: Column) -> Column:
    """Places of pieces that cover a needle, the last one up to its end."""
    return F.array_append(F.sequence(F.lit(1), F.greatest(length - size, F.lit(1)), F.greatest(size, F.lit(1))), length - size + 1)


def title_candidates(anchors: DataFrame, cut: DataFrame) -> DataFrame:
    """``needle, number``: the later texts that hold the rarest piece of a needle its first such text does not answer."""
    return anchors.join(cut, "piece").where(F.col("number") > F.col("first")).select("needle", "number")


def _by_title(rest: DataFrame, entries: DataFrame) -> DataFrame:
    """The first entry whose text contains each needle: ``platform, order_id, _needle, _entry``.

    The distinct texts of an order are numbered in the order of their first entries and cut into pieces of eight
    characters (all of a shorter needle); pieces are hashed with their order and carry the text's number, not the text.
    A needle needs all of the pieces that cover it in an order, and is looked for where the *rarest* of them is: first in
    the first text that has it, which settles a needle that many texts contain, then in the others.  What meets is compared
    whole.
    """
    needles = pin(rest.select(*ORDER_KEY, "_needle").withColumn("needle", F.monotonically_increasing_id()))
    needles = needles.withColumn("_n", F.least(F.length("_needle"), F.lit(PIECE_CHARS)))
    sizes = needles.groupBy(*ORDER_KEY).agg(F.collect_set("_n").alias("_sizes"))  # at most nine
    texts = entries.groupBy(*ORDER_KEY, "_text").agg(F.min(F.struct("position", "_entry")).alias("_first"))
    in_order = [*(F.col(c) for c in ORDER_KEY), F.col("_first"), F.col("_text")]
    texts = row_numbers(lookup(texts, sizes, ORDER_KEY, "inner"), in_order, "number")
    order = F.xxhash64(*ORDER_KEY)
    asked = needles.withColumn("_order", order)
    asked = asked.withColumn("_pieces", _pieces(F.col("_needle"), F.col("_n"), _side_by_side(F.length("_needle"), F.col("_n"))))
    asked = pin(asked.select("needle", F.size("_pieces").alias("_all"), F.explode("_pieces").alias("piece")))
    sized = texts.withColumn("_order", order).withColumn("_n", F.explode("_sizes")).where(F.length("_text") >= F.col("_n"))
    everywhere = F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1)
    cut = sized.select("number", F.explode(_pieces(F.col("_text"), F.col("_n"), everywhere)).alias("piece"))
    cut = pin(cut.join(asked.select("piece"), "piece", "left_semi"))  # most pieces of a text are in no needle's cover
    directory = cut.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    rarest = F.min(F.struct("n", "piece", "first"))
    anchors = lookup(asked, directory, ["piece"], "inner").groupBy("needle", "_all").agg(F.count(F.lit(1)).alias("_met"), rarest.alias("a"))
    anchors = pin(anchors.where("_met = _all").select("needle", "a.*"))

    def holding(pairs: DataFrame) -> DataFrame:
        both = lookup(pairs, needles.select("needle", "_needle"), ["needle"], "inner")
        both = lookup(both, texts.select("number", "_text"), ["number"], "inner")
        return both.where(F.contains("_text", "_needle")).select("needle", "number")

    at_once = pin(holding(anchors.select("needle", F.col("first").alias("number"))))
    left = lookup(anchors.where("n > 1"), at_once.select("needle"), ["needle"], "left_anti")
    later = holding(title_candidates(left, cut)).groupBy("needle").agg(F.min("number").alias("number"))
    found = lookup(at_once.unionByName(later), texts.select("number", "_first"), ["number"], "inner")
    named = lookup(found, needles.select("needle", *ORDER_KEY, "_needle"), ["needle"], "inner")
    return named.select(*ORDER_KEY, "_needle", F.col("_first._entry").alias("_entry"))


def _on_small_pages(submitted: DataFrame, confirmations: DataFrame, needle: Column) -> DataFrame:
    """The answers for pages of at most ``FEW`` entries: items and entries are each shuffled whole only to meet."""
    asked, shown, by_product, by_title = (unused(c, submitted) for c in ("_asked", "_shown", "_by_product", "_by_title"))

    def entry(e: Column) -> Column:
        text = _shown_text(e["title"], e["return_id_text"], e["refund_text"])
        return F.struct(F.struct(*[e[c].alias(c) for c in _ENTRY]).alias("entry"), text.alias("text"))

    def first(rule: Callable[[Column], Column]) -> Column:
        return F.array_min(F.transform(F.filter(shown, rule), lambda e: e["entry"]))

    row = F.struct(*_ENTRY, "title")
    found = lookup_rows(submitted.withColumn(asked, needle), confirmations, ORDER_KEY, row, shown, lambda rows: F.transform(rows, entry))
    found = found.withColumn(by_product, first(lambda e: e["entry"]["product_id"] == F.col("item_product_id")))
    titled = F.when(F.col(by_product).isNull(), first(lambda e: F.contains(e["text"], F.col(asked))))
    return _answers(submitted, found.withColumn(by_title, titled), F.col(by_product), F.col(by_title), F.col(shown).isNotNull())


def _on_large_pages(submitted: DataFrame, confirmations: DataFrame, needle: Column) -> DataFrame:
    """The answers by joins alone."""
    entries = _entries(confirmations)
    first = (
        entries.where(F.col("product_id").isNotNull())
        .groupBy(*ORDER_KEY, F.col("product_id").alias("item_product_id"))
        .agg(F.min(F.struct("position", "_entry"))["_entry"].alias("_by_product"))
    )
    pages = entries.select(*ORDER_KEY, F.lit(True).alias("_page")).distinct()
    listed = lookup(submitted, first, [*ORDER_KEY, "item_product_id"])
    listed = listed.withColumn("_needle", F.when(F.col("_by_product").isNull(), needle))
    rest = listed.where(F.col("_needle").isNotNull()).select(*ORDER_KEY, "_needle").distinct()
    titled = _by_title(rest, entries).withColumnRenamed("_entry", "_by_title")
    found = lookup(lookup(listed, titled, [*ORDER_KEY, "_needle"]), pages, ORDER_KEY)
    return _answers(submitted, found, F.col("_by_product"), F.col("_by_title"), F.coalesce("_page", F.lit(False)))


def _answers(submitted: DataFrame, found: DataFrame, by_product: Column, by_title: Column, shown: Column) -> DataFrame:
    return found.select(
        *submitted.columns,
        F.coalesce(by_product, by_title).alias("entry"),
        F.when(by_product.isNotNull(), "product").when(by_title.isNotNull(), "title").alias("confirmed_by"),
        shown.alias("page_shown"),
    )


def reconcile(submitted: DataFrame, confirmations: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Add ``entry`` (struct, null when not listed), ``confirmed_by`` and ``page_shown``.

    ``submitted`` has ``platform, order_id, item_product_id, item_title``.  Titles are looked
    for whole, or by their first ``title_chars`` characters where pages cut them.
    """
    title = F.coalesce("item_title", F.lit(""))
    needle = flat(title if title_chars is None else F.substring(title, 1, title_chars))
    sizes = confirmations.groupBy(*ORDER_KEY).agg(F.count(F.lit(1)).alias("_n"))
    large = pin(sizes.where(F.col("_n") > FEW).select(*ORDER_KEY))
    if large.isEmpty():
        return _on_small_pages(submitted, confirmations, needle)
    small = [matching(side, large, ORDER_KEY, keep=False) for side in (submitted, confirmations)]
    few = _on_small_pages(*small, needle)
    return few.unionByName(_on_large_pages(*[matching(side, large, ORDER_KEY) for side in (submitted, confirmations)], needle))


def confirmed_return_id(platform: Column, text: Column) -> Column:
    return F.when(platform == "Amazon", return_id(text, RMA_RETURN_ID)).otherwise(
        return_id(text, LETTER_RETURN_ID)
    )


def confirmation_outcome(reconciled: DataFrame, flow: Column) -> DataFrame:
    """Add ``outcome``: ``struct<return_status,return_id,refund_amount,message>``."""
    placed_id = confirmed_return_id(F.col("platform"), F.col("entry.return_id_text"))
    refund = amount_in_text(F.col("entry.refund_text"))

    def outcome(status: str, message: Column, with_page: bool = False) -> Column:
        return F.struct(
            F.lit(status).alias("return_status"),
            (placed_id if with_page else F.lit(None).cast("string")).alias("return_id"),
            (refund if with_page else F.lit(None).cast("double")).alias("refund_amount"),
            message.alias("message"),
        )

    return reconciled.withColumn(
        "outcome",
        F.when(
            ~F.col("page_shown"),
            outcome(FAILED, F.concat(flow, F.lit(" return was sent, yet nothing came back to confirm it"))),
        )
        .when(
            F.col("entry").isNull(),
            outcome(
                SUPPORT_NEEDED,
                F.concat(flow, F.lit(" confirmation leaves this item out; look at the order before another try")),
            ),
        )
        .when(
            placed_id.isNull(),
            outcome(SUPPORT_NEEDED, F.lit("confirmation names the item without a return number"), with_page=True),
        )
        .otherwise(
            outcome(
                PLACED,
                F.concat(F.lit("accepted by "), F.col("platform"), F.lit(", "), flow, F.lit(" return")),
                with_page=True,
            )
        ),
    )
