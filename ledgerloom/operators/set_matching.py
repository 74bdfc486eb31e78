"""The clear winner among many word sets, by a similarity join whose threshold falls.

For a needle set only two things matter: which set overlaps with it most (Jaccard, ``MIN_SCORE`` at least), and
whether any other comes within ``MIN_LEAD`` of that.  So needles are first searched at a high threshold, where a set
is found by its one or two rarest words.  A best score b leaves one question, asked in the next round: is there
another set above b - ``MIN_LEAD``?  Needles that found nothing go on to the next threshold.  Thresholds are at most
``MIN_LEAD`` apart, so two sets found in one search round are too close together, and their needle is done.

What keeps a group with N sets that share most of their words from N x N candidates:

* Words are taken rarest first: by how many pairs of needle and set they are common to.  Words on one side only can
  never meet; they are counted, not kept, and sets that then look alike are one.
* Where a word stands in a set bounds the overlap of a pair that meets in it, so a needle asks for a word only
  in sets of those sizes and at those places that can still reach its threshold (positional filter).  What sizes and
  places there are is in a directory, one row per word.
* The directory names two sets for every size and place.  They are compared before all others: if they are already
  too close together for any set to lead, the needle is done, however many sets tie with them.

Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookups import lookup
from ledgerloom.session import pin

MIN_SCORE = 0.45
MIN_LEAD = 0.15
SEARCHES = (0.85, 0.70, 0.55, MIN_SCORE)  # at most MIN_LEAD apart
LOWEST = MIN_SCORE - MIN_LEAD
SLACK = 1e-9  # rounding can only admit more candidates
WITNESSES = 4


def _least_overlap(t: Column, size: Column, other: Column) -> Column:
    return F.ceil(t / (1 + t) * (size + other) - SLACK)


def _prefix(t: Column, size: Column) -> Column:
    """How many of its rarest words a set of this size must be filed under to be found at threshold ``t``."""
    return size - F.ceil(t * size - SLACK) + 1


def _common_words(needles: DataFrame, sets: DataFrame, group: list[str]) -> DataFrame:
    """``group, word, pairs``: the words that both sides of a group have, and in how many pairs."""

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.select(*group, F.explode("tokens").alias("word")).groupBy(*group, "word").agg(F.count(F.lit(1)).alias(name))

    both = counted(needles, "_left").join(counted(sets, "_right"), [*group, "word"])
    return both.select(*group, "word", (F.col("_left") * F.col("_right")).alias("pairs"))


def _ordered(sets: DataFrame, common: DataFrame, group: list[str]) -> DataFrame:
    """Add ``words``, the common words rarest first, and ``size``; sets without a common word are left out."""
    words = sets.select(*group, "id", F.explode("tokens").alias("word"))
    in_order = F.sort_array(F.collect_list(F.struct("pairs", "word")))
    kept = lookup(words, common, [*group, "word"], "inner").groupBy("id").agg(F.transform(in_order, lambda w: w["word"]).alias("words"))
    return lookup(sets, kept, ["id"], "inner").withColumn("size", F.size("tokens")).drop("tokens")


def _places(size: Column, words: Column) -> Column:
    """Where its common words stand in a set, from 1; the others come first."""
    return F.transform(words, lambda w, n: F.struct(w.alias("word"), (size - F.size(words) + n + 1).alias("at")))


def _filed(sets: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The sets by ``group, word, size, at``, and the directory: per word the sizes and places there are."""
    placed = sets.select(*group, "id", "size", F.explode(_places(F.col("size"), F.col("words"))).alias("p")).select(*group, "id", "size", "p.*")
    filed = pin(placed.where(F.col("at") <= _prefix(F.lit(LOWEST - SLACK), F.col("size"))))
    at_place = filed.groupBy(*group, "word", "size", "at").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("one"), F.max("id").alias("two")
    )
    entry = F.struct("size", "at", "n", "one", "two")
    return filed, pin(at_place.groupBy(*group, "word").agg(F.collect_list(entry).alias("entries")))


def _asked(needles: DataFrame, directory: DataFrame, group: list[str]) -> DataFrame:
    """``group, id, word, e``: where each needle has to look for sets that reach its ``threshold``."""
    t, size = F.col("threshold"), F.col("size")
    places = F.filter(_places(size, F.col("words")), lambda p: p["at"] <= _prefix(t, size))
    probes = needles.select(*group, "id", "size", "threshold", F.explode(places).alias("p")).select(*group, "id", "size", "threshold", "p.*")

    def can_reach(e: Column) -> Column:
        most = 1 + F.least(size - F.col("at"), e["size"] - e["at"])
        return (e["at"] <= _prefix(t, e["size"])) & (most >= _least_overlap(t, size, e["size"]))

    found = lookup(probes, directory, [*group, "word"], "inner")
    return found.select(*group, "id", "word", F.explode(F.filter("entries", can_reach)).alias("e"))


def _scored(pairs: DataFrame, needles: DataFrame, sets: DataFrame) -> DataFrame:
    """``id, other, score, copies, item`` of pairs ``id, other``."""
    left = needles.select("id", F.col("words").alias("_words"), F.col("size").alias("_size"))
    right = sets.select(F.col("id").alias("other"), F.col("words").alias("_others"), F.col("size").alias("_others_size"), "copies", "item")
    both = lookup(lookup(pairs, left, ["id"], "inner"), right, ["other"], "inner")
    common = F.size(F.array_intersect("_words", "_others"))
    return both.select("id", "other", (common / (F.col("_size") + F.col("_others_size") - common)).alias("score"), "copies", "item")


def candidates(asked: DataFrame, filed: DataFrame, group: list[str]) -> DataFrame:
    """``id, other``: the pairs that meet where they were asked for; a pair may meet in several words."""
    where = asked.select(*group, "id", "word", F.col("e.size").alias("size"), F.col("e.at").alias("at"))
    there = filed.withColumnRenamed("id", "other")
    return where.join(there, [*group, "word", "size", "at"]).select("id", "other")


def _best_two(scored: DataFrame) -> DataFrame:
    """``id, best, second``: structs of score, set, copies and item."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    ranked = scored.withColumn("_place", F.row_number().over(order)).where("_place <= 2")
    one = F.struct("score", "other", "copies", "item")
    return ranked.groupBy("id").agg(
        F.max(F.when(F.col("_place") == 1, one)).alias("best"), F.max(F.when(F.col("_place") == 2, F.col("score"))).alias("second")
    )


def _too_close(needles: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
    """``id`` of needles that have no clear winner by the sets the directory names alone."""
    many = asked.groupBy("id").agg(F.sum("e.n").alias("_n")).where(F.col("_n") > WITNESSES)
    named = F.explode(F.array("e.one", "e.two"))
    shown = lookup(asked, many, ["id"], "inner").select("id", named.alias("other"), "e.size", "e.at").groupBy("id", "other").agg(F.max("at").alias("at"))
    # The places with most words after them first, so that what is shown can overlap most.
    first = Window.partitionBy("id").orderBy("at", "other")
    few = shown.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= WITNESSES).select("id", "other")
    scored = lookup(_scored(few, needles, sets), needles.select("id", "best", "ceiling"), ["id"], "inner")
    # No set is above the ceiling: two within the lead of it, or one within the lead of the best, settle it.
    known = F.col("best").isNotNull()
    close = F.when(known, (F.col("other") != F.col("best.other")) & (F.col("best.score") - F.col("score") < MIN_LEAD))
    close = close.otherwise(F.col("ceiling") - F.col("score") < MIN_LEAD - SLACK)
    counts = scored.where(close).groupBy("id", known.alias("_known")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= F.when(F.col("_known"), 1).otherwise(2)).select("id")


def clear_winners(needles: DataFrame, sets: DataFrame, group: list[str]) -> DataFrame:
    """``group, tokens, item, score`` of the needles that have a clear winner.

    ``needles`` has distinct ``group, tokens``; ``sets`` also ``copies`` (rows with these words) and ``item``.  A winner
    has one copy, a score of ``MIN_SCORE`` or more and ``MIN_LEAD`` or more before any other set of its group.
    """
    needles = pin(needles.select(*group, "tokens").withColumn("id", F.monotonically_increasing_id()))
    sets = sets.select(*group, "tokens", F.col("copies").cast("bigint").alias("copies"), F.col("item").cast("bigint").alias("item"))
    sets = pin(sets.withColumn("id", F.monotonically_increasing_id()))
    common = pin(_common_words(needles, sets, group))
    alike = [*group, "words", "size"]
    ordered = pin(_ordered(needles, common, group))
    sets = pin(
        _ordered(sets, common, group).groupBy(*alike).agg(F.min("id").alias("id"), F.sum("copies").alias("copies"), F.min("item").alias("item"))
    )
    filed, directory = _filed(sets, group)
    nothing = F.lit(None).cast("struct<score:double,other:bigint,copies:bigint,item:bigint>")
    waiting = pin(ordered.groupBy(*alike).agg(F.min("id").alias("id")).withColumn("best", nothing))
    won = waiting.where("false").select(*alike, "best")
    ceiling = 1.0
    for floor in (*SEARCHES, None):
        searching = F.col("best").isNull()
        if floor is None:
            waiting = waiting.where(~searching)
        threshold = F.when(searching, F.lit(floor)).otherwise(F.col("best.score") - MIN_LEAD) - SLACK
        asking = waiting.withColumn("threshold", threshold).withColumn("ceiling", F.lit(ceiling))
        asked = pin(_asked(asking, directory, group))
        done = pin(_too_close(asking, asked, sets))
        left = lookup(asked, done, ["id"], "left_anti")
        pairs = candidates(left, filed, group).distinct()
        found = _best_two(_scored(_others_than_best(pairs, asking), asking, sets))
        seen = lookup(lookup(asking, done, ["id"], "left_anti"), found.withColumnsRenamed({"best": "_found", "second": "_second"}), ["id"])
        found_score, least = F.col("_found.score"), MIN_SCORE if floor is None else floor
        leads = F.col("_found.score").isNull() | (F.col("best.score") - found_score >= MIN_LEAD)
        checked = seen.where(~searching & leads).select("id", *alike, "best", F.lit(True).alias("_won"))
        above = F.coalesce(found_score >= least - SLACK, F.lit(False))
        alone = (F.col("_found.copies") == 1) & (F.col("_second").isNull() | (found_score - F.col("_second") >= MIN_LEAD))
        open_ = seen.where(searching & (~above | (alone & (found_score >= MIN_SCORE))))
        # All that reach this round's threshold have been seen; no other can come near a best so far above it.
        far = above & (found_score - MIN_LEAD >= least)
        searched = open_.select("id", *alike, F.when(above, F.col("_found")).alias("best"), far.alias("_won"))
        after = pin(checked.unionByName(searched))
        won = won.unionByName(after.where("_won").select(*alike, "best"))
        waiting = after.where("not _won").drop("_won")
        ceiling = least
    winners = lookup(ordered, won, alike, "inner").select("id", F.col("best.item").alias("item"), F.col("best.score").alias("score"))
    return lookup(needles, winners, ["id"], "inner").select(*group, "tokens", "item", "score")


def _others_than_best(pairs: DataFrame, needles: DataFrame) -> DataFrame:
    known = needles.where(F.col("best").isNotNull()).select("id", F.col("best.other").alias("_best"))
    return lookup(pairs, known, ["id"]).where(F.col("_best").isNull() | (F.col("other") != F.col("_best"))).select("id", "other")
