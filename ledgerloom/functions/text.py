"""Column expressions over links, titles and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.cells import let, strip
from ledgerloom.schemas import (
    HEADER_ALIASES,
    REFUSAL_PHRASES,
    SUPPORT_NEEDED,
    TITLE_STOP_WORDS,
)

# The shapes of links, ids and amounts.
URL = r"(?U)https?://[^\s\"'<>]+"
TRAILING_PUNCTUATION = r"[.,);]+$"
PRODUCT_ID = r"(?i)[?&]pid=([A-Za-z0-9]+)"
SLUG = r"(?i)https?://[^/]+/(?:dl/)?([a-z0-9-]{6,})/p/"
LETTER_RETURN_ID = r"(?i)([A-Z]{2}\d{10,})"
RMA_RETURN_ID = r"([A-Z0-9]{6,}-?[A-Z0-9]*)"
AMOUNT = r"([0-9][0-9,]*(?:\.\d{1,2})?)"
# A run of three or more letters and digits that is not all digits.
TITLE_WORD = r"(?<![a-z0-9])(?![0-9]+(?![a-z0-9]))[a-z0-9]{3,}"


def header_key(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), r"[^a-z0-9]", "")


def header_field(header: Column) -> Column:
    """The canonical field a header cell names, else null."""
    pairs = [F.lit(part) for field, names in HEADER_ALIASES.items() for name in names for part in (name, field)]
    return F.try_element_at(F.create_map(*pairs), header_key(header))


def urls(text: Column) -> Column:
    """Every URL in the text, in order, without closing punctuation."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0)),
        lambda u: F.regexp_replace(u, TRAILING_PUNCTUATION, ""),
    )


def product_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, PRODUCT_ID, 1), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise the first letter of every run of letters (``35l bag`` is ``35L Bag``)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def slug_name(link: Column) -> Column:
    """A readable product name from the link's slug; '' when it has none."""
    return title_case(F.replace(F.regexp_extract(link, SLUG, 1), F.lit("-"), F.lit(" ")))


def slug(name: Column, length: int | None = None) -> Column:
    """Lower-case letters and digits only; the first ``length`` of them if given."""
    whole = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return whole if length is None else F.substring(whole, 1, length)


def products(cell: Column, name_chars: int | None = None) -> Column:
    """The distinct products of a cell as ``array<struct<link,pid,name>>``.

    A product is known by its id, or by its link when it has none; the first
    mention wins.  Text without any link is one product known by name only (its first
    ``name_chars`` characters if given), and a blank cell has no products.
    """
    def pid(link: Column) -> Column:
        return F.regexp_extract(link, PRODUCT_ID, 1)

    def key(link: Column) -> Column:
        # Bound to a name: a nullif inside a lambda would look for the id twice.
        return let(pid(link), lambda found: F.when(found == "", link).otherwise(found))

    def first_of_each(links: Column) -> Column:
        return F.when(F.size(links) == 1, links).otherwise(
            let(
                F.transform(links, key),
                lambda keys: F.filter(links, lambda u, i: F.array_position(keys, F.get(keys, i)) == i + 1),
            )
        )

    def product(link: Column) -> Column:
        return F.struct(link.alias("link"), pid(link).alias("pid"), slug_name(link).alias("name"))

    def named_only(text: Column) -> Column:
        name = text if name_chars is None else F.substring(text, 1, name_chars)
        return F.when(
            text != "", F.array(F.struct(F.lit("").alias("link"), F.lit("").alias("pid"), name.alias("name")))
        )

    return let(
        urls(cell),
        lambda links: F.coalesce(
            F.when(F.size(links) == 0, let(strip(F.coalesce(cell, F.lit(""))), named_only)),
            F.transform(first_of_each(links), product),
        ),
    )


def title_tokens(title: Column) -> Column:
    """The distinct informative words of a title, sorted, so equal sets are equal arrays."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(TITLE_WORD), F.lit(0))
    return F.sort_array(F.array_except(words, F.array(*[F.lit(w) for w in TITLE_STOP_WORDS])))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def refusal_status(note: Column, more: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The return status a platform's refusal text stands for; rules in order.

    ``more`` adds lower-case phrases to a status's own; they are asked for in its turn.
    """
    text = F.lower(F.coalesce(note, F.lit("")))
    if unknown := set(more or {}) - set(REFUSAL_PHRASES):
        raise ValueError(f"no refusal status: {', '.join(sorted(unknown))}")

    status = F.lit(SUPPORT_NEEDED)
    for meaning, phrases in reversed(REFUSAL_PHRASES.items()):
        hit = text.rlike("|".join(phrases))
        for phrase in (more or {}).get(meaning, ()):
            hit = hit | F.contains(text, F.lit(phrase))
        status = F.when(hit, meaning).otherwise(status)
    return status


def amount_in_text(text: Column) -> Column:
    """The first number in the text, thousands commas allowed."""
    number = F.regexp_extract(F.translate(text, "₹", ""), AMOUNT, 1)
    return F.translate(number, ",", "").try_cast("double")


def return_id(text: Column, pattern: str) -> Column:
    """The id of the given shape, else the text itself; null when blank."""
    text = strip(text)
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), text), F.lit(""))


def flat(text: Column) -> Column:
    """Lower case with runs of white space collapsed, as a page's text is compared."""
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))
