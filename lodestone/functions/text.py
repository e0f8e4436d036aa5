"""Text expressions over columns: tokens, translation, intent, language, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def lookup(entries: dict, key: Column, default: Column) -> Column:
    """entries[key], or default."""
    return F.coalesce(F.try_element_at(literal_map(entries), key), default)


def split_words(text: Column) -> Column:
    """Words between any white space, as they are; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return split_words(F.lower(text))


def one_space(text: Column) -> Column:
    return F.array_join(split_words(text), " ")


def truncate(text: Column, n: int = 512) -> Column:
    return F.substring(text, 1, n)


def distinct_count(words: Column) -> Column:
    return F.size(F.array_distinct(words))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def translate_words(query: Column, entries: dict[str, str] = fixed.TRANSLATIONS) -> Column:
    """Each word by the dictionary (case counts), joined by one space."""
    table = literal_map(entries)
    return F.array_join(F.transform(split_words(query), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def script_language(text: Column) -> Column:
    return F.when(text.rlike("[\\u0900-\\u097F]"), "hi").when(text.rlike("[\\u0600-\\u06FF]"), "ar").when(text.rlike("[\\u0100-\\u017F]"), "pl").otherwise("en")


def intent(query: Column, brands: tuple[str, ...]) -> Column:
    """BRAND where a known brand is part of the query, else SKU where a code is, else GENERIC."""
    sku = F.lit(False)
    for pattern in fixed.SKU_PATTERNS:
        sku = sku | query.rlike(f"(?U){pattern}")
    return F.when(contains_any(F.lower(one_space(query)), brands), "BRAND").when(sku, "SKU").otherwise("GENERIC")


def replace_in_turn(text: Column, entries: dict[str, str]) -> Column:
    for old, new in entries.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def local_title(title: Column, brand: Column, category: Column, lang: str) -> Column:
    """The title with its known words replaced in turn, or brand, category and a suffix where none is known."""
    changed = replace_in_turn(title, fixed.TITLE_WORDS[lang])
    return F.when(changed != title, changed).otherwise(F.concat_ws(" ", brand, category, F.lit(fixed.TITLE_SUFFIX[lang])))


def replace_ignoring_case(text: Column, old: Column, new: Column) -> Column:
    return F.regexp_replace(text, F.concat(F.lit("(?iu)\\Q"), old, F.lit("\\E")), new)


def swap_letters(word: Column, at: Column) -> Column:
    """Letters at (from 0) and at + 1 exchanged; words of up to three letters stay."""
    swapped = F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.lit(1)), word.substr(at + 1, F.lit(1)), word.substr(at + 3, F.length(word)))
    return F.when(F.length(word) > 3, swapped).otherwise(word)


def fill(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def title_case(text: Column) -> Column:
    return F.initcap(text)


def short_id(text: Column) -> Column:
    """Six hex digits of a hash, the same in every run."""
    return F.substring(F.md5(text), 1, 6)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", "")


def json_in_text(text: Column, schema: str) -> Column:
    """The outermost braces of a text, parsed; null where there are none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def half_even_grade(score: Column) -> Column:
    """A score in [0, 1] as a grade 0..3, halves to even."""
    return F.bround(F.least(F.greatest(3 * score, F.lit(0.0)), F.lit(3.0)))
