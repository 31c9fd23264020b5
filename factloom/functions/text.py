"""Text and name functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """Lower case, with one spelling of ё and no white space at the ends."""
    return F.translate(F.lower(F.trim(c)), "ё", "е")


def squeeze(c: Column) -> Column:
    """Runs of white space become single spaces."""
    return F.regexp_replace(c, r"\s+", " ")


def matching_key(c: Column) -> Column:
    """A lookup key, not an identity: folded, letters and digits only."""
    return F.regexp_replace(fold(c), r"[^\p{L}0-9]", "")


def words(c: Column) -> Column:
    """Folded words of letters and digits, in order."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column, floor: int = 3) -> Column:
    """Truncation: two letters off the end, but `floor` letters stay."""
    return F.left(word, F.greatest(F.lit(floor), F.length(word) - 2))


def trigrams(c: Column) -> Column:
    """The set of trigrams of the words, each padded by two blanks before and one after."""
    padded = F.transform(words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def typo_tolerance(length: Column) -> Column:
    """Edits that count as a typo: none in short names, one from 5 letters, two from 10."""
    return F.when(length >= 10, 2).when(length >= 5, 1).otherwise(0)


def same_stem(a: Column, b: Column) -> Column:
    """Equal up to an ending: all but two letters of the shorter word in common (three at least), or at most two edits behind an equal first letter. Soft and hard signs don't count."""
    a, b = F.translate(a, "ьъ", ""), F.translate(b, "ьъ", "")
    short = F.least(F.length(a), F.length(b))
    ending = F.left(a, F.greatest(F.lit(3), short - 2)) == F.left(b, F.greatest(F.lit(3), short - 2))
    return (ending & (short >= 3)) | ((F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b, 2) >= 0))


def name_words(words: Column) -> Column:
    """Words of a name as they are compared: folded, each part of a hyphenated one by itself."""
    parts = F.flatten(F.transform(words, lambda w: F.split(F.translate(F.lower(w), "ё", "е"), "[-\\s]+")))
    return F.filter(parts, lambda w: w != "")


def equal_but_ending(a: Column, b: Column) -> Column:
    """Equal, or in common all but two letters of the shorter one, three at least."""
    short = F.least(F.length(a), F.length(b))
    kept = F.greatest(F.lit(3), short - 2)
    return (a == b) | ((short >= 3) & (F.left(a, kept) == F.left(b, kept)))


def one_letter_apart(a: Column, b: Column) -> Column:
    """Equal length and one letter respelled."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, d: n + d)
    return (F.length(a) == F.length(b)) & (differ == 1)


def age_at(birth: Column, on: Column) -> Column:
    """Whole years; a birthday on 29 February is reached on 1 March of other years."""
    return F.year(on) - F.year(birth) - (F.date_format(on, "MMdd") < F.date_format(birth, "MMdd")).cast("int")


def iso_prefix(date: Column, exact: Column) -> Column:
    """The first `exact` characters of a date string of any precision; null where it is less precise."""
    return F.when(F.length(date) >= exact, F.left(date, exact))


def numbers_not_in(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence does not hold."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"([0-9]+)"), F.lit(1))
    return F.array_except(numbers(answer), numbers(evidence))


def quote_around(text: Column, needle: Column, width: int = 160) -> Column:
    """The text around the first place of needle; null where it is not there."""
    at = F.position(needle, text)
    start = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.substring(text, start, at - start + F.length(needle) + width))
