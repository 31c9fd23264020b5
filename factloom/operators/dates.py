"""Dates that sentences write: the clause of a trigger, what is masked in it, and the one day that is left.

A grammar holds the words of a language as data. What only looks like a date is cut out before any is read: references to
articles; days that are enumerated; days behind "until", which end something; days of birth. All of it are functions of a
column, so sentences never leave their rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DateGrammar:
    """Words of a language, in lower case; patterns are regular expressions."""

    #: form of a month's name -> its number
    months: Mapping[str, int]
    #: references to articles of the law, whole
    reference: str
    #: words before a day that ends something, and what may stand between
    until: str
    between: str
    #: "and" or "or" between days of one month
    also: str
    #: the word "year" behind one, and what makes a day one of birth
    year: str
    birth: str
    #: words that begin another time frame in a sentence
    frame: str


#: The forms of month names, and the words around dates.
RUSSIAN = DateGrammar(
    months={
        "январь": 1, "января": 1, "янв": 1, "февраль": 2, "февраля": 2, "февр": 2, "март": 3, "марта": 3, "мар": 3, "апрель": 4, "апреля": 4, "апр": 4,
        "май": 5, "мая": 5, "июнь": 6, "июня": 6, "июн": 6, "июль": 7, "июля": 7, "июл": 7, "август": 8, "августа": 8, "авг": 8,
        "сентябрь": 9, "сентября": 9, "сент": 9, "сен": 9, "октябрь": 10, "октября": 10, "окт": 10, "ноябрь": 11, "ноября": 11, "нояб": 11, "ноя": 11,
        "декабрь": 12, "декабря": 12, "дек": 12,
    },
    reference=r"(?:ст\.|стать[ьяеию]|ч\.|п\.)\s*[0-9]+\.[0-9]+(?!\.?[0-9])|[0-9]+\.[0-9]+(?!\.?[0-9])\s*(?:к\s*оап|ук)\s*рф",
    until="до|по", between=r"конца\s+дня|включительно|исключительно|первого|второго", also="и|или", year=r"года|г\.", birth=r"рождения|г\.\s*р\.?", frame="а|но|зато|однако|сегодня|вчера|накануне",
)
ENGLISH = DateGrammar(
    months={
        "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
        "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
    },
    reference=r"(?:article|section|art\.|sec\.)\s*[0-9]+\.[0-9]+(?!\.?[0-9])",
    until="until|till", between=r"the\s+end\s+of", also="and|or", year="year", birth=r"of\s+birth", frame="but|yet|today|yesterday",
)

DAY, MONTH, YEAR = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])", "((?:19|20)[0-9]{2})"
BORDERS = r"[,;:()]|\s[—–-]\s"


def piece_at(text: Column, border: str, at: Column) -> Column:
    """struct(at, piece): of the pieces that a text falls into at (zero-width) borders, the one that holds place `at`, and where that is in it."""
    step = lambda done, piece: F.when(
        (at >= done["end"]) & (at < done["end"] + F.length(piece)), F.struct((at - done["end"]).alias("at"), piece.alias("piece"), (done["end"] + F.length(piece)).alias("end"))
    ).otherwise(F.struct(done["at"].alias("at"), done["piece"].alias("piece"), (done["end"] + F.length(piece)).alias("end")))
    return F.aggregate(F.split(text, border), F.struct(F.lit(0).alias("at"), text.alias("piece"), F.lit(0).alias("end")), step)


def clause_of(sentence: Column, at: Column, grammar: DateGrammar) -> Column:
    """The clause, in the time frame, that holds place `at` of a sentence in lower case."""
    frame = piece_at(sentence, rf"(?=(?<!\p{{L}})(?:{grammar.frame})(?!\p{{L}}))", at.cast("int"))
    return piece_at(frame["piece"], rf"(?={BORDERS})|(?<=[,;:()])|(?<=\s[—–-]\s)", frame["at"])["piece"]


def _date_pattern(grammar: DateGrammar) -> str:
    """Groups 1 to 3: day, name of the month, year; 4 to 6: the same in digits; 7 and 8: without a year."""
    names = "|".join(sorted(grammar.months, key=len, reverse=True))
    free = rf"(?<![0-9])(?<![0-9]\.)(?<!(?:^|[^\p{{L}}])(?:{grammar.until})\s{{1,3}})(?<!(?:^|[^\p{{L}}])(?:{grammar.until})\s{{1,3}}(?:{grammar.between.replace('+', '{1,3}')})\s{{1,3}})"
    words = rf"{DAY}\s+({names})\.?(?!\p{{L}})(?:\s*+{YEAR}(?:\s*(?:{grammar.year})(?!\p{{L}}))?)?+(?![0-9])(?!\s*(?:{grammar.birth}))"
    return rf"{free}(?:{words}|{DAY}\.{MONTH}\.{YEAR}(?![0-9])|{DAY}\.{MONTH}(?!\.[0-9])(?![0-9]))"


def written_date(clause: Column, published: Column, most_past_days: int, grammar: DateGrammar) -> Column:
    """The one day that a clause in lower case writes; null for none, for several, and for days that don't exist.

    Without a year it is that of publication if the day has passed by then, else the year before if that is at most
    `most_past_days` ago. The day of publication itself is never taken in place of a written one.
    """
    names = "|".join(sorted(grammar.months, key=len, reverse=True))
    plain, pattern = F.regexp_replace(clause, grammar.reference, " "), _date_pattern(grammar)
    listed = rf"(?<![0-9]){DAY}\s*(?:{grammar.also})\s+(?:\p{{L}}\s+)?{DAY}\s+(?:{names})"
    group = lambda i: F.nullif(F.regexp_extract(plain, pattern, i), F.lit(""))
    number = F.element_at(F.create_map(*[F.lit(v) for pair in grammar.months.items() for v in pair]), group(2)).cast("string")
    day_of, month, year = F.coalesce(group(1), group(4), group(7)), F.coalesce(number, group(5), group(8)), F.coalesce(group(3), group(6))
    day = lambda y: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day_of, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    on = published.cast("date")
    this, last = day(F.year(on).cast("string")), day((F.year(on) - 1).cast("string"))
    inferred = F.when(this <= on, this).when(last.isNotNull() & (F.datediff(on, last) <= most_past_days), last)
    one = (F.regexp_count(plain, F.lit(pattern)) == 1) & ~plain.rlike(listed)
    return F.when(one, F.when(year.isNotNull(), day(year)).otherwise(inferred))


def event_date(sentence: Column, trigger: Column, published: Column, most_past_days: int, grammar: DateGrammar) -> Column:
    """The day that a sentence writes for the event whose trigger begins at place `trigger` (from 0): that of its clause."""
    return written_date(clause_of(F.lower(sentence), trigger, grammar), published, most_past_days, grammar)
