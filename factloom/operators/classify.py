"""Rule classification of evidence: which kinds of words stand in a text, and what they amount to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_word(text: Column, stems: Sequence[str]) -> Column:
    """Some word of the text (in lower case) begins with a stem."""
    return F.regexp_like(F.lower(text), F.lit(r"(^|[^a-zà-ÿ])(" + "|".join(stems) + ")"))


def evidence(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The kinds of evidence in the text, in the lexicon's order."""
    found = F.array(*[F.when(starts_word(text, stems), kind) for kind, stems in lexicon.items()])
    return F.filter(found, lambda k: k.isNotNull())


def charge_listed(charge: Column, listed: Sequence[str], administrative: Sequence[str], mark: str) -> Column:
    """Some reference of a list split at semicolons names an article of its own code (administrative ones hold the mark)."""
    whole = lambda numbers: r"(^|[^0-9.])(" + "|".join(n.replace(".", r"\.") for n in numbers) + r")([^0-9.]|$)"
    own = lambda r: F.when(F.contains(F.lower(r), F.lit(mark)), F.regexp_like(r, F.lit(whole(administrative)))).otherwise(F.regexp_like(r, F.lit(whole(listed))))
    return F.coalesce(F.exists(F.split(charge, ";"), own), F.lit(False))


def status(kinds: Column, charge: str, has_event: Column) -> Column:
    """NON_POLITICAL without evidence; UNCERTAIN without an event of its own or with one soft sign; else POLITICAL."""
    return (
        F.when(F.size(kinds) == 0, "NON_POLITICAL")
        .when(~has_event, "UNCERTAIN")
        .when(F.array_contains(kinds, charge) | (F.size(kinds) >= 2), "POLITICAL")
        .otherwise("UNCERTAIN")
    )


def confidence(kinds: Column, charge: str, has_event: Column) -> Column:
    """0, 0.5 without an event, 0.6 for one soft sign, else 0.7 and 0.1 for each further kind up to 0.9."""
    strong = F.array_contains(kinds, charge) | (F.size(kinds) >= 2)
    return (
        F.when(F.size(kinds) == 0, 0.0)
        .when(~has_event, 0.5)
        .when(strong, F.least(F.lit(0.9), F.round(0.7 + (F.size(kinds) - 1) * 0.1, 6)))
        .otherwise(0.6)
    )
