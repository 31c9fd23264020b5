"""Evidence windows, bylines and kinship on real places, against brute force and hand-written texts."""

from __future__ import annotations

import random
import re

import pytest

from factloom.operators import context
from factloom.operators import spans as S

WIDTH, BORDER = 30, "[,;:]"


def brute_windows(text, names, width):
    """Windows by their definition: every mention against every other."""
    sentences = [(m.start(), m.end()) for m in re.finditer(r"(?:[^.!?…\n]|[.!?…](?!\s))+[.!?…]?", text)]
    found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(names, text)]
    of = lambda at: next(s for s in reversed(sentences) if s[0] <= at)
    wide = {}
    for a, b, person in found:
        low, high, own = max(0, a - width), b + width, of(a)
        for oa, ob, other in found:
            if other == person:
                continue
            theirs = of(oa)
            if theirs == own:
                if oa >= b and (m := re.compile(BORDER).search(text, b, oa)):
                    high = min(high, m.start())
                elif ob <= a and (ms := list(re.compile(BORDER).finditer(text, ob, a))):
                    low = max(low, ms[-1].end())
            elif oa < a:
                low = max(low, theirs[1]) if theirs[1] > a - width else low
            else:
                high = min(high, theirs[0]) if theirs[0] < b + width else high
        wide.setdefault(person, []).append((low, high))
    out = set()
    for person, spans in wide.items():
        merged = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        out |= {(person, a, b) for a, b in merged}
    return out


def windows(spark, texts, names):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    located = lambda p: S.located(docs, "doc_id", "text", p)
    mentions = located(names).selectExpr("doc_id", "lower(surface) as person", "start", "end")
    found = context.evidence_windows(context.with_borders(mentions, located(S.SENTENCE), located(BORDER)), WIDTH).collect()
    return {i: {(r.person, r.start, r.end) for r in found if r.doc_id == i} for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["Anna", "Boris", "Clara", " and ", " went home", ", ", "; ", ". ", "! ", "\n", " x.y ", " took a long way around the lake"]) for _ in range(60)) for _ in range(12)]
    texts = [re.sub("(Anna|Boris|Clara)(?=[A-Z])", r"\1 ", t) for t in texts]
    found = windows(spark, texts, "Anna|Boris|Clara")
    assert found == {i: brute_windows(t, "Anna|Boris|Clara", WIDTH) for i, t in enumerate(texts)}


def test_a_clause_is_shared_unless_a_border_parts_it(spark):
    texts = ["Anna for theft, and Boris at a picket.", "Anna and Boris at a picket.", "Anna for theft. Boris at a picket.", "Nobody."]
    found = windows(spark, texts, "Anna|Boris")
    cut = lambda i, person: [texts[i][a:b] for p, a, b in sorted(found[i]) if p == person]
    assert cut(0, "anna") == ["Anna for theft"] and cut(0, "boris") == [" and Boris at a picket."]
    assert cut(1, "anna") == cut(1, "boris") == [texts[1]]
    assert cut(2, "anna") == ["Anna for theft."] and cut(2, "boris") == [" Boris at a picket."]
    assert found[3] == set()


def test_a_crowded_sentence_makes_no_pairs(spark):
    """3,000 names in a sentence: each meets the outermost others only, besides those in reach."""
    texts = [", ".join(f"Name{i:04}" for i in range(3000)) + "."]
    assert len(windows(spark, texts, "Name[0-9]+")[0]) == 3000


NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,2}"


@pytest.mark.parametrize(("text", "reasons"), [
    ("Дело ведёт Иван Петров. Все заочно арестованы.\nНикита Черненко", ["kept", "byline"]),
    ("Арестованы.\nВлад Никифоров, Нижний Новгород\n ", ["byline", "kept"]),
    ("По делу проходят:\nИван Иванов\nПётр Петров", ["kept", "kept"]),
    ("Арестован Пётр Петров", ["kept"]),
    ("Арестованы.\nПётр Петров и другие", ["kept"]),
    ("Он сказал «да».» \n\n\t Пётр Петрович Петров", ["byline"]),
    ("Пётр Петров", ["kept"]),
    ("Жене Владимира дали слово, Жена Владимир молчит. Мужу Наталье не дали", ["kinship", "kept", "kinship"]),
    ("Жене Столаа не дали", ["kept"]), ("", []), (None, []),
])
def test_reasons_of_mentions(spark, text, reasons):
    docs = spark.createDataFrame([(1, text), (2, "Пётр Иванов.")], "doc_id long, text string")
    given = spark.createDataFrame([("владимир",), ("наталья",), ("владимир",)], "word string")
    found = context.mention_reasons(docs, "doc_id", "text", NAME, ["жена", "жене", "мужу"], given, ["а", "я", "й", "ь"])
    rows = sorted((r.doc_id, r.place, r.reason) for r in found.collect())
    assert [r for i, _, r in rows if i == 1] == reasons and [r for i, _, r in rows if i == 2] == ["kept"]


def test_a_long_sentence_counts_where_its_mention_is_near(spark):
    """The next sentence names another person 39,000 code points on: within reach, or without one, the window stops before it."""
    rows = [(1, "a", 10, 20, 0, 50), (1, "b", 39_000, 39_010, 50, 40_000)]
    columns = "doc_id int, person string, start int, end int, s_start int, s_end int, p_start int, p_end int, n_start int, n_end int"
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], columns)
    until = lambda reach: {r.person: r.end for r in context.evidence_windows(df, 120, reach=reach).collect()}["a"]
    assert (until(None), until(50_000), until(20_000)) == (50, 50, 140)
