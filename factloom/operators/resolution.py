"""Entity resolution: blocking, component comparison, additive score and decision, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.storage import materialize

#: Fixed values of the additive score.
SURNAME = {"exact": 0.45, "typo": 0.30}
GIVEN = {"exact": 0.30, "typo": 0.20, "initial": 0.08}
PATRONYMIC = {"exact": 0.20, "typo": 0.12, "initial": 0.05, "missing": 0.05}
EXACT_FORM, COMPLETE_FORM, ORDER_PENALTY, CONFLICT_CAP = 0.05, 0.85, 0.05, 0.25
#: Fixed values of the decision.
AUTO, REVIEW, MARGIN = 0.85, 0.40, 0.10


def compare(a: Column, b: Column) -> Column:
    """exact, typo, initial, mismatch or missing: how two parts of a name agree. A part of one letter is an initial."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    typo = F.levenshtein(a, b) <= X.typo_tolerance(F.greatest(F.length(a), F.length(b)))
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    return (
        F.when(a.isNull() | b.isNull(), "missing")
        .when(initial, F.when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), "initial").otherwise("mismatch"))
        .when(a == b, "exact")
        .when(typo, "typo")
        .otherwise("mismatch")
    )


def _points(match: Column, table: dict[str, float]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(match == name, value) if out is None else out.when(match == name, value)
    return out.otherwise(0.0)


def score(surname: Column, given: Column, patronymic: Column, exact_form: Column, complete: Column, order_differs: Column) -> Column:
    """Points of the parts and of an equal form; an equal complete form is worth 0.85 at least; conflicts cap at 0.25."""
    value = _points(surname, SURNAME) + _points(given, GIVEN) + _points(patronymic, PATRONYMIC) + F.when(exact_form, EXACT_FORM).otherwise(0.0)
    value = F.when(exact_form & complete, F.greatest(value, F.lit(COMPLETE_FORM))).otherwise(value)
    value = value - F.when(order_differs, ORDER_PENALTY).otherwise(0.0)
    conflict = (surname == "mismatch") | (given == "mismatch") | (patronymic == "mismatch")
    value = F.when(conflict, F.least(value, F.lit(CONFLICT_CAP))).otherwise(value)
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4)


#: What a review says where nothing but the name speaks for its best candidate.
NAME_ONLY = "name only evidence"


def decide(scored: DataFrame, key: str, candidate: str, value: str, conflict: str, full: str, proven: str | None = None) -> DataFrame:
    """One row for each key of `scored` (key, candidate or null, value, conflict, full identity): action, selected, margin, plausible.

    No plausible candidate creates an entity where the name is a full identity, and is reviewed otherwise. A strong
    candidate is linked where no other is near it in score or strong as well, and the name is a full identity. proven: a
    column that says whether more than the name speaks for a candidate (all parts of it, the article, the case); where it is
    given, the best candidate needs that too, and `best` names it.
    """
    plausible = F.col(candidate).isNotNull() & ~F.col(conflict) & (F.col(value) >= REVIEW)
    ordered = F.row_number().over(Window.partitionBy(key).orderBy(F.when(plausible, F.col(value)).desc_nulls_last(), candidate))
    best = scored.withColumn("_ok", plausible).withColumn("_r", ordered)
    first = lambda n: F.max(F.when((F.col("_r") == n) & F.col("_ok"), F.col(value)))
    one = best.groupBy(key).agg(
        first(1).alias("_top"),
        first(2).alias("_second"),
        F.max(F.when((F.col("_r") == 1) & F.col("_ok"), F.col(candidate))).alias("_chosen"),
        F.count_if(F.col("_ok")).alias("plausible"),
        F.count_if(F.col("_ok") & (F.col(value) >= AUTO)).alias("_strong"),
        F.bool_and(F.col(full)).alias("_full"),
        F.coalesce(F.bool_or((F.col("_r") == 1) & F.col("_ok") & F.col(proven)), F.lit(False)).alias("_proven") if proven else F.lit(True).alias("_proven"),
    )
    margin = F.round(F.col("_top") - F.coalesce("_second", F.lit(0.0)), 4)
    near = (margin <= MARGIN) & (F.col("plausible") > 1)
    told = (
        ("no plausible candidate", F.col("plausible") == 0), ("incomplete name", ~F.col("_full")), ("low score", F.col("_top") < AUTO),
        ("small margin", near), ("several strong candidates", F.col("_strong") > 1),
        (NAME_ONLY, (F.col("plausible") > 0) & ~F.col("_proven")),
    )
    reasons = F.array_compact(F.array(*[F.when(when, name) for name, when in told]))
    action = (
        F.when(F.col("plausible") == 0, F.when(F.col("_full"), "CREATE_NEW").otherwise("REVIEW"))
        .when((F.col("_top") < AUTO) | near | (F.col("_strong") > 1) | ~F.col("_full") | ~F.col("_proven"), "REVIEW")
        .otherwise("AUTO_LINK")
    )
    return one.select(key, action.alias("action"), F.when(action == "AUTO_LINK", F.col("_chosen")).alias("selected"), margin.alias("margin"), "plausible", F.array_join(reasons, "; ").alias("reasons"), *([F.col("_chosen").alias("best")] if proven else []))


def redecide(decisions: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """The reviews that new evidence settles or changes, as decide would give them with it.

    decisions: as decide gives them with `proven`. told: key, candidate, for which more than the name speaks since then
    (repeats count once). Only reviews for want of such evidence, of the keys told, are looked at: new evidence changes
    nothing in other decisions, and none of these but that reason.
    """
    news = told.select(key, F.col("candidate").alias("best")).distinct()
    asked = decisions.filter((F.col("action") == "REVIEW") & F.contains("reasons", F.lit(NAME_ONLY))).join(news, [key, "best"], "left_semi")
    rest = F.filter(F.split("reasons", "; "), lambda r: r != NAME_ONLY)
    action = F.when(F.size(rest) == 0, "AUTO_LINK").otherwise("REVIEW")
    return asked.select(key, action.alias("action"), F.when(F.size(rest) == 0, F.col("best")).alias("selected"), "margin", "plausible", F.array_join(rest, "; ").alias("reasons"), "best")


#: Letters up to which words meet by what deletions leave of them, and longer ones by whole pieces.
DELETED = 24


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y) of the distinct words left.x and right.y that are equal or a typo apart (typo_tolerance of the longer one).

    Words of up to DELETED letters meet where they are equal after as many deletions on either side as their tolerance, which
    so many edits always are; longer ones by typo_partners, whose pieces of them are long. Short words have no typos.
    """
    left, right = left.select("x").distinct(), right.select("y").distinct()
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))

    def deleted(df: DataFrame, c: str) -> DataFrame:
        size = F.length(c)  # a word of 5 letters may be one of 4 with a typo, one of 10 one of 8 with two
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of words become many rows
        one = df.filter(size.between(4, DELETED)).repartition(tasks, c).withColumn("d", without(F.col(c)))
        two = F.when(size >= 8, F.flatten(F.transform("d", without))).otherwise(F.array().cast("array<string>"))
        return one.select(c, F.explode(F.array_distinct(F.transform(F.concat(F.array(c), "d", two), lambda w: F.xxhash64(w)))).alias("k"))

    met = deleted(left, "x").join(deleted(right, "y"), "k").select("x", "y").filter("x <> y")
    long = typo_partners(left.filter(F.length("x") > DELETED - 2), right.filter(F.length("y") > DELETED - 2), 2).select("x", "y")
    near = met.union(long).filter(F.levenshtein("x", "y") <= X.typo_tolerance(F.greatest(F.length("x"), F.length("y")))).distinct()
    return near.filter("x <> y").union(left.join(right, F.col("x") == F.col("y")).select("x", "y"))


_PARTS = ("given", "surname", "patronymic")
_KNOWN = tuple(f"k_{c}" for c in _PARTS)


def _compared(pairs: DataFrame) -> DataFrame:
    """pairs (parts, k_parts) with m_parts, exact_form, conflict and score."""
    compared = pairs.withColumns({f"m_{c}": compare(F.col(c), F.col(f"k_{c}")) for c in _PARTS})
    exact = F.array_join(F.array(*_PARTS), " ") == F.array_join(F.array(*_KNOWN), " ")
    complete = (F.length("given") > 1) & (F.length("surname") > 1) & (F.length("patronymic") > 1)
    compared = compared.withColumns({"exact_form": exact, "conflict": (F.col("m_surname") == "mismatch") | (F.col("m_given") == "mismatch") | (F.col("m_patronymic") == "mismatch")})
    return compared.withColumn("score", score(F.col("m_surname"), F.col("m_given"), F.col("m_patronymic"), F.col("exact_form"), complete, F.lit(False)))


def _key(*c: str) -> Column:
    return F.array_join(F.sort_array(F.array(*c)), " ")


def _better(incoming: DataFrame, known: DataFrame, surnames: DataFrame, limit: int) -> DataFrame:
    """(parts, person, k_parts): what may stand before the mass of a block (a surname near, an initial) in a name's candidates.

    Such pairs agree in more than the block, so they meet on that: words in the given name and in the third part, whose
    pairs are told once for all names. Where a part of one letter, or none, agrees with more than words near it, the group
    that it agrees with gives its `limit` least persons: all of the group score as much at least, so no other is needed.
    """
    known = known.withColumns({"third": F.coalesce("k_patronymic", F.lit("")), "letter": F.left("k_patronymic", F.lit(1))})
    asked = incoming.withColumn("p", F.coalesce("patronymic", F.lit("")))
    words = {}
    for c, theirs in (("given", "k_given"), ("p", "third")):  # an initial, and a third part that isn't told, agree as well
        mine, others = asked.select(F.col(c).alias("x")).distinct(), known.select(F.col(theirs).alias("y")).distinct()
        more = mine.filter(F.length("x") > 1).withColumn("y", F.left("x", F.lit(1))).unionByName(mine.withColumn("y", F.lit("")))
        words[c] = materialize(near_words(mine, others).union(more.join(others.filter(F.length("y") <= 1), "y", "left_semi").select("x", "y")).distinct(), f"near-{c}").select(F.col("x").alias(c), F.col("y").alias(theirs))
    short = lambda c: F.length(c) <= 1

    def least(names: DataFrame, keys: list[str]) -> DataFrame:
        """names with the `limit` least persons of their group."""
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("person"))
        group = known.join(names.select(*keys).distinct(), keys, "left_semi").withColumn("_r", order).filter(F.col("_r") <= limit)
        return names.join(group.select(*{*keys, "person", *_KNOWN}), keys)

    # first the pairs of given name and surname that are there, for those asked for
    two = asked.filter(~short("given")).select("given", "surname").distinct()
    met = two.join(surnames, "surname").join(words["given"], "given").filter(F.left("given", F.lit(1)) == F.left("k_given", F.lit(1)))
    met = materialize(met.join(known.select("k_given", "k_surname").distinct(), ["k_given", "k_surname"], "left_semi"), "near-names")
    of_two = asked.join(met, ["given", "surname"])
    in_block = asked.filter(short("given") | short("surname")).join(surnames, "surname").withColumn("initial", F.left("given", F.lit(1)))
    initial, untold = (F.length("p") == 1), F.col("p") == ""
    name, block = ["k_surname", "k_given"], ["k_surname", "initial"]
    found = [
        of_two.join(words["p"], "p").join(known, [*name, "third"]),
        least(of_two.filter(initial).withColumn("letter", F.col("p")), [*name, "letter"]),
        least(of_two.filter(untold | short("surname")), name),
        least(in_block.join(words["p"], "p"), [*block, "third"]),
        least(in_block.filter(initial).withColumn("letter", F.col("p")), [*block, "letter"]),
        least(in_block.filter(untold), block),
    ]
    columns = [*_PARTS, "person", *_KNOWN]
    out = found[0].select(*columns)
    for df in found[1:]:
        out = out.unionByName(df.select(*columns))
    return out


def candidates(incoming: DataFrame, known: DataFrame, limit: int = 30, plausible: bool = False) -> DataFrame:
    """The best `limit` known names (person, k_given, k_surname, k_patronymic) of each incoming name (given, surname, patronymic).

    Two generators are merged: names of equal words in whatever order (an equal key), and names whose surname is equal or
    a typo apart under the same given initial. A pair counts once, with both sources. Both sides are distinct names, so
    that a name of many mentions meets the others once. The second generator's block isn't paired out: names that agree in
    more than the block are found by that (_better), and of the others, which score alike, a block's `limit` least persons
    do for all of its names. They join as one array for each block. plausible: of these, only candidates that a decision may
    be about (no conflict, REVIEW at least), which come before all others.
    """
    surname_of = lambda df, c: df.select(F.col(c).alias("x" if c == "surname" else "y"))
    incoming = incoming.select(*_PARTS).distinct()
    known = known.select("person", *_KNOWN).withColumn("initial", F.left("k_given", F.lit(1)))
    surnames = materialize(near_words(surname_of(incoming, "surname"), surname_of(known, "k_surname")).select(F.col("x").alias("surname"), F.col("y").alias("k_surname")), "near-surnames")
    by_key = incoming.withColumn("key", _key(*_PARTS)).join(known.withColumn("key", _key(*_KNOWN)), "key").select(*_PARTS, "person", *_KNOWN)
    met = _compared(by_key.unionByName(_better(incoming, known, surnames, limit)).repartition(*[F.col(c) for c in _PARTS]).distinct())
    ranked = F.row_number().over(Window.partitionBy(*_PARTS).orderBy(F.col("score").desc(), "person"))
    same = F.coalesce(_key(*_PARTS) == _key(*_KNOWN), F.lit(False))
    near = F.coalesce((F.left("given", F.lit(1)) == F.left("k_given", F.lit(1))) & (F.levenshtein("surname", "k_surname") <= X.typo_tolerance(F.greatest(F.length("surname"), F.length("k_surname")))), F.lit(False))
    sources = F.concat_ws("+", F.when(same, "key"), F.when(near, "name"))
    if plausible:
        return met.withColumn("_r", ranked).filter((F.col("_r") <= limit) & ~F.col("conflict") & (F.col("score") >= REVIEW)).drop("_r").withColumn("sources", sources)
    pair = F.struct((-F.col("score")).alias("under"), "person", *_KNOWN)
    listed = met.withColumn("_r", ranked).filter(F.col("_r") <= limit).groupBy(*_PARTS).agg(F.collect_list(pair).alias("found"))

    by_person = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("person"))
    block = known.withColumn("_r", by_person("k_surname", "initial")).filter(F.col("_r") <= limit).drop("_r")
    asked = incoming.select("surname", F.left("given", F.lit(1)).alias("initial")).distinct().join(surnames, "surname").join(block, ["k_surname", "initial"])
    # a surname a typo apart scores like an equal one where the others differ: conflicts are capped below both
    mass = asked.withColumn("_r", by_person("surname", "initial")).filter(F.col("_r") <= limit).groupBy("surname", "initial").agg(F.collect_list(F.struct("person", *_KNOWN)).alias("mass"))

    own = listed.select(*[F.col(c).alias(f"l_{c}") for c in _PARTS], "found")
    every = incoming.join(own, F.expr(" and ".join(f"{c} <=> l_{c}" for c in _PARTS)), "left").select(*_PARTS, "found", F.left("given", F.lit(1)).alias("initial"))
    every = every.join(mass, ["surname", "initial"], "left")
    match = {c: lambda k, c=c: compare(F.col(c), k[f"k_{c}"]) for c in _PARTS}
    value = lambda k: score(match["surname"](k), match["given"](k), match["patronymic"](k), F.lit(False), F.lit(False), F.lit(False))
    none = lambda c: F.coalesce(c, F.array())
    persons = F.transform(none("found"), lambda k: k["person"])
    rest = F.filter(none("mass"), lambda k: ~F.array_contains(persons, k["person"]))
    valued = lambda v: F.transform(rest, lambda k: F.struct((-v(k)).alias("under"), k["person"].alias("person"), *[k[c].alias(c) for c in _KNOWN]))
    # whole names are in conflict with all that isn't found: the surname alone is worth more than the cap
    whole = (F.length("surname") > 1) & (F.length("given") > 1) & (F.coalesce("patronymic", F.lit("")) != "")
    scored = F.when(whole, valued(lambda k: F.lit(CONFLICT_CAP))).otherwise(valued(value))
    best = every.select(*_PARTS, F.explode(F.slice(F.sort_array(F.concat(none("found"), scored)), 1, limit)).alias("c")).select(*_PARTS, "c.person", *[f"c.{c}" for c in _KNOWN])
    return _compared(best).withColumn("sources", sources)


def trigram_pairs(names: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """Pairs x < y of names whose trigram sets have a Jaccard similarity of `least` or more: (x, y, similarity).

    An inverted index on trigrams finds them: a name enters by its rarest size - ceil(least * size) + 1 trigrams only, which
    no similar pair escapes. Trigrams that most names have come last in that order, so names don't meet on them.
    """
    sets = names.select(F.col(key).alias("k"), F.array_sort(X.trigrams(F.col(name))).alias("t")).filter(F.size("t") > 0)
    each = sets.select("k", F.explode("t").alias("g"))
    rarity = each.groupBy("g").agg(F.count("*").alias("n"))
    ordered = each.join(rarity, "g").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("t"))
    front = ordered.select("k", F.explode(F.slice("t.g", F.lit(1), (F.size("t") - F.ceil(F.size("t") * least - 1e-9) + 1).cast("int"))).alias("g"))
    other = front.select(F.col("k").alias("k2"), "g")
    met = front.join(other, "g").filter("k < k2").select("k", "k2").distinct()
    both = met.join(sets, "k").join(sets.select(F.col("k").alias("k2"), F.col("t").alias("t2")), "k2")
    return both.select(F.col("k").alias("x"), F.col("k2").alias("y"), F.round(X.jaccard(F.col("t"), F.col("t2")), 6).alias("similarity")).filter(F.col("similarity") >= least)


def typo_partners(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Pairs (x, y) of words (left.x, right.y) at most `most` edits apart, over blocks of equal pieces.

    A word cut into most + 1 pieces keeps one piece whole under `most` edits, so pairs meet on (piece, its number) at a
    shift of at most `most` places: an equi-join on pieces, then the distance.
    """
    parts = most + 1
    size = lambda c: F.floor(F.length(c) / parts)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(
            i.alias("i"),
            F.substring(F.col("x"), (i * size(F.col("x")) + 1).cast("int"), F.when(i == most, F.length("x")).otherwise(size(F.col("x"))).cast("int")).alias("s"),
            F.length("x").alias("n"),
        ),
    )
    a = left.select("x", F.explode(pieces).alias("p")).select("x", "p.i", "p.s", "p.n")
    lengths = F.sequence(F.greatest(F.length("y") - most, F.lit(0)), F.length("y") + most)
    windows = F.flatten(
        F.transform(
            lengths,
            lambda n: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.lit(parts - 1)),
                    lambda i: F.transform(
                        F.sequence(F.lit(-most), F.lit(most)),
                        lambda d: F.struct(
                            i.alias("i"),
                            F.substring(
                                F.col("y"),
                                F.greatest(F.floor(n / parts) * i + 1 + d, F.lit(1)).cast("int"),
                                F.when(i == most, n - F.floor(n / parts) * most).otherwise(F.floor(n / parts)).cast("int"),
                            ).alias("s"),
                            n.alias("n"),
                        ),
                    ),
                )
            ),
        )
    )
    b = right.select("y", F.explode(F.array_distinct(windows)).alias("p")).select("y", "p.i", "p.s", "p.n")
    met = a.join(b, ["i", "s", "n"]).select("x", "y").distinct()
    return met.withColumn("edits", F.levenshtein("x", "y")).filter(F.col("edits") <= most)


def dispute_pairs(names: DataFrame) -> DataFrame:
    """(given, surname, patronymic, other, kind): distinct names that agree but for the third part.

    similar: third parts one edit apart, found over their distinct words. patronymic: what is no spelling of the first
    (smallest) third part of the name meets that one, so a name of many third parts has as many pairs, not their square.
    """
    words = names.select("patronymic")
    near = typo_partners(words.select(F.col("patronymic").alias("x")).distinct(), words.select(F.col("patronymic").alias("y")).distinct(), 1).filter("x < y").select(F.col("x").alias("patronymic"), F.col("y").alias("other"))
    others = names.withColumnRenamed("patronymic", "other")
    similar = names.join(near, "patronymic").join(others, ["given", "surname", "other"]).withColumn("kind", F.lit("similar"))
    firsts = names.groupBy("given", "surname").agg(F.min("patronymic").alias("patronymic"))
    apart = firsts.join(others, ["given", "surname"]).filter((F.col("patronymic") < F.col("other")) & (F.levenshtein("patronymic", "other") > 1)).withColumn("kind", F.lit("patronymic"))
    columns = ["given", "surname", "patronymic", "other", "kind"]
    return similar.select(*columns).unionByName(apart.select(*columns))


def all_dispute_pairs(names: DataFrame) -> DataFrame:
    """(given, surname, patronymic, other, kind): all pairs of distinct names that agree but for the third part.

    similar: third parts one edit apart at most; patronymic: others. A name of many third parts has the square of their
    number as rows; they are formed in one join on the name and go out as they come, so no task holds them.
    """
    others = names.withColumnRenamed("patronymic", "other")
    pairs = names.join(others, ["given", "surname"]).filter(F.col("patronymic") < F.col("other"))
    kind = F.when(F.levenshtein("patronymic", "other", 1) >= 0, "similar").otherwise("patronymic")
    return pairs.select("given", "surname", "patronymic", "other", kind.alias("kind"))


#: Admissible orders of a name's words by their number, and where some are initials, by what each one is.
FULL_ORDERS = {
    1: (("surname",), ("given",)),
    2: (("given", "surname"), ("surname", "given"), ("given", "patronymic")),
    3: (("given", "patronymic", "surname"), ("surname", "given", "patronymic")),
}
INITIAL_ORDERS = {
    ("initial", "word"): ("given", "surname"),
    ("initial", "initial", "word"): ("given", "patronymic", "surname"),
    ("word", "initial"): ("surname", "given"),
    ("word", "initial", "initial"): ("surname", "given", "patronymic"),
    ("word", "initial", "word"): ("given", "patronymic", "surname"),
    ("word", "word", "initial"): ("surname", "given", "patronymic"),
}


def name_variants(name: Column) -> Column:
    """Every admissible reading of a name as (surname, given, patronymic), absent parts null; none for other shapes."""
    words = X.words(name)
    shape = F.array_join(F.transform(words, lambda w: F.when(F.length(w) == 1, "initial").otherwise("word")), " ")
    orders = {("word",) * n: orders for n, orders in FULL_ORDERS.items()} | {form: (order,) for form, order in INITIAL_ORDERS.items()}
    part = lambda order, role: F.get(words, F.lit(order.index(role))) if role in order else F.lit(None).cast("string")
    found = F.lit(None).cast("array<struct<surname:string,given:string,patronymic:string>>")
    for form, readings in orders.items():
        structs = [F.struct(*[part(order, role).alias(role) for role in ("surname", "given", "patronymic")]) for order in readings]
        found = F.when(shape == " ".join(form), F.array(*structs)).otherwise(found)
    return F.coalesce(found, F.array().cast("array<struct<surname:string,given:string,patronymic:string>>"))


#: Suffixes that hint at a part's role.
SURNAME_SUFFIXES = ("ов", "ев", "ин", "ын", "ова", "ева", "ина", "ына", "ский", "цкий", "ская", "цкая", "енко", "ук", "юк", "ян", "швили", "дзе")
PATRONYMIC_SUFFIXES = ("ич", "вна", "вн", "ична", "ичн")


def plausibility(reading: Column) -> Column:
    """One for each part whose suffix speaks for its role, less one for each part that carries the other role's suffix.

    A patronymic's suffix is looked for first: what ends like a patronymic is no surname.
    """
    ends = lambda part, suffixes: F.coalesce(F.regexp_like(part, F.lit("(" + "|".join(suffixes) + ")$")), F.lit(False))
    hint = lambda part: F.when(ends(part, PATRONYMIC_SUFFIXES), "patronymic").when(ends(part, SURNAME_SUFFIXES), "surname")
    fits = lambda role: F.coalesce(F.when(hint(reading[role]) == role, 1).when(hint(reading[role]).isNotNull(), -1), F.lit(0))
    return fits("surname") + fits("given") + fits("patronymic")


def best_alignment(pairs: DataFrame, incoming: str, form: str) -> DataFrame:
    """pairs with surname, given and patronymic matches of the best of all readings of both names.

    Ranked by the weight of the matches, by how plausible both readings are, and by fewest conflicts.
    """
    weight = {"exact": 3, "typo": 2, "initial": 1, "missing": 0, "mismatch": 0}  # fixed values
    points = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])
    aligned = F.flatten(
        F.transform(
            name_variants(F.col(incoming)),
            lambda a: F.transform(
                name_variants(F.col(form)),
                lambda b: F.struct(*[compare(a[p], b[p]).alias(p) for p in ("surname", "given", "patronymic")], (plausibility(a) + plausibility(b)).alias("plausible")),
            ),
        )
    )
    parts = ("surname", "given", "patronymic")
    total = lambda m: sum((points[m[p]] for p in parts), F.lit(0))
    conflicts = lambda m: sum(((m[p] == "mismatch").cast("int") for p in parts), F.lit(0))
    ranked = F.transform(aligned, lambda m: F.struct(total(m).alias("w"), m["plausible"].alias("p"), (-conflicts(m)).alias("c"), m.alias("m")))
    best = F.array_max(ranked)["m"]
    return pairs.withColumns({f"m_{p}": F.coalesce(best[p], F.lit("missing")) for p in parts})
