"""Matching of persons against a dated list, and what a list snapshot carries over from the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.storage import materialize

#: Fixed values of the list score and its statuses.
KEY_SCORE, NAME_WEIGHT, NAME_LEAST, CANDIDATE, MATCHED, AMBIGUITY, BIRTH_BONUS, BIRTH_CAP = 0.8, 0.2, 0.8, 0.5, 0.95, 0.1, 0.05, 0.5
NOT_MATCHED_CONFIDENCE = 0.8
#: Letters up to which words are compared by what deletions leave of them, and longer ones by their segments.
DELETED = 12


def list_score(key: Column, other_key: Column, words: Column, other_words: Column, birth: Column | None = None, other_birth: Column | None = None) -> Column:
    """0.8 for equal keys and 0.2 x the words' Jaccard similarity above 0.8; known birth dates add 0.05 or cap at 0.5."""
    near = X.jaccard(words, other_words)
    value = F.when(key == other_key, KEY_SCORE).otherwise(0.0) + F.when(near > NAME_LEAST, near * NAME_WEIGHT).otherwise(0.0)
    value = F.least(value, F.lit(1.0))
    if birth is not None and other_birth is not None:
        known = birth.isNotNull() & other_birth.isNotNull() & (value > 0)
        value = F.when(known & (birth == other_birth), F.least(value + BIRTH_BONUS, F.lit(1.0))).when(known, F.least(value, F.lit(BIRTH_CAP))).otherwise(value)
    return value


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(w, e): words of left (w) and right (e) that are equal up to an ending or two edits behind an equal first letter.

    Endings: the prefix that the shorter word keeps is the key, met by all prefixes of the longer one. Edits: words of at
    most DELETED letters meet where they are equal after two deletions at most on either side, which two edits always are.
    Of the three segments of a longer word two edits leave one whole, moved by as many places at most as there are edits on
    either side of it; so a segment is the key, with the word's length and first letter.
    """
    bare = lambda df, c: df.select(c).distinct().withColumn("b", F.translate(c, "ьъ", "")).filter("b <> ''").withColumn("n", F.length("b"))
    ws, es = bare(left, "w"), bare(right, "e")
    kept = lambda df, c: df.filter("n >= 3").select(c, F.xxhash64(F.left("b", F.greatest(F.lit(3), F.col("n") - 2))).alias("k"))
    heads = lambda df, c: df.filter("n >= 3").select(c, F.explode(F.transform(F.sequence(F.lit(3), F.col("n")), lambda i: F.xxhash64(F.left("b", i)))).alias("k"))
    endings = kept(ws, "w").join(heads(es, "e"), "k").select("w", "e").union(heads(ws, "w").join(kept(es, "e"), "k").select("w", "e"))

    def segments(size: Column, part: Column) -> tuple[Column, Column]:
        """Where the part of a word of this size begins (from 1), and its length: later parts are the longer ones."""
        short, rest = F.floor(size / 3).cast("int"), size % 3
        longer = F.greatest(F.lit(0), part - (3 - rest))
        return part * short + longer + 1, short + (part >= 3 - rest).cast("int")

    without = lambda w, i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w)))
    cut = lambda w: F.transform(F.filter(F.sequence(F.lit(2), F.length(w) + 1), lambda i: i <= F.length(w)), lambda i: without(w, i))

    def deleted(df: DataFrame, c: str) -> DataFrame:
        """A row for the word and for each way to delete one or two letters behind the first."""
        one = df.filter(F.col("n") <= DELETED).withColumn("d", cut(F.col("b")))
        two = F.flatten(F.transform("d", cut))
        return one.select(c, F.explode(F.array_distinct(F.transform(F.concat(F.array("b"), "d", two), lambda w: F.xxhash64(w)))).alias("k"))

    short = deleted(ws, "w").join(deleted(es, "e"), "k").select("w", "e")
    part, moved = F.col("part"), F.col("moved")
    given = es.filter(F.col("n") > DELETED - 2).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at, long = segments(F.col("n"), part)
    given = given.select("e", F.struct("n", "part", F.left("b", F.lit(1)).alias("f"), F.substring(F.col("b"), at, long).alias("s")).alias("k"))
    # (part, difference of sizes, places that the segment has moved)
    moves = [(p, d, m) for p in range(3) for d in range(-2, 3) for m in range(-2, 3) if abs(m) <= p and abs(m - d) <= 2 - p]
    asked = ws.filter(F.col("n") > DELETED - 2).withColumn("m", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(d).alias("more"), F.lit(m).alias("moved")) for p, d, m in moves])))
    asked = asked.select("w", "b", F.left("b", F.lit(1)).alias("f"), (F.col("n") - F.col("m.more")).alias("n"), "m.part", "m.moved", F.col("n").alias("own")).filter(F.col("n") > DELETED - 2)
    at, long = segments(F.col("n"), part)
    inside = (at + moved >= 1) & (at + moved + long - 1 <= F.col("own"))
    asked = asked.filter(inside).select("w", F.struct("n", "part", "f", F.substring(F.col("b"), at + moved, long).alias("s")).alias("k"))
    edits = asked.join(given, "k").select("w", "e")
    return endings.union(short).union(edits).filter(X.same_stem(F.col("w"), F.col("e"))).distinct()


def _first_letters(words: Column) -> Column:
    """A bit for each first letter: names whose words agree have those of the shorter one's words in common."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.left(F.translate(w, "ьъ", ""), F.lit(1))), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda done, w: done.bitwiseOR(bit(w)))


def _contained(short: DataFrame, long: DataFrame, pairs: DataFrame, least_more: int) -> DataFrame:
    """(s, l): names of `short` (s) each word of which has a pair (a, b) in a name of `long` (l) of at least `least_more` words more.

    Only names all of whose words have pairs go on, each under its rarest word: the one whose pairs are in fewest names.
    """
    of = long.withColumn("l_letters", _first_letters(F.col("l"))).select("l", "l_letters", F.explode(F.array_distinct("l")).alias("b"))
    cost = pairs.join(of.groupBy("b").agg(F.count("*").alias("n")), "b").groupBy("a").agg(F.sum("n").alias("cost"))
    words = short.select("s", F.posexplode(F.array_distinct("s")).alias("at", "a"))
    cheapest = F.min(F.col("cost") * 65536 + F.pmod(F.col("at"), F.lit(65536)))  # one number: cost, then place
    rarest = words.join(cost, "a").groupBy("s").agg(cheapest.alias("key"), F.count("*").alias("met")).filter(F.col("met") == F.size(F.array_distinct("s")))
    rarest = rarest.select("s", _first_letters(F.col("s")).alias("s_letters"), F.get(F.array_distinct("s"), (F.col("key") % 65536).cast("int")).alias("a"))
    near = rarest.join(pairs, "a").join(of, "b").filter((F.size("l") >= F.size("s") + least_more) & (F.col("s_letters").bitwiseAND(F.bitwise_not("l_letters")) == 0))
    return near.filter(F.forall("s", lambda w: F.exists("l", lambda e: X.same_stem(w, e)))).select("s", "l").distinct()


def name_variants_of(names: DataFrame, listed: DataFrame) -> DataFrame:
    """(words, e_words): distinct names and list names, of two words or more, of which the shorter's words all agree with words of the longer up to an ending or a typo.

    names: words, and stems: what a listed name must hold one of (the kept parts of all words that its person goes by).
    Words are compared once, as a table of pairs; the shorter name's rarest word is then the one key of the join, in either
    direction, so a frequent word alone brings nobody together.
    """
    left = names.select("words", "stems").distinct()
    own, right = left.filter(F.size("words") >= 2).select("words").distinct(), listed.filter(F.size("e_words") >= 2).select("e_words").distinct()
    pairs = materialize(word_pairs(own.select(F.explode("words").alias("w")), right.select(F.explode("e_words").alias("e"))), "word-pairs")
    there = _contained(own.select(F.col("words").alias("s")), right.select(F.col("e_words").alias("l")), pairs.select(F.col("w").alias("a"), F.col("e").alias("b")), 0)
    back = _contained(right.select(F.col("e_words").alias("s")), own.select(F.col("words").alias("l")), pairs.select(F.col("e").alias("a"), F.col("w").alias("b")), 1)
    met = there.select(F.col("s").alias("words"), F.col("l").alias("e_words")).union(back.select(F.col("l").alias("words"), F.col("s").alias("e_words")))
    return met.join(left, "words").filter(F.exists("stems", lambda p: F.contains(F.array_join("e_words", " "), p))).select("words", "stems", "e_words")


def stems_of(words: Column) -> Column:
    """What words of three letters and more keep of themselves whatever their ending."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: X.stem(w))))


def match_list(persons: DataFrame, entries: DataFrame, least_words: int = 2, aliases: DataFrame | None = None) -> DataFrame:
    """(person, status, confidence, entry) of persons (person, words, and birth, if known) against entries (entry, words, birth).

    aliases (person, words) are further identities of persons. Scores above one half need equal keys, so an equi-join on the
    key gives all candidates; each entry counts once for a person, with the best score of its identities. Two near the
    top are ambiguous; 0.95 and more is a match; other candidates need review. Where there is no candidate, a person one of
    whose names contains an entry's, or is contained in it (name_variants_of), isn't proven absent: review too.
    """
    with_birth = lambda df: df if "birth" in df.columns else df.withColumn("birth", F.lit(None).cast("int"))
    people, listed = with_birth(persons), with_birth(entries)
    key = lambda words: F.array_join(F.array_sort(words), "")
    every = people.select("person", "words", "birth")
    if aliases is not None:
        every = every.unionByName(aliases.select("person", "words").join(people.select("person", "birth"), "person"))
    every = every.withColumn("key", key("words"))
    listed = listed.select("entry", F.col("words").alias("e_words"), F.col("birth").alias("e_birth"), key("words").alias("key"))
    score = list_score(F.lit(1), F.lit(1), F.col("words"), F.col("e_words"), F.col("birth"), F.col("e_birth"))
    scored = every.join(listed, "key").groupBy("person", "entry").agg(F.max(score).alias("score")).filter(F.col("score") > CANDIDATE)
    order = F.row_number().over(Window.partitionBy("person").orderBy(F.col("score").desc(), "entry"))
    best = scored.withColumn("r", order).filter("r <= 2").groupBy("person").agg(
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col("entry"))).alias("entry")
    )
    bare = every.select("person", X.name_words("words").alias("words"))
    goes_by = bare.groupBy("person").agg(stems_of(F.flatten(F.collect_list("words"))).alias("stems"), F.collect_set("words").alias("forms"))
    named = materialize(goes_by.select("person", "stems", F.explode("forms").alias("words")), "identities")
    alike = name_variants_of(named, listed.select(X.name_words("e_words").alias("e_words"))).select("words", "stems").distinct()
    variant = named.join(alike, ["words", "stems"], "left_semi").select("person").distinct().withColumn("variant", F.lit(True))
    found = people.select("person", "words").join(best, "person", "left").join(variant, "person", "left")
    full = F.size(F.filter("words", lambda w: F.length(F.btrim(w, F.lit("."))) > 1))
    status = (
        F.when(F.col("top").isNull() & (full < least_words), "INSUFFICIENT_DATA")
        .when(F.col("top").isNull() & F.coalesce("variant", F.lit(False)), "NEEDS_REVIEW")
        .when(F.col("top").isNull(), "NOT_MATCHED")
        .when(F.col("second").isNotNull() & (F.col("top") - F.col("second") < AMBIGUITY), "AMBIGUOUS")
        .when(F.col("top") >= MATCHED, "MATCHED")
        .otherwise("NEEDS_REVIEW")
    )
    confidence = F.when(status == "NOT_MATCHED", NOT_MATCHED_CONFIDENCE).otherwise(F.coalesce("top", F.lit(0.0)))
    return found.select("person", status.alias("status"), F.round(confidence, 6).alias("confidence"), "entry")


def membership(checked: Column, listed: Column, certain: Column, identified: Column) -> Column:
    """What is shown of a person and a list: unknown, not found, probable or confirmed.

    listed: an entry was found; certain: by the whole name; identified: its birth date and place are the case's.
    """
    return F.when(~listed, F.when(checked, "not_found").otherwise("unknown")).when(certain & identified, "confirmed").otherwise("probable")


def fill_inclusion(entries: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """entries with included filled where null, by the first of `others` (keys, included) that knows it; `told_by` is its place."""
    out, values = entries.withColumnRenamed("included", "_v0"), [F.col("_v0")]
    for i, other in enumerate(others, 1):
        out = out.join(other.select(*keys, F.col("included").alias(f"_v{i}")), keys, "left")
        values.append(F.col(f"_v{i}"))
    told = F.coalesce(*[F.when(v.isNotNull(), i) for i, v in enumerate(values)])
    return out.withColumn("included", F.coalesce(*values)).withColumn("told_by", told).drop(*[f"_v{i}" for i in range(len(values))])
