"""What sentences tell: triggers, whom a pronoun means, whose evidence a passage is, who is no person of the news, and what corroborates a link."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators.joins import as_of_join
from factloom.operators.relational import merge_intervals
from factloom.storage import materialize


def first_trigger(sentence: Column, verbs: Mapping[str, str], nouns: Mapping[str, str], negations: Sequence[str]) -> Column:
    """struct(start, type, text) of the earliest verb that no negation stands before, else of the earliest such noun; null without any.

    verbs, nouns: type -> regular expression, as data. A negation is a word right before the trigger.
    """

    def earliest(table: Mapping[str, str]) -> Column:
        found = []
        for kind, pattern in table.items():
            free = rf"(?<!(?:{'|'.join(negations)}) )(?:{pattern})"
            start = F.length(F.get(F.split(sentence, free, 2), F.lit(0)))
            found.append(F.when(sentence.rlike(free), F.struct(start.alias("start"), F.lit(kind).alias("type"), F.regexp_extract(sentence, free, 0).alias("text"))))
        return F.array_min(F.array_compact(F.array(*found)))

    return F.coalesce(earliest(verbs), earliest(nouns))


def antecedents(sentences: DataFrame, mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, sentence, mention): the person that a sentence's pronoun stands for, where only one can fit.

    sentences: doc, sentence, start, gender (of its pronoun), paragraph. mentions: doc, mention, end, surname, gender,
    paragraph. The last two mentions that end before the sentence must be of one surname, the last one of the pronoun's
    gender and in the sentence's paragraph. One window over a document's mentions and sentences.
    """
    order = Window.partitionBy(doc).orderBy("end", "mention")
    told = mentions.withColumn("before", F.lag("surname").over(order))
    told = told.select(doc, F.col("end").alias("at"), F.lit(0).alias("kind"), F.struct("mention", "surname", "before", F.col("gender").alias("of"), F.col("paragraph").alias("in")).alias("m"), *[F.lit(None).cast(t).alias(c) for c, t in (("sentence", "long"), ("gender", "string"), ("paragraph", "long"))])
    asked = sentences.select(doc, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(told.schema["m"].dataType).alias("m"), F.col("sentence").cast("long"), "gender", F.col("paragraph").cast("long"))
    mine = Window.partitionBy(doc).orderBy("at", "kind", F.col("m.mention"), "sentence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = told.unionByName(asked).withColumn("last", F.last("m", ignorenulls=True).over(mine))
    fits = (F.col("kind") == 1) & (F.col("last.surname") == F.col("last.before")) & (F.col("last.of") == F.col("gender")) & (F.col("last.in") == F.col("paragraph"))
    return last.filter(fits).select(doc, "sentence", F.col("last.mention").alias("mention"))


def with_borders(mentions: DataFrame, sentences: DataFrame, borders: DataFrame, doc: str = "doc_id") -> DataFrame:
    """mentions (doc, start, end, ...) with s_start and s_end of their sentence, and the clause borders around them.

    sentences, borders: doc, start, end; sentences don't overlap. The borders are the last one that ends at or before the
    mention (p_start, p_end) and the first that begins at or after its end (n_start, n_end). Three sweeps over a text's
    places: no mention meets more than one sentence and two borders.
    """
    within = as_of_join(mentions, sentences.select(doc, F.col("start").alias("s_start"), F.col("end").alias("s_end")), [doc], "start", "s_start", ["s_start", "s_end"])
    before = as_of_join(within, borders.select(doc, F.col("start").alias("p_start"), F.col("end").alias("p_end")), [doc], "start", "p_end", ["p_start", "p_end"])
    backward = borders.select(doc, (-F.col("start")).alias("_b"), F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    return as_of_join(before.withColumn("_e", -F.col("end")), backward, [doc], "_e", "_b", ["n_start", "n_end"]).drop("_e")


def evidence_windows(mentions: DataFrame, width: int, doc: str = "doc_id", reach: int | None = None) -> DataFrame:
    """(doc, person, start, end): the text around a person's mentions, merged where it overlaps.

    mentions: doc, person, start, end and what with_borders adds. A window of `width` on both sides never reaches into a
    sentence that names another person. Inside the mention's own sentence it stops at the clause border nearest to it, if
    another person is named beyond that border; a clause without such a border is shared. Other sentences meet a mention
    by cells of its width; of its own sentence it meets the outermost other mentions only. reach: another sentence counts only
    where its mention is less than so many code points off, which matters for sentences as long as that.
    """
    spot = [doc, "s_start"]
    each = mentions.groupBy(*spot, "person").agg(F.max("start").alias("last"), F.min("end").alias("first"))
    latest, earliest = Window.partitionBy(*spot).orderBy(F.col("last").desc(), "person"), Window.partitionBy(*spot).orderBy("first", "person")
    ranked = each.withColumns({"a": F.row_number().over(latest), "b": F.row_number().over(earliest)}).filter("a <= 2 or b <= 2")
    pick = lambda c, r, n: F.max(F.when(F.col(r) == n, F.col(c)))
    outer = ranked.groupBy(*spot).agg(*[pick(c, r, n).alias(f"{c}_{r}{n}") for r, value in (("a", "last"), ("b", "first")) for c in ("person", value) for n in (1, 2)])
    own = mentions.join(outer, spot)
    last = F.when(F.col("person") == F.col("person_a1"), F.col("last_a2")).otherwise(F.col("last_a1"))
    first = F.when(F.col("person") == F.col("person_b1"), F.col("first_b2")).otherwise(F.col("first_b1"))
    own = own.withColumns({"c_low": F.when(F.col("p_start") >= first, F.col("p_end")), "c_high": F.when(F.col("n_end") <= last, F.col("n_start"))})
    own = own.select(doc, "person", "start", "end", "s_start", "s_end", "c_low", "c_high").distinct()

    other = mentions.select(doc, F.col("person").alias("o_person"), F.col("s_start").alias("o_start"), F.col("s_end").alias("o_end"), "start").groupBy(doc, "o_person", "o_start", "o_end").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    cell = lambda c: F.floor(c / width)
    near = own.select(doc, "person", "start", "end", "s_start", "s_end", F.explode(F.sequence(cell(F.col("start")) - 1, cell(F.col("end")) + 1)).alias("cell"))
    left = other.withColumn("cell", cell(F.col("o_end"))).select(doc, "cell", "o_person", F.col("o_end").alias("edge"), F.col("last").alias("at"), F.lit(True).alias("ends"))
    right = other.withColumn("cell", cell(F.col("o_start"))).select(doc, "cell", "o_person", F.col("o_start").alias("edge"), F.col("first").alias("at"), F.lit(False).alias("ends"))
    met = near.join(left.unionByName(right), [doc, "cell"]).filter(F.col("o_person") != F.col("person"))
    if reach is not None:
        met = met.filter((F.col("at") > F.col("start") - reach) & (F.col("at") < F.col("end") + reach))
    clips = met.groupBy(doc, "person", "start", "end").agg(
        F.max(F.when(F.col("ends") & (F.col("edge") <= F.col("s_start")), F.col("edge"))).alias("after"), F.min(F.when(~F.col("ends") & (F.col("edge") >= F.col("s_end")), F.col("edge"))).alias("until")
    )
    wide = own.join(clips, [doc, "person", "start", "end"], "left")
    low = F.greatest(F.lit(0), F.col("start") - width, "after", "c_low")
    high = F.least(F.col("end") + width, "until", "c_high")
    return merge_intervals(wide.select(doc, "person", low.alias("start"), high.alias("end")), [doc, "person"], "start", "end")


#: What a finished sentence ends with, and what may follow an author's name: nothing, or a town.
SENTENCE_ENDS = ".!?…»\"”)"
BYLINE_END = r"(?:,[ \t]*\p{Lu}[\p{Ll}-]+(?:[ \t-]\p{L}[\p{Ll}-]+){0,2})?\s*"


def mention_reasons(docs: DataFrame, key: str, text: str, name: str, kin: Sequence[str], given: DataFrame, endings: Sequence[str], byline_end: str = BYLINE_END) -> DataFrame:
    """(key, place, surface, reason) of every match of `name`: byline, kinship or kept.

    byline: the author's signature, a name of two or three words alone on the text's last line, behind a finished sentence
    (a list of names keeps its last one). kinship: a word of kin before a given name that is declined: without its last
    letter, or with one of `endings` for it, it is one of given (word), and it isn't so itself. Decided inside the text's
    row, from what stands between matches; only words behind a word of kin meet the given names.
    """
    found, gaps, n = F.col("_found"), F.col("_gaps"), F.size("_found")
    ends = "[" + "".join(f"\\{c}" for c in SENTENCE_ENDS) + "]"

    def signed(at: Column, rest: Column) -> Column:
        alone = F.size(F.split(F.trim(F.get(found, at)), r"\s+")).between(2, 3) & rest.rlike(rf"\A(?:{byline_end})\z") & F.get(gaps, at).rlike(rf"{ends}\s*\n[ \t]*\z")
        return F.coalesce(alone, F.lit(False))

    # the last match, or the one before it where the last is the author's town
    by = F.when(signed(n - 1, F.get(gaps, n)), n - 1).when(signed(n - 2, F.concat(F.get(gaps, n - 1), F.get(found, n - 1), F.get(gaps, n))), n - 2)
    held = docs.filter(F.col(text).rlike(name)).select(key, F.regexp_extract_all(F.col(text), F.lit(name), F.lit(0)).alias("_found"), F.split(F.col(text), name, -1).alias("_gaps"))
    rows = held.select(key, by.alias("_by"), F.posexplode("_found").alias("place", "surface"))
    rows = rows.select(key, "place", "surface", F.coalesce(F.col("place") == F.col("_by"), F.lit(False)).alias("signed"), X.words(F.col("surface")).alias("words"))
    relative = (F.size("words") >= 2) & F.get("words", F.lit(0)).isin(*kin)
    second = F.get("words", F.lit(1))
    stem = F.left(second, F.length(second) - 1)
    bases = F.when(relative, F.filter(F.array(stem, *[F.concat(stem, F.lit(e)) for e in endings]), lambda b: b != second))
    told = materialize(rows.select(key, "place", "surface", "signed", F.coalesce(relative, F.lit(False)).alias("relative"), bases.alias("bases")), "named")  # read four times, matched once
    relative = F.col("relative")
    asked = told.filter(relative).select(F.explode("bases").alias("word")).distinct().join(given.select("word").distinct(), "word").withColumnRenamed("word", "_base")
    kin_rows = told.filter(relative).select(key, "place", F.explode("bases").alias("_base")).join(asked, "_base").select(key, "place").distinct().withColumn("_kin", F.lit(True))
    plain = told.filter(~relative).withColumn("_kin", F.lit(None).cast("boolean"))
    both = told.filter(relative).join(kin_rows, [key, "place"], "left").unionByName(plain)
    return both.select(key, "place", "surface", F.when(F.col("signed"), "byline").when(F.col("_kin"), "kinship").otherwise("kept").alias("reason"))


def bracketed_aliases(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(alias, named): a mention in brackets right behind another one's. mentions: doc, mention, start, end, before and
    after (the characters around it)."""
    order = Window.partitionBy(doc).orderBy("start", "mention")
    led = mentions.withColumn("named", F.lag("mention").over(order)).withColumn("gap", F.col("start") - F.lag("end").over(order))
    return led.filter((F.col("before") == "(") & (F.col("after") == ")") & F.col("gap").between(1, 2)).select(F.col("mention").alias("alias"), "named")


def charges(links: DataFrame) -> DataFrame:
    """(target, basis, other_targets): each event's targets with its legal bases, and how many other targets the event has.

    links: event, mention, role (target or legal_basis). Targets are counted before they meet the bases.
    """
    targets = links.filter("role = 'target'").select("event", F.col("mention").alias("target")).distinct()
    counts = targets.groupBy("event").agg((F.count("*") - 1).alias("other_targets"))
    bases = links.filter("role = 'legal_basis'").select("event", F.col("mention").alias("basis")).distinct()
    return targets.join(counts, "event").join(bases, "event").select("event", "target", "basis", "other_targets")


def corroborated(asked: DataFrame, named: DataFrame, days: int) -> DataFrame:
    """(mention, person) that context speaks for. asked: mention, person (a candidate), article, on, sole (it is the only
    target of an event). named: person, article, on (where a person is named).

    Either the candidate is named in the mention's own article, or the mention is a sole target and the candidate is named
    within `days` of it: equi-joins on the person and the article, and on cells of days.
    """
    same = asked.join(named.select("person", "article").distinct(), ["person", "article"], "left_semi").select("mention", "person")
    cell = lambda c: F.floor(F.unix_date(c) / days)
    near = asked.filter("sole").select("mention", "person", F.col("on").cast("date").alias("at"), F.explode(F.sequence(cell(F.col("on").cast("date")) - 1, cell(F.col("on").cast("date")) + 1)).alias("cell"))
    days_of = named.select("person", F.col("on").cast("date").alias("day")).distinct().withColumn("cell", cell(F.col("day")))
    close = near.join(days_of, ["person", "cell"]).filter(F.abs(F.datediff("at", "day")) <= days).select("mention", "person")
    return same.union(close).distinct()
