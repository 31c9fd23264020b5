"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of turn tokens cut a conversation at turn boundaries: turns of at most half the budget of new tokens fall in
cells of that size by the sum before them, so a cell's turns stay within the budget. A turn longer than that is cut into
pieces of PIECE code points, of which the later ones are marked as continuing it. Each window holds the first piece of the
conversation's system turn (all of it, where it has SYSTEM_TOKENS tokens or fewer), a limited repeat of the pieces just
before, and its new pieces: at most WINDOW_TOKENS tokens, whatever the texts' length. The loss mask covers the new
assistant texts only: repeated ones are masked, and each assistant text is a target once.

Template: ``<s>[role]text</s>`` and a line feed for each turn, ``<c>[role]text</s>`` for what continues one. In roles and
texts ``&``, ``<``, ``[`` and ``]`` are written as the entities ``&amp;``, ``&lt;``, ``&#91;``, ``&#93;``, so no text can
hold a control string, and reading undoes it.

Scale: prefix sums are taken in blocks of BLOCK turn numbers and moved by the sums of earlier blocks, and history is an
equi-join on (conversation, position), so one conversation may hold most rows. A block that holds many more rows than turn
numbers (turns without a number, or of one number) is split by role and the text's first letters, and its rows that repeat
whole travel as one with their count. The query's digests need each whole conversation in one value: a conversation's text
is bounded by what a Spark string holds, 2 GB; the windows have no such bound.

Defined cases. Null role or text: empty. Null conv_id: a conversation of its own. Null turn: first. Turns of equal number
go by role, then text; repeated rows are turns of their own. Roles are names: the budget holds for those of ROLE code
points at most, and a longer one makes its windows longer by what it has more. No turns: no rows. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.base import materialize, table

#: Turn numbers in a block of prefix sums, and rows in it from which it is split.
BLOCK, CROWDED = 256, 1024
#: Tokens of new pieces, of the system turn, of repeated history, and pieces of it, in a window; all of them together.
NEW_TOKENS, SYSTEM_TOKENS, HISTORY_TOKENS, HISTORY_TURNS = 512, 256, 256, 2
WINDOW_TOKENS = NEW_TOKENS + SYSTEM_TOKENS + HISTORY_TOKENS
#: Code points of a role and of a piece, whose tokens are half of the new ones then.
ROLE = 48
PIECE = 4 * (NEW_TOKENS // 2 - 4) - ROLE
#: Fixed value: characters and their entities; the ampersand is written first and read last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
START, CONTINUED, END = "<s>[", "<c>[", "</s>\n"


def escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def turn_tokens(role: Column, text: Column) -> Column:
    """Estimated tokens: four for the markers and one for every four code points; at least four, which bounds pieces a window."""
    return (F.lit(4) + F.ceil((F.length(role) + F.length(text)) / 4)).cast("long")


def blocks_of_turns(turns: DataFrame) -> DataFrame:
    """Add block (sorts as conv, turn, role, text do) and copies (rows that the row stands for)."""
    number = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))  # a null turn has a block of its own, before all others
    turns = turns.withColumn("number", number)
    crowded = materialize(turns.groupBy("conv", "number").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("conv", "number", F.lit(True).alias("crowded")), "crowded-blocks")
    marked = turns.join(crowded, ["conv", "number"], "left")
    columns = ["conv", "number", "turn", "role", "text"]
    none = F.lit(None)
    plain = marked.filter(F.col("crowded").isNull()).select(*columns, F.lit(1).cast("long").alias("copies"), F.struct("number", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("head")).alias("block"))
    counted = marked.filter(F.col("crowded")).groupBy(*columns).agg(F.count("*").alias("copies"))
    split = counted.select(*columns, "copies", F.struct("number", "turn", "role", F.left("text", F.lit(8)).alias("head")).alias("block"))
    return plain.unionByName(split)


def positions(turns: DataFrame) -> DataFrame:
    """The pieces of all turns with pos (gapless from 0) and the sums before each: of all tokens, and of those of short pieces; longs counts the long ones up to it."""
    turns = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = blocks_of_turns(turns)
    sizes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / PIECE).cast("int") - 1)),
        lambda i: turn_tokens(F.col("role"), F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))),
    )
    is_long = lambda t: (t > NEW_TOKENS // 2).cast("long")
    total = lambda f: F.aggregate("sizes", F.lit(0).cast("long"), lambda a, t: a + f(t))
    sums = ("one", "tokens", "short_tokens", "long")
    placed = placed.withColumn("sizes", sizes).withColumns({"one": F.size("sizes").cast("long"), "tokens": total(lambda t: t), "short_tokens": total(lambda t: t * (1 - is_long(t))), "long": total(is_long)})
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(F.col(c) * F.col("copies")).over(earlier), F.lit(0)).alias(f"in_{c}") for c in sums])
    totals = placed.groupBy("conv", "block").agg(*[F.sum(F.col(c) * F.col("copies")).alias(c) for c in sums])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in sums])
    joined = summed.join(offsets, ["conv", "block"])  # summed is dealt by these keys already
    start = {c: F.col(f"in_{c}") + F.col(f"o_{c}") for c in sums}
    each = joined.withColumns({f"s_{c}": v for c, v in start.items()}).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    cut = each.select("*", F.posexplode("sizes").alias("piece", "size"))
    at = lambda c, f: F.col(f"s_{c}") + F.col("copy") * F.col(c) + f
    return cut.select(
        "conv", "role", F.substring(F.col("text"), F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"), "piece", F.col("size").alias("tokens"), is_long(F.col("size")).alias("long"),
        at("one", F.col("piece")).alias("pos"),
        at("tokens", F.col("piece") * F.get("sizes", F.lit(0))).alias("before"),  # all pieces but the last are of one size
        at("short_tokens", F.col("piece") * F.get("sizes", F.lit(0)) * (1 - is_long(F.get("sizes", F.lit(0))))).alias("short_before"),
        (at("long", F.col("piece") * is_long(F.get("sizes", F.lit(0)))) + is_long(F.col("size"))).alias("longs"),
    )


#: Order of a window's parts: the system turn, repeated turns, new turns.
SYSTEM, HISTORY, NEW = 0, 1, 2


def _part(kind: int) -> Column:
    """A turn of a window: its place, what stands before its text, its text as written, and the length of its target."""
    text = escape(F.col("text"))
    target = F.when(F.col("role") == "assistant", F.length(text)) if kind == NEW else F.lit(None).cast("int")
    return F.struct(F.lit(kind).alias("kind"), "pos", F.concat(F.when(F.col("piece") == 0, START).otherwise(CONTINUED), escape(F.col("role")), F.lit("]")).alias("head"), text.alias("body"), target.alias("target"))


def format_windows(turns: DataFrame) -> DataFrame:
    """conv_id, start (position of the first new piece), formatted, n_context (pieces repeated), loss_spans.

    loss_spans: array of (start, length) in code points of formatted, in order. Positions are written once. The windows'
    plan (which pieces each repeats) has no texts in it; texts are shuffled to their positions, and with their copies to
    their windows.
    """
    placed = positions(turns)
    cell = F.when(F.col("long") == 1, F.lit(-1)).otherwise(F.floor(F.col("short_before") / (NEW_TOKENS // 2)))
    placed = materialize(placed.withColumn("cell", cell), "turns")
    window = ["conv", "longs", "cell"]
    windows = placed.groupBy(*window).agg(F.min("pos").alias("start"), F.min("before").alias("sum_before"))
    first = placed.filter((F.col("role") == "system") & (F.col("piece") == 0)).groupBy("conv").agg(F.min("pos").alias("system_pos"))
    later = materialize(windows.filter(F.col("start") > 0).join(first, "conv", "left"), "windows")
    asked = later.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("start") - HISTORY_TURNS, F.lit(0)), F.col("start") - 1)))
    asked = asked.filter(F.col("system_pos").isNull() | (F.col("pos") != F.col("system_pos"))).select(*window, "pos", "sum_before", F.lit(HISTORY).alias("kind"))
    leads = later.filter(F.col("system_pos") < F.col("start")).select(*window, F.col("system_pos").alias("pos"), "sum_before", F.lit(SYSTEM).alias("kind"))
    wanted = asked.unionByName(leads)
    texts = placed.select("conv", "pos", "before", "role", "text", "piece")
    repeated = wanted.join(texts, ["conv", "pos"]).filter((F.col("kind") == SYSTEM) | (F.col("sum_before") - F.col("before") <= HISTORY_TOKENS))
    part = F.when(F.col("kind") == SYSTEM, _part(SYSTEM)).otherwise(_part(HISTORY))
    parts = placed.select(*window, _part(NEW).alias("part")).unionByName(repeated.select(*window, part.alias("part")))
    full = parts.groupBy(*window).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    full = full.withColumn("n_context", F.size(F.filter("parts", lambda p: p["kind"] != NEW)))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["target"].isNull(), acc["spans"])
            .otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), p["target"].alias("length")))))
            .alias("spans"),
        ),
    )
    return full.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.get("parts", F.col("n_context"))["pos"].alias("start"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        "n_context",
        spans["spans"].alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """For each window, from formatted, n_context and loss_spans alone: n_new (turns that begin in it), turns (array of
    role, text, continued: the new pieces), targets (texts)."""
    written = F.split("formatted", END, -1)
    new = F.slice(written, F.col("n_context") + 1, F.greatest(F.size(written) - 1 - F.col("n_context"), F.lit(0)))
    turn = r"(?s)^<[sc]>\[([^\]]*)\](.*)$"
    read = F.transform(
        new,
        lambda w: F.struct(unescape(F.regexp_extract(w, turn, 1)).alias("role"), unescape(F.regexp_extract(w, turn, 2)).alias("text"), F.startswith(w, F.lit(CONTINUED)).alias("continued")),
    )
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumn("turns", read).withColumn("targets", targets).withColumn("n_new", F.size(F.filter("turns", lambda t: ~t["continued"])))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose turns hold control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op3_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back; the digests of what was read."""
    read = read_windows(format_windows(with_probe(spark, table(spark, sf_dir, "conversations"))))
    # the line feed behind a turn is written where the next one begins
    said = F.array_join(F.transform("turns", lambda t: F.when(t["continued"], t["text"]).otherwise(F.concat(F.lit("\n"), t["role"], F.lit("\n"), t["text"]))), "")
    one = read.select("conv_id", "start", "n_new", F.length("formatted").alias("chars"), said.alias("said"), F.array_join("targets", "").alias("loss"))
    whole = one.groupBy("conv_id").agg(
        F.sum("n_new").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("start", "said", "loss"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
    )
    joined = whole.withColumn("loss", F.array_join("w.loss", ""))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.concat(F.substring(F.array_join("w.said", ""), 2, 1 << 30), F.lit("\n")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


_ESCAPED_SQL = "length(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))"
OP3_SQL = rf"""
with turns_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from turns_),
cut as (select conv_id, n, role, unnest(range(greatest(1, ceil(length(text) / {PIECE}.0)::bigint))) as piece, text as whole_text from numbered),
rows_ as (select conv_id, n, piece, role, substr(whole_text, piece * {PIECE} + 1, {PIECE}) as text from cut),
sized as (
    select *, 4 + ceil((length(role) + length(text)) / 4.0)::bigint as tokens,
           10 + {_ESCAPED_SQL.format("role")} + {_ESCAPED_SQL.format("text")} as chars
    from rows_),
placed as (
    select *, row_number() over w - 1 as pos, sum(tokens) over w - tokens as before,
           sum(case when tokens > 256 then 0 else tokens end) over w - case when tokens > 256 then 0 else tokens end as short_before,
           sum((tokens > 256)::int) over w as longs
    from sized window w as (partition by conv_id order by n, piece rows unbounded preceding)),
celled as (select *, case when tokens > 256 then -1 else short_before // 256 end as cell from placed),
windows as (select conv_id, longs, cell, min(pos) as start, min(before) as sum_before from celled group by all),
systems as (select conv_id, min(pos) as pos, arg_min(chars, pos) as chars from placed where role = 'system' and piece = 0 group by conv_id),
repeated as (
    select w.conv_id, sum(p.chars) as chars
    from windows w join placed p on p.conv_id = w.conv_id and p.pos < w.start and p.pos >= w.start - 2 and w.sum_before - p.before <= 256
    left join systems s on s.conv_id = w.conv_id where s.pos is null or p.pos <> s.pos group by w.conv_id),
led as (select w.conv_id, sum(s.chars) as chars from windows w join systems s on s.conv_id = w.conv_id and s.pos < w.start group by w.conv_id),
counted as (select conv_id, count(*) as n_windows from windows group by conv_id),
sizes as (select conv_id, sum(chars) as chars from placed group by conv_id),
whole as (
    select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by n) as said,
           coalesce(string_agg(case when role = 'assistant' then text end, '' order by n), '') as loss
    from numbered group by conv_id)
select t.conv_id, t.n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       (z.chars + coalesce(r.chars, 0) + coalesce(l.chars, 0))::bigint as formatted_chars, c.n_windows
from whole t join sizes z using (conv_id) join counted c using (conv_id) left join repeated r using (conv_id) left join led l using (conv_id)"""
