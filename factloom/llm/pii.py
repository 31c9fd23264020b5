"""Personal data by weak supervision (DataFrame functions only).

Candidate spans come from the base patterns (email, ip, card, phone) and wider ones. Labelers vote on each candidate, for
(1), against (-1) or not at all (0): the base pattern's own check, a stricter form, a gazetteer of cue words before it, the
context on both sides, and digit variety. Expectation-maximisation over the counted vote patterns (3^5 for each kind at
most, whatever the corpus) estimates each labeler's reliability and a posterior for each pattern; these soft labels train
a naive Bayes classifier of spans on shape and context features, whose counts are aggregated by Spark. Base spans always
stay; other candidates are added where the classifier is sure and no base span overlaps.

Spans are in code points, end exclusive. They come from lengths of matches and of the gaps between them, not from regex
positions, which count UTF-16 units. The patterns use possessive loops and anchors that change no match: a long run of
digits or letters costs linear time and no deep recursion.

Defined cases. A null text is empty: no spans. Repeated rows count each. Other columns are kept (those named as added ones
are replaced). No candidates at all: an empty model, base spans only. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.base import materialize, spread, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "phone_local", "email_spelled", "secret", "id_number")
BASE = 4
#: The base patterns of the contract, with run starts and possessive loops in place of retries.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z])(?:password|passwd|secret|token|api[_-]?key|Password|Token|Secret) ?[=:] ?\"?[A-Za-z0-9_/+.-]{8,}+\"?|(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cue words for and against.
CUES_FOR = r"(?i)(?:mail|phone|tel|fax|call|contact|card|visa|pay|addr|host|login|user|password|token|secret|key|ssn|ident|konto|tarjeta|carte|telefon|correo)"
CUES_AGAINST = r"(?i)(?:version|isbn|issn|chapter|figure|table|page|order|invoice|serial|build|release|section)"
LABELERS = ("check", "form", "gazetteer", "context", "variety")
CONTEXT = 24
#: A candidate outside the base is added at this probability or more.
SURE = 0.9


def _guard(kind: str, text: Column) -> Column:
    """A cheap necessary condition, so that the full pattern runs on few texts."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}")
    if kind == "email_spelled":
        return F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    if kind == "secret":
        return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit("AKIA"))
    return text.rlike(r"[0-9]{3}\)?[ .-]{1,2}[0-9]{2}")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, surface: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return surface.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(surface)).between(14, 19) & F.call_function("luhn_check", _digits(surface))
    if kind == "phone":
        return F.length(_digits(surface)).between(10, 15)
    return F.lit(kind == "email")


_SPAN = "array<struct<start:int,kind:int,end:int,base:boolean,surface:string,left:string,right:string,from:int,to:int>>"
#: Elements that a running sum or a search takes at a time.
CHUNK = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for a row, however often it is used and in whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array in pieces of CHUNK elements; values must be a column or bound by let."""
    return F.transform(
        F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)),
    )


def running(values: str, join: str) -> Column:
    """Of each element of an array of int (SQL), join (SQL, of `a` and `v`) over all before it, zero for the first.

    It goes piece by piece, so that the time is in proportion to the array even where it is long.
    """
    pieces = f"transform(if(size(w) > 0, sequence(0, cast((size(w) - 1) div {CHUNK} as int)), cast(array() as array<int>)), i -> slice(w, i * {CHUNK} + 1, {CHUNK}))"
    scan = lambda over, start: f"aggregate({over}, named_struct('a', {start}, 'out', cast(array() as array<int>)), (s, v) -> transform(array(s.a), a -> named_struct('a', {join}, 'out', concat(s.out, array(a))))[0]).out"
    totals = f"transform(p, q -> aggregate(q, 0, (a, v) -> {join}))"
    whole = f"flatten(zip_with(p, {scan(totals, '0')}, (q, b) -> {scan('q', 'b')}))"
    return F.expr(f"transform(array({values}), w -> transform(array({pieces}), p -> {whole})[0])[0]")


def _span(number: int, kind: str) -> Callable[[Column], Column]:
    """The span of a match, from what stands before it (in code points, in bytes, and as text) and after it."""

    def span(m: Column) -> Column:
        start, byte = m["at"] + F.length(m["gap"]), m["byte"] + F.octet_length(m["gap"])
        return F.struct(
            start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m["hit"])).alias("end"), _valid(kind, m["hit"]).alias("base"), m["hit"].alias("surface"),
            F.right(m["gap"], F.lit(CONTEXT)).alias("left"), F.left(m["next"], F.lit(1)).alias("right"), byte.alias("from"), (byte + F.octet_length(m["hit"])).alias("to"),
        )

    return span


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _spans: every candidate as (start, kind number, end, base, surface, left, right, from, to), by start, then kind.

    from, to: the same places in bytes. Places are running sums of the lengths of gaps and matches.
    """
    df = df.withColumn("_t", text_or_empty(text))
    df = df.withColumns({f"_m_{k}": F.when(_guard(k, F.col("_t")), F.regexp_extract_all("_t", F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_t", PATTERNS[k], -1)) for k in KINDS})

    def located(number: int, kind: str) -> Column:
        gaps, hits = F.col(f"_g_{kind}"), F.col(f"_m_{kind}")
        before = lambda size: running(f"zip_with(slice(_g_{kind}, 1, size(_m_{kind})), _m_{kind}, (g, h) -> {size}(g) + {size}(h))", "a + v")
        parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(hits)).alias("next"), before("length").alias("at"), before("octet_length").alias("byte"))
        return F.when(gaps.isNotNull(), F.transform(parts, _span(number, kind)).cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    df = df.withColumns({f"_c_{k}": located(i, k) for i, k in enumerate(KINDS)})
    spans = F.array_sort(F.concat(*[F.col(f"_c_{k}") for k in KINDS]))
    return df.withColumn("_spans", spans).drop("_t", *[f"_{p}_{k}" for p in "mgc" for k in KINDS])


def votes(s: Column) -> list[Column]:
    """The labelers' votes on one candidate, in the order of LABELERS."""
    kind, surface = s["kind"], s["surface"]
    digits = _digits(surface)
    strict = F.when(kind == 0, surface.rlike(r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,}$")).when(kind == 1, ~surface.rlike(r"(?:^|\.)0[0-9]"))
    strict = strict.when(kind == 2, F.length(digits).between(15, 16)).when(kind == 3, surface.rlike(r"^\+[1-9][0-9]{0,2}[ (.-]"))
    strict = strict.when(kind == 6, surface.rlike(r"[0-9]") & surface.rlike(r"[A-Za-z]"))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return [
        F.when(kind < BASE, sign(s["base"])).otherwise(0),
        F.when(strict.isNull(), 0).otherwise(sign(strict)),
        F.when(s["left"].rlike(CUES_AGAINST), -1).when(F.concat(s["left"], surface).rlike(CUES_FOR), 1).otherwise(0),
        sign(s["left"].rlike(r"(?:^|[\s(\[<\"':;,=|])$") & s["right"].rlike(r"^$|^[\s)\]>\"':;,.|!?]")),
        F.when(F.length(digits) < 8, 0).otherwise(sign(F.size(F.array_distinct(F.split(digits, ""))) > 3)),
    ]


def features(s: Column) -> list[Column]:
    """Names of the active features of one candidate: each kind has a few dozen at most."""
    kind = s["kind"].cast("string")
    length = F.least(F.floor(F.log2(F.length(s["surface"]) + F.lit(1))), F.lit(8)).cast("string")
    side = lambda c: F.when(c == "", "none").when(c.rlike(r"^\s"), "space").when(c.rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")
    digits = F.floor(4 * F.length(_digits(s["surface"])) / F.length(s["surface"])).cast("string")
    cue = F.when(s["left"].rlike(CUES_AGAINST), "against").when(F.concat(s["left"], s["surface"]).rlike(CUES_FOR), "for").otherwise("none")
    named = (("length", length), ("before", side(F.right(s["left"], F.lit(1)))), ("after", side(s["right"])), ("digits", digits), ("cue", cue), ("valid", s["base"].cast("string")))
    return [F.concat(kind, F.lit(f"/{n}="), v) for n, v in named]


@dataclass(frozen=True)
class SpanModel:
    #: accuracy of each labeler when it votes
    reliability: dict[str, float]
    #: log odds of each kind, and what each feature adds
    prior: dict[int, float]
    weight: dict[str, float]


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], dict[int, float], dict[tuple[int, tuple[int, ...]], float]]:
    """EM over (kind, votes, count): accuracy of each labeler, share of true spans of each kind, posterior of each pattern."""
    accuracy, share = [0.8] * len(LABELERS), {k: 0.5 for k, _, _ in patterns}
    posterior: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, vote, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(a / (1 - a)) for v, a in zip(vote, accuracy, strict=True))
            posterior[kind, vote] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        for i in range(len(accuracy)):
            cast = [(n, posterior[k, v] if v[i] > 0 else 1 - posterior[k, v]) for k, v, n in patterns if v[i]]
            # a weak prior of 8 right votes in 10; below one half a labeler would be read backwards
            accuracy[i] = min(0.99, max(0.51, (sum(n * p for n, p in cast) + 8) / (sum(n for n, _ in cast) + 10)))
        for kind in share:
            own = [(n, posterior[k, v]) for k, v, n in patterns if k == kind]
            share[kind] = min(0.99, max(0.01, (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)))
    return accuracy, share, posterior


def fit(annotated: DataFrame) -> SpanModel:
    """Label model and span classifier from a table with _spans. What reaches the driver is bounded: vote patterns, features."""
    one = annotated.filter(F.size("_spans") > 0).select(F.explode("_spans").alias("s"))
    voted = one.select(F.col("s.kind").alias("kind"), F.array(*votes(F.col("s"))).alias("votes"), F.array(*features(F.col("s"))).alias("features"))
    counted = voted.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    patterns = [(r.kind, tuple(r.votes), r.n) for r in counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()]
    if not patterns:
        return SpanModel({}, {}, {})
    accuracy, share, posterior = estimate(sorted(patterns))
    # soft labels: each vote pattern's posterior, summed for each feature
    told = json.dumps([{"kind": k, "votes": list(v), "label": p} for (k, v), p in sorted(posterior.items())])
    labels = annotated.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<kind:int,votes:array<int>,label:double>>")))
    label = F.col("label")
    soft = counted.join(F.broadcast(labels), ["kind", "votes"]).select("kind", F.explode("features").alias("feature"), (F.col("n") * label).alias("yes"), (F.col("n") * (1 - label)).alias("no"))
    rows = soft.groupBy("kind", "feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    true = {k: sum(n * posterior[k, v] for kind, v, n in patterns if kind == k) for k in share}
    false = {k: sum(n * (1 - posterior[k, v]) for kind, v, n in patterns if kind == k) for k in share}
    weight = {r.feature: math.log((r.yes + 0.5) / (true[r.kind] + 1) * (false[r.kind] + 1) / (r.no + 0.5)) for r in rows}
    return SpanModel(dict(zip(LABELERS, accuracy, strict=True)), {k: math.log(s / (1 - s)) for k, s in share.items()}, weight)


def classify(annotated: DataFrame, model: SpanModel) -> DataFrame:
    """_spans narrowed to the spans found: base ones, and candidates of which the classifier is sure that no base one overlaps.

    Base spans stand in pieces by start; a candidate looks into those pieces only whose reach it touches.
    """
    number = "array<struct<start:int,kind:int,end:int,base:boolean,from:int,to:int>>"
    slim = lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"], s["from"], s["to"])
    base = F.transform(F.filter("_spans", lambda s: s["base"]), slim).cast(number)
    if not model.prior:
        return annotated.withColumn("_spans", base)
    table_of = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    weights, priors = table_of(model.weight), table_of(model.prior)

    def sure(s: Column) -> Column:
        odds = F.coalesce(priors[s["kind"]], F.lit(0.0))
        for f in features(s):
            odds = odds + F.coalesce(weights[f], F.lit(0.0))
        return odds >= math.log(SURE / (1 - SURE))

    meets = lambda a, s: (a["start"] < s["end"]) & (s["start"] < a["end"])
    reach = lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("spans"))
    apart = lambda s, reaches: ~F.exists(reaches, lambda r: meets(r, s) & F.exists(r["spans"], lambda b: meets(b, s)))
    wider = F.filter("_spans", lambda s: ~s["base"] & (s["kind"] >= BASE))

    def found(base: Column) -> Column:
        added = let(F.transform(_chunks(base), reach), lambda reaches: F.filter(wider, lambda s: apart(s, reaches) & sure(s)))
        return F.array_sort(F.concat(base, F.transform(added, slim).cast(number)))

    return annotated.withColumn("_spans", let(base, found))


def find_spans(df: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, SpanModel]:
    """df with _spans (start, kind number, end, base), and the model. Candidates are written once and read by fit and classify."""
    found = candidates(df, text)
    annotated = materialize(found if keep_text else found.drop(text), "pii")
    model = fit(annotated)
    return classify(annotated, model), model


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the spans of _spans in the text by their kind in brackets; of overlapping spans, the first and what sticks out go.

    Pieces are cut out of the text's bytes and joined once, so the time is in proportion to the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ends = running("transform(_spans, s -> s.to)", "greatest(a, v)")

    def cleaned(data: Column) -> Column:
        piece = lambda s, at: F.when(s["from"] >= at, F.concat(F.substring(data, at + 1, s["from"] - at).cast("string"), F.get(names, s["kind"]))).otherwise("")
        last = F.greatest(F.array_max(F.transform("_spans", lambda s: s["to"])), F.lit(0))
        return F.concat(F.array_join(F.zip_with("_spans", ends, piece), ""), F.substring(data, last + 1, F.octet_length(data)).cast("string"))

    return df.withColumn(text, F.when(F.size("_spans") > 0, let(F.col(text).cast("binary"), cleaned)).otherwise(F.col(text)))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found, _ = find_spans(docs, keep_text=False)
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_email"), of(1).alias("n_ip"), of(2).alias("n_card"), of(3).alias("n_phone"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"),
    )
