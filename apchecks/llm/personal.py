"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans that fixed patterns find and that pass their kind's check. They induce lexical patterns:
the shape of a value, the word on its left, and the words on both sides. Patterns and instances (values)
form a graph whose edges count occurrences. Seeds score 1 and values that fail their kind's check 0; the
other values and the patterns score each other in turn: a pattern gets the share of its occurrences that
its values' scores make up, a value the mean of its patterns. Patterns that enough different seeds support
and that score high then discover values that the fixed patterns miss: addresses written ``name [at] host
[dot] tld``, numbers that run into the digits before them, telephone numbers without a country.

A document's text is read once. What is kept of it are its base spans and its candidates, wider matches
with their neighbouring words, which are few; the rest is joins and grouped sums over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Kinds in the order in which spans of one start stand.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive repeats and the look-behinds only save work: where the start of a run of an
#: address's or number's characters fails, all later starts in that run fail alike.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[({]at[\])}]\x20?", r"\x20?[\[({]dot[\])}]\x20?"
_PHONE = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
#: What patterns may discover: addresses with written-out signs, four numbers, ten digits in three groups
#: with or without a country, 12 to 19 digits on end or in the groups of a card.
CANDIDATE = "|".join(
    (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\.|[\[({](?:\.|dot)[\])}])[0-9]{1,3}){3}(?![A-Za-z0-9])",
        rf"(?<![A-Za-z0-9+])(?:\+?[0-9]{{1,3}}[\x20.-])?{_PHONE}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![A-Za-z0-9])",
    )
)
#: How far the neighbouring words may lie, in characters.
REACH = 48
_SALTS = 16


def _number(digits: Column) -> Column:
    """Luhn's check of 12 to 19 digits."""

    def double(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), double) % 10 == 0
    return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)


def _parts_fit(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)


def passes(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes its kind's check."""
    if kind == "ip":
        return _parts_fit(value)
    if kind == "card":
        return _number(F.translate(value, " -", ""))
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern: start, end (in characters, exclusive), value, before and after (the text up to the next match)."""
    found, rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(
        F.zip_with(F.slice(rest, F.lit(1), F.size(found)), found, lambda b, v: F.struct(b.alias("before"), v.alias("value"))), F.slice(rest, F.lit(2), F.size(found)),
        lambda x, a: F.struct(x["before"].alias("before"), x["value"].alias("value"), a.alias("after")),
    )
    nothing = "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["value"])
        row = F.struct(
            start.alias("start"), end.alias("end"), x["value"].alias("value"), F.substring(x["before"], -REACH, REACH).alias("before"),
            F.substring(x["after"], 1, REACH).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.expr(nothing).alias("out")), step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end) of all valid base spans, in order; rank is the place of the kind in ``KINDS``."""
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    there = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(_matches(text, BASE[kind]), lambda m: passes(kind, m["value"]))
        spans = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
        return F.when(there.get(kind, F.regexp_like(text, F.lit("[0-9]"))), spans).otherwise(none)

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def candidates(text: Column) -> Column:
    """Array of the matches of ``CANDIDATE`` with their neighbourhoods."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)")
    return F.when(F.regexp_like(text, F.lit(r"[0-9@]|[\[({]at[\])}]")), _matches(text, CANDIDATE)).otherwise(none)


def _described(found: DataFrame) -> DataFrame:
    """Rank of the kind, value in its plain form, whether it passes its check, and patterns of each candidate ``c``."""
    value = F.col("c.value")
    plain = F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT + r"|[\[({]\.[\])}]", ".")
    rank = (
        F.when(plain.contains("@"), 0).when(F.regexp_like(plain, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")), 1)
        .when(F.regexp_like(plain, F.lit(rf"{_PHONE}$")) & ~F.regexp_like(plain, F.lit("^[0-9]{4}[ -][0-9]{4}[ -]")), 3).otherwise(2)
    )
    d = found.withColumns({"plain": plain, "rank": rank})
    digits = F.regexp_replace("plain", "[^0-9]", "")
    kind = lambda of: F.when(F.col("rank") == 0, of["email"]).when(F.col("rank") == 1, of["ip"]).when(F.col("rank") == 2, of["card"]).otherwise(of["phone"])
    local = F.regexp_replace(F.regexp_replace("plain", rf"^.*?(?={_PHONE}$)", ""), "[0-9]", "9")
    shape = {
        "email": F.regexp_replace(F.regexp_replace("plain", "[A-Za-z]+", "a"), "[0-9]+", "9"),
        "ip": F.lit("9.9.9.9"),
        "card": F.concat(F.lit("9x"), F.length(digits).cast("string")),
        "phone": F.btrim(F.regexp_replace(local, r"[\x20()-]+", "-"), F.lit("-")),
    }
    d = d.withColumns(
        {
            "ok": kind({"email": F.lit(True), "ip": _parts_fit(F.col("plain")), "card": _number(digits), "phone": F.length(digits).between(9, 15)}),
            "instance": kind({"email": F.lower("plain"), "ip": F.col("plain"), "card": digits, "phone": digits}),
            "shape": kind(shape),
            "left": F.regexp_extract(F.lower("c.before"), r"(\p{L}+)[^\p{L}]*\z", 1),
            "right": F.regexp_extract(F.lower("c.after"), r"(\p{L}+)", 1),
        }
    )
    k = F.col("rank").cast("string")
    patterns = F.array(
        F.concat_ws("|", F.lit("shape"), k, "shape"), F.when(F.col("left") != "", F.concat_ws("|", F.lit("left"), k, "left")),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws("|", F.lit("around"), k, "left", "right")),
    )
    return d.select("row_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), "rank", "ok", "instance", F.array_compact(patterns).alias("patterns"))


def _occurrences(read: DataFrame) -> DataFrame:
    """Candidates that are a base span (``seed``) or overlap none."""
    base = read.select("row_id", F.explode("base").alias("b")).select(
        "row_id", "b.start", "b.end", "b.rank", F.lit(True).alias("base"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("instance"),
        F.lit(None).cast("array<string>").alias("patterns"),
    )
    found = _described(read.select("row_id", F.explode("found").alias("c"))).withColumn("base", F.lit(False))
    keys = ["row_id", "start", "end", "rank"]
    rows = base.unionByName(found).repartition("row_id").groupBy(*keys).agg(
        F.max("base").alias("seed"), F.max("ok").alias("ok"), F.max("instance").alias("instance"), F.max("patterns").alias("patterns")
    )
    before = Window.partitionBy("row_id").orderBy("start", F.desc("seed"), "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row_id").orderBy(F.desc("start"), "seed", F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("last_end", F.max(F.when(F.col("seed"), F.col("end"))).over(before)).withColumn("next_start", F.min(F.when(F.col("seed"), F.col("start"))).over(after))
    free = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next_start"), F.col("end")) >= F.col("end"))
    return placed.filter(F.col("patterns").isNotNull() & (F.col("seed") | free)).select(*keys, "seed", "ok", "instance", "patterns")


def _with_scores(edges: DataFrame, scores: DataFrame, salt_by: Column) -> DataFrame:
    """Edges with the score of their pattern; a frequent pattern's edges are dealt over salts."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(_SALTS)).cast("int"))
    return salted.join(scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["pattern", "salt"])


def pattern_scores(occurrences: DataFrame, scratch: Scratch, least_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """(pattern, score) of the patterns that at least ``least_seeds`` different seed values support."""
    exploded = occurrences.select(F.explode("patterns").alias("pattern"), "rank", "instance", "seed", "ok")
    edges = exploded.groupBy("pattern", "rank", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("ok").alias("ok"))
    values = occurrences.groupBy("rank", "instance").agg(F.max("seed").alias("known"), F.sum(F.size("patterns")).alias("degree"))
    edges = scratch.save(edges.drop("seed").join(values, ["rank", "instance"]), "edges")
    n = F.sum("n").alias("n")
    patterns = edges.groupBy("pattern").agg(n, F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("seeds"), F.count_if("known").alias("support"))
    patterns = scratch.save(patterns.filter(F.col("support") >= least_seeds), "patterns")
    open_edges = edges.filter(~F.col("known") & F.col("ok")).select("pattern", "rank", "instance", "n", "degree")
    scores = scratch.save(patterns.select("pattern", (F.col("seeds") / (F.col("n") + 1)).alias("score")), "scores")
    for _ in range(rounds):
        given = _with_scores(open_edges, scores, F.col("instance"))
        value = given.groupBy("rank", "instance").agg((F.sum(F.col("n") * F.col("score")) / F.first("degree")).alias("value"))
        gained = open_edges.join(value, ["rank", "instance"]).groupBy("pattern").agg(F.sum(F.col("n") * F.col("value")).alias("gain"))
        grown = patterns.join(gained, "pattern", "left").select("pattern", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)).alias("score"))
        scores = scratch.save(grown, "scores")
    return scores


def find(docs: DataFrame, least_seeds: int = 5, least_score: float = 0.8, rounds: int = 3) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, rank, end) in order, in characters of the whole text.

    ``base`` has what the fixed patterns find, ``spans`` that and what the induced patterns add, which
    passes its kind's check and overlaps no base span. Null and empty texts have none; each row is a
    document of its own, also where an id or a text repeats, and equal texts get equal spans; an empty
    table gives no rows; other columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    text = F.coalesce("text", F.lit(""))
    read = scratch.save(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", base_spans(text).alias("base"), candidates(text).alias("found")), "read")
    occurrences = scratch.save(_occurrences(read), "occurrences")
    scores = pattern_scores(occurrences, scratch, least_seeds, rounds)
    unseen = occurrences.filter(~F.col("seed") & F.col("ok")).select("row_id", "start", "rank", "end", F.explode("patterns").alias("pattern"))
    sure = _with_scores(unseen, scores.filter(F.col("score") >= least_score), F.col("row_id"))
    added = sure.groupBy("row_id", "start", "rank", "end").count().groupBy("row_id").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    whole = F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    out = materialize(read.join(added, "row_id", "left").select("doc_id", "base", whole.alias("spans")), "personal-found")
    scratch.drop(*list(scratch.paths))
    return out


def spans_text(spans: str) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
