"""Personal data: base spans, and bootstrapped contextual extraction. DataFrame operations alone.

Base entities, and keys of many hexadecimal digits, seed the bootstrap. Words around whole base spans, identifier-like tokens and runs
of such tokens are patterns; a bipartite graph joins patterns with the values they extract. Each round scores patterns by
the share of their values that are believed, and values by the patterns that extract them;
trusted patterns then mark identifiers that no base expression knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import UPPER, prepare, stored

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that the bootstrap adds.
FOUND = "id"
#: The base expressions, written so that no text takes more than linear time; matches are the same.
_LOCAL = "A-Za-z0-9._%+-"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9][0-9\x20-]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a text can't hold the kind.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
#: Rounds of the bootstrap; distinct believed values and share of them that a pattern needs; belief that a value needs.
ROUNDS, SUPPORT, CONFIDENCE, BELIEF = 3, 3, 0.6, 0.8
#: Keys by their shape alone: as many hexadecimal digits, letters and figures among them. They are seeds too.
KEY = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Digits that a value needs to be taken for an identifier; code points that a value outside of base spans needs, and those beyond which it is compared by its hash.
DIGITS, LEAST, HASHED = 4, 5, 64
#: What may part the tokens of a run (blanks, and one bank code of four capitals, no more than WORD code points in all), and how tokens end and begin where they go on.
BETWEEN, ENDS, BEGINS = r"^[\x20\x09]+(?:[A-Z]{4}[\x20\x09]+)?$", r"^[^@]*[\p{L}0-9)-]$", r"^[\p{L}0-9(+][^@]*$"
#: Elements summed in one step of a prefix sum.
CHUNK = 64
#: Code points of the longest word that patterns tell apart: longer ones are all the same word to them, written LONG. Two words and their blanks take WIDE at most.
WORD, LONG = 64, "\u2026"
WIDE = 2 * WORD + 3


def with_steps(df: DataFrame, name: str) -> DataFrame:
    """Add `name`_step: code points from the start of each match to the start of the next."""
    n = F.col(name)
    step = F.transform(n, lambda v, i: (F.element_at(F.col(f"{name}_gaps"), i + 1) + F.when(i > 0, F.length(F.try_element_at(n, i))).otherwise(0)).cast("long"))
    return df.withColumn(f"{name}_step", step)


def located(df: DataFrame, name: str) -> DataFrame:
    """Add `name`_spans (start, end, value) by a prefix sum in two levels, so that long arrays stay cheap; needs stored columns."""
    total = lambda a, start, n: F.aggregate(F.slice(a, start, n), F.lit(0).cast("long"), lambda x, y: x + y)
    step, value = F.col(f"{name}_step"), F.col(name)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / CHUNK).cast("int")), lambda c: total(step, c * CHUNK + 1, F.lit(CHUNK)))
    df = df.withColumn(f"{name}_sum", F.when(F.size(step) > 0, chunks))
    base = F.transform(F.col(f"{name}_sum"), lambda _, c: total(F.col(f"{name}_sum"), F.lit(1), c))
    df = df.withColumn(f"{name}_base", base)

    def span(v: Column, i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        start = F.element_at(F.col(f"{name}_base"), c + 1) + total(step, c * CHUNK + 1, i - c * CHUNK + 1)
        return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

    return df.withColumn(f"{name}_spans", F.coalesce(F.transform(value, span), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")))


def luhn(digits: Column) -> Column:
    def add(total: Column, x: Column) -> Column:
        n = x.cast("int") * (F.pmod(total["i"], F.lit(2)) + 1)
        return F.struct((total["s"] + n - F.when(n > 9, 9).otherwise(0)).alias("s"), (total["i"] + 1).alias("i"))

    each = F.split(F.reverse(digits), "(?<=.)(?=.)")
    return F.aggregate(each, F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), add, lambda t: F.pmod(t["s"], F.lit(10)) == 0)


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts: ip parts at most 255; 12 to 19 card digits passing Luhn; 9 to 15 phone digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def kept(kind: str) -> Column:
    """The spans of a kind that count, as (start, rank, end, value)."""
    good = F.filter(f"{kind}_spans", lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["end"], s["value"]))


def short(x: Column) -> Column:
    """Words with one blank between them, long ones as LONG."""
    return F.regexp_replace(F.regexp_replace(x, rf"[{_SPACE}]++", " "), rf"[^\x20]{{{WORD + 1},}}+", LONG)


def words_before(i: Column) -> Column:
    """The words before token i, two at least where there are so many, be they tokens or not."""
    gap = lambda k: F.element_at("before", i + 1 - k)
    token = lambda k: short(F.element_at("token", i + 1 - k))
    second = F.concat(F.when((i > 1) & (F.length(gap(1)) < WIDE), token(2)).otherwise(""), gap(1), token(1))
    return F.right(F.concat(F.when((i > 0) & (F.length(gap(0)) < WIDE), second).otherwise(""), gap(0)), F.lit(WIDE))


def words_after(i: Column) -> Column:
    """The word after token i, be it a token or not."""
    gap = F.element_at("after", i + 2)
    return F.concat(gap, F.when((F.trim(gap) == "") & (i + 1 < F.size("token")), short(F.element_at("token", i + 2))).otherwise(""))


def of_rank(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def matches(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, base spans (start, kind rank, end), the same with their values, and identifier-like tokens with the gap before them and their contexts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # where two separators meet, a card ends: both are masked, so that a plain class matches what lies between
    masked = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "#")
    columns = [F.monotonically_increasing_id().alias("rid"), "doc_id"]
    for name, expression in [*EXPRESSIONS.items(), ("token", TOKEN)]:
        source = masked if name == "card" else text
        gate = text.rlike(GATES.get(name, "[0-9@]"))
        columns.append(F.when(gate, F.regexp_extract_all(source, F.lit(expression), F.lit(0))).alias(name))
        parts = F.split(source, expression, -1)
        columns.append(F.when(gate, F.transform(parts, lambda x: F.length(x))).alias(f"{name}_gaps"))
        if name == "token":
            first = lambda x: short(F.regexp_extract(x, rf"^[{_SPACE}]*+[^{_SPACE}]*+", 0))
            columns += [F.when(gate, F.transform(parts, lambda x: F.right(short(x), F.lit(WIDE)))).alias("before"), F.when(gate, F.transform(parts, first)).alias("after")]
            columns.append(F.when(gate, F.transform(parts, lambda x: F.when(F.length(x) <= WORD, x).otherwise(LONG))).alias("between"))
    raw = stored(docs.select("doc_id", "text").select(*columns), "matches")
    for name in (*KINDS, "token"):
        raw = with_steps(raw, name)
    raw = stored(raw.drop(*(f"{k}_gaps" for k in (*KINDS, "token"))), "steps")
    for name in (*KINDS, "token"):
        raw = located(raw, name)
    spans = [kept(k) for k in KINDS]
    tokens = F.transform("token_spans", lambda s, i: F.struct(s["start"], s["end"], s["value"], F.element_at("between", i + 1).alias("gap"), words_before(i).alias("before"), words_after(i).alias("after")))
    base = F.transform("entities", lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return stored(raw.select("rid", "doc_id", F.array_sort(F.concat(*spans)).alias("entities"), tokens.alias("tokens")).select("rid", "doc_id", base.alias("base"), "entities", "tokens"), "spans")


def compared(value: Column) -> Column:
    return F.when(F.length(value) > HASHED, F.sha2(value.cast("binary"), 256)).otherwise(value)


def seeds_of(rows: DataFrame) -> DataFrame:
    """Each base span as one instance; its context is what stands around the words that it touches."""

    def one(b: Column) -> Column:
        first = F.size(F.filter("tokens", lambda t: t["end"] <= b["start"])) + 1
        last = F.size(F.filter("tokens", lambda t: t["start"] < b["end"]))
        return F.struct(b["start"], b["end"], b["value"], F.element_at("tokens", first)["before"].alias("before"), F.element_at("tokens", last)["after"].alias("after"))

    return rows.where(F.size("entities") > 0).select("rid", F.inline(F.transform("entities", one))).withColumn("seed", F.lit(True)).withColumn("known", F.lit(True)).withColumn("place", compared(F.col("value")))


def candidates(rows: DataFrame) -> DataFrame:
    """Tokens clear of base spans, and runs of them: whole, and without the first or the last token, which may be a number of its own.

    Candidates of one run share a `place`. Punctuation around a candidate isn't part of it.
    """
    hit = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
    marked = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t["start"], t["end"], t["value"], t["gap"], t["before"], t["after"], hit(t).alias("hit")))
    free = rows.where(F.size("tokens") > 0).select("rid", F.inline(F.filter(marked, lambda t: ~t["hit"]))).drop("hit")
    w = Window.partitionBy("rid").orderBy("i")
    digit = F.col("value").rlike("[0-9]") & F.lag("value").over(w).rlike("[0-9]")
    goes_on = (F.lag("i").over(w) == F.col("i") - 1) & digit & F.col("gap").rlike(BETWEEN) & F.lag("value").over(w).rlike(ENDS) & F.col("value").rlike(BEGINS)
    free = free.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    free = free.withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    part = F.struct("i", "start", "end", "value", "gap", "before", "after")
    runs = free.groupBy("rid", "run").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    n = F.size("parts")

    def cut(first: int, length: Column) -> Column:
        kept = F.slice("parts", first, length)
        a, z = F.element_at(kept, 1), F.element_at(kept, -1)
        text = F.array_join(F.transform(kept, lambda p, i: F.concat(F.when(i > 0, p["gap"]).otherwise(""), p["value"])), "")
        return F.struct(a["start"].alias("start"), z["end"].alias("end"), text.alias("value"), a["before"].alias("before"), z["after"].alias("after"))

    single = F.transform("parts", lambda p: F.struct(p["start"], p["end"], p["value"], p["before"], p["after"]))
    none = F.slice(single, 1, 0)
    all_ = F.concat(single, F.when(n > 1, F.array(cut(1, n))).otherwise(none), F.when(n > 2, F.array(cut(2, n - 1), cut(1, n - 1))).otherwise(none))
    one = runs.withColumn("place", compared(cut(1, n)["value"])).select("rid", "place", F.inline(all_))
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+@]*+", 0))
    core = F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}0-9+@]++", ""), r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")
    one = one.withColumn("start", F.col("start") + lead).withColumn("value", core).withColumn("end", F.col("start") + F.length("value"))
    return one.where((F.length("value") >= LEAST) & F.col("value").rlike("[0-9@]")).withColumn("seed", F.col("value").rlike(KEY)).withColumn("known", F.lit(False))


def instances(rows: DataFrame) -> DataFrame:
    """One row per base span or candidate and pattern: rid, start, end, value, place, digits (it has enough), seed (a base span or a key), known (a base span), pattern.

    Patterns are the two words before the instance, and the word before with the word after;
    an instance without a word before has one row with none. Words may hold digits. A long value is its hash.
    """
    one = seeds_of(rows).unionByName(candidates(rows))
    low = lambda c: F.translate(c, UPPER, UPPER.lower())
    left = F.regexp_extract(low(F.col("before")), rf"([^{_SPACE}]+[{_SPACE}]+[^{_SPACE}]+)[{_SPACE}]*$", 1)
    last = F.regexp_extract(low(F.col("before")), rf"([^{_SPACE}]+)[{_SPACE}]*$", 1)
    right = F.regexp_extract(low(F.col("after")), rf"^[{_SPACE}]*([^{_SPACE}]+)", 1)
    patterns = F.array(F.when(left != "", F.concat(F.lit("L "), F.regexp_replace(left, rf"[{_SPACE}]+", " "))), F.when((last != "") & (right != ""), F.concat_ws(" ", F.lit("M"), last, F.lit("_"), right)))
    digits = F.length(F.regexp_replace("value", "[^0-9]", "")) >= DIGITS
    return one.select("rid", "start", "end", compared(F.col("value")).alias("value"), "place", digits.alias("digits"), "seed", "known", F.explode_outer(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern"))


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Values with their belief (1 for seeds), after scoring the pattern-instance graph `rounds` times.

    Candidates of one place count once for a pattern, by the one believed most.
    """
    edges = stored(found.where("pattern IS NOT NULL OR seed").groupBy("pattern", "place", "value").agg(F.max("seed").alias("seed")), "edges")
    seeds = edges.where("seed").select("value").distinct().withColumn("belief", F.lit(1.0))
    belief = seeds
    for _ in range(rounds):
        known = edges.where("pattern IS NOT NULL").join(belief, "value", "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
        places = known.groupBy("pattern", "place").agg(F.max("belief").alias("belief"), F.max_by("value", "belief").alias("value"))
        scored = places.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("belief").alias("s"), F.countDistinct(F.when(F.col("belief") >= BELIEF, F.col("value"))).alias("k"))
        trusted = scored.where((F.col("k") >= support) & (F.col("s") >= confidence * F.col("n"))).select("pattern", (F.col("s") / (F.col("n") + 0.5)).alias("c"))
        trusted = stored(trusted, "trusted")  # so that a hot pattern's join can be split
        doubt = edges.select("pattern", "value").distinct().join(trusted, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("belief"))
        belief = stored(doubt.join(seeds.select("value"), "value", "left_anti").unionByName(seeds), "belief")
    return belief


def find_private(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, base and found spans, as arrays of (start, rank, end) in code points.

    Null and empty texts have none; texts of any length are searched whole. Repeated rows are
    found each for itself; a value counts once per pattern, however many rows repeat it. Of
    values that a pattern believes equally, any one stands for their place. Extra columns
    are not read.
    """
    prepare(docs.sparkSession)
    rows = matches(docs)
    found = stored(instances(rows), "instances")
    belief = bootstrap(found).where(F.col("belief") >= BELIEF).select("value")
    new = found.where(~F.col("known") & F.col("digits")).select("rid", "start", "end", "value").distinct().join(belief, "value")
    # the longest of nested finds stays
    before = F.max("end").over(Window.partitionBy("rid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    new = new.withColumn("reached", before).where(F.col("reached").isNull() | (F.col("end") > F.col("reached")))
    new = new.groupBy("rid").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end")).alias("new"))
    return rows.select("rid", "doc_id", "base").join(new, "rid", "left").select("doc_id", "base", F.array_sort(F.coalesce("new", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))).alias("found"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (spans that the method adds), n_spans (all)."""
    rows = find_private(docs)
    counts = [of_rank(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"))
