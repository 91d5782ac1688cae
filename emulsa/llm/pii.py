"""Personal data: patterns, and contexts that are learned from what the patterns find.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern; secrets (tokens, keys, passwords)
are seeded by what they are assigned to. Bootstrapping: every token that looks like an identifier (it has a digit or an @, and
MIN_LENGTH characters at least, and is no number between numbers) is an instance, and so are the first and the last up to
MAX_PARTS tokens of a numeric run and addresses with a spelled-out at sign, with the words on the left and right as context; instances that are a span of the base are seeds of its
kind. A part of a longer numeric run is judged, but is no evidence. A pattern is a kind's left word, right word, or both.

In each round patterns are scored by their instances, then instances by their patterns. A pattern's confidence for a kind is
the mean over its distinct instances: seeds of the kind count 1, instances that were accepted for it count their score, all
others 0; it needs MIN_SEEDS instances that count, and is weighed by their number. An instance is accepted with the score of
its best pattern if that is MIN_CONFIDENCE or more and if it could be of the kind at all (LIKE, and the number of digits).
Accepted instances are evidence in the next round, so they induce patterns in contexts that no seed has; rounds end when
nothing changes (a round without news is the last; ROUNDS only guards against scores that swing). What is accepted becomes a span of its kind; of overlapping ones the longest.

All of it is column expressions, one pass over the texts into a narrow table of instances, and aggregates by pattern; a
frequent context is summed before it is shuffled, and only patterns that hold (a few) meet the instances again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_split, let, pinned, row_key, running, table, text_of, upto, written

KINDS = ("email", "ip", "card", "phone")
#: Found beside them; no part of the base.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
# The patterns. Possessive groups match what plain ones would (nothing follows them that could take back a
# character) without recursion; a run is tried once, from its first character or from the end of the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

#: Secrets by what they are assigned to.
ASSIGNED = r"(?:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
SECRET_SEED, SECRET_HINT = rf"(?i)(?<={ASSIGNED})(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{{16,}}+", rf"(?i){ASSIGNED}[A-Za-z0-9+/_.~-]{{16}}"

ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_LENGTH = 20, 5, 0.9, 7
#: A token that may be an identifier, with the word before and after it.
TOKEN = r"(?<![^\s])(?=[^\s]*(?:[0-9]|@))[^\s]{%d,}" % MIN_LENGTH
#: Numeric tokens in a run are read together, so many at most.
MAX_PARTS = 6
NUMERIC = r"[+(\[]{0,2}[0-9][0-9().\]/+-]*+"
RUN = rf"(?<![^\s]){NUMERIC}(?:\x20++{NUMERIC})++"
#: Addresses whose at sign is bracketed, spelled out or between spaces.
SPELLED = r"(?i)(?<![^\s])(?:[^\s@\[({<]++\x20?[\[({<](?:at|@)[\])}>]\x20?[^\s]++(?:\x20?[\[({<]dot[\])}>]\x20?[^\s]++|\x20dot\x20[^\s]++)*+|[\p{L}\p{N}._%+-]++\x20(?:at|@)\x20[\p{L}\p{N}-]++(?:(?:\.|\x20dot\x20)[\p{L}\p{N}-]++)++)"
SPELLED_HINT = r"(?i)[\[({<](?:at|@)[\])}>]|\x20(?:at|@)\x20[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}]|\x20dot\x20)"
#: What an instance of a kind can look like at all; its context decides the rest.
LIKE = {
    "email": r"(?i)^(?=.*\p{L}{2}[\p{L}\p{N}-]*$)[\p{L}\p{N}][\p{L}\p{N}._%+'-]*(?:\s?[\[({<](?:at|@)[\])}>]\s?|\s(?:at|@)\s|[@%#*=~!|&$^]+|[._-]at[._-])[\p{L}\p{N}][\p{L}\p{N}-]*(?:(?:\.|\s?[\[({<](?:dot|\.)[\])}>]\s?|\sdot\s)[\p{L}\p{N}-]+)*$",
    "ip": r"^(?:[0-9]{1,3}(?:(?:[.,:;_/-]|\x20|[\[({](?:\.|dot)[\])}])[0-9]{1,3}){3}|(?=.*(?:::|[A-Fa-f]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})$",
    "card": r"^[0-9][0-9 ._/\u2013-]*[0-9]$",
    "phone": r"^[+(\[]*[0-9][0-9() .\[\]/\u2013-]*[0-9)]$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.~=-]{16,}$",
}
DIGITS = {"card": (12, 19), "phone": (MIN_LENGTH, 15)}
MAX_LENGTH = 254
#: Characters of context that are read on either side; patterns and instances up to which what holds is broadcast.
CONTEXT, MAX_BROADCAST = 41, 200_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass: every second digit from the right counts twice, less 9 if over 9."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.lpad(F.right(p, F.lit(3)), 3, "0") <= "255"))
    n = F.length(_digits(x))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(x))).otherwise(False)
    return n.between(9, 15)


def found(text: Column, pattern: str, context: int = 0) -> Column:
    """start, end (code points, end exclusive) and text of each match, leftmost first; with context also before and after: so many characters of the gap, and the neighbouring match if the gap is shorter."""

    def placed(gaps: Column, matches: Column) -> Column:
        # Before match i stand gaps 0..i and matches 0..i-1.
        size = F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))
        beside = lambda gap, match, side: F.when(F.length(gap) < context, F.coalesce(side(match, F.lit(context)), F.lit(""))).otherwise("")
        near = lambda i: [F.concat(beside(F.get(gaps, i), F.get(matches, i - 1), F.right), F.right(F.get(gaps, i), F.lit(context))).alias("before"), F.concat(F.left(F.get(gaps, i + 1), F.lit(context)), beside(F.get(gaps, i + 1), F.get(matches, i + 1), F.left)).alias("after")] if context else []
        at = lambda s, m, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("text"), *near(i))
        return let(running(size), lambda s: F.transform(matches, lambda m, i: at(s, m, i)))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: placed(gaps, m)))


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(text.rlike(HINTS[kind]), F.filter(found(text, PATTERNS[kind]), lambda x: _holds(kind, x["text"]))).otherwise(none)


def _like(kind: str, x: Column) -> Column:
    """Whether x could be of the kind."""
    digits = F.length(_digits(x)).between(*DIGITS[kind]) if kind in DIGITS else F.lit(True)
    return (F.length(x) <= MAX_LENGTH) & digits & x.rlike(LIKE[kind])


def secret_spans(text: Column) -> Column:
    """Like base_spans(), of what is assigned to a name that secrets have."""
    return F.when(text.rlike(SECRET_HINT), F.filter(found(text, SECRET_SEED), lambda x: _like(SECRET, x["text"]))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def _parts(run: Column) -> Column:
    """The first and the last 2 to MAX_PARTS numeric tokens of a run, by the number of digits that a kind allows, with what stands around them.

    Stretches from within a run have numbers on both sides and so no context; without them a run gives so many at most, however long it is.
    """

    def stretches(p: Column) -> Column:
        # Tokens of a run stand one space apart, or more; a stretch is put together from its tokens and what is between them.
        between = lambda i: F.concat(F.get(p, i)["text"], F.repeat(F.lit(" "), F.get(p, i + 1)["start"] - F.get(p, i)["end"]))
        whole = lambda i, n: F.concat(F.array_join(F.transform(upto(n - 1), lambda k: between(i + k)), ""), F.get(p, i + n - 1)["text"])
        before = lambda i: F.when(i > 0, F.concat(F.lit(" "), F.get(p, i - 1)["text"], F.lit(" "))).otherwise(run["before"])
        after = lambda i: F.when(i < F.size(p), F.concat(F.lit(" "), F.get(p, i)["text"], F.lit(" "))).otherwise(run["after"])
        one = lambda i, n: F.struct((run["start"] + F.get(p, i)["start"]).alias("start"), (run["start"] + F.get(p, i + n - 1)["end"]).alias("end"), whole(i, n).alias("text"), before(i).alias("before"), after(i + n).alias("after"))
        some = F.transform(F.sequence(F.lit(2), F.lit(MAX_PARTS)), lambda n: F.when(F.size(p) == n, F.array(one(F.lit(0), n))).when(F.size(p) > n, F.array(one(F.lit(0), n), one(F.size(p) - n, n))))
        return F.flatten(F.filter(some, lambda x: x.isNotNull()))

    return F.filter(let(found(run["text"], r"[^\x20]+"), stretches), lambda x: F.length(_digits(x["text"])).between(4, 19))


def _instances(text: Column) -> Column:
    """start, end, text, left, right of what looks like an identifier, without the punctuation around it; whole: it is no part of a longer numeric run."""

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x["text"], r"^[^\p{L}\p{N}+(]+", "")
        core = F.regexp_replace(bare, r"[^\p{L}\p{N})]+$", "")
        start = x["start"] + F.length(x["text"]) - F.length(bare)
        word = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]+$|^[^\p{L}\p{N}]+", ""))
        part = x["text"].rlike(rf"^{NUMERIC}(?:\x20++{NUMERIC})*+$") & (x["before"].rlike(rf"(?:^|\s){NUMERIC}\x20+$") | x["after"].rlike(rf"^\x20+{NUMERIC}(?:\s|$)"))
        # The nearest words with a letter or digit; an equals sign alone is none.
        left, right = F.regexp_extract(x["before"], r"(\S+)\s+(?:[^\p{L}\p{N}\s]+\s+)*$", 1), F.regexp_extract(x["after"], r"^\s+(?:[^\p{L}\p{N}\s]+\s+)*(\S+)", 1)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("text"), word(left).alias("left"), word(right).alias("right"), (~part).alias("whole"))

    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    runs = F.when(text.rlike(RUN), F.flatten(F.transform(found(text, RUN, CONTEXT), _parts))).otherwise(none)
    spelled = F.when(text.rlike(SPELLED_HINT), found(text, SPELLED, CONTEXT)).otherwise(none)
    # A number between numbers has no context: tables and logs are full of them.
    between = lambda x: x["before"].rlike(rf"(?:^|\s){NUMERIC}\s+$") & x["after"].rlike(rf"^\s+{NUMERIC}(?:\s|$)") & x["text"].rlike(rf"^{NUMERIC}$")
    tokens = F.when(text.rlike("[0-9@]"), F.filter(found(text, TOKEN, CONTEXT), lambda x: ~between(x))).otherwise(none)
    all_of = F.concat(tokens, runs, spelled)
    return F.transform(all_of, one)


def _patterns(instances: DataFrame) -> DataFrame:
    """instances, and each of their contexts as a pattern; empty words make none."""
    both = [F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws("\x00", F.lit("b"), "left", "right")), F.when(F.col("left") != "", F.concat_ws("\x00", F.lit("l"), "left")), F.when(F.col("right") != "", F.concat_ws("\x00", F.lit("r"), "right"))]
    return instances.select("*", F.explode_outer(F.array_compact(F.array(*both))).alias("pattern")).filter(F.col("pattern").isNotNull())


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pattern, k (place in ALL_KINDS), confidence of the patterns that hold after the last round.

    instances: text, left, right, k (null if it is no seed), could (of which kinds it could be). Repeats of one text in one
    context count once; a text that is a seed of several kinds is one of the first.
    """
    graph = _patterns(instances.groupBy("text", "left", "right").agg(F.min("k").alias("k"), F.first("could").alias("could")))
    edges = graph.groupBy("text", "pattern").agg(F.min("k").alias("k"), F.first("could").alias("could"))
    # A secret is known by where it was assigned, and is the same elsewhere; the other kinds are known by their form.
    secrets = written(instances.filter(F.col("k") == len(KINDS)).groupBy("text").agg(F.min("k").alias("of")), "known-secrets")
    edges = edges.join(F.broadcast(secrets) if secrets.count() <= MAX_BROADCAST else secrets, "text", "left")
    edges = written(edges.select("text", "pattern", F.coalesce("k", "of").alias("k"), "could"), "pattern-graph")
    kinds = range(len(ALL_KINDS))
    seeds = [F.count(F.when(F.col("k") == k, 1)).alias(f"seeds{k}") for k in kinds]
    stats = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), *seeds).filter(F.col("n") >= min_seeds), "pattern-stats")
    free = edges.filter("k is null").select("text", "pattern", "could")
    held, accepted, before, total = None, None, 0, 0.0
    for _ in range(max(1, rounds)):
        if accepted is None:
            now = stats.select("*", *[F.lit(0).alias(f"new{k}") for k in kinds], *[F.lit(0.0).alias(f"score{k}") for k in kinds])
        else:
            told = free.join(F.broadcast(accepted) if before <= MAX_BROADCAST else accepted, "text").groupBy("pattern")
            told = told.agg(*[F.count(F.when(F.col("as") == k, 1)).alias(f"new{k}") for k in kinds], *[F.coalesce(F.sum(F.when(F.col("as") == k, F.col("score"))), F.lit(0.0)).alias(f"score{k}") for k in kinds])
            now = stats.join(told, "pattern", "left").na.fill(0)
        each = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"seeds{k}") + F.col(f"new{k}")).alias("m"), (F.col(f"seeds{k}") + F.col(f"score{k}")).alias("sum")) for k in kinds])
        scored = now.select("pattern", "n", F.explode(each).alias("e")).select("pattern", "e.k", (F.col("e.sum") / F.col("n") * F.col("e.m") / (F.col("e.m") + 0.1)).alias("confidence"), F.col("e.m").alias("m"))
        held = written(scored.filter((F.col("m") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "k", "confidence"), "pattern-scores")
        met = free.join(F.broadcast(held) if held.count() <= MAX_BROADCAST else held, "pattern").filter(F.get("could", "k"))
        accepted = written(met.groupBy("text").agg(F.max(F.struct("confidence", "k")).alias("best")).select("text", F.col("best.k").alias("as"), F.col("best.confidence").alias("score")), "accepted-instances")
        was, (before, total) = (before, total), accepted.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if was[0] == before and abs(was[1] - total) < 1e-9:
            break
    return held


def personal_data(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of docs: doc_id; base, extra and spans: arrays of (kind, start, end), by kind in the order of ALL_KINDS, then start.

    base holds what the patterns of KINDS match, extra the secrets and what the contexts give, spans both. start and end count
    code points, end exclusive. Null texts are empty. Rows without doc_id are like any other; repeated rows give repeated
    rows. An empty table gives an empty result. Other columns are ignored.
    """
    docs = pinned(docs, {"doc_id": "bigint", "text": "string"})
    spans = F.flatten(F.array(*[_tagged(base_spans(F.col("t"), kind), k) for k, kind in enumerate(KINDS)]))
    seen = docs.select("doc_id", row_key("doc_id", "text").alias("row"), text_of().alias("t")).select("doc_id", "row", spans.alias("base"), _tagged(secret_spans(F.col("t")), len(KINDS)).alias("secret"), _instances(F.col("t")).alias("instances"))
    seen = written(seen, "pii")
    some = seen.filter((F.size("instances") > 0) | (F.size("secret") > 0)).dropDuplicates(["row"])
    each = some.select("row", F.explode_outer("instances").alias("i")).filter("i is not null").select("row", "i.start", "i.end", "i.text", "i.left", "i.right", "i.whole", F.lit(None).cast("int").alias("k"))
    known = some.select("row", F.explode_outer(F.concat("base", "secret")).alias("b")).filter("b is not null").select("row", "b.start", "b.end", *[F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("left", "string"), ("right", "string"), ("whole", "boolean"))], "b.k")
    # Spans and instances of a document in one order: what equals a span is a seed, what meets one otherwise is left out.
    order, back = Window.partitionBy("row").orderBy("start", "end"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"))
    spanned = F.col("k").isNotNull()
    at = each.unionByName(known).select(
        "*", F.min("k").over(order.rangeBetween(Window.currentRow, Window.currentRow)).alias("inside"),
        F.max(F.when(spanned, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("reached"),
        F.min(F.when(spanned, F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("coming"),
    )
    covered = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("coming") < F.col("end"), F.lit(False))
    could = F.array(*[_like(kind, F.col("text")) for kind in ALL_KINDS])
    each = at.filter(F.col("text").isNotNull() & (F.col("inside").isNotNull() | ~covered)).select("row", "start", "end", "text", "left", "right", "whole", F.col("inside").alias("k"), could.alias("could"))
    each = written(each, "pii-instances")
    good = bootstrap(each.filter("k is not null or whole").select("text", "left", "right", "k", "could"), rounds, min_seeds, min_confidence)
    free = _patterns(each.filter("k is null")).select("row", "start", "end", "could", "pattern")
    new = free.join(F.broadcast(good) if good.count() <= MAX_BROADCAST else good, "pattern").filter(F.get("could", "k"))
    new = new.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "k")).alias("best"))
    new = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("best.k").alias("k")))).alias("new"))
    extra = new.select("row", F.transform(_longest(F.col("new")), lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"))).alias("new"))
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    names = F.array(*map(F.lit, ALL_KINDS))
    out = lambda c: F.transform(c, lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = join_split(seen.select("doc_id", "row", "base", "secret"), written(extra, "pii-extra"), "row", "left").select("doc_id", "base", F.array_sort(F.concat("secret", F.coalesce("new", none))).alias("extra"))
    return joined.select("doc_id", out(F.col("base")).alias("base"), out(F.col("extra")).alias("extra"), out(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def _longest(spans: Column) -> Column:
    """Of spans in order of their start, those that meet no other; of two that meet, the longer, of equals the first."""
    size = lambda x: x["end"] - x["start"]

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        meets = F.coalesce(last["end"] > x["start"], F.lit(False))
        return F.when(~meets, F.concat(kept, F.array(x))).when(size(x) > size(last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,k:int>>"), step)


def _tagged(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 of the base; spans and n_found of all, secrets included, which have columns of their own too."""
    found = personal_data(table(spark, sf_dir, "documents"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    secret = F.filter("spans", lambda x: x["kind"] == SECRET)
    return found.select(
        "doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size(secret).cast("long").alias("n_secret"), told(secret).alias("secrets"), F.size("spans").cast("long").alias("n_found"),
    )
