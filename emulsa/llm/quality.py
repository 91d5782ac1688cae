"""Quality rules: plain counts, and the divergence of character and word histograms from language references.

Every document gets a histogram of its characters over a few classes and one of the most frequent function words of
its language. The references are the mean histograms of all documents of the language that pass the plain rules and
are long enough (each document counts the same). A document is rejected if a Jensen-Shannon distance (base 2, square root of the divergence) to its
reference is over the limit. Histograms of short documents are noisy: the expected divergence by chance alone grows with one
over the number of words, so under MIN_JUDGED_WORDS words the squared limits widen by a noise over that number. Function
words are those of COMMON_WORDS; of every other language they are learned: the N_LEARNED words that stand in most of its
documents. Character classes need no list. A language has a reference from MIN_DOCS such documents on.

Plan: one pass over the texts writes a narrow table of counts; references are an aggregate of a row for each language,
broadcast up to MAX_BROADCAST of them. Only documents of languages without a list are read a second time, to count their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, pinned, table, text_of, upto, words_of, written

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los"],
}
#: Words that are learned for any other language; so many documents make a reference.
N_LEARNED, MIN_DOCS = 8, 20

WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: From so many words on histograms make references and the limits are the plain ones; below, squared limits widen by noise * (1 / words - 1 / MIN_JUDGED_WORDS).
MIN_JUDGED_WORDS = 120
CHAR_NOISE, WORD_NOISE = 2.5, 0.85
MAX_BROADCAST = 100_000
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.25


def _language() -> Column:
    """In lower case; null is a language of its own."""
    return F.lower(F.coalesce("lang", F.lit("")))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 5-word window that the text has at least twice. Windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        def by_hash(s: Column) -> Column:
            """Positions of windows whose hash a neighbour in hash order has too, each adding the words after the last one."""
            twice = F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])).alias("twice")))
            at = F.sort_array(F.transform(F.filter(twice, lambda x: x["twice"]), lambda x: x["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, by_hash))

    return let(words, lambda w: let(F.transform(upto(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])), covered))


def learned_words(docs: DataFrame, n: int = N_LEARNED) -> DataFrame:
    """language, learned: of each language without a list the n words (lower case, letters only) that most of its documents have, ties by alphabet."""
    each = docs.filter(~_language().isin(*COMMON_WORDS)).select(_language().alias("language"), F.explode(F.array_distinct(F.filter(words_of(F.lower(text_of())), lambda w: w.rlike(r"^\p{L}+$")))).alias("word"))
    counts = each.groupBy("language", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= n)
    return ranked.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("ranked")).select("language", F.transform("ranked", lambda x: x["word"]).alias("learned"))


def features(docs: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Counts of every document: doc_id, language, words, chars (by class), commons (by word of the language's list), and the plain counts."""
    docs = pinned(docs, {"doc_id": id_type, "text": "string", "lang": "string"})
    learned = written(learned_words(docs), "learned-words")
    docs = docs.withColumn("language", _language()).join(F.broadcast(learned) if learned.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else learned, "language", "left")
    base = docs.select("doc_id", "language", "learned", text_of().alias("t"), words_of(text_of()).alias("w"))
    without = lambda col, pattern: F.regexp_replace(col, pattern, "")
    base = base.select(
        "doc_id", "language", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), repeated_words(F.col("w")).alias("n_repeat_words"),
        # Counted as they are written, in lower case; what neither letter nor space is, is short, and so is what the other classes are taken from.
        F.coalesce(*[F.when(F.col("language") == lang, F.array(*[F.size("w") - F.size(F.array_remove("w", x)) for x in listed])) for lang, listed in COMMON_WORDS.items()], F.transform("learned", lambda x: F.size("w") - F.size(F.array_remove("w", x)))).alias("commons"),
        without("t", r"[\p{L}\s]+").alias("rest"), F.length(without("t", r"[^\p{Lu}]+")).alias("upper"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return base.select(
        "doc_id", "language", F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.length(without("rest", "[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.array("upper", *[F.length(without("rest", pattern)) for pattern in (r"[^\p{N}]+", r"[^\p{P}]+", r"[^\p{S}]+")]).alias("classes"),
        "commons", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """Shares of each count in total, then that of all others."""
    part = F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))
    return let(part, lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x)))))


def _distance(p: Column, q: Column) -> Column:
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.when(each.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x))))


def quality_rules(docs: DataFrame, min_judged_words: int = MIN_JUDGED_WORDS, max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_docs: int = MIN_DOCS, id_type: str = "bigint") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Null texts are empty: no words, base_failed. Distances are null for documents without words and where the language
    has no reference (too few documents of min_judged_words words that pass the plain rules), where a document stands or
    falls by the other rules. Null is a language like any other. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are ignored.
    id_type: the type of doc_id, which is only passed on.
    """
    counts = written(features(docs, id_type), "quality")
    shares = counts.select(
        "*", _shares(F.col("classes"), F.col("word_chars")).alias("p_char"), _shares(F.col("commons"), F.col("n_words")).alias("p_word"),
    )
    n_char, n_word = 5, max(N_LEARNED, *map(len, COMMON_WORDS.values())) + 1
    judged = shares.filter(~F.col("base_failed") & (F.col("n_words") >= min_judged_words))
    mean = lambda col, n: F.filter(F.array(*[F.avg(F.get(col, F.lit(k))) for k in range(n)]), lambda x: x.isNotNull())
    refs = judged.groupBy("language").agg(F.count("*").alias("n"), mean("p_char", n_char).alias("r_char"), mean("p_word", n_word).alias("r_word")).filter(F.col("n") >= min_docs).drop("n")
    refs = written(refs, "quality-references")
    out = shares.join(F.broadcast(refs) if refs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else refs, "language", "left")
    some = F.col("n_words") > 0
    out = out.withColumn("char_distance", F.when(some, _distance(F.col("p_char"), F.col("r_char")))).withColumn("word_distance", F.when(some, _distance(F.col("p_word"), F.col("r_word"))))
    short = F.greatest(F.lit(0.0), 1 / F.greatest(F.col("n_words"), F.lit(1)) - 1 / F.lit(max(1, min_judged_words)))
    max_char, max_word = [F.sqrt(F.lit(limit**2) + noise * short) for limit, noise in ((max_char_distance, CHAR_NOISE), (max_word_distance, WORD_NOISE))]
    odd = (F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~(F.col("base_failed") | odd)).alias("kept"), "char_distance", "word_distance")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_W = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP10_SQL = r"""
with listed(language, listed) as (values {listed}),
     d as (select row_number() over () as r, doc_id, lower(coalesce(lang, '')) as language, coalesce(text, '') as t, {words} as w from documents),
     learned as (select language, list(word order by rank) as listed
                 from (select language, word, row_number() over (partition by language order by count(*) desc, word) as rank
                       from (select distinct r, language, unnest({lower}) as word from d where language not in (select language from listed))
                       where regexp_full_match(word, '\p{{L}}+') group by language, word)
                 where rank <= {n_learned} group by language),
     lists as (from listed union all from learned),
     windows as (select r, i, array_to_string(w[i:i + 4], ' ') as five from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
     twice as (select r, i from (select r, i, count(*) over (partition by r, five) as n from windows) where n > 1),
     repeated as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from twice) group by r),
     counts as (
         select d.r, doc_id, d.language, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(x.n, 0) as n_repeat_words,
                [length(regexp_replace(t, '[^' || c || ']', '', 'g')) for c in ['\p{{Lu}}', '\p{{N}}', '\p{{P}}', '\p{{S}}']] as classes, [len(list_filter(w, lambda y: y = x)) for x in l.listed] as commons
         from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d) d left join repeated x on x.r = d.r left join lists l on l.language = d.language),
     base as (select *, n_words < {min_words} or 100 * n_repeat_words > {max_repeated} * n_words as base_failed, [x / greatest(word_chars, 1) for x in classes] as pc, [x / greatest(n_words, 1) for x in commons] as pw from counts),
     shares as (select *, list_append(pc, greatest(0, 1 - list_sum(pc))) as p_char, list_append(pw, greatest(0, 1 - list_sum(pw))) as p_word from base),
     judged as (select * from shares where not base_failed and n_words >= {min_judged}),
     mean_of as (select language, kind, i, sum(p) / any_value(n) as m
                 from (select *, count(*) over (partition by language, kind, i) as n
                       from (select language, 'c' as kind, unnest(p_char) as p, unnest(range(len(p_char))) as i from judged
                             union all select language, 'w', unnest(p_word), unnest(range(len(p_word))) from judged)) where n >= {min_docs} group by language, kind, i),
     refs as (select language, list(m order by i) filter (where kind = 'c') as r_char, list(m order by i) filter (where kind = 'w') as r_word from mean_of group by language),
     told as (
         select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                case when n_words > 0 and r_char is not null then sqrt(greatest(0, {js_char})) end as char_distance, case when n_words > 0 and r_word is not null then sqrt(greatest(0, {js_word})) end as word_distance
         from shares s left join refs f on f.language = s.language)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or coalesce(char_distance, 0) > sqrt({c2} + {c_noise} * short) or coalesce(word_distance, 0) > sqrt({w2} + {w_noise} * short)) as kept, char_distance, word_distance
from (select *, greatest(0, 1 / greatest(n_words, 1) - 1 / {min_judged}) as short from told)
""".format(
    listed=", ".join("('{}', [{}])".format(lang, ", ".join(f"'{w}'" for w in ws)) for lang, ws in COMMON_WORDS.items()), words=_W.format("coalesce(text, '')"), lower=_W.format("lower(t)"), n_learned=N_LEARNED,
    min_words=MIN_WORDS, max_repeated=MAX_REPEATED_PERCENT, min_judged=f"{MIN_JUDGED_WORDS}.0", min_docs=MIN_DOCS, c2=MAX_CHAR_DISTANCE**2, c_noise=CHAR_NOISE, w2=MAX_WORD_DISTANCE**2, w_noise=WORD_NOISE,
    **{f"js_{k}": f"list_sum(list_transform(list_zip(p_{k}, r_{k}), lambda x: (case when x[1] > 0 then x[1] * log2(2 * x[1] / (x[1] + x[2])) else 0 end + case when x[2] > 0 then x[2] * log2(2 * x[2] / (x[1] + x[2])) else 0 end) / 2))" for k in ("char", "word")},
)
