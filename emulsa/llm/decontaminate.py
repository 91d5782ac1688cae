"""Benchmark decontamination by spaced seeds.

Each mask names the token positions that count and those that are ignored. The hashes of the counted tokens at every
position of a document are joined with those of the benchmark items; around each hit the two texts are laid side by side,
and a window of TOKENS tokens (the whole item if it is shorter) in which SIMILARITY of the tokens agree, at their places,
verifies it. A substituted token costs only the seeds that count it, so masks of different shapes bridge substitutions.

Every overlap of the asked similarity is retrieved: masks_for() tries all placements of the substitutions that it allows. For
windows in which the spaced masks would miss one (short items of some lengths), the mask is a run of as many tokens as must
agree side by side somewhere, the whole item where no substitution is allowed. Such masks are only made for lengths that
the benchmark has.

A seed of the benchmark carries the tokens that a window over it can reach (25 at most), never its item. The benchmark's side
is broadcast only up to MAX_BROADCAST bytes, which are counted; then nothing is shuffled but the different surroundings of
hits. Beyond that the seeds are joined without the texts, and Spark splits seeds that many rows have.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pinned, row_key, table, text_of, upto, written

#: Five tokens count in each; the residues of their places differ, so that regular substitutions miss one of them.
MASKS = ("1101101", "11001011", "110100101")
TOKENS, SIMILARITY = 13, 0.8
#: Bytes of the benchmark's seeds, as rows in memory, that are broadcast; tokens of an item that are seeded together.
MAX_BROADCAST, SEGMENT = 64_000_000, 1_000


def tokens_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def masks_for(window: int, similarity: float, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks of which one lies on agreeing tokens only, wherever a window of so many tokens differs in as many as the similarity allows."""
    differ = window - math.ceil(similarity * window - 1e-9)
    placed = [{i + j for j, x in enumerate(m) if x == "1"} for m in masks for i in range(window - len(m) + 1)]
    if all(any(not set(gone) & p for p in placed) for gone in combinations(range(window), differ)):
        return masks
    return ("1" * (window // (differ + 1)),)


def _seeds(tokens: Column, masks: tuple[str, ...]) -> Column:
    """A hash for each mask at position 0, then at position 1, and so on; null where the mask runs over the end."""
    span = min(map(len, masks))

    def at(i: Column) -> Column:
        # The last counted token is missing beyond the end.
        return F.array(*[F.when(F.get(tokens, i + (len(m) - 1)).isNotNull(), F.xxhash64(F.lit(k), *[F.get(tokens, i + j) for j, x in enumerate(m) if x == "1"])) for k, m in enumerate(masks)])

    return F.flatten(F.transform(upto(F.size(tokens) - (span - 1)), at))


def _spread(df: DataFrame, tokens: str, masks: tuple[str, ...]) -> DataFrame:
    """df, at, k (place of the mask), seed. (The outer form of explode: for the other the optimizer adds a filter that works out the seeds twice.)"""
    hashed = df.select("*", _seeds(F.col(tokens), masks).alias("seeds"))
    return hashed.select(*df.columns, F.posexplode_outer("seeds").alias("at", "seed")).filter(F.col("seed").isNotNull()).withColumn("k", F.col("at") % len(masks)).withColumn("at", F.floor(F.col("at") / len(masks)).cast("int"))


def _pieces(items: DataFrame, own: Column, masks: tuple[str, ...], tokens: int) -> DataFrame:
    """item_id, seed, piece (the tokens that windows over the seed's first one reach), piece_at (that token's place in it), window.

    Items are cut into segments first, so that what a row holds does not grow with the item.
    """
    window = F.least(F.lit(tokens), F.size("item"))
    margin = max(tokens, *map(len, masks))
    cut = items.select("item_id", "item", window.alias("window"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.size("item") - 1, F.lit(SEGMENT))).alias("from")).filter(F.size("item") > 0)
    # Tokens of a segment, and so many before and after it; left is how many there are before.
    left = F.least(F.col("from"), F.lit(margin))
    cut = cut.select("item_id", "window", "own", left.alias("left"), F.slice("item", F.col("from") - left + 1, left + (SEGMENT + margin)).alias("part"), F.least(F.lit(SEGMENT), F.size("item") - F.col("from")).alias("n"))
    hashed = cut.select("*", _seeds(F.col("part"), masks).alias("seeds"))

    def told(i: Column) -> Column:
        at = F.floor(i / len(masks)).cast("int")
        lo = F.greatest(F.lit(0), at - F.col("window") + 1)
        return F.struct(F.get("seeds", i).alias("seed"), F.slice("part", lo + 1, at - lo + F.col("window")).alias("piece"), (at - lo).alias("piece_at"))

    first, last = F.col("left") * len(masks), F.least(F.size("seeds"), (F.col("left") + F.col("n")) * len(masks))
    held = F.filter(F.transform(upto(last - first), lambda i: i + first), lambda i: F.get("seeds", i).isNotNull() & F.array_contains("own", i % len(masks)))
    return hashed.select("item_id", "window", F.explode(F.transform(held, told)).alias("s")).select("item_id", "window", "s.*")


def _best(doc: Column, piece: Column, shift: Column, window: Column) -> Column:
    """The largest share of agreeing tokens in a window of the piece; the document's token is shift further on."""
    agree = F.transform(piece, lambda x, i: F.when((i + shift >= 0) & F.get(doc, i + shift).eqNullSafe(x), 1).otherwise(0))

    def windows(x: Column) -> Column:
        counts = F.transform(upto(F.size(x) - window + 1), lambda i: F.aggregate(F.slice(x, i + 1, window), F.lit(0), lambda a, y: a + y))
        return F.array_max(counts) / window

    return let(agree, windows)


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, tokens: int = TOKENS, similarity: float = SIMILARITY, id_type: str = "bigint") -> DataFrame:
    """doc_id, item_id, similarity of each document and benchmark item that share a passage; each pair once.

    Null texts are empty, and an item without tokens is found nowhere. Empty tables give an empty result.
    Texts and items may be of any length: a document's tokens are one row's, an item is seeded in segments.
    Rows with the same doc_id (or none: null is a doc_id of its own) are reported together, as are items with the same
    item_id. Other columns are ignored. id_type: the type of doc_id.
    """
    docs, benchmark = pinned(docs, {"doc_id": id_type, "text": "string"}), pinned(benchmark, {"item_id": "bigint", "text": "string"})
    items = benchmark.select("item_id", tokens_of(text_of()).alias("item"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item"), F.lit(tokens)).alias("n")).distinct().collect() if r[0])  # tokens of them at most
    by_length = {n: masks_for(n, similarity, masks) for n in lengths}
    masks = tuple(dict.fromkeys(m for n in lengths for m in by_length[n])) or masks
    own = F.coalesce(*[F.when(F.least(F.size("item"), F.lit(tokens)) == n, F.array(*[F.lit(masks.index(m)) for m in by_length[n]])) for n in lengths], F.array().cast("array<int>"))
    known = written(_pieces(items, own, masks, tokens), "benchmark-seeds")
    size = known.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "piece")) + 16 * F.size("piece") + 64), F.lit(0))).first()[0]
    few = size <= MAX_BROADCAST
    bound = F.broadcast if few else (lambda df: df)
    wanted = known.select("seed").distinct()
    rows = docs.select("doc_id", tokens_of(text_of()).alias("doc"))
    if few:  # in one stage with the seeds, so that only positions with a hit are copied, with the tokens around them
        hits = _spread(rows, "doc", masks).join(bound(wanted), "seed")
    else:  # the seeds travel without the tokens, which rows with a hit get back, once a row
        rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), tokens_of(text_of()).alias("doc"))
        seeded = _spread(rows, "doc", masks).select("row", "at", "seed").join(wanted, "seed").groupBy("row").agg(F.collect_set(F.struct("at", "seed")).alias("hits"))
        hits = seeded.join(rows.dropDuplicates(["row"]), "row").select("doc_id", "doc", F.explode("hits").alias("h")).select("doc_id", "doc", "h.at", "h.seed")
    before = F.least(F.col("at"), F.lit(tokens - 1))
    around = hits.select("doc_id", "seed", before.alias("before"), F.slice("doc", F.col("at") - before + 1, F.lit(2 * tokens - 1)).alias("around"))
    # A text that repeats itself has few different surroundings, however many places.
    found = around.distinct().join(bound(known), "seed")
    scored = found.select("doc_id", "item_id", _best(F.col("around"), F.col("piece"), F.col("before") - F.col("piece_at"), F.col("window")).alias("similarity"))
    # The limit comes after the aggregate: before it, it would become part of the join and take it out of the stage's code.
    return scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= similarity)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every agreement of a document's token with an item's counts for its diagonal; windows of it are judged by how many agree.
OP6_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, row_number() over () as r from documents),
     b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, row_number() over () as r from benchmark),
     dt as (select r, unnest(w) as t, unnest(range(len(w))) as p from d),
     bt as (select r, unnest(w) as t, unnest(range(len(w))) as p, least(13, len(w)) as size, len(w) as n from b),
     agree as (select dt.r as dr, bt.r as br, dt.p - bt.p as diagonal, bt.p as p, size, n from dt join bt using (t)),
     enough as (select dr, br, diagonal from agree group by all having count(*) >= 0.8 * any_value(size)),
     windows as (select *, count(*) over (partition by dr, br, diagonal order by p range between current row and 12 following) as n_agree from agree semi join enough using (dr, br, diagonal)),
     -- A window begins with a token that agrees, or is the last one of the item and holds what agrees in it.
     fitting as (select dr, br, size, n_agree from windows
                 union all
                 select dr, br, any_value(size), count(*) from windows where p >= n - size group by dr, br, diagonal)
select doc_id, item_id, max(n_agree / size) as similarity
from fitting join d on d.r = dr join b on b.r = br where n_agree >= 0.8 * size group by doc_id, item_id
"""
