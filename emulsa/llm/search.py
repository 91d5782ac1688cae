"""Ranked lexical search: an index of posting blocks with maximum impacts, searched by Block-Max WAND.

The index is cut into shards of documents, each of bounded bytes of text. A shard has a row for each of its terms: the
postings in blocks of BLOCK documents, compressed to the bytes that a block's widest gap and count need, and a head for each
block: first and last document, highest impact, place, widths. Impacts are whole numbers and free of the term's weight,
which is known only when all shards have been counted.

A search brings to each shard the postings of the terms that any item has, and the items, in groups of bounded rows. For an
item, the ends of its terms' blocks cut the shard into stretches; one shallow move of all terms' pointers gives the sum of
the maxima of the blocks that meet a stretch. The pivot is the next stretch whose sum reaches the threshold (the K-th best
score so far): only its blocks are decompressed and scored, all others are skipped as they are. A few stretches with the
highest sums go first, since the sooner the threshold is high the more is skipped. For the same reason one shard in WAVE is
searched before all others, which begin with the threshold that it found.

Scores are whole numbers; a document with the threshold's very score is kept until all shards have met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, table, text_of, upto, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: By UTF-8 bytes: letters lowered, all else that is ASCII and no digit to a space. Bytes of other characters stay.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Best documents an item, postings a block, bytes of text a shard, terms of items that meet a shard in one group.
K, BLOCK, SHARD, GROUP = 10, 128, 16_000_000, 500_000
#: One shard in so many gives the others their first threshold.
WAVE = 16
#: Stretches tried first, and scored together at most.
FIRST, TOGETHER = 8, 64
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("top", "<i4"), ("at", "<i4"), ("count", "<i2"), ("gap_bytes", "u1"), ("tf_bytes", "u1")])
INDEX = "shard int, term string, df bigint, head binary, data binary"
SCORE, LENGTH_SHARE = 1_000_000_000, 75


def impact(tf, m):
    """The part of a score that is the document's: whole, for numbers and arrays."""
    return SCORE * tf // (1000 * tf + 8 * m)


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), NO_TERM), "")


def _bytes_for(most: np.ndarray, none: int) -> np.ndarray:
    """0 (all are none), 1, 2 or 4."""
    return np.select([most <= none, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4).astype(np.uint8)


def index_shard(shard: int, doc_ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int) -> pa.Table:
    """The rows of a shard. n_docs: documents with a term; n_terms: all their terms."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
    ids: dict[bytes, int] = {}
    docs, sizes, words = [], [], []
    for i in order:
        own = texts[i].translate(BYTES).split()
        if own:
            docs.append(doc_ids[i])
            sizes.append(len(own))
            words.append(np.array([ids.setdefault(w, len(ids)) for w in own], np.int64))
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in sizes], np.int64)
    keys, tf = np.unique(np.concatenate(words or [np.empty(0, np.int64)]) * len(docs) + np.repeat(np.arange(len(docs)), sizes), return_counts=True)
    term, doc = np.divmod(keys, max(1, len(docs)))
    df = np.bincount(term, minlength=len(ids))

    blocks = -(-df // BLOCK)
    first_posting, first_block = np.cumsum(df) - df, np.cumsum(blocks) - blocks
    start = np.repeat(first_posting, blocks) + (np.arange(blocks.sum()) - np.repeat(first_block, blocks)) * BLOCK
    count = np.diff(np.append(start, len(doc)))
    head = np.zeros(len(start), HEAD)
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    if len(start):
        head["first"], head["last"], head["count"] = doc[start], doc[start + count - 1], count
        head["top"] = np.maximum.reduceat(impact(tf, m[doc]), start)
        head["gap_bytes"], head["tf_bytes"] = _bytes_for(np.maximum.reduceat(gap, start), 0), _bytes_for(np.maximum.reduceat(tf, start), 1)
    size = count * (head["gap_bytes"].astype(np.int64) + head["tf_bytes"])
    at = np.cumsum(size) - size
    term_at = np.append(at, size.sum())[np.append(first_block, len(start))]
    head["at"] = at - np.repeat(term_at[:-1], blocks)
    data = np.zeros(int(size.sum()), np.uint8)
    block_of = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(doc)) - start[block_of]
    for values, width, base in ((gap, head["gap_bytes"], at), (tf, head["tf_bytes"], at + count * head["gap_bytes"])):
        for w in (1, 2, 4):
            some = np.flatnonzero(width[block_of] == w)
            to = base[block_of[some]] + place[some] * w
            for b in range(w):
                data[to + b] = values[some] >> 8 * b & 255

    nulls = np.array([d is None for d in docs], np.uint8)
    about = np.array([d or 0 for d in docs], "<i8").tobytes() + m.astype("<i8").tobytes() + nulls.tobytes()
    cut = lambda values, ends: pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(values.tobytes())])
    heads = pa.concat_arrays([cut(head.view(np.uint8), np.append(first_block, len(start)) * HEAD.itemsize).cast(pa.binary()), pa.array([None], pa.binary())])
    datas = pa.concat_arrays([cut(data, term_at).cast(pa.binary()), pa.array([about], pa.binary())])
    n = len(ids) + 1
    terms = pa.array([*[t.decode() for t in ids], None], pa.string())
    return pa.table([pa.array(np.full(n, shard), pa.int32()), terms, pa.array(np.append(df, len(docs)), pa.int64()), heads, datas], ["shard", "term", "df", "head", "data"])


class Postings:
    """A term in a shard; blocks are decompressed when first scored, and then kept."""

    def __init__(self, head: bytes, data: bytes):
        head = np.frombuffer(head, HEAD)
        self.first, self.last, self.top = head["first"].astype(np.int64), head["last"].astype(np.int64), head["top"].astype(np.int64)
        self.head, self.data, self.held = head.tolist(), data, {}

    def block(self, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts."""
        if k not in self.held:
            first, _, _, at, count, gap_bytes, tf_bytes = self.head[k]
            gaps = np.frombuffer(self.data, f"<u{gap_bytes}", count, at).cumsum(dtype=np.int64) if gap_bytes else 0
            docs = first + gaps if gap_bytes else np.full(count, first)
            tf = np.frombuffer(self.data, f"<u{tf_bytes}", count, at + count * gap_bytes).astype(np.int64) if tf_bytes else 1
            self.held[k] = docs, impact(tf, m[docs])
        return self.held[k]


def best_of_shard(lists: list[tuple[Postings, int]], m: np.ndarray, k: int, least: int, skipped: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents with a score of least or more (and above 0), equal ones by place.

    lists: the item's terms with their weights. skipped: gets the number of blocks that were not decompressed for this item.
    """
    ends = np.unique(np.concatenate([p.last for p, _ in lists]))
    begins = np.append(0, ends[:-1] + 1)
    bound, moved = np.zeros(len(ends), np.int64), []
    for p, weight in lists:  # shallow: heads only
        at = np.searchsorted(p.last, begins)
        meets = at < len(p.last)
        meets[meets] = p.first[at[meets]] <= ends[meets]
        bound[meets] += weight * p.top[at[meets]]
        moved.append(np.where(meets, at, -1))
    places, scores, least, used = np.empty(0, np.int64), np.empty(0, np.int64), max(1, least), set()

    def score(lo: int, hi: int) -> None:
        """Stretches lo to hi - 1."""
        nonlocal places, scores, least
        begin, end = int(begins[lo]), int(ends[hi - 1])
        total = np.zeros(end - begin + 1, np.int64)
        for i, ((p, weight), at) in enumerate(zip(lists, moved, strict=True)):
            own = at[lo:hi]
            own = own[own >= 0]
            if not len(own):
                continue
            for b in range(int(own[0]), int(own[-1]) + 1):
                docs, impacts = p.block(b, m)
                used.add((i, b))
                if docs[0] < begin or docs[-1] > end:
                    x, y = np.searchsorted(docs, [begin, end + 1])
                    docs, impacts = docs[x:y], impacts[x:y]
                total[docs - begin] += weight * impacts
        good = np.flatnonzero(total >= least)
        if len(good):
            places, scores = np.append(places, good + begin), np.append(scores, total[good])
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))

    done = np.zeros(len(ends), bool)
    if len(ends) > FIRST:
        for x in np.argpartition(-bound, FIRST)[:FIRST].tolist():
            if bound[x] >= least:
                score(x, x + 1)
                done[x] = True
    at = 0
    while at < len(ends):
        reaching = (bound[at:] >= least) & ~done[at:]
        pivot = int(reaching.argmax())
        if not reaching[pivot]:
            break
        more = reaching[pivot : pivot + TOGETHER]
        width = len(more) if more.all() else int((~more).argmax())
        score(at + pivot, at + pivot + width)
        at += pivot + width
    if skipped is not None:
        skipped.append(sum(len(p.last) for p, _ in lists) - len(used))
    return places, scores


def build_index(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index as a table in the shared folder: a row for each shard and term, and one without term for the shard's documents.

    Null texts and texts without a term are in no shard. Repeated rows, and rows without doc_id, are documents each.
    """
    docs = pinned(docs, {"doc_id": "bigint", "text": "string"})
    count = F.regexp_count(text_of(), F.lit(TERM)).cast("long")
    n_docs, n_terms, size = docs.agg(F.count(F.when(count > 0, 1)), F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.sum(F.octet_length(text_of()).cast("long")), F.lit(0))).first()
    # Repeated rows are told apart by the part of the input that they came in.
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(max(1, -(-size // shard)))).cast("int")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        texts = [x.as_py() for x in group.column("text").cast(pa.large_binary())]
        return index_shard(key[0].as_py(), group.column("doc_id").to_pylist(), texts, n_docs, n_terms)

    some = docs.filter(F.col("text").rlike(TERM)).withColumn("shard", dealt)
    return written(some.groupBy("shard").applyInArrow(run, INDEX), "index")


def search(index: DataFrame, items: DataFrame, k: int = K, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, equal scores by doc_id (nulls last).

    items: item_id, text. Rows with one item_id (or none: null is an item_id of its own) are one item with all their terms.
    An item without terms, or none that a document has, has no rows; a term that nearly all documents have may weigh 0.
    """
    spark = index.sparkSession
    items = pinned(items, {"item_id": "bigint", "text": "string"})
    asked = written(items.select("item_id", F.explode(terms_of(text_of())).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n")), "item-terms")
    lists = written(index.join(asked.select("term").distinct(), "term", "left_semi"), "item-postings")
    about = index.filter(F.col("term").isNull())
    n_docs = about.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighed = written(asked.join(df, "term").select("item_id", "term", (F.col("n") * weight).alias("weight")).filter("weight > 0"), "item-weights")
    groups = max(1, -(-weighed.count() // group))
    weighed = weighed.withColumn("group", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    shards = written(about.select("shard").distinct(), "shards")
    postings = lists.unionByName(about).withColumn("group", F.explode(upto(F.lit(groups))))

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        found, own, m, docs = [], {}, None, []
        for term, df, head, data in zip(*(postings.column(c).to_pylist() for c in ("term", "df", "head", "data")), strict=True):
            if term is None:
                docs, m, nulls = np.frombuffer(data, "<i8", df), np.frombuffer(data, "<i8", df, 8 * df), np.frombuffer(data, np.uint8, df, 16 * df)
            else:
                own[term] = Postings(head, data)
        by_item: dict[int | None, tuple[int, list]] = {}
        for item, term, weight, least in zip(*(asked.column(c).to_pylist() for c in ("item_id", "term", "weight", "least")), strict=True):
            if term in own:
                by_item.setdefault(item, (least, []))[1].append((own[term], weight))
        for item, (least, terms) in by_item.items():
            places, scores = best_of_shard(terms, m, k, least)
            found += [(item, None if nulls[p] else int(docs[p]), s) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    def wave(which: Column, least: DataFrame | None) -> DataFrame:
        some = weighed.withColumn("least", F.lit(0).cast("long")) if least is None else weighed.join(least, weighed["item_id"].eqNullSafe(least["item_id"]), "left").select(weighed["*"], F.coalesce("least", F.lit(0)).alias("least"))
        # Every item is for every shard: a stated set of queries.
        left, right = postings.filter(which), shards.filter(which).withColumn("group", F.explode(upto(F.lit(groups)))).join(some, "group")
        return left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    early = F.col("shard") % WAVE == 0
    first = written(top(wave(early, None)).drop("rank"), "first-wave")
    least = first.groupBy("item_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("least"))
    rest = written(wave(~early, least), "other-waves")
    return top(first.unionByName(rest)).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}') as w from documents),
     own as (select r, doc_id, w as words, len(w)::bigint as n from d where len(w) > 0),
     whole as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from own),
     tf as (select r, term, count(*)::bigint as tf from (select r, unnest(words) as term from own) group by r, term),
     df as (select term, count(*)::bigint as df from tf group by term),
     asked as (select item_id, term, count(*)::bigint as q
               from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')) as term from benchmark) group by item_id, term),
     weighed as (select item_id, term, q, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from asked join df using (term), whole),
     scored as (select item_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
                from weighed join tf using (term) join own using (r), whole group by item_id, r),
     ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored join own using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
