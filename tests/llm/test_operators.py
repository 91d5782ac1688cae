"""Each operator against a plain version of itself, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsa.llm import common, components, decontaminate, licenses, lines, mixing, pii, quality, simhash, tokens, toxicity, warc

from ..conftest import SF

SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, ties, repeats.
ODD = [
    (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "fr", None, 0), (3, " \n\t ", "xx", "a", 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "one two three four five six", "en", "b", 9),
    (5, "word " * 30_000, "en", "a", 150_000), (6, "x" * 50_000, "de", "c", 50_000), (7, "𝒳é " * 40 + "a b c d e f g", "es", "a", 1), (8, "a\n\nb\n" * 30, "en", "a", 1),
]


def words(t):
    return [w for w in SPACES.split(t or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use themselves."""
    d = spark.createDataFrame(ODD, DOCS)
    return d.withColumns({c: F.lit(1) for c in ("row", "key", "slot", "position", "words", "at", "w", "t", "language", "fp", "gone", "part", "seed", "item_id", "base", "start")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_mix(docs, rows):
    got = mixing.mix_sources(docs, block=4).orderBy("position").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and len({r.position for r in got}) == len(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert [r.block for r in own] == [k // 4 for k in range(len(own))] and all(r.release <= r.slot < r.deadline for r in own)


def test_mix_odd(odd, none):
    got = mixing.mix_sources(odd, {"a": 1, None: 1}, carry=["text"]).collect()
    assert len(got) == len(ODD) and len({r.position for r in got}) == len(ODD) and {r.source for r in got if r.slot is None} == {"b", "c"}
    assert mixing.mix_sources(none).collect() == []


@pytest.mark.parametrize(("weights", "blocks"), [({"a": 0.9999, "b": 0.0001}, {"a": 3000, "b": 2}), ({"a": 1 / 3} | {str(i): 2 / 3 / 200 for i in range(200)}, None), ({str(i): (1_000_000 if i == 0 else 100_000) ** 0.5 for i in range(50)}, None)])
def test_schedule_holds_the_given_weights(weights, blocks):
    blocks = blocks or dict.fromkeys(weights, 100)
    w = np.array([weights[s] for s in sorted(weights)]) / sum(weights.values())
    total, done, place = np.array([blocks[s] for s in sorted(weights)]), np.zeros(len(w)), {s: i for i, s in enumerate(sorted(weights))}
    slots = set()
    for s, k, release, deadline, slot in mixing.schedule(mixing.shares_of(weights), blocks):
        assert release <= slot < deadline and slot not in slots and k == done[place[s]]
        slots.add(slot)
        done[place[s]] += 1
        off = np.abs(done - w * (slot + 1))[done < total]  # while a source has blocks
        assert not len(off) or off.max() < 1 + 1e-9
    assert (done == total).all()


def test_every_source_is_scheduled_by_its_own_weight(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, F.col("id") % 1000).otherwise(1000).cast("string").alias("source"))
    got = mixing.mix_sources(d, block=2).collect()
    total = 1000 * 1 + 31
    assert len({r.position for r in got}) == 3000 and len({r.source for r in got if r.block == 0}) == 1001
    for r in got:
        w = (31 if r.source == "1000" else 1) / total
        assert abs(r.release - r.block / w) < 1.01 and abs(r.deadline - (r.block + 1) / w) < 1.01 and r.release <= r.slot < r.deadline


@pytest.mark.parametrize(("weights", "counts"), [({"a": 5, "b": 3, "c": 1, "d": 0.2}, {"a": 400, "b": 150, "c": 90, "d": 40}), ({"a": 10_000, "b": 1}, {"a": 900, "b": 5}), ({"a": 2, "b": 2}, {"a": 301, "b": 4})])
def test_periods_go_on_as_they_began(spark, weights, counts):
    """Rows are within a block of the given weights at every slot, over many periods."""
    d = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
    got, total = mixing.mix_sources(d, weights, block=2).collect(), sum(weights.values())
    assert len({r.position for r in got}) == sum(counts.values()) and len({r.slot for r in got}) == sum(-(-n // 2) for n in counts.values())
    for s, n in counts.items():
        own = {r.block: r for r in got if r.source == s}
        assert sorted(own) == list(range(-(-n // 2))) and all(r.release <= r.slot < r.deadline for r in own.values())
        assert all(r.release == int(r.block * total / weights[s] + 1e-9) and -1e-9 < r.deadline - (r.block + 1) * total / weights[s] < 1 for r in own.values())


def test_the_driver_works_out_a_period(spark, monkeypatch):
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    written, stored = [], mixing._stored
    monkeypatch.setattr(mixing, "_stored", lambda *a: written.append(stored(*a)) or written[-1])
    got = mixing.mix_sources(d, {"0": 0.5, "1": 0.3, "2": 0.2}, block=4)
    assert [n for _, n in written] == [10, 3] and got.select(F.countDistinct("position"), F.max("deadline")).first()[:] == (60_000, 25_000)


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages = pages.union(pages.filter("page_id < 9").select(F.col("page_id") + 10_000, "url", "html"))
    first = {}
    for r in pages.collect():
        first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    got = {r.page_id: r for r in warc.warc(pages).collect()}
    for r in pages.collect():
        x, data = got[r.page_id], r.html.encode()
        assert (x.payload_bytes, x.payload_digest) == (len(data), warc.digest_of(data))
        assert (x.record_type, x.refers_to) == (("response", None) if first[r.html] == r.page_id else ("revisit", first[r.html]))
        assert x.payload == (data if x.record_type == "response" else None)


def test_warc_odd(spark):
    d = spark.createDataFrame([(1, "http://a b\n", None), (2, None, ""), (2, None, ""), (None, "u", "xé"), (5, "v", "xé"), (5, "v", "xé")], "page_id long, url string, html string").withColumn("offset", F.lit(3))
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.warc(d).collect())
    assert got == Counter({(1, "response", None, 0): 1, (2, "revisit", 1, 0): 2, (None, "revisit", 5, 3): 1, (5, "response", None, 3): 2})
    assert warc.warc(d.limit(0)).collect() == []
    assert {r.record_type for r in warc.warc(d, least_bytes=10).collect()} == {"response"}
    assert [r.page_id for r in warc.warc(d, F.col("url") == "v").collect()] == [5, 5]


def test_reads_are_coalesced(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "REQUEST", 100)
    wanted = [("a", 0, 20), ("a", 20, 20), ("a", 50, 10), ("a", 71, 9), ("a", 80, 25), ("a", 105, 5), ("a", 110, 300), ("b", 0, 5), ("b", 4, 6)]
    assert list(warc.requests(wanted)) == [(0, 3, 0, 60), (3, 6, 71, 110), (6, 7, 110, 410), (7, 9, 0, 10)]
    assert list(warc.requests([])) == []


def test_a_page_that_half_the_crawl_has(spark):
    """Its pages are not dealt by digest: no task gets more than twice the median."""
    d = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 2 == 0, "gone").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("html")).repartition(8)
    index = warc.write_warc(d, common.fresh_dir(spark, "warc-test"))
    per_file = sorted(r["count"] for r in index.groupBy("file").count().collect())
    assert sum(per_file) == 4000 and per_file[-1] <= 2 * per_file[len(per_file) // 2]
    got = {r.page_id: (r.record_type, r.refers_to) for r in index.collect()}
    assert all(got[i] == (("response", None) if i in (0, *range(1, 500, 2)) else ("revisit", 0 if i % 2 == 0 else i % 500)) for i in range(4000))


def test_archives_name_what_is_revisited(spark, tmp_path):
    import gzip

    index = warc.write_warc(spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz")).decode()
    assert data.count("WARC-Type: warcinfo") == len(list(tmp_path.glob("*.warc.gz"))) and "WARC-Refers-To-Target-URI: http://a/\r\nWARC-Refers-To-Date: " in data and index.count() == 2


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 10_001, dtype=np.uint64).astype("<u4")
    assert (tokens.unpack(tokens.pack(x, bits), len(x), bits) == x).all()


def test_random_access(tmp_path):
    import pyarrow.fs as pafs

    rng, docs_ = np.random.default_rng(0), []
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "x.tok")) as out:
        w = tokens.Writer(out, 17, block=64)
        for k in range(300):
            docs_.append(rng.integers(0, 1 << 17, rng.integers(0, 200)).astype("<u4"))
            w.add(k if k % 7 else None, docs_[-1].tobytes())
        w.close()
    r = tokens.Reader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.tok")))
    for k in rng.permutation(300):
        assert (r.document(k) == docs_[k]).all() and r.docs[k] == (k if k % 7 else None)
    assert (r.ids(1000, 5000) == np.concatenate(docs_)[1000:5000]).all()


def _encoded(rows_):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for d, text in rows_:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tokens(docs, rows):
    got = tokens.token_output(docs, tokens.default_tokenizer()).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == _encoded(sorted((r[0], r[1]) for r in rows))


def test_a_batch_looks_up_only_its_own_pieces():
    """What is remembered may be far more than a batch has; long pieces are not kept."""

    class Older(dict):
        def __iter__(self):
            raise AssertionError("went through all that is older")

    e = tokens.Encoder(tokens.default_tokenizer())
    texts = ["some words here\nand there", "words " + "x" * 1_000 + " again", "a\0b c", " \n", ""]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, e.dtype).tobytes() for x in texts]
    assert e.encode(texts) == want
    e.older, e.known = Older(e.known), {}
    assert e.encode(texts) == want and max(map(len, e.known)) <= tokens.LONG


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    texts = ["", " a", "a ", "a  b", "a   b\n\nc", "x \n y", "\n\n", "don't  stop <|endoftext|> x<|endoftext|>y", "a <|endoftext|>", " a　 b\x1c c", "é\t\t x", "a\x85 b c", "1 2  3", "\na b", "a b\n", "a​ b\xa0"]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("ab1. \n\té　'"), 40)) for _ in range(300)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_what_an_encoder_remembers_is_bounded_in_bytes(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 20_000)
    t, e = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    rng = np.random.default_rng(1)
    for k in range(20):
        texts = ["".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 2000)), " ".join(f"w{k}x{i}" for i in range(40))]
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids
        assert all(len(x) <= tokens.LONG for x in e.known) and e.held < 40_000 and sum(map(len, e.known)) + sum(map(len, e.known.values())) <= e.held


def test_tokens_odd(odd, none):
    got = tokens.token_output(odd, tokens.default_tokenizer()).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert tokens.token_output(none, tokens.default_tokenizer()).collect() == []


# 4 ---------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    """Of (id, fingerprint) the smallest id reachable."""
    values = sorted(set(f for _, f in fps))
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    x = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= 4):
            a, b = root(v), root(values[i + 1 + j])
            up[max(a, b)] = min(a, b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in fps]


def test_simhash(docs, rows):
    got = simhash.simhash_components(docs).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]))


def test_simhash_odd(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components([(r[0], plain_fingerprint(r[1])) for r in ODD]))
    assert simhash.simhash_components(none).collect() == []


@pytest.mark.parametrize("c", [1, 2, 3])
def test_keys_of_links_stay_off_the_driver(spark, c):
    """A table of fingerprints small enough to be broadcast has up to 640 times its rows as keys."""
    fps = common.written(spark.range(2_000).selectExpr("xxhash64(id) as fp"), "few")
    plan = simhash.links(fps, c)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_keeps_keys_of_links_off_the_driver(spark, docs, monkeypatch):
    import corpus_pipeline as P

    real, plans = simhash.links, []

    def seen(fps, c):
        plans.append((found := real(fps, c))._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "links", seen)
    assert P.near_dedup(spark, docs, SF).count()
    assert len(plans) == 1 and "Broadcast" not in plans[0]


@pytest.mark.parametrize("c", [1, 2, 3])
def test_all_plans_find_all_links(spark, c):
    rng = np.random.default_rng(3)
    x = set()
    for centre in rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for k in range(7):
            x.add(centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    signed = [simhash._signed(v) for v in x]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), c).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 100)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in [*range(1, 41), 100, 101]}


def test_hot_keys_are_split(spark):
    """Half of all rows have one key: no task of the join gets more than twice the median."""
    left = common.written(spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("key"), "id").repartition(8), "left")
    right = spark.range(0, 20_000, 3).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice")).filter("key != 6").union(spark.createDataFrame([(7, 14)], "key long, twice long")).distinct()
    for how in ("inner", "left"):
        got = common.join_split(left, right, "key", how)
        assert Counter(map(tuple, got.select("key", "id", "twice").collect())) == Counter(map(tuple, left.join(right, "key", how).select("key", "id", "twice").collect()))
    hot = got.filter("key = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 4 and max(r["count"] for r in hot) <= 10_000 / len(hot) * 2


def test_copies_by_the_thousand(spark):
    d = [(i, "the same words in every copy of this text") for i in range(3000)] + [(5000 + i, f"own words {i} of number {i * 7} here") for i in range(200)] + [(None, "") for _ in range(500)]
    got = simhash.simhash_components(spark.createDataFrame(d, "doc_id long, text string").repartition(6)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components([(i, plain_fingerprint(t)) for i, t in d]))


# 5 ---------------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "", re.A) if _good(k, m[0])]


HARD = [
    "", "a@b.c@d.e", "a@b.c_d@e.f x", "éé 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 +1 (555) 123-4567", "+1 555", "0001.002.3.4 1.2.3.0256", "9" * 3000, "a" * 3000 + "@x.y", "1." * 500,
    "x@" + "y." * 2000 + "z", "+1" + "2 " * 200, "𝒳 me@x.org 𝒳𝒳 1.1.1.1", "a@b..c d@-.-", None,
]


def test_base_spans(spark, docs, rows, odd):
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    texts = {r[0]: r[1] for r in rows} | {10_000 + i: t for i, t in enumerate(HARD)}
    for r in pii.personal_data(d).collect():
        assert [tuple(x) for x in r.base] == plain_spans(texts[r.doc_id]), r.doc_id
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(odd.limit(0)).collect() == []


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows_ = [(i, f"some text here, call phone +1 (555) 010-{1000 + i} today or later") for i in range(12)]
    rows_ += [(100, "please call phone 1 (555) 010-9999 today"), (101, "the part 5550109999 was sent today"), (102, "you call phone +44 20 today")]
    rows_ += [(200 + i, f"write email user{i}@site.org now") for i in range(9)] + [(300, "write email user@site now"), (301, "write email user77%site.org now")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(plain_spans(t) == [tuple(x) for x in got[d].base] for d, t in rows_)
    assert not got[101].extra and not got[102].extra
    assert all(x in got[d].spans for d, _ in rows_ for x in got[d].base)


def test_unseen_identifiers_come_out_whole(spark):
    """Planted in a context that seeds have, but written in another way than any of them."""
    seeds = [(i, f"some text here, call phone +1 (555) 010-{1000 + i} today or later") for i in range(60)]
    seeds += [(100 + i, f"write email user{i}@site.org now") for i in range(60)] + [(200 + i, f"from host 10.20.30.{i} came nothing") for i in range(60)]
    planted = [("phone", "call phone", x, "today") for x in ("0555 123 4567", "555-010-9999", "1 (555) 010-9999", "(0555) 12 34 56")]
    planted += [("email", "write email", x, "now") for x in ("user77%site.org", "name [at] host", "name (at) host (dot) org", "some.name at host dot org")] + [("ip", "from host", x, "came") for x in ("10-20-30-40", "2001:db8::17")]
    d = seeds + [(300 + i, f"so {left} {x} {right} then") for i, (_, left, x, right) in enumerate(planted)]
    d += [(400, "the part 5550109999 was sent"), (401, "call phone yesterday2024 today"), (402, "call phone +44 20 today"), (403, "write email 12345678 now"), (404, "look at it now, and at home")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    texts = dict(d)
    for i, (kind, _, x, _) in enumerate(planted):
        assert [(e.kind, texts[300 + i][e.start : e.end]) for e in got[300 + i].extra] == [(kind, x)]
    assert not any(got[i].extra for i in range(400, 405)) and not any(got[i].extra for i, _ in seeds)


def plain_bootstrap(instances, rounds):
    """instances: text, left, right, k, could. Patterns that hold: (pattern, k): confidence."""
    edges, seed, could = defaultdict(set), {}, {}
    for text, left, right, k, c in instances:
        could[text] = c
        if k is not None:
            seed[text] = min(seed.get(text, k), k)
        if left and right:
            edges[f"b\0{left}\0{right}"].add(text)
        if left:
            edges[f"l\0{left}"].add(text)
        if right:
            edges[f"r\0{right}"].add(text)
    accepted, held = {}, {}
    for _ in range(rounds):
        held = {}
        for p, texts in edges.items():
            for k in range(len(pii.ALL_KINDS)):
                scores = [1.0 for t in texts if seed.get(t) == k] + [accepted[t][0] for t in texts if t in accepted and accepted[t][1] == k]
                if len(scores) >= pii.MIN_SEEDS and (c := sum(scores) / len(texts) * len(scores) / (len(scores) + 0.1)) >= pii.MIN_CONFIDENCE:
                    held[p, k] = c
        accepted = {}
        for (p, k), c in held.items():
            for t in edges[p]:
                if t not in seed and could[t][k]:
                    accepted[t] = max(accepted.get(t, (c, k)), (c, k))
    return held


def test_patterns_score_as_a_plain_graph(spark):
    rng = np.random.default_rng(8)
    texts = [(f"t{i}", int(rng.integers(0, 2)) if i < 60 else None, [bool(x) for x in rng.random(5) < 0.9]) for i in range(90)]
    rows_ = []
    for _ in range(900):
        t, k, c = texts[rng.integers(0, 90)]
        place = rng.integers(0, 6) + 10 * (k if k is not None else rng.integers(0, 2)) * (rng.random() < 0.97)
        rows_.append((t, f"l{place}", f"r{rng.integers(0, 5)}" if rng.random() < 0.8 else "", k, c))
    d = spark.createDataFrame(rows_, "text string, left string, right string, k int, could array<boolean>")
    for rounds in (1, 2, 4):
        want = plain_bootstrap(rows_, rounds)
        got = {(r.pattern, r.k): r.confidence for r in pii.bootstrap(d, rounds).collect()}
        assert want and got == pytest.approx(want)


def test_what_was_found_induces_patterns_that_find_more(spark):
    """No seed stands after "ring desk": only what was found beside "call phone" teaches that pattern."""
    d = [(i, f"please call phone +1 (555) 010-{1000 + i} today") for i in range(900)]
    d += [(1000 + i, f"please call phone 0555 123 {4000 + i} today") for i in range(30)] + [(2000 + i, f"then ring desk 0555 123 {4000 + i} soon") for i in range(30)]
    d += [(3000, "then ring desk 0777 321 9876 soon"), (3001, "then ring desk tomorrow2024 soon"), (3002, "the part 0777 321 9876 is here")]
    texts = dict(d)
    told = lambda rounds: {r.doc_id: [(x.kind, texts[r.doc_id][x.start : x.end]) for x in r.extra] for r in pii.personal_data(spark.createDataFrame(d, "doc_id long, text string"), rounds).collect() if r.extra}
    one, two = told(1), told(2)
    assert one == {1000 + i: [("phone", f"0555 123 {4000 + i}")] for i in range(30)}
    assert two == one | {2000 + i: [("phone", f"0555 123 {4000 + i}")] for i in range(30)} | {3000: [("phone", "0777 321 9876")]}


def test_secrets(spark):
    d = [(i, f'some token = "{zlib.crc32(str(i).encode()):08x}{i:08d}abcdef" here') for i in range(30)] + [(50 + i, f'use bearer {zlib.crc32(str(i).encode()):08x}{i:08d}abcdef now') for i in range(30)]
    d += [(100, "use bearer 0123456789abcdef99 now"), (101, "API_KEY: AAAABBBBCCCC1111DDDD"), (102, "token = shortone1"), (103, "password = allletterswithoutdigits")]
    texts = dict(d)
    got = {r.doc_id: [(x.kind, texts[r.doc_id][x.start : x.end]) for x in r.extra] for r in pii.personal_data(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert all(got[i] == [("secret", texts[i].split('"')[1])] for i in range(30)) and all(got[50 + i] == [("secret", texts[50 + i].split()[2])] for i in range(30))
    assert got[100] == [("secret", "0123456789abcdef99")] and got[101] == [("secret", "AAAABBBBCCCC1111DDDD")] and not got[102] and not got[103]


def test_long_texts_of_many_identifiers(spark):
    d = spark.createDataFrame([(1, "a1.2.3.4 mail me@x.org é " * 20_000)], "doc_id long, text string")
    r = pii.personal_data(d).first()
    assert len(r.base) == 40_000 and (r.base[-1].kind, r.base[-1].start) == ("ip", 19_999 * 25 + 1)


def test_numeric_tables(spark, monkeypatch):
    """What is kept of numbers between numbers does not grow with them; what stands at the ends of a line of them is found."""
    rng = np.random.default_rng(7)
    numbers = lambda n, gap: gap.join(str(x) for x in rng.integers(10**6, 10**7, n))
    kept = {}
    monkeypatch.setattr(pii, "written", lambda df, name: kept.setdefault(name, common.written(df, name)))
    d = [(i, numbers(20_000, gap)) for i, gap in enumerate((" ", "\t", "\n", "  "))] + [(9, "192.168.0.1 " + numbers(3_000, " ") + " +1 (555) 010-9999")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert [x.kind for x in got[9].base][0] == "ip" and all([tuple(x) for x in got[i].base] == plain_spans(t) for i, t in d)
    assert kept["pii"].agg(F.sum(F.size("instances"))).first()[0] < 100


def test_spans_hold_secrets_too(spark):
    r = [x for x in pii.op5_personal_data(spark, SF.replace("sf0.001", "sf0.01")).collect() if x.secrets]
    assert r and all(set(x.secrets.split(",")) <= set(x.spans.split(",")) and x.n_found == len(x.spans.split(",")) for x in r)


# 6 ---------------------------------------------------------------------------------------------------------------------


def plain_tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def plain_best(d, b, size=13):
    best, w = 0.0, min(size, len(b))
    for k in range(-len(b), len(d)):
        agree = [1 if 0 <= i + k < len(d) and d[i + k] == b[i] else 0 for i in range(len(b))]
        if sum(agree) >= 0.8 * w:
            best = max(best, *(sum(agree[i : i + w]) / w for i in range(len(b) - w + 1)))
    return best


def test_decontaminate(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, text(n)) for i, n in enumerate([9, 13, 20, 30, 40, 40])]
    rows_ = [(k, text(60)) for k in range(30)]
    for k, (_, b) in enumerate(items):  # whole, with every sixth token changed, a middle part
        rows_ += [(100 + k, text(20) + b + text(9)), (200 + k, text(20) + [x if i % 6 != 3 else "other" for i, x in enumerate(b)] + text(9)), (300 + k, text(5) + b[len(b) // 4 : -(len(b) // 4)] + text(5))]
    d = spark.createDataFrame([(k, " ".join(t).upper() + ".") for k, t in rows_], "doc_id long, text string")
    b = spark.createDataFrame([(k, ", ".join(t)) for k, t in items], "item_id long, text string")
    want = {(k, i): s for k, t in rows_ for i, bt in items if (s := plain_best([x.lower() for x in t], bt)) >= 0.8 - 1e-9}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    decontaminate.MAX_BROADCAST, kept = 10, decontaminate.MAX_BROADCAST
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == set(want)
    finally:
        decontaminate.MAX_BROADCAST = kept


def test_every_allowed_substitution_is_found(spark):
    """Items of 1 to 16 tokens, each with all placements of as many substitutions as 0.8 allows; one more is too many."""
    from itertools import combinations

    items, rows_, want = [], [], set()
    for n in [*range(1, 15), 16]:
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        size = min(n, 13)
        for more in (0, 1):
            for gone in combinations(range(size), size // 5 + more):
                if len(gone) == size or more and len(rows_) % 3:
                    continue
                text = ["a", "b", "c", *[x if k not in gone else f"o{k}" for k, x in enumerate(item[:size])], "d", "e"]
                rows_.append((len(rows_), " ".join(text)))
                if not more:
                    want.add((len(rows_) - 1, n))
    got = decontaminate.contaminated(spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_long_items(spark, monkeypatch):
    """Items of some thousand tokens: what a seed carries does not grow, and passages across segments are found."""
    rng = np.random.default_rng(6)
    items = [(k, [f"w{x}" for x in rng.integers(0, 4_000, 3_000 + k)]) for k in range(40)]
    kept = []
    monkeypatch.setattr(decontaminate, "written", lambda df, name: kept.append(common.written(df, name)) or kept[-1])
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string").repartition(4)
    places = [(3, 0), (5, 990), (7, 995), (9, 1_000), (11, 1_987), (39, 3_026)]
    rows_ = [(1_000 + n, ["x"] * 4 + [t if i != 4 else "y" for i, t in enumerate(items[k][1][at : at + 13])] + ["x"] * 4) for n, (k, at) in enumerate(places)] + [(2_000, [f"z{i}" for i in range(50)])]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in rows_], "doc_id long, text string")
    want = {(1_000 + n, k): 12 / 13 for n, (k, _) in enumerate(places)}
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    seeds = sum(len(t) for _, t in items) * 3
    assert 0.98 * seeds < kept[0].count() <= seeds and kept[0].agg(F.max(F.size("piece"))).first()[0] == 25
    monkeypatch.setattr(decontaminate, "SEGMENT", 7)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b.filter("item_id < 12")).collect()} == {x for x in want if x[1] < 12}


def test_decontaminate_odd(spark, odd, none):
    b = spark.createDataFrame([(None, None), (1, ""), (2, "word " * 20), (2, "word " * 20), (3, "short item"), (4, "ONE, two three")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, b).collect()} == {(5, 2), (None, 4)}
    assert decontaminate.contaminated(none, b).collect() == [] and decontaminate.contaminated(odd, b.limit(0)).collect() == []


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    m = toxicity.Model({"bad": 1, "good": 2}, rng)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    laid = toxicity.Laid(m, [["bad", "x", "good"] * 15, ["good", "y"]])
    index, ids = laid.index, laid.around(np.array([0, 5, 13, laid.at[1]]), np.array([0, 0, 0, 1]))
    y = np.array([1.0] * (len(ids) - 1) + [0.0])
    loss = lambda: -np.sum(y * np.log(p := m.forward(m.inputs(index), ids)) + (1 - y) * np.log(1 - p))
    kept = []
    x = m.inputs(index)
    p = m.forward(x, ids, kept)
    g = m.backward(x, ids, index, kept, p - y)
    for name in m.p:
        at = tuple(int(i) for i in np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        old, e = m.p[name][at], 1e-2
        m.p[name][at] = old + e
        up = loss()
        m.p[name][at] = old - e
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 0.05 * abs(g[name][at]) + 2e-3, name


def test_no_character_of_a_long_token_is_lost():
    for n in (1, 23, 24, 25, 26, 46, 47, 48, 49, 500):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.tokens_of(w)
        assert all(len(p) <= toxicity.MAX_CHARS for p in parts) and parts[0] + "".join(p[2:] for p in parts[1:]) == w
        assert {w[i : i + 3] for i in range(n - 2)} <= {p[i : i + 3] for p in parts for i in range(len(p) - 2)}
    model = toxicity.Model({}, np.random.default_rng(2))
    model.p["char"] *= 10
    plain, hidden = "x" * 60, "x" * 40 + "vile" + "x" * 16
    a, b = toxicity.Scorer(model).scores([plain, hidden])
    assert a != b


def plain_score(model, words):
    """Token by token, window by window; a state reads the segment that the token is in and the one before or after."""
    sigmoid, p, h, w = lambda x: 1 / (1 + np.exp(-x)), model.p, toxicity.HIDDEN, toxicity.WINDOW
    x = model.inputs(model.index(words))

    def state(way, places):
        s = np.zeros(h)
        for t in places:
            g, u = x[t] @ p[f"W{way}"] + p[f"B{way}"], p[f"U{way}"]
            zr = sigmoid(g[: 2 * h] + s @ u[:, : 2 * h])
            s = s + zr[:h] * (np.tanh(g[2 * h :] + (zr[h:] * s) @ u[:, 2 * h :]) - s)
        return s

    n, each = len(words), []
    for t in range(n):
        a = t // w * w
        each.append(np.concatenate([state("f", range(max(0, a - w), t + 1)), state("b", range(min(n, a + 2 * w) - 1, t - 1, -1))]))
    scores = []
    for a in range(max(1, n - w + 1)):
        part = np.array(each[a : a + w]).reshape(-1, 2 * h)
        weight = np.exp(part @ p["a"])
        scores.append(sigmoid((weight / max(weight.sum(), 1e-30)) @ part @ p["v"] + p["c"][0]))
    return max(scores)


def test_the_highest_of_all_windows_counts(monkeypatch):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(50)]
    model = toxicity.Model({w: i + 1 for i, w in enumerate(vocabulary)}, rng)
    model.p["word"] *= 20
    texts = [list(rng.choice(vocabulary, n)) for n in (0, 1, 5, 31, 32, 33, 40, 64, 100, 131)]
    want = [plain_score(model, t) for t in texts]
    for rows_ in (2, 4096):
        monkeypatch.setattr(toxicity, "ROWS", rows_)
        assert np.allclose(toxicity.Scorer(model).scores([" ".join(t) for t in texts]), want, atol=1e-5)


def test_toxicity_of_held_out_documents():
    import pandas as pd

    at = SF.replace("0.001", "0.1")
    d = pd.read_parquet(f"{at}/documents.parquet").merge(pd.read_parquet(f"{at}/labels.parquet"), on="doc_id").sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id])
    learn = pd.concat([d[~held & (d.toxic == k)][:1000] for k in (0, 1)])
    model = toxicity.train(list(learn.text), list(learn.toxic))
    test = d[held]
    s, y = np.concatenate([toxicity.Scorer(model).scores(list(test.text[a : a + 200])) for a in range(0, len(test), 200)]), test.toxic.to_numpy() == 1
    assert (s[y][:, None] > s[~y]).mean() >= 0.93 and (s[y] >= 0.5).mean() >= 0.85 and (s[~y] >= 0.5).mean() <= 0.04
    # Without what training adds to the words' odds: worse.
    plain = np.concatenate([toxicity.Scorer(toxicity.train(list(learn.text), list(learn.toxic), epochs=0)).scores(list(test.text[a : a + 200])) for a in range(0, len(test), 200)])
    assert (s[y][:, None] > s[~y]).mean() > (plain[y][:, None] > plain[~y]).mean() + 0.02


def test_sample_of_repeated_labels_and_texts(spark):
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:6]
    d = spark.createDataFrame([(ids[0], "b"), (ids[0], "a"), (ids[1], None), (ids[2], "c"), (ids[3], "x" * 400_000), (ids[4], "")], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 0), (ids[0], 1), (ids[1], 1), (ids[2], 0), (ids[2], 0), (ids[3], 1), (ids[4], 0), (None, 1), (ids[5], 1), (ids[2], 7)], "doc_id long, toxic int")
    assert sorted(zip(*toxicity.learning_sample(d, labels), strict=True)) == [("", 0), ("a", 1), ("c", 0)]


def test_toxicity_learns(spark, odd, none):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(60)]
    def make(i, bad):
        t = list(rng.choice(plain, rng.integers(20, 120)))
        for _ in range(3 * bad):
            t.insert(rng.integers(0, len(t)), str(rng.choice(["vile", "nasty", "rotten"])))
        return i, " ".join(t), int(bad)
    data = [make(i, i % 4 == 0) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, _ = toxicity.learning_sample(d, labels)
    held = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    assert set(texts) == {t for i, t, _ in data if i not in held}
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert {i for i, r in got.items() if r.held_out} == held and np.mean([got[i].predicted == y for i, _, y in data if i in held]) >= 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD) and toxicity.toxicity(none, labels.limit(0)).collect() == []


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs, rows, odd, none):
    grams = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    long = licenses.TEMPLATES["GPL-3.0"][1].split()
    more = [(10_000, " ".join(["lead"] * 33 + long + ["tail"] * 20)), (10_001, " ".join(["lead"] * 3 + long[:-4])), (10_002, " ".join(long[: len(long) // 2])), (10_003, "it was Released, under THE mit license (see there)")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = set()
    for k, t in [*((r[0], r[1]) for r in rows), *more]:
        own = grams(plain_tokens(t))
        want |= {(k, n) for n, ts in licenses.TEMPLATES.items() for x in ts if len(grams(plain_tokens(x)) & own) >= 0.8 * len(grams(plain_tokens(x)))}
    assert {(r.doc_id, r.license) for r in licenses.license_scan(d).collect()} == want
    assert licenses.license_scan(odd).collect() == [] and licenses.license_scan(none).collect() == [] and licenses.license_scan(odd, {}).collect() == [] and licenses.license_scan(odd, {"x": ["too short"]}).collect() == []


def test_many_long_templates(spark, monkeypatch):
    """200 templates of 2,000 tokens as a table: whole ones, ones with every 40th word changed, halves; joined rather than broadcast too."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"w{i}" for i in range(4000)])
    texts = {f"t{i}": list(rng.choice(vocabulary, 2000)) for i in range(200)}
    templates = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "license string, text string").repartition(4)
    pad = lambda n: list(rng.choice(vocabulary, n))
    d = [(i, pad(int(rng.integers(0, 900))) + texts[f"t{i}"] + pad(300), True) for i in range(8)]
    d += [(100 + i, pad(100) + [x if k % 40 else "other" for k, x in enumerate(texts[f"t{i}"])] + pad(50), True) for i in range(8)]
    d += [(200 + i, texts[f"t{i}"][:900], False) for i in range(8)]
    docs_ = spark.createDataFrame([(i, " ".join(t)) for i, t, _ in d], "doc_id long, text string").repartition(4)
    want = {(i, f"t{i % 100}") for i, _, whole in d if whole}
    assert {(r.doc_id, r.license) for r in licenses.license_scan(docs_, templates).collect()} == want
    monkeypatch.setattr(licenses, "MAX_BROADCAST", 10)
    assert {(r.doc_id, r.license) for r in licenses.license_scan(docs_.filter("doc_id < 102"), templates).collect()} == {x for x in want if x[0] < 102}
    monkeypatch.setattr(licenses, "MAX_SHINGLES", 100)
    with pytest.raises(ValueError):
        licenses.license_scan(docs_, templates)


# 9 ---------------------------------------------------------------------------------------------------------------------


def plain_lines(rows_, sites):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    seen = defaultdict(set)
    for _, t, s in rows_:
        for x in (t or "").split("\n"):
            seen[strip(x)].add(s)
    gone = {x for x, s in seen.items() if len(s) >= sites and len(words(x)) >= 3}
    out = []
    for d, t, _ in rows_:
        all_ = t.split("\n") if t is not None else []
        kept = [x for x in all_ if strip(x) not in gone]
        out.append((d, len(all_), len(all_) - len(kept), "\n".join(kept) if t is not None else None))
    return Counter(out)


@pytest.mark.parametrize("sites", [2, 5])
def test_lines(docs, rows, sites):
    assert Counter(map(tuple, lines.line_dedup(docs, sites).collect())) == plain_lines([(r[0], r[1], r[3]) for r in rows], sites)


def test_lines_near_the_limit_are_exact(spark):
    rows_ = [(n * 1000 + k, f"line number {n} here\nown text of {n} {k}", f"s{k}") for n in (38, 39, 40, 41, 60) for k in range(n)]
    got = lines.line_dedup(spark.createDataFrame(rows_, "doc_id long, text string, source string"), 40)
    assert Counter(map(tuple, got.collect())) == plain_lines(rows_, 40)


def test_lines_odd(odd, none):
    assert Counter(map(tuple, lines.line_dedup(odd, 2).collect())) == plain_lines([(r[0], r[1], r[3]) for r in ODD], 2)
    assert lines.line_dedup(none).collect() == []


# 10 --------------------------------------------------------------------------------------------------------------------


def plain_quality(t):
    w = words(t)
    where = defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    with_word = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(with_word) - len(set(with_word)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(docs, rows):
    got = quality.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *plain_quality(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    labels = {r.doc_id: r.quality for r in docs.sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.kept or r.base_failed for r in got if labels.get(r.doc_id) == 1)


def test_quality_odd(odd, none):
    got = quality.quality_rules(odd).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *plain_quality(r[1])) for r in ODD)
    assert quality.quality_rules(none).collect() == []


def test_short_junk_and_junk_of_any_language_is_judged(spark):
    rng = np.random.default_rng(3)
    listed = quality.COMMON_WORDS["en"]
    prose = lambda n: " ".join(str(rng.choice(listed)) if rng.random() < 0.4 else "".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)) + "."
    junk = lambda n: " ".join("".join(rng.choice(list("0123456789;:=+"), 6)) for _ in range(n))
    d = [(i, prose(200), ("en", "pl")[i % 2]) for i in range(40)] + [(100 + i, prose(60 + i), ("en", "pl")[i % 2]) for i in range(40)]
    d += [(200 + i, junk(n), lang) for i, (n, lang) in enumerate([(50, "en"), (100, "en"), (50, "pl"), (200, "PL")])]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(d, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values()) and {i for i, r in got.items() if not r.kept} == set(range(200, 204))
    assert got[1].word_distance is not None and got[1].char_distance is not None


def test_distances_are_those_of_plain_histograms(spark):
    """In a language with a list, one without, and none; a language of few documents has no reference."""
    import math
    import unicodedata

    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "i")] + ["The", "of", "and", "x1", "y-z", "$9"]
    make = lambda n: " ".join(rng.choice(vocabulary, n, p=(w := 1 / np.arange(2, len(vocabulary) + 2)) / w.sum()))
    d = [(i, make(int(rng.integers(30, 300))), (None, "en", "pl", "fi")[i % 4 if i < 160 else 3 if i == 160 else i % 3]) for i in range(0, 300) if i % 4 != 3 or i == 3 or i > 160]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(d, "doc_id long, text string, lang string")).collect()}
    lists = {"en": quality.COMMON_WORDS["en"]}
    for lang in ("", "pl", "fi"):
        have = Counter(w for _, t, g in d if (g or "") == lang for w in {w.lower() for w in words(t)} if w.isalpha())
        lists[lang] = sorted(have, key=lambda w: (-have[w], w))[: quality.N_LEARNED]

    def shares(t, lang):
        w, kind = words(t), lambda c: unicodedata.category(c)
        chars = [sum(kind(c) == "Lu" for c in t), *[sum(kind(c)[0] == k for c in t) for k in "NPS"]]
        both = [[x / sum(map(len, w)) for x in chars], [w.count(x) / len(w) for x in lists[lang]]]
        return [[*p, max(0.0, 1 - sum(p))] for p in both]

    told = {i: shares(t, g or "") for i, t, g in d}
    for lang in lists:
        own = [i for i, t, g in d if (g or "") == lang]
        good = [i for i in own if not got[i].base_failed and got[i].n_words >= 120]
        for i in own:
            for k, (distance, limit, noise) in enumerate([(got[i].char_distance, 0.28, 2.5), (got[i].word_distance, 0.25, 0.85)]):
                if len(good) < quality.MIN_DOCS:
                    assert distance is None
                    continue
                ref = np.mean([told[j][k] for j in good], axis=0)
                want = math.sqrt(max(0.0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(told[i][k], ref, strict=True)) / 2))
                assert abs(distance - want) < 1e-6
                assert got[i].base_failed or not got[i].kept or distance <= math.sqrt(limit**2 + noise * max(0, 1 / got[i].n_words - 1 / 120))


# The pipeline ----------------------------------------------------------------------------------------------------------


def test_stages_on_odd_rows(spark, none):
    """Nulls, repeats, missing columns, and columns named like what the stages make: values come out as they went in, decisions hold row by row."""
    import corpus_pipeline as P

    text = lambda k: " ".join(f"the w{k * 50 + i} of and x{k}y{i}" for i in range(12))
    rows_ = [(1, text(1), "en", "a"), (1, text(2), "en", "a"), (None, text(3), None, None), (None, text(4), "en", "b"), (5, text(1), "en", "b"), (6, None, "en", "a"), (7, "", "en", None), (8, text(8), "fr", "a"), (8, text(8), "fr", "a"), (9, "x " * 20_000, "en", "a")]
    clash = ("position", "slot", "block", "_key", "_key_", "__row__", "cell", "line", "whole", "n", "kept", "k0", "share", "carried", "draw")
    d = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"own {c}") for c in clash})
    want = {"quality rules": lambda r: r[1] and len(r[1]) > 1 and not r[1].startswith("x "), "near-dedup": None, "decontamination": lambda r: True, "mixing": lambda r: True}
    for name, stage in P.STAGES[:4]:
        got = stage(spark, d, SF)
        assert got.columns == d.columns
        out = got.collect()
        assert all(r[c] == f"own {c}" for r in out for c in clash)
        if name == "near-dedup":
            kept = Counter((r.doc_id, r.text) for r in out)
            assert kept == Counter({(1, text(1)): 1, (1, text(2)): 1, (None, text(3)): 1, (None, text(4)): 1, (6, None): 1, (8, text(8)): 1, (9, "x " * 20_000): 1})
        else:
            assert Counter(tuple(r)[:4] for r in out) == Counter(r for r in rows_ if want[name](r)), name
        assert stage(spark, d.limit(0), SF).collect() == [] and stage(spark, d.select("text"), SF).columns == ["text"]
    place = common.fresh_dir(spark, "odd")
    d.write.parquet(place)
    assert P.tokens(spark, spark.read.parquet(place), SF).count() == len(rows_)
    none.write.parquet(place + "-none")
    assert P.tokens(spark, spark.read.parquet(place + "-none"), SF).collect() == []


def test_stages_on_any_types(spark):
    """Maps beside, doc_ids that are text, rows that differ in other columns only."""
    import corpus_pipeline as P

    text = lambda k: " ".join(f"the w{k * 50 + i} of and x{k}y{i}" for i in range(12))
    rows_ = [(f"id-{k}", text(k), "en", f"s{k % 2}", {"k": k}, k) for k in range(6)] + [("id-0", text(0), "en", "s0", {"k": 7}, 7), ("id-0", text(0), "en", "s0", {"k": 8}, 8), ("17", text(17), "en", "s0", None, 9)]
    schema = "doc_id string, text string, lang string, source string, more map<string,int>, at int"
    kept = set()
    for order in (rows_, rows_[::-1]):
        d = spark.createDataFrame(order, schema).repartition(3)
        for name, stage in P.STAGES:
            place = common.fresh_dir(spark, "test")
            stage(spark, d, SF).write.parquet(place)
            was, d = d, spark.read.parquet(place)
            assert name == "token output" or d.schema == was.schema
            if name == "near-dedup":
                kept.add(tuple(sorted(r["at"] for r in d.collect())))
                assert sorted(r.doc_id for r in d.collect()) == ["17", *[f"id-{k}" for k in range(6)]]
        assert d.count() == 7 and {r.doc_id for r in d.collect()} == {17, None}
    assert len(kept) == 1


def test_part_files_beyond_five_digits_keep_their_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k, n in enumerate([99_998, 99_999, 100_000, 100_001]):
        pq.write_table(pa.table({"doc_id": [k], "text": [f"t{k}"]}), tmp_path / f"part-{n:05d}-x.parquet")
    got = tokens.token_output(spark.read.parquet(f"file://{tmp_path}"), tokens.default_tokenizer(), in_file_order=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3]


def test_pipeline(spark, rows):
    import corpus_pipeline as P

    d = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.quality_rules(d).filter("kept").collect()}
    assert len({r[0] for r in rows}) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for name, stage in P.STAGES:
        before = {r.doc_id for r in d.select("doc_id").collect()}
        place = common.fresh_dir(spark, "test")
        stage(spark, d, SF).write.parquet(place)
        was, d = d, spark.read.parquet(place)
        now = {r.doc_id for r in d.select("doc_id").collect()}
        if name == "quality rules":
            assert now == kept
        elif name == "near-dedup":
            groups = defaultdict(set)
            for i, _, c in plain_components([(i, plain_fingerprint(texts[i])) for i in sorted(before)]):
                groups[c].add(i)
            assert all(len(g & now) == 1 for g in groups.values()) and d.count() == len(groups)
        elif name == "decontamination":
            items = common.table(spark, SF, "benchmark")
            assert now == before - {r.doc_id for r in decontaminate.contaminated(was, items).collect()} and now < before
        elif name == "mixing":
            assert now == before
            order = [r.doc_id for r in mixing.mix_sources(was).orderBy("position").collect()]
        else:
            got = d.orderBy("start").collect()
            assert [tuple(r)[:4] for r in got] == _encoded([(i, texts[i]) for i in order])
