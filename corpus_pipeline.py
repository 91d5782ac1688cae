"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns that they were given, values untouched. Decisions are carried by a key of a row's
doc_id and 128 bits of hash of its doc_id, text, lang and source, so rows without doc_id, or with one that others have too,
are decided each by themselves. The key's column gets a name that docs does not have.

Of all stages: docs may lack any column (it counts as null) and have others, whatever their names and types. A doc_id that is
no whole number counts as null where numbers are asked for, and as itself in the key. Texts may be of any length. An empty
table gives an empty result. Repeated rows are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.llm.common import fresh_dir, hashable, row_key, table, written
from emulsa.llm.decontaminate import contaminated
from emulsa.llm.mixing import mix_sources
from emulsa.llm.quality import quality_rules
from emulsa.llm.simhash import simhash_components
from emulsa.llm.tokens import default_tokenizer, token_output

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
#: In place of doc_id, for the operators.
KEY = "struct<id:bigint,a:bigint,b:bigint>"


def _typed(docs: DataFrame, name: str) -> Column:
    given = {c.lower(): t for c, t in docs.dtypes}
    value = F.col(f"`{name}`") if name in given else F.lit(None)
    return (value.try_cast(COLUMNS[name]) if given.get(name) == "string" else value.cast(COLUMNS[name])).alias(name)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with the key; what the operators read, with the key as doc_id; the name of the key's column."""
    key, taken = "_key", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    # A doc_id that is text is in the hash as it is.
    said = F.col("`doc_id`").cast("string") if "doc_id" in taken else F.lit(None).cast("string")
    keyed = docs.withColumn(key, F.struct(*[_typed(docs, c) for c in COLUMNS], said.alias("said")))
    of = row_key(f"{key}.said", *[f"{key}.{c}" for c in COLUMNS if c != "doc_id"])
    told = keyed.select(F.struct(F.col(f"{key}.doc_id").alias("id"), of["a"].alias("a"), of["b"].alias("b")).alias("doc_id"), *[f"{key}.{c}" for c in COLUMNS if c != "doc_id"])
    return keyed.withColumn(key, F.struct(F.col(f"{key}.doc_id").alias("id"), of["a"].alias("a"), of["b"].alias("b"))), told, key


def _only(docs: DataFrame, key: str, keys: DataFrame, how: str, columns: list[str]) -> DataFrame:
    """docs with a key (or without, by how) that keys has in its column doc_id."""
    # Compared part by part: a null doc_id is one like any other.
    keys = keys.select(F.coalesce("doc_id.id", F.lit(-1)).alias("k0"), F.col("doc_id.a").alias("k1"), F.col("doc_id.b").alias("k2")).distinct()
    same = (F.coalesce(docs[key]["id"], F.lit(-1)) == keys["k0"]) & (docs[key]["a"] == keys["k1"]) & (docs[key]["b"] == keys["k2"])
    return docs.join(keys, same, how).select(*[f"`{c}`" for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words, so they go; ties in a limit stay."""
    keyed, told, key = _keyed(docs)
    # Written first: the optimizer would else spread the filter's long expression over the whole plan.
    rules = written(quality_rules(told, id_type=KEY).select("doc_id", "kept"), "quality-verdicts")
    return _only(keyed, key, rules.filter("kept"), "left_semi", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null before all), among equal ones the smallest hash.

    Of rows alike in doc_id, text, lang and source one stays: that whose other columns have the smallest hash. Texts without
    words are copies of one another.
    """
    keyed, told, key = _keyed(docs)
    groups = simhash_components(told, id_type=KEY)
    first = groups.filter("doc_id = component_id").select("doc_id")
    kept = _only(keyed, key, written(first, "first-of-groups"), "left_semi", keyed.columns)
    more = [c for c in docs.columns if c.lower() not in COLUMNS]
    order = F.xxhash64(*hashable(docs, more)) if more else F.lit(0)
    one = kept.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("one"))
    return one.select(*[F.col("one")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none, so they stay."""
    keyed, told, key = _keyed(docs)
    hit = contaminated(told, table(spark, sf_dir, "benchmark"), id_type=KEY).select("doc_id")
    return _only(keyed, key, hit, "left_anti", docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: part files follow one another, and rows within them. Null is a source like any other."""
    columns = docs.columns
    # The whole row travels as one column, so its names meet none of the operator's.
    mixed = mix_sources(docs.select(_typed(docs, "doc_id"), _typed(docs, "source"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")), carry=["whole"])
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*[F.col("whole")[c].alias(c) for c in columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture; for each document where its ids are. Null texts are empty: an end id alone."""
    return token_output(docs.withColumn("doc_id", _typed(docs, "doc_id")) if dict(docs.dtypes).get("doc_id") == "string" else docs, default_tokenizer(), in_file_order=True)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("token output", tokens)]

#: Tokenizing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
