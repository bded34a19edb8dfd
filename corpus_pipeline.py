"""Raw documents to a sharded training mixture: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. ``run`` applies them to the table documents and returns the last one's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dustledger.llm import decontaminate, language, mixing, ngram_join, sharding
from dustledger.session import durable, work_folder

#: Documents below this language score are rejected: two coin tosses, one per level, score 0.25.
LEAST_SCORE = 0.3
#: The most times that a small source is read.
REPETITION = 2.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts, letterless texts and scores under LEAST_SCORE go.

    The model learns from all rows whose id may teach (see ``language.remainder``); rows without id are judged but teach nothing.
    Repeated rows are judged alike. An empty table stays empty; further columns are kept.
    """
    learn = docs.filter(language.remainder(F.col("doc_id"), 3) != 1).select("text", "lang")
    model = language.fit_language_model(learn)
    told = language.predicted_language(F.col("text"), model, spark)
    return docs.filter((told["lang"] != "und") & (told["score"] >= LEAST_SCORE))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id that stands for one text only.

    Rows without id take part, and so do the texts of an id that stands for several; they are told apart by their text and
    kept if their group has no other row. Null texts are no duplicates: one row per id stays, and each without id. Of rows equal in
    id and text one stays. Empty and wordless texts are near duplicates of equal texts only. An empty table stays empty; further
    columns of any name are kept as they are.
    """
    # what decides is ids and digests; inside, columns have their own names, so those of docs cannot clash
    ids = durable(docs.filter("text is not null").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest")).distinct())
    several = ids.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("s"))
    named = F.col("id").isNotNull() & F.col("s").isNull()
    told = durable(ids.join(several, F.col("id") == F.col("s"), "left").select("id", "digest", named.alias("named")))
    # rows without id, and those of an id with several texts, are fed without id: their texts are told apart by a stand-in id
    fed = docs.filter("text is not null").select("doc_id", "text")
    if not told.filter("not named").isEmpty():
        loose = told.filter("named").select(F.col("id").alias("i"))
        keyed = fed.join(loose, F.col("doc_id") == F.col("i"), "left")
        apart = keyed.filter("i is null").select(F.lit(None).cast("long").alias("doc_id"), "text", F.md5("text").alias("digest")).dropDuplicates(["digest"])
        fed = keyed.filter("i is not null").select("doc_id", "text").unionByName(apart.select("doc_id", "text"))
    kept = ngram_join.near_duplicates(fed).groupBy("component_id").agg(F.min("doc_id").alias("id"), F.min("class_id").alias("class"))
    # the stand-in id of near_duplicates for texts without id
    stand_in = -F.pmod(F.xxhash64("digest"), F.lit(1 << 62)) - 1
    kept = kept.select(F.col("id").isNotNull().alias("own"), F.coalesce("id", "class").alias("k"))
    chosen = told.withColumn("key", F.when(F.col("named"), F.col("id")).otherwise(stand_in)).join(
        kept, (F.col("key") == F.col("k")) & (F.col("named") == F.col("own")), "left_semi")
    # one id for a text without an id of its own; then the texts are read by a join on (id, digest), and of rows equal in both the first stays
    chosen = durable(chosen.groupBy("key", "named", "digest").agg(F.min("id").alias("id")).select(F.struct("id", "digest").alias("_chosen")))
    marked = docs.filter("text is not null").select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").alias("id"), F.md5("text").alias("digest")).alias("at"))
    met = marked.join(chosen, marked["at"] == chosen["_chosen"], "left_semi")
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("row")))).filter("place = 1").select("row.*")
    silent = docs.filter("text is null")
    return first.unionByName(silent.filter("doc_id is not null").dropDuplicates(["doc_id"])).unionByName(silent.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with fewer than a twentieth of their words inside benchmark windows.

    Null and wordless texts stay. Repeated rows are judged alike. An empty table stays empty; further columns are kept.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.benchmark_hits(F.col("text"), benchmark)
    return docs.filter(~decontaminate.contaminated(hit))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to REPETITION times.

    A missing source is a source of its own. Null and wordless texts count no tokens and stay. Repeated rows are read as often
    as they stand there. An empty table stays empty; further columns are kept.
    """
    return mixing.mixed_documents(docs, repetition=REPETITION)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of the mixture.

    Nulls, repeated rows and empty tables are treated as in ``sharding.document_shards``; further columns are dropped here.
    """
    return sharding.document_shards(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", deal_shards),
]

#: A trained classifier, a MinHash forest and a heap are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
