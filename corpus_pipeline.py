"""A corpus pipeline of five stages: each takes what its predecessor kept, as documents reread from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import language, mixing, ngram_join, packing, toxicity
from lacuna.llm.common import shared_dir, ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in a language: those with letters whose cosine with a learned language isn't too low for their length.

    Null and empty texts and texts without letters go; nulls in other columns don't matter (a null lang teaches nothing); very long texts are read whole; equal texts
    fare alike, repeated rows too; an empty table, or one without any lang, keeps nothing; extra columns are dropped."""
    ship(spark)
    rows = language.predicted(docs, language.learned(docs), keep=COLUMNS[1:])
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= language.least_cosine(F.char_length("text")))).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted to be toxic.

    Null and empty texts have the score of the bias alone and stay; nulls in other columns don't matter; very long texts are read whole; equal texts fare alike,
    repeated rows too; without a toxic label nothing goes; an empty table stays empty; extra columns are dropped."""
    ship(spark)
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, keep=COLUMNS[1:]).filter("predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group: five-word shingles, similarity 0.8 or more.

    Rows without an id are linked with nothing and all kept. Rows that share an id and a text are one document; different texts of one id are
    documents of their own (in a group of such, the one with the smallest text hash stays). Null and empty texts, and texts without words, are linked with nothing; extra
    columns are dropped.
    """
    ship(spark)
    rows, more = _nodes(docs.filter("doc_id is not null"))
    found = ngram_join.linked(rows.select(F.col("node").alias("doc_id"), "text"), n=5, num=80, den=100)
    if more is None:
        kept = found.filter("component_id = doc_id").select(F.col("doc_id").alias("node")).distinct()
    else:
        place = F.struct(F.coalesce("i", "doc_id").alias("i"), "g", F.col("doc_id").alias("node"))
        placed = found.join(more.select(F.col("node").alias("doc_id"), F.col("doc_id").alias("i"), F.col("h").alias("g")), "doc_id", "left")
        kept = placed.groupBy("component_id").agg(F.min(place).alias("b")).select("b.node")
    # one shuffle of the texts; rows of a node differ in lang, source and n_chars at most
    once = rows.join(kept, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("r")).select("r.*")
    return once.select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a number per id and text, and the numbers that aren't ids (doc_id, h, node; None without any). The text with an id's smallest
    hash has the id itself, further ones have hashes that are no id and differ."""
    h = F.xxhash64("text")
    twice = stored(docs.select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("doc_id", "lo"), "repeated-ids")
    if twice.isEmpty():
        return docs.withColumn("node", F.col("doc_id")), None
    pairs = stored(docs.select("doc_id", h.alias("h")).distinct().join(twice, "doc_id").filter("h > lo").select("doc_id", "h"), "further-texts")
    salt = 0
    while True:
        more = stored(pairs.withColumn("node", F.xxhash64("doc_id", "h", F.lit(salt))), "numbers")
        taken = more.groupBy("node").count().filter("count > 1").select("node").unionByName(docs.select(F.col("doc_id").alias("node")).join(more, "node", "left_semi"))
        if taken.isEmpty():
            break
        salt += 1
    rows = docs.select(*COLUMNS, h.alias("h")).join(more, ["doc_id", "h"], "left").withColumn("node", F.coalesce("node", "doc_id")).drop("h")
    return stored(rows, "numbered"), more


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix: sources' shares go by the square root of their sizes. A row is known by its file and its
    place there, so that repeated rows and rows without an id need no numbers of their own; texts are shuffled to their position and then by it.

    docs must be read from files. A null source is a source of its own; no row is lost or doubled, whatever is null, empty, equal or long; an empty table stays empty; extra
    columns are dropped."""
    row = ["file_name", "row_index"]
    docs = docs.select(*COLUMNS, *(F.col(f"_metadata.{c}").alias(c) for c in row))
    rows = docs.join(mixing.mixed(docs, keep=row).select(*row, "position"), row)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "position").sortWithinPartitions("position").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, in stored order.

    docs must be read from files. Null and empty texts are documents of the end token alone; very long texts are cut into pieces; repeated rows and rows without an
    id are packed like others; of equally good cuts the encoder's order decides; an empty table has no pieces; extra columns aren't read."""
    ship(spark)
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file_name"))
    pieces = packing.packed(rows, packing.default_tokenizer())
    return packing.digested(pieces)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: SQL can't express the trained stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
