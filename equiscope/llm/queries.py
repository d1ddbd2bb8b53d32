"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, hard_negatives, hyperminhash, lang_id, licenses, mixing, radix_dedup, shards, token_files, util, warc, weak_quality, whitening

#: The vocabulary of the encoding query; its place and pattern are parameters of the operator.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer of the token-id files.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST)
""")
def op2_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.encode(util.without_spaces(F.col("text")), "UTF-8"), 256))
    return radix_dedup.radix_dedup(docs, keep_columns=["doc_id", "text_sha256"])


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    both = bpe.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query()
def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80, keep_columns=["doc_id"])
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))  # as the contract has it: of repeated ids all or none


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(CASE WHEN most <= level * weight THEN most
             ELSE weight * max(CASE WHEN most > level * weight THEN level END) OVER () END, 6) AS target FROM l),
p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * ((start + size / 2.0::DOUBLE < target)::INT + (start + source_size + size / 2.0::DOUBLE < target)::INT) AS BIGINT) AS taken
FROM p
""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_columns=["doc_id"]).drop("shards")


@query()
def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.minimax_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_columns=["doc_id"])


@query()
def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (declared language, source as host) and all pages (markup language, host, address suffix)."""
    docs, pages = read(spark, sf_dir, "documents"), lang_id.page_evidence(read(spark, sf_dir, "pages"))
    model = lang_id.fit(docs, "text", "lang", "doc_id")
    of_docs = lang_id.identify(docs, model, "text", declared="lang", host="source", keep_columns=["doc_id"])
    of_pages = lang_id.identify(pages, model, "_body", declared="_markup", host="_site", suffix="_tld", keep_columns=["page_id"])
    both = of_docs.unionByName(of_pages, allowMissingColumns=True)
    return both.select("doc_id", "page_id", "language", F.round("posterior", 6).alias("posterior"), (~F.col("rejected")).alias("kept"))


@query()
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = util.Scratch(spark, "warc")
    archives = scratch.path("archives")
    warc.write_archives(read(spark, sf_dir, "pages"), archives)
    found = archived_pages(scratch, archives)
    scratch.drop(archives)
    return found


def archived_pages(scratch: util.Scratch, archives: str) -> DataFrame:
    """A row per record of the archives; what could not be read stays, with its ``problem`` (``original``: a revisit whose response is lost)."""
    # payloads are checked where they are decoded; the digest and length alone go on
    records = scratch.table(warc.reassemble(warc.read_segments(scratch.spark, archives))
                            .select("type", "page_id", "digest", "refers_to", "problem", F.octet_length("payload").cast("long").alias("bytes")), "records")
    columns = ["page_id", "bytes", "digest", "type", "refers_to", "problem"]
    originals = (records.where("type = 'response' AND problem IS NULL").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("bytes").alias("_b"))
                 .distinct())
    revisit = "type = 'revisit' AND problem IS NULL"
    again = records.where(revisit).drop("bytes", "problem").join(originals, (F.col("refers_to") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    again = again.withColumn("bytes", F.col("_b")).withColumn("problem", F.when(F.col("_b").isNull(), "original"))
    return (records.where(f"NOT ({revisit})").select(columns).unionByName(again.select(columns))
            .select("page_id", F.col("bytes").alias("payload_bytes"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
                    F.col("type").alias("record_type"), "refers_to", "problem"))


@query(licenses.oracle_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in licenses.NEW])


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(read(spark, sf_dir, "documents"), keep_columns=["doc_id"])


@query()
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32)


@query()
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 are relabelled; those divisible by 100 are anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = util.Scratch(spark, "token-files").path("ids")
    token_files.write_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.file_index(spark, path)
