"""The registered queries of the pipeline's operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import toxicity
from footfall.llm.centroids import cluster
from footfall.llm.common import table
from footfall.llm.conversation_trie import prefix_trie
from footfall.llm.decontamination import contaminated
from footfall.llm.html_text import extract_text
from footfall.llm.line_dedup import remove_repeated_runs
from footfall.llm.near_duplicates import near_duplicates
from footfall.llm.packing import pack
from footfall.llm.quality import judge_quality
from footfall.llm.secrets import as_text, find_secrets
from footfall.llm.sql import SQL  # noqa: F401
from footfall.llm.substrings import remove_repeats
from footfall.llm.token_counts import count_tokens
from footfall.llm.url_filters import address_of, host_of, judge_captures, path_of


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine of a cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _hash(text: Column) -> Column:
    """28 bits of a text's MD5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a day of 2024 on which each was fetched."""
    day = (_hash(F.col("page_id").cast("string")) % 366).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts, paths and addresses that the pages have."""
    url = F.col("url")
    step = F.split(path_of(url), "/")
    seen = pages.select(host_of(url).alias("host"), F.get(step, F.lit(1)).alias("step"), address_of(url).alias("address"))
    path = F.concat_ws("/", "host", "step")

    def dated(kind, names: DataFrame, lists: Column, when: Column, day: Column, action: str) -> DataFrame:
        start = F.lit("2024-01-01").cast("date")
        return names.where(when).select(
            lists.alias("list"), F.concat(F.lit(f"{kind}:"), "name").alias("key"),
            F.date_add(start, day.cast("int")).alias("day"), F.lit(action).alias("action"))

    h = F.col("h")
    hosts = seen.select(F.col("host").alias("name"), _hash(F.col("host")).alias("h")).distinct()
    paths = seen.where("step is not null").select(path.alias("name"), _hash(F.concat(F.lit("path"), path)).alias("h")).distinct()
    addresses = seen.select(F.col("address").alias("name"), _hash(F.col("address")).alias("h")).distinct()
    sites = seen.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("name"), F.lit(0).alias("h")).distinct()
    kind = F.get(F.array(*map(F.lit, ("adult", "malware", "spam"))), (h % 3).cast("int"))
    parts = [
        dated("domain", hosts, kind, h % 4 < 3, h % 200, "add"),
        dated("domain", hosts, kind, (h % 4 < 3) & (h % 2 == 0), h % 200 + 60, "remove"),
        dated("domain", hosts, kind, h % 8 == 0, h % 200 + 120, "add"),
        dated("path", paths, F.lit("paths"), h % 5 == 0, h % 366, "add"),
        dated("address", addresses, F.lit("addresses"), h % 50 == 0, h % 366, "add"),
        dated("domain", sites, F.lit("parked"), F.lit(True), h + 100, "add"),
        dated("domain", sites, F.lit("parked"), F.lit(True), h + 110, "remove"),
    ]
    return reduce(DataFrame.unionAll, parts)


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = judge_captures(sample_captures(pages), sample_entries(pages))
    return judged.select(
        "page_id", "fetched", F.size("lists").cast("long").alias("n_lists"), F.array_join("lists", ",").alias("lists"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=2)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    left = remove_repeated_runs(docs)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings"))


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_html_text": op12_html_text,
    "op13_prefix_trie": op13_prefix_trie,
}
