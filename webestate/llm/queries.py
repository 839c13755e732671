"""The numbered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webestate.llm import chat, codes, decontam, infill, langid, lines, mixing, near, passages, secrets, suffixes, twins, urlfilter, vectors
from webestate.llm.common import read
from webestate.session import materialise


#: Formats that label a finding as a secret: an access key id, or a hexadecimal value assigned to a credential word.
KEY_ID, ASSIGNED, HEX = r"^AKIA[0-9A-Z]{16}$", r"(?i)(token|password|secret)\s*=\s*[\"']?$", r"(?i)^[0-9a-f]{16,}$"
#: What may be a secret of another format: an assigned value, or letters and digits in one run. Such findings have no label.
VALUE, MIXED = r"[=:]\s*[\"']?$", r"[A-Za-z][0-9]|[0-9][A-Za-z]"


def secret_label() -> Column:
    """True for the known formats, False for words and numbers that stand by no credential word and no assignment, else null."""
    known = F.col("candidate").rlike(KEY_ID) | (F.col("before").rlike(ASSIGNED) & F.col("candidate").rlike(HEX))
    unclear = F.col("before").rlike(secrets.CREDENTIAL) | F.col("before").rlike(VALUE) | F.col("candidate").rlike(MIXED)
    return F.when(known, True).when(~unclear, False)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the forest's verdict; labels come from formats, in documents that are not held out."""
    found = secrets.scan(read(spark, sf_dir, "documents"), secret_label(), ~langid.held_out(F.col("doc_id")))
    return found.select("doc_id", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("n_chars"),
                        langid.held_out(F.col("doc_id")).alias("held_out"), "probability", "secret")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(read(spark, sf_dir, "documents"))


#: The rules that op3 applies: host, path prefix, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Host labels of unwanted sites; op3 lists the canonical URLs of their pages.
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.arrays_overlap(F.split(urlfilter.url_host(F.col("url")), r"\."), F.array(*[F.lit(x) for x in UNWANTED]))
    listed = pages.where(bad).select(urlfilter.canonical(F.col("url")).alias("canon"))
    return urlfilter.judge_pages(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digest(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digest(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_digest(read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_links(read(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digest(read(spark, sf_dir, "embeddings"))


def chat_records(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, record``: rows as four exports would hold them, dealt by ``conv_id``; nulls and other roles as messages."""
    role, text = F.col("role"), F.col("text")
    export = F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(2))
    named = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    shared = F.to_json(F.struct(F.array(F.struct(named.alias("from"), text.alias("value"))).alias("conversations")))
    record = F.when(export == 3, shared)
    for which, fields in ((0, ("system", "prompt", "completion")), (1, ("context", "instruction", "output"))):
        for name, field in zip(("system", "user", "assistant"), fields, strict=True):
            record = record.when((export == which) & (role == name), F.to_json(F.struct(text.alias(field))))
    messages = F.to_json(F.struct(F.array(F.struct("role", text.alias("content"))).alias("messages")))
    simple = F.coalesce(text.isNotNull() & role.isin("system", "user", "assistant"), F.lit(False))
    return conversations.select("conv_id", "turn", F.when(simple, F.coalesce(record, messages)).otherwise(messages).alias("record"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = [{"role": role, "content": "</s>[INST] ok [/INST]"} for role in ("user", "assistant")]
    table = read(spark, sf_dir, "conversations")
    extra = spark.createDataFrame([(-7, None, json.dumps({"messages": says}))], "conv_id bigint, turn bigint, record string")
    turns = chat.canonical_turns(chat_records(table).unionByName(extra))
    return chat.read_back(materialise(chat.format_chats(turns.where(F.col("layout").isNotNull())), "chats"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_format": op12_chat_format,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op3_url_filter": twins.URL_FILTER,
    "op6_source_mixing": twins.SOURCE_MIXING,
    "op8_embedding_dedup": twins.EMBEDDING_DEDUP,
    "op9_line_dedup": twins.LINE_DEDUP,
    "op11_vector_codes": twins.VECTOR_CODES,
    "op12_chat_format": twins.CHAT_FORMAT,
    "op13_fill_in_middle": twins.FILL_IN_MIDDLE,
}
