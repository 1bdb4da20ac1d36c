"""The queries op1_ to op13_ over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, hmm, kd_sharding, perplexity, rope_fim, secrets, simhash_dedup, suffix_dedup, tandem_runs, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(table(spark, sf_dir, "conversations"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(table(spark, sf_dir, "documents"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem_runs.planted_runs(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rope_fim.digest(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_kd_sharding, op3_bpe, op4_chat, op5_simhash_dedup, op6_perplexity, op7_suffix_array, op8_secrets, op9_hmm, op10_decontaminate, op11_tandem_runs, op12_fill_in_middle, op13_token_counts)}

_FILL_IN_MIDDLE = r"""
with units as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as hashed,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as unit
  from documents
), draws as (
  select *, len(unit) as n, cast('0x' || hashed[1:8] as bigint) as h1, cast('0x' || hashed[9:16] as bigint) as h2,
    cast('0x' || hashed[17:24] as bigint) as h3, cast('0x' || hashed[25:32] as bigint) as h4
  from units
), cut as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two
  from draws
), parts as (
  select *, array_to_string(unit[1:one], '') as prefix, array_to_string(unit[one + 1:two], '') as middle, array_to_string(unit[two + 1:], '') as suffix
  from cut
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from parts"""

#: SQL where it can express the operator; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {"op12_fill_in_middle": _FILL_IN_MIDDLE}
