"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers

from tarmac.llm import (
    bpe, exactdedup, filteraudit, hostrep, kneser, langid, linededup, minhash, mixing, periodicruns, qualityrules, toolcalls, toxicity)
from tarmac.llm.common import read_table

# The vocabulary file's place; it is read on the driver only.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark, sf_dir):
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op2_tool_calls(spark, sf_dir):
    return toolcalls.digest(read_table(spark, sf_dir, "conversations"))


def op3_host_reputation(spark, sf_dir):
    return hostrep.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark, sf_dir):
    return exactdedup.dedup_exact(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return qualityrules.judge(read_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    return mixing.digest(read_table(spark, sf_dir, "documents"))


def op8_bpe(spark, sf_dir):
    return bpe.digest(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_kneser_ney(spark, sf_dir):
    return kneser.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark, sf_dir):
    return filteraudit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark, sf_dir):
    return periodicruns.digest(read_table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_tool_calls, op3_host_reputation, op4_exact_dedup, op5_quality_rules, op6_minhash_near_dedup, op7_source_mixing, op8_bpe, op9_kneser_ney, op10_line_dedup,
    op11_filter_audit, op12_periodic_runs, op13_toxicity)}
ORACLE = {"op2_tool_calls": toolcalls.ORACLE, "op3_host_reputation": hostrep.ORACLE, "op4_exact_dedup": exactdedup.ORACLE, "op5_quality_rules": qualityrules.ORACLE,
          "op6_minhash_near_dedup": minhash.ORACLE, "op11_filter_audit": filteraudit.ORACLE, "op12_periodic_runs": periodicruns.ORACLE}
