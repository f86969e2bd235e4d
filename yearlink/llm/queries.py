"""Registered queries of this subpackage: one ``opN_<name>`` for each operator,
over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yearlink.llm import collocations, license_scan, minhash_dedup, mixing, rule_cascade, spelling, substring_dedup, warc
from yearlink.llm.common import read
from yearlink.llm.decontaminate import leaks
from yearlink.llm.html_extract import main_texts
from yearlink.llm.language_id import languages
from yearlink.llm.lm_scoring import scored
from yearlink.llm.minhash_dedup import near_duplicates
from yearlink.llm.quality_classifier import quality_scores
from yearlink.llm.substring_dedup import repeat_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


ORACLE["op1_warc"] = warc.SQL


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_cascade.judged(read(spark, sf_dir, "documents"))


ORACLE["op3_quality_rules"] = rule_cascade.SQL


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


ORACLE["op5_mixing"] = mixing.SQL


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op6_minhash_dedup"] = minhash_dedup.SQL


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(read(spark, sf_dir, "documents"))


ORACLE["op7_substring_dedup"] = substring_dedup.SQL


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(read(spark, sf_dir, "documents"))


ORACLE["op11_license_scan"] = license_scan.SQL


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(read(spark, sf_dir, "documents"))


ORACLE["op12_spelling_variants"] = spelling.SQL


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = collocations.SQL
