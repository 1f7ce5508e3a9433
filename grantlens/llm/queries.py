"""The registered queries of this subpackage and, where SQL can say it, the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grantlens.llm import archive, codes, contentsort, language, lexical, merkle, mixing, neardup, neighbours, packing, personal, quotes, shingles
from grantlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


@query("op2_language")
def op2(spark: SparkSession, base: str) -> DataFrame:
    return language.languages(table(spark, base, "documents"))


@query("op3_mixing", mixing.SQL)
def op3(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(table(spark, base, "documents"))


@query("op9_personal_data")
def op9(spark: SparkSession, base: str) -> DataFrame:
    return personal.personal_data(table(spark, base, "documents"))


@query("op10_codes")
def op10(spark: SparkSession, base: str) -> DataFrame:
    return codes.round_trip(table(spark, base, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents"))


@query("op5_archive", archive.SQL)
def op5(spark: SparkSession, base: str) -> DataFrame:
    return archive.round_trip(table(spark, base, "pages"))


@query("op1_jaccard_join", shingles.SQL)
def op1(spark: SparkSession, base: str) -> DataFrame:
    return shingles.joined(table(spark, base, "documents"))


@query("op8_near_copies", neardup.SQL)
def op8(spark: SparkSession, base: str) -> DataFrame:
    return neardup.linked_vectors(table(spark, base, "embeddings"))


@query("op7_neighbours")
def op7(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.near_hundredths(table(spark, base, "embeddings"))


@query("op6_quotation_linking", quotes.SQL)
def op6(spark: SparkSession, base: str) -> DataFrame:
    return quotes.conversations(table(spark, base, "conversations"))


@query("op12_content_sort", contentsort.SQL)
def op12(spark: SparkSession, base: str) -> DataFrame:
    return contentsort.copies(table(spark, base, "documents"))


@query("op13_manifest", merkle.SQL)
def op13(spark: SparkSession, base: str) -> DataFrame:
    return merkle.verified(table(spark, base, "documents"))


@query("op11_best_positions", lexical.SQL)
def op11(spark: SparkSession, base: str) -> DataFrame:
    return lexical.search(table(spark, base, "documents"), table(spark, base, "benchmark"))
