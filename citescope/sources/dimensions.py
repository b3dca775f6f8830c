"""The fixed dimensions as DataFrames. All have a fixed, small number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K


def dim_engine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        K.ENGINES, "engine string, measure_mode string, kr_weight string, citation_path string"
    )


def dim_bot(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.BOTS, "token string, operator string, category string")


def dim_bot_detection(spark: SparkSession) -> DataFrame:
    rows = [(bot, i) for bot, ids in K.BOT_DETECTION_IDS for i in ids]
    return spark.createDataFrame(rows, "bot string, detection_id bigint")


def dim_checklist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CHECKLIST_ITEMS, "checklist string, item_id string, weight string")


def dim_procedure(spark: SparkSession) -> DataFrame:
    rows = [(i, q, label, words) for i, (q, label, words) in enumerate(K.PROCEDURES)]
    return spark.createDataFrame(rows, "procedure_ord int, q string, label string, keywords array<string>")


def dim_follow_up(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.FOLLOW_UPS, "product_id string, rule string")


def dim_sido(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SIDO, "spelling string, short string")


def dim_region_term(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in K.REGION_TERMS], "term string")


def dim_score_item(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(K.SCORE_ITEMS)]
    return spark.createDataFrame(
        rows, "item_ord int, key string, label string, max int, layer string, axis string, why string"
    )
