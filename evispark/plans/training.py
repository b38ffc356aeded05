"""The pN_ queries of the general operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.packed import unpack
from evispark.operators.units import QUANTITIES, common_units, unit_calibration
from evispark.session import Scratch, read


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    items = unpack(read(spark, sf, "extraction_records"), "post_processing", Scratch(spark))
    return items.where("n_items >= 2").select("row_id", "item_pos", "item_text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    done = common_units(read(spark, sf, "extraction_records"), Scratch(spark))
    named = [q.units[0][0] for q in QUANTITIES]
    return done.where(~F.col("unit").isin(*named)).select("row_id", "field_name", "value_common")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Filled quantities by unit, how the unit was found and what the files' texts say to it, review included."""
    done = common_units(read(spark, sf, "extraction_records"), Scratch(spark))
    return done.groupBy("field_name", "unit", "how", "audit").agg(F.count("*").alias("n_rows"))


def p7_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """How often the classifier is right on files that it was not fitted on, by its score."""
    return unit_calibration(read(spark, sf, "extraction_records"), Scratch(spark))


QUERIES = {f.__name__: f for f in (p6_found, p7_found, p7_report, p7_calibration)}
SQL: dict[str, str] = {}
