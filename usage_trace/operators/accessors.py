"""Getters and setters of fields, by naming convention and by what methods return and assign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usage_trace.functions.extract import getter_of, setter_of
from usage_trace.functions.text import regex
from usage_trace.operators.scopes import sticky_method
from usage_trace.schema import GETTER, SETTER

_RETURNS = regex(r"\breturn\s+(?:this\.)?(\w+)")
_ASSIGNS = regex(r"(?:this\.)?(\w+)\s*=\s*\w+")


def line_accessors(lines: DataFrame) -> DataFrame:
    """filepath, member, method, ref_type: what the lines of methods return and assign, read line by line."""
    inside = sticky_method(lines).where("method IS NOT NULL")
    returns = inside.select("filepath", F.regexp_extract("line", _RETURNS, 1).alias("member"), "method", F.lit(GETTER).alias("ref_type"))
    assigns = inside.select("filepath", F.regexp_extract("line", _ASSIGNS, 1).alias("member"), "method", F.lit(SETTER).alias("ref_type"))
    return returns.unionByName(assigns).where("member <> ''").distinct()


def accessor_tasks(fields: DataFrame, members: DataFrame) -> DataFrame:
    """Tasks for the accessors of field tasks: conventional names, and those of methods in members; name is the method's."""
    rest = [c for c in fields.columns if c != "name"]
    numbered = fields.withColumn("__ut_id", F.xxhash64(*fields.columns)).withColumnRenamed("name", "field")
    getters = numbered.select(getter_of(F.col("field")).alias("name"), F.lit(GETTER).alias("ref_type"), *rest, "__ut_id")
    setters = numbered.select(setter_of(F.col("field")).alias("name"), F.lit(SETTER).alias("ref_type"), *rest, "__ut_id")
    found = numbered.join(members.select(F.col("filepath").alias("def_file"), F.col("member").alias("field"), "method", "ref_type"), ["def_file", "field"])
    found = found.select(F.col("method").alias("name"), "ref_type", *rest, "__ut_id")
    return getters.unionByName(setters).unionByName(found).distinct().drop("__ut_id")
