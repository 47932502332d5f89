"""How payloads depart from their declared schema: unknown, missing and wrong-typed fields, with counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from docforge.schemas import PAYLOAD

UNKNOWN, MISSING, WRONG_TYPE = "unknown", "missing", "wrong type"
_KINDS = {StringType: "string", LongType: "integer", IntegerType: "integer", DoubleType: "number", BooleanType: "boolean", StructType: "object", ArrayType: "array"}
#: What a field of a kind may hold besides values of that kind.
_ALSO = {"number": ("integer",)}


def declared_paths(kind: DataType, path: str = "$") -> list[tuple[str, str, str | None]]:
    """``path, kind, parent`` of a declared type and all below it; elements of an array have the path ``[]`` and no parent."""
    out = [(path, _KINDS[type(kind)], None)]
    if isinstance(kind, ArrayType):
        out += declared_paths(kind.elementType, f"{path}[]")
    if isinstance(kind, StructType):
        for field in kind.fields:
            (own, name, _), *below = declared_paths(field.dataType, f"{path}.{field.name}")
            out += [(own, name, path), *below]
    return out


def _kind(value: Column) -> Column:
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object")
        .when(told.startswith("ARRAY"), "array")
        .when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean")
        .when(told.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | told.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(told == "VOID", "null")
        .otherwise("number")
    )


def _nodes(bronze: DataFrame, depth: int) -> DataFrame:
    """``path, kind`` of every JSON value of all successful payloads, down to ``depth`` names or elements."""
    spark = bronze.sparkSession
    level = bronze.where("status = 'success'").select(F.lit("$").alias("path"), F.try_parse_json("payload").alias("value")).where("value IS NOT NULL")
    levels = [level]
    for _ in range(depth):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "inner"))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "key"))
        level = inside.select(step.alias("path"), F.col("inner").alias("value"))
        levels.append(level)
    return reduce(DataFrame.unionByName, [each.select("path", _kind(F.col("value")).alias("kind")) for each in levels])


def schema_drift(bronze: DataFrame, schema: str = PAYLOAD, depth: int | None = None) -> DataFrame:
    """``path, finding, expected, found, occurrences``, one row for each kind of departure.

    An unknown field is told once, without what is below it. A field is missing where its object is there and it isn't; a JSON null
    is no departure. Values are counted by path on the map side, so only paths and kinds are shuffled. ``depth`` limits how
    many names and elements deep a payload is read, the schema's own depth by default; malformed text isn't counted
    here (``parse_yield`` does).
    """
    spark = bronze.sparkSession
    declared = declared_paths(StructType.fromDDL(schema))
    reach = max(path.count(".") + path.count("[]") for path, _, _ in declared) if depth is None else depth
    known = [row for row in declared if row[0].count(".") + row[0].count("[]") <= reach]
    allowed = F.array_contains(F.split("also", ","), F.col("found")) | (F.col("found") == "null")
    counted = _nodes(bronze, reach).groupBy("path", F.col("kind").alias("found")).agg(F.count("*").alias("occurrences"))
    rows = [(path, kind, ",".join((kind, *_ALSO.get(kind, ())))) for path, kind, _ in known]
    paths = spark.createDataFrame(rows, "path string, expected string, also string")
    wrong = counted.join(paths, "path").where(~allowed).select("path", F.lit(WRONG_TYPE).alias("finding"), "expected", "found", "occurrences")

    # An unknown path is reported if what it lies in is declared.
    lies_in = F.when(F.col("path").endswith("[]"), F.expr("substring(path, 1, length(path) - 2)")).otherwise(F.regexp_replace("path", r"\.[^.]*$", ""))
    strange = counted.join(paths.select("path"), "path", "left_anti").withColumn("of", lies_in)
    objects = paths.where("expected = 'object' OR expected = 'array'").select(F.col("path").alias("of"))
    unknown = strange.join(objects, "of", "left_semi").select("path", F.lit(UNKNOWN).alias("finding"), F.lit(None).cast("string").alias("expected"), "found", "occurrences")

    fields = spark.createDataFrame([(path, kind, parent) for path, kind, parent in known if parent], "path string, expected string, parent string")
    whole = counted.where("found = 'object'").select(F.col("path").alias("parent"), F.col("occurrences").alias("objects"))
    there = counted.groupBy("path").agg(F.sum("occurrences").alias("there"))
    gap = F.col("objects") - F.coalesce("there", F.lit(0))
    missing = fields.join(whole, "parent").join(there, "path", "left").where(gap > 0)
    return (
        wrong.unionByName(unknown)
        .unionByName(missing.select("path", F.lit(MISSING).alias("finding"), "expected", F.lit(None).cast("string").alias("found"), gap.alias("occurrences")))
    )
