"""Reading request batches and request streams.

Requests come typed (``read_requests``), or as lines of JSON that clients wrote
(``read_raw_requests``). Of the latter each field is held against its type
before it becomes a column: a value of another type refuses its request with
status 422 and never turns into a default. What counts as a value of a type:

* whole numbers: JSON numbers without a fraction, ``true`` and ``false``, and
  texts of digits with a sign and blanks around them; all within the range;
* texts: JSON strings only;
* truth values: ``true``, ``false``, 0, 1, and a fixed list of texts;
* times: texts in ISO form.

A field that may be left out may also be ``null``, unless it has a default. A
line that is no JSON object is refused as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, TimestampNTZType

from stockroom.schemas import REQUEST_DEFAULTS, REQUESTS, REQUIRED

# Reasons for a request with fields left out or of a wrong type.
FIELD_REQUIRED = "Field required"
NO_JSON = "JSON decode error"
WRONG_TYPE = {
    LongType: "Input should be a valid integer",
    IntegerType: "Input should be a valid integer",
    StringType: "Input should be a valid string",
    BooleanType: "Input should be a valid boolean",
    TimestampNTZType: "Input should be a valid datetime",
}
# Texts that stand for truth values.
TRUE_TEXTS = ["true", "1", "on", "yes", "t", "y"]
FALSE_TEXTS = ["false", "0", "off", "no", "f", "n"]


def with_defaults(frame: DataFrame, kind: str) -> DataFrame:
    """Fill fields left out, and bring the columns into the order of the schema."""
    defaults = REQUEST_DEFAULTS.get(kind, {})
    return frame.select(
        *(
            F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name)
            if f.name in defaults
            else F.col(f.name)
            for f in REQUESTS[kind].fields
        )
    )


def read_requests(spark: SparkSession, kind: str, path: str, fmt: str = "json") -> DataFrame:
    """Requests whose types are known to be right; values that do not fit become NULL."""
    return with_defaults(spark.read.schema(REQUESTS[kind]).format(fmt).load(path), kind)


def stream_requests(
    spark: SparkSession,
    kind: str,
    path: str,
    fmt: str = "json",
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files dropped into ``path`` as a stream of requests."""
    return with_defaults(_stream(spark.readStream.schema(REQUESTS[kind]), path, fmt, glob, files_per_batch), kind)


def _stream(reader, path: str, fmt: str, glob: str | None, files_per_batch: int | None) -> DataFrame:
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


# --- raw requests -------------------------------------------------------------


def read_raw_requests(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Lines of JSON as ``parsed_requests``."""
    return parsed_requests(spark.read.text(path), kind, "value")


def stream_raw_requests(
    spark: SparkSession, kind: str, path: str, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    return parsed_requests(_stream(spark.readStream, path, "text", glob, files_per_batch), kind, "value")


def parsed_requests(lines: DataFrame, kind: str, column: str = "raw") -> DataFrame:
    """The columns of the kind, defaults filled in, with ``errors``, NULL where all is right, and the ``raw`` line.

    The line is parsed, its fields are looked up and then read in selects of their own: what the next one uses more
    than once stays a column, and is not worked out again at every use.
    """
    fields = REQUESTS[kind].fields
    parsed = lines.select(F.col(column).alias("raw"), F.try_parse_json(column).alias("_json"))
    looked = parsed.select(
        "raw", "_json", F.schema_of_variant("_json").alias("_shape"),
        *(F.schema_of_variant(F.try_variant_get("_json", _path(f), "variant")).alias(_given(f)) for f in fields),
        *(F.try_variant_get("_json", _path(f), "string").alias(_written(f)) for f in fields),
    )
    typed = looked.select(
        "raw", "_shape", *(_given(f) for f in fields), *(_value(f).alias(f.name) for f in fields)
    )
    told = F.array_compact(F.array(*(_error(f, kind) for f in fields)))
    is_object = F.coalesce(F.col("_shape").startswith("OBJECT<"), F.lit(False))
    errors = F.when(~is_object, F.lit(NO_JSON)).otherwise(F.nullif(F.array_join(told, "; "), F.lit("")))
    return typed.select(*(_filled(f, kind).alias(f.name) for f in fields), errors.alias("errors"), "raw")


def _path(field: StructField) -> str:
    return f"$.{field.name}"


def _given(field: StructField) -> str:
    """The column that says what type a field was given as, NULL if it was left out."""
    return f"_given_{field.name}"


def _written(field: StructField) -> str:
    """The column that holds a field as a text."""
    return f"_written_{field.name}"


def _value(field: StructField) -> Column:
    """The value of a field, NULL if it is not of its type."""
    return _VALUES[type(field.dataType)](field, F.col(_given(field)), F.col(_written(field)))


def _error(field: StructField, kind: str) -> Column:
    """What is wrong with a field, NULL if nothing is."""
    must = field.name == "seq" or field.name in REQUIRED[kind]
    null_is_wrong = must or REQUEST_DEFAULTS.get(kind, {}).get(field.name) is not None
    wrong = F.lit(f"{field.name}: {WRONG_TYPE[type(field.dataType)]}")
    fine = F.lit(None).cast("string")
    given = F.col(_given(field))
    return (
        F.when(given.isNull(), F.lit(f"{field.name}: {FIELD_REQUIRED}") if must else fine)
        .when(given == "VOID", wrong if null_is_wrong else fine)
        .when(F.col(field.name).isNull(), wrong)
    )


def _filled(field: StructField, kind: str) -> Column:
    """The value of a field, or its default if it was left out."""
    default = REQUEST_DEFAULTS.get(kind, {}).get(field.name)
    if default is None:
        return F.col(field.name)
    left_out = F.col(_given(field)).isNull()
    return F.when(left_out, F.lit(default).cast(field.dataType)).otherwise(F.col(field.name))


def _whole(field: StructField, given: Column, written: Column) -> Column:
    as_number = F.try_variant_get("_json", _path(field), "double")
    digits = written.rlike(r"^\s*[+-]?[0-9]+\s*$")
    number = given.startswith("DECIMAL") & written.rlike(r"^-?[0-9]+(\.0*)?$")
    double = (given == "DOUBLE") & (as_number == F.floor(as_number))
    fits = (given == "BIGINT") | (given == "BOOLEAN") | number | double | ((given == "STRING") & digits)
    return F.when(fits, F.try_variant_get("_json", _path(field), field.dataType.simpleString()))


def _text(field: StructField, given: Column, written: Column) -> Column:
    return F.when(given == "STRING", written)


def _truth(field: StructField, given: Column, written: Column) -> Column:
    said = F.lower(written)
    readable = (given == "BOOLEAN") | (given == "BIGINT") | (given == "STRING")
    return F.when(readable & said.isin(TRUE_TEXTS), F.lit(True)).when(readable & said.isin(FALSE_TEXTS), F.lit(False))


def _time(field: StructField, given: Column, written: Column) -> Column:
    return F.when(given == "STRING", written.try_cast(field.dataType))


_VALUES = {LongType: _whole, IntegerType: _whole, StringType: _text, BooleanType: _truth, TimestampNTZType: _time}


def sound_requests(parsed: DataFrame, kind: str) -> DataFrame:
    """The requests in which everything is right."""
    return parsed.where(F.col("errors").isNull()).select(*REQUESTS[kind].fieldNames())


def refused_decisions(parsed: DataFrame) -> DataFrame:
    """Decision rows (status 422) for the others; ``seq`` is NULL where that is what is wrong."""
    return parsed.where(F.col("errors").isNotNull()).select(
        "seq", F.lit(False).alias("accepted"), F.lit(422).alias("status"), F.col("errors").alias("reason")
    )


def write_quarantine(parsed: DataFrame, root: str, kind: str, batch: int) -> None:
    """Keep the refused lines and why, for whoever sent them. Writing a batch again replaces it."""
    refused = parsed.where(F.col("errors").isNotNull()).select("raw", "errors")
    refused.write.mode("overwrite").json(f"{root}/{kind}/lote={batch}")


# --- typed requests that may lack fields ----------------------------------------


def _complete(kind: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in REQUIRED[kind]), F.lit(True))


def complete_requests(requests: DataFrame, kind: str) -> DataFrame:
    """The requests that carry every field they must carry."""
    return requests.where(_complete(kind))


def incomplete_decisions(requests: DataFrame, kind: str) -> DataFrame:
    """Decision rows (status 422) for the others."""
    return requests.where(~_complete(kind)).select(
        "seq",
        F.lit(False).alias("accepted"),
        F.lit(422).alias("status"),
        F.lit(FIELD_REQUIRED).alias("reason"),
    )
