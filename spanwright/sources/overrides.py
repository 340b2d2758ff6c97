"""A folder of override files, read in order of application: what is defined first counts, and what is wrong is a row."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.plans.materialise import sorted_side

#: Folders in order of application; units are read from the last.
KINDS = ("early", "historical", "modern")
_FILE = "kind string, region string, entries array<string>, units array<string>, _corrupt_record string"


class Overrides(NamedTuple):
    """`files` (file, kind, region, n_entries, n_units); `entries` and `units` (file, kind, place, id, from_year, to_year, status, error, body); `problems` (file, id, detail)."""

    files: DataFrame
    entries: DataFrame
    units: DataFrame
    problems: DataFrame


def override_files(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, value): the whole text of each .json file below a folder of its kind; other folders are not looked at. Spark lists no empty files, so these leave no row."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    # paths are encoded as in addresses, but for the plus sign
    part = lambda i: F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), i), F.lit("+"), F.lit("%2B")))
    return raw.select(part(-2).alias("kind"), part(-1).alias("name"), "value")


def _is_object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))


def _items(files: DataFrame, lists: str, what: str, key: str, present: int) -> DataFrame:
    """The items of a list of each file with their checks; an item keeps its whole text as `body`."""
    rows = files.select("order", "file", "kind", F.posexplode(f"read.{lists}").alias("place", "body"))
    rows = rows.withColumn("item", F.from_json(F.when(_is_object(F.col("body")), F.col("body")), f"{key} string, years string, status string"))
    years = F.regexp_replace("item.years", r"\s", "")
    side = r'(?:-?\d{1,9}|"present")'
    pair = rf"^\[({side}),({side})\]$"
    year = lambda i: F.when(F.regexp_extract(years, pair, i) == '"present"', F.lit(present)).otherwise(F.regexp_extract(years, pair, i).try_cast("int"))
    rows = rows.withColumn("given", F.nullif(F.col(f"item.{key}"), F.lit(""))).withColumn("a", year(1)).withColumn("b", year(2))
    error = (
        F.when(~_is_object(F.col("body")), f"{what} is not an object")
        .when(F.coalesce(F.size(F.from_json("item.years", "array<string>")), F.lit(-1)) != 2, "years must be [from, to]")
        .when(F.col("a").isNull() | F.col("b").isNull(), 'years must be integers or "present"')
        .when((F.col("a") == 0) | (F.col("b") == 0), "there is no year 0")
        .when(F.col("a") > F.col("b"), "years run backwards")
    )
    rows = rows.withColumn("years_error", error)
    sound = F.col("years_error").isNull()
    named = F.coalesce("given", F.concat("file", F.lit("#"), F.col("place")))
    wrong = F.coalesce("years_error", F.when(F.col("given").isNull(), f"{what} has no {key}"))
    return rows.select(
        "order", "file", "kind", "place", named.alias("id"), F.when(sound, F.col("a")).alias("from_year"), F.when(sound, F.col("b")).alias("to_year"), F.col("item.status").alias("status"), wrong.alias("error"), "body"
    )


def _with_first(items: DataFrame) -> DataFrame:
    """Each item with the first place and file of its id, by an aggregation and a join back that only repeated ids need."""
    at = F.struct("order", "file", "place")
    first = items.groupBy("id").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("id", "first")
    return items.join(sorted_side(first), "id", "left").withColumn("later", F.coalesce(at != F.col("first"), F.lit(False)))


def overrides(files: DataFrame, present: int, kinds: Sequence[str] = KINDS) -> Overrides:
    """What the files (kind, name, value) define, in the order of `kinds`, then names, then places in the file.

    A file is a JSON object with the lists `entries` and `units`; an entry has an id, a unit a code in `unit`, both have years [from, to], where "present"
    stands for `present`. All entries are given, also those whose id was used before, which is a problem; of units only the first of a code. Units outside
    the last kind are not read. An item that is not an object, has no id (its file and place take its stead) or no valid years has an error and no years.
    A text that is no JSON, whose lists are none, or that is null gives a problem and nothing else; files of other kinds are not looked at.

    Each file is one row, so files must fit in a task, as files written by hand do; all else is spread by id.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    rows = files.filter(F.col("kind").isin(*kinds)).select(F.concat_ws("/", "kind", "name").alias("file"), "kind", order.alias("order"), "value")
    rows = rows.withColumn("read", F.from_json("value", _FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    whole = F.try_parse_json("value")
    lists = F.col("read").isNull() | F.col("read._corrupt_record").isNotNull()
    fault = F.when(whole.isNull(), "cannot read file").when(~F.schema_of_variant(whole).startswith("OBJECT"), "file is not a JSON object").when(lists, "cannot read file")
    rows = rows.withColumn("fault", fault)
    good, last = rows.filter("fault IS NULL"), kinds[-1]
    entries = _with_first(_items(good, "entries", "entry", "id", present))
    units = _with_first(_items(good.filter(F.col("kind") == last), "units", "unit", "unit", present))
    no_id = F.lit(None).cast("string").alias("id")
    declared = F.coalesce("read.kind", F.lit("missing"))
    problems = (
        rows.filter("fault IS NOT NULL").select("file", no_id, F.col("fault").alias("detail"))
        .unionByName(good.filter(declared != F.col("kind")).select("file", no_id, F.concat(F.lit("kind is "), declared, F.lit(", read as "), "kind").alias("detail")))
        .unionByName(good.filter((F.col("kind") != last) & (F.size("read.units") > 0)).select("file", no_id, F.lit(f"units are read from {last} files only").alias("detail")))
        .unionByName(entries.filter("later").select("file", "id", F.concat(F.lit("id is first in "), "first.file").alias("detail")))
        .unionByName(units.filter("later").select("file", "id", F.concat(F.lit("unit is first in "), "first.file", F.lit(", this one is ignored")).alias("detail")))
    )
    size = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0)).cast("long")
    kept = units.filter("NOT later")
    in_file = kept.groupBy("file").agg(F.count("*").alias("n_units"))
    heads = good.select("file", "kind", F.col("read.region").alias("region"), size("read.entries").alias("n_entries")).join(sorted_side(in_file), "file", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0).cast("long")))
    shown = ("file", "kind", "place", "id", "from_year", "to_year", "status", "error", "body")
    return Overrides(heads, entries.select(*shown), kept.select(*shown), problems)
