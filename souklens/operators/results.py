"""Result tables: labels as columns, CSV export and reload, the list of runs, the funnel."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import last_segment
from ..schema import STAGES

log = logging.getLogger(__name__)

#: Ranges in which runs are numbered.
RANGES = 200


def label_columns(base: Sequence[str], names: Sequence[str]) -> dict[str, str]:
    """Column names of prompts: the last segment of a dotted name, unless that makes two columns of one name."""
    names = list(dict.fromkeys(names))
    short = {n: last_segment(n) for n in names}
    if len({*base, *short.values()}) < len(base) + len(names):
        log.warning("column names clash: %s stay as they are", names)
        return {n: f"classifications.{n}" for n in names}
    return short


def wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with a nullable int column for each prompt in place of the map, after the others."""
    base = [c for c in df.columns if c != "classifications"]
    return df.select(*base, *[F.try_element_at("classifications", F.lit(n)).alias(c) for n, c in label_columns(base, names).items()])


#: How CSV tells an empty text from null: the one is quoted, the other is this mark.
EMPTY, NULL = "", "\\N"


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV files with header and quotes throughout; arrays as JSON text, nulls as NULL."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", EMPTY).option("nullValue", NULL).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote, by a schema in which arrays are strings; nulls and empty texts are what they were."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", EMPTY).option("nullValue", NULL).csv(path)


def run_id(term: Column, language: Column, location: Column, at: Column) -> Column:
    return F.concat_ws("_", term, language, location, F.date_format(at, "yyyyMMddHHmmss"))


def listed_runs(runs: DataFrame) -> DataFrame:
    """runs with index: -1 is the latest, by ts and run_id. A run list has one row for each run.

    Runs are numbered within ranges of ts, then moved on by the rows of earlier ranges; only runs of one ts have to be
    in one task. Ranges and their counts are one row, so both come from the same bounds.
    """
    within = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("ts"))), F.lit(0))
    bounds = runs.agg(F.percentile_approx("ts", [i / RANGES for i in range(1, RANGES)]).alias("__bounds"))
    counts = runs.select("ts").crossJoin(F.broadcast(bounds)).groupBy("__bounds", F.greatest(within(F.col("__bounds")), F.lit(0)).alias("b")).agg(F.count("*").alias("n"))
    ranges = counts.groupBy("__bounds").agg(F.collect_list(F.struct("b", "n")).alias("__counts"), F.sum("n").alias("__total"))
    a = runs.crossJoin(F.broadcast(ranges)).withColumn("__b", F.greatest(within(F.col("__bounds")), F.lit(0)))
    before = F.aggregate(F.filter("__counts", lambda x: x["b"] < F.col("__b")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    a = a.withColumn("__before", before - F.col("__total")).drop("__bounds", "__counts", "__total")
    place = F.row_number().over(W.partitionBy("__b").orderBy("ts", "run_id"))
    return a.withColumn("index", (place - 1 + F.col("__before")).cast("int")).drop("__b", "__before")


def load_run(results: DataFrame, runs: DataFrame, index: int = -1) -> DataFrame:
    """The result rows of the run with this index; results are partitioned by run_id."""
    one = listed_runs(runs).where(F.col("index") == index).select("run_id")
    return results.join(F.broadcast(one), "run_id", "left_semi")


#: A store of runs: rows in a folder for each write, and manifests, each of which names a run's folder, rows, schema and time of commit.
MANIFEST = "run_id string, ts timestamp, folder string, rows long, schema string, committed long"


def _write_rows(results: DataFrame, folder: str) -> None:
    results.write.partitionBy("run_id").parquet(folder)


def staged(results: DataFrame, path: str, ts: str = "ts") -> DataFrame:
    """Writes result rows (run_id, ts and what else there is) into a new folder of the store at path; gives the manifests that commit() needs. No reader sees the rows yet."""
    spark, folder = results.sparkSession, uuid.uuid4().hex
    results = results.withColumn("run_id", F.col("run_id").cast("string"))
    _write_rows(results, f"{path}/rows/{folder}")
    rows = spark.read.schema(results.schema).parquet(f"{path}/rows/{folder}")
    return rows.groupBy("run_id").agg(F.min(ts).cast("timestamp").alias("ts"), F.lit(folder).alias("folder"), F.count("*").alias("rows"), F.lit(results.schema.json()).alias("schema"))


def _commit(manifests: DataFrame, path: str) -> None:
    manifests.withColumn("committed", F.lit(time.time_ns())).coalesce(1).write.parquet(f"{path}/manifests/{uuid.uuid4().hex}")


def commit(spark: SparkSession, path: str, manifests: DataFrame) -> None:
    """Makes staged runs visible, all at once: one file, moved into place. Of a run that is committed again the later commit counts."""
    _commit(manifests, path)


def write_runs(results: DataFrame, path: str, ts: str = "ts") -> None:
    """Adds runs to the store at path, or replaces them. Results are worked out once.

    Each write has a folder of its own, so writers do not disturb one another, and one that ends early leaves no more
    than rows that no manifest names.
    """
    commit(results.sparkSession, path, staged(results, path, ts))


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of each run that counts: the last one committed."""
    every = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/*")
    return every.groupBy("run_id").agg(F.max(F.struct("committed", "folder", "ts", "rows", "schema")).alias("m")).select("run_id", "m.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """run_id, ts and index of all committed runs in the store at path; -1 is the latest."""
    return listed_runs(committed(spark, path).select("run_id", "ts"))


def _with_all_columns(rows: DataFrame, schemas: Sequence[T.StructType]) -> DataFrame:
    """rows with the columns of all schemas, in order of their first appearance; where types differ, the last one's."""
    kinds, own = {f.name: f.dataType for s in schemas for f in s}, {f.name: f.dataType.simpleString() for f in rows.schema}
    of = lambda c, kind: F.col(c) if own.get(c) == kind.simpleString() else (F.col(c) if c in own else F.lit(None)).cast(kind)
    return rows.select(*[of(c, kind).alias(c) for c, kind in kinds.items()])


def _schemas(manifests: DataFrame) -> list[T.StructType]:
    """The distinct schemas of runs, oldest first: as many as the results' form has changed."""
    found = manifests.groupBy("schema").agg(F.min("committed").alias("at")).orderBy("at").collect()
    return [T.StructType.fromJson(json.loads(r["schema"])) for r in found]


def load_results(spark: SparkSession, path: str, index: int = -1) -> DataFrame:
    """The stored rows of the committed run with this index; only its folder is read. Columns that only other runs have are null. An index that no run has is an error."""
    manifests = committed(spark, path)
    run = registry(spark, path).where(F.col("index") == index).join(manifests.drop("ts"), "run_id").first()
    if run is None:
        raise IndexError(f"no run {index}")
    own = T.StructType.fromJson(json.loads(run["schema"]))
    rows = spark.read.schema(own).parquet(f"{path}/rows/{run['folder']}").where(F.col("run_id") == F.lit(run["run_id"]))
    return _with_all_columns(rows, _schemas(manifests))


def all_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs, with the columns of all of them. Folders are listed on the driver, one for each write that still counts."""
    manifests = committed(spark, path)
    schemas, out = _schemas(manifests), None
    for own in schemas:
        mine = manifests.where(F.col("schema") == own.json())
        folders = [f"{path}/rows/{r['folder']}" for r in mine.select("folder").distinct().collect()]
        rows = reduce(DataFrame.unionByName, [spark.read.schema(own).parquet(f).withColumn("__folder", F.lit(f.rpartition("/")[2])) for f in folders])
        rows = rows.join(mine.select("run_id", F.col("folder").alias("__folder")), ["run_id", "__folder"], "left_semi").drop("__folder")
        rows = _with_all_columns(rows, schemas)
        out = rows if out is None else out.unionByName(rows)
    return out


def write_run_csv(spark: SparkSession, path: str, to: str, index: int = -1) -> None:
    """The run with this index of the store at path as CSV files in the folder `to`/run_id; written again, it replaces them."""
    rows = load_results(spark, path, index)
    run = registry(spark, path).where(F.col("index") == index).first()["run_id"]
    write_csv(rows.drop("run_id"), f"{to}/{run}", "overwrite")


def written_with_counts(df: DataFrame, path: str, mode: str = "error") -> tuple[DataFrame, dict[str, int]]:
    """Writes annotated rows as Parquet; gives the stored rows, and the funnel: how many rows each stage flagged, counted by the job that writes them."""
    counted = Observation("funnel")
    stage = F.coalesce("filtered_at_stage", F.lit("kept"))
    names = {f"n{i}": s for i, s in enumerate(("kept", *STAGES))}
    known = [F.count_if(stage == s).alias(n) for n, s in names.items()]
    df.observe(counted, *known, F.count_if(~stage.isin(*names.values())).alias("other")).write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {names.get(n, n): c for n, c in counted.get.items()}


def funnel(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("filtered_at_stage", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


def written(df: DataFrame, sink: Callable[[DataFrame], None]) -> None:
    """Hands the result to a sink of the user's own."""
    sink(df)
