"""Classification with prompts by a batch predictor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import whole_number
from ..schema import DEFAULT_LABEL, Prompt

Predictor = Callable[[pd.DataFrame], pd.Series]


def rendered(context: Column, name: Column, description: Column) -> Column:
    r"""The user's message. Fixed value: its wording; after the description stand a backslash and the letter n."""
    return F.concat(F.lit("Context: "), context, F.lit("\n\nProduct Details: "), name, F.lit("\n"), description, F.lit("\\n"), F.lit("\nRelevance:"))


def messages(system_prompt: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system_prompt.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def label(reply: Column, allowed: Column, name: Column, description: Column, default: int = DEFAULT_LABEL) -> Column:
    """The integer of a reply if it is allowed; the default for anything else, and where name or description is null."""
    n = whole_number(reply)
    ok = name.isNotNull() & description.isNotNull() & n.isNotNull() & F.array_contains(allowed, n.cast("int")) & (n == n.cast("int"))
    return F.when(F.coalesce(ok, F.lit(False)), n.cast("int")).otherwise(F.lit(default))


def run_prompts(prompts: DataFrame, run: str = "run_id") -> DataFrame:
    """run_id and its prompts as an array, from rows (run_id, ord, name, context, system_prompt, allowed_classes); of several with one name the last counts."""
    last = prompts.groupBy(run, "name").agg(F.max(F.struct("ord", "context", "system_prompt", "allowed_classes")).alias("p"))
    listed = F.sort_array(F.collect_list(F.struct("p.ord", "name", "p.context", "p.system_prompt", "p.allowed_classes")))
    return last.groupBy(run).agg(listed.alias("prompts"))


def replies_of(predict: Predictor, batch: pd.DataFrame) -> tuple[list[str | None], list[str | None]]:
    """Replies and errors of the rows of a batch. A batch that fails, or has too few or too many replies, is halved until the failing rows stand alone; only these have no reply but an error."""
    try:
        replies = [None if r is None or r != r else str(r) for r in predict(batch)]
        error = None if len(replies) == len(batch) else f"{len(replies)} replies for {len(batch)} rows"
    except Exception as e:  # whatever a model or its service may raise
        error = f"{type(e).__name__}: {e}"
    if error is None:
        return replies, [None] * len(batch)
    if len(batch) == 1:
        return [None], [error]
    half = len(batch) // 2
    (a, x), (b, y) = replies_of(predict, batch.iloc[:half]), replies_of(predict, batch.iloc[half:])
    return a + b, x + y


def _answered(asked: DataFrame, make: Callable[[], Predictor]) -> DataFrame:
    """asked without __asked, with the replies and errors of its entries as arrays. The predictor is made once for each task, which sees whole batches; rows with a null in __asked don't go to it."""
    kept = [c for c in asked.columns if c != "__asked"]
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([*asked.select(*kept).schema.fields, T.StructField("__replies", texts), T.StructField("__errors", texts)])

    def work(batches):
        predict = make()
        for batch in batches:
            entries, of = batch.column("__asked"), pc.list_parent_indices(batch.column("__asked"))
            flat, at = entries.flatten(), of.to_numpy(zero_copy_only=False)
            rows = batch.select(["url", "product_name", "product_description"]).take(of).to_pandas()
            rows = rows.assign(**{c: flat.field(c).to_pandas() for c in ("prompt", "system_prompt", "user")})
            replies, errors = [None] * len(at), [None] * len(at)
            for places in rows.groupby(["prompt", "system_prompt"], sort=False, dropna=False).indices.values():
                for i, reply, error in zip(places, *replies_of(predict, rows.iloc[places].reset_index(drop=True)), strict=True):
                    replies[i], errors[i] = reply, error
            offsets = pa.array([0, *np.cumsum(np.bincount(at, minlength=len(batch))).tolist()], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.string())) for x in (replies, errors)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *lists], names=schema.names)

    return asked.mapInArrow(work, schema)


def classify(df: DataFrame, prompts: Sequence[Prompt] | DataFrame, predict: Predictor | None = None, default: int = DEFAULT_LABEL, make: Callable[[], Predictor] | None = None, errors: str | None = None) -> DataFrame:
    """df with classifications: the label of each prompt by name, for unflagged rows; an empty map for flagged ones.

    prompts: those of all rows, or a table with the prompts of each run_id of df (as run_prompts); of several with one
    name the last counts, the others are not asked. A run without prompts has no labels.

    predict gets batches of (url, product_name, product_description, prompt, system_prompt, user) with one prompt each
    and returns the replies' texts; make builds it where it runs, once for each task. It sees neither flagged rows nor
    such without name or description: one pass with a mask, since a split and union would run all that is above it
    twice. A row for which it fails has the default label; its error goes to the column `errors`, if that is named, a
    map from prompt to text. k failing rows of a batch of n take some 2 k log2(n) calls more.
    """
    base = df.drop("classifications")
    if isinstance(prompts, DataFrame):
        base = base.join(run_prompts(prompts).withColumnsRenamed({"run_id": "__run", "prompts": "__prompts"}), F.col("run_id") == F.col("__run"), "left").drop("__run")
        mine = F.coalesce("__prompts", F.array())
    else:
        last = {p.name: p for p in prompts}.values()
        mine = F.array(*[F.struct(F.lit(p.name).alias("name"), F.lit(p.context).alias("context"), F.lit(p.system_prompt).alias("system_prompt"), F.array(*map(F.lit, p.allowed_classes)).cast("array<int>").alias("allowed_classes")) for p in last])
    name, description = F.col("product_name"), F.col("product_description")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:int>>"))
    if not isinstance(prompts, DataFrame) and not prompts:
        out = base.withColumn("classifications", none)
        return out.withColumn(errors, none.cast("map<string,string>")) if errors else out
    one = lambda p: F.struct(p["name"].alias("prompt"), p["system_prompt"].alias("system_prompt"), rendered(p["context"], name, description).alias("user"))
    asked = base.withColumn("__asked", F.when(~F.col("filtered") & name.isNotNull() & description.isNotNull(), F.transform(mine, one)))
    answered = _answered(asked, make or (lambda: predict))
    labels = F.map_from_entries(F.zip_with(mine, F.coalesce("__replies", F.array().cast("array<string>")), lambda p, r: F.struct(p["name"].alias("key"), label(r, p["allowed_classes"], name, description, default).alias("value"))))
    out = answered.withColumn("classifications", F.when(F.col("filtered"), none).otherwise(labels))
    if errors:
        failed = F.zip_with(mine, F.coalesce("__errors", F.array().cast("array<string>")), lambda p, e: F.when(e.isNotNull(), F.struct(p["name"].alias("key"), e.alias("value"))))
        out = out.withColumn(errors, F.map_from_entries(F.filter(failed, lambda x: x.isNotNull())))
    return out.drop("__replies", "__errors", "__prompts")
