"""What several operators share: settled tables, held-out rows, text handling inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a batch that a task works on at once, so that arrays stay small beside the batch itself.
SLICE = 256


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base`` or a variant of it that no column of ``df`` has."""
    taken = {name.lower() for name in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def pick_rows(docs: DataFrame, chosen: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs``, all columns, that ``chosen (doc_id, h, n)`` names, one for each of its rows.

    ``digest`` is the hash of a row that ``h`` holds; ``n`` is the number of rows
    with that doc_id and hash. Only rows that repeat both are compared further.
    """
    h, doc_id = free_name(docs, "_h"), free_name(docs, "_id")
    keyed = docs.withColumn(h, digest)
    named = chosen.select(F.col("doc_id").alias(doc_id), F.col("h").alias(f"{h}_"), "n")
    on = keyed["doc_id"].eqNullSafe(named[doc_id]) & (keyed[h] == named[f"{h}_"])
    out = keyed.join(named.where("n = 1"), on, "left_semi")
    repeated = named.where("n > 1")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, on, "left_semi").dropDuplicates(["doc_id", h]))
    return out.drop(h)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model may learn from; a null id is in no fold."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 4 == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` is fast, but also changes other letters; it is used where the rest
    of the text has nothing it would change.
    """
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: where each text's words begin and the last ones end, each word's place among the distinct ones, and those.

    A null text has one word, which is empty, as others may be.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = lists.offsets.to_numpy()
    coded = lists.values[ends[0]:ends[-1]].dictionary_encode()
    return ends - ends[0], coded.indices.to_numpy(), coded.dictionary


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], list], ddl: str, keep: bool = False, rows: int = SLICE) -> DataFrame:
    """``mapInArrow`` in slices of ``rows``: ``work`` gets a record batch and returns the columns named in ``ddl``.

    With ``keep`` the input columns stay in front (``work`` must then return one value for each row).
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [pa.array(values, kind) for values, kind in zip(work(part), schema.types)]
                if keep:
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *schema.names])
                else:
                    yield pa.RecordBatch.from_arrays(made, schema=schema)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " if keep else ""
    return df.mapInArrow(run, out + ddl)
