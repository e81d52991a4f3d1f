"""Tables as versions: each write is a folder of its own, and a manifest tells its schema and how that differs from the one before.

Nothing is ever dropped or rebuilt in place: a table whose columns drift goes on in a new version, the old ones stay readable
under their own schemas.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators import tables
from . import contracts
from .files import new_version

MANIFEST = "version long, path string, schema string, change string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, path, schema, change) of all versions of the table under ``root``; ``change`` is empty where the schema stayed."""
    rows = spark.createDataFrame([], MANIFEST)
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows


def _last(spark: SparkSession, root: str):
    return versions(spark, root).orderBy(F.desc("version")).first()


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one by default, with the schema that it was written with."""
    found = _last(spark, root) if version is None else versions(spark, root).where(F.col("version") == version).first()
    if found is None:
        raise FileNotFoundError(f"{root} has no version" + ("" if version is None else f" {version}"))
    return spark.read.schema(T.StructType.fromJson(json.loads(found.schema))).parquet(found.path)


def drift(old: T.StructType, new: T.StructType) -> str:
    """What differs, as added, lost and retyped columns; '' if nothing does. The order of columns does not count."""
    a, b = ({f.name: f.dataType for f in s} for s in (old, new))
    parts = {"added": sorted(b.keys() - a.keys()), "lost": sorted(a.keys() - b.keys()), "retyped": sorted(n for n in a.keys() & b.keys() if a[n] != b[n])}
    return "; ".join(f"{kind} {', '.join(names)}" for kind, names in parts.items() if names)


def put(df: DataFrame, root: str, contract: T.StructType) -> int:
    """Write ``df``, which must meet the contract, as the next version; returns its number."""
    spark = df.sparkSession
    last = _last(spark, root)
    change = "first" if last is None else drift(T.StructType.fromJson(json.loads(last.schema)), df.schema)
    number = 0 if last is None else last.version + 1
    path = new_version(contracts.guard(df, contract), root)
    spark.createDataFrame([(number, path, df.schema.json(), change)], MANIFEST).coalesce(1).write.json(f"{root}/manifest/version-{number}")
    return number


def fitted(df: DataFrame, contract: T.StructType) -> DataFrame:
    """``df`` with the contract's columns alone: those that it lacks are null, those of another type are cast where they can be."""
    have = {f.name: f.dataType for f in df.schema}
    column = lambda f: F.lit(None).cast(f.dataType) if f.name not in have else F.col(f.name) if have[f.name] == f.dataType else F.col(f.name).try_cast(f.dataType)
    return df.select(*[column(f).alias(f.name) for f in contract])


def upsert(new: DataFrame, root: str, keys: list[str], order: str, contract: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Insert or overwrite the rows of ``new``, which must meet the contract; the result is the next version, which is returned.

    A stored table of another schema is fitted to the contract for it.
    """
    spark = new.sparkSession
    new = contracts.guard(new, contract).select(*contract.names)
    last = _last(spark, root)
    old = spark.createDataFrame([], contract) if last is None else fitted(read(spark, root, last.version), contract)
    return read(spark, root, put(tables.upsert(old, new, keys, order, keep, contract), root, contract))
