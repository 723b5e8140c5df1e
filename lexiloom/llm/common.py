"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from ..plans.storage import ship

DOC = ("doc_id", "text")


def need(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; any others, whatever their names, play no part."""
    ship(df.sparkSession)  # before the first kernel is planned
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def whole(kind: DataType) -> bool:
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType))


def id_kind(df: DataFrame, column: str = "doc_id") -> str:
    """The type that ids have within the operators and in their results: long for integers of any width, else as given (URLs, UUIDs ...)."""
    kind = df.schema[column].dataType
    return "long" if whole(kind) else kind.simpleString()


def own_id(df: DataFrame, column: str = "doc_id") -> Column:
    """The id column in the type of `id_kind`."""
    return F.col(column).cast(id_kind(df, column)).alias(column)


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (see `id_kind`), text and more columns of the rows that have an id and a text."""
    return need(df, (*DOC, *more)).where("doc_id is not null and text is not null").select(own_id(df), "text", *more)


def text_key(column: str = "text") -> Column:
    """With doc_id this identifies a document, so that rows that share a doc_id but not a text stay apart."""
    return F.xxhash64(F.col(column))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name
