"""Column masking, row filters and the analyst's semantic perimeter, applied on read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas

CLEAR, MASKED, DENIED = "clear", "masked", "denied"


def masked_view(df: DataFrame, table: str, grants: Mapping[str, str]) -> DataFrame:
    """``df`` as a reader with ``grants`` (tag -> clear, masked or denied) sees it.

    Masked columns read as null of their own type. A denied tag among the columns is an
    error; a tag without a grant is denied.
    """
    shown = []
    for field in df.schema.fields:
        tag = schemas.COLUMN_TAGS.get((table, field.name))
        access = CLEAR if tag is None else grants.get(tag, DENIED)
        if access == DENIED:
            raise PermissionError(f"no access to {table}.{field.name} ({tag})")
        column = F.col(field.name)
        shown.append(F.lit(None).cast(field.dataType).alias(field.name) if access == MASKED else column)
    return df.select(*shown)


def posted_rows_only(transaction: DataFrame, granted: bool) -> DataFrame:
    """Row policy on transactions: grantees see posted rows, everybody else sees none."""
    return transaction.where(F.col("status") == "POSTED" if granted else F.lit(False))


def perimeter_view(df: DataFrame, view: str) -> DataFrame:
    """The allow-listed columns of a semantic view; identifier columns are left out."""
    return df.select(*schemas.PERIMETER[view])


def assignment_differences(declared: DataFrame, deployed: DataFrame) -> DataFrame:
    """(column, tag) pairs on one side only, with the side that has them."""
    only_declared = declared.exceptAll(deployed).withColumn("side", F.lit("declared"))
    only_deployed = deployed.exceptAll(declared).withColumn("side", F.lit("deployed"))
    return only_declared.unionByName(only_deployed)
