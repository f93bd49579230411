"""Sign rules of transaction amounts.

The views disagree on TRANSFER on purpose: balances treat it as an outflow, the
summary and the customer rollup leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def balance_delta(txn_type: Column, amount: Column) -> Column:
    """Signed amount for balances: deposits in; withdrawals, fees and transfers out."""
    return (
        F.when(txn_type == "DEPOSIT", amount)
        .when(txn_type.isin("WITHDRAWAL", "FEE", "TRANSFER"), -amount)
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    )


def net_delta(txn_type: Column, amount: Column) -> Column:
    """Signed amount for net figures: deposits in; withdrawals and fees out; transfers ignored."""
    return (
        F.when(txn_type == "DEPOSIT", amount)
        .when(txn_type.isin("WITHDRAWAL", "FEE"), -amount)
        .otherwise(F.lit(0).cast("decimal(18,2)"))
    )
