"""The banking graph as node and edge tables, and questions over it as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.session import checkpointed


def owns(account: DataFrame) -> DataFrame:
    """Customer -OWNS-> Account edges."""
    return account.select(F.col("customer_id").alias("src"), F.col("account_id").alias("dst"), F.lit("OWNS").alias("label"))


def on_account(transaction: DataFrame, *properties: str) -> DataFrame:
    """Transaction -ON_ACCOUNT-> Account edges, with the named transaction properties."""
    return transaction.select(
        F.col("transaction_id").alias("src"), F.col("account_id").alias("dst"), F.lit("ON_ACCOUNT").alias("label"), *properties
    )


def requested(loan_request: DataFrame) -> DataFrame:
    """Account -REQUESTED-> Loan edges."""
    return loan_request.select(
        F.col("account_id").alias("src"), F.col("loan_id").alias("dst"), F.lit("REQUESTED").alias("label")
    )


def edge_counts(account: DataFrame, transaction: DataFrame, loan_request: DataFrame) -> DataFrame:
    """Number of edges and of distinct targets per label."""
    edges = owns(account).unionByName(on_account(transaction)).unionByName(requested(loan_request))
    per_target = edges.groupBy("label", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per_target.groupBy("label").agg(
        F.sum("n").alias("edges"), F.count(F.lit(1)).alias("targets")
    )


def deposits_by_owner_segment(customer: DataFrame, account: DataFrame, transaction: DataFrame) -> DataFrame:
    """(Customer)-OWNS->(Account)<-ON_ACCOUNT-(deposit), counted and summed by segment.

    The deposit edges are summed per account, then per owner, before the pattern is matched.
    """
    deposits = (
        on_account(transaction, "txn_type", "amount")
        .where(F.col("txn_type") == "DEPOSIT")
        .groupBy("dst")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_amount"))
    )
    return (
        deposits.join(owns(account).select("src", "dst"), "dst")
        .groupBy("src")
        .agg(F.sum("_n").alias("_n"), F.sum("_amount").alias("_amount"))
        .join(customer.select(F.col("customer_id").alias("src"), "segment"), "src")
        .groupBy("segment")
        .agg(F.sum("_n").alias("txns"), F.sum("_amount").alias("total"))
    )


def transfers(transaction: DataFrame) -> DataFrame:
    """Distinct Account -> Account edges of posted transfers, with their number and amount."""
    return (
        transaction.where(
            (F.col("txn_type") == "TRANSFER")
            & (F.col("status") == "POSTED")
            & (F.coalesce("counterparty_account", F.lit("")) != "")
        )
        .groupBy(F.col("account_id").alias("src"), F.col("counterparty_account").alias("dst"))
        .agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount").alias("amount"))
    )


def walk_counts(edges: DataFrame, hops: int) -> DataFrame:
    """Per node, the number of chains of 1 to ``hops`` edges starting there.

    Counts travel back along the edges, one join and sum per hop; no chain is ever listed,
    so the work stays linear in the edges even around a hub. Each hop is checkpointed.
    """
    pairs = checkpointed(edges.select("src", "dst"))
    out = checkpointed(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("walks_1")))
    for hop in range(2, hops + 1):
        onward = out.select(F.col("src").alias("dst"), F.col(f"walks_{hop - 1}").alias("_n"))
        longer = pairs.join(onward, "dst").groupBy("src").agg(F.sum("_n").alias(f"walks_{hop}"))
        out = checkpointed(out.join(longer, "src", "left"))
    zeros = [F.coalesce(f"walks_{h}", F.lit(0)).alias(f"walks_{h}") for h in range(1, hops + 1)]
    return out.select(F.col("src").alias("node"), *zeros)


def hops_from(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops): nodes reachable from any seed (column ``node``) and their least distance.

    Each hop follows the edges of the newest nodes only and is checkpointed.
    """
    reached = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = reached.select("node")
    pairs = checkpointed(edges.select("src", "dst"))
    for hop in range(1, max_hops + 1):
        onward = (
            pairs.join(frontier.select(F.col("node").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        frontier = checkpointed(onward.join(reached, "node", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def relationships(spark: SparkSession) -> DataFrame:
    """The join model as a table."""
    return spark.createDataFrame(
        list(schemas.RELATIONSHIPS),
        "from_table string, from_column string, to_table string, to_column string, "
        "relationship string, cardinality string",
    )


def join_path(from_table: str, to_table: str) -> list[tuple[str, str, str, str]]:
    """Hops (from_table, from_column, to_table, to_column) that lead from one view to another."""
    frontier: list[tuple[str, list]] = [(from_table, [])]
    seen = {from_table}
    while frontier:
        at, path = frontier.pop(0)
        if at == to_table:
            return path
        for src, src_col, dst, dst_col, _, _ in schemas.RELATIONSHIPS:
            if src == at and dst not in seen:
                seen.add(dst)
                frontier.append((dst, [*path, (src, src_col, dst, dst_col)]))
    raise ValueError(f"no join path from {from_table} to {to_table}")


def cardinality_check(tables: dict[str, DataFrame]) -> DataFrame:
    """Per relationship of the join model: repeated keys on the sides that must be unique, and orphans.

    Keys are counted once per side before they meet, so hub keys are single rows.
    """
    results = []
    for src, src_col, dst, dst_col, relationship, cardinality in schemas.RELATIONSHIPS:
        left = tables[src].groupBy(F.col(src_col).alias("key")).agg(F.count(F.lit(1)).alias("_from"))
        right = tables[dst].groupBy(F.col(dst_col).alias("key")).agg(F.count(F.lit(1)).alias("_to"))
        must_be_single = F.lit(cardinality == "one-to-one")
        results.append(
            left.join(right, "key", "full_outer").agg(
                F.lit(relationship).alias("relationship"),
                F.count_if(F.col("_to") > 1).alias("repeated_targets"),
                F.count_if(must_be_single & (F.col("_from") > 1)).alias("repeated_sources"),
                F.coalesce(F.sum(F.when(F.col("_to").isNull(), F.col("_from"))), F.lit(0)).alias("orphans"),
            )
        )
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumn(
        "holds",
        (F.col("repeated_targets") == 0) & (F.col("repeated_sources") == 0) & (F.col("orphans") == 0),
    )
