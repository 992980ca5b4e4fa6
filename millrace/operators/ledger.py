"""Usage ledgers: requests, tokens, money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ratio
from millrace.operators.ordered import GROUP_ROWS, numbered, running

# Price in dollars of a million tokens.
INPUT_PRICE = 15
OUTPUT_PRICE = 75
MILLION = 1_000_000


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column | None = None, output_price: Column | None = None) -> Column:
    """Dollars for a request; prices may come from a table column."""
    a = F.lit(INPUT_PRICE) if input_price is None else input_price
    b = F.lit(OUTPUT_PRICE) if output_price is None else output_price
    return input_tokens * a / MILLION + output_tokens * b / MILLION


def option_or(value: Column, default) -> Column:
    """The option, or the default where none is given. Zero is a given value."""
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def usage_totals(df: DataFrame, success: Column, tokens: Column, cost: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests, failures, tokens, cost and their averages. Failures use up nothing."""
    success = F.coalesce(success, F.lit(False))
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~success).alias("failed_requests"),
        F.coalesce(F.sum(F.when(success, tokens)), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(success, cost)), F.lit(0)).alias("total_cost"),
    )
    n = F.col("total_requests")
    return sums.withColumns(
        {
            "success_rate": ratio(n - F.col("failed_requests"), n),
            "average_tokens_per_request": ratio(F.col("total_tokens"), n),
            "average_cost_per_request": ratio(F.col("total_cost"), n),
        }
    )


def dataset_totals(df: DataFrame, label: str, tokens: Column, seconds: Column) -> DataFrame:
    """Counts, sums and means per label, and one row with a null label for the whole.

    An empty table gives no rows.
    """
    return (
        df.rollup(label)
        .agg(
            F.count(F.lit(1)).alias("total_examples"),
            F.avg(tokens).alias("average_tokens"),
            F.sum(tokens).alias("total_tokens"),
            F.avg(seconds).alias("average_time"),
            F.sum(seconds).alias("total_time"),
            F.grouping(label).alias("is_total"),
        )
        .where("total_examples > 0")
    )


def completion(counts: DataFrame, usage: DataFrame, target: int) -> DataFrame:
    """Target against actual, and what an accepted row cost. Both inputs have one row; the
    ledger comes in as a scalar subquery."""
    both = counts.withColumn("__u", usage.select(F.struct("total_requests", "total_cost")).scalar())
    return both.select(
        F.lit(target).cast("long").alias("target_size"),
        F.col("accepted").alias("actual_size"),
        (F.col("accepted") / F.lit(target)).alias("completion_rate"),
        F.col("__u.total_requests").alias("total_api_calls"),
        F.col("__u.total_cost").alias("total_cost"),
        ratio(F.col("__u.total_cost"), F.col("accepted")).alias("average_cost_per_example"),
    )


def paired(requests: DataFrame, responses: DataFrame, key: str, position: str, payload: list[str]) -> DataFrame:
    """Each request with its first response; a request without one is marked failed.

    The responses are folded to one per key before the join, so a crowded key costs a
    map-side aggregate and no skewed join.
    """
    firsts = responses.groupBy(key).agg(F.min_by(F.struct(*payload), F.col(position)).alias("response"))
    joined = requests.join(firsts, key, "left")
    error = F.when(F.col("response").isNull(), F.lit("no response"))
    return joined.withColumns({"success": F.col("response").isNotNull(), "error": error})


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int = 100, limit: int = GROUP_ROWS) -> DataFrame:
    """Number fixed-size batches (from 0) in order, per key."""
    rows = numbered(df, keys, order, "__n", limit)
    return rows.withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")


def id_batches(df: DataFrame, row_id: str, size: int = 100) -> DataFrame:
    """Batches by id range: no order to establish, so no shuffle."""
    return df.withColumn("batch", F.floor(F.col(row_id) / size))


def spend_alerts(
    df: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    cost: Column,
    budget: float = 500,
    alert_share: float = 0.8,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Total per key and the first row at which the running cost reached the alert line
    and the budget. `cost` should be a decimal, so that no sum depends on its order."""
    rows = running(df.withColumn("__c", cost), [key], [F.col(ts), F.col(row_id)], {"__spent": F.col("__c")}, limit=limit)
    spent = F.col("__spent")

    def first_at(line: float) -> Column:
        return F.min_by(F.when(spent >= line, F.col(row_id)), F.when(spent >= line, F.struct(ts, row_id)))

    return rows.groupBy(key).agg(
        F.sum("__c").alias("total_cost"),
        first_at(budget * alert_share).alias("alert_row"),
        first_at(budget).alias("limit_row"),
    )


def throughput(df: DataFrame, by: list, tokens: Column, seconds: Column) -> DataFrame:
    """Tokens per second of each group; null where no time passed."""
    sums = df.groupBy(*by).agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"))
    return sums.withColumn("tokens_per_second", F.col("tokens") / F.nullif(F.col("seconds"), F.lit(0)))
