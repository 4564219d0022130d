"""Costs, admission and reports of a budget ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: US dollars for a million tokens in and out.
PRICES = {
    "gpt-4o-mini": (0.09, 0.36),
    "glm-4.5-air": (0.60, 2.40),
    "glm-4.6": (1.20, 4.80),
    "deepseek-v3.2": (1.20, 1.80),
    "kimi-k2": (0.60, 2.40),
    "deepseek-v3.1": (2.40, 7.20),
    "gemini-2.5-pro": (1.00, 8.00),
    "gemini-2.5-flash": (0.24, 2.002),
    "gemini-3-flash-preview-nothinking": (0.24, 2.002),
    "qwen3-vl-plus": (0.60, 6.00),
    "qwen-vl-max": (0.96, 2.40),
}
#: Prices of unknown models, of transcription, tokens of an image and of a minute, and the exchange rate.
DEFAULT_PRICE = (1.0, 3.0)
ASR_PRICES = {"whisper-1": 18.0, "gpt-4o-transcribe": 1.5, "gpt-4o-mini-transcribe": 0.75}
IMAGE_TOKENS, ASR_TOKENS_PER_MINUTE, CNY_PER_USD = 800, 150, 7.2


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, p_in double, p_out double")


def chat_cost(calls: DataFrame, prices: DataFrame, n_in: str, n_out: str, name: str = "cost_usd", multiplier: Column | None = None) -> DataFrame:
    """The calls with their cost; an unknown model has the default prices. The price list is
    broadcast if the planner finds it small enough."""
    joined = calls.join(prices, "model", "left")
    p_in, p_out = F.coalesce("p_in", F.lit(DEFAULT_PRICE[0])), F.coalesce("p_out", F.lit(DEFAULT_PRICE[1]))
    cost = (F.col(n_in) * p_in + F.col(n_out) * p_out) * (multiplier if multiplier is not None else F.lit(1.0)) / 1e6
    return joined.withColumn(name, cost).drop("p_in", "p_out")


def transcription_cost(model: Column, minutes: Column) -> Column:
    price = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ASR_PRICES.items() for x in kv)), model), F.lit(1.5))
    return price * ASR_TOKENS_PER_MINUTE * minutes / 1e6


def message_tokens(text: Column, images: Column, chars_per_token: float = 4.0) -> Column:
    """Estimate of a message's tokens: characters over a ratio, and a fixed count for each image."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / chars_per_token).cast("long") + images * IMAGE_TOKENS


def to_usd(cny: Column) -> Column:
    return cny / CNY_PER_USD


def admit_until_reject(calls: DataFrame, limits: DataFrame, total_limit: float, run: str = "run_id", order: str = "call_pos") -> DataFrame:
    """The calls with ``verdict``: admitted, calls, stage_money, total_money or stopped.

    A run's calls are admitted in order until the first that is rejected: for a stage's number
    of calls, its money, or the total, tested in this order on the estimate; what is booked is
    the actual cost. All that follow are stopped. With that rule each sum before a call is a
    plain running sum, so two window passes are exact. Unknown stages have limits of zero.
    """
    rows = calls.join(limits, "stage", "left").fillna({"money_limit": 0.0, "call_limit": 0})
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    s = Window.partitionBy(run, "stage").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_spent": F.coalesce(F.sum("actual").over(w), F.lit(0.0)), "_stage": F.coalesce(F.sum("actual").over(s), F.lit(0.0)), "_n": F.count(F.lit(1)).over(s)})
    why = (
        F.when(F.col("_n") >= F.col("call_limit"), "calls")
        .when(F.col("_stage") + F.col("estimate") > F.col("money_limit"), "stage_money")
        .when(F.col("_spent") + F.col("estimate") > total_limit, "total_money")
    )
    rows = rows.withColumn("_why", why)
    stopped = F.coalesce(F.max(F.col("_why").isNotNull()).over(w), F.lit(False))
    return rows.withColumn("verdict", F.when(stopped, "stopped").otherwise(F.coalesce("_why", F.lit("admitted")))).drop("_spent", "_stage", "_n", "_why", "money_limit", "call_limit")


def admit_each(calls: DataFrame, limits: DataFrame, total_limit: float, run: str = "run_id", order: str = "call_pos") -> DataFrame:
    """Like :func:`admit_until_reject`, but a rejected call adds nothing and later ones go on.

    What is booked depends on each verdict before, so a run's calls are folded in order.
    """
    rows = calls.join(limits, "stage", "left").fillna({"money_limit": 0.0, "call_limit": 0})
    item = F.struct(order, "stage", "estimate", "actual", "money_limit", "call_limit")
    keyed = rows.groupBy(run).agg(F.array_sort(F.collect_list(item)).alias("calls"))
    begin = F.struct(
        F.lit(0.0).alias("spent"), F.create_map().cast("map<string,double>").alias("money"), F.create_map().cast("map<string,int>").alias("n"),
        F.array().cast("array<string>").alias("verdicts"),
    )

    def step(a: Column, c: Column) -> Column:
        money = F.coalesce(F.try_element_at(a["money"], c["stage"]), F.lit(0.0))
        n = F.coalesce(F.try_element_at(a["n"], c["stage"]), F.lit(0))
        why = F.when(n >= c["call_limit"], "calls").when(money + c["estimate"] > c["money_limit"], "stage_money").when(a["spent"] + c["estimate"] > total_limit, "total_money").otherwise("admitted")
        ok = why == "admitted"

        def put(m: Column, v: Column) -> Column:
            return F.map_concat(F.map_filter(m, lambda k, _: k != c["stage"]), F.create_map(c["stage"], v))

        return F.struct(
            F.when(ok, a["spent"] + c["actual"]).otherwise(a["spent"]).alias("spent"),
            F.when(ok, put(a["money"], money + c["actual"])).otherwise(a["money"]).alias("money"),
            F.when(ok, put(a["n"], n + 1)).otherwise(a["n"]).alias("n"),
            F.concat(a["verdicts"], F.array(why)).alias("verdicts"),
        )

    folded = keyed.withColumn("_v", F.aggregate("calls", begin, step)["verdicts"])
    return folded.select(run, F.explode(F.arrays_zip("calls", F.col("_v").alias("verdict"))).alias("x")).select(run, *(F.col(f"x.calls.{c}").alias(c) for c in (order, "stage", "estimate", "actual")), F.col("x.verdict").alias("verdict"))


def report(calls: DataFrame, run: str = "run_id", cost: str = "actual") -> DataFrame:
    """Spent and calls by stage, with a total for each run (stage ``(total)``)."""
    return calls.rollup(run, "stage").agg(F.sum(cost).alias("spent"), F.count(F.lit(1)).alias("calls")).where(F.col(run).isNotNull()).withColumn("stage", F.coalesce("stage", F.lit("(total)")))
