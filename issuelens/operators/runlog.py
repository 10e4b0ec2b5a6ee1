"""Run-log analytics (T1-T4) over a log of timed stages or queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import elapsed_seconds
from issuelens.operators.ordering import with_key_running_sum


def stage_share(log: DataFrame, run_col: str, stage_col: str, elapsed_col: str) -> DataFrame:
    """Each stage's share of its run (percent) and a bar of one ``#`` per full 5 %."""
    st = log.groupBy(run_col, stage_col).agg(F.sum(elapsed_col).alias("elapsed"))
    total = F.sum("elapsed").over(Window.partitionBy(run_col))
    pct = F.when(total > 0, F.col("elapsed") / total * 100.0).otherwise(F.lit(0.0))
    return (st.withColumn("_pct", pct)
            .select(run_col, stage_col, F.round("elapsed", 6).alias("elapsed"),
                    F.round("_pct", 6).alias("pct"),
                    F.repeat(F.lit("#"), F.floor(F.col("_pct") / 5).cast("int")).alias("bar")))


def rolling_eta(log: DataFrame, key_col: str, order_cols: list[str], duration_col: str,
                in_flight: int = 1, window: int = C.ETA_WINDOW,
                default: float = C.DEFAULT_ETA_SECONDS) -> DataFrame:
    """Expected wait = in-flight x mean of the last ``window`` finished durations.

    At each log row the history is the ``window`` rows before it for the
    same key; no history gives ``default``.  Durations are taken in whole
    hundredths and the mean is rounded half-up with integer arithmetic
    (6 decimals for the mean, 1 for the wait), so every engine produces the
    same digits.
    """
    # trailing sum over the previous `window` rows = C(r-1) - C(r-1-window),
    # with C the running sum inside the key; both come from skew-safe
    # running sums and an equi-join on (key, rank), never from a window
    # over a whole key
    cents = F.round(F.col(duration_col) * 100).cast("bigint")
    base = log.withColumn("_c", cents)
    run = with_key_running_sum(base, key_col, order_cols, "_c", "_r", "_cum")
    back = run.select(F.col(key_col).alias("_k2"), (F.col("_r") + window).alias("_r2"),
                      F.col("_cum").alias("_cum_back"))
    j = run.join(back, (run[key_col] == back["_k2"]) & (run["_r"] - 1 == back["_r2"]), "left")
    out = (j.withColumn("_s", F.col("_cum") - F.coalesce(F.col("_c"), F.lit(0)) - F.coalesce(F.col("_cum_back"), F.lit(0)))
           .withColumn("_n", F.least(F.col("_r") - 1, F.lit(window))))
    k = int(in_flight)
    mean = F.expr("(2 * _s * 10000 + _n) div (2 * _n)") / F.lit(1e6)
    eta = F.expr(f"(2 * {k} * _s + 10 * _n) div (20 * _n)") / F.lit(10.0)
    has = F.col("_n") > 0
    return out.select(*log.columns,
                      F.when(has, mean).otherwise(F.lit(float(default))).alias("mean_duration"),
                      F.when(has, eta).otherwise(F.lit(round(k * default, 1))).alias("eta"))


def throughput(log: DataFrame, group_col: str, ts_col: str) -> DataFrame:
    """Items per second of elapsed time (0 when the elapsed time is 0)."""
    g = log.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("items"),
        elapsed_seconds(F.max(ts_col), F.min(ts_col)).alias("elapsed"))
    return g.select(group_col, "items", F.round("elapsed", 6).alias("elapsed"),
                    F.round(F.when(F.col("elapsed") > 0, F.col("items") / F.col("elapsed"))
                            .otherwise(F.lit(0.0)), 6).alias("per_second"))


def query_time(log: DataFrame, query_col: str, stage_col: str, elapsed_col: str,
               stages: dict[str, str]) -> DataFrame:
    """T4: per query, the time of extraction, retrieval, generation and total.

    ``stages`` maps the three stage names to values of ``stage_col``.  The
    extraction time is NULL (row omitted in the text report) when it is 0.
    """
    def part(name: str):
        return F.coalesce(F.sum(F.when(F.col(stage_col) == stages[name], F.col(elapsed_col))), F.lit(0.0))

    g = log.groupBy(query_col).agg(part("extraction").alias("t_filter"),
                                   part("retrieval").alias("t_retrieve"),
                                   part("generation").alias("t_generate"))
    return g.select(query_col,
                    F.round(F.when(F.col("t_filter") > 0, F.col("t_filter")), 6).alias("t_filter"),
                    F.round("t_retrieve", 6).alias("t_retrieve"),
                    F.round("t_generate", 6).alias("t_generate"),
                    F.round(F.col("t_filter") + F.col("t_retrieve") + F.col("t_generate"), 6).alias("total"))


# ---------------------------------------------------------------------------
# Numbers of the job's runs (A14, D8, M14): observed in the writes, users as mergeable sketches
# ---------------------------------------------------------------------------

#: log2 of the sketch's registers: a standard error of 1.04 / sqrt(2 ** 12), or 1.6 %.
SKETCH_BITS = 12


def observe_issues(issues: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts issues, and those with journals, as the DataFrame is written."""
    seen = Observation(name)
    noted = F.coalesce(F.size("journals"), F.lit(0)) > 0
    return issues.observe(seen, F.count(F.lit(1)).alias("issues"), F.count_if(noted).alias("with_journals")), seen


def observe_windows(windows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts the issues, chunks and windows of embedded chunk windows (D8) as they are written."""
    seen = Observation(name)
    first = F.col("part") == 0
    return windows.observe(seen, F.count_if(first & F.col("is_description")).alias("chunked_issues"),
                           F.count_if(first).alias("chunks"), F.count(F.lit(1)).alias("windows")), seen


def user_sketch(refs: DataFrame) -> DataFrame:
    """One row: the users of reference rows (``anonymize.user_refs``) as a sketch that merges with others."""
    return refs.agg(F.hll_sketch_agg("user.id", F.lit(SKETCH_BITS)).alias("users"))


def users_of_runs(runs: DataFrame) -> DataFrame:
    """Distinct users over all runs, from their sketches: no issue is read again."""
    return runs.agg(F.count(F.lit(1)).alias("runs"),
                    F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("users"))
