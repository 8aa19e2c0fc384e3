"""Per-series and cross-sectional statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import pair_sums

YEAR = 252


def ewma_volatility(returns: DataFrame, span: int = 20, per_year: int = YEAR) -> DataFrame:
    """returns(asset, pos, ret) -> asset, ewma_vol: weights (1 - alpha) ** age, normalised; null below two returns."""
    keep = 1 - 2 / (span + 1)
    r = returns.where("ret is not null").withColumn("w", F.pow(F.lit(keep), F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("pos"))) - 1))
    m = r.groupBy("asset").agg((F.sum(F.col("w") * F.col("ret")) / F.sum("w")).alias("mean"))
    spread = r.join(m, "asset").groupBy("asset").agg(F.count("*").alias("n"), (F.sum(F.col("w") * (F.col("ret") - F.col("mean")) ** 2) / F.sum("w")).alias("var"))
    return spread.select("asset", F.when(F.col("n") >= 2, F.sqrt("var") * math.sqrt(per_year)).alias("ewma_vol"))


def ewma_by_day(returns: DataFrame, span: int = 20, per_year: int = YEAR) -> DataFrame:
    """returns(asset, pos, ret) with ewma_vol up to each row; null below two returns. Weights below a double's last place, (1 - alpha) ** age
    < 2 ** -53, can't move a sum, so a row looks back over those above it: 368 rows at a span of 20."""
    keep = 1 - 2 / (span + 1)
    memory = math.ceil(-53 * math.log(2) / math.log(keep))
    number = F.count("ret").over(Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))  # rows without return have that of the last one with
    seen = F.collect_list("ret").over(Window.partitionBy("asset").orderBy("_k").rangeBetween(-memory, 0))  # without nulls

    def step(s: Column, x: Column) -> Column:  # West's update: older weights fade, the newest is 1
        w = s["w"] * keep + 1
        m = s["m"] + (x - s["m"]) / w
        return F.struct(w.alias("w"), m.alias("m"), (s["s"] * keep + (x - s["m"]) * (x - m)).alias("s"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "wms"])
    spread = F.aggregate("_seen", zero, step, lambda s: F.try_divide(s["s"], s["w"]))
    r = returns.withColumn("_k", number).withColumn("_seen", seen)
    return r.withColumn("ewma_vol", F.when(F.size("_seen") >= 2, F.sqrt(spread) * math.sqrt(per_year))).drop("_k", "_seen")


def yang_zhang(bars: DataFrame, per_year: int = YEAR) -> DataFrame:
    """bars(asset, pos, open, high, low, close), all positive -> asset, yang_zhang; null below three bars."""
    w = Window.partitionBy("asset").orderBy("pos")
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    x = bars.withColumn("night", F.log(o / F.lag(c).over(w))).withColumn("day", F.log(c / o)).withColumn("rs", F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o))
    g = x.where("night is not null").groupBy("asset").agg(F.count("*").alias("m"), F.var_samp("night").alias("vn"), F.var_samp("day").alias("vd"), F.avg("rs").alias("rs"))
    k = 0.34 / (1.34 + (F.col("m") + 1) / (F.col("m") - 1))
    return g.where("m >= 2").select("asset", F.sqrt((F.col("vn") + k * F.col("vd") + (1 - k) * F.col("rs")) * per_year).alias("yang_zhang"))


def winsorized(rows: DataFrame, key: str, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to interpolated quantiles of their group; nulls stay."""
    q = rows.groupBy(key).agg(F.percentile(x, F.lit(low)).alias("_lo"), F.percentile(x, F.lit(high)).alias("_hi"))
    return rows.join(q, key).withColumn("clipped", F.when(F.col(x).isNotNull(), F.least(F.greatest(x, "_lo"), F.col("_hi")))).drop("_lo", "_hi")


def zscores(rows: DataFrame, key: str, x: str) -> DataFrame:
    s = rows.groupBy(key).agg(F.avg(x).alias("_m"), F.nullif(F.stddev_samp(x), F.lit(0.0)).alias("_s"))
    return rows.join(s, key).withColumn("z", (F.col(x) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def neutralized(rows: DataFrame, x: str = "x") -> DataFrame:
    """rows(d, grp, cap, x) with neutral: x less its group's mean, then less a line on ln(cap) over the date's usable rows, if three or more."""
    usable = F.col("cap") > 0
    dm = rows.withColumn("dm", F.col(x) - F.avg(x).over(Window.partitionBy("d", "grp"))).withColumn("lc", F.when(usable & F.col(x).isNotNull(), F.log("cap")))
    line = dm.where("lc is not null").groupBy("d").agg(F.count("*").alias("n"), F.regr_slope("dm", "lc").alias("b"), F.regr_intercept("dm", "lc").alias("a"))
    out = dm.join(line, "d", "left")
    return out.withColumn("neutral", F.when((F.col("n") >= 3) & F.col("lc").isNotNull(), F.col("dm") - F.coalesce(F.col("a") + F.col("b") * F.col("lc"), F.lit(0.0))).otherwise(F.col("dm"))).drop("dm", "lc", "n", "a", "b")


def trend(prices: DataFrame, short: int = 20, long: int = 60, threshold: float = 0.02) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("pos")
    fast, slow = F.avg("close").over(w.rowsBetween(1 - short, 0)), F.avg("close").over(w.rowsBetween(1 - long, 0))
    gap = fast / slow - 1
    full = F.count("close").over(w.rowsBetween(1 - long, 0)) == long
    return prices.where("close is not null").withColumn("trend", F.when(full & (gap > threshold), "UP").when(full & (gap < -threshold), "DOWN").otherwise("RANGING"))


def volatility_state(vol: Column) -> Column:
    return F.when(vol >= 0.4, "EXTREME").when(vol >= 0.25, "HIGH").when(vol <= 0.12, "LOW").otherwise("NORMAL")


def liquidity(bars: DataFrame, short: int = 5, long: int = 60, stress: float = 0.6) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("pos")
    fast, slow = F.avg("volume").over(w.rowsBetween(1 - short, 0)), F.avg("volume").over(w.rowsBetween(1 - long, 0))
    full = F.count("volume").over(w.rowsBetween(1 - long, 0)) == long
    return bars.where("volume is not null").withColumn("liquidity", F.when(full & (slow > 0) & (fast / F.nullif(slow, F.lit(0.0)) < stress), "STRESSED").otherwise("NORMAL"))


def hysteresis(states: DataFrame, key: str, order: str, state: str, need: int = 5) -> DataFrame:
    """states with effective: a state takes over once it was seen `need` times running; the first holds until then."""
    w, ws = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, state).orderBy(order)
    runs = states.withColumn("_island", F.row_number().over(w) - F.row_number().over(ws))
    runs = runs.withColumn("_run", F.row_number().over(Window.partitionBy(key, state, "_island").orderBy(order)))
    taken = F.last(F.when(F.col("_run") >= need, F.col(state)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("effective", F.coalesce(taken, F.first(state).over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_island", "_run")


def half_life(series: DataFrame) -> DataFrame:
    """series(asset, pos, close) -> asset, half_life by the slope of changes on the level before; null below 30 rows, outside (-1, 0), or above half the rows."""
    w = Window.partitionBy("asset").orderBy("pos")
    s = series.where("close is not null").withColumn("before", F.lag("close").over(w)).withColumn("dy", F.col("close") - F.col("before"))
    g = s.groupBy("asset").agg(F.count("*").alias("n"), F.regr_slope("dy", "before").alias("b"))
    h = -math.log(2) / F.log(1 + F.when((F.col("b") < 0) & (F.col("b") > -1), F.col("b")))
    return g.select("asset", F.when((F.col("n") >= 30) & (h <= F.col("n") / 2), h).alias("half_life"))


def window_from_half_life(h: Column, multiplier: float = 2.0, low: int = 5, high: int = 252) -> Column:
    return F.when((h > 0) & (F.abs(h) != float("inf")), F.least(F.lit(high), F.greatest(F.lit(low), F.bround(h * multiplier).cast("int"))))


def correlation(a: str, b: str) -> Column:
    """Null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pair_correlations(panel: DataFrame) -> DataFrame:
    """panel(asset, pos, x) -> a, b, corr for a < b on shared positions, from the sums of gram.pair_sums(); null where a side doesn't vary.

    Each series is shifted by its first value, so that sums of squares don't drown what varies.
    """
    shifted = panel.withColumn("x", F.col("x") - F.first("x", ignorenulls=True).over(Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    sums = pair_sums(shifted).where("a < b")
    n = F.col("n")
    var = lambda s, ss: F.col(ss) / n - (F.col(s) / n) ** 2
    varies = (var("sum_a", "sum_aa") > NO_SPREAD * F.col("sum_aa") / n) & (var("sum_b", "sum_bb") > NO_SPREAD * F.col("sum_bb") / n)
    cov = F.col("sum_ab") / n - (F.col("sum_a") / n) * (F.col("sum_b") / n)
    return sums.select("a", "b", F.when(varies, cov / F.sqrt(var("sum_a", "sum_aa") * var("sum_b", "sum_bb"))).alias("corr"))


#: Share of a mean square up to which a variance is what rounding left.
NO_SPREAD = 1e-14


#: MacKinnon's (1994) coefficients for the test with a constant, and the critical values of the level-stationarity test.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
LEVEL_STATS, LEVEL_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def _unit_root_p(y: np.ndarray) -> float:
    """p of a unit root with a constant, lags by the least AIC over one common sample."""
    dy, n = np.diff(y), len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    fit = lambda k, start: _regress(dy[start:], np.column_stack([y[start:-1], *[dy[start - j : len(dy) - j] for j in range(1, k + 1)], np.ones(len(dy) - start)]))
    lags = min(range(most + 1), key=lambda k: fit(k, most)[2])
    stat = fit(lags, lags)
    tau = stat[0] / stat[1]
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    powers = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return 0.5 * math.erfc(-sum(c * tau**i for i, c in enumerate(powers)) / math.sqrt(2))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """The first coefficient, its standard error, and AIC."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    rss, n, k = float(e @ e), *x.shape
    se = math.sqrt(max(rss / (n - k) * np.linalg.pinv(x.T @ x)[0, 0], 1e-300))
    return float(b[0]), se, n * math.log(max(rss / n, 1e-300)) + 2 * k


def _level_p(y: np.ndarray) -> float:
    """p of level stationarity (Kwiatkowski et al., 1992), with Hobijn's automatic lags; clamped to 0.01 and 0.1."""
    e, n = y - y.mean(), len(y)
    lags = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, lags + 1):
        c = float(e[i:] @ e[:-i]) / n
        s0, s1 = s0 + 2 * c, s1 + 2 * i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2 * n) ** (1 / 3)), n - 1) if s0 else 0
    s = float(e @ e) / n + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / s if s > 0 else 0.0
    return float(np.interp(stat, LEVEL_STATS, LEVEL_P))


def stationarity(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """series(asset, pos, close) -> asset, n, unit_root_p, level_p, verdict. Each series is tested in one task, so a series must fit one."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos")["close"].dropna().to_numpy(float)
        if len(y) < 20 or y.std() == 0:
            return pd.DataFrame([(pdf["asset"].iloc[0], len(y), None, None, "INCONCLUSIVE")], columns=["asset", "n", "unit_root_p", "level_p", "verdict"])
        a, k = _unit_root_p(y), _level_p(y)
        verdict = {(True, True): "STATIONARY", (False, False): "NON_STATIONARY"}.get((a < alpha, k > alpha), "INCONCLUSIVE")
        return pd.DataFrame([(pdf["asset"].iloc[0], len(y), a, k, verdict)], columns=["asset", "n", "unit_root_p", "level_p", "verdict"])

    return series.select("asset", "pos", "close").groupBy("asset").applyInPandas(test, "asset string, n long, unit_root_p double, level_p double, verdict string")


def gated_half_life(series: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """half_life() of the series whose unit root tests(asset, unit_root_p) reject; null for the others."""
    rejected = tests.where(F.col("unit_root_p") < alpha).select("asset")
    return series.select("asset").distinct().join(half_life(series).join(rejected, "asset", "left_semi"), "asset", "left")


class Registry:
    """Features by name and version: functions (rows, asof, **params) -> rows, with required columns and a range of valid values."""

    def __init__(self) -> None:
        self._specs: dict[tuple[str, str], dict] = {}

    def register(self, name: str, version: str, f, requires: tuple = (), low: float = -math.inf, high: float = math.inf, column: str = "value", **params) -> None:
        if (name, version) in self._specs:
            raise ValueError(f"{name}@{version} is registered")
        self._specs[name, version] = {"f": f, "requires": requires, "low": low, "high": high, "column": column, "params": params}

    def versions_of(self, name: str) -> list[str]:
        return sorted(v for n, v in self._specs if n == name)

    def names(self) -> list[str]:
        return sorted({n for n, _ in self._specs})

    def compute(self, name: str, version: str, rows: DataFrame, asof, ingest: str = "ingest_date", **params) -> DataFrame:
        """The feature over the rows known by asof; `valid` says whether each value that isn't null is in range."""
        spec = self._specs[name, version]
        if missing := [c for c in spec["requires"] if c not in rows.columns]:
            raise ValueError(f"{name} needs {missing}")
        seen = rows.where(F.col(ingest) <= F.lit(asof)) if ingest in rows.columns else rows
        x = F.col(spec["column"])
        return spec["f"](seen, asof, **{**spec["params"], **params}).withColumn("valid", x.isNull() | F.isnan(x) | x.between(spec["low"], spec["high"]))

