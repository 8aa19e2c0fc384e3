"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, staged, table, whole, words_of

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PASSES = 20
TOLERANCE = 1e-4
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns `keep` of docs, all if None) and `_f`, a struct of FEATURES (long each), all of whole texts; a
    null text has no words. Nothing of docs stands beside the columns used here, so names can't clash.

    Repeats are found by sorting the 64-bit hashes of a text's 3-word windows with their places: of equal neighbours, both
    windows count, and the words of all such windows are counted once.
    """
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), whole(F.col(f"`{text_col}`")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    windows = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))
    base = docs.withColumn("_w", words_of(text)).withColumn("_l", lines)
    hashed = base.withColumn("_h", F.transform(windows, lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))))
    # most texts repeat no window: only the others are sorted
    keyed = hashed.withColumn("_k", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # a place counts if its window equals the one before or after it in the sorted order
    again = F.filter(F.transform("_k", lambda x, j: F.when((x["h"] == F.get("_k", j - 1)["h"]) | (x["h"] == F.get("_k", j + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    placed = keyed.withColumn("_p", F.sort_array(again))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    n = lambda c: F.size(c).cast("long")
    found = {
        "n_words": n("_w"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": n("_l") - n(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_lines": n("_l"),
    }
    return placed.select("row", F.struct(*[found[k].alias(k) for k in FEATURES]).alias("_f"))


def _vote(against: Column, in_favour: Column) -> Column:
    return F.when(against, -1).when(in_favour, 1).otherwise(0).cast("int")


def rules(f: str = "_f") -> dict[str, Column]:
    """Each rule's vote on a struct of FEATURES: -1 against the text, 1 for it, 0 abstains. Texts without words are left to base_failed."""
    x = lambda k: F.col(f"{f}.{k}")
    return {
        "symbols_per_word": _vote(10 * x("n_symbols") > 3 * x("n_words"), 100 * x("n_symbols") <= 5 * x("n_words")),
        "symbols_per_character": _vote(100 * x("n_symbols") > 8 * x("word_chars"), 100 * x("n_symbols") <= x("word_chars")),
        "word_length": _vote((x("word_chars") > 7 * x("n_words")) | (x("word_chars") < 3 * x("n_words")), x("word_chars").between(4 * x("n_words"), 6 * x("n_words"))),
        "repeated_words": _vote(100 * x("n_repeat_words") > 40 * x("n_words"), 100 * x("n_repeat_words") <= 20 * x("n_words")),
        "repeated_lines": _vote((x("n_lines") > 3) & (2 * x("n_dup_lines") > x("n_lines")), (x("n_lines") > 3) & (10 * x("n_dup_lines") <= x("n_lines"))),
        "length": _vote(x("n_words") < MIN_WORDS, x("n_words") >= 2 * MIN_WORDS),
    }


class Fit(dict):
    """prior: share of good texts; good, bad: each rule's chance to vote against a good and a bad text, if it votes."""


def _log_odds(fit: Fit) -> Column:
    """Log odds that a text with the votes in column `votes` is good."""
    from math import log

    total = F.lit(log(fit["prior"] / (1 - fit["prior"])))
    for r, (g, b) in enumerate(zip(fit["good"], fit["bad"], strict=True)):
        vote = F.get("votes", F.lit(r))
        total = total + F.when(vote == -1, log(g / b)).when(vote == 1, log((1 - g) / (1 - b))).otherwise(0.0)
    return total


def fit_votes(votes: DataFrame, passes: int = PASSES) -> Fit:
    """Estimate the rules' accuracies from a column `votes` alone, by expectation-maximisation (Dawid and Skene, 1979).

    Only the distinct combinations of votes matter, 3 ** rules at most, each with its count; every pass is one aggregate over
    them, of which the driver gets the sums. The start, and bounds on the chances, say which side is good: a rule votes against
    a good text in at most a fifth of its votes, and against a bad one in at least a fifth. Without rows the start is returned.
    """
    n = len(rules())
    combinations = staged(votes.groupBy("votes").count().coalesce(1), "votes")
    fit = Fit(prior=0.8, good=[0.05] * n, bad=[0.6] * n)
    within = lambda x, low, high: min(max(x, low), high)
    for _ in range(passes):
        p, c = F.col("p"), F.col("count")
        sums = [F.sum(c * p).alias("good"), F.sum(c).alias("all")]
        for r in range(n):
            v = F.get("votes", F.lit(r))
            sums += [F.sum(F.when(cond, c * w).otherwise(0.0)).alias(f"{name}{r}") for name, cond, w in (("ga", v == -1, p), ("gv", v != 0, p), ("ba", v == -1, 1 - p), ("bv", v != 0, 1 - p))]
        s = combinations.withColumn("p", 1 / (1 + F.exp(-_log_odds(fit)))).agg(*sums).first()
        if not s["all"]:
            break
        last, fit = fit, Fit(
            prior=within(s["good"] / s["all"], 0.05, 0.98),
            good=[within((s[f"ga{r}"] + 0.05) / (s[f"gv{r}"] + 1), 1e-4, 0.2) for r in range(n)],
            bad=[within((s[f"ba{r}"] + 0.6) / (s[f"bv{r}"] + 1), 0.2, 0.999) for r in range(n)],
        )
        if all(abs(x - y) < TOLERANCE for x, y in zip((fit["prior"], *fit["good"], *fit["bad"]), (last["prior"], *last["good"], *last["bad"]), strict=True)):
            break
    return fit


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns `keep` of docs, all if None), `_f` (FEATURES), votes, base_failed, quality (the posterior
    probability that the text is good) and kept (not base_failed, and quality at least one half).

    The accuracies are learnt from the votes of all rows given, without labels. Rows without words, base_failed anyway, count too.
    Defined cases: a null text has no words and fails the base; equal texts get equal verdicts; ids don't matter; an empty table
    gives an empty result; columns of docs may have any names, as they stand within row.
    """
    seen = staged(features(docs, text_col, keep).withColumn("votes", F.array(*rules().values())), "quality")
    fit = fit_votes(seen.select("votes"))
    failed = (F.col("_f.n_words") < MIN_WORDS) | (100 * F.col("_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_f.n_words"))
    return seen.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-_log_odds(fit)))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """judged() with the columns `keep` of docs (all, if None) instead of row; those named like the new ones are replaced."""
    new = ("_f", "votes", "base_failed", "quality", "kept")
    return judged(docs, text_col, keep).select(*[F.col(f"row.`{c}`") for c in (docs.columns if keep is None else keep) if c not in new], *new)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that judged() keeps, with their own columns, whatever their names."""
    return judged(docs, text_col).where("kept").select("row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its features, the base verdict and the posterior's."""
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "_f.n_words", "_f.word_chars", "_f.n_symbols", "_f.n_dup_lines", "_f.n_repeat_words", "base_failed", "kept", "quality", "votes")
