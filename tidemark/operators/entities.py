"""Names to entities: exact codes, exact aliases, then similar aliases, with what is in doubt left to a queue."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ticker_code
from ..sources.landing import written

#: Endings of company names, in the order in which they are removed.
SUFFIXES = ("股份有限公司", "控股股份有限公司", "有限公司", "公司", "集團")
PUNCTUATION = r"[\s\-_.,()（）「」【】·・]"
CANDIDATE, ACCEPT, GAP, MOST = 0.60, 0.92, 0.02, 5
#: Ratios that are asked for one after the other.
ROUNDS = (ACCEPT, 0.76, CANDIDATE)


def _compatible(name: Column) -> Column:
    @F.pandas_udf("string")
    def plain(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return plain(name)


def normalized(name: Column) -> Column:
    """Full-width forms as plain ones, trimmed, upper case, without company endings and punctuation; null is blank."""
    text = F.upper(F.trim(_compatible(F.coalesce(name, F.lit("")))))
    for suffix in SUFFIXES:
        text = F.replace(text, F.lit(suffix), F.lit(""))
    return F.regexp_replace(text, PUNCTUATION, "")


def alias_table(aliases: DataFrame) -> DataFrame:
    """aliases(alias, entity_id, seq) -> key, alias, entity_id: the last of each normalised key; blank keys are refused."""
    keyed = aliases.withColumn("key", normalized(F.col("alias"))).where("key != ''")
    return keyed.groupBy("key").agg(F.max_by(F.struct("alias", "entity_id"), F.struct("seq", "entity_id")).alias("r")).select("key", "r.*")


def exact(queries: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries(query), codes(code, entity_id) and an alias_table() -> query, norm, entity_id and method: a code comes before an alias."""
    q = queries.withColumn("query", F.trim("query")).withColumn("norm", normalized(F.col("query"))).withColumn("code_key", F.coalesce(ticker_code(F.col("query")), "norm"))
    c = codes.select(normalized(F.col("code")).alias("code_key"), F.col("entity_id").alias("by_code")).dropDuplicates(["code_key"])
    a = aliases.select(F.col("key").alias("norm"), F.col("entity_id").alias("by_alias"))
    found = q.join(c, "code_key", "left").join(a, "norm", "left")
    some = F.col("norm") != ""
    entity = F.when(some, F.coalesce("by_code", "by_alias"))
    method = F.when(some & F.col("by_code").isNotNull(), "EXACT_CODE").when(some & F.col("by_alias").isNotNull(), "EXACT_ALIAS").otherwise("UNRESOLVED")
    return found.select("query", "norm", entity.alias("entity_id"), method.alias("method"))


def _numbered(text: Column) -> Column:
    """Each character with its number among its equals, so that shared ones of two texts are the intersection of two sets."""
    chars = F.split(text, "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _by_rarity(df: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """name and letters: its numbered characters, those that fewest aliases have first; the same order for all texts."""
    spelt = df.where(F.col(name) != "").select(name).distinct().select(name, F.explode(_numbered(F.col(name))).alias("letter")).join(counts, "letter", "left")
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter")))
    return spelt.groupBy(name).agg(ordered.alias("s")).select(name, F.col("s.letter").alias("letters"))


def ratio(left: str, right: str) -> float:
    """Ratcliff and Obershelp's similarity; 0 if a side is empty."""
    if not left or not right:
        return 0.0
    return 1.0 if left == right else difflib.SequenceMatcher(None, left, right).ratio()


def ratios(left: Column | str, right: Column | str) -> Column:
    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return compare(left, right)


def meetings(names: DataFrame, aliases: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """names(norm) and aliases(key) -> norm, key of the pairs that share enough characters for a ratio of `least`; each pair once.

    An inverted index of numbered characters, in one order for all texts, the rarest first. A ratio of r needs r / 2 of both texts' characters to
    match, so the two share that many and then one of the first few of each: texts meet by those, if their sizes allow the ratio (size band) and
    enough characters are left behind the two places at which they meet (positional filter). A pair meets at many places; the first of them counts, as
    no earlier character of one is an earlier one of the other, so that pairs needn't be shuffled again to become distinct. Nothing that could pass is lost.
    """
    half = least / 2
    counts = aliases.where("key != ''").select("key").distinct().select(F.explode(_numbered(F.col("key"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))

    def keyed(df: DataFrame, name: str, letters: str, size: str, place: str) -> DataFrame:
        n = F.size("letters")
        fewest = F.ceil(half * (n + n * (half / (1 - half))) - 1e-9)  # matches needed with the shortest possible partner
        first = F.slice("letters", F.lit(1), F.greatest(n - fewest + 1, F.lit(1)).cast("int"))
        return _by_rarity(df, name, counts).select(name, F.col("letters").alias(letters), n.alias(size), F.posexplode(first).alias(place, "letter"))

    left, right = keyed(names, "norm", "l", "n", "i"), keyed(aliases, "key", "r", "m", "j")
    needed = F.ceil(half * (F.col("n") + F.col("m")) - 1e-9)
    left_behind = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    band = (F.col("n") * (half / (1 - half)) <= F.col("m") + 1e-9) & (F.col("m") * (half / (1 - half)) <= F.col("n") + 1e-9)
    met = left.join(right, "letter").where(band & (left_behind >= needed))
    met = met.where(~F.arrays_overlap(F.slice("l", F.lit(1), F.col("i")), F.slice("r", F.lit(1), F.col("j"))))
    return met.where(F.size(F.array_intersect("l", "r")) >= needed).select("norm", "key")


def candidates(names: DataFrame, aliases: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """names(norm) and aliases(key, entity_id) -> norm, key, entity_id and score of the pairs whose ratio is `least` or more."""
    scored = meetings(names, aliases, least).select("norm", "key", ratios("norm", "key").alias("score")).where(F.col("score") >= least)
    return scored.join(aliases.select("key", "entity_id"), "key").select("norm", "key", "entity_id", "score")


def best(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The candidates of each name that matter: the MOST best at least, or all where there are fewer.

    In rounds of falling similarity: a name that has MOST candidates of a round's ratio has its best ones, and only the others go on to a round in
    which more aliases have to be compared.
    """
    waiting, found = names.select("norm").distinct(), None
    for least in ROUNDS:
        now = candidates(waiting, aliases, least)
        if least != ROUNDS[-1]:
            now = written(now, "candidates")
            full = now.groupBy("norm").agg(F.count("*").alias("n")).where(F.col("n") >= MOST).select("norm")
            waiting, now = waiting.join(full, "norm", "left_anti"), now.join(full, "norm", "left_semi")
        found = now if found is None else found.unionByName(now)
    return found


def fuzzy(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(norm) -> norm, entity_id, score, n_candidates, review and candidates: the best alias decides from ACCEPT on, unless the second is closer
    than GAP; anything else that has candidates waits for review. Candidates are aliases, MOST at most, ties by key."""
    w = Window.partitionBy("norm").orderBy(F.desc("score"), "key")
    ranked = best(names, aliases).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MOST)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity_id", "key", "score"))), lambda c: F.struct(c["entity_id"].alias("entity_id"), c["key"].alias("key"), c["score"].alias("score")))
    by = ranked.groupBy("norm").agg(at(1, "score").alias("score"), at(2, "score").alias("second"), at(1, "entity_id").alias("first_id"), F.count("*").alias("n_candidates"), listed.alias("candidates"))
    sure = (F.col("score") >= ACCEPT) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= GAP))
    return by.select("norm", F.when(sure, F.col("first_id")).alias("entity_id"), "score", "n_candidates", (~sure).alias("review"), "candidates")


def resolve(queries: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, entity_id, method (EXACT_CODE, EXACT_ALIAS, FUZZY or UNRESOLVED), score, review and candidates (entity_id, key, score) of each query."""
    first = exact(queries, codes, aliases)
    rest = fuzzy(first.where("method = 'UNRESOLVED' and norm != ''").select("norm"), aliases).withColumnRenamed("entity_id", "similar_id")
    both = first.join(rest, "norm", "left")
    done = F.col("method") != "UNRESOLVED"
    method = F.when(done, F.col("method")).when(F.col("similar_id").isNotNull(), "FUZZY").otherwise("UNRESOLVED")
    score = F.when(done, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    entity = F.when(done, F.col("entity_id")).otherwise(F.col("similar_id"))
    return both.select("query", entity.alias("entity_id"), method.alias("method"), score.alias("score"), (~done & F.coalesce("review", F.lit(False))).alias("review"), "candidates")
