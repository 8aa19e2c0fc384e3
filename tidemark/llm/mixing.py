"""Mixing sources to target weights along a curriculum, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words_of, staged, table

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Slope of each source's weight schedule, repeating likewise: its intensity at time t of the training run, 0 to 1, is
#: 1 + slope * (2 t - 1), so that it integrates to 1. Below 0 the source comes early, above 0 late.
SLOPES = (-0.5, 0.0, 0.5)
#: Rows of one source that one task sums up in order.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple, slopes: tuple) -> DataFrame:
    """sizes(source, source_size) -> the same with target and slope: `share` of all sizes dealt by weight, no target above
    `cap` times its size, the excess dealt again by weight. One row a source; in closed form: ordered by cap * size / weight,
    the sources that reach their cap come first, and the rest divide what those leave."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(in_order) - 1
    deal = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(F.col("number"), F.lit(len(values))) + 1).cast("int"))
    ranked = sizes.withColumn("number", number).withColumn("weight", deal(weights)).withColumn("slope", deal(slopes))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("level", F.col("most") / F.col("weight")).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    by_level = Window.orderBy("level", "number")
    ranked = ranked.withColumn("spent", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("rate", (F.col("budget") - F.col("spent")) / F.col("open"))
    ranked = ranked.withColumn("rate", F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", "number", "rate"))).over(Window.partitionBy())["rate"])
    return ranked.select("source", "source_size", F.least("most", F.coalesce(F.col("rate") * F.col("weight"), "most")).alias("target"), "slope")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple = WEIGHTS,
    slopes: tuple = SLOPES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    number_col: str | None = None,
) -> DataFrame:
    """Say how often each document of docs enters the training mix, and where.

    Returns, ordered by first position: doc_id, source, size (words), source_size, target, copies, taken (copies * size) and
    positions (array of times from 0 to 1, one for each copy); with number_col, that column of docs as number too. Documents of a source stand in an order by hash. A source's
    demand for tokens up to time t is its target times the integral of its schedule; the copy that begins at token x of the
    source's stream goes to the time at which demand reaches x. A stream runs through the source again and again up to its
    target; the last round ends before the first document that would overshoot, and then takes the one other document whose
    size comes nearest to what is missing, if that helps.

    Defined cases: null or blank texts have size 0, are never taken and have no position; a null source is a source, the last
    in order; ids may be null or repeated and equal rows stay separate; an empty table gives an empty result; other columns are
    ignored. A hot source is summed in hash buckets of about BUCKET_ROWS rows: only bucket totals meet. Reruns agree, as the
    order depends on the rows alone.
    """
    rows = staged(
        docs.select(
            (F.lit(None).cast("long") if number_col is None else F.col(number_col)).alias("number"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.lit("mix")).alias("h"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc")
        ),
        "mix",
    )
    bits = max(4, (rows.count() // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    by_bucket = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, cap, weights, slopes)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    t, s = targets.alias("t"), starts.alias("s")
    starts = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.bucket", "s.start", "t.source_size", "t.target", "t.slope")
    r, s = rows.alias("r"), starts.alias("s")
    placed = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))).select("r.*", "s.start", "s.source_size", "s.target", "s.slope")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "crc")
    placed = placed.withColumn("start", F.col("start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    placed = staged(placed.withColumn("fits", F.col("start") + F.col("size") <= F.col("rest")).drop("bucket", "crc"), "mix-placed")
    # a document for what the last round leaves: of each source's others, the one whose size comes nearest
    left = placed.groupBy("source").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("start") + F.col("size"))), F.lit(0))).alias("missing"))
    p, m = placed.filter("not fits and size > 0").alias("p"), left.alias("m")
    gap = F.abs(F.col("p.size") - F.col("m.missing"))
    best = (
        p.join(m, F.col("p.source").eqNullSafe(F.col("m.source")))
        .filter(gap < F.col("m.missing"))
        .groupBy(F.col("p.source").alias("source"))
        .agg(F.min(F.struct(gap.alias("gap"), F.col("p.start").alias("start")))["start"].alias("extra"))
    )
    p, b = placed.alias("p"), best.alias("b")
    chosen = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", "b.extra")
    once_more = F.col("fits") | F.coalesce(F.col("start") == F.col("extra"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("rounds") + once_more.cast("long")).otherwise(0).cast("long")
    slope = F.col("slope")
    demand = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + F.col("start")) / F.col("target"))
    when = lambda x: 2 * x / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x))
    chosen = chosen.withColumn("copies", copies).withColumn(
        "positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: when(demand(k)))).otherwise(F.array().cast("array<double>"))
    )
    first = F.coalesce(F.get("positions", F.lit(0)), 1 + F.pmod("h", F.lit(1 << 20)) / float(1 << 20))
    numbered = [] if number_col is None else ["number"]
    return chosen.withColumn("first", first).orderBy("first", "h", "doc_id").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", *numbered)


def in_training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as mix() takes them: each as often as its copies say, range-sorted by position, so that the files of a written
    result stand in training order, and rows in each file; the others are left out.

    docs is written once with a number for each row, by which positions come back: rows of repeated or null ids, and equal rows,
    stay rows of their own. Columns of docs may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = staged(docs.select(row, F.monotonically_increasing_id().alias("number")), "numbered")
    own = numbered.select("number", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"), F.col(f"row.`{source_col}`").alias("source"))
    places = mix(own, id_col="id", text_col="text", source_col="source", number_col="number", **how).where("copies > 0").select("number", F.explode("positions").alias("at"))
    return numbered.join(places, "number").orderBy("at", F.xxhash64(F.col(f"row.`{id_col}`")), "number").select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target, its copies and their positions in training."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "positions")
