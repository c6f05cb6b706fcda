"""Mixing sources to target weights along a training curriculum.

Every source has a weight schedule over training time t in 0..1: its target share times
a shape, piecewise linear between points (t, weight) and scaled so that its integral
over all of training is 1. The source's demand at t is the cumulated integral, its
tokens times that; a document whose tokens are the c-th of its source's stream is read
when demand reaches c, so inverting the integral, a quadratic in each piece, gives its
training position. Documents sorted by position form the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

BUCKET_ROWS = 50_000
BROADCAST_SOURCES = 10_000


def demand(docs: DataFrame, targets: DataFrame, source_col: str = "source", size_col: str = "size") -> DataFrame:
    """One row per listed source: size, wanted, allowed, tokens, capped.

    T is the size of all documents of listed sources, each once. A source wants
    target_share * T tokens and is allowed max_repeats times its own size; capped
    says that it wants more than it is allowed. Sources without documents have
    size 0; null shares and repeats count as 0; a source listed twice counts with
    the sum of its shares and the larger repeat limit.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
    )
    own = docs.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.col(size_col), F.lit(0))).alias("size"), F.count("*").alias("docs"))
    x = t.join(own, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
    x = stage(x, "demand")
    x = x.withColumn("total", F.lit(x.agg(F.sum("size")).first()[0] or 0).cast("long"))
    wanted = F.col("target_share") * F.col("total")
    allowed = (F.col("max_repeats") * F.col("size")).cast("double")
    return x.select("*", wanted.alias("wanted"), allowed.alias("allowed"), F.least(wanted, allowed).alias("tokens"), (wanted > allowed).alias("capped"))


def pieces(schedules: DataFrame | None, sources: DataFrame) -> DataFrame:
    """(source, pieces): of every source its schedule's pieces as an array of structs
    (y0, t0, w0, slope), y0 being the cumulated integral at t0 of the scaled weights.

    ``schedules``: (source, t, weight) points; times outside 0..1 and negative or null
    weights count as the nearest allowed value, of points at one time the largest weight
    counts, before the first and after the last point the weight stays, and a source without
    points or weight has a flat schedule.
    """
    flat = F.array(F.struct(F.lit(0.0).alias("y0"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("w0"), F.lit(0.0).alias("slope")))
    if schedules is None:
        return sources.select("source", flat.alias("pieces"))
    p = schedules.where("source is not null and t is not null and not isnan(t)").select(
        "source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t").cast("double"))).alias("t"), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("w")
    ).groupBy("source", "t").agg(F.max("w").alias("w"))
    # a schedule is a short list of points a source
    own = p.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("p"))
    ends = F.expr("concat(if(p[0].t > 0, array(struct(0D AS t, p[0].w AS w)), array()), p, if(p[size(p) - 1].t < 1, array(struct(1D AS t, p[size(p) - 1].w AS w)), array()))")
    own = own.select("source", ends.alias("p"))
    own = own.withColumn("_total", F.expr("aggregate(sequence(1, size(p) - 1), 0D, (a, i) -> a + (p[i].t - p[i - 1].t) * (p[i].w + p[i - 1].w) / 2)"))
    step = """aggregate(sequence(1, size(p) - 1), cast(array() AS array<struct<y0: double, t0: double, w0: double, slope: double>>),
        (a, i) -> concat(a, array(struct(if(i = 1, 0D, a[i - 2].y0 + (p[i - 1].t - p[i - 2].t) * (p[i - 1].w + p[i - 2].w) / 2 / _total) AS y0, p[i - 1].t AS t0, p[i - 1].w / _total AS w0,
            (p[i].w - p[i - 1].w) / _total / (p[i].t - p[i - 1].t) AS slope))))"""
    own = own.where("_total > 0").select("source", F.expr(step).alias("pieces"))
    return sources.join(own, "source", "left").select("source", F.coalesce("pieces", flat).alias("pieces"))


def position(y: Column, of: Column) -> Column:
    """The time at which a schedule's cumulated integral reaches ``y``, in 0..1."""
    # the last piece that starts at or before y; pieces without weight are passed at once
    piece = F.filter(of, lambda e: e["y0"] <= y)
    last = F.element_at(piece, -1)
    rest = y - last["y0"]
    root = F.sqrt(F.greatest(F.lit(0.0), last["w0"] * last["w0"] + 2 * last["slope"] * rest))
    return F.least(F.lit(1.0), last["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / F.nullif(last["w0"] + root, F.lit(0.0))))


def mix(docs: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """The mixture: (position, source, doc_id, repeat, size, target_share, capped, offset).

    ``schedules`` (source, t, weight): see ``pieces``. A source is read in whole
    passes, each in its own
    pseudo-random order, and a last partial pass that ends with the document that
    would pass the source's tokens by more than half its size. offset: the tokens of the
    source's stream up to the document's middle. Documents of
    size 0 and of unlisted or null sources are left out. A source may hold any
    share of the rows: prefix sums are taken in buckets of hash order of about
    BUCKET_ROWS rows and shifted by bucket offsets. Rows come sorted by
    position over range partitions.
    """
    want = demand(docs, targets, source_col, size_col)
    want = want.join(pieces(schedules, want.select("source")), "source")
    want = stage(want.where("size > 0 and tokens > 0"), "mix")
    listed, most = want.agg(F.count("*"), F.max("docs")).first()
    most = most or 1
    n = max(1, -(-int(most) // BUCKET_ROWS))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")).where(F.col("size") > 0)
    w = want.select("source", "target_share", "total", "tokens", "capped", "pieces", F.col("size").alias("own"))
    w = F.broadcast(w) if listed <= BROADCAST_SOURCES else w  # beyond it, a shuffled join with skew handling
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("tokens") / F.col("own")) - 1)).cast("int"))
    x = d.join(w, "source").withColumn("repeat", F.explode(passes))
    x = x.withColumn("_h", F.xxhash64("doc_id", "repeat", F.lit(seed)))
    # the high bits of the hash number the buckets, so buckets follow hash order
    x = x.withColumn("_b", F.floor((F.shiftrightunsigned("_h", 33).cast("double") / float(1 << 31)) * n).cast("int"))
    x = x.withColumn("_k", F.shiftrightunsigned("_h", 1))
    sums = x.groupBy("source", "repeat", "_b").agg(F.sum("size").alias("_s"))
    off = sums.select("source", "repeat", "_b", (F.sum("_s").over(W.partitionBy("source", "repeat").orderBy("_b")) - F.col("_s")).alias("_off"))
    here = W.partitionBy("source", "repeat", "_b").orderBy("_k", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_c", F.sum("size").over(here)).join(off, ["source", "repeat", "_b"])
    middle = F.col("repeat") * F.col("own") + F.col("_off") + F.col("_c") - F.col("size") / 2.0
    x = x.withColumn("_m", middle).where(F.col("_m") <= F.col("tokens"))
    t = position(F.col("_m") / F.col("tokens"), F.col("pieces"))
    return x.select(t.alias("position"), "source", "doc_id", "repeat", "size", "target_share", "capped", F.col("_m").alias("offset")).repartitionByRange("position", "source", "doc_id").sortWithinPartitions("position", "source", "doc_id")


def over_time(mixed: DataFrame, slices: int = 10) -> DataFrame:
    """(slice, source, mixed_size, share): what each part of training is made of."""
    x = mixed.groupBy(F.least(F.lit(slices - 1), F.floor(F.col("position") * slices)).cast("int").alias("slice"), "source").agg(F.sum("size").alias("mixed_size"))
    return x.withColumn("share", F.col("mixed_size") / F.sum("mixed_size").over(W.partitionBy("slice")))


def report(docs: DataFrame, targets: DataFrame, mixed: DataFrame | None = None, schedules: DataFrame | None = None, **cols: str) -> DataFrame:
    """Of every listed source: target and actual share, what it wants and is allowed, repeats, capped.

    Actual figures are summed over the mixture itself.
    """
    mixed = mix(docs, targets, schedules, **cols) if mixed is None else mixed
    got = mixed.groupBy("source").agg(F.sum("size").alias("mixed_size"), F.count("*").alias("mixed_rows"))
    want = demand(docs, targets, cols.get("source_col", "source"), cols.get("size_col", "size"))
    x = want.join(got, "source", "left").fillna({"mixed_size": 0, "mixed_rows": 0})
    x = stage(x, "mixed")
    total = float(x.agg(F.sum("mixed_size")).first()[0] or 0)
    return x.select(
        "source", "target_share", (F.col("mixed_size") / F.lit(total) if total else F.lit(0.0)).alias("actual_share"), "size", "wanted", "allowed", "mixed_size",
        F.when(F.col("size") > 0, F.col("mixed_size") / F.col("size")).otherwise(0.0).alias("repeats"), "max_repeats", "mixed_rows", "capped",
    )
