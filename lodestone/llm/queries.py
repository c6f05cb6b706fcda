"""The pN_ queries over the test tables, and SQL for those that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from . import clusters, mixing, neardup, neighbours, packing, quality, residue, subjects
from .common import current_keys, table


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their token size: UTF-8 bytes of the text, 0 for null."""
    return table(spark, sf, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def _specs(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    """The container kinds: a fixed table of three rows."""
    return [(r["spec"], r["capacity"]) for r in table(spark, sf, "pack_spec").where("spec is not null and capacity >= 1").distinct().collect()]


def _p1(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit("")))
    return neardup.near_duplicates(table(spark, sf, "doc_meta"), both, "id", "ingested_at", width=3, least_words=20, similarity=0.5)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.expand_pairs(*_p1(spark, sf))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record with a near-duplicate: its class and number of links."""
    return neardup.groups(*_p1(spark, sf))


def p2_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The text quality statistics and the kind of every current doc_meta record."""
    docs = table(spark, sf, "doc_meta")
    x = quality.classify(docs.select("id", F.col("ingested_at"), "text"), keep_text=False)
    return x.join(current_keys(docs, "id", "ingested_at"), ["id", "ingested_at"]).dropDuplicates(["id"]).drop("ingested_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_meta")
    # staged, or the filter on the kind would be pushed down and every statistic computed again inside it
    x = stage(quality.classify(docs.select("id", F.col("ingested_at"), "text"), keep_text=False).select("id", "ingested_at", "kind"), "kinds")
    x = x.where(F.col("kind").isin("list", "table", "junk"))
    # of different rows with one id and time the kind that is first by name counts
    return x.join(current_keys(docs, "id", "ingested_at"), ["id", "ingested_at"]).groupBy("id").agg(F.min("kind").alias("kind"))


def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, cluster, size): the members of every cluster of two and more."""
    return clusters.cluster(table(spark, sf, "vectors"), ts_col="embedded_at").members().drop("leaf")


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(cluster, size, typical_1..3, cosine_1): every cluster with its members nearest to its centre."""
    return clusters.cluster(table(spark, sf, "vectors"), ts_col="embedded_at").clusters().drop("leaves")


def p3_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The compact leaves: cluster, size, compactness and most typical members."""
    return clusters.cluster(table(spark, sf, "vectors"), ts_col="embedded_at").leaves()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.consecutive(p3_members(spark, sf))  # chains of members inside the clusters


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, rank, near_id, cosine) of every valid current vector."""
    return neighbours.similar_vectors(table(spark, sf, "vectors"), ts_col="embedded_at")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    x = p4_neighbours(spark, sf)
    return x.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()


def p5_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """(id, area, share) of every current doc_meta record."""
    areas = [r["area"] for r in table(spark, sf, "subject_area").collect()]  # a fixed table of ten rows
    return subjects.assign(table(spark, sf, "doc_meta"), table(spark, sf, "subject_label"), areas, ts_col="ingested_at")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_subjects(spark, sf).select("id", "area")


def p5_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Records per area; a record with two areas counts in both."""
    return p5_subjects(spark, sf).groupBy("area").agg(F.count("*").alias("records"), F.round(F.sum("share"), 3).alias("weight"))


def p6_assign(spark: SparkSession, sf: str) -> DataFrame:
    """(spec, doc_id, piece_no, pieces, length, container) for every container kind."""
    docs, out = stage(sized(spark, sf), "sizes"), None
    for spec, capacity in _specs(spark, sf):
        x = packing.pack(docs, capacity).select(F.lit(spec).alias("spec"), "*")
        out = x if out is None else out.unionByName(x)
    return out if out is not None else spark.createDataFrame([], "spec string, doc_id long, piece_no int, pieces int, length long, container long")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_assign(spark, sf).where("pieces > 1 and piece_no = 0").select("spec", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Of each container kind: containers, items, bytes and the unused share."""
    x = p6_assign(spark, sf).groupBy("spec", "container").agg(F.count("*").alias("items"), F.sum("length").alias("used"))
    x = x.groupBy("spec").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    x = x.join(table(spark, sf, "pack_spec"), "spec")
    return x.select("spec", "capacity", "containers", "items", "used", "fullest", F.round(1 - F.col("used") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"))


#: Weight schedules (t, weight) of the registered mixtures; sources take them in turn, by name.
SHAPES = {
    "falling": ((0.0, 1.5), (1.0, 0.5)),
    "rising": ((0.0, 0.5), (1.0, 1.5)),
    "late": ((0.0, 0.8), (0.6, 0.8), (0.7, 1.6), (1.0, 1.6)),
}


def _curriculum(targets: DataFrame) -> DataFrame:
    """(source, shape, t, weight): a documented schedule for every listed source, as mix_target has none."""
    x = targets.where("source is not null").select("source").distinct().withColumn("_i", (F.row_number().over(W.orderBy("source")) - 1) % len(SHAPES))  # the listed sources
    points = F.array(*[F.array(*[F.struct(F.lit(n).alias("shape"), F.lit(t).alias("t"), F.lit(w).alias("weight")) for t, w in p]) for n, p in SHAPES.items()])
    return x.select("source", F.explode(F.get(points, F.col("_i"))).alias("p")).select("source", "p.shape", "p.t", "p.weight")


def _p7(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_target")
    docs = stage(sized(spark, sf), "sizes")
    return docs, targets, stage(mixing.mix(docs, targets, _curriculum(targets)), "mixture")


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Of every document its pieces and their bytes, and whether the containers they lie in are within capacity."""
    x = stage(p6_assign(spark, sf), "assigned")
    full = x.groupBy("spec", "container").agg(F.sum("length").alias("used")).join(table(spark, sf, "pack_spec"), "spec").where("used > capacity").select("spec", "container", F.lit(False).alias("within"))
    x = x.join(full, ["spec", "container"], "left")
    return x.groupBy("spec", "doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("container").alias("containers"), F.sum("length").alias("bytes"), F.bool_and(F.coalesce("within", F.lit(True))).alias("within"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_target")
    return mixing.mix(sized(spark, sf), targets, _curriculum(targets))


def p7_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """(source, percent, position): when a source has delivered so much of its tokens."""
    targets = table(spark, sf, "mix_target")
    x = mixing.pieces(_curriculum(targets), targets.select("source").where("source is not null").distinct())
    x = x.withColumn("percent", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5))))
    return x.select("source", "percent", F.round(mixing.position(F.col("percent") / 100, F.col("pieces")), 6).alias("position"))


def p7_slices(spark: SparkSession, sf: str) -> DataFrame:
    """(slice, source, mixed_size, share): what each tenth of training is made of."""
    return mixing.over_time(_p7(spark, sf)[2])


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets, mixed = _p7(spark, sf)
    return mixing.report(docs, targets, mixed)


def p7_order(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source in the mixture: documents that come before an earlier one of its stream, positions
    that are off the schedule, and passes that aren't whole though a further one follows."""
    docs, targets, mixed = _p7(spark, sf)
    w = W.partitionBy("source").orderBy("offset")
    x = mixed.withColumn("before", F.lag("position").over(w))
    lost = mixed.groupBy("source", "repeat").agg(F.count("*").alias("n")).join(docs.where("size > 0").groupBy("source").agg(F.count("*").alias("docs")), "source")
    lost = lost.withColumn("last", F.max("repeat").over(W.partitionBy("source"))).groupBy("source").agg(F.sum((F.col("n") < F.col("docs")) .cast("long") * (F.col("repeat") < F.col("last")).cast("long")).alias("cut_passes"))
    return x.groupBy("source").agg(F.sum((F.col("before") > F.col("position")).cast("long")).alias("out_of_order"), F.sum((~F.col("position").between(0, 1)).cast("long")).alias("off")).fillna(0).join(lost, "source")


def p7_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Of every listed source what it wants and is allowed, what capped ones got, and whether the others got what they want."""
    x = p7_report(spark, sf)
    longest = sized(spark, sf).groupBy("source").agg(F.max("size").alias("longest"))
    x = x.join(longest, "source", "left")
    met = F.when(~F.col("capped"), F.abs(F.col("mixed_size") - F.col("wanted")) <= F.coalesce("longest", F.lit(0)))
    return x.select("source", "size", F.round("wanted", 3).alias("wanted"), F.col("allowed").cast("long").alias("allowed"), "capped", F.when(F.col("capped"), F.col("mixed_size")).alias("capped_size"), met.alias("met"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that the mixture gives less than they want, since they want more than they are allowed."""
    return p7_report(spark, sf).where("mixed_size < wanted and capped").select("source")


def p8_residue(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, kind, evidence) of documents that are or hold template residue."""
    return residue.residue(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_residue(spark, sf).select("doc_id").distinct()


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_VECTORS = """x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) AS r FROM vectors)
            WHERE r = 1 AND embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        u AS (SELECT vec_id, list_transform(e, lambda v: v / sqrt(list_inner_product(e, e))) AS e FROM x),
        c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS cosine FROM u a, u b WHERE a.vec_id <> b.vec_id),
        near AS (SELECT * FROM c WHERE cosine >= 0.8)"""
_SHINGLES = r"""d AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || '. ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w
            FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM doc_meta) WHERE r = 1),
        s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
        f AS (SELECT id_a, id_b, c, a.n AS na, b.n AS nb FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE 2 * c >= a.n + b.n - c)"""
_ROOTS = "reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b), root AS (SELECT a AS vec_id, least(a, min(b)) AS root FROM reach GROUP BY a)"


def _sql_pieces() -> str:
    """The shapes' pieces, their weights scaled to an integral of 1."""
    out = []
    for i, p in enumerate(SHAPES.values()):
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:])]
        for j, ((t0, w0), (t1, w1)) in enumerate(zip(p, p[1:])):
            out.append(f"SELECT {i} AS shape, {t0!r}::DOUBLE AS t0, {w0 / sum(area)!r}::DOUBLE AS w0, {(w1 - w0) / (t1 - t0) / sum(area)!r}::DOUBLE AS slope, {sum(area[:j]) / sum(area)!r}::DOUBLE AS y0")
    return " UNION ALL ".join(out)


_SIZES = """own AS (SELECT source, sum(strlen(coalesce(text, ''))) AS size FROM documents GROUP BY source),
        x AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(o.size, 0) AS size FROM mix_target m LEFT JOIN own o USING (source)), y AS (SELECT *, target_share * (SELECT sum(size) FROM x) AS wanted, max_repeats * size AS allowed FROM x)"""

ORACLE = {
    "p1_found": r"""
        WITH d AS (SELECT id, regexp_extract_all(lower(coalesce(title, '') || '. ' || coalesce(text, '')), '[\p{L}\p{N}]+') AS w
            FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM doc_meta) WHERE r = 1),
        s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM c JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE 2 * c >= a.n + b.n - c""",
    "p3_found": f"""
        WITH RECURSIVE {_VECTORS}, reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
        root AS (SELECT a AS vec_id, least(a, min(b)) AS root FROM reach GROUP BY a),
        l AS (SELECT vec_id AS vec_a, lead(vec_id) OVER (PARTITION BY root ORDER BY vec_id) AS vec_b FROM root) SELECT * FROM l WHERE vec_b IS NOT NULL""",
    "p4_found": f"""
        WITH {_VECTORS}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS r FROM near)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE r <= 10""",
    "p6_found": """
        SELECT s.spec, d.doc_id FROM documents d JOIN pack_spec s ON strlen(coalesce(d.text, '')) > s.capacity""",
    "p7_found": """
        WITH own AS (SELECT source, sum(strlen(coalesce(text, ''))) AS size FROM documents GROUP BY source),
        x AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(o.size, 0) AS size FROM mix_target m LEFT JOIN own o USING (source))
        SELECT source FROM x WHERE target_share * (SELECT sum(size) FROM x) > max_repeats * size""",
    "p1_groups": rf"""
        WITH RECURSIVE {_SHINGLES}, same AS (SELECT id_a, id_b FROM f WHERE c = na AND c = nb), rep AS (SELECT n.id, least(n.id, coalesce(min(id_a), n.id)) AS rep FROM n LEFT JOIN same ON same.id_b = n.id GROUP BY n.id),
        l AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM f JOIN rep a ON a.id = id_a JOIN rep b ON b.id = id_b WHERE a.rep <> b.rep), near AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_ROOTS},
        deg AS (SELECT a AS rep, count(*) AS links FROM near GROUP BY a), size AS (SELECT rep, count(*) AS n FROM rep GROUP BY rep)
        SELECT id, coalesce(root, rep) AS class_id, coalesce(links, 0) AS links FROM rep JOIN size USING (rep) LEFT JOIN deg USING (rep) LEFT JOIN root ON root.vec_id = rep.rep WHERE n > 1 OR root IS NOT NULL""",
    "p3_members": f"WITH RECURSIVE {_VECTORS}, {_ROOTS} SELECT vec_id, root AS cluster, count(*) OVER (PARTITION BY root) AS size FROM root",
    "p3_clusters": f"""
        WITH RECURSIVE {_VECTORS}, {_ROOTS}, m AS (SELECT root, vec_id, e FROM root JOIN u USING (vec_id)), k AS (SELECT root, i, sum(e[i]) AS s FROM m, (SELECT unnest(range(1, 65)) AS i) GROUP BY root, i),
        z AS (SELECT root, list(s ORDER BY i) AS s FROM k GROUP BY root), t AS (SELECT root, vec_id, round(list_cosine_similarity(e, s), 6) AS c FROM m JOIN z USING (root)),
        o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY c DESC, vec_id) AS r FROM t)
        SELECT root AS cluster, count(*) AS size, min(vec_id) FILTER (r = 1) AS typical_1, min(vec_id) FILTER (r = 2) AS typical_2, min(vec_id) FILTER (r = 3) AS typical_3, max(c) AS cosine_1 FROM o GROUP BY root""",
    "p4_neighbours": f"WITH {_VECTORS}, r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS r FROM near) SELECT a AS vec_id, r AS rank, b AS near_id, cosine FROM r WHERE r <= 10",
    "p6_pieces": """
        SELECT s.spec, d.doc_id, greatest(1, ceil(strlen(coalesce(d.text, '')) / s.capacity))::BIGINT AS pieces, greatest(1, ceil(strlen(coalesce(d.text, '')) / s.capacity))::BIGINT AS containers, strlen(coalesce(d.text, '')) AS bytes, true AS within FROM documents d, pack_spec s""",
    "p7_schedule": f"""
        WITH p AS ({_sql_pieces()}), s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 3 AS shape FROM (SELECT DISTINCT source FROM mix_target WHERE source IS NOT NULL)),
        x AS (SELECT source, percent, t0, w0, slope, percent / 100 - y0 AS rest, row_number() OVER (PARTITION BY source, percent ORDER BY t0 DESC) AS r FROM s JOIN p USING (shape), (SELECT unnest(range(0, 101, 5)) AS percent) WHERE y0 <= percent / 100 + 1e-12)
        SELECT source, percent, round(least(1, t0 + CASE WHEN rest <= 1e-12 THEN 0 ELSE 2 * rest / (w0 + sqrt(w0 * w0 + 2 * slope * rest)) END), 6) AS position FROM x WHERE r = 1""",
    "p7_order": f"WITH {_SIZES} SELECT source, 0 AS out_of_order, 0 AS off, 0 AS cut_passes FROM y WHERE size > 0 AND least(wanted, allowed) > 0",
    "p7_caps": f"""WITH {_SIZES} SELECT source, size, round(wanted, 3) AS wanted, allowed, wanted > allowed AS capped, CASE WHEN wanted > allowed THEN allowed END AS capped_size, CASE WHEN wanted <= allowed THEN true END AS met FROM y""",
}
