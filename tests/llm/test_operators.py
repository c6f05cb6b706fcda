"""The training-data operators against brute force on small fixtures, and their edge cases."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import clusters, codes, mixing, neardup, neighbours, packing, quality, residue, subjects
from lodestone.llm.common import components, latest
from lodestone.llm.quality_examples import ENGLISH, labelled

WORDS = "alder birch cedar daisy elm fern gorse hazel iris juniper kelp larch maple nettle oak pine quince rowan sedge thyme umber violet willow yarrow zinnia".split()


def shingles(text, width):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def texts(n, seed=0):
    """Groups of a text and edited copies of it, exact copies among them."""
    r = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = [f"{WORDS[r.integers(25)]}{r.integers(40)}" for _ in range(60)]
        for _ in range(r.integers(1, 5)):
            t = list(base)
            for _ in range(r.integers(0, 9)):
                t[r.integers(60)] = WORDS[r.integers(25)]
            out.append(" ".join(t))
    return out[:n]


# -- near-duplicates ------------------------------------------------------------


def test_masks_cover_every_pair_of_differences():
    assert neardup.LINES.shape == (7, 3)
    for d in itertools.combinations(range(7), 2):
        assert any(not set(d) & set(line) for line in neardup.LINES.tolist())


def test_pairs_match_brute_force(spark):
    t = texts(160)
    docs = spark.createDataFrame(list(enumerate(t)), "id long, text string").withColumn("rep", F.lit(1)).withColumn("s", F.lit("x"))
    got = {tuple(r) for r in neardup.expand_pairs(*neardup.near_duplicates(docs, F.col("text"), width=3, least_words=20, similarity=0.5)).collect()}
    s = [shingles(x, 3) for x in t]
    want = {(a, b) for a, b in itertools.combinations(range(len(t)), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.5}
    assert not got - want
    assert len(got & want) >= 0.99 * len(want)


def test_hot_buckets_and_groups_are_paired_in_blocks(spark, monkeypatch):
    """Variants of one page share buckets; copies of one text share a representative."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    r = np.random.default_rng(7)
    base = [f"{WORDS[r.integers(25)]}{r.integers(40)}" for _ in range(80)]
    t = [" ".join([*base[:70], *(WORDS[r.integers(25)] for _ in range(10))]) for _ in range(150)] + [" ".join(base)] * 50 + texts(40, 3)
    docs = spark.createDataFrame(list(enumerate(t)), "id long, text string")
    classes, links = neardup.near_duplicates(docs, F.col("text"), width=3, least_words=20, similarity=0.5)
    got = [tuple(x) for x in neardup.expand_pairs(classes, links).collect()]
    s = [shingles(x, 3) for x in t]
    want = {(a, b) for a, b in itertools.combinations(range(len(t)), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.5}
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got) & want) >= 0.99 * len(want) > 15_000


def test_near_duplicate_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None, 1), (2, "", 1), (3, "too short", 1), (None, "a " * 40, 1), (4, long, 1), (5, long, 1), (5, long, 1), (6, long, 1), (6, "now something else entirely " * 3, 2), (7, long + " end", None)]
    docs = spark.createDataFrame(rows, "id long, text string, ts long")
    classes, links = neardup.near_duplicates(docs, F.col("text"), ts_col="ts")
    assert {tuple(r) for r in classes.where("id in (4, 5)").collect()} == {(4, 4), (5, 4)}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(4, 7)}
    g = {r["id"]: (r["class_id"], r["links"]) for r in neardup.groups(classes, links).collect()}
    assert g == {4: (4, 1), 5: (4, 1), 7: (4, 1)}
    empty = docs.limit(0)
    classes, links = neardup.near_duplicates(empty, F.col("text"), ts_col="ts")
    assert classes.count() == 0 and neardup.expand_pairs(classes, links).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(docs, F.col("text"), similarity=0.2)


def test_words_are_runs_of_letters_and_digits():
    _, starts, part = neardup.shingle_hashes(["a b c d", "x\xady_z Ⅷ², é", "a"], 3, 4)
    assert part.tolist() == [True, True, False] and len(starts) == 2  # x, y, z, Ⅷ², é


def test_components(spark):
    e = [(1, 2), (2, 3), (10, 11), (5, 5), (12, 11), (3, 4), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_latest_row(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (None, "d", 9), (2, "c", None)], "k long, v string, t long")
    assert {tuple(r) for r in latest(df, "k", "t").collect()} == {(1, "b", 2), (2, "c", None)}


# -- quality ----------------------------------------------------------------------


def test_rules_tell_held_out_documents(spark):
    rows = labelled(60, seed=99)
    got = quality.classify(spark.createDataFrame(rows, "label string, text string")).select("label", "kind").collect()
    assert sum(r["label"] == r["kind"] for r in got) / len(got) > 0.9


def test_rules_hold_on_texts_of_another_hand(spark):
    """Texts written by hand, in languages and layouts that the generator doesn't have too."""
    texts = {
        "prose": [
            "The ferry leaves at nine, or so the timetable claims. In practice the captain waits until the last crate of fish is on board, and nobody minds: there is coffee, a bench in the sun, and usually somebody who knows a story about the lighthouse.",
            "Le matin, la brume couvre encore les champs et l'on n'entend que les corneilles. Puis le soleil se lève, les volets s'ouvrent, et le village reprend peu à peu ses habitudes.",
            "Am Abend saßen wir noch lange im Garten. Es war warm, die Grillen zirpten, und mein Großvater erzählte zum dritten Mal, wie er den Zug nach Wien verpasst hatte.",
            "Nel cortile della scuola i bambini giocavano a pallone. La maestra li guardava dalla finestra e pensava che l'estate non sarebbe durata ancora a lungo.",
            "“You're late,” she said.\n“I know. The bridge was closed.”\n“It was open when I came over it.”\n“Then it closed behind you,” he said, and sat down without taking off his coat.",
            "Revenue rose by 4.2 percent to 318 million in 2019, while costs, at 291 million, were 3 million below those of 2018; the board proposes a dividend of 1.10 a share, after 0.95 in the year before.",
        ],
        "list": ["- milk\n- two loaves of bread\n- washing powder\n- batteries (AA)\n- apples\n- stamps\n- string\n", "1. Ada Brandt\n2. Jules Moreau\n3. Pia Lindqvist\n4. Tomás Ibarra\n5. Wen Li\n6. Noor Haddad\n7. Ian Petrie\n"],
        "table": ["station|open|height|trains\nLorrach|1862|294|41\nHausen|1862|403|38\nZell|1876|426|38\nWehr|1890|366|12\n", "city,population,area,founded\nBrno,380681,230,1243\nOstrava,284765,214,1267\nOlomouc,100514,103,1055\n"],
        "junk": ["#@!! ~~~~ %%^^ &*&*&* ((( ))) ___---=== ///\\\\\\ $$$$ ^^^^ ~~", "a9f3c2e1b7d8440012ffacbe9981aa7b3c4d5e6f7a8b9c0d1e2f3a4b5c6d7e8f90123456789abcdef", "Ã¼Ã¶Ã¤ â€œÃ©â€ Ã¨Â£Â¥Â§ Ã¢â‚¬ ï¿½ï¿½ Ã¼Ã¼Ã¶ Ã±Ã³ Â¿Â¡ Ã©Ã©Ã© â€™â€™ Ã¼Ã¶"],
    }
    rows = [(k, t) for k, v in texts.items() for t in v]
    got = quality.classify(spark.createDataFrame(rows, "label string, text string")).select("label", "kind").collect()
    assert sum(r["label"] == r["kind"] for r in got) >= len(rows) - 1, [tuple(r) for r in got]


def test_induction_learns_a_band_and_exports_sql(spark):
    x = np.random.default_rng(0).random((600, len(quality.STATISTICS)))
    y = np.where((x[:, 2] > 0.4) & (x[:, 2] < 0.6), "table", "prose")
    case = quality.to_case(quality.induce(x, y))
    df = spark.createDataFrame(pd.DataFrame(x, columns=quality.STATISTICS))
    kinds = [r[0] for r in df.select(F.expr(case)).collect()]
    assert np.mean(np.array(kinds) == y) > 0.95
    assert quality.to_case([]) == "'prose'"


def test_statistics_by_hand(spark):
    r = quality.statistics(spark.createDataFrame([("The cat sat.\nA dog, 12!",)], "text string")).first()
    assert (r["words"], r["size"]) == (5, 18)
    assert r["mean_word"] == pytest.approx(13 / 5, abs=1e-5) and r["digits"] == pytest.approx(2 / 18, abs=1e-5)
    assert r["end_lines"] == 1.0 and r["common"] == pytest.approx(2 / 5) and r["distinct"] == 1.0


def test_quality_edge_cases(spark):
    rows = [(None, 1), ("", 2), (" \xa0\n", 3), ("x" * 300_000, 4), (" " * 100_000 + "|", 5), ("The end of it was the end of it.", 6)]
    df = spark.createDataFrame(rows, "text string, words int").withColumns({c: F.lit(7) for c in ("_t", "_l", "_n", "kind", "size")})
    got = quality.classify(df).collect()
    assert [r["kind"] for r in got[:3]] == ["blank"] * 3 and got[5]["kind"] == "prose" and got[0]["_t"] == 7
    assert quality.classify(df.limit(0)).count() == 0


# -- vectors ------------------------------------------------------------------------


def cloud(groups, size, noise, dim=64, spread=0.05, seed=1):
    r = np.random.default_rng(seed)
    c = r.standard_normal((groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([(c[:, None] + spread * r.standard_normal((groups, size, dim))).reshape(-1, dim), r.standard_normal((noise, dim))]).astype(np.float32)
    return x[r.permutation(len(x))]


def vectors_of(spark, x):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>")


def cosines(x):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def brute_top(x, k, least):
    s = cosines(x)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        near = [j for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least]
        out |= {(i, int(j)) for j in near}
    return out


def test_neighbours_match_brute_force(spark):
    x = cloud(30, 40, 800)
    x[5] = x[77]
    x[6] = x[77]
    got = {(r["vec_id"], r["near_id"]) for r in neighbours.similar_vectors(vectors_of(spark, x)).collect()}
    want = brute_top(x, 10, 0.8)
    assert len(got & want) / len(want) > 0.99 and len(got & want) / len(got) > 0.99


def at_cosine(cosine, n, dim=64, seed=3):
    """Two arrays of unit vectors, row by row at this cosine."""
    r = np.random.default_rng(seed)
    a, b = (r.standard_normal((n, dim)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("rows", [10_000, 122_000, 1_200_000, 12_000_000])
def test_pairs_meet_at_every_number_of_rows(spark, rows):
    a, b = at_cosine(0.8, 4000)
    packed = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "x": [v.tobytes() for v in a.astype(np.float32)]}), "id long, x binary")
    index = codes.MultiIndex.fit(packed, rows, 64, neighbours.TABLES)
    assert (index.keys(a) == index.keys(b)).any(1).mean() > 0.96
    assert rows / 2**index.width <= 2 * codes.BUCKET_ROWS  # buckets don't grow either


def test_any_threshold_has_an_index(spark):
    assert codes.tables_for(8, 1.0) == 1 and codes.tables_for(0, 0.8) == 1 and codes.tables_for(8, -1.0) == np.inf
    x = cloud(3, 5, 20)
    got = {(r["vec_id"], r["near_id"]) for r in neighbours.similar_vectors(vectors_of(spark, x), k=4, least=-1.0).collect()}
    assert got == brute_top(x, 4, -1.0)


def test_many_copies_and_scaled_vectors(spark):
    x = cloud(3, 5, 20)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0), 3 * x[1:2]])
    got = {(r["vec_id"], r["near_id"]) for r in neighbours.similar_vectors(vectors_of(spark, x), k=4).collect()}
    assert got == brute_top(x, 4, 0.8)


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    x = cloud(1, 400, 30)
    monkeypatch.setattr(codes, "BLOCK_ROWS", 64)
    got = {(r["vec_id"], r["near_id"]) for r in neighbours.similar_vectors(vectors_of(spark, x), k=3).collect()}
    want = brute_top(x, 3, 0.8)
    assert len(got & want) / len(want) > 0.98


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    ok = [1.0] + [0.0] * 63
    rows = [(1, ok, 1), (2, ok, 1), (2, None, 2), (3, ok[:5], 1), (4, [nan] * 64, 1), (5, [inf] + ok[1:], 1), (6, [0.0] * 64, 1), (7, [None] + ok[1:], 1), (None, ok, 1), (8, [2.0] + ok[1:], 1), (9, [1e-30] + ok[1:], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ts long").withColumn("x", F.lit(1)).withColumn("id", F.lit("clash"))
    got = {(r["vec_id"], r["near_id"]) for r in neighbours.similar_vectors(df, ts_col="ts").collect()}
    assert got == {(a, b) for a in (1, 8, 9) for b in (1, 8, 9) if a != b}
    c = clusters.cluster(df, ts_col="ts")
    assert {(r["vec_id"], r["cluster"]) for r in c.members().collect()} == {(1, 1), (8, 1), (9, 1)}
    empty = df.limit(0)
    assert neighbours.similar_vectors(empty, ts_col="ts").count() == 0
    assert clusters.cluster(empty, ts_col="ts").members().count() == 0
    with pytest.raises(ValueError):
        neighbours.similar_vectors(df, k=0)


def test_short_forms_bound_the_error():
    x = cloud(5, 20, 300)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    p = codes.shortened(u, np.arange(len(u)))
    f = p["q"] * p["scale"][:, None].astype(np.float64)
    assert p.dtype.itemsize == 80 and (np.linalg.norm(f - u, axis=1) <= p["off"]).all()
    assert (np.abs(f @ f.T - u @ u.T) <= (p["off"][:, None] + p["off"]) * 1.02).all()


def chains(x, least):
    s = cosines(x) >= least
    label = np.arange(len(x))
    while True:
        new = np.array([label[s[i]].min() for i in range(len(x))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("block", [4096, 128])
def test_clusters_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
    monkeypatch.setattr(clusters, "NODE_ROWS", 2 * block)
    monkeypatch.setattr(clusters, "SAMPLE_ROWS", 300)
    x = cloud(25, 20, 400, seed=2)
    x[3] = x[11]
    label = chains(x, 0.8)
    n = np.bincount(label)
    want = {(i, int(label[i])) for i in range(len(x)) if n[label[i]] > 1}
    c = clusters.cluster(vectors_of(spark, x))
    assert {(r["vec_id"], r["cluster"]) for r in c.members().collect()} == want
    leaves = c.leaves().collect()
    assert all(r["typical_1"] is not None and r["size"] > 1 for r in leaves)


def test_hot_clusters_are_never_compared_as_a_whole(spark, monkeypatch):
    """A third of all vectors in one tight group, and as many in the same direction exactly."""
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 64)
    monkeypatch.setattr(clusters, "NODE_ROWS", 128)
    monkeypatch.setattr(clusters, "SAMPLE_ROWS", 600)
    r = np.random.default_rng(3)
    one = r.standard_normal(64)
    tight = one + 0.02 * r.standard_normal((600, 64))
    same = np.outer(np.linspace(1, 9, 600), r.standard_normal(64))
    x = np.concatenate([tight, same, cloud(10, 20, 400, seed=5)]).astype(np.float32)
    x = x[r.permutation(len(x))]
    label = chains(x, 0.8)
    n = np.bincount(label)
    c = clusters.cluster(vectors_of(spark, x))
    assert {(m["vec_id"], m["cluster"]) for m in c.members().collect()} == {(i, int(label[i])) for i in range(len(x)) if n[label[i]] > 1}
    packed, _ = neighbours.distinct_vectors(vectors_of(spark, x), 64, "vec_id", "embedding", None)
    nodes, cliques = clusters.parted(packed, len(x), 64, 0.8)
    assert nodes.groupBy("node").count().agg(F.max("count")).first()[0] <= 128
    assert cliques.count() > 500 and nodes.count() + cliques.count() == len(x)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for d in c.clusters().collect():
        own = np.flatnonzero(label == d["cluster"])
        centre = u[own].sum(0)
        cos = np.round(u[own] @ centre / np.linalg.norm(centre), 6)
        assert d["size"] == len(own) and d["typical_1"] == own[np.lexsort((own, -cos))[0]] and d["cosine_1"] == pytest.approx(cos.max(), abs=2e-6)


def test_trees_part_by_dispersion():
    x = cloud(6, 40, 0, seed=8, spread=0.02).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    t = clusters.grow(u, 100, 5, clusters.compactness(0.8))
    leaf = t.route(u)
    label = chains(x.astype(np.float32), 0.8)
    assert len(set(zip(leaf, label))) == len(set(leaf)) == 6 and t.centres.any(1).all()  # compact leaves, one a group
    one = clusters.grow(np.tile(u[:1], (50, 1)), 100, 5, 2.0)
    assert not len(one.split) and (one.route(u) == 0).all()


def test_chains_longer_than_a_leaf(spark):
    """Vectors along an arc: neighbours are similar, the ends are not."""
    a = np.arange(0, 3.1, 0.2)
    x = np.zeros((len(a), 64), np.float32)
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    c = clusters.cluster(vectors_of(spark, x))
    assert {r["cluster"] for r in c.members().collect()} == {0}
    assert sorted(tuple(r) for r in clusters.consecutive(c.members(), width=5).collect()) == [(i, i + 1) for i in range(len(a) - 1)]


def test_wide_leaves_on_either_side_of_a_plane(spark, monkeypatch):
    """Couples of wide leaves, centres 83 degrees apart, each joined by one link of cosine 0.83."""
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 128)
    monkeypatch.setattr(clusters, "NODE_ROWS", 256)
    monkeypatch.setattr(codes, "BUCKET_ROWS", 8)
    r = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
        at = lambda t: np.cos(t) * a + np.sin(t) * b
        for centre, tip in ((at(0), at(0.43)), (at(1.45), at(1.02))):
            rows.append(tip)
            for _ in range(11):
                way = r.standard_normal(64)
                way -= (way @ centre) * centre
                rows.append(np.cos(0.43) * centre + np.sin(0.43) * way / np.linalg.norm(way))
    x = np.array(rows, np.float32)
    label = chains(x, 0.8)
    assert len(np.unique(label)) == 60
    got = {(m["vec_id"], m["cluster"]) for m in clusters.cluster(vectors_of(spark, x)).members().collect()}
    assert got == {(i, int(label[i])) for i in range(len(x))}


# -- subjects ---------------------------------------------------------------------------


def about(areas, r, sentences=8):
    out = []
    for i in range(sentences):
        terms = subjects.INSPECTED[areas[i % len(areas)]].split()
        out.append(f"The {terms[r.integers(len(terms))]} of the {terms[r.integers(len(terms))]} was {['narrow', 'plain', 'odd'][r.integers(3)]} and the {terms[r.integers(len(terms))]} had it.")
    return " ".join(out)


def test_subjects_of_made_documents(spark):
    r = np.random.default_rng(4)
    areas = sorted(subjects.INSPECTED)
    truth, rows = {}, []
    for i in range(1200):
        own = [areas[i % 10]] if i % 7 else [areas[i % 10], areas[(i + 1) % 10]]
        truth[i] = set(own)
        rows.append((i, None if i % 5 else "Title", about(own, r)))
    rows += [(9000, "t", None), (9001, None, " "), (None, "x", rows[0][2]), (9002, None, "l e t t e r s a p a r t " * 20), (9003, "a", "The window had a garden and the bench was narrow. " * 2)]
    labels = [(i, a) for i in range(0, 1200, 4) for a in truth[i]] + [(None, "law"), (1, "unknown")]
    docs = spark.createDataFrame(rows, "id long, title string, text string").withColumn("share", F.lit(1)).withColumn("area", F.lit("x"))
    got: dict = {}
    for x in subjects.assign(docs, spark.createDataFrame(labels, "id long, area string"), areas).collect():
        got.setdefault(x["id"], set()).add(x["area"])
    assert np.mean([got.get(i) == truth[i] for i in truth]) > 0.95
    assert not {9000, 9001, 9002, 9003, None} & got.keys()
    assert subjects.assign(docs.limit(0), spark.createDataFrame(labels, "id long, area string"), areas).count() == 0


def test_length_alone_breaks_no_text():
    """A novel's worth of words has few different ones; it still has a language and a subject."""
    r = np.random.default_rng(8)
    english = "the of and to in that was his it with as her had for at".split()
    words = [english[r.integers(15)] if r.random() < 0.4 else f"w{WORDS[r.integers(25)]}{WORDS[r.integers(25)]}{WORDS[int(25 * r.random() ** 3)]}" for _ in range(120_000)]
    assert len(set(words)) < 0.15 * len(words)
    assert not subjects.broken(words, set(words))
    assert subjects.main_language(words, set(words)) == subjects.main_language(words[:300], set(words[:300])) != "-"
    for again in (["word"] * 120_000, words[:300] * 400, [WORDS[i] for i in r.integers(0, 25, 120_000)], list("abcdefgh") * 9000, ["so"] * 70_000 + words[:30_000]):
        assert subjects.broken(again, set(again))
    assert not subjects.broken(words[:2001], set(words[:2001]))
    for n in (21, 500, 1999):
        assert subjects.broken(["word", "again"] * (n // 2 + 1), {"word", "again"})


def test_long_documents_have_subjects(spark):
    r = np.random.default_rng(9)
    areas = sorted(subjects.INSPECTED)
    docs = [(i, "", about([areas[i % 10]], r), areas[i % 10]) for i in range(600)]
    prose = lambda n: " ".join(WORDS[r.integers(25)] + WORDS[r.integers(25)] for _ in range(n))
    docs += [(600 + i, "", " ".join(f"{about([areas[i]], r, 1)} {prose(12)}." for _ in range(1500)), areas[i]) for i in range(10)]
    df = spark.createDataFrame([d[:3] for d in docs], "id long, title string, text string")
    labels = spark.createDataFrame([(d[0], d[3]) for d in docs[:200]], "id long, area string")
    got = {(x["id"], x["area"]) for x in subjects.assign(df, labels, areas).where("id >= 600").collect()}
    assert got == {(d[0], d[3]) for d in docs[600:]}


def test_inference_and_mapping():
    beta = subjects.normalised(np.array([[9.0, 0], [8, 0], [0, 9], [0, 7]]))
    got, _ = subjects.infer(np.array([0, 0, 2]), np.array([0, 1, 2]), np.array([3.0, 2, 4], np.float32), 3, beta)
    assert got[0].argmax() == 0 and got[1].sum() == 0 and got[2].argmax() == 1
    assert subjects.map_topics(beta, ["a", "b", "c", "d"], {"x": "a b", "y": "c d"}, top=2, least=2) == ["x", "y"]
    assert subjects.language(set("der hund und die katze ist im haus".split())) == "de"


# -- packing --------------------------------------------------------------------------------


def test_placements_are_whole_and_fit():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 1001, 3000)
    hist = {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True))}
    places, used = packing.plan_placements(hist, 1000)
    load = np.zeros(used, int)
    seen: dict = {}
    for length, rank, count, first in places:
        load[first : first + count] += length
        seen.setdefault(length, []).append((rank, count))
    assert load.max() <= 1000 and load.sum() == sizes.sum()
    for length, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) == hist[length]
    assert 1 - sizes.sum() / (used * 1000) < 0.02
    assert packing.plan_placements({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan_placements({11: 1}, 10)


def test_equal_lengths_share_packs():
    places, used = packing.plan_placements({300: 10}, 1000)
    assert used == 4 and sum(c for _, _, c, _ in places) == 10


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BUCKET_ROWS", 40)  # the 200 items of 60 are salted
    rows = [(i, s) for i, s in enumerate([0, None, 100, 101, 250, 1000, 35] + [60] * 200)] + [(None, 10), (3, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, size long").withColumn("length", F.lit(9)).withColumn("rank", F.lit(9))
    got = packing.pack(docs, 100).toPandas()
    assert got["length"].sum() == sum(s or 0 for _, s in rows)
    assert packing.fill(packing.pack(docs, 100), 100).where("used > 100").count() == 0
    assert set(got[got["pieces"] > 1]["doc_id"].dropna()) == {3, 4, 5}
    five = got[got["doc_id"] == 5]
    assert sorted(five["piece_no"]) == list(range(10)) and five["container"].nunique() == 10
    assert packing.pack(docs.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, 0)


# -- mixing -----------------------------------------------------------------------------------


def test_mix_reaches_shares_and_caps_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 30)
    rows = [(i, "big", 10) for i in range(600)] + [(1000 + i, "small", 10) for i in range(60)] + [(2000, "tiny", 40), (2001, "other", 999), (2002, None, 5), (2003, "big", None), (2004, "big", 0), (None, "big", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("total", F.lit(1))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 5), ("tiny", 0.1, 2), ("gone", 0.0, 3), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mixing.report(docs, targets).collect()}
    total = 6010 + 600 + 40
    assert r["tiny"]["capped"] and r["tiny"]["mixed_size"] == 80 and r["tiny"]["repeats"] == 2
    assert not r["big"]["capped"] and abs(r["big"]["mixed_size"] - 0.6 * total) <= 10
    assert abs(r["small"]["mixed_size"] - 0.3 * total) <= 10 and r["gone"]["mixed_size"] == 0
    m = mixing.mix(docs, targets).toPandas()
    assert m["position"].between(0, 1).all() and m["repeat"].max() == 3
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert {x["source"] for x in mixing.report(docs.limit(0), targets).collect()} == {"big", "small", "tiny", "gone"}


def test_schedules_move_sources_in_time(spark):
    docs = spark.createDataFrame([(i, "abcd"[i % 4], 5) for i in range(800)], "doc_id long, source string, size long")
    targets = spark.createDataFrame([(c, 0.25, 1) for c in "abcd"], "source string, target_share double, max_repeats int")
    points = [("a", 0.0, 2.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 1.0, 2.0), ("c", 0.0, 0.0), ("c", 0.5, 0.0), ("c", 0.75, 4.0), ("d", -1.0, 3.0), ("d", 9.0, None), ("e", 0.5, 1.0), (None, 0.1, 1.0)]
    m = mixing.mix(docs, targets, spark.createDataFrame(points, "source string, t double, weight double")).toPandas()
    at = m.groupby("source")["position"]
    assert at.mean()["a"] == pytest.approx(1 / 3, abs=0.02) and at.mean()["b"] == pytest.approx(2 / 3, abs=0.02)
    assert at.min()["c"] >= 0.5 and (m[m["source"] == "c"]["position"] > 0.75).mean() == pytest.approx(2 / 3, abs=0.02)
    assert (m.sort_values(["source", "offset"]).groupby("source")["position"].diff().dropna() >= 0).all() and m["position"].between(0, 1).all()
    # the cumulated weight at a document's position is its share of the stream
    d = m[m["source"] == "d"]
    assert np.allclose(1 - (1 - d["position"]) ** 2, d["offset"] / 1000, atol=1e-9)
    flat = mixing.mix(docs, targets).toPandas()
    assert np.allclose(flat["position"], flat["offset"] / 1000)
    s = mixing.over_time(mixing.mix(docs, targets), 4).toPandas()
    assert len(s) == 16 and np.allclose(s.groupby("slice")["share"].sum(), 1)


# -- residue --------------------------------------------------------------------------------------

ARTICLE = "\\documentclass{article}\n\\newcommand{\\todo}[1]{\\textcolor{red}{#1}}\n\\begin{document}\n\\title{%s}\n\\section{Introduction}\n%s\n\\end{document}"


@pytest.mark.parametrize("body", [
    "{{ main content }}", "[[Write your abstract here]]", "<<SECTION TEXT>>", "Text. <Start writing here> More.", "@@intro paragraph@@", "***Firstname Lastname***", "(( your affiliation ))", "\\_\\_Insert\\_title\\_\\_", "\\$\\{abstract\\}",
    "#\\{Titel hier einfügen\\}", "??? to be filled in ???", "$\\langle$author name$\\rangle$", "{\\bf [Your Name]}", "\\textit{(INTRO PARAGRAPH)}", "\\todo{section text}", "TBD", "xxx xxx xxx", "Click or tap here to enter text.", "[texto pendiente]",
    "\\author{Nome do autor aqui}", "\\caption{Insérer la légende ici}", "\\title{ここにタイトルを入力}", "\\title{Paper Title}", "\\author{Author Name}", "{{ inserire titolo }}", "{{ customer }}", "[FUNDING AGENCY]", "<Corresponding Author Name>", "$FIGURE\\_CAPTION$", "{customer\\_name}", "[[grant_number]]", "[Insert here in no more than thirty words what was found and why it matters for all who work on it now or later]",
    "\\lipsum[2-4]", "\\blindtext", "Lorem ipsum dolor sit amet consectetur adipiscing.", "More dummy text follows to make the page longer.", "bla bla bla bla bla bla bla bla bla bla", "(placeholder)", "{{rÃ©sumÃ© ici}}",
])
def test_residue_is_found(body):
    assert residue.find(ARTICLE % ("On Things", body))


@pytest.mark.parametrize("body", [
    # an example of every grammar, alone in a text: nothing may stand before the grammars that knows less than they
    "{{title}}", "\\{\\{title\\}\\}", "{{{{{title}}}}}", "[[title]]", "<<title>>", "@@title@@", "***title***", "((title))", "__title__", "______title______", "\\_\\_title\\_\\_", "${title}", "#{title}", "\\#\\{title\\}", "???title???", "\\%\\%TITLE\\%\\%",
    "[...] title [...]", "[…] title […]", "[\\dots] title [\\ldots]", "{\\bf [title]}", "{\\bfseries[title]}", "{\\itshape [title]}", "\\textbf{[title]}", "\\emph{ [title]}", "\\textsl{(title)}", "\\textbf{ (title)}", "\\todo{title}", "\\todo[inline]{title}", "[title]", "<title here>", "$\\langle$title$\\rangle$", "\\textless title\\textgreater",
    "TBD", "TBA", "T.B.D.", "t.b.d.", "TODO: more", "FIXME", "To be determined", "Coming soon.", "xxx xxx", "XXXXX", "(Platzhalter)", "Tap here to add text", "Insert abstract here", "Your title goes here",
    "\\lipsum[1]", "\\kant", "\\zblindtext", "Item two of the sample text", "Line B of the dummy text", "This is a test paragraph", "This is a test sentence", "This is placeholder text", "More filler text follows", "It has no meaning and only fills", "These lines only fill the space",
    "Nothing in these lines is meant to be read", "They only show the width of the column", "Replace this text before you submit", "The quick brown fox jumps over the lazy dog", "Hier ist ein Fülltext", "Der Absatz zwei des Beispieltextes", "Ceci est un faux texte", "Voici texte factice", "Este es un texto simulado",
    "na,na,na,na,na,na,na,na", "Bla bla bla bla bla bla bla bla", "lorem ipsum dolor sit amet", "adipiscing elit sed eiusmod tempor",
])
def test_every_grammar_is_reached(body):
    assert residue.slot(residue.own_content(body)) or residue.filler(residue.own_content(body))
    assert residue.find(body)
    assert residue.find(f"We study graphs.\n\n{body}\n\nMore prose.")


@pytest.mark.parametrize("body", [
    "Plain text of an article with $a < b$ and $b > c$.", "% {{ main content }}", "\\begin{comment}\n[[abstract]]\n\\end{comment}", "\\iffalse Lorem ipsum dolor sit amet consectetur.\\fi", "\\begin{verbatim}\nDear {{ user_name }}\n\\end{verbatim}",
    "Typographers have long used lorem ipsum as dummy text; we measure it.", "Annotators marked placeholders such as ``Your Title Here'' in 12 theses.", "About 4 percent of readers had JavaScript disabled, so the form asked them to enable scripts.",
    "\\section{Results and Discussion}", "\\section{Summary of Methods}", "The missions of [NASA ESA] and [WHO].", "$N_{MAX}$ and $x^{max_min}$ at \\label{sec_one} and \\ref{fig_two}.", "“" + "A long quotation. " * 60 + "{{ your title here }}”", "\\author{J. Doe}", "\\title{Title insurance in the nineteenth century}",
    "We write $[[\\hat{\\theta}]]$ for the ring.", "Links returned \\texttt{404 Not Found} and were left out.", "\\input{missing}", "\\begin{thebibliography}{1}\\bibitem[Doe(2001)]{doe} J. Doe. {{DNA}} repair.\\end{thebibliography}", "See \\cite[section 2]{doe} and [12].",
])
def test_articles_about_it_are_not(body):
    assert residue.find(ARTICLE % ("On Things", body)) is None


@pytest.mark.parametrize("text", [
    "404 Not Found", "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1><p>The server did not answer in time.</p></body></html>", "Please enable JavaScript to view this document. Reload the page afterwards.",
    "\\documentclass{article}\n\\begin{document}\nPage not found\nTry searching instead.\n\\end{document}", "Esta página necesita permitir scripts. Después recargue la página.", '{"status": 503, "message": "Zugriff verweigert"}',
    'Traceback (most recent call last):\n  File "/srv/a.py", line 3, in f\nValueError: bad', "! LaTeX Error: File `a.sty' not found.\n\nEmergency stop.",
])
def test_messages(text):
    kind, _ = residue.find(text)
    assert kind == "message"


@pytest.mark.parametrize("text", [
    "The requested resource has been removed. Go back to the previous page.", "La página solicitada ya no existe. Vuelva al inicio.", "La risorsa richiesta non è disponibile. Torna alla pagina precedente.", "La page demandée a été supprimée. Revenez à l'accueil.",
    "お探しのページは見つかりませんでした。", "Запрошенная страница не найдена. Вернитесь на главную.", "We could not load this document. Refresh and retry.", "A página não foi encontrada.", "De pagina is verwijderd. Ga terug.", "请求的页面不存在。请返回首页。",
])
def test_messages_in_any_language(text):
    kind, _ = residue.find(text)
    assert kind == "message"


@pytest.mark.parametrize("text", [
    "We thank the librarians for access to the files.", "The server room was cold, and nobody had an answer. He waited by the window until the rain had stopped.", "This page was left blank by the printer of 1742, whose accounts are lost.",
    "The link between the two towns was moved in 1911. Farmers had asked for it. The valley has had no trains since, and the station is a school. " * 3,
])
def test_short_prose_is_no_message(text):
    assert residue.find(text) is None


def test_residue_edge_cases(spark):
    slow = ["{" * 200_000, "((" * 100_000, "a" * 300_000, "<" * 100_000, "[[" + " " * 100_000, "word " * 3 + "x" * 100_000, "\\begin{verbatim}" * 5000, "%" * 100_000]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Page not found"), (4, "Page not found"), (None, "{{ body }} and more. " * 3)] + [(10 + i, t) for i, t in enumerate(slow)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("title", F.lit(None).cast("string")).withColumn("kind", F.lit(1))
    got = residue.residue(df).collect()
    assert [r["doc_id"] for r in got].count(4) == 2 and not {1, 2, 3} & {r["doc_id"] for r in got}
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.without_residue(df).where("doc_id = 4").count() == 0


def test_examples_are_reproducible():
    assert labelled(5, 1) == labelled(5, 1) and len(ENGLISH) > 5
