"""Near-duplicate records: covering locality-sensitive hashing over min-hash symbols.

A record's set R of word shingles is sketched by min-hash symbols; two symbols are
equal with probability J, the Jaccard similarity. The symbols are cut into bands
of seven positions, and each band is hashed under seven structured masks: the
lines of the projective plane of order 2 (Fano plane), each keeping three
positions. Two points meet at most five of the seven lines, so for every pair
whose sketches differ in at most two positions of a band some mask avoids all
differences: the pair is guaranteed to collide in that table. Over B bands every
pair that differs in at most 3 B - 1 of 7 B positions collides (pigeonhole); most
pairs that differ in more still do. Every candidate is then checked on the exact
shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import components, in_blocks, pair_once

BANDS = 7
SYMBOLS = 7 * BANDS
SIGN_BITS = 64
#: Candidates that differ in more sign bits are dropped: at J = 0.5 the bits differ
#: with probability 1/4 (16 of 64, deviation 3.5), so 29 is 3.8 deviations away.
SIGN_LIMIT = 29
#: Fewest equal symbols of 49: at J = 0.5 24.5 are equal (deviation 3.5), so 11 is 3.9 deviations away.
SYMBOL_FLOOR = 11
BROADCAST_IDS = 500_000  # 4 MB of ids at most; beyond it a shuffled semi-join
#: Larger buckets of a table, and larger groups of copies, are paired in blocks of this size.
BLOCK_ROWS = 4096
BROADCAST_KEYS = 1_000_000

#: The covering masks: the lines of the Fano plane, i.e. the triples of nonzero
#: three-bit vectors with exclusive-or zero.
LINES = np.array([(a - 1, b - 1, (a ^ b) - 1) for a in range(1, 8) for b in range(a + 1, 8) if (a ^ b) > b])

WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = _mix(np.arange(1, max(SYMBOLS, SIGN_BITS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(texts: list[str], width: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start of each text's hashes, which texts take part).

    Texts with fewer than max(least_words, width) words take no part and have no
    hashes. The hashes of one text may repeat.
    """
    lists = [WORD.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    part = counts >= max(least_words, width)
    words = [w for ws, p in zip(lists, part) if p for w in ws]
    n = counts[part]
    if not len(n):
        return np.empty(0, np.uint64), np.empty(0, np.int64), part
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    h = _mix(pd.util.hash_array(uniques.astype(object), categorize=False))[codes]
    total = len(h)
    ends = np.cumsum(n)
    s = np.zeros(total - width + 1, np.uint64)
    for i in range(width):
        s = (s + h[i : total - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        s ^= s >> np.uint64(29)
    keep = np.ones(len(s), bool)
    for i in range(1, width):  # runs that reach into the next text
        keep[(ends[:-1] - i)[ends[:-1] - i < len(s)]] = False
    s = _mix(s[keep])
    return s, np.concatenate([[0], np.cumsum(n - width + 1)[:-1]]), part


def _sketches(width: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 2000):  # bounds the arrays
                y = x.iloc[at : at + 2000]
                s, starts, part = shingle_hashes(y["s"].tolist(), width, least_words)
                if not len(starts):
                    continue
                low = np.empty((len(starts), max(SYMBOLS, SIGN_BITS)), np.uint64)
                for i in range(low.shape[1]):
                    low[:, i] = np.minimum.reduceat(s * _MULTIPLIERS[i], starts)
                low = _mix(low)
                bits = (low[:, :SIGN_BITS] & np.uint64(1)) << np.arange(SIGN_BITS, dtype=np.uint64)
                # a digest of the set: sums over its distinct hashes
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
                order = np.lexsort((s, owner))
                s2, o2 = s[order], owner[order]
                first = np.append(True, (s2[1:] != s2[:-1]) | (o2[1:] != o2[:-1]))
                s2, o2 = s2[first], o2[first]
                cut = np.flatnonzero(np.append(True, o2[1:] != o2[:-1]))
                yield pd.DataFrame({
                    "id": y["id"].to_numpy()[part], "ts": y["ts"].to_numpy()[part], "h": y["h"].to_numpy()[part],
                    "k1": np.add.reduceat(s2, cut).astype(np.int64), "k2": np.add.reduceat(_mix(s2 ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cut).astype(np.int64),
                    "sign": np.bitwise_or.reduce(bits, axis=1).astype(np.int64),
                    "sketch": [r.tobytes() for r in (low[:, :SYMBOLS] >> np.uint64(48)).astype(np.uint16)],
                })

    return run


def _table_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per covering mask: the hash of the three symbols that it keeps."""
    for x in batches:
        if not len(x):
            continue
        m = np.frombuffer(b"".join(x["sketch"]), np.uint16).reshape(len(x), BANDS, 7).astype(np.uint64)
        kept = m[:, :, LINES]  # rows, bands, masks, 3
        table = np.arange(BANDS * 7, dtype=np.uint64).reshape(BANDS, 7)
        key = _mix(kept[..., 0] | kept[..., 1] << np.uint64(16) | kept[..., 2] << np.uint64(32) | table << np.uint64(48)).reshape(len(x), -1)
        yield pd.DataFrame({"key": key.ravel().astype(np.int64), "id": np.repeat(x["id"].to_numpy(), key.shape[1]), "sign": np.repeat(x["sign"].to_numpy(), key.shape[1])})


def _equal_symbols(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    return pd.Series((x == np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)).sum(1).astype(np.int32))


def _shingle_sets(width: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s, starts, part = shingle_hashes(x["s"].tolist(), width, least_words)
            if len(starts):
                yield pd.DataFrame({"id": x["id"].to_numpy()[part], "r": [np.unique(y).astype(np.int64) for y in np.split(s, starts[1:])]})

    return run


def hot_keys(rows: DataFrame) -> DataFrame:
    """(key, n): buckets of more than BLOCK_ROWS records, about.

    Counted on every few records by id hash, since the numbers only say into how many
    blocks a bucket is cut; all records are paired either way. Staged, never collected.
    """
    of = max(1, BLOCK_ROWS // 128)
    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(of)) == 0) if of > 1 else rows
    return stage(some.mapInPandas(_table_keys, "key long, id long, sign long").groupBy("key").agg((F.count("*") * of).alias("n")).where(F.col("n") > BLOCK_ROWS), "hot")


def _met(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): pairs that share a bucket and are alike in their signs, each once.

    Buckets of many records, such as the variants of one page, are paired block by block,
    so no task holds one as a whole.
    """
    alike = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= SIGN_LIMIT
    n = hot.count()
    if not n:
        a, b = keys.toDF("key", "a", "sa"), keys.toDF("key", "b", "sb")
        return a.join(b, "key").where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()
    x = in_blocks(keys.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, "key", "left"), F.coalesce("n", F.lit(0)), "id", BLOCK_ROWS).drop("n")
    a, b = x.select("key", "_lo", "_hi", F.col("id").alias("a"), F.col("_i").alias("ia"), F.col("sign").alias("sa")), x.select("key", "_lo", "_hi", F.col("id").alias("b"), F.col("_i").alias("ib"), F.col("sign").alias("sb"))
    both = a.join(b, ["key", "_lo", "_hi"]).where(pair_once("a", "ia", "b", "ib") & alike)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: Column, id_col: str = "id", ts_col: str | None = None, width: int = 5, least_words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes(id, rep): every current record that takes part with the representative
    (smallest id) of the records whose shingle sets equal its own. links(a, b,
    similarity): the pairs of representatives, a < b, with Jaccard similarity of
    at least ``similarity``. Copies are thus never compared or expanded, however
    many there are.

    Null texts count as empty; rows with a null id are dropped; of an id in
    several rows the one with the latest ``ts_col`` counts (a null one is the
    earliest; of different texts with one id and time the one with the greatest
    hash counts). An empty table gives empty results. Whole texts are read, and nothing is gathered on the driver.
    """
    from pyspark.sql.functions import pandas_udf

    if not 0.5 <= similarity <= 1:
        raise ValueError("the masks are laid out for similarities of 0.5 and more")
    ts = F.coalesce(F.col(ts_col).cast("timestamp_ltz").cast("double"), F.lit(-1e18)) if ts_col else F.lit(0.0)
    s = F.coalesce(text, F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), ts.alias("ts"), F.xxhash64(s).alias("h"), s.alias("s")).where("id is not null")
    sketched = stage(base.mapInPandas(_sketches(width, least_words), "id long, ts double, h long, k1 long, k2 long, sign long, sketch binary"), "sketch")
    # the current row is chosen among all rows, also those that take no part
    key = ["id", "ts", "h"]
    now = stage(base.groupBy("id").agg(F.max(F.struct("ts", "h")).alias("m")).select("id", "m.ts", "m.h"), "now")
    members = stage(sketched.select(*key, "k1", "k2").join(now, key).dropDuplicates(key), "members")
    reps = members.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = members.join(reps, ["k1", "k2"]).select("id", "rep")

    chosen = members.groupBy("k1", "k2").agg(F.min(F.struct(*key)).alias("m")).select("m.*")
    rows = stage(sketched.select(*key, "sign", "sketch").join(chosen, key).dropDuplicates(key).select("id", "sign", "sketch"), "rows")
    keys = rows.mapInPandas(_table_keys, "key long, id long, sign long")
    met = _met(keys, hot_keys(rows))

    equal = pandas_udf(_equal_symbols, "int")
    sk = rows.select("id", "sketch")
    likely = met.join(sk.toDF("a", "ska"), "a").join(sk.toDF("b", "skb"), "b").where(equal("ska", "skb") >= SYMBOL_FLOOR).select("a", "b")
    likely = stage(likely, "likely")

    wanted = stage(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    cur = F.broadcast(wanted) if small else wanted
    texts = base.join(cur, "id", "left_semi")
    held = now.join(cur, "id", "left_semi")
    texts = texts.join(F.broadcast(held) if small else held, key, "left_semi")
    sets = texts.mapInPandas(_shingle_sets(width, least_words), "id long, r array<long>").dropDuplicates(["id"])
    both = likely.join(sets.toDF("a", "ra"), "a").join(sets.toDF("b", "rb"), "b")
    common = F.size(F.array_intersect("ra", "rb"))
    both = both.select("a", "b", F.size("ra").alias("na"), F.size("rb").alias("nb"), common.alias("c"))
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return classes, stage(both.select("a", "b", j.alias("similarity")).where(F.col("similarity") >= similarity), "links")


def expand_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records, copies included.

    Its size is that of the answer, quadratic in the size of a group of copies, which
    are paired in blocks; use the classes and links themselves where copies abound.
    """
    multi = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    copies = in_blocks(classes.join(multi, "rep"), F.col("n"), "id", BLOCK_ROWS)
    a, b = copies.select("rep", "_lo", "_hi", F.col("id").alias("id_a"), F.col("_i").alias("ia")), copies.select("rep", "_lo", "_hi", F.col("id").alias("id_b"), F.col("_i").alias("ib"))
    inner = a.join(b, ["rep", "_lo", "_hi"]).where(pair_once("id_a", "ia", "id_b", "ib")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    x = links.select(F.col("a").alias("rep"), "b").join(classes, "rep").select(F.col("id").alias("x"), F.col("b").alias("rep"))
    x = x.join(classes, "rep").select("x", F.col("id").alias("y"))
    return inner.unionByName(x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links): one row per record that has a copy or a link.

    class_id is the smallest id of the records joined by chains of links; links
    counts the representatives linked with the record's own.
    """
    roots = components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("n"))
    x = sizes.join(roots.toDF("rep", "root"), "rep", "left").join(degree, "rep", "left").where("n > 1 or root is not null")
    return classes.join(x, "rep").select("id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
