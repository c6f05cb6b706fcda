"""Text quality statistics per document, and rules learned on them.

``statistics`` are native column expressions over the whole text. Rules that tell
prose from lists, tables and junk are induced by incremental reduced-error
pruning on labelled documents (quality_examples), on the very same statistics,
and exported as one SQL CASE, so applying them needs no Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
COMMON_WORDS = """
the of and a an in to is was are were be been by at on for with as it its this that these those from have has had he she his her they their we our you your i not no
but or so if than then there which who what when where how all each every some any most more only other into over after before about because although until while could would can will may
under against near beside since during through between upon such both either nor within whether
der die das des dem den ein eine einer eines einem einen und oder ist im zu zur zum von vom mit auf für es gab nicht als auch wie sich war wird wurde hat haben bei nach aus über noch nur
doch ohne zwischen was viele dass wenn aber sind um am an man
le la les un une des du de et ou est dans pour sur par au aux ce cette il elle on qui que ne pas plus avec sans sont été nous vous se sa son ses leur mais comme à en y entre
el los las lo del al una uno y o que es son por para con se su sus más no hay como pero sin sobre entre muchos nadie desde cuando este esta ha fue ser
il i gli di da che per con non si è sono della del nel una um os ao do dos das em na não com mais uma het een van dat niet zijn op te voor met ook
""".split()

STATISTICS = (
    "words", "mean_word", "symbols", "digits", "letters", "garbled", "end_lines", "common", "single", "distinct", "distinct_lines", "line_words", "prose", "cells", "entries", "rest", "long_words", "marks",
)

_IN = "(" + ", ".join("'" + w + "'" for w in sorted(set(COMMON_WORDS))) + ")"
_BREAK = r"\r\n|[\n\r\x{b}\f\x{85}\x{2028}\x{2029}]"
_CELL = r"(?=[|!\t,;<\s])(?:\|\|?|!!|\t|,(?=[^\s])|;(?=[^\s])|\s&\s|</t[dh]>|(?<! ) {3,}+(?=[^\s]))"
_INLINE = (" · ", " / ", " • ", " > ", " → ", " » ")
_MARKS = (" | ", "; ")
_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_NOT_PUNCTUATION = r"[^.,;:!?'\"()\-]+"
_END = r"[.!?…:;][\"'”’»)\]]*\s*$"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds one column per entry of STATISTICS to ``docs`` (same-named columns are
    replaced), and ``size``, the number of non-blank characters. The text column is
    left out unless ``keep_text``.

    words, mean word length; of non-blank characters the shares of symbols, digits,
    letters and garbled ones; of non-blank lines the share that ends in punctuation
    and of different ones; of words the shares of common, single-letter, different
    and overlong ones; list marks per word; words per line; of non-blank characters the shares on lines
    that read like prose, hold cells, are entries, or none of these. A null, empty
    or blank text has words and size 0 and every share 0.
    """
    names = [c for c in docs.columns if c not in STATISTICS and c != "size" and (keep_text or c != text_col)]
    t = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u00ad"), F.lit(""))  # soft hyphens
    # the caller's columns travel in one struct, so none can clash with the working columns
    x = docs.select(F.struct(*names, F.lit(0).alias("__")).alias("_row"), t.alias("_t"))
    # plain replacements count marks much faster than a pattern does
    marks = lambda of: " + ".join(f"(length(l) - length(replace(l, {_sql(m)}, ''))) div {len(m)}" for m in of)
    line = f"""named_struct(
        'l', l, 'c', length(regexp_replace(replace(l, ' ', ''), {_sql(_BLANK)}, '')),
        'w', filter(split(lower(l), '[^\\\\p{{L}}]+'), w -> w <> ''),
        'd', regexp_count(l, {_sql(_CELL)}),
        'a', {marks(_INLINE)}, 'm', {marks(_MARKS)}, 't', length(l) - length(replace(l, ' ', '')) + 1,
        'g', length(regexp_replace(l, '[^0-9]+', '')),
        'e', l rlike {_sql(_END)})"""
    x = x.withColumn("_s", F.expr(f"filter(transform(split(_t, {_sql(_BREAK)}), l -> {line}), s -> s.c > 0)"))
    # classes of wide characters are slow in patterns, so those are counted one by one
    several = lambda chars: " + ".join(f"(length(_t) - length(replace(_t, '{c}', '')))" for c in chars)
    # words, lines and text end here: rows of the further steps hold numbers only
    x = x.select(
        "_row",
        F.expr(
            f"""transform(_s, s -> named_struct('c', double(s.c), 'n', double(size(s.w)), 'd', double(s.d), 'm', double(s.a + s.m), 'a', double(s.a), 't', double(s.t), 'e', s.e, 'g', double(s.g),
            'o', double(size(filter(s.w, w -> w in {_IN}))), 'i', double(size(filter(s.w, w -> length(w) = 1))), 'b', double(size(filter(s.w, w -> length(w) > 22))), 'z', double(length(array_join(s.w, '')))))"""
        ).alias("_k"),
        F.expr("double(size(array_distinct(flatten(transform(_s, s -> s.w)))))").alias("_dw"), F.expr("double(size(array_distinct(transform(_s, s -> s.l))))").alias("_dl"),
        F.expr(f"double(length(regexp_replace(_t, {_sql(_NOT_PUNCTUATION)}, '')) + {several('–—’“”«»…')})").alias("_p"), F.expr(f"double({several('ÃÂâ�')})").alias("_g"),
    )
    # what a line is: 1 prose, 2 cells, 3 entry, 0 none
    kind = """CASE WHEN s.a >= 3 AND s.a * 6 >= s.n AND s.z + s.g >= 0.6D * s.c AND s.i <= 0.4D * s.n AND s.d < 2D * s.a THEN 3
        WHEN (s.n >= 6 OR s.o >= 2) AND s.o >= 0.16D * s.n AND s.i <= 0.3D * s.n AND s.z >= 0.55D * s.c AND s.d <= 0.35D * s.n THEN 1
        WHEN s.d >= 1 AND s.d * 5 >= s.n AND s.b = 0 AND s.z + s.g >= 0.4D * s.c THEN 2
        WHEN (s.n BETWEEN 1 AND 9 OR s.m >= 2 AND s.m * 8 >= s.n) AND s.z >= 0.2D * s.c AND s.z + s.g >= 0.6D * s.c AND s.i <= 0.4D * s.n AND s.b = 0 AND s.c <= 25D * s.t THEN 3 ELSE 0 END"""
    x = x.withColumn("_q", F.expr(f"transform(_k, s -> named_struct('c', s.c, 'e', s.e, 'q', {kind}))"))
    # a line that goes on from a long line of prose without a full stop is prose too
    x = x.withColumn("_q", F.expr("transform(_q, (s, i) -> named_struct('c', s.c, 'q', CASE WHEN s.q IN (0, 3) AND i > 0 AND get(_q, i - 1).q = 1 AND NOT get(_q, i - 1).e AND get(_q, i - 1).c >= 30 THEN 1 ELSE s.q END))"))
    total = lambda f, of="_k": F.expr(f"aggregate({of}, 0D, (a, s) -> a + {f})")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    x = x.withColumns({"words": total("s.n"), "_n": total("s.c"), "_a": total("s.z"), "_d": total("s.g")})
    n, lines, words = F.col("_n"), F.size("_k").cast("double"), F.col("words")
    part = lambda q: share(F.expr(f"aggregate(filter(_q, s -> s.q = {q}), 0D, (a, s) -> a + s.c)"), n)
    new = {
        "mean_word": share(F.col("_a"), words), "letters": share(F.col("_a"), n), "digits": share(F.col("_d"), n),
        "symbols": share(n - F.col("_a") - F.col("_d") - F.col("_p"), n), "garbled": share(F.col("_g"), n),
        "end_lines": share(F.expr("size(filter(_k, s -> s.e))"), lines), "common": share(total("s.o"), words), "single": share(total("s.i"), words),
        "distinct": share(F.col("_dw"), words), "distinct_lines": share(F.col("_dl"), lines),
        "line_words": share(words, lines), "prose": part(1), "cells": part(2), "entries": part(3), "rest": part(0), "long_words": share(total("s.b"), words), "marks": share(total("s.m"), words),
    }
    text = [F.col(f"_row.`{c}`").alias(c) for c in names]
    return x.select(*text, n.cast("long").alias("size"), words.cast("long").alias("words"), *[F.round(v, 6).alias(k) for k, v in new.items()])


# -- rule induction ---------------------------------------------------------


def _covers(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, up, at in rule:
        hit &= x[:, f] >= at if up else x[:, f] <= at
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, bool, float]]:
    """Adds the condition with the greatest FOIL gain until no other class is covered."""
    rule: list[tuple[int, bool, float]] = []
    on = np.ones(len(y), bool)
    while (~y[on]).any() and len(rule) < 8:
        p0, n0 = y[on].sum(), (~y[on]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(x.shape[1]):
            v = x[on, f]
            order = np.argsort(v, kind="stable")
            v, yy = v[order], y[on][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p = np.cumsum(yy)[cut].astype(float)
            n = np.cumsum(~yy)[cut].astype(float)
            at = np.round((v[cut] + v[cut + 1]) / 2, 4)
            for up, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                ok = pp > 0
                gain = np.where(ok, pp * (np.log2(np.where(ok, pp / np.maximum(pp + nn, 1), 1)) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, up, float(at[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on = _covers(rule, x)
        if not y[on].any():
            rule.pop()
            break
    return rule


def induce(x: np.ndarray, y: np.ndarray, default: str = "prose", seed: int = 3) -> list[tuple[list[tuple[int, bool, float]], str]]:
    """An ordered rule list: classes from the rarest on, each rule grown on two
    thirds of what is left and pruned on the rest; a class ends with the first rule
    that is wrong on half of what it covers in pruning."""
    rng = np.random.default_rng(seed)
    names, counts = np.unique(y[y != default], return_counts=True)
    left = np.ones(len(y), bool)
    rules = []
    for name in names[np.argsort(counts, kind="stable")]:
        while (y[left] == name).any():
            rows = rng.permutation(np.flatnonzero(left))
            cut = 2 * len(rows) // 3
            g, p = rows[:cut], rows[cut:]
            if not (y[g] == name).any():
                break
            rule = _grow(x[g], y[g] == name)
            if not rule:
                break

            def worth(r: list) -> float:
                hit = _covers(r, x[p])
                pos = (y[p][hit] == name).sum()
                return (2 * pos - hit.sum()) / hit.sum() if hit.any() else -1.0

            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
            if worth(rule) <= 0:
                break
            rules.append((rule, str(name)))
            left &= ~_covers(rule, x)
    return rules


def to_case(rules: list, names: tuple[str, ...] = STATISTICS, default: str = "prose") -> str:
    """The rule list as a SQL CASE."""
    when = [f"WHEN {' AND '.join(f'{names[f]} {">=" if up else "<="} {at!r}D' for f, up, at in rule)} THEN '{name}'" for rule, name in rules]
    return f"CASE {' '.join(when)} ELSE '{default}' END" if when else f"'{default}'"


@lru_cache(maxsize=8)
def _learned(app: str, per_kind: int, seed: int) -> str:
    from .quality_examples import labelled

    spark = SparkSession.getActiveSession()
    rows = labelled(per_kind, seed)
    stats = statistics(spark.createDataFrame(rows, "label string, text string").repartition(4)).select("label", *STATISTICS).collect()  # the labelled documents only
    y = np.array([r["label"] for r in stats])
    x = np.array([[float(r[c]) for c in STATISTICS] for r in stats])
    order = np.lexsort((*x.T, y))
    return to_case(induce(x[order], y[order], seed=seed))


def rules(spark: SparkSession, per_kind: int = 800, seed: int = 3) -> str:
    """The CASE learned from 4 * ``per_kind`` labelled documents; once per application."""
    return _learned(spark.sparkContext.applicationId, per_kind, seed)


def classify(docs: DataFrame, text_col: str = "text", case: str | None = None, keep_text: bool = True) -> DataFrame:
    """Adds ``kind`` (prose, list, table or junk) and the statistics. Null, empty
    and blank texts are 'blank'."""
    x = statistics(docs, text_col, keep_text)
    case = case or rules(docs.sparkSession)
    return x.withColumn("kind", F.when(F.col("size") == 0, "blank").otherwise(F.expr(case)))
