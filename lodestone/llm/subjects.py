"""Subject areas of documents by distributed latent Dirichlet topic models.

Every text is cut into words once: one pass counts terms and keeps each document's bag
as hashes. A variational topic model is then fitted over all documents in distributed
passes, until the topics settle; every pass sends the topics to the tasks and brings back
one topic-by-term matrix of expected counts, whose size is bounded by the vocabulary limit. Topics start
from the term counts of labelled documents and of the whole corpus and are free to
move. After fitting, each topic is mapped to the subject whose inspected terms are
found among its top terms; topics without such terms are background. A document
has a subject when the topics of the subject hold a third or more of its content.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Set

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import current_keys

#: Terms in the model: of the terms in at least one of LEAST_SHARE documents (and LEAST_DOCS of them) and
#: at most MOST_SHARE of all, those in the largest shares of the documents of some language, so that
#: languages with few documents keep theirs. Bounds the memory of a pass: 4 MB a matrix at 16 topics.
VOCABULARY = 65_536
LEAST_DOCS, LEAST_SHARE = 20, 6000
MOST_SHARE = 0.2
BACKGROUND = 6
#: Passes end when topics change by less than SETTLED (half the sum of differences, mean of the topics).
PASSES, SETTLED = 12, 0.05
LABEL_ROWS = 20_000
INNER = 8
ALPHA, ETA = 0.08, 0.02
SHARE = 0.3
#: Words within which repetition and language are judged; a longer text is judged in parts, as
#: the share of different words falls, and that of function words among them, with the length of any prose.
WINDOW, LANGUAGE_WINDOW = 2000, 600

# Terms inspected in the fitted topics that name each subject.
INSPECTED = {
    "software": "compiler debugger database server cache kernel runtime parser protocol thread queue repository deployed compiled scheduler module",
    "sport": "tournament goalkeeper striker league marathon referee stadium match tackled medal season coach penalty wicket athletic relegated",
    "physics": "photon quark neutron plasma electron quantum spectrum wavelength magnetic gravitational pulsar telescope laser isotope lattice entropy",
    "law": "plaintiff defendant verdict statute tribunal clause prosecutor testimony jurisdiction appeal contract sued convicted appellate criminal tort",
    "medicine": "patient surgeon diagnosis vaccine clinic therapy symptom infection antibody surgical clinical dose nurse chronic cardiac tumour",
    "geography": "river village coast valley island mountainous peninsula estuary glacier volcano district province plateau lagoon fjord watershed",
    "music": "orchestra melody violin choir soprano opera sonata chorus harmony conductor cello quartet ballad composed rehearsed symphonic",
    "finance": "dividend mortgage creditor bond equity portfolio inflation treasury hedge bank currency fiscal taxable merger loan broker",
    "food": "recipe dough sauce roast onion garlic pepper butter oven simmered fermented baked spicy broth flour vinegar",
    "history": "empire dynasty treaty siege monarch throne armistice rebellion crusade fortress manuscript medieval conquered crowned feudal colonial",
}

# Function words by which a text's language is told.
LANGUAGES = {
    "en": "the of and in to is was that it with for as at by from had not but are were has have",
    "de": "der die das und ist im von zu mit auf für ein eine nicht es was war nach hat noch als sich",
    "es": "el los las que del por una con para se su más en es al y de no",
    "fr": "le les des et une dans pour qui sur est par au du ce ne pas plus la de à en",
}

WORD = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"<[^<>]{0,200}>")
_FUNCTION = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}


def words_of(title: str | None, text: str) -> list[str]:
    s = f"{title} {text}" if title else text
    if "<" in s:
        s = TAG.sub(" ", s)
    if "\xad" in s:
        s = s.replace("\xad", "")
    return WORD.findall(s.lower())


def language(words: Set[str]) -> str:
    """The language with the most different function words, '-' where they are under two or a twentieth."""
    counts = {k: len(v & words) for k, v in _FUNCTION.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] >= 2 and 20 * counts[best] >= len(words) else "-"


def parts(words: list[str], most: int) -> Iterator[list[str]]:
    """A long text in equal parts of at most ``most`` words."""
    n, k = len(words), -(-len(words) // most)
    return (words[i * n // k : (i + 1) * n // k] for i in range(k))


def main_language(words: list[str], different: Set[str]) -> str:
    """The language of a text of any length: the one of most of its parts."""
    if len(words) <= LANGUAGE_WINDOW:
        return language(different)
    counts = Counter(language(set(p)) for p in parts(words, LANGUAGE_WINDOW // 2))
    return min(counts, key=lambda k: (-counts[k], k))


def _different_runs(words: list[str], width: int = 5) -> int:
    """How many different runs of ``width`` words there are, by hash."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    runs = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(runs)]
    return len(np.unique(runs))


def broken(words: list[str], different: Set[str]) -> bool:
    """Text whose letters were torn apart or that repeats itself without end: it has no subject.

    It repeats itself when most of its parts have few different words, or the whole
    has few different runs of words (a long passage over and over).
    """
    n = len(words)
    sizes = list(map(len, words))
    if sizes.count(1) > 3 + 0.2 * n and sum(sizes) < 4 * n:
        return True
    if n <= 20 or len(different) >= 0.15 * n:
        return False
    if n <= WINDOW:
        return True
    poor = [len(set(p)) < 0.15 * len(p) for p in parts(words, WINDOW)]
    return 2 * sum(poor) > len(poor) or _different_runs(words) < 0.15 * n


def infer(d: np.ndarray, w: np.ndarray, c: np.ndarray, docs: int, beta: np.ndarray, inner: int = INNER, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(expected counts docs x topics, responsibilities of the entries), mean field.

    d, w, c: document (ascending), term and count of every entry; beta: terms x topics.
    """
    k = beta.shape[1]
    if not len(d):
        return np.zeros((docs, k), np.float32), np.zeros((0, k), np.float32)
    b = beta[w]
    starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d))))
    got = np.repeat((np.add.reduceat(c, starts) / k)[:, None], k, axis=1).astype(np.float32)
    r = b
    for _ in range(inner):
        r = b * (got + np.float32(alpha))[at]
        r *= (c / np.maximum(r.sum(1), 1e-30))[:, None]
        got = np.add.reduceat(r, starts, axis=0)
    out = np.zeros((docs, k), np.float32)
    out[d[starts]] = got
    return out, r


def normalised(counts: np.ndarray, eta: float = ETA) -> np.ndarray:
    """terms x topics, columns summing to 1."""
    x = counts + eta
    return (x / x.sum(0)).astype(np.float32)


def map_topics(beta: np.ndarray, vocabulary: list[str], inspected: dict[str, str] = INSPECTED, top: int = 30, least: int = 4) -> list[str | None]:
    """The subject of every topic, from its most probable terms; None (background) where
    under ``least`` inspected terms of any subject are among them."""
    named = {a: frozenset(t.split()) for a, t in inspected.items()}
    out: list[str | None] = []
    for k in range(beta.shape[1]):
        terms = {vocabulary[i] for i in np.argsort(-beta[:, k], kind="stable")[:top]}
        hits = {a: len(t & terms) for a, t in named.items()}
        best = max(hits, key=lambda a: hits[a], default=None)
        out.append(best if best is not None and hits[best] >= least else None)
    return out


class Model:
    """Vocabulary (term -> number), terms left out by language, topics and their subjects."""

    def __init__(self, vocabulary: list[str], stop: dict[str, frozenset[str]], beta: np.ndarray, topic_of: list[str | None]):
        self.vocabulary, self.stop, self.beta, self.topic_of = vocabulary, stop, beta, topic_of
        self.areas = sorted({a for a in topic_of if a})
        self.to_area = np.zeros((len(topic_of), max(1, len(self.areas))), np.float32)
        for k, a in enumerate(topic_of):
            if a:
                self.to_area[k, self.areas.index(a)] = 1

    def top_terms(self, n: int = 20) -> list[tuple[int, str | None, str]]:
        return [(k, a, " ".join(self.vocabulary[i] for i in np.argsort(-self.beta[:, k], kind="stable")[:n])) for k, a in enumerate(self.topic_of)]


READ = "id long, ts double, lang string, h binary, c binary, t binary, term string, area string, n long"


def _hashes(words: Iterable[str]) -> np.ndarray:
    """32 bits a word; two words of a vocabulary or of a text are rarely alike in them."""
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32)


def _read(labels: dict[int, tuple[str, ...]]):
    """The one pass over the texts. Rows with a term: document counts of every (language,
    term), in all and among the labelled of each area. Rows without: a document's language, the
    hashes and counts of its text's words and the hashes of its title's."""

    def flush(counts: dict[tuple[str, str], Counter]) -> Iterator[pd.DataFrame]:
        for (lang, area), c in counts.items():
            terms = [w for w in c if len(w) > 1 or w == " "]  # at least the blank
            yield pd.DataFrame({"id": None, "ts": None, "lang": lang, "h": None, "c": None, "t": None, "term": terms, "area": area, "n": [c[w] for w in terms]})
        counts.clear()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for x in batches:
            out = []
            for i, ts, title, text in zip(x["id"], x["ts"], x["title"], x["text"]):
                words = words_of(None, text)
                bag = Counter(words)
                if broken(words, bag.keys()):
                    continue
                lang = main_language(words, bag.keys())
                head = words_of(None, title) if title else []
                different = bag.keys() | set(head)
                different.add(" ")  # stands for the document
                counts[lang, ""].update(different)
                for a in (*labels[i], "*") if i in labels else ():  # "*": labelled at all
                    counts[lang, a].update(different)
                out.append((i, ts, lang, _hashes(bag).tobytes(), np.fromiter(bag.values(), np.uint32).tobytes(), _hashes(head).tobytes()))
            yield pd.DataFrame(out, columns=["id", "ts", "lang", "h", "c", "t"]).assign(term=None, area=None, n=None)
            if sum(map(len, counts.values())) > 400_000:  # bounds the memory of a task
                yield from flush(counts)
        yield from flush(counts)

    return run


def _bags(vocabulary: list[str], stop: dict[str, frozenset[str]]):
    """(id, ts, w, c): term numbers and counts of every row, without the terms left out in its language."""
    h = _hashes(vocabulary)
    order = np.argsort(h, kind="stable")
    known = h[order]
    number = {w: i for i, w in enumerate(vocabulary)}
    out_of = {k: np.array(sorted(number[w] for w in v if w in number), np.int64) for k, v in stop.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n, m = np.array([len(b) // 4 for b in x["h"]], np.int64), np.array([len(b) // 4 for b in x["t"]], np.int64)
            if not len(x) or not len(known):
                continue
            doc = np.concatenate([np.repeat(np.arange(len(x)), n), np.repeat(np.arange(len(x)), m)])
            got = np.frombuffer(b"".join(x["h"]) + b"".join(x["t"]), np.uint32)
            c = np.concatenate([np.frombuffer(b"".join(x["c"]), np.uint32).astype(np.int64), np.ones(int(m.sum()), np.int64)])
            in_text = np.arange(len(doc)) < n.sum()
            at = np.minimum(np.searchsorted(known, got), len(known) - 1)
            w = np.where(known[at] == got, order[at], -1)
            lang = x["lang"].to_numpy(object)
            for k, gone in out_of.items():
                if len(gone):
                    w[(lang[doc] == k) & np.isin(w, gone)] = -1
            ok = w >= 0
            has = np.zeros(len(x), bool)
            has[doc[ok & in_text]] = True  # a title alone doesn't give a text a subject
            ok &= has[doc]
            key, back = np.unique(doc[ok] * len(known) + w[ok], return_inverse=True)
            count = np.bincount(back, c[ok], len(key)).astype(np.uint32)
            d, w = key // len(known), (key % len(known)).astype(np.int32)
            cuts = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.empty(0, np.int64)
            ends = np.append(cuts[1:], len(d))
            rows = d[cuts]
            yield pd.DataFrame({"id": x["id"].to_numpy()[rows], "ts": x["ts"].to_numpy()[rows], "w": [w[a:b].tobytes() for a, b in zip(cuts, ends)], "c": [count[a:b].tobytes() for a, b in zip(cuts, ends)]})

    return run


def _entries(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(c) // 4 for c in x["c"]])
    return np.repeat(np.arange(len(x)), n), np.frombuffer(b"".join(x["w"]), np.int32), np.frombuffer(b"".join(x["c"]), np.uint32).astype(np.float32)


def _expect(beta: np.ndarray):
    """The E step of a partition: one terms x topics matrix of expected counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for x in batches:
            for at in range(0, len(x), 5000):
                d, w, c = _entries(x.iloc[at : at + 5000])
                if not len(d):
                    continue
                _, r = infer(d, w, c, int(d[-1]) + 1, beta)
                order = np.argsort(w, kind="stable")
                ws = w[order]
                cut = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
                total = np.zeros(beta.shape, np.float64) if total is None else total
                total[ws[cut]] += np.add.reduceat(r[order], cut, axis=0)
        if total is not None:
            yield pd.DataFrame({"part": [0], "m": [total.astype(np.float32).tobytes()]})

    return run


def _sum(d: pd.DataFrame) -> pd.DataFrame:
    m = np.zeros(len(d["m"].iloc[0]) // 4, np.float64)
    for b in d["m"]:
        m += np.frombuffer(b, np.float32)
    return pd.DataFrame({"part": [0], "m": [m.astype(np.float32).tobytes()]})


def _subjects(model: Model, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 5000):
                y = x.iloc[at : at + 5000]
                d, w, c = _entries(y)
                got, _ = infer(d, w, c, len(y), model.beta, 12)
                s = got @ model.to_area / np.maximum(got.sum(1, keepdims=True), 1e-9)
                i, k = np.nonzero(s >= share) if model.areas else (np.empty(0, int), np.empty(0, int))
                if len(i):
                    yield pd.DataFrame({"id": y["id"].to_numpy()[i], "ts": y["ts"].to_numpy()[i], "area": [model.areas[j] for j in k], "share": s[i, k].astype(float)})

    return run


def fit(docs: DataFrame, labels: DataFrame, areas: list[str], seed: int = 1, label_rows: int = LABEL_ROWS) -> tuple[Model, DataFrame]:
    """(model, bags): fitted over all rows of docs(id, ts, title, text).

    Labels (id, area) only shape the start: of at most ``label_rows`` of them (those
    with the smallest id hashes; all of them while there are fewer) counts by term
    and area are taken. Terms that a tenth of the documents of their language hold
    are left out as function words unless the labels tie them to one area.
    """
    spark = docs.sparkSession
    areas = sorted(areas)
    got = labels.where(F.col("id").isNotNull() & F.col("area").isin(areas)).distinct().orderBy(F.xxhash64("id"), "id", "area").limit(label_rows).collect()
    known: dict[int, tuple[str, ...]] = {}
    for r in got:
        known[r["id"]] = (*known.get(r["id"], ()), r["area"])
    read = stage(docs.mapInPandas(_read(known), READ), "read")
    counts = read.where("term is not null").groupBy("term", "lang", "area").agg(F.sum("n").alias("n"))
    sizes = {(r["lang"], r["area"]): r["n"] for r in counts.where(F.col("term") == " ").collect()}  # languages x areas
    docs_n = sum(n for (_, a), n in sizes.items() if a == "")
    by_lang: dict[str, int] = {}
    for (lang, a), n in sizes.items():
        if a == "":
            by_lang[lang] = by_lang.get(lang, 0) + n
    least = max(LEAST_DOCS, docs_n // LEAST_SHARE)
    share = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when((F.col("area") == "") & (F.col("lang") == k), F.col("n") / F.lit(float(n))).otherwise(0.0) for k, n in by_lang.items()])
    per = counts.where(F.col("term") != " ").groupBy("term").agg(F.sum(F.when(F.col("area") == "", F.col("n"))).alias("df"), F.max(share).alias("share"), F.collect_list(F.struct("lang", "area", "n")).alias("by"))  # by: languages x areas at most
    rows = per.where(F.col("df") >= least).orderBy(F.desc("share"), "term").limit(VOCABULARY).collect()
    of_area = np.array([sum(n for (_, a), n in sizes.items() if a == k) for k in areas], float)
    labelled = max(1.0, float(sum(n for (_, a), n in sizes.items() if a == "*")))
    vocabulary, stop, f, freq = [], {k: set() for k in LANGUAGES}, [], []
    for r in rows:
        term = {(e["lang"], e["area"]): e["n"] for e in r["by"]}
        fa = np.array([sum(n for (_, a), n in term.items() if a == k) for k in areas], float)
        ft = sum(n for (_, a), n in term.items() if a == "*")
        tied = bool((fa / (ft * of_area / labelled + 1) > 2).any())
        for lang in LANGUAGES:
            n = term.get((lang, ""), 0)
            if n > 20 and n > (0.2 if tied else 0.1) * by_lang.get(lang, 0):
                stop[lang].add(r["term"])
        if r["df"] <= MOST_SHARE * docs_n:
            vocabulary.append(r["term"])
            f.append(fa)
            freq.append(r["df"])
    fixed = {k: frozenset(v) for k, v in stop.items()}
    bags = stage(read.where("term is null").select("id", "ts", "lang", "h", "c", "t").mapInPandas(_bags(vocabulary, fixed), "id long, ts double, w binary, c binary"), "bags")
    k = len(areas) + BACKGROUND
    if not vocabulary:
        return Model(vocabulary, fixed, np.zeros((0, k), np.float32), [None] * k), bags
    fm, tot = np.array(f), np.array(freq, float)
    own = fm / (fm.sum(1)[:, None] * fm.sum(0) / max(fm.sum(), 1) + 1) > 2
    rng = np.random.default_rng(seed)
    start = np.zeros((len(vocabulary), k))
    start[:, : len(areas)] = np.where(own, fm, fm * 0.02)
    start[:, len(areas) :] = (np.where(own.any(1), 0.01, 1.0) * tot / BACKGROUND)[:, None] * rng.gamma(2, 0.5, (len(vocabulary), BACKGROUND))
    prior = np.zeros_like(start)
    prior[:, : len(areas)] = np.where(own, fm, 0)
    beta = normalised(start)
    for _ in range(PASSES):
        part = bags.mapInPandas(_expect(beta), "part int, m binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
        sums = part.groupBy("part").applyInPandas(_sum, "part int, m binary").collect()  # at most 16 matrices
        total = sum((np.frombuffer(bytes(r["m"]), np.float32).astype(np.float64) for r in sums), np.zeros(beta.size)).reshape(beta.shape)
        was, beta = beta, normalised(total + prior)
        if np.abs(beta - was).sum(0).mean() / 2 < SETTLED:
            break
    inspected = {a: INSPECTED[a] if a in INSPECTED else " ".join(vocabulary[i] for i in np.argsort(-fm[:, j] * own[:, j], kind="stable")[:15]) for j, a in enumerate(areas)}
    return Model(vocabulary, fixed, beta, map_topics(beta, vocabulary, inspected)), bags


def assign(docs: DataFrame, labels: DataFrame, areas: list[str], id_col: str = "id", title_col: str = "title", text_col: str = "text", ts_col: str | None = None, share: float = SHARE) -> DataFrame:
    """(id, area, share): the subjects of every current document.

    Null and blank texts, texts torn apart or without a term of the vocabulary and
    texts about no listed area have no rows; null ids are dropped; an empty table gives no rows. share: of the
    document's terms that are neither function words nor outside the vocabulary,
    the part held by the topics of the area. Of different rows with one id and the
    same latest time the areas of all count. Subjects without inspected terms are
    named by the terms that their labels are tied to.
    """
    ts = F.coalesce(F.col(ts_col).cast("timestamp_ltz").cast("double"), F.lit(-1e18)) if ts_col else F.lit(0.0)
    x = docs.select(F.col(id_col).alias("id"), ts.alias("ts"), F.col(title_col).alias("title"), F.col(text_col).alias("text")).where("id is not null")
    model, bags = fit(x.where("length(trim(text)) > 0"), labels, areas)
    found = bags.mapInPandas(_subjects(model, share), "id long, ts double, area string, share double")
    return found.join(current_keys(x.select("id", "ts"), "id", "ts"), ["id", "ts"]).groupBy("id", "area").agg(F.round(F.max("share"), 6).alias("share"))
