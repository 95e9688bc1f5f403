"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around its hits.

Learning (labelled rows only):
1. Every term of every labelled text is counted by document and class, over all labelled
   rows; copies of a text (five-word shingle sets of similarity ``COPY`` or more with a kept text of
   the same least shingle hash and label) speak once, so that the words of a much-copied text do not
   pass for toxic terms; texts that only share a passage are counted each. Terms that stand out in toxic documents (log-likelihood ratio above 2 ln of the
   vocabulary's size) make the lexicon, weighted by their log odds; beginnings of words that
   stand out in the same way over three terms or more enter as stems.
2. Misspellings: words within one edit of a lexicon word (a letter more, less or changed, or two
   neighbours swapped) are hits, too, unless clean labelled documents use them (they are words of
   their own). Words of ``SWAP_FROM`` letters up to ``FUZZY_FROM`` may only have letters swapped, as
   other edits of so short a word are mostly other words.
3. A logistic model over a document's hit features is fitted on a bounded sample of labelled
   rows (about ``FIT_ROWS``, chosen by hash).

Matching: the Levenshtein automaton of a word and the lexicon trie are walked together, as
one automaton over pairs (trie node, edits so far), made deterministic as words need it.
A word costs about one step per letter, and most die after two or three.

Context: each hit is scored in a window of words around it. Quotation marks around it and
verbs of reporting or words about words lower it (quotation); address to the reader raises it
(abuse). A misspelt hit counts a quarter of a plain one, so that one chance likeness decides nothing.

The lexicon holds every term above the threshold, rare ones too, and travels whole to the tasks;
only the rows of the logistic fit are a sample. Counts and scores cover all rows.

Defined cases: null or empty texts score like a text without hits; ids, languages, sources and
labels are never inputs of a score; labels that are null are not used, and a document with
several labels counts as toxic if one says so; without labelled toxic rows every score is 0; rows
that repeat are scored alike; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read_table, small
from .jaccard_join import shingle_sets

FIT_ROWS = 20_000
STEM = (4, 6)
FUZZY_FROM = 5            # shortest lexicon word that is matched with any one edit
SWAPPED = 2
SWAP_FROM = 4             # shortest lexicon word that is matched with two neighbouring letters swapped
NEAR = 6                  # words on either side of a hit that make its context

TOKEN = re.compile(r"[^\W_]+(?:[*@$!'][^\W_]+)*")
#: fixed values: words of quotation and of address, in the corpus's languages
_REPORT = frozenset("said says say called calls wrote writes quoted quote quotes word words term terms meaning means "
                    "dit mot citation sagte sagt wort zitat dijo dice palabra cita".split())
_ADDRESS = frozenset("you your youre u ur yourself tu te toi vous ton du dich dir dein ihr tú usted eres tus".split())
_QUOTES = '"“”«»„'


def fold(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Matcher(dict):
    """word -> (term number, edits) or None; the product automaton, made deterministic on demand.

    A state is a set of (trie node, what was done so far): 0 nothing, 1 an edit, ``SWAPPED`` a swap. The first
    of two swapped letters leads to (node after both, "the letter that must follow"). Terms are (text, is a stem). A stem matches any word that begins with it. ``known`` are
    words that are not taken as misspellings.
    """

    def __init__(self, terms: list[tuple[str, bool]], known: frozenset[str] = frozenset(), fuzzy_from: int = FUZZY_FROM):
        super().__init__()
        swap_from = min(fuzzy_from, SWAP_FROM)
        self.known, self.shortest = known, {0: 0, 1: fuzzy_from, SWAPPED: swap_from}
        self.next: list[dict[str, int]] = [{}]      # the trie
        self.exact: dict[int, int] = {}             # node -> term
        self.stem: dict[int, int] = {}
        self.deep: list[bool] = [False]             # whether a term that may have an edit lies below
        self.swap: list[bool] = [False]             # the same of swapped letters
        for i, (t, is_stem) in enumerate(terms):
            node, fuzzy, swap = 0, not is_stem and len(t) >= fuzzy_from, not is_stem and len(t) >= swap_from
            self.deep[0] |= fuzzy
            self.swap[0] |= swap
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.deep.append(False)
                    self.swap.append(False)
                node = self.next[node][c]
                self.deep[node] |= fuzzy
                self.swap[node] |= swap
            (self.stem if is_stem else self.exact).setdefault(node, i)
        self.length = [len(t) for t, _ in terms]
        start = self._closed({(0, 0)})
        self.sets, self.ids, self.moves = [start], {start: 0}, [{}]

    def _closed(self, pairs: set[tuple]) -> frozenset:
        """With a letter of the term left out: one edit, down the trie."""
        out = set(pairs)
        for node, e in pairs:
            if e == 0 and self.deep[node]:
                out.update((child, 1) for child in self.next[node].values() if self.deep[child])
        return frozenset(out)

    def _step(self, state: int, c: str) -> int:
        got = set()
        for node, e in self.sets[state]:
            if isinstance(e, str):                                   # the second of two swapped letters
                if e == c:
                    got.add((node, SWAPPED))
                continue
            child = self.next[node].get(c)
            if child is not None and (e == 0 or (self.swap if e == SWAPPED else self.deep)[child]):
                got.add((child, e))
            if e == 0 and self.deep[node]:
                got.add((node, 1))                                   # a letter too many
                got.update((k, 1) for k in self.next[node].values() if self.deep[k])   # another letter
            if e == 0 and self.swap[node]:
                for first, k in self.next[node].items():
                    both = self.next[k].get(c) if first != c else None
                    if both is not None and self.swap[both]:
                        got.add((both, first))
        s = self._closed(got)
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
        to = self.moves[state][c] = self.ids[s]
        return to

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        state, stem = 0, None
        for c in word:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            pairs = self.sets[state]
            if not pairs:
                break
            if self.stem and stem is None:
                stem = next((self.stem[n] for n, e in pairs if e == 0 and n in self.stem), None)
        hit = None
        pairs = self.sets[state]
        if stem is not None:
            hit = (stem, 0)
        for n, e in pairs:
            t = None if isinstance(e, str) else self.exact.get(n)
            if t is not None and self.length[t] >= self.shortest[e] and (e == 0 or word not in self.known):
                found = (t, min(e, 1))
                if hit is None or (found[1], found[0]) < (hit[1], hit[0]):
                    hit = found
        self[word] = hit
        return hit


FEATURES = ["abuse", "quoted", "kinds", "share"]
COPY = (4, 5)             # similarity from which a labelled text is a copy
PART = 0.25               # what a misspelt or a quoted hit counts beside a plain one


def features(text: str, matcher: Matcher, weights: list[float]) -> tuple[list[float], list[str]]:
    """Hit features of a text, and its hits as words."""
    low = text.lower()
    words = TOKEN.findall(low)
    got = list(map(matcher.__getitem__, words))
    at = [i for i, x in enumerate(got) if x is not None]
    if not at:
        return [0.0] * len(FEATURES), []
    spans = [m.span() for m in TOKEN.finditer(low)]
    abuse = quoted = total = 0.0
    kinds: dict[int, float] = {}
    for i in at:
        term, edits = got[i]
        a, b = max(0, i - NEAR), min(len(words), i + NEAR + 1)
        before, after = low[spans[a][0]:spans[i][0]], low[spans[i][1]:spans[b - 1][1]]
        inside = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
        around = words[a:i] + words[i + 1:b]
        reported = any(w in _REPORT for w in around)
        addressed = any(w in _ADDRESS for w in around)
        part = PART if edits else 1.0
        if inside or (reported and not addressed):
            quoted += weights[term] * part
            part *= PART
        else:
            abuse += weights[term] * part * (1.25 if addressed else 1.0)
        kinds[term] = max(part, kinds.get(term, 0.0))
        total += part
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(sum(kinds.values())),
            math.log1p(1000 * total / len(words)) / 7], [words[i] for i in at]


def family(text: Column) -> Column:
    """Least hash of a text's five-word shingles: the same for copies, and for most near copies, but for others, too."""
    @F.pandas_udf("long")
    def least(texts: pd.Series) -> pd.Series:
        sets = shingle_sets(pa.array(texts, type=pa.large_string(), from_pandas=True), 5)
        return pd.Series([int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in sets], dtype="int64")

    return least(text)


def is_copy(text: Column, kept: Column) -> Column:
    """Whether the five-word shingle sets of two texts have a similarity of ``COPY`` or more."""
    @F.pandas_udf("boolean")
    def like(texts: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(*(shingle_sets(pa.array(x, type=pa.large_string(), from_pandas=True), 5) for x in (texts, others))):
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(COPY[1] * both >= COPY[0] * (len(a) + len(b) - both))
        return pd.Series(out, dtype="bool")

    return like(text, kept)


def without_copies(ws: Workspace, labelled: DataFrame) -> DataFrame:
    """Rows (text, y, h) of which copies speak once; (f, y) of a row names the family that it is compared in.

    Families are found by numbers alone, and a text equal to its family's kept one is known by its digest. Texts
    move only for the other rows of families with several different texts.
    """
    rows = ws.save(labelled.withColumn("n", F.monotonically_increasing_id())
                   .withColumn("d", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), "labelled")
    numbers = rows.select("n", "f", "y", "h", "d")
    first = numbers.groupBy("f", "y").agg(F.min(F.struct("h", "n", "d")).alias("one"), F.count(F.lit(1)).alias("rows"))
    first = first.filter("rows > 1").select("f", "y", F.col("one.n").alias("kept"), F.col("one.d").alias("kept_d"))
    pairs = ws.save(numbers.join(first, ["f", "y"]).filter("n != kept")
                    .select("n", "kept", (F.col("d") == F.col("kept_d")).alias("same")), "pairs")
    differ = pairs.filter("not same").select("n", "kept")
    texts = rows.select("n", "text").join(small(differ), "n")
    kept = (rows.select(F.col("n").alias("kept"), F.coalesce("text", F.lit("")).alias("kept_text"))
            .join(small(differ.select("kept").distinct()), "kept"))
    near = texts.join(kept, "kept").filter(is_copy(F.coalesce("text", F.lit("")), F.col("kept_text"))).select("n")
    copies = ws.save(pairs.filter("same").select("n").unionByName(near), "copies")
    return rows.join(small(copies), "n", "left_anti").select("text", "y", "h")


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each class that hold a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[1 if y else 0].update(set(fold(text or "")))
            terms = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()),
                 pa.array([n[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])
    parts = labelled.select("text", "y").mapInArrow(count, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a term's two document counts against equal use in both classes."""
    n = n_toxic + n_clean
    e1, e0 = (toxic + clean) * (n_toxic / n), (toxic + clean) * (n_clean / n)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return 2 * (part(toxic, e1) + part(clean, e0))


def learn(ws: Workspace, labelled: DataFrame) -> dict:
    """Lexicon, known words and logistic coefficients from rows (text, y, h)."""
    n = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    empty = {"terms": [], "weights": [], "known": frozenset(), "beta": None}
    if not n1:
        return empty
    counts = ws.save(term_counts(labelled), "terms")
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    vocabulary = max(2, counts.count())
    stands_out = (ratio(F.col("toxic"), F.col("clean"), n1, n0) > 2 * math.log(vocabulary)) & (odds > math.log(8))
    strongest = [F.desc("llr"), F.asc("term")]
    llr = ratio(F.col("toxic"), F.col("clean"), n1, n0).alias("llr")
    words = counts.filter(stands_out).select("term", odds.alias("w"), llr).orderBy(*strongest).collect()
    stems: list = []
    for size in range(STEM[0], STEM[1] + 1):
        begin = (counts.filter((F.char_length("term") >= size) & (F.col("term").rlike("^[^0-9]+$")))
                 .groupBy(F.substring("term", 1, size).alias("term"))
                 .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n")))
        stems += (begin.filter(stands_out & (F.col("n") >= 3) & (F.col("toxic") >= 19 * F.col("clean")))
                  .select("term", odds.alias("w"), llr).orderBy(*strongest).collect())
    kept: dict[str, float] = {}
    for s in sorted(stems, key=lambda r: (len(r.term), r.term)):
        if not any(s.term[:k] in kept for k in range(STEM[0], len(s.term))):
            kept[s.term] = s.w
    terms = [(t, True) for t in kept]
    weights = list(kept.values())
    for r in words:
        if not any(r.term[:k] in kept for k in range(STEM[0], STEM[1] + 1)):
            terms.append((r.term, False))
            weights.append(r.w)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(terms)
        for batch in batches:
            t = [x for x in batch.column(0).to_pylist() if (m[x] or (0, 0))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["term"])

    # at most the words within one edit of the lexicon
    words_near = frozenset(r.term for r in counts.filter("clean > 0").select("term").mapInArrow(known, "term string").collect())
    model = {"terms": terms, "weights": weights, "known": words_near, "beta": None}
    # about FIT_ROWS rows by hash, never more than twice as many
    one_in = max(1, -(-(n0 + n1) // FIT_ROWS))
    sample = labelled.filter(F.pmod("h", F.lit(one_in)) == 0).limit(2 * FIT_ROWS)
    got = sample.select("y", score_column(model, F.col("text")).alias("s")).select("y", "s.features").collect()
    got.sort(key=lambda r: (r.y, r.features))
    x = np.array([[1.0, *r.features] for r in got])
    model["beta"] = fit_logistic(x, np.array([float(r.y) for r in got]))
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by Newton steps; hit features never count against toxicity, except quotation."""
    free = [FEATURES.index("quoted") + 1, 0]
    beta = np.zeros(x.shape[1])
    use = np.ones(x.shape[1], dtype=bool)
    for _ in range(x.shape[1]):
        beta[:] = 0.0
        beta[0] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        z = x[:, use]
        b = beta[use]
        pen = np.full(int(use.sum()), ridge)
        pen[0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * b)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        beta[use] = b
        wrong = [i for i in range(len(beta)) if use[i] and i not in free and beta[i] < 0]
        if not wrong:
            break
        use[wrong] = False
    return beta.tolist()


def score_column(model: dict, text: Column) -> Column:
    """(features, score, hits) of a text column under a model."""
    terms, weights, known, beta = model["terms"], model["weights"], model["known"], model["beta"]

    @F.pandas_udf("features array<double>, score double, hits array<string>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms, known)
        for texts in parts:
            rows = []
            for t in texts:
                f, hits = features(t or "", matcher, weights) if terms else ([0.0] * len(FEATURES), [])
                s = 0.0 if beta is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, beta[0] + sum(
                    b * v for b, v in zip(beta[1:], f))))))
                rows.append((f, s, hits))
            yield pd.DataFrame(rows, columns=["features", "score", "hits"])

    return score(text)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> dict:
    """A model from the labelled documents that are not held out."""
    ws = Workspace(docs.sparkSession, "toxicity")
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    labelled = (docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(small(known), F.col("_doc") == F.col("_id"))
                .select("text", "y", F.xxhash64("_doc", "text").alias("h"), family(F.coalesce("text", F.lit(""))).alias("f")))
    return learn(ws, without_copies(ws, labelled))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of the labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", score_column(model, F.col("text")).alias("s"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"),
                      (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.hits").alias("hits"))
