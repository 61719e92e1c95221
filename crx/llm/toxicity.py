"""Toxicity by a learned lexicon, matched with Levenshtein automata.

1. Of the labelled training rows at most MAX_TRAINING (those of smallest id hash)
   teach a lexicon: words, and stems (beginnings of words), more frequent in toxic
   texts than chance allows, each with the log of its lift as its weight. All of
   them are kept; the training rows bound their number. Near copies among the
   training rows count once.
2. The lexicon is a trie. A text's words run through the Levenshtein automaton of
   the trie's words, so misspelled words are found within one or two edits; what
   clean training texts use themselves is no misspelling. Stems match exactly.
3. Each hit is weighed by its context window: quotation marks around it or a verb
   of reporting before it make it a quotation, a second person makes it abuse.
4. A logistic regression over the summed weights gives the score.
Whole texts are scored in one pass; only bounded training data reach the driver.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.llm.common import shared_table, text_of

MAX_TRAINING = 10_000   # labelled rows the lexicon and the weights are learned from
MEMO_ENTRIES = 300_000
WINDOW = 8              # words before and after a hit
PASSAGE = 100           # words
N_FEATURES = 6

# Words of reporting and of address in the four languages of the corpus.
REPORTING = frozenset("said says saying wrote writes quote quoted quoting called calls told dijo dice escribió "
                      "sagte sagt schrieb nannte zitierte dit écrit disait appelé".split())
ADDRESS = frozenset("you your yours you're u ur tú usted ustedes eres du dich dir dein ihr euch tu te toi vous".split())
_OPENING, _CLOSING = "\"“„«‹'‘`", "\"”“»›'’`"
_INNER = re.compile(r"[^\W_]+")
_EDGES = re.compile(r"^\W+|\W+$")


def edits_allowed(term: str) -> int:
    """Edits at which a word still counts: short ones must be exact. Terms are words
    (ending in $) or stems, which must be exact: near a stem lie ordinary words."""
    n = len(term) - 1
    return 0 if not term.endswith("$") or n < 5 else 1 if n < 9 else 2


class LexiconTrie:
    """Weighted terms in a trie; `match` walks it with one Levenshtein row per node,
    leaving a branch when every entry of its row exceeds the edits its terms allow."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        parts = set()
        for term, weight in sorted(terms.items()):
            node, edits, letters = self.root, edits_allowed(term), term.removesuffix("$")
            node["most"] = max(node.get("most", 0), edits)
            for c in letters:
                node = node.setdefault("next", {}).setdefault(c, {})
                node["most"] = max(node.get("most", 0), edits)
            node["word" if term.endswith("$") else "stem"] = (edits, weight)
            cuts = [round(i * len(letters) / (edits + 1)) for i in range(edits + 2)]
            parts |= {letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
        # a word within e edits of a term holds one of the term's e + 1 parts unchanged
        self.may_match = re.compile("|".join(map(re.escape, sorted(parts)))) if parts else None

    def match(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term, the heavier of equally near ones; None
        if no term is near enough. A stem is compared with every beginning of the word."""
        if self.may_match is None or not self.may_match.search(word):
            return None
        best: tuple[int, float] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for kind, distance in (("word", row[-1]), ("stem", min(row))):
                if kind in node and distance <= node[kind][0]:
                    found = (distance, node[kind][1])
                    if best is None or (found[0], -found[1]) < (best[0], -best[1]):
                        best = found
            for c, child in node.get("next", {}).items():
                last = row[0] + 1
                new = [last]
                for j, w in enumerate(word, 1):
                    last = min(last + 1, row[j] + 1, row[j - 1] + (w != c))
                    new.append(last)
                if min(new) <= child["most"]:
                    stack.append((child, new))
        return best


class Matcher:
    """Hits of white-space tokens, remembered; clean words are no misspellings."""

    def __init__(self, trie: LexiconTrie, benign: frozenset[str]):
        self.trie, self.benign = trie, benign
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def find(self, tokens: list[str]) -> set[str]:
        """Those of the tokens that are hits; `hits` has (edits, weight) of each."""
        kinds = set(tokens)
        fresh = kinds - self.seen
        if fresh:
            if len(self.seen) > MEMO_ENTRIES:
                self.seen, self.hits, fresh = set(), {}, kinds
            self.seen |= fresh
            may = self.trie.may_match
            for token in fresh if may else ():
                if may.search(token):
                    self._learn(token)
        return kinds & self.hits.keys()

    def _learn(self, token: str) -> None:
        words = set(_INNER.findall(token))
        outer = _EDGES.sub("", token)
        if outer:
            words.add(outer)
        found = [m for w in words if (m := self.trie.match(w)) is not None and not (m[0] and w in self.benign)]
        if found:
            self.hits[token] = min(found, key=lambda m: (m[0], -m[1]))

    def hit(self, token: str) -> tuple[int, float] | None:
        return self.hits[token] if self.find([token]) else None


def is_quoted(tokens: list[str], i: int) -> bool:
    """Whether the token stands between quotation marks that open at most WINDOW
    words before and close at most WINDOW words after it, or follows a verb of
    reporting and an opening mark or colon within the window."""
    before, after = tokens[max(0, i - WINDOW):i + 1], tokens[i:i + WINDOW + 1]
    opened = closed = False
    for t in reversed(before):
        if t[0] in _OPENING:
            opened = True
            break
        if t is not before[-1] and t[-1] in _CLOSING:
            break
    for t in after:
        if t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in _CLOSING:
            closed = True
            break
    if opened and closed:
        return True
    told = any(t.strip(".,;:!?") in REPORTING for t in before[:-1])
    return told and (opened or any(t.endswith(":") for t in before[:-1]))


def features(text: str, matcher: Matcher) -> list[float]:
    """Of the hits outside quotations: log weight of exact and of misspelled ones, of
    those that address the reader, weight per word, and the largest weight within
    a passage of PASSAGE words; and the log weight of quoted hits."""
    tokens = text.lower().split()
    hits = matcher.find(tokens)
    if not hits:
        return [0.0] * N_FEATURES
    exact = misspelled = addressed = quoted = densest = 0.0
    passage: deque[tuple[int, float]] = deque()
    in_passage = 0.0
    for i, t in enumerate(tokens):
        if t not in hits:
            continue
        edits, weight = matcher.hits[t]
        weight *= 0.5 ** edits
        if is_quoted(tokens, i):
            quoted += weight
            continue
        exact, misspelled = (exact, misspelled + weight) if edits else (exact + weight, misspelled)
        near = tokens[max(0, i - WINDOW):i] + tokens[i + 1:i + WINDOW + 1]
        if any(w.strip(".,;:!?\"'") in ADDRESS for w in near):
            addressed += weight
        passage.append((i, weight))
        in_passage += weight
        while passage[0][0] <= i - PASSAGE:
            in_passage -= passage.popleft()[1]
        densest = max(densest, in_passage)
    logs = [float(np.log1p(v)) for v in (exact, misspelled, addressed, densest, quoted)]
    return [*logs, 100 * (exact + misspelled) / (len(tokens) + 50)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights (intercept first) of a ridge-penalised logistic regression, by Newton
    steps; one positive and many negative rows, say, still have a finite answer."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        curvature = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_terms(stats: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Weights of the terms chosen from candidates term -> (surprise, weight).

    The most surprising come first; none may begin another. A term gives way to
    its longest extension that is nearly as surprising, so a word stands for its
    own beginnings and a stem for the words it begins. The candidate words that a
    chosen stem begins stay beside it, each with the edits its own length allows."""
    ordered = sorted(stats)

    def extensions(term: str) -> list[str]:
        return ordered[bisect_left(ordered, term):bisect_left(ordered, term + "\U0010ffff")]

    chosen: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of chosen terms
    for term in sorted(stats, key=lambda t: (-stats[t][0], -len(t), t)):
        near = [t for t in extensions(term) if stats[t][0] >= 0.95 * stats[term][0]]
        best = max(near, key=lambda t: (len(t), stats[t][0], t))
        starts = [best[:i] for i in range(1, len(best) + 1)]
        if best not in begun and not any(s in chosen for s in starts):
            chosen[best] = stats[best][1]
            begun.update(starts)
    words = {t: stats[t][1] for stem in chosen if not stem.endswith("$") for t in extensions(stem)
             if t.endswith("$") and stats[t][0] >= 0.5 * stats[stem][0]}
    return chosen | words


class ToxicityModel:
    def __init__(self, terms: dict[str, float], benign: frozenset[str], weights: np.ndarray):
        self.terms, self.benign, self.weights = terms, benign, weights
        self._matcher: Matcher | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(LexiconTrie(self.terms), self.benign)
        return self._matcher

    def score(self, text: str) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], features(text, self.matcher())))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def held_out(doc_id: str) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _training_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    chosen = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = (docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
             .join(F.broadcast(chosen), "doc_id"))  # at most `limit` rows
    words = F.split(F.trim(F.col("text")), "\\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))),
                           lambda i: F.xxhash64(F.array_join(F.slice("words", i, 5), " ")))
    # near copies mostly share the smallest shingle hash: one of them teaches
    return (texts.withColumn("words", words).withColumn("family", F.array_min(shingles))
            .groupBy("family").agg(F.min_by(F.struct("toxic", "text"), F.col("doc_id")).alias("row")).select("row.*"))


def _terms(text: Column) -> Column:
    """Distinct words (with $ at the end) and their beginnings of 3 to 8 letters."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+")), lambda w: F.length(w) >= 3)
    stems = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.transform(
        F.sequence(F.lit(3), F.least(F.length(w) - 1, F.lit(8))), lambda n: w.substr(F.lit(1), n))))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(w, F.lit("$"))), stems))


def _per_text(fn: Callable[[str], list[float]]) -> Callable:
    """For mapInArrow over (toxic, text): toxic and the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          limit: int = MAX_TRAINING) -> ToxicityModel:
    """The model of at most `limit` labelled rows that are not held out. Of labels
    repeated for an id the largest counts; without toxic rows the lexicon is empty
    and every score is the same low rate."""
    sample = shared_table(_training_texts(docs, labels, id_col, text_col, label_col, limit), "toxic-sample")
    n_toxic, n_clean = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
    prior = float(np.log((n_toxic + 0.5) / (n_clean + 10)))
    if not n_toxic or not n_clean:
        return ToxicityModel({}, frozenset(), np.array([prior, *[0.0] * N_FEATURES]))
    counts = shared_table(
        sample.select("toxic", F.explode(_terms(F.col("text"))).alias("term")).groupBy("term")
        .agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") != 1, 1)).alias("c")), "toxic-terms")
    # how unlikely so many toxic texts are by chance (Chernoff bound), against the number of terms tried
    rate = n_toxic / (n_toxic + n_clean)
    share = F.col("t") / (F.col("t") + F.col("c"))
    surprise = F.col("t") * F.log(share / rate) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    lift = ((F.col("t") + 0.5) / n_toxic) / ((F.col("c") + 0.5) / n_clean)
    needed = float(np.log(max(1, counts.count())) + np.log(100.0))
    top = (counts.filter((F.col("t") > 0) & (lift >= 4.0)).withColumn("surprise", surprise).withColumn("weight", F.log(lift))
           .filter(F.col("surprise") >= needed).select("term", "surprise", "weight").collect())
    terms = choose_terms({r["term"]: (r["surprise"], r["weight"]) for r in top})
    trie = LexiconTrie(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [w for w in (t[:-1] for t in batch.column(0).to_pylist()) if trie.match(w)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["word"])

    clean = counts.filter(F.col("term").endswith("$") & (F.col("c") > 0)).select("term")
    benign = frozenset(r["word"] for r in clean.mapInArrow(near, "word string").collect())  # misspellings in the sample
    matcher = Matcher(trie, benign)
    rows = sample.select("toxic", "text").mapInArrow(_per_text(lambda t: features(t, matcher)), "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["toxic"] == 1 for r in rows], dtype=float)
    return ToxicityModel(terms, benign, fit_logistic(x, y))


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, score, predicted. Null text is empty
    and has the score of a text without hits; repeated rows are scored each; an
    empty table gives an empty result; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents scored below 0.5, all columns kept. Null text is empty."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")
    return docs.filter(score(F.col(text_col)) < 0.5)
