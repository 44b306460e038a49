"""Toxicity: a lexicon learned from labels, found in misspelled form as well.

The lexicon's trie is walked together with a Levenshtein automaton (insertion,
deletion, substitution and transposition of neighbours cost one edit each); the
product is made deterministic as far as texts ask for it, so that most words end
after a few steps. A hit counts by the precision its term has in the labels,
less for each edit and by the words and quotation marks around it, whose weights
tell quotation from abuse. Hits of different words add up as independent
evidence; texts without a hit get the rate of their frequent words among
labelled texts without a hit, at most ``BACKGROUND_CAP``.

The fit reads at most ``SAMPLE`` labelled rows (those with the least hash of the
key), each text once. A term needs a precision, and more different surroundings
than chance gives any of that many words, so words of one much-copied text don't
become terms. Beginnings that several terms share, and hardly any clean text, are
stems: words with such a beginning count like terms. Near misses that labelled
clean texts use are ordinary words; a term with several of them at some number of
edits stands among ordinary words and gets no near misses at that number.

Edge cases: a null or empty text, and one without words, has the rate of texts
without a hit. Null labels and keys teach nothing; of repeated label rows the
largest label counts. Without labels every score is 0. Whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import column, small_batches, stored

SAMPLE = 20_000
PRECISION, SURPRISE, SUPPORT = 0.85, 5.0, 3
STEM, STEM_TERMS, STEM_PRECISION, CROWDED = 4, 3, 0.97, 2
#: Log-odds lost by the number of edits, and by a quotation mark in the window.
EDIT_LOSS, QUOTE_LOSS = {0: 0.0, 1: 3.0, 2: 4.0}, 1.5
WINDOW, BACKGROUND_WORDS, BACKGROUND_CAP = 4, 2000, 0.45
THRESHOLD = 0.7
QUOTES = "\"“”„«»"
TOKEN = re.compile(rf"[{QUOTES}]|[$@]?\w+(?:[*@$!#]+\w+)*")
# Signs written for letters.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
CACHED = 200_000


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased words and quotation marks in order."""
    return TOKEN.findall(text.lower()) if text else []


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """Trie of the terms times the Levenshtein automaton, determinised on demand.

    A state is a set of (trie node, edits so far, letter that a transposition
    still waits for). Letters of no term are one letter.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        self.letters = frozenset("".join(terms))
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            for c in term:
                self.most[node] = max(self.most[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
            self.term[node] = term
        self.start = self._closed({(0, 0, "")})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple[int, str] | None] = {}

    def _closed(self, states) -> frozenset:
        """With all that letters missing from the word lead to."""
        todo, found = list(states), set(states)
        while todo:
            node, edits, waits = todo.pop()
            for child in self.children[node].values() if not waits else ():
                state = (child, edits + 1, "")
                if edits < self.most[child] and state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)

    def _step(self, states: frozenset, c: str) -> frozenset:
        after = set()
        for node, edits, waits in states:
            if waits:
                if c == waits:
                    after.add((node, edits, ""))
                continue
            children = self.children[node]
            if c in children:
                after.add((children[c], edits, ""))
            if edits < self.most[node]:
                after.add((node, edits + 1, ""))
            for letter, child in children.items():
                if edits < self.most[child]:
                    if letter != c:
                        after.add((child, edits + 1, ""))
                    if letter != c and c in self.children[child]:
                        after.add((self.children[child][c], edits + 1, letter))
        return self._closed(after)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within its number of edits; ties go to the first by name."""
        states = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            after = self.steps.get((states, c))
            if after is None:
                after = self.steps[states, c] = self._step(states, c)
            if not after:
                return None
            states = after
        if states not in self.ends:
            ends = [(e, self.term[n]) for n, e, waits in states if not waits and self.term[n]]
            self.ends[states] = min(((e, t) for e, t in ends if e <= edits_allowed(t)), default=None)
        return self.ends[states]


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)  # log-odds
    stems: dict[str, float] = field(default_factory=dict)  # log-odds
    crowded: frozenset = frozenset()  # terms and numbers of edits at which ordinary words lie
    ordinary: frozenset = frozenset()  # near misses that clean texts use
    around: dict[str, float] = field(default_factory=dict)  # log-odds of words in the window
    background: dict[str, float] = field(default_factory=dict)
    base: float = 0.0

    def __post_init__(self):
        self.automaton = TermAutomaton(sorted(self.terms))
        self.lengths = sorted({len(x) for x in self.stems})
        self.cache: dict[str, float | None] = {}

    def __reduce__(self):
        return ToxicityModel, (self.terms, self.stems, self.crowded, self.ordinary, self.around, self.background, self.base)

    def nearest(self, word: str) -> tuple[int, str] | None:
        found = self.automaton.match(word)
        if found is None and not word.isalpha():
            found = self.automaton.match(word.translate(LETTERS))
        return found

    def weight(self, word: str) -> float | None:
        """Log-odds of a word by itself; None if it's no hit."""
        if word in self.terms:
            return self.terms[word]
        if word in self.ordinary:
            return None
        for n in self.lengths:
            if (odds := self.stems.get(word[:n])) is not None:
                return odds
        found = self.nearest(word)
        if found is None or found[::-1] in self.crowded:
            return None
        return self.terms[found[1]] - EDIT_LOSS[found[0]]

    def hits(self, tokens: list[str]) -> dict[str, float]:
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        found = {}
        for word in set(tokens):
            if word not in cache:
                cache[word] = self.weight(word)
            if cache[word] is not None:
                found[word] = cache[word]
        return found

    def score(self, text: str | None) -> float:
        tokens = tokens_of(text)
        clean = 1 - self.rate(tokens)
        if found := self.hits(tokens):
            best: dict[str, float] = {}
            for i, word in enumerate(tokens):
                if word in found:
                    near = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
                    odds = found[word] + sum(self.around.get(x, 0.0) for x in near)
                    best[word] = max(best.get(word, -math.inf), odds)
            for odds in best.values():
                clean *= 1 / (1 + math.exp(min(odds, 30.0)))
        return 1 - clean

    def rate(self, tokens: list[str]) -> float:
        known = [self.background[x] for x in self.background.keys() & set(tokens)]
        return min(BACKGROUND_CAP, math.fsum(known) / len(known) if known else self.base)


def _tokens_column(text: str) -> Column:
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(tokens_of)

    return tokens(column(text).cast("string"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic", sample: int = SAMPLE) -> ToxicityModel:
    """The model of at most ``sample`` labelled rows; the caller chooses which rows may teach."""
    known = labels.filter(column(key).isNotNull() & column(label).isNotNull())
    known = known.groupBy(column(key).alias("id")).agg(F.max(column(label)).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))  # of bounded size
    texts = small_batches(docs).select(column(key).alias("id"), column(text).alias("x")).join(chosen, "id")
    texts = stored(texts.select("y", F.xxhash64("x").alias("t"), _tokens_column("x").alias("w")))
    once = texts.groupBy("t").agg(F.max("y").alias("y"))
    rows = stored(texts.dropDuplicates(["t"]).drop("y").join(once, "t"))

    words = rows.select("y", F.explode(F.array_distinct("w")).alias("w"))
    counts = stored(words.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    size = rows.agg(F.count("*"), F.sum("y")).first()
    if not size[0] or not size[1]:
        return ToxicityModel()
    base = size[1] / size[0]
    surprise = math.log(max(1, counts.count())) + SURPRISE

    def strong(t: str, c: str) -> Column:
        share = (F.col(t) + 0.5) / (F.col(t) + F.col(c) + 1)
        return (share >= PRECISION) & (F.col(t) >= SUPPORT) & (F.col(t) * F.log(share / base) >= surprise)

    terms = counts.filter(strong("t", "c") & F.expr("length(w) > 1")).select("w")
    # How many different surroundings each has: copies of one text have the same.
    at = rows.select("y", "w", F.posexplode("w").alias("i", "word"))
    side = lambda n: F.coalesce(F.get("w", F.col("i") + n), F.lit(""))
    seen = at.select("y", F.col("word").alias("w"), F.xxhash64(side(-1), side(1)).alias("h")).join(terms, "w")
    seen = seen.groupBy("w").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("h"))).alias("t"), F.countDistinct(F.when(F.col("y") == 0, F.col("h"))).alias("c"))
    odds = {r["w"]: min(4.6, math.log((r["t"] + 0.5) / (r["c"] + 0.5))) for r in seen.filter(strong("t", "c")).collect()}
    return _refine(ToxicityModel(odds, _stems(odds, counts), base=base), rows, counts)


def _stems(terms: dict[str, float], counts: DataFrame) -> dict[str, float]:
    """Shortest beginnings that several terms share and clean texts hardly use."""
    shared = Counter(w[:n] for w in terms for n in range(STEM, len(w)))
    wanted = [x for x, n in shared.items() if n >= STEM_TERMS]
    if not wanted:
        return {}
    beginnings = F.transform(F.sequence(F.lit(STEM), F.length("w")), lambda n: F.substring("w", F.lit(1), n))
    listed = counts.sparkSession.createDataFrame([(x,) for x in wanted], "s string")
    met = counts.filter(F.length("w") >= STEM).select("t", "c", F.explode(beginnings).alias("s")).join(F.broadcast(listed), "s")
    sums = met.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    good = {r["s"]: min(4.6, math.log((r["t"] + 0.5) / (r["c"] + 0.5))) for r in sums if r["t"] + 0.5 >= STEM_PRECISION * (r["t"] + r["c"] + 1)}
    return {s: v for s, v in good.items() if not any(s[:n] in good for n in range(STEM, len(s)))}


def _refine(model: ToxicityModel, rows: DataFrame, counts: DataFrame) -> ToxicityModel:
    """Adds what near misses, surroundings and texts without a hit teach."""

    @F.pandas_udf("string")
    def near(words: pd.Series) -> pd.Series:
        def miss(w):
            found = None if w in model.terms or any(w[:n] in model.stems for n in model.lengths) else model.nearest(w)
            return f"{found[0]} {found[1]}" if found else None

        return words.map(miss)

    missed = counts.filter("c >= 2 AND t < c").withColumn("miss", near("w")).filter("miss IS NOT NULL")
    missed = missed.select("w", "miss").collect()
    many = Counter(r["miss"] for r in missed)
    crowded = frozenset((x[2:], int(x[0])) for x, n in many.items() if n > CROWDED)
    ordinary = frozenset(r["w"] for r in missed if (r["miss"][2:], int(r["miss"][0])) not in crowded)
    model = ToxicityModel(model.terms, model.stems, crowded, ordinary, base=model.base)

    @F.pandas_udf("boolean")
    def hit(words: pd.Series) -> pd.Series:
        return words.map(lambda tokens: bool(model.hits(list(tokens))))

    marked = stored(rows.withColumn("hit", hit("w")))
    rest = marked.filter("NOT hit")
    base = rest.agg((F.sum("y") + 0.5) / (F.count("*") + 1)).first()[0]
    base = model.base if base is None else base
    rates = rest.select("y", F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    most = rates.orderBy(F.desc("n"), "w").limit(BACKGROUND_WORDS).collect()
    background = {r["w"]: (r["t"] + base) / (r["n"] + 1) for r in most}

    @F.pandas_udf("array<string>")
    def beside(words: pd.Series) -> pd.Series:
        def near_hits(tokens):
            found = model.hits(tokens)
            return [x for i, w in enumerate(tokens) if w in found for x in tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]]

        return words.map(lambda tokens: near_hits(list(tokens)))

    windows = marked.filter("hit").select("y", F.explode(F.array_distinct(beside("w"))).alias("w"))
    sides = windows.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    total = marked.filter("hit").agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    around = {q: -QUOTE_LOSS for q in QUOTES}
    if total[1]:
        prior = math.log((total[0] + 1) / (total[1] + 1))
        for r in sides.filter("c >= 5").orderBy(F.desc("c"), "w").limit(BACKGROUND_WORDS).collect():
            around[r["w"]] = min(0.0, math.log((r["t"] + 1) / (r["c"] + 1)) - prior)
    return ToxicityModel(model.terms, model.stems, model.crowded, model.ordinary, around, background, base)


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    """Score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return score(column(text).cast("string"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    return small_batches(docs).filter(toxicity_score(model, text) < threshold)
