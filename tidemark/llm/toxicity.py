"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

Learning. Labelled rows give a lexicon: whole words, and stems (prefixes) where many different words
begin alike, that are far more frequent in toxic than in other rows. At most FIT_ROWS labelled rows
are used (those with the smallest hashes of their ids); everything else covers all rows.

Matching. The lexicon is a trie. Walking it with all positions that lie within a term's edit budget
is the intersection of the trie with the terms' Levenshtein automata; its sets of positions become
states of one automaton, made when first met, so a word costs one step per character and misspelled
terms (idi0t, worthles) are found. Words that labelled harmless rows use are no misspellings.

Context. Each hit looks at a window around it: within quotation marks or after words of report it
counts as quotation. Abuse and quotation, exact and misspelled hits and their density are the inputs
of a logistic model, fitted on labelled rows with a prior that misspelled terms are toxic.

Null and empty texts have no hits and get the score of such texts. Ties and repeated rows are scored
alike. Rows of labels with null id or label are left out; of several labels of an id the highest
holds. Without any toxic label all scores are low. Extra columns stay.

Bounds of the lexicon: MAX_TERMS terms, the most frequent in toxic rows first, of words of 3 to 40 characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_name, held_out, kept_by_worker, table

#: Labelled rows at most that the model is fitted on.
FIT_ROWS = 20_000
#: Terms at most in the lexicon.
MAX_TERMS = 2_000
#: Evidence for a term (log likelihood ratio of its toxic share against that of all rows), and for
#: one whose misspellings are sought as well. Among a million candidates, chance rarely reaches 16.
EVIDENCE, FUZZY_EVIDENCE = 16.0, 30.0
WINDOW = 48
THRESHOLD = 0.3
FLUSH, CACHE, STATES = 200_000, 100_000, 20_000
WORD = re.compile(r"\w+")

#: Quotation marks that open and close, and words of report in the tables' languages.
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
REPORT = frozenset(
    "said says called calls calling wrote writes quote quoted quoting term word insult slur sagte nannte schrieb zitat wort begriff dit appelé écrit mot terme citation dijo llamó escribió palabra término cita".split()
)


def edits(term: str) -> int:
    """The edit budget of a whole word."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def plain(term: str) -> bool:
    """Whether any word within the budget counts. Of terms of four letters so many words are one edit away that
    only those with a digit or an underscore do."""
    return len(term) > 4


def family(text: str | None) -> int:
    """The smallest hash of the text's three-word windows: alike for most near copies."""
    found = (text or "").lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))), default=0) >> 1


@dataclass
class Matcher:
    """The trie of (term, is stem, may be misspelled) with a lazily built automaton over it."""

    terms: list[tuple[str, bool, bool]]
    harmless: frozenset[str] = frozenset()
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[int]] = field(default_factory=dict)
    reach: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for k, (term, _, _) in enumerate(self.terms):
            node, budget = 0, self.budget(k)
            self.reach[0] = max(self.reach[0], budget)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], budget)
            self.ends.setdefault(node, []).append(k)
        self.forget()
        self.found: dict[str, tuple[int, int] | None] = {}

    def forget(self) -> None:
        """Drops all states made so far; they are made again when met."""
        self.states: dict[frozenset, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.sets: list[dict[int, int]] = []
        self.stem_at: list[int] = []
        #: Best (edits, term) where a word ends: of all, and of short terms for words with other signs than letters.
        self.word_at: list[tuple[int, int] | None] = []
        self.sign_at: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def budget(self, k: int) -> int:
        term, stem, fuzzy = self.terms[k]
        return edits(term) if fuzzy and not stem else 0

    def _state(self, at: dict[int, int]) -> int:
        """The number of a set of positions {node: fewest edits}, closed under skipped term characters."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and at.get(child, 9) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.arcs)
            self.arcs.append({})
            self.sets.append(at)
            ended = [(e, k) for node, e in at.items() for k in self.ends.get(node, ()) if e <= self.budget(k)]
            self.stem_at.append(min([k for e, k in ended if self.terms[k][1]], default=-1))
            words = [x for x in ended if not self.terms[x[1]][1]]
            sure = [x for x in words if not x[0] or plain(self.terms[x[1]][0])]
            self.word_at.append(min(sure, default=None))
            self.sign_at.append(min(words, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for sign, child in self.children[node].items():
                cost = e + (sign != c)
                if cost <= self.reach[child] and to.get(child, 9) > cost:
                    to[child] = cost
            if e + 1 <= self.reach[node] and to.get(node, 9) > e + 1:
                to[node] = e + 1
        new = self._state(to) if to else -1
        self.arcs[state][c] = new
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best term of a lower-case word; stems match with no edit."""
        state, arcs, stem = self.start, self.arcs, -1
        for c in word:
            state = arcs[state].get(c, -2)
            if state == -2:
                state = self._step(self._last, c)
            if state == -1:
                break
            self._last = state
            if stem < 0:
                stem = self.stem_at[state]
        best = None if state < 0 else self.word_at[state] if word.isalpha() else self.sign_at[state]
        if stem >= 0 and (best is None or best[0] > 0):
            best = (0, stem)
        return None if best is None or best[0] and word in self.harmless else best

    _last = 0

    def hit(self, word: str) -> tuple[int, int] | None:
        if word in self.found:
            return self.found[word]
        if len(self.found) >= CACHE:
            self.found.clear()
        if len(self.arcs) >= STATES:
            self.forget()
        self._last = self.start
        self.found[word] = out = self.match(word)
        return out


def matcher_of(terms: list[tuple[str, bool, bool]], harmless: frozenset[str]) -> Matcher:
    """One matcher for each worker, with its states."""
    return kept_by_worker(("toxicity", tuple(terms), harmless), lambda: Matcher(terms, harmless))


def is_quoted(text: str, begin: int, end: int) -> bool:
    """Whether the window around text[begin:end] marks a quotation."""
    left, right = text[max(0, begin - WINDOW) : begin], text[end : end + WINDOW]
    opened = max(left.rfind(q) for q in OPENING)
    closed = min([at for q in CLOSING if (at := right.find(q)) >= 0], default=-1)
    if opened >= 0 and closed >= 0 and "\n" not in left[opened:] + right[:closed]:
        return True
    return any(w in REPORT for w in WORD.findall(left)[-4:])


#: Inputs of the model: log counts of abuse (exact, stem, misspelled), of quotations, and density.
FEATURES = 5
PRIOR = np.array([3.0, 3.0, 3.0, 0.5, 0.0])


def features(text: str | None, matcher: Matcher) -> tuple[np.ndarray, list[str]]:
    """Inputs of the model, and the misspelled forms met."""
    low = (text or "").lower()
    found = WORD.findall(low)
    hits = {w: h for w in set(found) if (h := matcher.hit(w)) is not None}
    counts = np.zeros(FEATURES)
    if hits:
        for m in WORD.finditer(low):
            if (h := hits.get(m[0])) is not None:
                counts[3 if is_quoted(low, m.start(), m.end()) else 2 if h[0] else 1 if matcher.terms[h[1]][1] else 0] += 1
        counts[4] = 100 * counts[:3].sum() / len(found)
    return np.log1p(counts), [w for w, h in hits.items() if h[0]]


@dataclass
class Model:
    terms: list[tuple[str, bool, bool]]
    harmless: frozenset[str]
    weights: np.ndarray
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -30, 30)))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, bad, good): rows of either label (text, y) with a word or a prefix of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list({*seen[0], *seen[1]})
            out = pa.RecordBatch.from_arrays([pa.array([k[1:] for k in keys]), pa.array([k[0] == "^" for k in keys]), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "stem", "bad", "good"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {w for w in WORD.findall((text or "").lower()) if 3 <= len(w) <= 40}
                seen[y].update({"=" + w for w in own} | {"^" + w[:k] for w in own for k in range(4, min(9, len(w)))})
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        yield flush()

    found = rows.mapInArrow(run, "term string, stem boolean, bad long, good long")
    return found.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def chosen(counts: list[tuple[str, bool, int, bool]]) -> list[tuple[str, bool, bool]]:
    """Terms that add to the rows covered: longest first among equals, stems over the words they begin. Words
    whose misspellings are sought stay beside their stem, since stems match with no edit."""
    out: list[tuple[str, bool, int, bool]] = []
    for term, stem, bad, fuzzy in sorted(counts, key=lambda x: (-x[2], x[1], -len(x[0]), x[0])):
        covered = (stem or not fuzzy) and any(s and term.startswith(t) for t, s, _, _ in out)
        same = stem and any(t.startswith(term) and bad <= 1.1 * b for t, _, b, _ in out)
        if not covered and not same:
            out.append((term, stem, bad, fuzzy))
    return [(t, s, f) for t, s, _, f in out]


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, shrunk towards PRIOR."""
    if not len(y) or not y.any():
        return PRIOR.copy(), float(np.log(0.01))
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.append(PRIOR, -4.0)
    prior, hold = w.copy(), np.append(np.ones(FEATURES), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (y - p) - hold * (w - prior))
        w += step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def family_of(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(family)

    return F.pandas_udf(run, "long")(text)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled rows of docs: labels holds the rows to learn from (id, label 0 or 1)."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.least(F.max("_y"), F.lit(1)).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # At most fit_rows pairs of numbers, so safe to broadcast.
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id").select("text", F.col("_y").alias("y"), (F.crc32(F.col("_id").cast("string").cast("binary")) % 8 < 4).alias("half"))
    # Near copies would pass for independent evidence: of each family and label, one row is learnt from.
    rows = cut(picked.withColumn("family", family_of(F.col("text"))).groupBy("family", "y").agg(F.min_by(F.struct("text", "half"), "text").alias("row")).select("row.text", "y", "row.half"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    share, n = bad / max(1, bad + good), F.col("bad") + F.col("good")
    evidence = F.col("bad") * F.log(F.col("bad") / n / share) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - share))).otherwise(0) if bad and good else F.lit(0.0)
    best = term_counts(rows).where((F.col("bad") > share * n)).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("bad"), "stem", F.desc(F.length("term")), "term").limit(MAX_TERMS * 8)
    terms = chosen([(r["term"], r["stem"], r["bad"], r["evidence"] >= FUZZY_EVIDENCE) for r in best.collect()])[:MAX_TERMS] if bad else []

    def inputs(harmless: frozenset[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(terms, harmless)
            for batch in batches:
                got = [features(t, matcher) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.string())), batch.column(1), batch.column(2)], names=["x", "forms", "y", "half"])

        return rows.mapInArrow(run, "x array<double>, forms array<string>, y int, half boolean")

    def forms(which: Column) -> frozenset[str]:
        good_forms = inputs(frozenset()).where(which & (F.col("y") == 0)).select(F.explode("forms").alias("form")).distinct()
        return frozenset(r["form"] for r in good_forms.collect())  # forms close to a term, of fit_rows texts at most

    # Misspellings are judged on rows that didn't tell which forms are harmless.
    first = forms(F.col("half"))
    got = inputs(first).where(~F.col("half")).select("x", "y").collect()  # fit_rows at most
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got], float)
    weights, intercept = fit_weights(x, y)
    return Model(terms, first | forms(~F.col("half")), weights, intercept)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the double out from 0 to 1, in place of a column of that name."""
    learnt = docs.sparkSession.sparkContext.broadcast((model.terms, model.harmless))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(*learnt.value)
        for texts in batches:
            yield pd.Series(model.scores(np.array([features(t, matcher)[0] for t in texts]).reshape(-1, FEATURES)))

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def keep_harmless(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below THRESHOLD, with the columns of docs; held-out labels aren't read."""
    flag = free_name("_score", docs)
    model = learn(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col)
    return scored(docs, model, text_col, flag).where(F.col(flag) < THRESHOLD).drop(flag)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = scored(docs, learn(docs, labels.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
