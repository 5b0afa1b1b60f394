"""Language identification by cross-parsing entropy with suffix automata.

For each language a suffix automaton of labelled text gives, at any place of a new text, the longest
match with that language's text. Cutting the new text into such longest matches, each from where the
last one ended (Ziv-Merhav cross-parsing), needs few phrases in its own language and many in others.
Phrases run across words. Each language's count is weighted with the log of its training size, and the
smallest wins (of equal ones the first by name).

All texts of a batch are parsed side by side: one step reads the next character of each in each
language. When few texts are left, their rests are read one by one.

Bounds. An automaton holds LANG_CHARS characters, and fewer with more than TOTAL_CHARS / LANG_CHARS
languages, cut from the texts of about SAMPLE_ROWS different labelled ones of its language, one at least,
whatever the input's size. Of more than MOST_LANGS languages, the most frequent can be predicted.

Texts are read lower-cased, with all but letters as single spaces, also in front and behind. Null texts
and texts without a letter get `und` and score 0. The score is the margin to the second language, from 0
to 1 (1 if there is but one). Without any labelled row every text is `und`. Repeated rows, null ids and
extra columns stay as they are, but for one with the result's name, which it replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import END_CODE, Table, by_size, codes_of
from tidemark.llm.common import held_out, kept_by_worker, table

LANG_CHARS, TOTAL_CHARS = 20_000, 400_000
SAMPLE_ROWS, PIECE = 120, 200
MOST_LANGS = 500
#: Characters that are brought to classes at a time, and texts that are no longer parsed side by side.
BATCH_CHARS, FEW = 1 << 20, 128


class SuffixAutomaton:
    """All substrings of a text, as one dict of transitions per state."""

    def __init__(self, text: Sequence) -> None:
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: Sequence, state: int = 0, n: int = 0) -> int:
        """Longest matches that make up text, n and a match up to state before it; a character that never
        occurs is one by itself."""
        arcs = self.next
        for c in text:
            to = arcs[state].get(c)
            if to is None:
                n += state != 0
                to = arcs[0].get(c)
                if to is None:
                    n, to = n + 1, 0
            state = to
        return n + (state != 0)


class Parser:
    """Phrase counts of texts in each language."""

    def __init__(self, training: dict[str, str]) -> None:
        self.langs = sorted(training)
        self.weights = np.array([math.log(len(training[k]) + 2) for k in self.langs])
        #: Classes of characters: 0 is all that is no letter, the last one letters without training text.
        letters = sorted({c for t in training.values() for c in t.lower() if c.isalpha()})
        self.n_classes = len(letters) + 2
        kind = np.uint16 if self.n_classes <= 1 << 16 else np.uint32
        self.classes = np.array([(len(letters) + 1) * chr(c).isalpha() for c in range(END_CODE)] + [0], kind)
        self.classes[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        self.automata = [SuffixAutomaton(self.read([training[k]])[0].tolist()) for k in self.langs]
        self.first = np.cumsum([0, *[len(a.next) for a in self.automata]])[:-1]
        arcs = [((int(first) + state) * self.n_classes + c, int(first) + to) for first, a in zip(self.first, self.automata, strict=True) for state, own in enumerate(a.next) for c, to in own.items()]
        self.arcs = Table(np.array([k for k, _ in arcs], np.uint64), np.array([to for _, to in arcs], np.int32))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(classes, ends, letters): of all texts, joined, where each one's end, and how many letters it has."""
        codes, ends = codes_of([f" {t.lower()} " for t in texts])
        classes = self.classes[codes]
        codes[ends] = 0
        keep = np.append(True, (classes[1:] != 0) | (classes[:-1] != 0))
        keep[ends] = False
        keep[ends[:-1] + 1] = True  # each text's space in front
        return classes[keep], np.cumsum(keep)[ends], np.diff(np.append(0, np.cumsum(classes != 0)[ends]))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, letters by text)."""
        parts = [self.read(some) for some in by_size(texts, BATCH_CHARS)]
        classes = np.concatenate([p[0] for p in parts])
        n = np.concatenate([np.diff(np.append(0, p[1])) for p in parts])
        begins = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        at, n = begins[order], n[order]
        roots, n_classes = self.first.astype(np.uint64)[:, None], np.uint64(self.n_classes)
        state, count = np.repeat(roots, len(n), 1), np.zeros((len(self.langs), len(n)), np.int64)
        step = 0
        while (m := int(np.searchsorted(-n, -step))) >= FEW:
            c = classes[at[:m] + step].astype(np.uint64)
            own = state[:, :m]
            to = self.arcs.find((own * n_classes + c).ravel()).reshape(own.shape)
            lang, text = np.nonzero(to < 0)
            if len(lang):
                at_root = own[lang, text] == roots[lang, 0]
                again = np.where(at_root, -1, self.arcs.find(roots[lang, 0] * n_classes + c[text]))
                count[lang, text] += ~at_root
                count[lang, text] += again < 0
                to[lang, text] = np.where(again < 0, self.first[lang], again)
            state[:, :m] = to
            step += 1
        count[:, m:] += state[:, m:] != roots
        for k in range(m):
            rest = classes[at[k] + step : at[k] + n[k]].tolist()
            count[:, k] = [a.phrases(rest, int(state[j, k] - roots[j, 0]), int(count[j, k])) for j, a in enumerate(self.automata)]
        out = np.empty_like(count.T)
        out[order] = count.T
        return out, np.concatenate([p[2] for p in parts])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs or not texts:
            return [("und", 0.0)] * len(texts)
        counts, letters = self.counts(texts)
        costs = counts * self.weights
        order = np.argsort(costs, 1, kind="stable")
        best, second = (np.take_along_axis(costs, order[:, k : k + 1], 1)[:, 0] for k in (0, min(1, len(self.langs) - 1)))
        scores = 1 - best / np.maximum(second, 1e-9) if len(self.langs) > 1 else np.ones(len(best))
        return [(self.langs[k], s) if n else ("und", 0.0) for k, s, n in zip(order[:, 0].tolist(), scores.tolist(), letters.tolist(), strict=True)]


def training_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Text of each language, at most LANG_CHARS; docs holds the labelled rows alone."""
    mix = F.xxhash64("text")
    place = F.pmod(mix, F.greatest(F.length("text") - PIECE, F.lit(1))).cast("int") + 1
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", mix.alias("mix"), F.substring("text", place, F.lit(PIECE)).alias("piece")).where(F.col("piece").rlike(r"\p{L}"))
    # Different texts are counted, so many copies of a few leave the others their share.
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("mix").alias("texts"), F.min(F.struct("mix", "piece")).alias("first")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not found:
        return {}
    share = F.element_at(F.from_json(F.lit(pd.Series({r["lang"]: min(1.0, sample_rows / r["texts"]) for r in found}).to_json()), "map<string,double>"), F.col("lang"))
    pieces = {r["lang"]: {(r["first"]["mix"], r["first"]["piece"])} for r in found}
    for r in rows.where(F.shiftrightunsigned("mix", 11) / float(1 << 53) < share).distinct().collect():  # about sample_rows pieces for each language
        pieces[r["lang"]].add((r["mix"], r["piece"]))
    room = min(LANG_CHARS, TOTAL_CHARS // len(found))
    return {k: " ".join(p for _, p in sorted(v))[:room] for k, v in pieces.items()}


def parser_of(training: dict[str, str]) -> Parser:
    """One parser for each worker and training."""
    return kept_by_worker(("langid", tuple(sorted(training.items()))), lambda: Parser(training))


def identified(docs: DataFrame, training: dict[str, str], text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with the struct out of lang and score."""
    sent = docs.sparkSession.sparkContext.broadcast(training)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = parser_of(sent.value)
        for texts in batches:
            yield pd.DataFrame(parser.predict([t or "" for t in texts]), columns=["lang", "score"])

    return docs.withColumn(out, F.pandas_udf(run, "lang string, score double")(F.col(text_col).cast("string")))


def learnable(id_: Column) -> Column:
    return ~held_out(id_)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = training_texts(docs.where(learnable(F.col("doc_id"))))
    out = identified(docs.select("doc_id", "text"), training)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {"op10_langid": op10_langid}
ORACLES: dict[str, str] = {}
