"""Toxicity by a learned lexicon: Levenshtein automata run against a trie of its terms.

Learning. Among labelled documents (about ``sample_rows`` of them, the documented bound),
Spark counts for each word and word beginning the toxic and the clean documents that have it,
and in how many different surroundings (word before, word after) toxic documents have it.
Terms that toxic documents favour by ``LEAST_ODDS`` in log odds, in ``LEAST_SUPPORT`` or more
surroundings, and that next to no clean ones have, make the lexicon; surroundings, not documents, so that words of a text with many
copies don't pass. A word beginning stands for its words if many of them are toxic.

Matching. The terms form a trie; a word is read by the Levenshtein automata of all terms at
once, as sets of (trie node, errors so far) that are made when first met and kept. Terms of
``FUZZY_CHARS`` letters or more may have one wrong, missing, added or swapped letter, the first
one too, unless clean documents have words that close to them; word beginnings none.

Scoring. Each hit counts its log odds, a misspelt one less, and less again in a window that
speaks about words: quotation marks on both sides, or words such as "said" or "quoted" close
by. The score is 1 - exp(-sum / SCALE).

Defined results: null and empty texts score 0; without labels of both kinds the lexicon is
empty and every score is 0; of several labels of an id the highest counts, null labels and
ids are left out; a row per row, repeated ones too; an empty table gives an empty result.
Very long texts are read whole. Columns other than id and text are not read. The lexicon is all that passes; its size is
bounded by the words of the sampled documents, each term being in ``LEAST_SUPPORT`` surroundings of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import WORD, bounded_sample, whole_text
from platter.session import stored

SAMPLE_ROWS = 30_000
LEAST_ODDS = 4.5
CLEAN_SHARE = 0.02
LEAST_SUPPORT = 6
STEM_CHARS = (4, 5, 6)
STEM_WORDS = 3
FUZZY_CHARS = 4
FUZZY_FACTOR = 0.5
QUOTED_FACTOR = 0.35
WINDOW = 6
SCALE = 4.0

#: Words that report speech or speak about words, and marks of quotation.
REPORTING = frozenset("said says quote quoted quotes called wrote written word words term terms slur insult reported citing cited".split())
OPENING, CLOSING = "\"“«„‘'", "\"”»“’'"

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """A lower-case word without the marks around it."""
    return word if word.isalpha() else _EDGES.sub("", word)


class Automaton:
    """All Levenshtein automata of a lexicon over its trie, made deterministic as words are read."""

    DEAD = 0

    def __init__(self, words: dict[str, float], stems: dict[str, float], exact: frozenset[str] = frozenset(), most_states: int = 100_000):
        self.most_states = most_states
        self.term: dict[int, str] = {}
        self.child: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]  # a word that may be misspelt passes here
        self.close: dict[int, bool] = {}  # may the word that ends here be misspelt?
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for term, weight in terms.items():
                node = 0
                for at, ch in enumerate(term):
                    if ch not in self.child[node]:
                        self.child[node][ch] = len(self.child)
                        for column, empty in ((self.child, {}), (self.word, 0.0), (self.stem, 0.0), (self.fuzzy, False)):
                            column.append(empty if column is not self.child else {})
                    node = self.child[node][ch]
                    if ends is self.word and len(term) >= FUZZY_CHARS and term not in exact:
                        self.fuzzy[node] = True
                ends[node] = max(ends[node], weight)
                if ends is self.word:
                    self.term[node] = term
                    self.close[node] = len(term) >= FUZZY_CHARS and term not in exact
        self._reset()

    def _reset(self) -> None:
        #: A state: (items, weight of a stem that was passed); an item: (node, errors, letter to come after a swap).
        self.states: list[tuple[frozenset, float]] = [(frozenset(), 0.0), (frozenset({(0, 0, "")}), 0.0)]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: dict[int, float] = {}

    def _step(self, state: int, ch: str) -> int:
        items, passed = self.states[state]
        out = set()
        for node, errors, due in items:
            nexts = self.child[node]
            if due:
                if ch == due:
                    out.add((node, 1, ""))
                continue
            if ch in nexts:
                out.add((nexts[ch], errors, ""))
                if not errors:
                    passed = max(passed, self.stem[nexts[ch]])
            if errors:
                continue
            out.add((node, 1, ""))  # a letter too many
            for other, to in nexts.items():
                if not self.fuzzy[to]:
                    continue
                out.add((to, 1, ""))  # a wrong letter
                after = self.child[to]
                if ch in after:
                    out.add((after[ch], 1, ""))  # a letter is missing
                    out.add((after[ch], 1, other))  # two letters are swapped
        exact = {node for node, errors, due in out if not errors}
        made = (frozenset(i for i in out if not (i[1] and not i[2] and i[0] in exact)), passed)
        if not made[0] and not passed:
            return self.DEAD
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
        return self.number[made]

    def _misspelt(self, state: int) -> Iterator[int]:
        """Ends of words that what was read up to ``state`` misspells."""
        for node, errors, due in self.states[state][0]:
            if errors and not due and self.close.get(node):
                yield node
            if not errors and node:  # the last letter is missing
                yield from (to for to in self.child[node].values() if self.close.get(to))

    def _end(self, state: int) -> float:
        items, passed = self.states[state]
        exact = [self.word[node] for node, errors, due in items if not errors]
        return max([passed, *exact, *(self.word[node] * FUZZY_FACTOR for node in self._misspelt(state))])

    def misspelt(self, word: str) -> list[str]:
        """The terms that ``word`` misspells."""
        state = 1
        for ch in word:
            state = self._step(state, ch)
            if not state:
                return []
        return [self.term[node] for node in self._misspelt(state)]

    def read(self, word: str) -> float:
        """Weight of the best term that the word is, 0 if it is none."""
        if len(self.states) > self.most_states:
            self._reset()
        state, steps = 1, self.steps
        for ch in word:
            key = (state, ch)
            to = steps.get(key)
            if to is None:
                to = steps[key] = self._step(state, ch)
            if not to:
                return 0.0
            state = to
        if state not in self.ends:
            self.ends[state] = self._end(state)
        return self.ends[state]


class Scorer:
    """Lexicon in one worker, with the weights of words it has read, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exact: frozenset[str] = frozenset(), seen_words: int = 200_000):
        self.automaton = Automaton(words, stems, exact)
        self.seen_words = seen_words
        self.seen: dict[str, float] = {}

    def _factor(self, words: list[str], at: int) -> float:
        before, after = words[max(0, at - WINDOW) : at + 1], words[at : at + WINDOW + 1]
        opened = any(w[0] in OPENING for w in before)
        closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING and w.rstrip(".,;:!?") for w in after)
        reported = any(bare(w) in REPORTING for w in before[:-1] + after[1:])
        return QUOTED_FACTOR if opened and closed or reported else 1.0

    def score(self, text: str) -> float:
        words = WORD.findall(text.lower())
        seen = self.seen
        new = {w for w in words if w not in seen}
        if len(seen) + len(new) > self.seen_words:
            seen.clear()
            new = set(words)
        for w in new:
            seen[w] = self.automaton.read(bare(w))
        total = 0.0
        for at, weight in enumerate([seen[w] for w in words]):
            if weight:
                total += weight * self._factor(words, at)
        return 1.0 - math.exp(-total / SCALE)


def _terms(word: str) -> list[tuple[str, bool]]:
    return [(word, False), *((word[:n], True) for n in STEM_CHARS if len(word) > n)]


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """Words and word beginnings with their log odds, and the words that must be spelt right; ``labels`` holds only rows that may be learned from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    known = bounded_sample(known.agg(F.max(F.col(label_col)).cast("int").alias("y")), "label_id", sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).join(known, F.col("id") == F.col("label_id")).select("y", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "stem", "near", "word", "toxic", "clean"]

        def flush():
            keys = list(tally)
            tally_values = [tally[k] for k in keys]
            columns = [*zip(*keys)] if keys else [()] * 4
            out = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())]
            out += [pa.array([v if k[4] else 0 for k, v in zip(keys, tally_values)], pa.int64()), pa.array([0 if k[4] else v for k, v in zip(keys, tally_values)], pa.int64())]
            tally.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        tally: Counter = Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in map(bare, WORD.findall(text.lower())) if len(w) > 2]
                tally[("", False, 0, 0, bool(y))] += 1
                if y:
                    #: One row for each term and document, with the surroundings it is first met in.
                    first: dict[tuple[str, bool], tuple[int, int]] = {}
                    for at, w in enumerate(words):
                        for term in _terms(w):
                            if term not in first:
                                around = f"{words[at - 1] if at else ''} {words[at + 1] if at + 1 < len(words) else ''}"
                                first[term] = (xxhash.xxh64_intdigest(around) >> 1, xxhash.xxh64_intdigest(w) >> 1)
                    tally.update((*term, *where, True) for term, where in first.items())
                else:
                    tally.update((*term, 0, 0, False) for term in {t for w in set(words) for t in _terms(w)})
                if len(tally) > 200_000:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "term string, stem boolean, near bigint, word bigint, toxic bigint, clean bigint")
    by_place = counts.groupBy("term", "stem", "near", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = by_place.groupBy("term", "stem").agg(
        F.sum("toxic").alias("toxic"),
        F.sum("clean").alias("clean"),
        F.count(F.when(F.col("toxic") > 0, 1)).alias("places"),
        F.size(F.collect_set(F.when((F.col("toxic") > 0) & F.col("stem"), F.col("word") % 64))).alias("words"),
    )
    totals = stored(totals, "terms")
    n = known.groupBy("y").count().collect()  # two rows at most
    n_toxic = sum(r["count"] for r in n if r["y"])
    n_clean = sum(r["count"] for r in n if not r["y"])
    if not n_toxic or not n_clean:
        return {}, {}, frozenset()
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit((n_clean + 1.0) / (n_toxic + 1.0)))
    good = totals.where((F.col("term") != "") & (F.col("places") >= LEAST_SUPPORT) & (F.col("clean") <= CLEAN_SHARE * F.col("toxic"))).withColumn("odds", odds)
    good = good.where((F.col("odds") >= LEAST_ODDS) & (~F.col("stem") | (F.col("words") >= STEM_WORDS)))
    best = good.orderBy(F.desc("places"), "term", "stem").collect()  # each has LEAST_SUPPORT places in the sampled documents
    stems: dict[str, float] = {}
    for r in sorted((r for r in best if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        if not any(r["term"][:k] in stems for k in STEM_CHARS):
            stems[r["term"]] = r["odds"]
    words = {r["term"]: r["odds"] for r in best if not r["stem"]}
    #: A word beginning that one word makes up is that word.
    single = {s for s in stems if any(w.startswith(s) and r_toxic * 2 > s_toxic for w, r_toxic, s_toxic in _shares(best, s))}
    stems = {s: o for s, o in stems.items() if s not in single}
    loose = Automaton(words, {})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(term, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in words for term in loose.misspelt(w)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["term", "n"])

    clean_words = totals.where(~F.col("stem") & (F.col("clean") > 0)).select("term", "clean")
    beside = clean_words.mapInArrow(close, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # lexicon rows at most
    support = {r["term"]: r["toxic"] for r in best if not r["stem"]}
    return words, stems, frozenset(r["term"] for r in beside if r["n"] > CLEAN_SHARE * support[r["term"]])


def _shares(best: list, stem: str) -> list[tuple[str, int, int]]:
    whole = max(r["toxic"] for r in best if r["stem"] and r["term"] == stem)
    return [(r["term"], r["toxic"], whole) for r in best if not r["stem"] and r["term"].startswith(stem)]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id and ``score``; ``learn_from`` says which labels may be read."""
    words, stems, exact = learn(docs, labels.where(learn_from), id_col, text_col, label_col, sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, stems, exact)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
