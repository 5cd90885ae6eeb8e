"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

1. From a bounded labelled sample, words that toxic texts have and others lack become the
   lexicon, with a short list of fixed terms. Groups of near copies count once: texts with
   the same least word hash vote together. Stems shared by several such words are kept too.
2. The lexicon is a trie. The Levenshtein automaton of a word, which accepts all strings within
   so many edits of it, walks the trie together with it, so misspelled terms are found without
   comparing with each term. Words may hold digits and marks for letters.
3. Every hit is seen in its window of text: quotation marks and verbs of reporting speak for
   quotation, words that address someone for abuse.
4. Logistic regression gives the score. The context enters it twice: hits that are quoted count
   apart from all others and add nothing to weight, rate or number of terms, and hits that stand
   by a word of address count once more. Rows are scored by themselves; nothing shuffles but
   the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.common import materialize, small_slices
from geolattice.llm.labels import draw_labelled, fit_logistic, sigmoid

#: Terms of abuse known without labels.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
#: Words that introduce reported speech, and words that address someone.
REPORTING = ("said", "says", "wrote", "quote", "quoted", "quoting", "called", "dit", "cite", "sagte", "zitat", "dijo", "cita")
ADDRESSING = ("you", "your", "youre", "tu", "vous", "toi", "du", "dich", "ihr", "usted", "ustedes", "eres")

WINDOW = 60
WORD = re.compile(r"[^\W\d_]{3,}")
#: Runs of letters, digits and marks that hold a digit or mark; their letters are words besides.
_MIXED = re.compile(r"(?<![\w@$!*+|])[^\W\d_]*+[0-9@$!*+|]++(?:[^\W_]|[@$!*+|])*+")
#: Digits and marks that are written for letters.
WRITTEN_FOR = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "$", "t": "+", "u": "*"}
#: Kinds of hits: an exact term, a stem, a misspelled sure term, another misspelled term.
EXACT, STEM, BENT, DOUBTFUL = range(4)
FEATURES = 10


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict[str, float]
    stems: tuple[str, ...]
    sure: tuple[str, ...] = SEED_TERMS  # terms whose misspellings are strong evidence
    edits: int = 1  # of the Levenshtein automaton
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    intercept: float = -3.0


class LevenshteinAutomaton:
    """Accepts the strings within ``most`` edits of a word: inserts, deletes, replacements and swaps of neighbours.

    A state is, for each number of edits, the set of prefixes of the word that may have been
    read, as bits, and after them the prefixes that wait for the second letter of a swap.
    """

    def __init__(self, word: str, most: int) -> None:
        self.most, self.final = most, 1 << len(word)
        self.all = (self.final << 1) - 1
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.known: dict[tuple, tuple] = {}
        read = [1]
        for _ in range(most):
            read.append(read[-1] | read[-1] << 1 & self.all)
        self.start = (*read, *([0] * most))

    def step(self, state: tuple, letter: str) -> tuple | None:
        """The state after one more letter, or None if no string goes on from there."""
        if (state, letter) in self.known:
            return self.known[state, letter]
        most, here = self.most, self.places.get(letter, 0)
        read: list[int] = []
        for e in range(most + 1):
            bits = (state[e] & here) << 1
            if e:
                less = state[e - 1]
                bits |= less | less << 1 | read[e - 1] << 1 | (state[most + e] & here) << 2
            read.append(bits & self.all)
        swaps = [state[e] & here >> 1 for e in range(most)]
        after = (*read, *swaps) if any(read) or any(swaps) else None
        self.known[state, letter] = after
        return after

    def edits(self, state: tuple) -> int | None:
        """Least number of edits with which the string read so far is accepted."""
        return next((e for e in range(self.most + 1) if state[e] & self.final), None)


class LexiconTrie:
    """Trie of words, intersected with the Levenshtein automaton of a query."""

    END = ""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[self.END] = word

    def find(self, word: str, most: int = 1) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within ``most`` edits; of equally near ones the smallest."""
        automaton = LevenshteinAutomaton(word, most)
        best: tuple[int, str] | None = None
        stack = [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == self.END:
                    edits = automaton.edits(state)
                    if edits is not None and (best is None or (edits, child) < best):
                        best = (edits, child)
                elif (after := automaton.step(state, c)) is not None:
                    stack.append((child, after))
        return (best[1], best[0]) if best else None


def shortened(word: str, most: int) -> set[str]:
    """The word and all that is left of it after up to ``most`` deletions."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Shortened:
    """Tells words that cannot be within so many edits of any term.

    Two words within k edits have a word in common that is left of both after k deletions at
    most, so a word none of whose shortened forms is one of a term's needs no search.
    """

    def __init__(self, terms, most: int) -> None:
        self.most = most
        self.known = {w for t in terms for w in shortened(t, most)}
        self.longest = max(map(len, terms), default=0) + most

    def may_match(self, word: str) -> bool:
        return len(word) <= self.longest and not self.known.isdisjoint(shortened(word, self.most))


class Matcher:
    """Looks words up in lexicon and stems, remembering what it has seen."""

    MOST_REMEMBERED = 400_000

    def __init__(self, model: ToxicityModel) -> None:
        self.terms, self.sure, self.edits = model.terms, set(model.sure), model.edits
        sought = {t for t in {*model.terms, *model.sure} if len(t) >= 4}
        self.trie = LexiconTrie(sought)
        self.filter = Shortened(sought, model.edits)
        self.stems = re.compile("|".join(map(re.escape, sorted(model.stems)))) if model.stems else None
        self.seen: dict[str, tuple[float, int] | None] = {}

    def kind(self, word: str) -> tuple[float, int] | None:
        """(weight, kind of hit), or None."""
        if word in self.seen:
            return self.seen[word]
        found: tuple[float, int] | None = None
        if word in self.terms:
            found = (self.terms[word], EXACT)
        elif self.stems is not None and self.stems.match(word):
            found = (1.0, STEM)
        elif self.filter.may_match(word) and (near := self.trie.find(word, self.edits)):
            sure = near[0] in self.sure and len(near[0]) >= 5
            found = (self.terms.get(near[0], 5.0), BENT if sure else DOUBTFUL)
        if len(self.seen) >= self.MOST_REMEMBERED:
            self.seen.clear()
        self.seen[word] = found
        return found


_MARKS = re.compile("[\"“”„«»]")
_REPORTING = re.compile(r"\b(?:%s)\b" % "|".join(REPORTING))
_ADDRESSING = re.compile(r"\b(?:%s)\b" % "|".join(ADDRESSING))


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the hit stands between quotation marks in its window, or a verb of reporting precedes it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if _REPORTING.search(before):
        return True
    return len(_MARKS.findall(before)) % 2 == 1 and bool(_MARKS.search(after))


def mixed_tokens(low: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens in which digits or marks stand among letters; marks of exclamation and the like at the ends are none."""
    found = []
    for m in _MIXED.finditer(low):
        token = m.group().rstrip("!*+|")
        start = m.end() - len(m.group()) + len(token) - len(token.lstrip("!*+|"))
        token = token.lstrip("!*+|")
        if len(token) > 1 and not token.isalpha() and any(map(str.isalpha, token)):
            found.append((start, start + len(token), token))
    return found


def features(text: str, matcher: Matcher) -> list[float]:
    low = text.lower()
    words, mixed = WORD.findall(low), mixed_tokens(low)
    kinds = {w: k for w in {*words, *(t for _, _, t in mixed)} if (k := matcher.kind(w)) is not None}
    if not kinds:
        return [0.0] * FEATURES
    plain, quoted = [0, 0, 0, 0], 0
    addressed, weight, distinct = 0, 0.0, set()
    for start, end, word in [*((m.start(), m.end(), m.group()) for m in WORD.finditer(low) if m.group() in kinds), *(t for t in mixed if t[2] in kinds)]:
        k = kinds[word]
        if is_quoted(low, start, end):
            quoted += 1
            continue
        plain[k[1]] += 1
        weight = max(weight, k[0] / (1 + k[1]))
        if k[1] <= STEM:
            distinct.add(word)
        if k[1] < DOUBTFUL:
            addressed += bool(_ADDRESSING.search(low[max(0, start - WINDOW) : end + WINDOW]))
    told = plain[EXACT] + plain[STEM]
    rate = 100.0 * told / max(1, len(words))
    return [*np.log1p(plain).tolist(), float(np.log1p(quoted)), weight, float(np.log1p(len(distinct))), float(np.log1p(rate)), float(np.log1p(addressed)), float(told > 0)]


def learn_lexicon(sample: DataFrame, most_terms: int = 3000, least_votes: int = 3) -> tuple[dict[str, float], tuple[str, ...], tuple[str, ...]]:
    """Terms with their log odds, stems, and the terms that are sure, from (id, text, label) rows with both labels.

    Of all words of the sample only the ``most_terms`` best reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,24}"), F.lit(0)))
    rows = sample.select("label", words.alias("words")).filter("size(words) > 0")
    voices = rows.select("label", "words", F.array_min(F.transform("words", lambda w: F.xxhash64(w))).alias("voice"))
    votes = voices.select("label", "voice", F.explode("words").alias("word")).groupBy("word", "voice").agg(F.max("label").alias("toxic"))
    table = materialize(votes.groupBy("word").agg(F.sum("toxic").alias("tox"), F.sum(1 - F.col("toxic")).alias("non")), "word-votes")
    totals = voices.groupBy("label").agg(F.countDistinct("voice").alias("n")).collect()
    n = {r.label: r.n for r in totals}
    tox, non = n.get(1, 0), n.get(0, 0)
    if not tox or not non:
        return dict.fromkeys(SEED_TERMS, 5.0), (), SEED_TERMS
    share = tox / (tox + non)

    def telling(df: DataFrame, evidence: float) -> DataFrame:
        """Rows whose votes speak for toxic texts: log odds over 3, and so much divergence from the shares of all voices."""
        votes = F.col("tox") + F.col("non")
        odds = F.log((F.col("tox") + 0.5) / tox) - F.log((F.col("non") + 0.5) / non)
        part = lambda c, q: F.when(c > 0, c * F.log(c / (votes * q))).otherwise(0.0)
        told = part(F.col("tox"), share) + part(F.col("non"), 1 - share)
        return df.withColumns({"odds": odds, "told": told}).filter((F.col("odds") >= 3.0) & (F.col("told") >= evidence))

    best = telling(table.filter(F.col("tox") >= least_votes), 6.5).orderBy(F.desc("odds"), "word").limit(most_terms)
    listed = best.collect()
    terms = {r.word: float(r.odds) for r in listed}
    sure = sorted({*SEED_TERMS, *(r.word for r in listed if r.told >= 15)})
    cut = F.explode(F.expr("transform(filter(sequence(4, 8), k -> k < char_length(word)), k -> substring(word, 1, k))")).alias("stem")
    stems = table.select(cut, "tox", "non").groupBy("stem").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"), F.sum((F.col("tox") > 0).cast("int")).alias("words"))
    good = telling(stems.filter("words >= 3"), 15.0)
    found = sorted(r.stem for r in good.orderBy(F.desc("tox"), "stem").limit(most_terms).collect())
    shortest = [s for s in found if not any(s != t and s.startswith(t) for t in found)]
    return {**dict.fromkeys(SEED_TERMS, 5.0), **terms}, tuple(shortest), tuple(sure)


def misspelled(text: str, terms) -> str:
    """The text with the middle letters of every lexicon term of five letters or more swapped."""

    def bend(m: re.Match) -> str:
        w, at = m.group(), len(m.group()) // 2
        return w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :] if len(w) >= 5 and w.lower() in terms else w

    return WORD.sub(bend, text)


def masked(text: str, terms) -> str:
    """The text with one letter inside every lexicon term of four letters or more written as a digit or mark."""

    def mask(m: re.Match) -> str:
        w = m.group()
        at = next((i for i in range(1, len(w) - 1) if w[i].lower() in WRITTEN_FOR), 0) if len(w) >= 4 and w.lower() in terms else 0
        return w[:at] + WRITTEN_FOR[w[at].lower()] + w[at + 1 :] if at else w

    return WORD.sub(mask, text)


def _training_features(model: ToxicityModel):
    """Features of the sample, and of its toxic texts with their terms misspelled or masked, which labels seldom show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, sure = Matcher(model), set(model.sure)
        for batch in small_slices(batches, "text"):
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                rows.append((label, False, features(text, matcher)))
                if label == 1:
                    rows += [(label, True, features(bent, matcher)) for bent in (misspelled(text, sure), masked(text, sure)) if bent != text]
            labels, bent, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(bent), pa.array(x, pa.list_(pa.float64()))], names=["label", "bent", "x"])

    return run


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        mean, scale, weights = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for batch in small_slices(batches, "text"):
            x = np.array([features(t.as_py() or "", matcher) for t in batch.column("text")], dtype=float).reshape(-1, FEATURES)
            z = np.einsum("ij,j->i", (x - mean) / scale, weights) + model.intercept
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(z))], names=["id", "score"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = 6000, edits: int = 1) -> ToxicityModel:
    """Fits lexicon and weights from labelled rows of ``docs``, at most about ``sample_rows`` of each label.

    Terms of four letters or more are found with up to ``edits`` edits; those that are short or
    not sure are evidence of a kind of its own. With one label only, the seed terms and fixed weights are used.
    """
    drawn, share, _ = draw_labelled(docs, labels, label, sample_rows, id_col, text_col)
    sample = materialize(drawn.select("id", "text", "label"), "toxicity-sample")
    terms, stems, sure = learn_lexicon(sample)
    bare = ToxicityModel(terms, stems, sure, edits)
    seen = sample.select("text", "label").mapInArrow(_training_features(bare), "label int, bent boolean, x array<double>").collect()
    labels = {r.label for r in seen}
    if labels != {0, 1}:
        return bare
    x, y = np.array([r.x for r in seen]), np.array([r.label for r in seen], dtype=float)
    weight = np.array([(0.15 if r.bent else 1.0) / share[r.label] for r in seen])
    mean, scale, coefficients, intercept = fit_logistic(x, y, weight)
    return ToxicityModel(terms, stems, sure, edits, mean.tolist(), scale.tolist(), coefficients.tolist(), intercept)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Scores every whole text.

    Returns one row per input row: ``id_col``, score (0 to 1, higher: more likely toxic),
    predicted (1 from ``threshold`` on). NULL texts count as empty and score like texts
    without a hit; texts of any length are scored whole. NULL and repeated ids come back as they are; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(_scored(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
