"""Toxicity from a learned lexicon, misspellings included, with scores of the context.

The lexicon is learned from labelled documents. Its terms form a trie; a Levenshtein automaton for
one edit runs along the trie, and the product of both is made deterministic state by state as
words are met, so a word costs one table look-up per letter and most words leave the automaton
after a few. An accepted word is a hit, exact or misspelled; one with a digit or sign in place of a
letter counts as exact. A hit's context decides how much it
counts: quotation marks around it and words that report or explain speech nearby lower it, words
that address someone raise it. A logistic model of the summed hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 10_000
#: Words and stems that may become terms, at most, and hashes that tell copies of a text.
CANDIDATES = 4000
SKETCHES = 3
#: Letters of a word, at least, of a stem, at least and at most, and of a stem that may be misspelled.
WORD_LETTERS = 4
STEM_LETTERS = (3, 8)
STEM_EDITS = 6
#: Words on either side of a hit that are its context.
CONTEXT = 6

# Words that report speech, words that address someone, and quotation marks.
REPORTING = frozenset("said says say called calls calling word words term terms quote quoted quotes wrote writes means meaning phrase slur insult".split())
ADDRESS = frozenset("you your youre you're yourself u ur".split())
OPENING = "\"'“”„«»‘’`"

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¡¿–—"


@dataclass(frozen=True)
class Model:
    """Terms, what is known of misspellings, and the weights of the features."""

    terms: tuple[str, ...]
    #: Share of toxic documents among those with this term or misspelling, smoothed.
    odds: dict[str, float]
    #: The same for misspellings that were not seen.
    unseen: float
    weights: tuple[float, ...]


class Automaton:
    """Words within one edit of a term: a state is a set of (trie node, edits so far), made when first met.

    A term with a star is a stem: it accepts words that begin with it or, if it has ``STEM_EDITS``
    letters or more, with something one edit away. Other terms accept whole words.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, str] = {}
        self.stems: dict[int, str] = {}
        for term in terms:
            node = 0
            for letter in term.removesuffix("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = self.children[node][letter]
            (self.stems if term.endswith("*") else self.words)[node] = term
        self.letters = frozenset("".join(terms)) - {"*"}
        self.moves: list[dict[str, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        #: For each state: an exact stem, a misspelled stem, an exact word and a misspelled word, or None.
        self.accepts: list[tuple] = []
        self.dead = self._number(frozenset())
        self.begin = self._number(self._closed({(0, 0)}))

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """Add what a missing letter allows, and drop what the same node has with fewer edits."""
        state = set(state)
        for node, edits in list(state):
            if edits == 0:
                state.update((child, 1) for child in self.children[node].values())
        return frozenset(s for s in state if not (s[1] == 1 and (s[0], 0) in state))

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})

            def best(table: dict[int, str], edits: int) -> str | None:
                return min((table[n] for n, e in state if e == edits and n in table), default=None)

            near = best({n: t for n, t in self.stems.items() if len(t) > STEM_EDITS}, 1)
            self.accepts.append((best(self.stems, 0), near, best(self.words, 0), best(self.words, 1)))
        return self.numbers[state]

    def _move(self, number: int, letter: str) -> int:
        after = set()
        for node, edits in self.states[number]:
            child = self.children[node].get(letter)
            if child is not None:
                after.add((child, edits))
            if edits == 0:
                after.add((node, 1))
                after.update((other, 1) for other in self.children[node].values())
        return self._number(self._closed(after))

    def match(self, word: str) -> tuple[str, str, bool] | None:
        """(term, what was matched, whether it is spelled right), or None. Exact stems come first."""
        state, moves, known = self.begin, self.moves, self.letters
        found = None
        for k, letter in enumerate(word):
            if letter not in known:
                letter = "?"
            step = moves[state]
            if letter not in step:
                step[letter] = self._move(state, letter)
            state = step[letter]
            if state == self.dead:
                return found
            stem, near, _, _ = self.accepts[state]
            if stem:
                return stem, stem, True
            if near and found is None:
                found = near, word[: k + 1] + "*", False
        _, _, whole, wrong = self.accepts[state]
        if whole:
            return whole, whole, True
        return found or ((wrong, word, False) if wrong else None)


def plain(token: str) -> str:
    return token.lower().strip(EDGES)


class Reader:
    """Hits of texts, with their contexts."""

    def __init__(self, terms: tuple[str, ...]):
        self.automaton = Automaton(terms)
        self.memo: dict[str, tuple | None] = {}

    def look(self, token: str):
        word = plain(token)
        found = self.automaton.match(word) if word else None
        if found and not found[2] and not word.isalpha() and not found[0].endswith("*"):
            # A digit or sign inside a word is a disguise: it counts as the term.
            return found[0], found[0], True
        return found

    def hits(self, text: str) -> Iterator[tuple[str, bool, float]]:
        """(what was matched, spelled right, weight of its context) for each hit."""
        tokens = TOKEN.findall(text)
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        for token in set(tokens):
            if token not in memo and len(token) <= 64:
                memo[token] = self.look(token)
        found = [k for k, token in enumerate(tokens) if memo.get(token)]
        for k in found:
            _, form, exact = memo[tokens[k]]
            yield form, exact, context_weight(tokens, k)


def context_weight(tokens: list[str], k: int) -> float:
    """0 to 1: how far the words around place k are abuse rather than quotation."""
    score = 2.0
    token = tokens[k]
    if token[0] in OPENING and token.rstrip(".,;:!?")[-1] in OPENING:
        score -= 3.0
    near = tokens[max(0, k - CONTEXT) : k], tokens[k + 1 : k + 1 + CONTEXT]
    if token[0] not in OPENING:
        opened = any(t[0] in OPENING for t in near[0]) and not any(t[-1] in OPENING for t in near[0])
        closed = token[-1] in OPENING or any(t.rstrip(".,;:!?")[-1:] in OPENING and t.rstrip(".,;:!?") for t in near[1])
        if opened and closed:
            score -= 2.0
    words = [plain(t) for side in near for t in side]
    if any(w in REPORTING for w in words):
        score -= 2.0
    if any(w in ADDRESS for w in words):
        score += 1.0
    return 1.0 / (1.0 + math.exp(-score))


def held_out(id_column, rest: int = 0, modulus: int = 5):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % modulus == rest


def specific(forms: dict[str, tuple[int, int]]) -> list[str]:
    """Of a stem and its extensions, the longer if it is nearly as frequent in toxic documents, else the stem."""
    ordered = sorted(forms, key=lambda f: (f.removesuffix("*"), f.endswith("*")))
    out = set(forms)
    for form in ordered:
        if not form.endswith("*"):
            continue
        stem = form[:-1]
        longer = [f for f in ordered if f != form and f.startswith(stem) and f in out]
        most = max((forms[f][0] for f in longer), default=0)
        if most >= 0.9 * forms[form][0]:
            out.discard(form)
        elif most * 1.5 <= forms[form][0]:
            out.difference_update(longer)
    return sorted(out)


def measured(hits: list[tuple[float, bool]]) -> list[float]:
    """Features of (odds times context weight, spelled right): the largest and the sum, for each spelling."""
    right, wrong = [h for h, r in hits if r], [h for h, r in hits if not r]
    return [max(right, default=0.0), math.log1p(sum(right)), max(wrong, default=0.0), math.log1p(sum(wrong))]


def explaining(bags: list[list[str]], least: float, rounds: int = 2) -> tuple[str, ...]:
    """The candidates that toxic documents are due to, by expectation maximisation.

    Each document is due to one of its candidates, in proportion to how many documents are due to
    them so far. Words that long documents merely contain beside real terms end with next to nothing.
    Few rounds are enough for that; many would starve real terms that come together.
    """
    due = Counter(w for bag in bags for w in bag)
    for _ in range(rounds):
        after: Counter = Counter()
        for bag in bags:
            total = sum(due[w] for w in bag)
            for w in bag:
                after[w] += due[w] / total
        due = after
    return tuple(sorted(w for w, share in due.items() if share >= least))


def fit(features: np.ndarray, label: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with a small ridge by Newton's method; the first weight is the constant."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - label) + ridge * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    label_id: str = "doc_id",
    labelled: int = LABELLED,
    least_share: float = 0.02,
) -> Model:
    """Learn from labelled documents that are not held out, at most ``labelled`` ids, chosen by hash.

    A term is a word or the beginning of words, most of whose documents are toxic, and that is in at least ``least_share`` of the
    toxic ones, copies of a text counted once, and that documents are due to, see ``explaining``. Texts are read whole; of a labelled document only its
    candidate words and hits reach the driver. An id with several labels counts as toxic if any is. Without both classes the
    model has no terms and its score is the share of toxic labels.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id)))
    one = known.groupBy(F.col(label_id).alias("known_id")).agg(F.max(label).alias("known_label"))
    sample = one.orderBy(F.xxhash64("known_id", F.lit(3)), "known_id").limit(labelled)
    narrow = docs.select(F.col(id).alias("seen_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = narrow.join(F.broadcast(sample), F.col("seen_id") == F.col("known_id")).select("text", "known_label")
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    low, high = STEM_LETTERS
    stems = F.flatten(
        F.transform(
            "bag",
            lambda w: F.when(
                F.length(w) > low,
                F.transform(
                    F.sequence(F.lit(low), F.least(F.lit(high), F.length(w) - 1)), lambda k: F.concat(F.substring(w, 1, k), F.lit("*"))
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    whole = F.filter("bag", lambda w: F.length(w) >= WORD_LETTERS)
    bags = seen.select(found.alias("bag"), "known_label").select(
        "known_label",
        F.array_distinct(F.concat(whole, stems)).alias("forms"),
        # Copies of one text mostly share the least hash of their words, so they count once.
        *[F.array_min(F.transform("bag", lambda w, k=k: F.xxhash64(w, F.lit(k)))).alias(f"s{k}") for k in range(SKETCHES)],
    )
    words = bags.select(F.explode("forms").alias("w"), "known_label", *[f"s{k}" for k in range(SKETCHES)])
    totals = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("known_label").cast("int")).alias("toxic")).first()
    n, toxic = totals.n, totals.toxic or 0
    if not n or not toxic or toxic == n:
        share = min(0.999, max(0.001, toxic / n)) if n else 0.001
        return Model((), {}, 0.0, (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0))
    least = max(3, math.ceil(least_share * toxic))
    bad = F.col("known_label") == 1
    tally = words.groupBy("w").agg(
        F.sum(bad.cast("int")).alias("bad"),
        F.count(F.lit(1)).alias("all"),
        *[F.size(F.collect_set(F.when(bad, F.col(f"s{k}")))).alias(f"texts{k}") for k in range(SKETCHES)],
    )
    texts = F.least(*[F.col(f"texts{k}") for k in range(SKETCHES)])
    pool = specific(
        {
            r.w: (r.bad, r.all)
            for r in tally.filter((texts >= least) & (F.col("bad") / F.col("all") >= 0.5 * (1 + toxic / n)))
            .orderBy(F.col("all") - 2 * F.col("bad"), "w")
            .limit(CANDIDATES)
            .collect()
        }
    )
    own = F.array_intersect("forms", F.array(*[F.lit(w) for w in pool]).cast("array<string>"))
    terms = explaining([r.own for r in bags.filter(bad).select(own.alias("own")).collect()], least)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in batches:
            rows = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = Counter((w, right, round(c, 3)) for w, right, c in reader.hits(t))
                rows.append((int(y), [f"{w}\t{int(right)}\t{c}\t{k}" for (w, right, c), k in hits.items()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                names=["label", "hits"],
            )

    found = []
    for row in seen.mapInArrow(look, "label int, hits array<string>").collect():
        hits = [(w, right == "1", float(c), int(k)) for w, right, c, k in (h.split("\t") for h in row.hits)]
        found.append((row.label, hits))
    bad, all_, wrong = Counter(), Counter(), set()
    for y, hits in found:
        wrong.update(w for w, right, _, _ in hits if not right)
        for w in {w for w, _, _, _ in hits}:
            all_[w] += 1
            bad[w] += y
    rare = [w for w in wrong if all_[w] <= 2]
    unseen = (sum(bad[w] for w in rare) + 2.0) / (sum(all_[w] for w in rare) + 4.0)
    odds = {w: (bad[w] + unseen) / (all_[w] + 1.0) for w in all_}
    table, y = [], []
    for label_, hits in found:
        table.append(measured([(odds.get(w, unseen) * c, right) for w, right, c, k in hits for _ in range(k)]))
        y.append(label_)
    w = fit(np.array(table), np.array(y, dtype=float))
    return Model(terms, odds, unseen, tuple(w.tolist()))


def scored(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, score (0 to 1), predicted (score >= 0.5), n_exact, n_misspelled.

    Only the text decides; whole texts are read. A null or empty text has the score of a text without
    hits. A null id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(model.terms), np.array(model.weights)
        for batch in batches:
            rows, n_exact, n_wrong = [], [], []
            for body in batch.column(1):
                hits = [(model.odds.get(f, model.unseen) * c, right) for f, right, c in reader.hits(body.as_py() or "")]
                rows.append(measured(hits))
                n_exact.append(sum(right for _, right in hits))
                n_wrong.append(len(hits) - n_exact[-1])
            x = np.array(rows).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(p),
                    pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(n_exact, pa.int64()),
                    pa.array(n_wrong, pa.int64()),
                ],
                names=[id, "score", "predicted", "n_exact", "n_misspelled"],
            )

    narrow = docs.select(F.col(id), F.col(text).cast("string"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id}` {kind}, score double, predicted int, n_exact bigint, n_misspelled bigint")
