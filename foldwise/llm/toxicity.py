"""Toxicity by a weighted finite-state pattern grammar.

Words are classes of an alphabet: insult, threat verb, target, negation,
reported speech, and other. Four small weighted transducers read a clause:

* insult: an insult gives its weight, learned from labelled texts;
* target: an insult or threat weighs more once the clause has named a person;
* negation: for some words after a negator, weights are damped;
* report: after a verb of saying or inside quotes, weights are damped.

Their composition is one transducer whose state is the tuple of the parts'
states; arcs multiply, a clause sums its arcs, and a text is described by its
clauses. A logistic model of three clause features, fitted on the labelled
rows, turns them into a score.

Learning covers all labelled rows outside the held-out part. A word is weighed by
the lower bound of its log ratio of toxic to clean texts, ``DOUBT`` standard
deviations below the smoothed ratio; a word that no text holds has the ratio 0. So evidence fades in
with the texts that show it, and no word is left out for its rank. The words
of the grammar keep their own class. The logistic model is fitted on training
texts whose own count is taken out of the weights, so that words seen in one
text alone do not pass for evidence about it.

Words travel as 64-bit hashes. Learning and scoring read the same words, and
the lexicon is broadcast only if its measured size allows; a larger one is
joined to the words of each text.

Defined results: a null or empty text has no clauses, its score is the
model's constant; rows are scored one by one, so repeated rows agree; a label that is null is
no label; without labels of both kinds every score is 0; a document with
several labels counts with each.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldwise.llm.words import LETTER_WORDS, LOWER, map_text, quoted, text_buffer, word_hashes, word_spans
from foldwise.session import fits_broadcast, settle

# standard deviations between a word's log ratio and its weight
DOUBT = 2.0
ROUNDS = 25

# fixed values: word classes of the grammar
TARGETS = frozenset("you your yours yourself u ur he she they them him her his hers their these those".split())
NEGATORS = frozenset("not no never nobody without isn aren wasn weren don doesn didn won cannot cant hardly".split())
REPORTS = frozenset("said says say wrote writes quoted claims claimed reported told called asked according heard".split())
THREATS = frozenset("kill hurt destroy beat shoot stab strangle burn murder hang punch smash attack".split())

THREAT_WEIGHT = 3.0
TARGET_FACTOR = 1.3
NEGATION_FACTOR = 0.4
REPORT_FACTOR = 0.5
NEGATION_REACH = 3

CLAUSE_END = np.isin(np.arange(256), list(b".!?;:\n"))
QUOTE = ord('"')

FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("strongest", "total", "density")])


class Transducer:
    """States, and for each state and word class the next state and the arc's factor."""

    def __init__(self, start: int, arcs: dict[tuple[int, str], tuple[int, float]]):
        self.start, self.arcs = start, arcs

    def step(self, state: int, kind: str) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 1.0))


def compose(*parts: Transducer) -> "Composed":
    return Composed(parts)


class Composed:
    """The product of transducers that read the same words; its arcs are made when first used."""

    def __init__(self, parts: tuple[Transducer, ...]):
        self.parts = parts
        self.start = tuple(p.start for p in parts)
        self.arcs: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]] = {}

    def step(self, state: tuple[int, ...], kind: str) -> tuple[tuple[int, ...], float]:
        key = (state, kind)
        if key not in self.arcs:
            moves = [p.step(s, kind) for p, s in zip(self.parts, state)]
            factor = 1.0
            for _, w in moves:
                factor *= w
            self.arcs[key] = (tuple(s for s, _ in moves), factor)
        return self.arcs[key]

    def score(self, words: list[tuple[str, float]]) -> float:
        """Sum over the words (class, weight) of weight times the arc's factor."""
        state, total = self.start, 0.0
        for kind, weight in words:
            state, factor = self.step(state, kind)
            total += weight * factor
        return total


KINDS = ["insult", "threat", "target", "negation", "report", "quote", "other"]


@lru_cache(maxsize=1)
def grammar() -> Composed:
    hot = ("insult", "threat")
    target = {(0, "target"): (1, 1.0)} | {(1, k): (1, TARGET_FACTOR) for k in hot}
    negation: dict[tuple[int, str], tuple[int, float]] = {}
    for left in range(NEGATION_REACH + 1):  # words the negation still reaches
        for kind in KINDS:
            if kind == "negation":
                negation[left, kind] = (NEGATION_REACH, 1.0)
            elif left:
                negation[left, kind] = (left - 1, NEGATION_FACTOR if kind in hot else 1.0)
    report = {(0, "report"): (1, 1.0), (0, "quote"): (2, 1.0), (1, "quote"): (3, 1.0), (2, "quote"): (0, 1.0), (3, "quote"): (1, 1.0)}
    report |= {(s, k): (s, REPORT_FACTOR) for s in (1, 2, 3) for k in hot}
    return compose(Transducer(0, target), Transducer(0, negation), Transducer(0, report))


class Lexicon:
    """Sorted hashes of words with three weights each: of all texts, without one clean, without one toxic text."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        order = np.argsort(words)
        self.words, self.weights = words[order], weights[:, order]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for characters that belong to words: letters, marks on them, and joiners inside them."""
    table = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
    table[[0x200C, 0x200D]] = True
    return table


def spelled(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case (A-Z), with blanks in place of characters outside ASCII that belong to no word."""
    out = LOWER[data]
    at = np.flatnonzero(out >= 0xC0)
    if not len(at):
        return out
    padded = np.append(out, np.zeros(3, np.uint8))
    a, b, c, d = (padded[at + k].astype(np.int32) & (0x3F if k else 0xFF) for k in range(4))
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    three = (a & 0x0F) << 12 | b << 6 | c
    code = np.where(size == 2, (a & 0x1F) << 6 | b, np.where(size == 3, three, (a & 0x07) << 18 | b << 12 | c << 6 | d))
    foreign = ~_letters()[np.minimum(code, 0x10FFFF)]
    for k in range(4):
        place = at[foreign & (size > k)] + k
        out[place[place < len(out)]] = 0x20
    return out


def read_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, starts and hashes of their words, and the first word of each text (n+1)."""
    raw, offsets = text_buffer(texts)
    data = spelled(raw)
    starts, ends, first = word_spans(data, offsets, LETTER_WORDS)
    return raw, offsets, starts, word_hashes(data, starts, ends), first


def _hashes(words: list[str]) -> np.ndarray:
    """Hash of each of the words, which are words as a whole."""
    return read_words(pa.array(words, pa.string()))[3]


@lru_cache(maxsize=1)
def fixed_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words of the grammar, and the number of their class."""
    kinds = {w: KINDS.index(k) for k, ws in (("report", REPORTS), ("negation", NEGATORS), ("target", TARGETS), ("threat", THREATS)) for w in ws}
    hashes = _hashes(list(kinds))
    order = np.argsort(hashes)
    return hashes[order], np.array(list(kinds.values()))[order]


def _slots(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the sorted known ones, and whether it is one of them."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return slot, known[slot] == hashes


def scored_clauses(texts, lexicon: Lexicon, which: np.ndarray) -> tuple[np.ndarray, list[int], list[float]]:
    """Words of each text, and text and score of every clause that holds an insult or a threat aimed at someone.

    ``which`` names the weights that hold for each text.
    """
    raw, offsets, starts, hashes, first = read_words(texts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fixed, classes = fixed_words()
    slot, own = _slots(fixed, hashes)
    kind = np.where(own, classes[slot], KINDS.index("other"))
    weight = np.where(kind == KINDS.index("threat"), THREAT_WEIGHT, 0.0)
    slot, learned = _slots(lexicon.words, hashes)
    at = np.flatnonzero(learned & ~own)
    value = lexicon.weights[which[row[at]], slot[at]]
    at, value = at[value > 0], value[value > 0]
    kind[at], weight[at] = KINDS.index("insult"), value
    # clauses are numbered through all texts
    before = np.cumsum(CLAUSE_END[raw])
    clause = before[starts] + row
    n_clauses = (int(before[-1]) if len(before) else 0) + len(first)
    insult, threat, target = (
        np.bincount(clause[kind == KINDS.index(k)], minlength=n_clauses) > 0 for k in ("insult", "threat", "target")
    )
    weight[(kind == KINDS.index("threat")) & ~target[clause]] = 0.0
    active = insult | threat & target
    quotes = np.flatnonzero(raw == QUOTE)
    quote_clause = before[quotes] + np.searchsorted(offsets, quotes, "right") - 1
    words, quoted_ = np.flatnonzero(active[clause]), active[quote_clause]
    order = np.argsort(np.concatenate([starts[words], quotes[quoted_]]), kind="stable")
    n_quotes = int(quoted_.sum())
    kinds = np.concatenate([kind[words], np.full(n_quotes, KINDS.index("quote"))])[order]
    weights = np.concatenate([weight[words], np.zeros(n_quotes)])[order]
    group = np.concatenate([clause[words], quote_clause[quoted_]])[order]
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
    named = [KINDS[k] for k in kinds.tolist()]
    read = list(zip(named, weights.tolist()))
    scores = [grammar().score(read[a:b]) for a, b in zip(bounds, bounds[1:])]
    owner = np.zeros(n_clauses, np.int64)
    owner[clause] = row
    return np.diff(first), owner[group[bounds[:-1]]].tolist(), scores


def clause_scores(text: str, weights: dict[str, float]) -> list[float]:
    """Score of every clause that holds an insult or a threat aimed at someone."""
    lexicon = Lexicon(_hashes(list(weights)), np.tile(np.array(list(weights.values()), float), (3, 1)))
    return scored_clauses(pa.array([text], pa.string()), lexicon, np.zeros(1, np.int64))[2]


def _described(texts, lexicon: Lexicon, which: np.ndarray) -> list[pa.Array]:
    n_words, rows, scores = scored_clauses(texts, lexicon, which)
    strongest, total = np.zeros(len(n_words)), np.zeros(len(n_words))
    np.maximum.at(strongest, rows, scores)
    np.add.at(total, rows, scores)
    density = 100 * total / np.maximum(n_words, 1)
    return [pa.array(strongest), pa.array(np.log1p(total)), pa.array(np.log1p(density))]


def bound(t, c, n_toxic, n_clean, log, sqrt):
    """The weight of a word that ``t`` of the toxic and ``c`` of the clean texts hold; not positive without evidence."""
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    t, c = t + share, c + (1 - share)
    return log(t / c) - math.log(share / (1 - share)) - DOUBT * sqrt(1 / t + 1 / c)


def _lexicon(words, toxic, clean, n_toxic: float, n_clean: float) -> Lexicon:
    words = np.asarray(words, np.int64).view(np.uint64)
    t, c = np.asarray(toxic, float), np.asarray(clean, float)
    one = lambda y_t, y_c: bound(np.maximum(t - y_t, 0), np.maximum(c - y_c, 0), n_toxic - y_t, n_clean - y_c, np.log, np.sqrt)
    return Lexicon(words, np.stack([one(0, 0), one(0, 1), one(1, 0)]))


def distinct_words(texts: DataFrame) -> DataFrame:
    """Rows (h, word): the words of each text (h, text)."""
    one = T.StructType([T.StructField("words", T.ArrayType(T.LongType()))])

    def fn(block, column):
        _, _, _, hashes, first = read_words(column)
        own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        bounds = np.append(0, np.cumsum([len(w) for w in own]))
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))]

    return map_text(texts, "text", "w", one, lambda: fn, keep=["h"]).select("h", F.explode("w.words").alias("word"))


def features(df: DataFrame, lexicon: DataFrame, n_toxic: float, n_clean: float, keep: list[str], own: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (text, ...) and of each text its strongest clause, sum of clauses (log) and their sum per 100 words (log).

    ``lexicon`` has the rows (word, toxic, clean). With ``own``, the column of a
    text's label, its words are weighed without that text itself.
    """
    out, carried = "__features__", list(keep)
    source, sent = df, None
    if fits_broadcast(lexicon):
        rows = lexicon.toArrow()
        arrays = [rows.column(k).to_numpy() for k in ("word", "toxic", "clean")]
        sent = df.sparkSession.sparkContext.broadcast(_lexicon(*arrays, n_toxic, n_clean))
    else:
        keyed = df.withColumn("h", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        found = settle(distinct_words(keyed.select("h", "text").dropDuplicates(["h"])))
        lists = settle(
            found.join(lexicon, "word").groupBy("h").agg(
                F.collect_list(F.struct("word", "toxic", "clean")).alias("__own__")
            )
        )
        source = keyed.join(lists, "h", "left").drop("h")
        carried.append("__own__")

    def make():
        def fn(block, texts):
            which = np.zeros(len(texts), np.int64)
            if own:
                which = 1 + block.column(block.schema.get_field_index(own)).to_numpy(zero_copy_only=False).astype(np.int64)
            if sent is not None:
                return _described(texts, sent.value, which)
            several = block.column(block.schema.get_field_index("__own__")).flatten()
            words, at = np.unique(several.field("word").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            counts = [several.field(k).to_numpy(zero_copy_only=False)[at] for k in ("toxic", "clean")]
            return _described(texts, _lexicon(words, *counts, n_toxic, n_clean), which)

        return fn

    return map_text(source, "text", out, FEATURES, make, keep=carried).select(*keep, f"{out}.*")


def word_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """For each word (hash) the labelled texts of either kind that hold it; counts of one block are added up first."""
    schema = "word long, toxic long, clean long"
    source = labelled.select(F.col(quoted(label)).cast("int").alias("y"), F.col(quoted(text)).cast("string").alias("t"))

    def run(batches):
        from foldwise.llm.words import cut

        for batch in batches:
            for part in cut(batch, "t"):
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                _, _, _, hashes, first = read_words(part.column(1))
                row = np.repeat(np.arange(len(y)), np.diff(first))
                free = ~_slots(fixed_words()[0], hashes)[1]
                hashes, row = hashes[free], row[free]
                order = np.lexsort((row, hashes))
                h, r = hashes[order], row[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                group = np.cumsum(new)[once] - 1
                toxic = np.bincount(group, y[r[once]], new.sum()).astype(np.int64)
                both = np.bincount(group, minlength=new.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), pa.array(toxic), pa.array(both - toxic)], names=["word", "toxic", "clean"]
                )

    return source.mapInArrow(run, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame, n_toxic: float, n_clean: float, text: str = "text", label: str = "toxic") -> DataFrame:
    """Rows (word, toxic, clean): every word that has a weight, with all texts or without any one of them."""
    t, c = F.col("toxic"), F.col("clean")
    one = lambda y_t, y_c: bound(t - y_t, c - y_c, n_toxic - y_t, n_clean - y_c, F.log, F.sqrt) > 0
    some = one(0, 0) | (c >= 1) & one(0, 1) | one(1, 0)
    return settle(word_counts(labelled, text, label).filter((t >= 1) & some))


def fit_logistic(table: DataFrame, names: list[str], label: str) -> list[float]:
    """Constant and coefficients by Newton's method; each round is one aggregation of the whole table."""
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    k = len(x)
    beta = np.zeros(k)
    for _ in range(ROUNDS):
        z = sum((F.lit(float(b)) * v for b, v in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        grad = [F.sum((F.col(label) - p) * v) for v in x]
        curve = [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        row = table.agg(*[e.alias(f"v{i}") for i, e in enumerate(grad + curve)]).first()
        if row[0] is None:
            return beta.tolist()
        h = np.zeros((k, k))
        for (i, j), v in zip(((i, j) for i in range(k) for j in range(i, k)), row[k:]):
            h[i, j] = h[j, i] = v
        # a small ridge keeps separable labels finite
        g = np.array(row[:k]) - 1e-2 * beta
        move = np.linalg.solve(h + 1e-2 * np.eye(k), g)
        beta = beta + move / max(1.0, np.abs(move).max() / 4)
        if np.abs(move).max() < 1e-8:
            break
    return beta.tolist()


def held_out(doc: str):
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(quoted(doc)).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_documents(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    slim = documents.select(F.col(quoted(doc)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    known = labels.select(F.col(quoted(doc)).alias("doc_id"), F.col(quoted(label)).cast("double").alias("y")).filter(
        F.col("y").isNotNull() & ~held_out("doc_id")
    )
    # merged at every size: a broadcast of labels below some size would make the shuffle jump when they outgrow it
    train = settle(slim.filter(~held_out("doc_id")).join(known.hint("merge"), "doc_id").select("text", "y"))
    n_toxic, n_clean = (float(x or 0) for x in train.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    names = FEATURES.names
    if not n_toxic or not n_clean:
        rated, score = slim, F.lit(0.0)
    else:
        lexicon = learn_lexicon(train, n_toxic, n_clean, "text", "y")
        beta = fit_logistic(settle(features(train, lexicon, n_toxic, n_clean, ["y"], own="y")), names, "y")
        rated = features(slim, lexicon, n_toxic, n_clean, ["doc_id"])
        z = sum((F.lit(b) * F.col(n) for b, n in zip(beta[1:], names)), F.lit(beta[0]))
        score = 1 / (1 + F.exp(-z))
    scored = rated.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
