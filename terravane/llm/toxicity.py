"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults from a lexicon whose weights are learned from labels (whole
words and stems), threats, targets, negations, reporting verbs, intensifiers and words that
announce a mention from short lists. Transducers for insults, threats, targets, negation and
reported speech rewrite the symbols in this order; composed, they are one machine that
reads a clause once. Negation and reported speech change only what is a match already, and
every state ends with its clause. A match is of a kind (insult, aimed insult, threat, negated,
reported); a clause holds, for each kind, the sum of its matches' weights times their words'
weights. How much a kind counts, an insult without a target among them, is fitted to labels:
a logistic curve over the clauses' sums is the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm.labelled import labelled_sample
from terravane.llm.neardup import Forest, minhashes, shingle_sets
from terravane.llm.shared import added_name, bounded, materialise, text_chunks

#: Short closed lists of the grammar, in the corpus' languages.
TARGETS = frozenset("you your yours yourself u he she they him her them du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ils elles usted ustedes tú ti vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun ningún nunca jamás".split())
REPORTING = frozenset("said says wrote claimed reported quoted according sagte sagt schrieb laut behauptete dit disait écrit selon dijo dice escribió según".split())
INTENSIFIERS = frozenset("such so very really total totally complete utter absolute absolutely ganz sehr total völlig so très tellement vraiment muy tan totalmente".split())
MENTIONS = frozenset("word words term terms spelling wort wörter begriff mot mots terme palabra palabras término".split())
THREAT_VERBS = "kill hurt destroy beat burn shoot stab attack punch strangle".split()
THREAT_FORMS = frozenset("töte tötet töten umbringe umbringt umbringen schlage schlägt schlagen tue tuerai tuer frappe frapperai frapper mato mataré matar golpeo golpearé golpear".split())

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”„«»]")
ENDS, QUOTES = frozenset(".!?;:\n"), frozenset("\"“”„«»")
STEMS = (4, 5, 6, 7)

#: Symbols: other word, insult, threat, target, negation, reporting verb, intensifier, mention, quotation mark, end of clause; then those that only transducers write.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSE, MENTION, QUOTE, END = range(10)
INSULTED, AIMED, THREATENED, NEGATED, REPORTED = MATCHES = range(10, 15)
SYMBOLS = range(15)
#: What a kind of match counts against an insult before labels say otherwise, in the order of MATCHES.
PRIOR = (1.0, 1.5, 1.5, 0.5, 0.6)
#: The word weight of a threat: its verb isn't in the learned lexicon.
THREAT_WEIGHT = 3.0


def inflected(verb: str) -> set[str]:
    """English forms of a verb: with s, ed and ing, with and without a doubled last letter or a dropped e."""
    stem = verb.removesuffix("e")
    return {verb, verb + "s", verb + "es", *(x + e for x in (stem, verb + verb[-1]) for e in ("ed", "ing"))}


THREATS = THREAT_FORMS.union(*map(inflected, THREAT_VERBS))


@dataclass
class Transducer:
    """Deterministic: arcs (state, symbol) -> (next state, output, weight). Without an arc a symbol stays, the state too."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what `first` reads and writes what `second` makes of its output; weights multiply."""
    start = (first.start, second.start)
    out, todo, seen = Transducer(start=start), [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            one, middle, w1 = first.step(state[0], symbol)
            two, end, w2 = second.step(state[1], middle)
            out.arcs[state, symbol] = ((one, two), end, w1 * w2)
            if (one, two) not in seen:
                seen.add((one, two))
                todo.append((one, two))
    return out


def insult(intense: float = 1.5, more: float = 1.25) -> Transducer:
    """An insult is a match, unless the word before it announces a mention; it weighs `intense` within two words after an intensifier, `more` right after another insult."""
    plain, again, mention, near, next_ = range(5)
    arcs: dict = {}
    for state in range(5):
        for symbol in SYMBOLS:
            arcs[state, symbol] = (near if state == next_ and symbol != END else plain, symbol, 1.0)
        arcs[state, INTENSE] = (next_, OTHER, 1.0)
        arcs[state, MENTION] = (mention, OTHER, 1.0)
        arcs[state, INSULT] = (again, INSULTED, {again: more, near: intense, next_: intense}.get(state, 1.0))
    arcs[mention, INSULT] = (plain, OTHER, 1.0)
    return Transducer(arcs)


def threat(scope: int = 3) -> Transducer:
    """A threat is a match at the target that follows within `scope` words."""
    arcs: dict = {}
    for left in range(scope + 1):
        for symbol in SYMBOLS:
            arcs[left, symbol] = (max(0, left - 1), symbol, 1.0)
        arcs[left, THREAT] = (scope, OTHER, 1.0)
        arcs[left, END] = (0, END, 1.0)
        if left:
            arcs[left, TARGET] = (0, THREATENED, 1.0)
    return Transducer(arcs)


def target() -> Transducer:
    """An insult after a target in the clause is aimed at it."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0), (0, THREATENED): (1, THREATENED, 1.0), (1, INSULTED): (1, AIMED, 1.0), (1, END): (0, END, 1.0)})


def negation(scope: int = 3) -> Transducer:
    """A match within `scope` words after a negation is negated."""
    arcs: dict = {}
    for left in range(scope + 1):
        for symbol in SYMBOLS:
            arcs[left, symbol] = (max(0, left - 1), NEGATED if left and symbol in MATCHES else symbol, 1.0)
        arcs[left, NEGATION] = (scope, OTHER, 1.0)
        arcs[left, END] = (0, END, 1.0)
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """A match after a reporting verb of its clause, or after an opening quotation mark of its clause, is reported."""
    arcs: dict = {(0, REPORT): (1, OTHER, 1.0), (0, QUOTE): (2, OTHER, 1.0), (2, QUOTE): (0, OTHER, 1.0)}
    for state in (1, 2):
        arcs[state, END] = (0, END, 1.0)
        for symbol in MATCHES:
            arcs[state, symbol] = (state, REPORTED, 1.0)
    return Transducer(arcs)


def grammar() -> Transducer:
    return compose(compose(compose(compose(insult(), threat()), target()), negation()), reported_speech())


class Lexicon(dict):
    """Symbol and weight of a word, filled in as words are met: learned words and stems, then the lists."""

    MOST = 150_000
    OTHERS = (OTHER, 0.0)

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[int, float]:
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
        if weight > 0:
            found = (INSULT, weight)
        elif word in ENDS:
            found = (END, 0.0)
        elif word in QUOTES:
            found = (QUOTE, 0.0)
        else:
            lists = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS), (INTENSE, INTENSIFIERS), (MENTION, MENTIONS))
            found = next(((s, 0.0) for s, known in lists if word in known), self.OTHERS)
        if len(self) > self.MOST:
            self.clear()
        self[word] = found
        return found


class ClauseScorer:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.lexicon, machine = Lexicon(words, stems), grammar()
        states = {machine.start: 0}
        for state, _ in machine.arcs:
            states.setdefault(state, len(states))
        self.table = [[(0, OTHER, 1.0)] * len(SYMBOLS) for _ in states]
        for (state, symbol), (nxt, out, weight) in machine.arcs.items():
            self.table[states[state]][symbol] = (states[nxt], out, weight)

    def clauses(self, text: str) -> list[list[float]]:
        """For each clause with matches, the sum of weights of each kind."""
        low, get = text.lower(), self.lexicon.__getitem__
        if not any(get(w)[0] in (INSULT, THREAT) for w in set(WORDS.findall(low))):
            return []
        found, state, now, table = [], 0, None, self.table
        for symbol, weight in map(get, TOKENS.findall(low)):
            state, out, factor = table[state][symbol]
            if out >= INSULTED:
                now = now or [0.0] * len(MATCHES)
                now[out - INSULTED] += factor * (weight or THREAT_WEIGHT)
            if symbol == END and now:
                found.append(now)
                now = None
        return [*found, now] if now else found

    def features(self, text: str | None) -> tuple[float, ...]:
        """Log sums: of all kinds as PRIOR weighs them, of the strongest clause, of the number of clauses; then of each kind alone."""
        found = self.clauses(text) if text else []
        if not found:
            return (0.0,) * N_FEATURES
        totals = [sum(c[k] for c in found) for k in range(len(MATCHES))]
        strongest = max(sum(p * x for p, x in zip(PRIOR, c, strict=True)) for c in found)
        logs = [math.log1p(x) for x in totals]
        return sum(p * x for p, x in zip(PRIOR, logs, strict=True)), math.log1p(strongest), math.log1p(len(found)), *logs


N_FEATURES = 3 + len(MATCHES)
#: Ridge of the curve: weak for the common features, strong for what a kind counts beyond its prior.
RIDGE = (0.05, 0.05, 0.05, *[1.0] * len(MATCHES))


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...]  # bias, then a weight for each feature

    def scorer(self) -> ClauseScorer:
        return ClauseScorer(self.words, self.stems)

    def score(self, features: tuple[float, ...]) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of this document are kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _term_counts(sample: DataFrame, known: frozenset[str] | None) -> DataFrame:
    """Toxic and clean documents of each word; or, where words are known already, of each stem of the other words."""

    def counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[x] for x in keys], pa.int64()), pa.array([clean[x] for x in keys], pa.int64())], names=["term", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if len(toxic) + len(clean) > 100_000:
                    yield counted(toxic, clean)
                    toxic, clean = Counter(), Counter()
                words = set(WORDS.findall((text or "").lower()))
                seen = words if known is None else {w[:n] for w in words - known for n in STEMS if len(w) >= n}
                (toxic if label >= 0.5 else clean).update(seen)
        yield counted(toxic, clean)

    return bounded(sample).select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_curve(x: np.ndarray, y: np.ndarray, l2: tuple[float, ...] = RIDGE, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *l2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _without_near_copies(sample: DataFrame, hashes: int = 3) -> DataFrame:
    """(text, toxic) of the sample's documents, one for each MinHash of word five-grams, for several MinHashes in turn: copies are no independent evidence."""
    forest = Forest(trees=1, depth=hashes)
    names = [f"near{k}" for k in range(hashes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                near = minhashes(shingle_sets(part.column("text"), 5), forest)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), *(pa.array(near[:, k]) for k in range(hashes))], names=["text", "toxic", *names])

    out = bounded(sample.select("text", "toxic")).mapInArrow(run, "text string, toxic double, " + ", ".join(f"{n} long" for n in names))
    for name in names:
        rest = [c for c in out.columns if c not in (name, "toxic")]
        out = out.groupBy(name, "toxic").agg(F.min(F.struct(*rest)).alias("one")).select("one.*", "toxic", name)
    return out.select("text", "toxic")


def train_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 12_000, evidence: float = 12.0, margin: float = 4.5, most: int = 8_192) -> ToxicityModel:
    """Learns lexicon and curve from at most `bound` labelled documents outside the held-out fold, one of each set of near copies.

    A word or stem is an insult if its log odds ratio in toxic against clean documents is
    `margin` or more and chance would spread it so with exp(-`evidence`) at most; the
    `most` strongest stay. The curve is fitted to one half with a lexicon of the other, so
    words that are there by chance count as little as they deserve. Without toxic or without clean examples the model knows no
    insults and scores the share of toxic ones.
    """
    sample = _without_near_copies(labelled_sample(docs, labels, {"toxic": F.col("toxic")}, bound, ~held_out()))
    sample, _ = materialise(sample, "toxicity-sample")
    n = {r["t"]: r["n"] for r in sample.groupBy((F.col("toxic") >= 0.5).alias("t")).agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return ToxicityModel({}, {}, (30.0 if bad else -30.0, *[0.0] * N_FEATURES))
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    curve = _fit_clauses(sample.where(~half), *_lexicon(sample.where(half), bad / 2, good / 2, evidence, margin, most))
    return ToxicityModel(*_lexicon(sample, bad, good, evidence, margin, most), curve)


def _lexicon(sample: DataFrame, bad: float, good: float, evidence: float, margin: float, most: int) -> tuple[dict[str, float], dict[str, float]]:
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    seen = (F.col("toxic") + F.col("clean")).cast("double")
    share, base = F.col("toxic") / seen, bad / (bad + good)
    surprise = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)

    def strongest(known: frozenset[str] | None) -> dict[str, float]:
        terms = _term_counts(sample, known).where("toxic > 0").withColumn("w", odds).where((F.col("w") >= margin) & (surprise >= evidence))
        return {r["term"]: r["w"] for r in terms.orderBy(F.desc("w"), "term").limit(most).collect()}

    words = strongest(None)
    return words, strongest(frozenset(words))


def _fit_clauses(sample: DataFrame, words: dict[str, float], stems: dict[str, float]) -> tuple[float, ...]:
    """The curve on documents that the lexicon was not learned from."""

    names = [f"x{k}" for k in range(N_FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ClauseScorer(words, stems)
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(N_FEATURES)), batch.column("toxic")], names=[*names, "toxic"])

    schema = ", ".join(f"{n} double" for n in [*names, "toxic"])
    rows = sample.select("text", "toxic").mapInArrow(run, schema).groupBy(*names).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas().sort_values(names)
    x = np.repeat(rows[names].to_numpy(dtype=float), 2, axis=0)
    y = np.tile([1.0, 0.0], len(rows))
    count = np.column_stack([rows["t"], rows["n"] - rows["t"]]).ravel().round().astype(int)
    return fit_curve(np.repeat(x, count, axis=0), np.repeat(y, count))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 where the score reaches the threshold) to every row; `carry` names the columns to keep.

    Null and empty texts have no clauses and score as documents without matches do. A
    score depends on the row's whole text alone, however long, so copies, repeated rows and
    equal ids score alike; ties at the threshold are predicted 1. An empty table gives an
    empty result. Where a column of the table has an added column's name, the added one gets
    underscores behind it (shared.added_name). The model, its lexicon of bounded size,
    goes to the executors.
    """
    kept = docs.columns if carry is None else carry
    source = docs.select(*dict.fromkeys([*kept, text]))
    at, text_at = [source.columns.index(c) for c in kept], source.columns.index(text)
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(added_name(kept, "score"), T.DoubleType()), T.StructField(added_name(kept, "predicted"), T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for part in text_chunks(batch, batch.schema.names[text_at]):
                scores = [model.score(scorer.features(t)) for t in part.column(text_at).to_pylist()]
                new = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *new], names=schema.names)

    return bounded(source).mapInArrow(run, schema)
