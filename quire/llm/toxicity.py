"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a text as symbols: insults, threats (intent, then a verb of violence), targets,
negation and reported speech. They are composed into one deterministic machine whose arcs add weights;
an insult or threat near a target weighs more, one that is negated or reported less. Targets, negation and intent
end with their clause, reported speech with its sentence, quotations with their paragraph at the latest.

Only matched clauses are scored: a clause's score is the sum of its arcs' weights, an insult's arc times the word's
lexicon weight. The strongest clauses, their sum, how many reach each level and their share of all clauses are the
features of a logistic score; no feature counts words outside their clause.

The insult lexicon holds fixed seed words and stems learned from labelled documents: words and word prefixes found in
``MIN_SUPPORT`` toxic documents or more whose log odds stay high after a confidence margin. Lexicon and logistic weights are fitted on a bounded sample of
``MAX_LABELLED`` labelled rows, cross-fitted over ``SPLITS`` splits in two halves so that stems don't vouch for themselves. Labels
come only from rows that ``train`` selects; label, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts are scored as texts without a match; labels that are null or lack a
document are ignored, repeated ones count as toxic if any is; of rows that repeat a labelled doc_id the smallest text
is learned from; without both classes in all halves the seed grammar's default weights hold; rows that repeat a doc_id
each get a score; empty tables give empty results; extra columns are ignored. Texts are read whole; reruns agree.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import materialize, ship_code, spread

MAX_LABELLED, MIN_SUPPORT, SPLITS, TOXIC_WEIGHT, THRESHOLD, STEM_LENGTHS = 20_000, 3, 3, 1.5, 0.7, range(3, 9)
#: Seeds of the grammar's word classes, in English, German, French and Spanish.
SEEDS = frozenset(
    "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting trash clown clowns dumb fool fools jerk imbecile filth vermin garbage "
    "dummkopf trottel vollidiot abschaum versager widerlich imbécile crétin débile ordure minable idiota estúpido estúpida imbécil basura escoria".split()
)
INTENT = frozenset("will gonna going shall should must let werde werden wirst sollte vais va allons devrait voy vamos debería".split())
VIOLENCE = frozenset(
    "kill hurt destroy beat burn hunt shoot stab strangle crush murder töten umbringen verprügeln verbrennen erschießen tuer frapper brûler détruire matar golpear quemar destruir".split()
)
TARGETS = frozenset(
    "you your yours youre u he she him her they them their these those people everyone du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
)
NEGATORS = frozenset("not no never neither nor without isnt arent dont nicht kein keine nie niemals ne pas jamais aucun nunca sin ni tampoco".split())
REPORTERS = frozenset("said says say called quoted wrote claims claimed according reported sagte sagt schrieb nannte dit écrit déclaré dijo dice escribió llamó".split())
QUOTES = frozenset("\"“”„«»")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n\"“”„«»]")
CLAUSE_END = frozenset(".!?;:,\n")
ENDS = frozenset(",./")  # symbols of a clause's, a sentence's and a paragraph's end
SEED_WEIGHT = 2.0


@dataclass(frozen=True)
class Transducer:
    """``step(state, symbol) -> (state, weight)`` from state 0; symbols: I insult, V violence, W intent, Y target, N negator, R reporter, Q quote, O other, and ends of a clause (,), a sentence (.) and a paragraph (/)."""

    step: object


def _window(opens: str, hits: str, weight: float, span: int) -> Transducer:
    """Adds a weight to hits within a span of tokens after an opener; a clause end closes the span."""

    def step(state: int, symbol: str) -> tuple[int, float]:
        got = weight if state and symbol in hits else 0.0
        return (0 if symbol in ENDS else span if symbol in opens else max(0, state - 1)), got

    return Transducer(step)


def _inside(quotes: str, opens: str, hits: str, weight: float) -> Transducer:
    """Adds a weight to hits in a quotation (state 2, until it or the paragraph ends) or after a verb of saying (state 1, until the sentence ends)."""

    def step(state: int, symbol: str) -> tuple[int, float]:
        if symbol in quotes:
            return (0 if state == 2 else 2), 0.0
        if symbol == "/" or (symbol == "." and state == 1):
            return 0, 0.0
        return (1 if symbol in opens and not state else state), weight if state and symbol in hits else 0.0

    return Transducer(step)


INSULT = Transducer(lambda state, symbol: (0, 1.0 if symbol == "I" else 0.0))
THREAT = _window("W", "V", 2.0, 3)
TARGET = _window("Y", "IV", 0.5, 4)
NEGATION = _window("N", "IV", -0.75, 3)
REPORTED = _inside("Q", "R", "IV", -0.4)


class Grammar:
    """The composition of transducers: states are tuples of their states, arcs add their weights; built as needed."""

    def __init__(self, parts: tuple[Transducer, ...] = (INSULT, THREAT, TARGET, NEGATION, REPORTED)):
        self.parts = parts
        self.numbers, self.states = {(0,) * len(parts): 0}, [(0,) * len(parts)]
        self.arcs: list[dict[str, tuple[int, float]]] = [{}]

    def arc(self, state: int, symbol: str) -> tuple[int, float]:
        """The next state's number and the weight of the arc."""
        found = self.arcs[state].get(symbol)
        if found is None:
            steps = [part.step(s, symbol) for part, s in zip(self.parts, self.states[state], strict=True)]
            number = self.numbers.setdefault(tuple(s for s, _ in steps), len(self.states))
            if number == len(self.states):
                self.states.append(tuple(s for s, _ in steps))
                self.arcs.append({})
            found = self.arcs[state][symbol] = number, sum(w for _, w in steps)
        return found


class Symbols(dict):
    """Token -> symbol under a lexicon, filled as tokens come."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> str:
        plain = token.replace("'", "").replace("’", "")
        if token in CLAUSE_END:
            symbol = "/" if token == "\n" else "." if token in ".!?" else ","
        elif token not in QUOTES and self.lexicon.weight(token) > 0:
            symbol = "I"
        else:
            symbol = next((s for s, words in CLASSES if plain in words), "O")
        self[token] = symbol
        return symbol


CLASSES = (("V", VIOLENCE), ("Q", QUOTES), ("Y", TARGETS), ("N", NEGATORS), ("W", INTENT), ("R", REPORTERS))
MAX_KNOWN = 150_000  # words whose symbols a lexicon remembers


@dataclass
class Lexicon:
    stems: dict[str, float]
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.heads = {s[:3] for s in self.stems if s[0] != "="}
        self.symbols = Symbols(self)

    def weight(self, token: str) -> float:
        """The largest weight of a token, its parts around apostrophes or their stems; 0 if it is no insult."""
        got = self.known.get(token)
        if got is None:
            got = 0.0
            for word in [token, *re.split("['’]", token)] if "'" in token or "’" in token else (token,):
                got = max(got, self.stems.get("=" + word, 0.0), SEED_WEIGHT if word in SEEDS else 0.0)
                if word[:3] in self.heads:
                    got = max(got, *(self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS))
            if got > 0:
                self.known[token] = got
        return got

    def read(self, tokens: list[str]) -> str:
        """The symbols of tokens. What is remembered of words is bounded between texts."""
        if len(self.symbols) > MAX_KNOWN:
            self.symbols.clear()
            self.known.clear()
        return "".join(map(self.symbols.__getitem__, tokens))


def stems_of(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(WORD.findall(text.lower())):
        out.add("=" + word)
        out.update(word[:n] for n in STEM_LENGTHS if len(word) >= n)
    return out


LEVELS = (1, 2, 3, 4)
N_FEATURES = 6 + len(LEVELS)
_grammar = Grammar()


CLAUSE = re.compile("[^,./]+")


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def clause_scores(tokens: list[str], lexicon: Lexicon, grammar: Grammar = _grammar) -> tuple[list[float], int]:
    """Scores of the matched clauses of a text, and how many clauses it has."""
    symbols = lexicon.read(tokens)
    n = len(CLAUSE.findall(symbols))
    if "I" not in symbols and "V" not in symbols:  # no clause can match
        return [], n
    scores: list[float] = []
    state, clause, matched, arcs = 0, 0.0, False, grammar.arcs
    for at, symbol in enumerate(symbols):
        if matched and symbol in ENDS:
            scores.append(max(clause, 0.0))
            clause, matched = 0.0, False
        state, got = arcs[state].get(symbol) or grammar.arc(state, symbol)
        if symbol == "I":
            clause, matched = clause + got * lexicon.weight(tokens[at]), True
        elif symbol == "V":
            clause, matched = clause + got, True
    if matched:
        scores.append(max(clause, 0.0))
    return scores, n


def features(tokens: list[str], lexicon: Lexicon) -> list[float]:
    """The three best clause scores, their sum, how many reach each level, their sum by clause, and the number of clauses."""
    scores, n = clause_scores(tokens, lexicon)
    top = sorted(scores, reverse=True)[:3] + [0.0] * 3
    total = sum(scores)
    return [*top[:3], math.log1p(total), *(math.log1p(sum(s >= level for s in scores)) for level in LEVELS), math.log1p(100 * total / max(1, n)), math.log1p(n)]


@dataclass
class Model:
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray  # the last is the intercept

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, self.coefficients[:-1]) + self.coefficients[-1], -30, 30)))


def untrained() -> Model:
    return Model({}, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([0.5, 0, 0, 1.5, *[0.0] * (N_FEATURES - 4), -2.0]))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-4, weight: float = 1.0) -> Model:
    """Newton's method with halved steps where the loss would rise; rows with label 1 count ``weight`` times."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y > 0, weight, 1.0) / np.where(y > 0, weight, 1.0).sum()
    sign = np.where(y > 0, -1.0, 1.0)

    def loss(w: np.ndarray) -> float:  # einsum keeps threaded libraries out
        return float(np.einsum("i,i->", share, np.logaddexp(0, sign * np.einsum("ij,j->i", z, w))) + ridge / 2 * np.einsum("i,i->", w, w))

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w), -30, 30)))
        gradient = np.einsum("ij,i->j", z, share * (p - (y > 0))) + ridge * w
        curve = np.einsum("ij,ik->jk", z * (share * p * (1 - p))[:, None], z) + ridge * np.eye(len(w))
        move, size = np.linalg.solve(curve, gradient), 1.0
        while (after := loss(w - size * move)) > now and size > 1e-6:
            size /= 2
        w, before, now = w - size * move, now, min(now, after)
        if before - now < 1e-12:
            break
    return Model({}, mean, scale, w)


def _weights(with_label: Counter, without: Counter, positives: int, negatives: int) -> dict[str, float]:
    """Log odds less a margin of 1.64 standard errors, where that is at least 1."""
    out = {}
    for stem, p in with_label.items():
        q = without.get(stem, 0)
        odds = math.log((p + 0.5) / (positives - p + 0.5)) - math.log((q + 0.5) / (negatives - q + 0.5))
        lower = odds - 1.64 * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        if p >= MIN_SUPPORT and lower >= 1:
            out[stem] = round(lower, 3)
    return out


CELLS = range(1 << SPLITS)  # bit i of a cell's number is the half of split i


def _count(rows: DataFrame, wanted: frozenset | None) -> dict[int, Counter]:
    """For each cell, in how many documents a stem occurs; each task sums its own first. What returns grows with the bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {cell: Counter() for cell in CELLS}
        for batch in batches:
            for text, cell in zip(batch.column("text"), batch.column("cell").to_pylist(), strict=True):
                found = stems_of(text.as_py() or "")
                counts[cell].update(found if wanted is None else found & wanted)
        for cell, counter in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array([cell] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())], names=["stem", "cell", "n"])

    summed = rows.select("text", "cell").mapInArrow(run, "stem string, cell int, n long").groupBy("stem").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("cell") == c, F.col("n"))).alias(f"c{c}") for c in CELLS])
    got = (summed.filter(F.col("n") >= MIN_SUPPORT) if wanted is None else summed).collect()
    return {c: Counter({r["stem"]: r[f"c{c}"] for r in got if r[f"c{c}"]}) for c in CELLS}


def _half(cells: dict[int, Counter], split: int, half: int) -> Counter:
    return sum((counter for cell, counter in cells.items() if cell >> split & 1 == half), Counter())


def _features(rows: DataFrame, lexicons: dict[tuple[int, int], dict[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, once a split; each half is read with the other half's lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {(split, half): Lexicon(lexicons[split, 1 - half]) for split, half in lexicons}
        for batch in batches:
            got: list[list[list[float]]] = [[] for _ in range(SPLITS)]
            for text, cell in zip(batch.column("text"), batch.column("cell").to_pylist(), strict=True):
                tokens = tokens_of(text.as_py())
                for split in range(SPLITS):
                    got[split].append(features(tokens, own[split, cell >> split & 1]))
            for rows_of in got:
                yield pa.RecordBatch.from_arrays([pa.array(rows_of, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    table = rows.select("text", "cell", "label").mapInArrow(run, "x array<double>, label int").toPandas()
    x, y = np.array(table["x"].tolist()).reshape(-1, N_FEATURES), table["label"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # tasks end in any order; sums shouldn't depend on it
    return x[order], y[order]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """(text, label, cell) of at most ``bound`` labelled rows, chosen by a hash of doc_id; both tables are read whole."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    known = materialize(known.withColumn("cell", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(len(CELLS))).cast("int")), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "cell").agg(F.min("text").alias("text"))
    return materialize(rows.select("text", "label", "cell"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, train: Column, bound: int = MAX_LABELLED) -> Model:
    ship_code(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", train, bound)
    sizes = {(r["label"], r["cell"]): r["n"] for r in rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = lambda label, split, half: sum(n for (own, cell), n in sizes.items() if own == label and cell >> split & 1 == half)
    halves = [(split, half) for split in range(SPLITS) for half in (0, 1)]
    if any(not many(label, *own) for label in (0, 1) for own in halves):
        return untrained()
    positive = _count(rows.filter("label = 1"), None)
    negative = _count(rows.filter("label = 0"), frozenset().union(*positive.values()))
    x, y = _features(rows, {own: _weights(_half(positive, *own), _half(negative, *own), many(1, *own), many(0, *own)) for own in halves})
    model = fit_logistic(x, y, weight=TOXIC_WEIGHT)
    everywhere = [sum(cells.values(), Counter()) for cells in (positive, negative)]
    model.lexicon = _weights(*everywhere, many(1, 0, 0) + many(1, 0, 1), many(0, 0, 0) + many(0, 0, 1))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to doc_id of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.lexicon)
        for batch in batches:
            rows = np.array([features(tokens_of(t.as_py()), lexicon) for t in batch.column("text")]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(rows))], names=["doc_id", "score"])

    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def remainder(modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit(docs, labels, remainder(3) != 1)
    return score(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic; all columns pass through the scoring task."""
    model = fit(docs, labels, remainder(3) != 1)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.lexicon)
        for batch in batches:
            rows = np.array([features(tokens_of(t.as_py()), lexicon) for t in batch.column(names.index("text"))]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(rows) < THRESHOLD))

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


SQL = None
