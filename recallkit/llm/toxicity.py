"""Toxicity (operator 2): a weighted finite-state pattern grammar over clauses.

A text is read as symbols: a lexical transducer maps each word to insult, harm, intent, target,
possessive, negator, report, mark of quotation, end of clause or line or other, the closed
classes first; marks of quotation are paired within a line.  Four
transducers rewrite that string: *negation* (an insult or a verb of harm up to three words
after a negator is negated), *threat* (intent, then harm, then a person as its object, each
within a few words; or a clause that opens with harm: the object becomes a threat), *reported
speech* (after a verb of saying or inside quotation marks) and *target* (an insult within four
words of an address to someone or of their possessive is aimed).  They are composed once into one table, so each word
costs one step.

What is scored is the clause: the weights of its matches are summed by path (kind and what
the transducers found), and a logistic function of the paths gives the probability that the
clause is toxic.  A document's score is the noisy-or of its matched clauses and a base rate.
Words of insult, whole or as stems, with their weights (log-odds of documents above a
threshold) are learnt from labelled rows, and so are the weights of the paths, drawn to the
prior in ``PATHS``.  Learning reads at most ``MAX_TRAIN`` labelled rows, chosen by hash; all of
them are used if there are fewer.

Cases: null, empty and wordless texts match nothing and get the base rate; very long texts are
read whole; repeated rows score alike; labels other than 0 and 1 are ignored; with no labelled
rows of both kinds the lexicon is empty and paths have their priors; an empty table gives an
empty result; other columns are carried, those with names of the results replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallkit.llm.common import add_columns, bounded_labels, map_arrow, texts_of

MAX_TRAIN = 20_000
STEMS = range(4, 9)
MIN_SUPPORT = 3
MIN_WEIGHT = 1.5
NEGATION_REACH = 3
TARGET_REACH = 4
INTENT_REACH = 5
OBJECT_REACH = 3

OTHER, INSULT, HARM, INTENT, TARGET, POSSESSIVE, NEGATOR, REPORT, QUOTE, END, LINE, THREAT = range(12)
#: Fixed words of the closed classes (English, French, German, Spanish).
CLOSED = {
    HARM: "kill hurt destroy punch stab shoot strangle murder beat burn crush hang "
    "tuer frapper détruire étrangler brûler töten umbringen schlagen verprügeln erschießen matar golpear destruir quemar",
    INTENT: "will i'll we'll gonna going shall want must should let's hope wish vais veux allons werde werden will muss soll voy quiero vamos",
    TARGET: "you u yourself he him she her they them tu te toi vous ils du dich ihr euch sie tú te ti usted vosotros ellos",
    POSSESSIVE: "your their dein tus",
    NEGATOR: "not never no nobody don't doesn't isn't aren't wasn't won't can't ne pas jamais nicht nie kein keine nunca jamás",
    REPORT: "said says say called calls wrote claimed reported dit disait écrit sagte sagt schrieb behauptete dijo dice escribió",
}
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n\"“”«»]")
_MARKS = {**dict.fromkeys(".!?;", END), "\n": LINE, **dict.fromkeys("\"“”«»", QUOTE)}
_QUOTES = re.compile("[\"“”«»]")
#: Weight of a verb of harm; insults have theirs from the labels.
HARM_WEIGHT = 3.0
#: The paths of a clause with the prior of their weights.
PATHS = {
    (INSULT, ""): 1.0,
    (INSULT, "aimed"): 1.5,
    (INSULT, "negated"): 0.0,
    (INSULT, "reported"): 0.3,
    (THREAT, ""): 2.5,
    (THREAT, "negated"): 0.0,
    (THREAT, "reported"): 0.3,
}
CLAUSE_PRIOR, BASE_PRIOR = -2.0, -4.0

Step = Callable[[Hashable, tuple], tuple]


# The symbols between transducers are (class, flags); flags gather what has been found.
def negation(state: int, symbol: tuple) -> tuple:
    kind, flags = symbol
    if kind in (END, LINE):
        return 0, symbol
    if kind == NEGATOR:
        return NEGATION_REACH, symbol
    out = (kind, flags | {"negated"}) if state and kind in (INSULT, HARM) else symbol
    return max(0, state - 1), out


def threat(state: tuple, symbol: tuple) -> tuple:
    """States: clause start, idle, (intent, steps left), (harm, steps left, its flags)."""
    kind, flags = symbol
    stage, left, held = state
    if kind in (END, LINE):
        return ("start", 0, frozenset()), symbol
    if kind == HARM and stage in ("start", "intent"):
        return ("harm", OBJECT_REACH, flags), symbol
    if kind == TARGET and stage == "harm":
        return ("idle", 0, frozenset()), (THREAT, flags | held)
    if kind == POSSESSIVE and stage == "harm":  # what is harmed is a thing
        return ("idle", 0, frozenset()), symbol
    if kind == INTENT:
        return ("intent", INTENT_REACH, frozenset()), symbol
    if stage in ("intent", "harm") and left > 1:
        return (stage, left - 1, held), symbol
    if kind == QUOTE and stage == "start":
        return state, symbol
    return ("idle", 0, frozenset()), symbol


def reported(state: tuple, symbol: tuple) -> tuple:
    kind, flags = symbol
    said, quoted = state
    if kind in (END, LINE):  # a quotation goes on over sentences, to the end of its line at most
        return (False, quoted and kind == END), symbol
    if kind == QUOTE:
        return (said, not quoted), symbol
    if kind == REPORT:
        return (True, quoted), symbol
    return state, (kind, flags | {"reported"}) if (said or quoted) and kind in (INSULT, THREAT) else symbol


def aimed(state: int, symbol: tuple) -> tuple:
    kind, flags = symbol
    if kind in (END, LINE):
        return 0, symbol
    if kind in (TARGET, POSSESSIVE):
        return TARGET_REACH, symbol
    return max(0, state - 1), (kind, flags | {"aimed"}) if state and kind == INSULT else symbol


def compose(first: Step, second: Step) -> Step:
    """The transducer that feeds the output of ``first`` to ``second``."""

    def step(state: tuple, symbol: tuple) -> tuple:
        a, between = first(state[0], symbol)
        b, out = second(state[1], between)
        return (a, b), out

    return step


_NUMBER = {path: i for i, path in enumerate(PATHS)}


def _path(kind: int, flags: frozenset) -> int:
    """The path of a match; reported speech outranks negation, negation a target."""
    named = [f for f in ("reported", "negated", "aimed") if f in flags and (kind, f) in PATHS]
    return _NUMBER[kind, named[0] if named else ""]


def compile_grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed machine as tables ``next[state][class]`` and ``path[state][class]`` (-1: no match)."""
    machine = compose(compose(compose(negation, threat), reported), aimed)
    start = (((0, ("start", 0, frozenset())), (False, False)), 0)
    number, queue, moves, paths = {start: 0}, [start], [], []
    for state in queue:
        row, out = [], []
        for kind in range(THREAT):
            after, (made, flags) = machine(state, (kind, frozenset()))
            if after not in number:
                number[after] = len(queue)
                queue.append(after)
            row.append(number[after])
            out.append(_path(made, flags) if made in (INSULT, THREAT) else -1)
        moves.append(row)
        paths.append(out)
    return moves, paths


class Lexicon(dict):
    """Word to (class, weight), filled on demand from whole words and stems."""

    LIMIT = 300_000

    def __init__(self, learnt: dict[str, float]):
        self.learnt = learnt
        self.closed = {w: k for k, words in CLOSED.items() for w in words.split()} | _MARKS

    def __missing__(self, word: str) -> tuple[int, float]:
        kind = self.closed.get(word)
        if kind is None:
            best = max([self.learnt.get(word, 0.0), *(self.learnt.get(word[:k] + "*", 0.0) for k in STEMS)])
            found = (INSULT, best) if best else (OTHER, 0.0)
        else:
            found = (kind, 0.0)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


def paired(text: str) -> str:
    """The text with marks of quotation in pairs: the last of a line that has an odd number goes."""
    if not _QUOTES.search(text):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        marks = [m.start() for m in _QUOTES.finditer(line)]
        if len(marks) % 2:
            lines[i] = line[: marks[-1]] + " " + line[marks[-1] + 1 :]
    return "\n".join(lines)


def match(text: str, lexicon: Lexicon, grammar: tuple) -> list[list[float]]:
    """The clauses of the text that match: weight by path."""
    moves, paths = grammar
    read = [lexicon[t] for t in _TOKEN.findall(paired(text.lower()))]
    if not any(kind == INSULT or kind == HARM for kind, _ in read):
        return []
    clauses, found, state = [], None, 0
    for kind, weight in read:
        path = paths[state][kind]
        if path >= 0:
            found = found or [0.0] * len(PATHS)
            found[path] += weight or HARM_WEIGHT
        state = moves[state][kind]
        if kind in (END, LINE) and found:
            clauses.append(found)
            found = None
    return clauses + [found] if found else clauses


class Scores:
    """Clause weights (a bias, one a path) and base rate; documents by noisy-or."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.array([CLAUSE_PRIOR, *PATHS.values(), BASE_PRIOR]) if weights is None else weights

    def parts(self, clauses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the logistic function and probability of each clause."""
        x = np.column_stack([np.ones(len(clauses)), np.log1p(clauses)])
        return x, 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1], -30, 30)))

    def of(self, owner: np.ndarray, clauses: np.ndarray, n: int) -> np.ndarray:
        """Score of ``n`` documents; clause ``i`` belongs to document ``owner[i]``."""
        clean = np.full(n, -np.logaddexp(0, self.weights[-1]))
        np.add.at(clean, owner, np.log1p(-np.minimum(self.parts(clauses)[1], 1 - 1e-12)))
        return -np.expm1(clean)

    def fit(self, owner: np.ndarray, clauses: np.ndarray, toxic: np.ndarray, steps: int = 600) -> "Scores":
        """Weights of greatest likelihood, drawn to the prior, by gradient steps (Adam)."""
        prior, n = self.weights.copy(), len(toxic)
        first, second = np.zeros_like(prior), np.zeros_like(prior)
        for step in range(1, steps + 1):
            x, p = self.parts(clauses)
            score = np.clip(self.of(owner, clauses, n), 1e-9, 1 - 1e-9)
            outer = np.where(toxic == 1, (1 - score) / score, -1.0)  # of the log-likelihood by -log(clean)
            slope = np.append(x.T @ (outer[owner] * p), outer.sum() / (1 + np.exp(-self.weights[-1])))
            slope -= 0.5 * (self.weights - prior)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            self.weights = self.weights + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return self


def stacked(found: list[list[list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and weights of all clauses of some documents."""
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return owner, np.array([c for x in found for c in x], float).reshape(-1, len(PATHS))


def word_features(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w not in _MARKS}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``text, toxic`` of at most ``MAX_TRAIN`` labelled rows (about, as hashes fall)."""
    usable = bounded_labels(labels.where(~held_out), "toxic", MAX_TRAIN)
    # at most MAX_TRAIN pairs of numbers: a broadcast of bounded size
    return docs.join(F.broadcast(usable), "doc_id").select(F.col("text").cast("string"), "toxic")


def fold(text: bytes) -> int:
    return zlib.crc32(text) % 2


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Words and stems of toxic rows with a high log-odds, lowered by its standard error.

    Three lexicons: of fold 0, of fold 1, and of all rows.
    """
    names = ["toxic0", "clean0", "toxic1", "clean1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in names]
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                at = seen[2 * fold(text) + 1 - toxic]
                at.update(word_features(text.decode()))
                at[""] += 1  # counts the rows
        keys = sorted(set().union(*seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)],
            names=["feature", *names],
        )

    schema = "feature string, " + ", ".join(f"{n} bigint" for n in names)
    counted = rows.transform(map_arrow, count, schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    counted = counted.where(F.col("toxic0") + F.col("toxic1") >= MIN_SUPPORT).persist()
    sizes = counted.where("feature = ''").first()
    learnt = []
    for used in ("0", "1", "01"):
        a, b = (sum((F.col(kind + f) for f in used), F.lit(0)) for kind in ("toxic", "clean"))
        n, m = (sum(sizes[kind + f] for f in used) if sizes else 0 for kind in ("toxic", "clean"))
        if not n or not m:
            learnt.append({})
            continue
        odds = F.ln((a + 0.5) / (n + 1.0)) - F.ln((b + 0.5) / (m + 1.0))
        sure = odds - 1.64 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        best = (
            counted.where((F.col("feature") != "") & (a >= MIN_SUPPORT))
            .select("feature", sure.alias("sure"))
            .where(F.col("sure") >= MIN_WEIGHT)
        )  # words of the bounded training rows
        learnt.append({r["feature"]: float(r["sure"]) for r in best.collect()})
    counted.unpersist()
    return learnt


def learn_weights(rows: DataFrame, by_fold: list[dict[str, float]]) -> Scores:
    """Weights of the paths from the bounded training rows.

    A row is matched with the lexicon of the other fold, so no word vouches for itself.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, grammar = [Lexicon(x) for x in by_fold], compile_grammar()
        for batch in batches:
            texts = texts_of(batch.column(0))
            found = [match(t.decode(), lexicons[1 - fold(t)], grammar) for t in texts]
            flat = [[w for clause in clauses for w in clause] for clauses in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    kind = rows.schema["toxic"].dataType.simpleString()
    sample = rows.transform(map_arrow, vectors, f"x array<double>, toxic {kind}").collect()
    clauses = [np.array(r["x"], float).reshape(-1, len(PATHS)).tolist() for r in sample]
    return Scores().fit(*stacked(clauses), np.array([r["toxic"] for r in sample]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, keep: list[str] | None = None
) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` beside the columns of ``docs``.

    ``held_out`` is a condition on ``doc_id``; its rows' labels are never read.
    """
    rows = training_rows(docs, labels, held_out).persist()
    *by_fold, learnt = learn_lexicons(rows)
    weights = (learn_weights(rows, by_fold) if learnt else Scores()).weights
    rows.unpersist()

    def compute(texts: list[bytes]) -> list[pa.Array]:
        lexicon, grammar = _cached(learnt)
        found = [match(t.decode(), lexicon, grammar) for t in texts]
        scores = Scores(weights).of(*stacked(found), len(texts))
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return add_columns(docs, "text", added, compute, keep)


_LAST: dict = {}


def _cached(learnt: dict[str, float]) -> tuple[Lexicon, tuple]:
    """One lexicon and grammar for all batches of a worker's task."""
    key = hash(frozenset(learnt.items()))
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = (Lexicon(learnt), compile_grammar())
    return _LAST[key]
