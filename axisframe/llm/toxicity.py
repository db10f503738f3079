"""Toxicity of texts that hide their words.

Words are read through a noisy channel: digits and signs stand for letters,
letters are spelled apart, or repeated. A Viterbi search over the lattice of
readings, weighted by the channel and by a character trigram model counted over
all documents, restores each such word. A lexicon of words and word beginnings
with their log-odds, learned from labelled documents, then weighs every word of
the restored text, and a logistic model over what was found gives the score.

Of the labelled rows at most ``MAX_LABELLED`` are used to fit lexicon and
logistic model, chosen by a hash of the key; the character model and the scores
cover all rows. Key, language, source and label of a row never enter its score.

Defined results: null and empty texts get the score of a text in which nothing
was found; labels that are null or of only one kind give no lexicon and the
rate of toxic labels as every score (0 without labels); a row with several
labels counts with each; repeated rows are scored one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty, written

#: The most labelled rows that lexicon and logistic model are fitted on.
MAX_LABELLED = 20_000
MIN_TOXIC, MIN_LOG_ODDS = 4, 2.0
PREFIXES = (3, 4, 5, 6, 7)

#: Letters that a sign may stand for, the likeliest first.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Signs that only part letters.
BETWEEN = frozenset(".-_~'`^/\\*,: ")
#: Costs in nats of reading a sign as a letter, of a less likely reading, of dropping a repeated letter, of dropping a sign.
READ_COST, LESS_COST, REPEAT_COST, DROP_COST = 0.7, 0.7, 0.3, 0.7

OTHER = "~"
_REST = re.compile(r"[^a-z]")
_LETTERS = re.compile(r"[^\W\d_]+")
_PURE = re.compile(r"[^\W\d_]+\Z")
_EDGE = re.compile(r"^[^\w@$!|+(€£¡*]+|[^\w@$]+\Z|^[*]+|[#%&|<>*$]+\Z")
_SIGNS_AT_END = re.compile(r"(?<=[^\W_])[$@]{1,2}\Z")
_APART = re.compile(r"(?<![^\s])(?:[^\s][ .\-_*~]){2,}[^\s](?![^\s.,;:!?])")
_RUN = re.compile(r"(.)\1\1")
_PARTING = re.compile("[" + re.escape("".join(sorted(BETWEEN))) + "]+")
_LONG_RUN = re.compile(r"(.)\1{3,}")
#: Tokens over LONGEST are decoded in pieces; in a piece that is itself longer, words of INSIDE letters or more are looked for.
LONGEST, INSIDE = 40, 5


@dataclass
class CharModel:
    """Trigrams of letters with counts, backed off to bigrams and a flat rest;
    words begin with two and end with one ``^``. Letters beyond a-z share one
    symbol, so a model has at most 28 ** 3 trigrams, however large the corpus."""

    three: Counter = field(default_factory=Counter)
    two: Counter = field(default_factory=Counter)
    _cost: dict = field(default_factory=dict)

    def add(self, word: str, times: int = 1) -> None:
        w = f"^^{_REST.sub(OTHER, word)}^"
        for i in range(2, len(w)):
            self.three[w[i - 2 : i + 1]] += times

    def close(self) -> CharModel:
        self.two = Counter()
        self._pair = Counter()
        self._one = Counter()
        for t, n in self.three.items():
            self._pair[t[:2]] += n
            self.two[t[1:]] += n
            self._one[t[1]] += n
        return self

    def cost(self, a: str, b: str, c: str) -> float:
        found = self._cost.get((a, b, c))
        if found is None:
            x, y, z = (ch if ch == "^" or "a" <= ch <= "z" else OTHER for ch in (a, b, c))
            low = (self.two[y + z] + 0.02) / (self._one[y] + 1.0)
            found = self._cost[a, b, c] = -math.log((self.three[x + y + z] + 3.0 * low) / (self._pair[x + y] + 3.0))
        return found


def lattice(seen: str) -> list[list[tuple[str, float]]]:
    """Per character of an observed word its readings ('' drops it) and costs."""
    steps = []
    for i, ch in enumerate(seen):
        arcs = []
        if ch.isalpha():
            arcs.append((ch, 0.0))
        for k, x in enumerate(READINGS.get(ch, "")):
            arcs.append((x, READ_COST + LESS_COST * k))
        if i and ch.isalpha() and ch == seen[i - 1]:
            arcs.append(("", REPEAT_COST))
        elif not ch.isalpha() and (ch in BETWEEN or not arcs):
            arcs.append(("", 0.1 if ch in BETWEEN else DROP_COST))
        steps.append(arcs)
    return steps


def decode(seen: str, model: CharModel) -> str:
    """The likeliest word behind an observed one: Viterbi over pairs of the
    last two letters."""
    best: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    for arcs in lattice(seen):
        now: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, word) in best.items():
            for x, extra in arcs:
                key, total, out = ((b, x), cost + extra + model.cost(a, b, x), word + x) if x else ((a, b), cost + extra, word)
                if key not in now or total < now[key][0]:
                    now[key] = (total, out)
        best = now
    return min(((cost + model.cost(a, b, "^"), word) for (a, b), (cost, word) in best.items()), default=(0.0, ""))[1]


def decodings(seen: str, model: CharModel) -> list[str]:
    """The decoded word, and that of the word with its runs cut to two and to
    one: repeated letters may stand for either."""
    cut = [re.sub(r"(.)\1{2,}", r"\1" * n, seen) for n in (2, 1)]
    return list(dict.fromkeys(decode(s, model) for s in ((seen,) if cut[0] == seen else (seen, *cut))))


def pieces(seen: str) -> list[str]:
    """A token with its long runs cut to three; if it is still longer than
    ``LONGEST``, its parts between signs that only part letters, where single
    characters in a row are one piece."""
    if len(seen) > LONGEST:
        seen = _LONG_RUN.sub(r"\1\1\1", seen)
    if len(seen) <= LONGEST:
        return [seen]
    found, spelled = [], ""
    for part in [*_PARTING.split(seen), ""]:
        if len(part) == 1:
            spelled += part
        else:
            found += [spelled, part]
            spelled = ""
    return [p for p in dict.fromkeys(found) if len(p) >= 3]


def decoded(seen: str, model: CharModel) -> list[str]:
    return [w for p in pieces(seen) if len(p) <= LONGEST for w in decodings(p, model)]


def readings(token: str, model: CharModel) -> list[str]:
    """The words of a token between white space: its runs of letters, or, if it
    looks disguised, what it decodes to as well."""
    core = _EDGE.sub("", token)
    if _PURE.match(core):
        words = [core] if not _RUN.search(core) else [core, *decodings(core, model)]
    else:
        words = _LETTERS.findall(token)
        letters = sum(map(len, words))
        if len(core) >= 3 and letters and (any(c in READINGS for c in core) or (len(words) > 1 and letters >= len(core) // 2)):
            words = [*words, *decoded(core, model)]
    signs = _SIGNS_AT_END.search(token)  # one or two may be letters
    if signs:
        words = [*words, *decoded(token, model)]
    return words


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


class Scanner:
    """Weights of words, kept by token."""

    def __init__(self, model: CharModel, lexicon: dict[str, float]):
        self.model, self.lexicon, self.cache = model, lexicon, {}
        self.longest = max(map(len, lexicon), default=0)

    def weigh(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(f, 0.0) for f in features(word))

    def token(self, token: str) -> float:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 600_000:
                self.cache.clear()
            found = max((self.weigh(w) for w in readings(token, self.model)), default=0.0)
            if len(token) > LONGEST and not _PURE.match(token):
                found = max([found, *(x for p in pieces(token) if len(p) > LONGEST for x in self.apart(p, INSIDE))])
            self.cache[token] = found
        return found

    def apart(self, letters: str, least: int = 3) -> list[float]:
        """Weights of words spelled apart, which may follow one another: a run
        is decoded in overlapping pieces, and words are looked for at every
        place of what comes out."""
        found: dict[str, float] = {}
        step = max(40, self.longest)
        for at in range(0, max(1, len(letters) - 20), step):
            for word in decodings(letters[at : at + step + max(20, self.longest)], self.model):
                found[word] = self.weigh(word)
                for i in range(len(word)):
                    for k in range(least, min(self.longest, len(word) - i) + 1):
                        if word[i : i + k] in self.lexicon:
                            found[word[i : i + k]] = self.lexicon[word[i : i + k]]
        return list(found.values())

    def facts(self, text: str) -> tuple[float, float, float]:
        """(largest weight, log of the sum, share) of the words found."""
        low = text.lower()
        token, cache = self.token, self.cache
        weights = [x for x in [cache[t] if t in cache else token(t) for t in low.split()] if x]
        for m in _APART.finditer(low):
            weights += [x for x in self.apart(re.sub(r"[ .\-_*~]", "", m[0])) if x]
        if not weights:
            return 0.0, 0.0, 0.0
        return max(weights), math.log1p(sum(weights)), math.log1p(len(weights))


def char_model(docs: DataFrame, text: str = "_text") -> CharModel:
    """Letter trigrams of the plain words of all documents, counted in parts;
    what comes to the driver is bounded by the alphabet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, words = CharModel(), Counter()

        def flush() -> None:
            for w, n in words.items():
                core = _EDGE.sub("", w)
                if _PURE.match(core):
                    model.add(core, n)
            words.clear()

        for batch in batches:
            for t in batch[text]:
                words.update(t.lower().split())
                if len(words) > 300_000:
                    flush()
        flush()
        yield pd.DataFrame(list(model.three.items()), columns=["three", "n"])

    rows = docs.select(text).mapInPandas(count, "three string, n long").groupBy("three").agg(F.sum("n").alias("n"))
    model = CharModel()
    for r in rows.collect():  # at most 28 ** 3 rows
        model.three[r["three"]] = r["n"]
    return model.close()


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``_text, toxic, half`` of the chosen labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "toxic")
    chosen = usable.orderBy(F.xxhash64("_id", F.lit(11)), "_id", "toxic").limit(most)
    rows = docs.select("doc_id", "_text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most MAX_LABELLED rows
    return written(rows.select("_text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(2)).cast("int").alias("half")), "labelled")


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def _supports(rows: DataFrame, model: CharModel, wanted: set[str] | None) -> DataFrame:
    """``feature, n``: in how many of the rows it is found."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        total: Counter = Counter()
        for batch in batches:
            for t in batch["_text"]:
                own: set[str] = set()
                for token in set(t.lower().split()):
                    if token not in known:
                        found = {f for w in readings(token, model) for f in features(w)}
                        known[token] = list(found if wanted is None else found & wanted)
                    own.update(known[token])
                total.update(own)
        yield pd.DataFrame(list(total.items()), columns=["feature", "n"])

    return rows.select("_text").mapInPandas(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame, model: CharModel) -> dict[str, float]:
    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    found = _supports(toxic, model, None).filter(F.col("n") >= MIN_TOXIC)  # bounded by the words of MAX_LABELLED rows
    support = {r["feature"]: r["n"] for r in found.collect()}
    other = {r["feature"]: r["n"] for r in _supports(clean, model, set(support)).collect()}
    odds = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((other.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in support.items()}
    # the weight also needs support: one standard error is taken off
    sure = {f: x - math.sqrt(1 / (support[f] + 0.5) + 1 / (other.get(f, 0) + 0.5)) * 0.5 for f, x in odds.items()}
    # a word beginning says more than a longer one only if more rows support it
    longest: dict[str, int] = {}
    for f, n in support.items():
        word = f.rstrip("~")
        for k in PREFIXES:
            if k < len(word) or (k == len(word) and f == word):
                longest[word[:k] + "~"] = max(longest.get(word[:k] + "~", 0), n)
    return {f: x for f, x in sure.items() if x >= MIN_LOG_ODDS and not (f[-1] == "~" and support[f] <= 1.1 * longest.get(f, 0))}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights with the bias last, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic model whose weights are not negative, so that finding more
    never lowers a score: columns with negative weights are left out in turn."""
    used = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, used], y)
        if not used or w[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(w[:-1])))
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def trained(docs: DataFrame, labels: DataFrame) -> Callable[[], tuple[Scanner, np.ndarray]]:
    """What makes scanner and weights; small enough to be sent to each task.

    The lexicon learned on one half of the labelled rows is scored on the
    other, which fits the logistic model; scores use the lexicon of both."""
    model = char_model(docs)
    rows = labelled(docs, labels)
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    lexicon = learn_lexicon(rows, model)
    rate = (toxic or 0) / n if n else 0.0
    if not lexicon:
        p = min(1 - 1e-9, max(1e-9, rate))
        weights = np.array([0.0, 0.0, 0.0, math.log(p / (1 - p))])
    else:
        xs, ys = [], []
        for half in (0, 1):
            part = learn_lexicon(rows.filter(F.col("half") == 1 - half), model)
            found = rows.filter(F.col("half") == half).mapInPandas(_facts(model, part), "toxic int, a double, b double, c double").collect()  # at most MAX_LABELLED rows
            xs += [(r["a"], r["b"], r["c"]) for r in found]
            ys += [r["toxic"] for r in found]
        weights = fit_rising(np.array(xs), np.array(ys))
    return lambda: (Scanner(model, lexicon), weights)


def _facts(model: CharModel, lexicon: dict[str, float]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model, lexicon)
        for batch in batches:
            facts = [scanner.facts(t) for t in batch["_text"]]
            out = pd.DataFrame(facts, columns=["a", "b", "c"])
            out.insert(0, "toxic", batch["toxic"].to_numpy())
            yield out

    return run


def scored(docs: DataFrame, make: Callable[[], tuple[Scanner, np.ndarray]]) -> DataFrame:
    """``doc_id, score`` of every row with ``doc_id`` and ``_text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, w = make()
        for batch in batches:
            x = np.array([scanner.facts(t) for t in batch["_text"]], float).reshape(-1, 3)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))})

    # keys pass as text: pandas would turn numbers beside nulls into floats
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "_text")
    return keyed.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row per document: whether its label is held out, score and verdict."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    out = scored(rows, trained(rows, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
