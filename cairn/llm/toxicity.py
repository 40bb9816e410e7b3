"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, partitions, table

# Classes of the grammar's words in English, German, French and Spanish.
INSULTS = "idiot moron stupid dumb trash scum loser pathetic worthless disgusting clown fool imbecile trottel dummkopf idiota imbécile estúpido crétin"
THREATS = "kill destroy hurt punch stab shoot strangle burn töten umbringen verprügeln tuer frapper matar golpear"
TARGETS = "you your yours yourself u he she they them those these people everyone du dich dir ihr euch sie tu toi vous vos usted ustedes tú ellos"
NEGATIONS = "not no never none without isn't aren't don't doesn't wasn't nicht kein keine nie niemals ohne pas jamais aucun sans nunca ningún sin tampoco"
REPORTS = "said says wrote called quoted quote claimed according told reported sagte schrieb nannte laut dit écrit selon appelé dijo escribió según llamó"

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What the transducers write: an insult, a target that makes a threat before it one, a hit at a target, a target that makes an insult before it one of its own.
HIT, MENACE, AIMED, ECHO = range(6, 10)
SYMBOLS, HITS = 10, (HIT, MENACE, AIMED, ECHO)
PREFIXES = range(4, 9)
#: Odd multipliers of the sketches by which near copies are told.
SKETCH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Weights of the grammar's arcs before any labels are seen: a hit at a target, after a negation, in reported speech.
FACTORS = (1.5, 0.2, 0.3)


class Machine:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state, the symbol written and the arcs' weights taken.

    The weights taken are the numbers of those in ``FACTORS``, as a bit mask.
    """

    def __init__(self, step, symbols: int = SYMBOLS, start=0):
        states, self.table = {start: 0}, []
        while len(self.table) < len(states):  # what the start reaches, tabulated
            here = list(states)[len(self.table)]
            row = []
            for c in range(symbols):
                there, out, taken = step(here, c)
                row.append((states.setdefault(there, len(states)), out, taken))
            self.table.append(row)

    def compose(self, other: Machine, symbols: int = SYMBOLS) -> Machine:
        """Reads what this machine reads and writes what ``other`` makes of what it writes; weights multiply."""

        def step(s, c):
            a, middle, x = self.table[s[0]][c]
            b, out, y = other.table[s[1]][middle]
            return (a, b), out, x | y

        return Machine(step, symbols, (0, 0))


def _insult(s, c):
    return s, HIT if c == INSULT else c, 0


def _threat(s, c, near=4):
    """A threat counts at a target, up to ``near`` tokens before or after it, and else not at all."""
    target, threat = s
    after = (max(0, target - 1), max(0, threat - 1))
    if c == TARGET:
        return (near, 0), MENACE if threat else TARGET, 0
    if c == THREAT:
        return (0, 0) if target else (after[0], near), AIMED if target else OTHER, 1 if target else 0
    return after, c, 0


def _target(s, c, near=4):
    """A hit counts more up to ``near`` tokens after a target or before one, where the target itself writes the difference."""
    target, hit = s
    after = (max(0, target - 1), max(0, hit - 1))
    if c == MENACE:
        return (near, 0), MENACE, 1
    if c == TARGET:
        return (near, 0), ECHO if hit else TARGET, 0
    if c == HIT:
        return (after[0], 0 if target else near), AIMED if target else HIT, 1 if target else 0
    return after, c, 0


def _negation(s, c, near=3):
    return near if c == NEGATION else max(0, s - 1), c, 2 if s and c in HITS else 0


def _report(s, c):
    return int(s or c == REPORT), c, 4 if s and c in HITS else 0


def grammar() -> list[list[tuple[int, int, int]]]:
    """The composed grammar by state and token class: next state, kind of hit (0 for none, 2 for an echo) and weights taken."""
    whole = Machine(_insult)
    for step, start in ((_threat, (0, 0)), (_target, (0, 0)), (_negation, 0), (_report, 0)):
        whole = whole.compose(Machine(step, start=start))
    return [[(s, (2 if out == ECHO else 1) if out in HITS else 0, taken) for s, out, taken in row[:6]] for row in whole.table]


def _arcs(factors: tuple[float, float, float]) -> list[list[float]]:
    """What a hit of each kind counts, by the weights taken."""
    aimed, negated, reported = factors
    out = []
    for kind in range(3):
        row = []
        for taken in range(8):
            value = (aimed if taken & 1 else 1.0) * (negated if taken & 2 else 1.0) * (reported if taken & 4 else 1.0)
            row.append(value if kind == 1 else value * (aimed - 1) if kind == 2 else 0.0)
        out.append(row)
    return out


class Lexicon:
    """Classes and weights of tokens; insults may be whole words or stems."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.fixed = {w: (c, 1.0) for c, names in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in names.split()}

    def look(self, token: str) -> tuple[int, float]:
        if weight := self.words.get(token):
            return INSULT, weight
        if found := self.fixed.get(token):
            return found
        for k in PREFIXES:
            if weight := self.stems.get(token[:k]):
                return INSULT, weight
        return OTHER, 0.0


class Scorer:
    def __init__(self, lexicon: Lexicon, factors: tuple[float, float, float] = FACTORS):
        self.lexicon, self.table, self.seen, self.arcs = lexicon, grammar(), {}, _arcs(factors)

    def token(self, t: str) -> tuple[int, float]:
        found = self.seen.get(t)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            found = self.seen[t] = self.lexicon.look(t)
        return found

    def clauses(self, text: str | None):
        """The hits of every clause that has any, as ``(kind, weights taken, weight)``."""
        text = (text or "").lower()
        if not any(self.token(t)[0] in (INSULT, THREAT) for t in set(TOKEN.findall(text))):
            return
        for clause in CLAUSE.split(text):
            state, hits = 0, []
            for t in TOKEN.findall(clause):
                kind, weight = self.token(t)
                state, hit, taken = self.table[state][kind]
                if hit:
                    hits.append((hit, taken, weight))
            if hits:
                yield hits

    def features(self, text: str | None) -> tuple[float, float]:
        """The sum of the clauses' scores, damped, and the largest."""
        scores = [sum(self.arcs[hit][taken] * weight for hit, taken, weight in hits) for hits in self.clauses(text)]
        return math.log1p(sum(scores)), min(max(scores, default=0.0), 4.0)

    def contexts(self, text: str | None) -> list[float]:
        """Weights of the text's hits, summed by kind and weights taken: 16 numbers."""
        out = [0.0] * 16
        for hits in self.clauses(text):
            for hit, taken, weight in hits:
                out[8 * (hit - 1) + taken] += weight
        return out


class Model:
    def __init__(self, lexicon: Lexicon, weights: tuple[float, float, float], factors: tuple[float, float, float] = FACTORS):
        self.lexicon, self.weights, self.factors = lexicon, weights, factors

    def score(self, text: Column) -> Column:
        """Probability of toxicity of a text column."""
        lexicon, factors, (bias, a, b) = self.lexicon, self.factors, self.weights

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            if "scorer" not in _held:
                _held["scorer"] = Scorer(lexicon, factors)
            x = np.array([_held["scorer"].features(t) for t in texts]).reshape(-1, 2)
            return pd.Series(1 / (1 + np.exp(-(bias + x @ np.array([a, b])))))

        _held: dict = {}
        return run(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """``text, toxic`` of at most about ``most`` labelled documents outside the held-out fifth, copies once.

    Documents with contradicting labels count as toxic if half or more say so.
    The sample is drawn by hashed ids. Only its ids and labels are broadcast.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text is not null")

    def sketch(batches):
        import xxhash

        for batch in batches:
            found = []
            for text in batch.column(0):
                w = text.as_py().lower().split()
                grams = {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
                found.append([min((g * m + m) & 0x7FFFFFFFFFFFFFFF for g in grams) for m in SKETCH])
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["text", "toxic", *(f"s{i}" for i in range(len(SKETCH)))])

    rows = rows.select("text", "toxic").mapInArrow(sketch, "text string, toxic int" + "".join(f", s{i} long" for i in range(len(SKETCH))))
    for i in range(len(SKETCH)):  # near copies would vouch for each other's rare words
        rows = rows.groupBy(f"s{i}").agg(F.max_by(F.struct(*(c for c in rows.columns if c != f"s{i}")), F.struct("toxic", "text")).alias("r")).select("r.*")
    return rows


def _stems(rows: DataFrame) -> DataFrame:
    """``feature, bad0, good0, bad1, good1``: in how many toxic and other texts of each half every word (``=word``) and prefix occurs."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = set()
                for t in set(TOKEN.findall(text.as_py().lower())):
                    if len(t) > 2:
                        found.add("=" + t)
                        found.update(t[:k] for k in PREFIXES if k <= len(t))
                counts.update((f, 2 * half + 1 - toxic) for f in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in counts]), pa.array([t for _, t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "cell", "n"]
            )

    counted = rows.select("text", "toxic", "half").mapInArrow(run, "feature string, cell int, n long")
    return counted.groupBy("feature").agg(*[F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(("bad0", "good0", "bad1", "good1"))])


def learn_lexicon(stems: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...], most: int) -> Lexicon:
    """Insults: the fixed words, and words and stems that are toxic beyond chance in ``halves`` of the sample.

    A feature's log-likelihood gain over the base rate must exceed what the
    best of all features would reach by chance; at most ``most`` are kept.
    """
    bad, good = (sum(sizes.get((h, t), 0) for h in halves) for t in (1, 0))
    words = {w: 1.0 for w in INSULTS.split()}
    if not bad or not good:
        return Lexicon(words, {})
    base = bad / (bad + good)
    stems = stems.select("feature", *[sum((F.col(f"{c}{h}") for h in halves[1:]), F.col(f"{c}{halves[0]}")).alias(c) for c in ("bad", "good")]).where("bad >= 3")
    rate = (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)
    gain = F.col("bad") * F.log(rate / base) + F.col("good") * F.log((1 - rate) / (1 - base))
    least = math.log(max(2, stems.count())) + 2
    kept = stems.withColumn("gain", gain).where((rate > max(0.8, base)) & (F.col("gain") >= least)).orderBy(F.desc("gain"), F.desc(F.length("feature")), "feature").limit(most).collect()
    found: dict[str, float] = {}
    for r in kept:
        f = r["feature"]
        if any(x.startswith(f.lstrip("=")) for x in (*words, *found)):
            continue  # it only generalises what explains as much
        weight = min(1.0, r["gain"] / (3 * least))
        if f[0] == "=":
            if not any(f[1 : k + 1] in found for k in PREFIXES):
                words[f[1:]] = weight
        elif not any(f[:k] in found for k in PREFIXES if k < len(f)):
            found[f] = weight
    return Lexicon(words, found)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by Newton's steps, near ``prior`` where the data are silent, and their log likelihood."""
    w = prior.copy()
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + (w - prior)
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    z = np.clip(x @ w, -30, 30)
    return w, float((n * (y * z - np.logaddexp(0, z))).sum() - ((w - prior) ** 2).sum() / 2)


def _fit_factors(c: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Weights of the grammar's arcs, each in turn that which explains the labels best, near ``FACTORS`` where they are silent."""
    best, steps = list(FACTORS), np.exp(np.linspace(-1.5, 1.5, 13))

    def merit(factors):
        arcs = np.array(_arcs(tuple(factors)))[1:].reshape(-1)
        x = np.stack([np.ones(len(c)), np.log1p(c @ arcs)], axis=1)
        return _logistic(x, y, n, np.array([-2.0, 2.0]))[1] - 2 * sum(math.log(f / g) ** 2 for f, g in zip(factors, FACTORS, strict=True))

    for _ in range(2 if len(y) else 0):
        for i, prior in enumerate(FACTORS):
            tried = [max(1.0, prior * t) if i == 0 else min(1.0, prior * t) for t in steps]
            best[i] = float(max(tried, key=lambda f: (merit([*best[:i], f, *best[i + 1 :]]), -abs(f - prior))))
    return tuple(best)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most: int = 5_000) -> Model:
    """Learn the lexicon, the weights of the grammar's arcs and those of the clause scores.

    The sample is halved by text hash. A lexicon learnt on each half reads the
    other, so arcs and scores are weighed on texts whose words it hasn't seen;
    the final lexicon is learnt on both. ``sample`` bounds the labelled rows,
    ``most`` the learnt lexicon. Reaching the driver: lexicons and 18 numbers
    of each sampled row.
    """
    rows = training_rows(docs, labels, sample).select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    rows = materialize(rows.repartition(partitions(docs.sparkSession)), "sample")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    stems = materialize(_stems(rows).where("bad0 + bad1 >= 3"), "stems")
    of = {h: learn_lexicon(stems, sizes, (1 - h,), most) for h in (0, 1)}  # learnt on the half that it doesn't read

    def run(factors=None):
        def work(batches):
            scorers = {h: Scorer(of[h], factors or FACTORS) for h in (0, 1)}
            for batch in batches:
                texts = zip(batch.column(0), batch.column(2).to_pylist(), strict=True)
                x = [(list(scorers[h].features(t.as_py())) if factors else scorers[h].contexts(t.as_py())) for t, h in texts]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

        got = sorted(rows.mapInArrow(work, "x array<double>, toxic int").groupBy("x", "toxic").count().collect())
        return np.array([r["x"] for r in got]).reshape(len(got), 2 if factors else 16), np.array([float(r["toxic"]) for r in got]), np.array([float(r["count"]) for r in got])

    factors = _fit_factors(*run())
    x, y, n = run(factors)
    w, _ = _logistic(np.hstack([np.ones((len(y), 1)), x]), y, n, np.array([-2.0, 2.0, 2.0]))
    return Model(learn_lexicon(stems, sizes, (0, 1), most), tuple(float(v) for v in w), factors)


def score_toxicity(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts match no clause and get the score of such texts. Rows
    with a null id are not held out and teach nothing. Without any labels the
    fixed words alone decide. Repeated rows stay apart; an empty table gives an
    empty result.
    """
    model = fit(docs, labels, **limits)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), model.score(F.col("text")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``docs`` with all their columns, of any names, that score below 0.5.

    Null and empty texts match no clause and stay, as do all rows without
    labels to learn from but for the fixed words; repeated rows are judged
    alike; an empty table gives an empty result.
    """
    model = fit(docs, labels, **limits)
    return docs.where(model.score(docs["text"]) < 0.5)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
