"""Toxicity by weak supervision.

Lexicon and pattern voters judge a bounded sample of labelled training rows. A generative model (expectation-
maximisation over a latent label, one table of vote probabilities per voter and label) estimates what each voter is
worth; residual correlations between voters then discount votes that repeat each other. The given label is one more
noisy voter, and no part of where the estimation starts. A linear classifier over term and pattern features is trained on
the posterior labels and scores whole texts.

Terms mined from the sample, words and stems that are dense in a text, join the built-in lexicons. Near copies count once: sampled rows that share the least hash of
their three-word shingles are one row, with the label that most of them have.

Defined cases: null and wordless texts have no hits and get the score of a text without hits; without labels the
model keeps its built-in prior; conflicting labels of a key count as toxic; repeated rows give repeated results;
other columns are ignored (or carried by ``drop_toxic``). Labels, language, source and key are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batches_of, cut, held_out_rows

WORD = re.compile(r"\w+")
#: Lexicon voters: one vote each, if any of its words stands in the text.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile imbeciles dimwit halfwit numbskull dumbass retard retarded brainless idiote imbécile stupide crétin abruti dumm blöd schwachkopf trottel vollidiot estúpido estúpida imbécil tonto",
    "worth": "loser losers worthless pathetic useless nobody failure minable nul wertlos versager jämmerlich inútil perdedor patético",
    "vermin": "scum trash garbage vermin filth parasite subhuman pig pigs rat ordure racaille vermine abschaum dreck ungeziefer müll basura escoria parásito",
    "ridicule": "clown clowns disgusting freak creep ugly laughable joke dégoûtant dégueulasse bouffon widerlich ekelhaft asqueroso payaso ridículo",
    "profanity": "fuck fucking fucker shit bullshit asshole bastard bitch cunt dick crap whore slut wanker putain merde connard salope scheiße arschloch hurensohn wichser mierda cabrón puta gilipollas",
    "threat": "kys hang lynch exterminate gas rape",
}
SEEDS = {w: name for name, words in LEXICONS.items() for w in words.split()}
ADDRESS = r"\b(?:you|your|youre|u|vous|tu|du|ihr|eres|tú)\b"
PATTERNS = {
    "addressed": re.compile(rf"{ADDRESS}\W+(?:\w+\W+){{0,3}}(?:{'|'.join(map(re.escape, SEEDS))})\b"),
    "command": re.compile(r"\b(?:shut up|get lost|kill yourself|go die|drop dead|ferme ta gueule|halt die fresse|cállate)\b"),
    "such": re.compile(rf"\b(?:such an?|what an?|total|complete|utter|so)\W+(?:{'|'.join(map(re.escape, SEEDS))})\b"),
}
#: Bounds: labelled rows and mined terms that a model is fitted on.
SAMPLE_ROWS, MINED_TERMS, MIN_ROWS = 20_000, 200, 8
MINED_VOTERS = 4
SHARED = ["bias", "any_seed", "seeds", *PATTERNS]
PRIOR = np.array([-3.0, 4.0, 1.0, 1.0, 3.0, 1.0])


#: Lengths of stems, and how often one must stand in a text to count: twice, and once in so many words.
STEMS, LEAST, DENSE = (5, 7), 3, 150


def dense_stems(words: list[str], known: set[str] | None = None) -> list[str]:
    """First letters that many of a text's words share, with a star; known: only of these."""
    counts = Counter(w[:n] for n in STEMS for w in words if len(w) > n and (known is None or w[:n] in known))
    least = max(LEAST, len(words) / DENSE)
    return [f"{stem}*" for stem, n in counts.items() if n >= least]


@dataclass
class ToxicityModel:
    """Terms and weights of the classifier, and what the label model learned about its voters."""

    terms: list[str]
    mined: list[str]
    weights: np.ndarray
    voters: dict[str, dict[str, float]] = field(default_factory=dict)
    correlations: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.at = {t: i for i, t in enumerate(self.terms)}
        self.stems = {t[:-1] for t in self.terms if t.endswith("*")}

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        """Indices of the terms present, and the values of the shared features."""
        low = (text or "").lower()
        words = WORD.findall(low)
        found = sorted(self.at[w] for w in self.at.keys() & {*words, *dense_stems(words, self.stems)})
        seeds = sum(self.terms[i] in SEEDS for i in found)
        return found, [1.0, float(seeds > 0), float(np.log1p(seeds)), *(float(bool(p.search(low))) if seeds or name == "command" else 0.0 for name, p in PATTERNS.items())]

    def score(self, text: str | None) -> float:
        found, shared = self.features(text)
        z = float(self.weights[: len(SHARED)] @ np.array(shared) + self.weights[[len(SHARED) + i for i in found]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def votes(self, found: list[int], shared: list[float]) -> list[int]:
        """1 toxic, 0 abstains, -1 clean: the lexicons, mined lexicons, patterns, and the absence of all hits."""
        names, mined = {SEEDS.get(self.terms[i]) for i in found}, {self.terms[i] for i in found} & set(self.mined)
        groups = {self.mined.index(t) % MINED_VOTERS for t in mined}
        out = [int(n in names) for n in LEXICONS] + [int(g in groups) for g in range(MINED_VOTERS)] + [int(x > 0) for x in shared[3:]]
        return [*out, 0 if any(out) else -1, 1 if len(found) > 2 else 0 if found else -1]


#: Where the posterior starts: rows with a hit of the lexicons, and rows without.
START = (0.6, 0.03)
#: Usual chances of the votes -1, 0 and 1 on clean and on toxic rows, and the rows that this counts for.
USUAL, WEIGHT = ((0.18, 0.80, 0.02), (0.05, 0.55, 0.40)), 4.0
VOTERS = [*LEXICONS, *(f"mined{g}" for g in range(MINED_VOTERS)), *PATTERNS, "no_hit", "many_hits", "label"]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, tables, correlations) for votes in {-1, 0, 1}; start: first posterior.

    tables[y, j, v + 1] is the chance of vote v by voter j if the label is y. After a first pass the correlations of
    the votes' residuals given the label discount each voter by 1 / (1 + the sum of its strong correlations).
    """
    n = len(votes)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    posterior, discount, rho = start.astype(np.float64), np.ones(votes.shape[1]), np.eye(votes.shape[1])
    for again in range(2):
        for _ in range(rounds):
            prior = np.clip((posterior.sum() + 1) / (n + 2), 0.001, 0.999)
            tables = _tables(onehot, posterior)
            gain = np.einsum("ijv,jv,j->i", onehot, np.log(tables[1]) - np.log(tables[0]), discount) + np.log(prior / (1 - prior))
            after = 1 / (1 + np.exp(-np.clip(gain, -50, 50)))
            moved, posterior = np.abs(after - posterior).max(), after
            if moved < 1e-6:
                break
        if not again:
            mean = np.einsum("yjv,v->yj", tables, np.array([-1.0, 0.0, 1.0]))
            residual = votes - ((1 - posterior)[:, None] * mean[0] + posterior[:, None] * mean[1])
            spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
            rho = (residual.T @ residual / max(1, n)) / np.outer(spread, spread)
            strong = np.where(np.abs(rho) > 0.2, np.abs(rho), 0)
            np.fill_diagonal(strong, 0)
            discount = 1 / (1 + np.clip(strong, 0, 1).sum(axis=1))
    return posterior, tables, rho


def _tables(onehot: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Chances of every vote by label: 2 x voters x 3, drawn a little to what a voter better than chance does."""
    return np.stack([(np.einsum("i,ijv->jv", w, onehot) + WEIGHT * np.array(usual)) / (w.sum() + WEIGHT) for w, usual in zip((1 - posterior, posterior), USUAL, strict=True)])


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights by Newton steps for soft labels y; strength pulls them to prior."""
    w = prior.astype(np.float64).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + strength * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sketch(words: list[str]) -> int:
    """Signed least hash of the three-word shingles: near copies mostly share it."""
    least = min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)
    return least - (1 << 64) if least >> 63 else least


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, mined_terms: int = MINED_TERMS) -> ToxicityModel:
    """Fit on at most sample_rows labelled rows outside the held-out fold, chosen by a hash of the key."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out_rows(key)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label)).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [_sketch(WORD.findall((t or "").lower())) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(marks, pa.int64())], names=["k", "t", "y", "s"])

    # A key that repeats stands for one row, that of the least text: the bound is on rows.
    rows = rows.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("k", "t", "y")
    marked = rows.mapInArrow(sketched, "k long, t string, y int, s long")
    sample = cut(marked.groupBy("s").agg(F.min_by(F.struct("k", "t"), F.struct("k", "t")).alias("r"), (F.avg((F.col("y") > 0).cast("int")) >= 0.5).cast("int").alias("y")).select("r.*", "y"), "sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((t or "").lower())
                counts[y > 0].update({*words, *dense_stems(words)})
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][w] for w in terms], pa.int64()), pa.array([counts[0][w] for w in terms], pa.int64())], names=["w", "n1", "n0"])

    totals = {r.y: r["count"] for r in sample.groupBy(F.expr("int(y > 0)").alias("y")).count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    mined: list[str] = []
    if n1 and n0:
        words = sample.select("t", "y").mapInArrow(counted, "w string, n1 long, n0 long").groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
        best = words.where((F.col("n1") >= MIN_ROWS) & (odds > 2)).orderBy((odds * F.sqrt("n1")).desc(), "w").limit(mined_terms)
        with batches_of(docs.sparkSession, BATCH_ROWS):
            mined = [r.w for r in best.collect()]
    model = ToxicityModel([*SEEDS, *(w for w in mined if w not in SEEDS)], mined, np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f for f, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], names=["y", "f", "s"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        rows = sample.select("t", "y").mapInArrow(vectors, "y int, f array<int>, s array<double>").collect()
    size = len(SHARED) + len(model.terms)
    prior = np.zeros(size)
    prior[: len(SHARED)] = PRIOR
    if not rows:
        model.weights = prior
        return model
    rows.sort(key=lambda r: (r.y, r.f, r.s))  # the same sums whatever the order of tasks
    y = np.array([r.y > 0 for r in rows], np.float64)
    votes = np.array([[*model.votes(r.f, r.s), 1 if r.y > 0 else -1] for r in rows])
    hits = np.array([bool(r.f) for r in rows])
    posterior, tables, model.correlations = label_model(votes, np.where(hits, START[0], START[1]))
    model.voters = {name: {"toxic_if_toxic": float(tables[1, j, 2]), "toxic_if_clean": float(tables[0, j, 2])} for j, name in enumerate(VOTERS)}
    x = np.zeros((len(rows), size), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(SHARED)] = r.s
        x[i, [len(SHARED) + j for j in r.f]] = 1
    used = np.flatnonzero(x.any(axis=0))
    model.weights = prior
    model.weights[used] = logistic(x[:, used].astype(np.float64), posterior, prior[used])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score) of every row. Narrow."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.score(t.as_py()) for t in b.column(2)], pa.float64())], names=[key, "held_out", "score"])

    rows = docs.select(F.col(key), held_out_rows(key).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, f"{key} {dict(docs.dtypes)[key]}, held_out boolean, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold; written, so that workers get few whole rows at once."""
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(place)], pa.bool_()))

    return cut(docs.mapInArrow(kept, docs.schema), "sound")


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs, fit_toxicity(docs, labels))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
