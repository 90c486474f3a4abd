"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Regular expressions propose candidate spans. Labelers vote on each: the strict shape, a checksum or format test, a
gazetteer, the words before it and its boundaries. The votes of all documents are counted by kind and vote pattern (a
number of groups that does not grow with the data); expectation-maximisation over those counts estimates every
labeler's reliability, and a logistic span classifier is trained on the resulting posteriors. Spans of the four base
kinds that pass their tests always stay; a candidate of another kind stays if the classifier gives it half or more.

Spans are in code points, end exclusive. Patterns use possessive repeats and start only at the head of a run, so long
runs cost linear time and no stack; both leave the leftmost matches as they are. The labeler of the words before a
candidate reads the 40 characters before it, back to the candidate of its kind before; all others read it whole.

Defined cases: null counts as empty and has no spans; an empty table gives an empty table; repeated rows give
repeated results; other columns are ignored (or carried by ``mask_documents``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LOCAL = "[A-Za-z0-9._%+-]"
HEAD = rf"(?:\G|(?<!{LOCAL}))"
#: Kinds in the order of ties. The first four are the base.
PATTERNS = {
    "email": rf"{HEAD}{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?:[a-f0-9]{32,}+|(?:sk-|ghp_|gho_|ghs_|AKIA|xoxb-)[A-Za-z0-9]{16,}+)(?![A-Za-z0-9_-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][\p{Ll}]{1,30}+(?:\x20[A-Z][\p{Ll}]{1,30}+)?",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
#: A test that is cheaper than the pattern and holds wherever the pattern matches.
MAY_MATCH = {
    "email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: t.rlike(r"[a-f0-9]{32}|sk-|gh[pos]_|AKIA|xoxb-"), "ssn": lambda t: t.rlike(r"-[0-9]{2}-"), "name": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z]"),
}
CONTEXT = {
    "email": "mail|contact|write|reach|adresse|correo|kontakt", "ip": "ip|host|server|address|client|adresse|dirección", "card": "card|visa|credit|debit|account|carte|karte|tarjeta", "phone": "call|phone|tel|mobile|fax|ruf|llam|appel",
    "secret": "token|secret|key|password|passwd|auth|bearer", "ssn": "ssn|social|security", "name": "name|am|by|from|dear|nom|bin|soy",
}
GAZETTEER = {
    "email": r"\.(?:com|net|org|edu|gov|io|de|fr|es|uk|info)$", "ip": r"^(?!(?:0|127|255)\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])",
    "secret": r"^(?:sk-|gh[pos]_|AKIA|xoxb-)|[a-f][0-9]|[0-9][a-f]", "ssn": r"^(?!000|666|9)", "name": r"\x20(?:Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Garc\p{L}+|Martin|Bernard|Dubois|Müller|Schmidt|Schneider|Fischer|Weber|Meyer|Lopez|Gonz\p{L}+)$",
}
STRICT = {
    "email": r"^[A-Za-z0-9][^@]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", "card": r"^(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}[\x20-][0-9]{1,4})$", "phone": r"^\+[0-9]{1,3}[\x20(.-]|^\+[0-9]+$",
    "secret": r"^(?:[a-f0-9]{32}|[a-f0-9]{40}|[a-f0-9]{64}|[^a-f0-9].*)$", "ssn": "^[0-9]", "name": r"\x20[^\x20]+\x20",
}
SPANS = "__spans"
VOTES = ["strict", "format", "gazetteer", "context", "edges"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The test that a match must pass to be a span of a base kind; for the others a plausibility test."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(value))
        return (n >= 12) & (n <= 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[a-zA-Z]")
    return F.lit(True)


#: Entries of a block of running values, and code points of a block of text.
BLOCK, TEXT_BLOCK = 64, 8192
SPAN = "struct<start:int,kind:int,stop:int,votes:int>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each entry of a non-empty array what join makes of 0 and all entries before it.

    Blocks are run one by one, then their ends: appending to one array would cost the square of the entries.
    """

    def run(block: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, none, lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), join))
        return _once(run(ends, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda block, i: run(block, F.get(starts, i)))))

    count = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return _once(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(values, i * BLOCK + 1, BLOCK)), joined)


def _found(text: Column, kind: str) -> Column:
    """Candidates of one kind: the matches that pass its test, with positions and votes."""
    pattern = PATTERNS[kind]
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    none = F.array().cast(f"array<{SPAN}>")

    def walked(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]

        def span(hit: Column, i: Column, at: Column) -> Column:
            gap = F.get(gaps, i)
            start = at + F.length(gap)
            before, after = F.lower(F.right(gap, F.lit(40))), F.left(F.get(gaps, i + 1), F.lit(1))
            votes = [hit.rlike(STRICT[kind]), _passes(kind, hit), hit.rlike(GAZETTEER[kind]), before.rlike(rf"(?:^|\P{{L}})(?:{CONTEXT[kind]})"), ~F.right(gap, F.lit(1)).rlike(r"[\p{L}0-9]") & ~after.rlike(r"[\p{L}0-9]")]
            bits = sum((v.cast("int") * (1 << n) for n, v in enumerate(votes)), F.lit(0))
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(hit)).alias("stop"), bits.alias("votes"))
            return F.when(_passes(kind, hit), one)

        lengths = F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.length(hit))
        places = lambda at: F.array_compact(F.transform(hits, lambda hit, i: span(hit, i, F.get(at, i))))
        return F.when(F.size(hits) > 0, _once(_before(lengths, lambda a, v: a + v), places)).otherwise(none)

    return F.when(MAY_MATCH[kind](text), _once(both, walked)).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind: array of (start, kind, stop, votes)."""
    value = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(value, k) for k in KINDS]))


@dataclass
class SpanModel:
    """What expectation-maximisation learned, and the span classifier's chance for each kind and vote pattern."""

    prior: np.ndarray
    right: np.ndarray
    chance: np.ndarray

    def keeps(self, span: Column) -> Column:
        """Base kinds, and others that the classifier gives half or more."""
        yes = [int(kind * 32 + v) for kind in range(len(KINDS)) for v in range(32) if self.chance[kind, v] >= 0.5 or KINDS[kind] in BASE]
        return (span["kind"] * 32 + span["votes"]).isin(yes)


def fit_spans(found: DataFrame, spans: str = "spans", rounds: int = 50) -> SpanModel:
    """Fit on the candidates of all rows; only counts by kind and vote pattern reach the driver."""
    rows = found.select(F.explode(spans).alias("s")).groupBy("s.kind", "s.votes").count().collect()
    n = np.zeros((len(KINDS), 32))
    for r in rows:
        n[r.kind, r.votes] = r["count"]
    bits = (np.arange(32)[:, None] >> np.arange(len(VOTES))) & 1
    votes = np.where(bits == 1, 1, np.where(np.array(VOTES) == "context", 0, -1))  # no word nearby says nothing
    prior, right = np.full(len(KINDS), 0.6), np.full(len(VOTES), 0.8)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(np.log(prior / (1 - prior))[:, None] + (votes @ np.log(right / (1 - right)))[None])))
        agrees = (n * post).sum(axis=0) @ (votes == 1) + (n * (1 - post)).sum(axis=0) @ (votes == -1)
        prior = np.clip(((n * post).sum(axis=1) + 6) / (n.sum(axis=1) + 10), 0.1, 0.9)
        right = np.clip((agrees + 8) / (n.sum(axis=0) @ (votes != 0) + 10), 0.55, 0.97)
    x = np.array([[*(k == j for j in range(len(KINDS))), *votes[v], votes[v].sum() >= 3] for k in range(len(KINDS)) for v in range(32)], float)
    share, w = n.ravel() / max(n.sum(), 1) + 1e-4, np.zeros(x.shape[1])
    for _ in range(500):
        w -= 2.0 * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - post.ravel())) + 1e-4 * w)
    return SpanModel(prior, right, (1 / (1 + np.exp(-x @ w))).reshape(len(KINDS), 32))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): per row the kept spans, an array of (start, kind index, stop, votes) by start, then kind."""
    found = cut(docs.select(F.col(key), candidates(F.col(text)).alias("spans")), "spans")
    model = fit_spans(found)
    return found.select(key, F.filter("spans", model.keeps).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """text with each of its spans (at least one; by start) replaced by its kind; spans that overlap become one.

    The text is taken in blocks, so that a piece is found without counting from the text's start.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    length = F.length(text)

    def cut_out(blocks: Column) -> Column:
        def between(start: Column, stop: Column) -> Column:
            part = lambda b: F.substring(F.get(blocks, b), F.greatest(start - b * TEXT_BLOCK, F.lit(0)) + 1, F.least(stop, (b + 1) * TEXT_BLOCK) - F.greatest(start, b * TEXT_BLOCK))
            at = lambda p: F.floor(p / TEXT_BLOCK).cast("int")
            return F.when(stop > start, F.array_join(F.transform(F.sequence(at(start), at(stop - 1)), part), "")).otherwise("")

        def pieces(ends: Column) -> Column:
            first = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(between(F.get(ends, i), s["start"]), F.get(names, s["kind"]))))
            return F.concat(F.array_join(F.array_compact(first), ""), between(F.array_max(F.transform(spans, lambda s: s["stop"])), length))

        return _once(_before(F.transform(spans, lambda s: s["stop"]), lambda a, v: F.greatest(a, v)), pieces)

    count = F.floor((length - 1) / TEXT_BLOCK).cast("int")
    return _once(F.transform(F.sequence(F.lit(0), count), lambda b: F.substring(text, b * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK))), cut_out)


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with every kept span replaced by its kind in angle brackets; spans that overlap become one.

    Texts are searched once, and written with what was found. Null and empty texts stay as they are.
    """
    marked = cut(docs.withColumn(SPANS, candidates(F.col(text))), "spans")
    model = fit_spans(marked, SPANS)
    whole = _once(F.filter(F.col(SPANS), model.keeps), lambda spans: F.when(F.size(spans) > 0, _masked(F.col(text), spans)).otherwise(F.col(text)))
    return marked.withColumn(text, whole).select(*docs.columns)


def op3_pii(docs: DataFrame) -> DataFrame:
    found = find_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    counts = [count(n) for n in range(len(BASE))]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
