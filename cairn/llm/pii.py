"""Personal data by weak supervision, with DataFrame and SQL functions only.

Labelers (form, check, gazetteer, context, boundary, shape) vote on every
candidate span. Expectation-maximisation over the table of vote patterns
estimates how reliable each labeler is and how likely each pattern is personal
data; a logistic span classifier is then trained on those likelihoods and
decides which candidates beyond the fixed patterns are reported. No labeler
knows whether a fixed pattern found the candidate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, table

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Possessive repeats and the checks for where a match can begin
# change no match; they keep time and stack in proportion to the text's length.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = (
    (_LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "contains(text, '@')"),
    (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"s rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'", "digits"),
    (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", "luhn(s)", "digits"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(s, '[^0-9]', '')) between 8 and 15", "digits and contains(text, '+')"),
)
# Looser patterns, whose matches are reported only if the classifier accepts them.
WIDE = (
    (_LOCAL + r"\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++", "true", "(contains(text, '(at)') or contains(text, '[at]'))"),
    (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", "s rlike '[a-fA-F]'", "digits and contains(text, ':')"),
    (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "luhn(s)", "digits"),
    (r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "true", "digits"),
)

# Forms that are hardly anything else and forms that can't be right, gazetteers and context words, by kind.
FORM = (
    r"^[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9])?(?:@|\x20?[\[(]at[\])]\x20?)[a-z0-9-]+(?:(?:\.|\x20?(?:[\[(]dot[\])]|\.)\x20?)[a-z0-9-]+)*(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z]{2,}$",
    r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4})$",
    r"^(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    r"^(?:\+|00)[1-9]",
)
MALFORMED = (r"[.-]@|^[._%+-]|\.[0-9]+$|--", r"(?:^|\.)0[0-9]", r"\x20-|-\x20", r"[(][^)]*$|^[^(]*[)]|[.-]{2}")
GAZETTEER = (
    r"(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at)$",
    r"^(?!0|127\.|255\.|169\.254\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|30|36|38|35)",
    r"^(?:\+|00)\(?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
)
#: Where the gazetteer has no say: numbers without a country's code.
UNLISTED = (r"^$", r":", r"^$", r"^(?!\+|00)")
CONTEXT = (
    r"(?:e-?mail|mail|contact|kontakt|correo|courriel|write|reach)\W*+(?:\w++\W++){0,2}$",
    r"(?:ip|host|server|address|adresse|client|from|login)\W*+(?:\w++\W++){0,2}$",
    r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|payment)\W*+(?:\w++\W++){0,2}$",
    r"(?:tel|phone|telefon|t.l.phone|tel.fono|call|mobile|fax|whatsapp)\W*+(?:\w++\W++){0,2}$",
)
AGAINST = r"(?:version|isbn|issn|invoice|order|serial|sku|page|build|release|ref)\W*+(?:\w++\W++){0,1}$"

N_VOTES, N_SHAPES = 6, 3
#: The share of right votes that is taken for each labeler beforehand: form, check, gazetteer, context, boundary, shape.
TRUST = (0.9, 0.9, 0.8, 0.9, 0.6, 0.8)
_SPANS = "array<struct<kind:int,start:int,stop:int,s:string,before:string,after:string>>"


def _luhn(s: str) -> str:
    digit = "int(substring(d, i, 1))"
    return (
        f"exists(array(regexp_replace({s}, '[^0-9]', '')), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
        f"CASE WHEN (length(d) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0)"
    )


def _running(values: str, fold: str) -> str:
    """SQL for the running fold of an array of ints; ``fold`` takes {0} and {1}.

    Arrays grow within blocks of 64 and over the blocks, so time is in
    proportion to the number of values.
    """
    head, local, every = fold.format("element_at(ra, -1)", "rx"), fold.format("element_at(rh, -1)", "element_at(rl, -1)"), fold.format("element_at(heads, rb)", "rt")
    blocks = f"transform(sequence(0, (size(rv) - 1) div 64), rb -> aggregate(slice(rv, rb * 64 + 2, 63), array(rv[rb * 64]), (ra, rx) -> array_append(ra, {head})))"
    heads = f"aggregate(slice(blocks, 2, size(blocks)), array(element_at(blocks[0], -1)), (rh, rl) -> array_append(rh, {local}))"
    joined = f"flatten(transform(blocks, (rl, rb) -> transform(rl, rt -> if(rb = 0, rt, {every}))))"
    inner = f"transform(array({blocks}), blocks -> transform(array({heads}), heads -> {joined})[0])[0]"
    return f"transform(array({values}), rv -> if(size(rv) = 0, cast(array() AS array<int>), {inner}))[0]"


def _found(pattern: str, valid: str, gate: str, kind: int) -> str:
    """SQL for the array of valid matches of ``pattern`` in ``text``, with code point positions.

    ``before`` and ``after`` are up to 40 characters since the match before and
    the next one, if it is in no match: what the context labelers look at.
    """
    match = "x.m[i]"
    valid = _luhn(match) if valid == "luhn(s)" else valid.replace("s rlike", f"{match} rlike").replace("(s,", f"({match},")
    ends = _running("transform(x.m, (m, i) -> length(x.p[i]) + length(m))", "{0} + {1}")
    span = (
        f"if({valid}, named_struct('kind', {kind}, 'start', ends[i] - length({match}), 'stop', ends[i], 's', {match}, "
        "'before', substring(x.p[i], -40), 'after', substring(x.p[i + 1], 1, 1)), null)"
    )
    return f"""
      CASE WHEN {gate} THEN element_at(transform(
        array(named_struct('p', split(text, r'{pattern}', -1), 'm', regexp_extract_all(text, r'{pattern}', 0))), x ->
        CASE WHEN size(x.m) = 0 THEN cast(array() AS {_SPANS}) ELSE
          transform(array({ends}), ends -> filter(transform(sequence(0, size(x.m) - 1), i -> {span}), c -> c is not null))[0] END), 1)
      ELSE cast(array() AS {_SPANS}) END"""


def _pick(kind: str, options) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options)) + " END"


def _judged(spans: str, base: int) -> str:
    """SQL that adds votes (1, 0, -1) and shape features to every span of the array ``spans``."""
    seen = "lower(c.before)"
    votes = [
        "CASE WHEN " + _pick("c.kind", [f"c.s rlike r'{m}'" for m in MALFORMED]) + " THEN -1 WHEN " + _pick("c.kind", [f"lower(c.s) rlike r'{f}'" for f in FORM]) + " THEN 1 ELSE 0 END",
        "CASE WHEN c.kind = 2 THEN 1 WHEN c.kind = 3 AND length(regexp_replace(c.s, '[^0-9]', '')) < 8 THEN -1 ELSE 0 END",
        "CASE WHEN " + _pick("c.kind", [f"c.s rlike r'{u}'" for u in UNLISTED]) + " THEN 0 WHEN " + _pick("c.kind", [f"lower(c.s) rlike r'{g}'" for g in GAZETTEER]) + " THEN 1 ELSE -1 END",
        f"CASE WHEN {seen} rlike r'{AGAINST}' THEN -1 WHEN " + _pick("c.kind", [f"{seen} rlike r'{c}'" for c in CONTEXT]) + " THEN 1 ELSE 0 END",
        "CASE WHEN NOT c.before rlike '[0-9A-Za-z_/.=-]$' AND NOT c.after rlike '[0-9A-Za-z_@/]' THEN 1 ELSE -1 END",
        "CASE WHEN regexp_replace(c.s, '[^0-9A-Za-z]', '') rlike r'^(.)\\1*+$' THEN -1 ELSE 0 END",
    ]
    shapes = [
        "int(least(3, length(c.s) div 8))",
        "int(4 * length(regexp_replace(c.s, '[^0-9]', '')) div (length(c.s) + 1))",
        "int(c.s rlike '[ ()-]')",
    ]
    return (
        f"transform({spans}, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'base', {'true' if base else 'false'}, "
        f"'votes', array({', '.join(votes)}), 'shape', array({', '.join(shapes)})))"
    )


# Spans of ``wide`` that overlap none of ``base``: in order of starts, none of those
# before goes on beyond theirs (running maximum) and the next begins at their end at least.
CLEAR = f"""
  CASE WHEN size(wide) = 0 OR size(base) = 0 THEN wide ELSE
    transform(array(array_sort(concat(transform(base, b -> named_struct('start', b.start, 'at', -1, 'stop', b.stop)),
                                      transform(wide, (w, n) -> named_struct('start', w.start, 'at', n, 'stop', w.stop))))), al ->
      transform(array(named_struct('far', {_running("transform(al, s -> if(s.at < 0, s.stop, -1))", "greatest({0}, {1})")},
                                   'near', reverse({_running("reverse(transform(al, s -> if(s.at < 0, s.start, 2147483647)))", "least({0}, {1})")}))), e ->
        transform(filter(transform(al, (s, n) -> named_struct('at', s.at, 'clear', s.at >= 0 AND e.far[n] <= s.start AND e.near[n] >= s.stop)), s -> s.clear),
                  s -> wide[s.at]))[0])[0] END"""


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``_cands``: all spans of the fixed patterns and the looser ones that overlap none of them."""
    text = F.coalesce(docs["text"], F.lit(""))
    given = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)])
    rows = docs.select(given.alias("given"), text.alias("text"), text.rlike("[0-9]").alias("digits"))
    base = ", ".join(_found(*p, k) for k, p in enumerate(BASE))
    rows = rows.withColumn("base", F.expr(f"CASE WHEN digits OR contains(text, '@') THEN concat({base}) ELSE cast(array() AS {_SPANS}) END"))
    wide = ", ".join(_found(*p, k) for k, p in enumerate(WIDE))
    gate = " OR ".join(f"({p[2]})" for p in WIDE)
    rows = rows.withColumn("wide", F.expr(f"CASE WHEN {gate} THEN concat({wide}) ELSE cast(array() AS {_SPANS}) END"))
    both = f"concat({_judged('base', 1)}, {_judged(CLEAR, 0)})"
    return rows.select("given", F.expr(both).alias("_cands"))


def _em(patterns: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Likelihood that each (kind, votes) is personal data, by expectation-maximisation per kind.

    Each labeler has a reliability, the share of its votes that are right; 0
    abstains. Both classes are as likely beforehand, and a labeler as right as
    ``TRUST`` says, which weighs as a tenth of the candidates and 10 more.
    Reliabilities stay between 0.6 and 0.89, so that it takes two to reach 0.9.
    """
    post: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        counts: dict[tuple, int] = {}
        for k, votes, _, n in patterns:
            if k == kind:
                counts[votes] = counts.get(votes, 0) + n
        weight = 10 + 0.1 * sum(counts.values())
        reliable = list(TRUST)
        for _ in range(rounds):
            gain = [math.log(r / (1 - r)) for r in reliable]
            belief = {v: 1 / (1 + math.exp(-sum(x * g for x, g in zip(v, gain, strict=True)))) for v in counts}
            for j in range(N_VOTES):
                said = [(n, b if v[j] > 0 else 1 - b) for (v, n), b in zip(counts.items(), belief.values(), strict=True) if v[j]]
                right = (TRUST[j] * weight + sum(n * b for n, b in said)) / (weight + sum(n for n, _ in said))
                reliable[j] = min(0.89, max(0.6, right))
        post |= {(kind, v): b for v, b in belief.items()}
    return post


def train(cands: DataFrame, steps: int = 50) -> list[list[float]]:
    """Weights of the span classifier, for each kind: of 1, the votes and the shapes.

    What reaches the driver is one row per (kind, votes, shape) that occurs:
    at most 4 * 3**6 * 4 * 4 * 2 rows, whatever the input's size.
    """
    spans = cands.select(F.explode("_cands").alias("c"))
    rows = spans.groupBy("c.kind", "c.votes", "c.shape").count().collect()
    patterns = sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in rows)
    belief = _em(patterns)
    out = []
    for kind in range(len(KINDS)):
        own = [(v, s, n) for k, v, s, n in patterns if k == kind]
        w, ridge = np.zeros(1 + N_VOTES + N_SHAPES), 1e-5 * np.eye(1 + N_VOTES + N_SHAPES)
        x = np.array([[1.0, *map(float, v), *(t / 3 for t in s)] for v, s, _ in own])
        y, n = np.array([belief[kind, v] for v, _, _ in own]), np.array([float(n) for *_, n in own])
        for _ in range(steps if own else 0):  # Newton's
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n / n.sum() * (p - y)) + ridge @ w
            curve = (x * (n / n.sum() * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
            move = np.linalg.solve(curve, slope)
            w = w - move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
        out.append([float(v) for v in w])
    return out


def _accepted(weights: list[list[float]], threshold: float) -> str:
    """SQL for the spans to report: those of the fixed patterns and those that the classifier accepts."""
    sums = []
    for w in weights:
        terms = [f"{w[0]!r}D", *[f"{v!r}D * c.votes[{j}]" for j, v in enumerate(w[1 : 1 + N_VOTES])]]
        sums.append(" + ".join(f"({t})" for t in [*terms, *[f"{v / 3!r}D * c.shape[{j}]" for j, v in enumerate(w[1 + N_VOTES :])]]))
    least = math.log(threshold / (1 - threshold))
    return f"filter(_cands, c -> c.base OR {_pick('c.kind', sums)} >= {least!r}D)"


def _spans(cands: DataFrame, threshold: float):
    spans = f"transform({_accepted(train(cands), threshold)}, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'base', c.base))"
    return F.array_sort(F.expr(spans))


def find_pii(docs: DataFrame, threshold: float = 0.9, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``pii``: an array of ``(kind, start, stop, base)`` by kind, then start.

    Positions count code points, ends are exclusive. Spans of the fixed
    patterns are always reported; others if the classifier gives them
    ``threshold`` or more. Null and empty texts have none. Columns may have any
    names, but one called ``pii`` is replaced; repeated rows stay apart; an
    empty table gives an empty result.
    """
    keep = [c for c in keep or docs.columns if c.lower() != "pii"]
    cands = materialize(candidates(docs, keep), "pii")
    return cands.select(*[F.col("given")[f"c{i}"].alias(c) for i, c in enumerate(keep)], _spans(cands, threshold).alias("pii"))


def _redacted(text: str, pii: str) -> str:
    """SQL for ``text`` with the spans ``pii`` replaced by ``<kind>``."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    ordered = f"array_sort(transform({pii}, c -> named_struct('start', c.start, 'stop', c.stop, 'kind', c.kind)))"
    ends = _running("transform(o, c -> c.stop)", "greatest({0}, {1})")
    since = "if(n = 0, 0, ends[n - 1])"  # split by '' gives code points, whose slices are found without counting from the start
    piece = f"if(c.start < {since}, '', concat(array_join(slice(chars, {since} + 1, c.start - {since}), ''), '<', {names}[c.kind], '>'))"
    rest = "array_join(slice(chars, element_at(ends, -1) + 1, size(chars)), '')"
    inner = f"transform(array({ordered}), o -> transform(array({ends}), ends -> transform(array(split({text}, '')), chars -> concat(array_join(transform(o, (c, n) -> {piece}), ''), {rest}))[0])[0])[0]"
    return f"CASE WHEN {text} IS NULL OR size({pii}) = 0 THEN {text} ELSE {inner} END"


def redact(found: DataFrame) -> DataFrame:
    """The result of ``find_pii`` with its spans replaced by ``<kind>`` in ``text``, without ``pii``.

    Spans that overlap or touch an earlier one are taken out with it. Null
    texts stay null; rows are neither joined nor dropped.
    """
    return found.withColumn("text", F.expr(_redacted("text", "pii"))).drop("pii")


def redacted(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs`` with the spans that ``find_pii`` finds replaced by ``<kind>`` in ``text``; columns may have any names."""
    cands = materialize(candidates(docs, docs.columns), "pii")
    rows = cands.select("given", _spans(cands, threshold).alias("spans"))
    text = docs.columns.index("text")
    return rows.select(*[F.expr(_redacted(f"given.c{i}", "spans")).alias(c) if i == text else F.col("given")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, c -> concat_ws(':', array({', '.join(repr(k) for k in KINDS)})[c.kind], c.start, c.stop)), ',')"


def pii_query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.expr(f"bigint(size(filter(pii, c -> c.base AND c.kind = {k})))").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.expr(f"sha2({_joined('filter(pii, c -> c.base)')}, 256)").alias("base_sha256"), F.expr(_joined("pii")).alias("spans")
    )
