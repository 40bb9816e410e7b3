"""Secret scanning: fixed patterns plus a randomness test battery with false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_=-])")  # no parts of candidates

#: Inferred encodings, narrowest first.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_INDEX = [(name, len(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS]

#: Lower ends of the length classes within which discoveries are controlled.
LENGTHS = (20, 28, 40, 64, 128)
#: Scores are log10 of a p-value, kept in tenths from here up to 0.
FLOOR = -300


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> tuple[str, int] | None:
    """Encoding and score of ``token``: how well it passes as uniformly random.

    The score is ten times log10 of Fisher's combination of three p-values:
    chi-squared uniformity over the encoding's alphabet (Wilson and Hilferty's
    normal approximation), runs above and below the alphabet's middle, and the
    serial correlation of neighbouring symbols.
    """
    body = token.rstrip("=")
    found = next(((name, size, index) for name, size, index in _INDEX if all(c in index for c in body)), None)
    if found is None or not body:
        return None
    name, size, index = found
    x = np.fromiter((index[c] for c in body), np.int64, len(body))
    n = len(x)
    counts = np.bincount(x, minlength=size).astype(float)
    chi = float((counts**2).sum()) * size / n - n
    d = 2 / (9 * (size - 1))
    p_chi = _upper_normal(((max(chi, 0) / (size - 1)) ** (1 / 3) - (1 - d)) / math.sqrt(d))
    high = x >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * ups * downs / n + 1
        var = max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9)
        p_runs = 2 * _upper_normal(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - (size - 1) / 2
    spread = float((y**2).sum())
    p_serial = 2 * _upper_normal(abs(float((y[1:] * y[:-1]).sum()) / spread) * math.sqrt(n)) if spread and n > 1 else 1.0
    s = -sum(math.log(min(1.0, max(p, 1e-300))) for p in (p_chi, p_runs, p_serial))
    log_p = (-s + math.log(1 + s + s * s / 2)) / math.log(10)  # tail of chi-squared with 6 degrees of freedom
    return name, max(FLOOR, round(10 * log_p))


def length_class(n: int) -> int:
    return max((i for i, low in enumerate(LENGTHS) if n >= low), default=0)


def _ordinary(text: str) -> tuple[str, int] | None:
    """A string that reads like an identifier made of the text's own words, half of them numbered, and its length class."""
    words = WORD.findall(text)
    if not words:
        return None
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    k = seed % len(LENGTHS)
    low = LENGTHS[k]
    at, made = (seed >> 8) % len(words), ""
    for i in range(low):
        made += words[(at + i) % len(words)]
        if len(made) >= low:
            break
    if len(made) < low:
        return None
    cut = made[: low + (seed >> 16) % (low // 4)]
    return (f"{cut[:-2]}{seed % 90 + 10}" if seed >> 24 & 1 else cut), k


SCANNED = (
    "doc_id long, base array<struct<start:int,kind:int,stop:int>>, "
    "more array<struct<start:int,stop:int,size:int,score:int>>, null_size int, null_score int"
)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, scored candidates and one ordinary string's score for each row."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))),
            ("more", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("size", pa.int32()), ("score", pa.int32())]))),
            ("null_size", pa.int32()),
            ("null_score", pa.int32()),
        ]
    )

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more, starts, ends = [], [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
                for m in CANDIDATE.finditer(text):
                    a, b = m.span()
                    before = bisect_left(starts, b)
                    if before and ends[before - 1] > a:  # some fixed pattern has a part of it
                        continue
                    if score := randomness(m[0]):
                        more.append({"start": a, "stop": b, "size": length_class(b - a), "score": score[1]})
                null = _ordinary(text)
                score = null and randomness(null[0])
                rows.append(
                    {
                        "doc_id": doc_id,
                        "base": [{"start": s, "kind": k, "stop": e} for s, k, e in base],
                        "more": more,
                        "null_size": null[1] if score else None,
                        "null_score": score[1] if score else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def thresholds(scanned: DataFrame, rate: float) -> dict[int, int]:
    """The least score that is a discovery, for each length class that has one.

    A candidate's p-value is the share of ordinary strings of its length class
    that score as high; Benjamini and Hochberg's procedure at ``rate`` runs
    over each class's candidates. Both tables are histograms with at most
    ``len(LENGTHS) * (1 - FLOOR)`` rows.
    """
    null = scanned.where("null_score is not null").groupBy(F.col("null_size").alias("size"), F.col("null_score").alias("score")).count()
    seen = scanned.select(F.explode("more").alias("m")).groupBy("m.size", "m.score").count()
    tables = []
    for df in (null, seen):
        h = np.zeros((len(LENGTHS), 1 - FLOOR))
        for size, score, n in df.collect():
            h[size, score - FLOOR] += n
        tables.append(h)
    out = {}
    for k, (ordinary, found) in enumerate(zip(*tables, strict=True)):
        above = ordinary[::-1].cumsum()[::-1]
        m, found_above = found.sum(), found[::-1].cumsum()[::-1]
        p = (1 + above) / (1 + ordinary.sum())
        good = np.flatnonzero((found > 0) & (p <= rate * found_above / max(m, 1)))
        if len(good):
            out[k] = int(good[0]) + FLOOR
    return out


def _spans(docs: DataFrame, rate: float) -> DataFrame:
    scanned = materialize(scan(docs), "secrets")
    limits = thresholds(scanned, rate)
    least = F.create_map(*[F.lit(x) for kv in (limits or {-1: 0}).items() for x in kv])
    more = F.filter("more", lambda m: F.coalesce(m["score"] >= F.try_element_at(least, m["size"]), F.lit(False)))
    return scanned.select("doc_id", "base", F.transform(more, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["stop"].alias("stop"))).alias("more"))


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Secret spans of every row of ``docs``: ``doc_id, base, added``.

    ``base`` has the matches of the fixed patterns and ``added`` the other
    strings of 20 or more characters that pass the randomness battery at false-discovery rate ``rate`` within their length
    class. Both are arrays of ``(start, kind, stop)`` with ends exclusive,
    counted in code points. Null and empty texts have no spans; repeated rows
    and ids are scanned apart; an empty table gives an empty result.
    """
    return _spans(docs, rate).withColumnRenamed("more", "added")


def _joined(spans):
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    # a lambda of two parameters would be given each span's place in the array as its second
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans")
    )


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
