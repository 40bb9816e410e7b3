"""Importance resampling towards a target distribution, over a persisted sparse matrix of hashed n-gram counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, ranked, table, unwrapped, wrapped
from .tokens import slices, unpadded

#: Lower case of bytes in words (letters, digits and all beyond ASCII), 0 for those between words.
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_WORD[65:91] = range(97, 123)

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: Features longer than this are hashed one by one.
_LONG = 48


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each slice of ``data``, for all slices byte by byte at once."""
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-length, -_LONG, "left"))
    for at in range(int(length[long]) if long < len(length) else 0):
        n = int(np.searchsorted(-length, -at, "left"))  # those of over ``at`` bytes
        old = state[long:n]
        state[long:n] = _CRC[(old ^ data[begin[long:n] + at]) & 255] ^ (old >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts (nulls: none): ``(bytes, start and size of each word, its text)``; bytes have one space between words."""
    raw, bounds = unpadded(texts.fill_null(""))
    data = _WORD[raw]
    inside = np.concatenate(([False], data != 0, [False]))
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    line = np.full(int((sizes + 1).sum()), 32, np.uint8)
    line[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = data[data != 0]
    return line, at, sizes, np.searchsorted(bounds, starts, "right") - 1


CSR = "ids array<long>, words array<long>, indptr array<int>, indices array<int>, counts array<int>"
#: Entries up to which a block is filled, or one longer document.
ENTRIES = 1 << 15
#: Bytes of a row group of the written matrix, as readers hold a whole one.
GROUP = 16 << 20


def _cut(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``rows`` as lists that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), rows)


def _block(ids: pa.Array, texts: pa.Array, runs: int, buckets: int) -> pa.RecordBatch:
    line, starts, sizes, text = words_of(texts)
    keys = []
    for n in range(1, runs + 1):  # runs of n words are neighbours in ``line``
        whole = np.arange(len(starts) - n + 1)[text[n - 1 :] == text[: len(text) - n + 1]] if len(starts) >= n else np.empty(0, np.int64)
        spans = starts[whole + n - 1] + sizes[whole + n - 1] - starts[whole]
        keys.append(text[whole] * buckets + crc32_of(line, starts[whole], spans) % buckets)
    cells, counts = np.unique(np.concatenate(keys), return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) * buckets)
    cuts = [0]
    while cuts[-1] < len(texts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(indptr, indptr[cuts[-1]] + ENTRIES, "right")) - 1))
    at, n = np.array(cuts), np.diff(cuts)
    own = np.concatenate([indptr[a : b + 1] - indptr[a] for a, b in zip(cuts, cuts[1:])])
    ids, words = pa.array(ids.to_pylist(), pa.int64()), pa.array(np.bincount(text, minlength=len(texts)), pa.int64())
    columns = [_cut(ids, at[1:]), _cut(words, at[1:]), _cut(pa.array(own, pa.int32()), np.cumsum(n + 1))]
    columns += [_cut(pa.array(x, pa.int32()), indptr[at[1:]]) for x in (cells % buckets, counts)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CSR.split(", ")])


def count_matrix(docs: DataFrame, runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """The document-by-bucket matrix of ``docs(doc_id, text)`` as CSR blocks, one a row: ``ids, words, indptr, indices, counts``.

    Words are runs of letters, digits and characters beyond ASCII, A to Z
    lower-cased; a feature is a run of 1 to ``runs`` neighbouring words, joined
    by spaces, and counts in bucket ``crc32 % buckets``. Row ``i`` of a block
    is the document ``ids[i]`` of ``words[i]`` words, with ``counts`` in
    ``indices`` from ``indptr[i]`` up to ``indptr[i + 1]``. A block has up to
    2,000 documents or ``ENTRIES`` counts, or one longer text, as Parquet's
    writer holds a hundred rows before it looks at their size.

    Null and empty texts are rows without counts, null ids stay null, repeated
    rows are rows of their own, and an empty table has no blocks.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000, 4 << 20):
                yield _block(part.column(0), part.column(1), runs, buckets)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, CSR)


def _blocks(batch: pa.RecordBatch, *names: str):
    """The arrays ``names`` of one block of ``batch`` after the other."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
    for n in range(batch.num_rows):
        yield [c[n].values for c in columns]


def column_sums(matrix: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, n`` over all rows of the matrix, for buckets with counts; each task sends one number a bucket at most."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in _blocks(batch, "indices", "counts"):
                sums += np.bincount(indices.to_numpy(), counts.to_numpy(), buckets).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    return matrix.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, gain`` for the buckets of ``raw``, both ``bucket, n``.

    A gain is the thousandfold logarithm, rounded down, of how much likelier
    the bucket is in the target, with one added to each of its counts.
    """
    of_raw, of_target = (x.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total")).first()[0] for x in (raw, target))
    both = raw.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, "t")
    ratio = (F.col("t") + 1.0) * F.lit(of_raw + buckets) / ((F.col("n") + 1.0) * F.lit(of_target + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def row_weights(matrix: DataFrame, gains: DataFrame, buckets: int = 10_000) -> DataFrame:
    """The matrix times the gains: ``doc_id, words, n_features, weight``.

    The vector of gains, one number a bucket whatever the input, is sent with the tasks.
    """
    vector = np.zeros(buckets, np.int64)
    for bucket, gain in gains.where(F.col("bucket") < buckets).collect():
        vector[bucket] = gain

    def run(batches):
        for batch in batches:
            for ids, words, ptr, indices, counts in _blocks(batch, "ids", "words", "indptr", "indices", "counts"):
                at, counts = ptr.to_numpy(), counts.to_numpy().astype(np.int64)
                sums = (np.diff(np.concatenate(([0], np.cumsum(x)))[at]) for x in (counts, vector[indices.to_numpy()] * counts))
                yield pa.RecordBatch.from_arrays([ids, words, *map(pa.array, sums)], names=["doc_id", "words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 10, least: int = 20, runs: int = 1, buckets: int = 10_000, seed: int = 2024
) -> DataFrame:
    """Draw ``share`` percent of ``docs`` without replacement, by importance for the distribution of ``target(text)``.

    Returns ``doc_id, n_features, weight, score, rank`` for every row of
    ``docs(doc_id, text)``. ``weight`` is the sum of the gains of a document's
    features (see ``bucket_gains``), ``score`` adds Gumbel noise hashed from
    seed and id, and the highest scores among documents of ``least`` words or
    more are drawn: ``rank`` is 1, 2, 3, ... in the order of scores, ties by
    the smaller id, null for those not drawn.

    The count matrix is written once to the shared folder; sums and weights
    are read off it, and only ids and numbers are sorted, by range. Texts
    without words weigh 0 and are never drawn; a null id has the noise of an
    empty one and comes last among ties; repeated rows are drawn one by one;
    an empty table gives an empty result, an empty target counts nothing.
    """
    matrix = materialize(count_matrix(docs, runs, buckets), "csr", **{"parquet.block.size": str(GROUP)})
    aim = column_sums(count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets), buckets)
    gains = bucket_gains(materialize(column_sums(matrix, buckets), "sums"), materialize(aim, "sums"), buckets)
    rows = row_weights(matrix, gains, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = materialize(rows.withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("words") >= least
    drawn = share * rows.where(fit).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    nth = F.when(F.col("nth") <= drawn, F.col("nth")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked(rows.where(fit), order, "nth").select(*columns, nth).union(rows.where(~fit).select(*columns, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, of any columns; rows that share an id are drawn if any of them is."""
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("of_id")).distinct()
    rows = wrapped(docs)
    return unwrapped(rows.join(ids, F.col("id").eqNullSafe(F.col("of_id")), "left_semi"), docs)


def resampling_query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RESAMPLING_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aim AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, octet_length(encode(w))),
      lambda i: [(('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM aim)),
f AS (SELECT doc_id, bucket, count(*) AS n FROM words JOIN crc USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY ALL),
t AS (SELECT bucket, count(*) AS t FROM aim JOIN crc USING (w) GROUP BY ALL),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM f JOIN gains USING (bucket) GROUP BY ALL),
scores AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
places AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS nth FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * (SELECT count(nth) FROM places) // 100 THEN nth END AS rank FROM places
"""
