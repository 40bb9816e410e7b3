"""Mixing sources to target weights by range-sorted random keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, ranked, running_totals, table, wrapped

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources(source, source_size)`` with the words that each is to give.

    Sources in code point order, null last, weigh ``weights`` in rotation.
    They share ``share`` times all words; none gives over ``most`` times its
    own words, and what it cannot give is shared again by weight.
    """
    ranked = running_totals(sources.withColumn("_one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], "_one", "_rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select(
        "source",
        "source_size",
        F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * F.lit(most)).alias("_cap"),
    )
    ranked = materialize(ranked, "sources")
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        n, given, rest = ranked.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (budget - given) / rest
    return ranked.select("source", "source_size", F.least("_cap", F.lit(level) * F.col("_weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, taken`` and the columns
    ``also`` for every row of ``docs``. Within a source, documents stand in the order of a key hashed
    from ``doc_id`` and ``seed``; the source's target, rounded to whole words,
    is cut off that order, which starts again once all its words are taken.
    The document at the cut gives only its first words.

    Null texts have size 0; a null source is a source of its own; rows that
    agree in ``doc_id`` are put in order by size, and equal rows take from each
    other's share in either order. An empty table gives an empty result.
    """
    sizes = docs.select("doc_id", "source", _size(), *also).withColumn("_n", F.lit(1).cast("long"))
    return _cut(sizes, weights, share, most, seed).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_rounds") * F.col("size") + F.col("_part")).cast("long").alias("taken"), *also
    )


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def _cut(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``sizes(doc_id, source, size, _n, ...)``, each row of which stands for ``_n`` documents, with ``source_size, target``,
    how often each is taken whole (``_rounds``) and how many words all of them give beyond that (``_part``)."""
    sizes = sizes.withColumns({"_key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), "_all": F.col("size") * F.col("_n")})
    order = [F.col("source").asc_nulls_last(), F.col("_key").asc(), F.col("doc_id").asc_nulls_last(), F.col("size").asc(), *[F.col(c).asc() for c in ties]]
    placed = materialize(running_totals(sizes, ["source"], order, "_all", "_end"), "placed")
    sources = placed.groupBy("source").agg(F.sum("_all").alias("source_size"))
    goal = source_targets(sources, weights, share, most).withColumnRenamed("source", "_source")
    words = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    joined = placed.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_rounds", rounds)
    rest = words - F.col("_rounds") * F.col("source_size")
    return joined.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_all"), rest - (F.col("_end") - F.col("_all")))))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs`` that it takes, with ``size, source_size, target, taken``; see ``mix``.

    A text of which fewer words are taken than it has is cut after them. One
    that is taken more than once appears once; ``taken`` tells how often.
    Rows that agree in id, source and text stand together in the order; should
    the cut fall among them, any of them are taken. Columns of ``docs`` may
    have any names; those called like the four are replaced. Nulls, repeated
    rows and empty tables are as for ``mix``.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")])
    # words are counted and put in order by class of equal rows; the texts meet their class in one join
    classes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("hash"), _size())
    classes = classes.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("_n"))
    taken = _cut(classes, weights, share, most, seed, ties=("hash",)).where("_rounds * size + _part > 0")
    taken = taken.selectExpr("doc_id AS of_id", "source AS of_source", "hash AS of_hash", "size", "source_size", "target", "_rounds AS rounds", "_part AS part", "_n AS n")
    taken = materialize(taken, "taken")
    rows = wrapped(docs).withColumn("source", F.col("given")[f"c{docs.columns.index('source')}"])
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("hash") == F.col("of_hash")))
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size") * F.col("n")) & (F.col("n") > 1)
    whole = rows.where(~cut).withColumn("taken", F.expr("rounds * size + part div n"))
    if taken.where(cut).isEmpty():
        out = whole
    else:  # equal rows, of one class in a source at most, take from its share one after the other
        order = [F.col("of_source").asc_nulls_last(), F.col("of_id").asc_nulls_last(), F.col("of_hash").asc()]
        nth = ranked(rows.where(cut), order, "nth", ["of_source", "of_id", "of_hash"])
        out = whole.unionByName(nth.withColumn("taken", F.expr("rounds * size + greatest(0L, least(size, part - (nth - 1) * size))")).drop("nth")).where("taken > 0")
    text = F.col("given")[f"c{docs.columns.index('text')}"]
    first = F.regexp_substr(text, F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("taken").cast("string"), F.lit("}+")))
    given = [F.col("given")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c != "text"]
    given.insert(docs.columns.index("text"), F.when(F.col("taken") < F.col("size"), first).otherwise(text).alias("text"))
    return out.select(*given, "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '7', doc_id::VARCHAR)) AS k
  FROM documents),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS r FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
l AS (
  SELECT arg_min((b - given) / rest, r) FILTER (WHERE (b - given) / rest * w <= cap) AS level
  FROM c, (SELECT 1.5::DOUBLE * sum(source_size) AS b FROM s)),
t AS (
  SELECT source, source_size, least(cap, level * w)::DOUBLE AS target,
         floor(least(cap, level * w) + 0.5)::BIGINT AS words FROM c, l)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
        + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - (e - size))))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
