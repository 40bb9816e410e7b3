"""Benchmark decontamination by spaced-seed hashing, with DataFrame and SQL functions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, table, unwrapped, wrapped

#: Masks over neighbouring tokens; a 0 ignores the token there. Wherever one
#: token of 8 or 9, or two of 10 to 13, are substituted, one of these fits.
MASKS = ("1101011", "10110011", "10011101")
#: Tokens of the shortest items that are sought by these masks; shorter ones have masks of their own length.
SPAN = 8
WORDS = r"array_remove(split(lower(coalesce(text, '')), r'[^\p{L}\p{N}]+'), '')"


def _parts(mask: str) -> list[str]:
    """A mask's tokens as pairs of neighbours ``p`` and single ones ``a``: fewer values to hash at every position."""
    out, k = [], 0
    while k < len(mask):
        if mask[k : k + 2] == "11":
            out.append(f"p[i + {k}]")
            k += 2
        else:
            out += [f"a[i + {k}]"] * (mask[k] == "1")
            k += 1
    return out


def whole_masks(size: int, share: float) -> list[str]:
    """Masks over all of an item's ``size`` tokens, one of which fits wherever so many are substituted that ``share`` still agree.

    With d substitutions the tokens are parted in d + 2 groups (d + 1, if there
    are fewer tokens); each mask ignores d of them.
    """
    d = size - math.ceil(size * share - 1e-9)
    groups = min(size, d + 2) if d else 1
    out = []
    for gone in combinations(range(groups), d):
        out.append("".join("0" if k * groups // size in gone else "1" for k in range(size)))
    return out


def _seeds(masks: list[str]) -> str:
    """SQL for the array of seed hashes of ``words``: mask by mask by position."""
    every = [(len(m), f"xxhash64({n}, {', '.join(_parts(m))})") for n, m in enumerate(masks)]
    parts = [f"if(size(a) >= {span}, transform(sequence(0, size(a) - {span}), i -> {hashed}), array())" for span, hashed in every]
    pairs = "if(size(a) > 1, transform(sequence(0, size(a) - 2), i -> xxhash64(a[i], a[i + 1])), array())"
    return f"transform(array(transform(words, w -> xxhash64(w))), a -> transform(array({pairs}), p -> concat({', '.join(parts)}))[0])[0]"


def _place(pos: str, size: str, masks: list[str], which: bool = False) -> str:
    """SQL for the token at which the seed at ``pos`` of ``_seeds`` begins, of ``size`` tokens, or for ``which`` mask gave it."""
    out, before = "", "0"
    for k, mask in enumerate(masks):
        n = f"greatest(0, {size} - {len(mask) - 1})"
        out += f"WHEN {pos} < {before} + {n} THEN {k if which else f'{pos} - ({before})'} "
        before += f" + {n}"
    return f"CASE {out}END"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, shortest: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Overlaps of documents with benchmark items: ``doc_id, text_hash, item_id, matched, of, start``.

    Texts are lower-cased runs of letters and digits. Where a document and an
    item share a seed, the tokens on its diagonal are compared, and the overlap
    counts if some ``window`` tokens in a row of the item (all, if it has
    fewer) agree in ``share`` or more; substitutions are tolerated anywhere.
    One row per document and item gives the best count, out of how many, and
    the token of the document at which the item begins (negative if cut off).

    With the standard ``window`` and ``share`` every such overlap shares a seed:
    items of 8 tokens or more have the spaced ``MASKS``, shorter ones masks over
    all their tokens. Under 5 tokens that is the whole phrase; such items are
    sought only if ``shortest`` asks for it. An item's seeds don't depend on
    the other items. The item side is broadcast up to ``broadcast_rows`` seeds
    and shuffled beyond. Null texts match nothing;
    rows that repeat in id and text give one result; ``text_hash`` tells apart
    rows that share an id; empty tables give an empty result.
    """
    items = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text")).selectExpr("item_id", f"{WORDS} AS words").where(F.size("words") >= shortest)
    items = materialize(items.distinct(), "items")
    lengths = sorted(r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect())  # SPAN at most
    masks = [*MASKS, *(m for n in lengths for m in whole_masks(n, share))]
    seeds = _seeds(masks)
    # outer explosions: else Spark would compute the arrays once more, to filter empty ones
    item_seeds = items.select("item_id", "words", F.size("words").alias("n"), F.expr(f"posexplode_outer({seeds}) AS (pos, seed)"))
    item_seeds = item_seeds.select("item_id", F.col("n").alias("item_n"), F.expr(_place("pos", "n", masks)).alias("item_at"), F.expr(_place("pos", "n", masks, True)).alias("mask"), "seed")
    spans = f"array({', '.join(str(len(m)) for m in masks)})"
    own = f"if(item_n >= {SPAN}, mask < {len(MASKS)}, mask >= {len(MASKS)} and {spans}[mask] = item_n)"
    item_seeds = materialize(item_seeds.where(f"seed is not null and {own}").drop("mask"), "seeds")
    small = item_seeds.count() <= broadcast_rows
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # the size is taken before the explosion, which then has no words to copy to its rows
    # tokens that a short item may lack may also lie beyond a text's ends
    beyond = max((m.count("0") for m in masks[len(MASKS) :]), default=0)
    padding = f"array_repeat('', {beyond})"
    words = f"concat({padding}, {WORDS}, {padding})" if beyond else WORDS
    rows = known.selectExpr("doc_id", "text_hash", f"{words} AS words").select("doc_id", "text_hash", "words", F.size("words").alias("n"))
    rows = rows.select("doc_id", "text_hash", "n", F.expr(f"posexplode_outer({seeds}) AS (pos, seed)"))
    hits = rows.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    hits = hits.select("doc_id", "text_hash", "item_id", "item_n", (F.expr(_place("pos", "n", masks)) - F.col("item_at") - beyond).alias("start")).distinct()
    # texts rejoin their hits, so that they aren't copied for every seed
    hits = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("item_id", "item_n", "start")).alias("hits"))
    hits = materialize(hits, "hits")
    found = known.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    cut = f"transform(array({WORDS}), w -> transform(hits, h -> named_struct('item_id', h.item_id, 'start', h.start, 'extent', slice(w, greatest(h.start, 0) + 1, h.item_n))))[0]"
    found = found.select("doc_id", "text_hash", F.expr(f"inline_outer({cut})"))
    item_words = items.select("item_id", F.col("words").alias("item"))
    found = found.join(F.broadcast(item_words) if small else item_words, "item_id")
    agree = "transform(sequence(0, size(item) - 1), k -> int(get(extent, start - greatest(start, 0) + k) <=> item[k]))"
    width = f"least({window}, size(item))"
    best = f"array_max(transform(array({agree}), m -> array_max(transform(sequence(1, size(m) - {width} + 1), s -> aggregate(slice(m, s, {width}), 0, (t, x) -> t + x)))))"
    verified = found.select("doc_id", "text_hash", "item_id", F.expr(best).alias("matched"), F.expr(width).alias("of"), "start")
    verified = verified.where(F.col("matched") >= F.ceil(F.col("of") * F.lit(share) - F.lit(1e-9)))
    return (
        verified.groupBy("doc_id", "text_hash", "item_id", "of")
        .agg(F.max_by(F.struct("matched", "start"), F.struct("matched", -F.col("start"))).alias("b"))
        .select("doc_id", "text_hash", "item_id", F.col("b.matched").alias("matched"), "of", F.col("b.start").alias("start"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no benchmark item; see ``contaminated``.

    Columns may have any names.
    """
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = materialize(bad, "contaminated")
    return unwrapped(wrapped(docs).join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti"), docs)


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("of").cast("long").alias("of"), F.col("start").cast("long").alias("start"))
