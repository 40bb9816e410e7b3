"""SimHash near-duplicates, linked by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import components, discard, materialize, partitions, sent, table, unwrapped, wrapped

#: Fingerprints in a bucket from which it is linked through centres instead of pairs.
CROWDED = 64

#: Fingerprints of the similarity stage: segments of bits, of which each is looked up with its least certain bits flipped.
SEGMENTS, WIDTH, UNSURE = 9, 24, 7
BITS = SEGMENTS * WIDTH
#: Most differing bits of the 64 looked at in a bucket and of the complete fingerprint; similar sets stay below by over 2.5 deviations.
HEAD_FAR, FAR = 18, 47


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of ``text`` over shingles of ``words`` words, repeats included.

    Only A-Z are lower-cased and only ASCII white space parts words. A shorter
    text is one shingle; a text without words (or null) has fingerprint 0.
    """
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype=">u8")
    n = len(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the unpacked bits of a very long text
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for every row of ``docs``."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """All pairs needed to connect fingerprints at 2 or fewer differing bits.

    ``prints(fp)`` must be distinct. A fingerprint is two 32-bit segments; of
    two within distance 2, either the low segments agree or the high ones are
    within distance 1. So the tables of both segments are looked up with the
    exact segment and that of the high one also with its ball of radius 1
    (each pair only from the side that lacks the flipped bit), and complete
    distances are verified.

    A bucket with over ``CROWDED`` fingerprints would make pairs as its square.
    There each fingerprint goes to the 33 centres in the ball of radius 1
    around its other segment; those that share a centre (33 at most) are
    within distance 2, and two within distance 2 share one, so joining each to
    the centre's smallest keeps every connection. Returns ``a, b``.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    parts = prints.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(mask).alias("lo"))
    low_table = F.lit(1 << 32).cast("long")
    homes = parts.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.col("hi").alias("key"), F.col("lo").alias("rest")),
                F.struct(F.col("lo").bitwiseOR(low_table).alias("key"), F.col("hi").alias("rest")),
            )
        ).alias("h"),
    ).select("fp", "h.key", "h.rest")
    crowded = materialize(homes.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "crowded")
    flips = F.expr("transform(filter(sequence(0, 31), i -> getbit(hi, i) = 0), i -> hi | shiftleft(1L, i))")
    probes = parts.select("fp", "lo", F.explode(flips).alias("key"))

    busy = not crowded.isEmpty()
    calm_homes = homes.join(crowded, "key", "left_anti") if busy else homes
    asks = calm_homes.select("key", F.col("fp").alias("a"), F.lit(True).alias("same")).union(
        probes.select("key", F.col("fp").alias("a"), F.lit(False).alias("same"))
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    found = asks.join(calm_homes.select("key", F.col("fp").alias("b")), "key").where(near & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")
    if busy:
        ball = F.expr("array_union(array(rest), transform(sequence(0, 31), i -> rest ^ shiftleft(1L, i)))")
        around = homes.join(crowded, "key", "left_semi").select("fp", "key", F.explode(ball).alias("centre"))
        stars = (
            around.groupBy("key", "centre")
            .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
            .where(F.size("fps") > 1)
            .select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b"))
            .where((F.col("a") != F.col("b")) & near)
        )
        rest = F.expr("array_union(array(lo), transform(sequence(0, 31), i -> lo ^ shiftleft(1L, i)))")
        reach = (
            probes.join(crowded, "key", "left_semi")
            .select(F.col("fp").alias("a"), "key", F.explode(rest).alias("rest"))
            .select("a", F.shiftleft("key", 32).bitwiseOR(F.col("rest")).alias("b"))
        )
        reach = reach.join(prints.select(F.col("fp").alias("b")), "b").where(near).select("a", "b")
        found = found.union(stars).union(reach)
    return found


def near_groups(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Fingerprints link at 2 or fewer differing bits and components follow links
    through any number of steps; ``component_id`` is the smallest ``doc_id`` of
    the component (null if all its ids are null). Null and empty texts have
    fingerprint 0 and are linked like any other; repeated rows and ids stay
    apart as rows. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words, seed), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = components(links(nodes.select("fp")))
    rooted = nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialize(rooted.join(ids, "root").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def _sketch(text: str | None, words: int) -> tuple[int, int, list[int], list[int], np.ndarray]:
    """``node, head, segments, unsure, grams`` of a text's set of shingles.

    ``node`` names the set, ``head`` and ``segments`` are its SimHash of 64 and
    ``SEGMENTS`` times ``WIDTH`` bits, ``unsure`` has the ``UNSURE`` bits of
    each segment whose votes are closest to even, and ``grams`` the shingles'
    sorted 32-bit hashes.
    """
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.unique(np.array([digest(g, 42) for g in grams], dtype=np.uint64))
    node = xxhash.xxh64_intdigest(h.astype("<u8").tobytes()) if w else 0
    ones = np.zeros(64 + BITS, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounds the unpacked bits of a very long text
        part = h[at : at + (1 << 14)]
        mixed = [part]
        for k in range(1, 1 + -(-BITS // 64)):
            x = part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed.append(x ^ (x >> np.uint64(31)))
        octets = np.stack(mixed, axis=1).astype(">u8").view(np.uint8)
        ones += np.unpackbits(octets, axis=1)[:, : 64 + BITS].sum(axis=0, dtype=np.int64)
    up = ones * 2 > len(h)
    head = int.from_bytes(np.packbits(up[:64]).tobytes(), "big", signed=True)
    sides = up[64:].reshape(SEGMENTS, WIDTH)
    margin = np.abs(ones[64:] * 2 - len(h)).reshape(SEGMENTS, WIDTH)
    unsure = np.argsort(margin, axis=1, kind="stable")[:, :UNSURE].ravel().tolist()
    segments = (sides @ (1 << np.arange(WIDTH, dtype=np.int64))).tolist()
    return node - (node >> 63 << 64), head, segments, unsure, np.unique(h.astype(np.uint32)).view(np.int32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, h, node, head, segments, unsure, grams`` of each row of ``docs(doc_id, text, h)``; see ``_sketch``."""
    fields = [("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("head", pa.int64()), ("segments", pa.list_(pa.int32())), ("unsure", pa.list_(pa.int8())), ("grams", pa.list_(pa.int32()))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*(_sketch(t.as_py(), words) for t in part.column("text")), strict=True))
                columns = [part.column("doc_id"), part.column("h"), *(pa.array(c, t) for c, (_, t) in zip(found, fields[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = "doc_id long, h long, node long, head long, segments array<int>, unsure array<tinyint>, grams array<int>"
    return docs.select("doc_id", "text", "h").mapInArrow(run, schema)


def _similar(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose complete fingerprints are near and whose sets of shingles are as similar as asked for."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = prints.join(sent(wanted), "node").groupBy("node").agg(F.first(F.struct("segments", "grams")).alias("s"))
    sets = materialize(sets.select("node", "s.*"), "sets")
    sides = pairs
    for c in "ab":
        sides = sides.join(sets.select(F.col("node").alias(c), F.col("segments").alias(f"segments_{c}"), F.col("grams").alias(f"grams_{c}")), c)
    apart = F.expr("aggregate(zip_with(segments_a, segments_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    either = F.size("grams_a") + F.size("grams_b") - both
    out = materialize(sides.where((apart <= FAR) & (both >= similarity * either - 1e-9)).select("a", "b"), "similar")
    discard(wanted, sets)
    return out


def similar_components(prints: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of the sets of shingles in ``prints`` that are linked by similarities of ``similarity`` or more.

    Multi-index hashing: each segment is looked up by itself and by the small
    ball of its ``UNSURE`` neighbours, on both sides, so two bits of a segment
    may differ. Two sets at a similarity of 0.8 meet in one segment at least
    in over nine of ten cases, at 0.85 in 98 of 100.

    A bucket isn't expanded into pairs. First each of its sets meets the
    bucket's least; then those outside the bucket's most frequent component
    meet all of its sets that are of other components, which leaves out only
    pairs that are connected already. They meet with their complete
    fingerprints, so that of a crowd of less similar sets no pairs are made,
    and in a segment in which they agree under its own key only. What isn't
    needed any more is deleted.
    """
    nodes = materialize(prints.select("node", "head", "segments", "unsure").dropDuplicates(["node"]), "nodes")
    each = UNSURE + 1
    seg = f"cast(segments[cast(i div {each} as int)] as bigint)"
    bit = f"shiftleft(1L, cast(unsure[cast(i div {each} * {UNSURE} + i % {each} - 1 as int)] as int))"
    keys = F.expr(f"transform(sequence(0, {SEGMENTS * each - 1}), i -> shiftleft(i div {each}, {WIDTH}) | ({seg} ^ if(i % {each} = 0, 0L, {bit})))")
    posts = nodes.select("node", "head", F.explode(keys).alias("key"))
    bucket = Window.partitionBy("key")
    posts = posts.select("key", "node", "head", F.first(F.struct("node", "head")).over(bucket.orderBy("node")).alias("least"), F.count("*").over(bucket).alias("n"))
    posts = materialize(posts.where("n > 1").select("key", "node", "head", F.col("least.node").alias("least"), F.col("least.head").alias("least_head"), "n"), "buckets")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= HEAD_FAR
    stars = posts.where((F.col("node") != F.col("least")) & near("head", "least_head")).select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    stars = materialize(stars, "stars")
    found = _similar(stars, prints, similarity)
    linked = components(found)
    comp = materialize(linked, "comp")
    discard(linked)
    members = posts.where("n > 2").select("key", "node", "head").join(sent(comp.withColumnRenamed("node", "_node")), F.col("node") == F.col("_node"), "left")
    members = members.select("key", "node", "head", F.coalesce("root", "node").alias("root")).repartition(partitions(prints.sparkSession), "key")
    members = members.withColumn("size", F.count("*").over(Window.partitionBy("key", "root")))
    main, least, most = (f(c).over(Window.partitionBy("key")).alias(n) for f, c, n in ((F.max, F.struct("size", "root"), "main"), (F.min, "root", "least"), (F.max, "root", "most")))
    open_ = materialize(members.select("key", "node", "head", "root", main, least, most).where("least <> most").select("key", "node", "head", "root", F.col("main.root").alias("main")), "open")
    discard(stars, posts)
    pairs_of_segments = [f"shiftleft(cast(segments[{n}] as bigint), {WIDTH})" + (f" | segments[{n + 1}]" if n + 1 < SEGMENTS else "") for n in range(0, SEGMENTS, 2)]
    wide = nodes.select(F.col("node").alias("_node"), "segments", *[F.expr(x).alias(f"f{n}") for n, x in enumerate(pairs_of_segments)])
    full = open_.join(sent(wide), F.col("node") == F.col("_node"))
    full = materialize(full.select("key", "node", "head", "root", "main", F.expr(f"cast(segments[cast(shiftright(key, {WIDTH}) as int)] as bigint)").alias("own"), *[f"f{n}" for n in range(len(pairs_of_segments))]), "full")
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in full.columns if x not in ("key", "node")]
    one, all_ = full.where("root <> main").select("key", F.col("node").alias("a"), *side("a")), full.select("key", F.col("node").alias("b"), *side("b"))
    apart = F.expr(" + ".join(f"bit_count(f{n}_a ^ f{n}_b)" for n in range(len(pairs_of_segments))))
    once = ((F.col("root_b") == F.col("main_b")) | (F.col("a") > F.col("b"))) & ((F.col("own_a") != F.col("own_b")) | (F.expr(f"key & {(1 << WIDTH) - 1}L") == F.col("own_a")))
    rest = one.join(all_.hint("merge"), "key").where((F.col("root_a") != F.col("root_b")) & once & near("head_a", "head_b") & (apart <= FAR))
    rest = materialize(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "rest")
    discard(nodes, open_, full)
    if rest.isEmpty():
        discard(found, rest)
        return comp
    more = _similar(rest, prints, similarity)
    linked = components(found.union(more))
    out = materialize(linked, "comp")
    discard(linked, found, comp, rest, more)
    return out


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, less those that repeat another.

    Two texts are near copies if the Jaccard similarity of their sets of
    shingles of ``words`` words is ``similarity`` or more (words as in
    ``fingerprint``); groups follow near copies through any number of steps.
    Candidates are found by SimHash, see ``similar_components``; the sets'
    similarity then decides. Texts with equal sets, and texts without words
    (or null), are always found.

    Of each group the row with the smallest ``doc_id`` stays (nulls last), of
    rows with that id the one with the smallest text hash, and one of rows that
    agree in both. Columns may have any names.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("h", F.xxhash64("text"))
    prints = materialize(sketches(texts, words), "prints")
    comp = similar_components(prints, similarity)
    rows = prints.select("doc_id", "h", F.col("node").alias("fp")).join(comp, F.col("fp") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "fp").alias("root"))
    rows = materialize(rows.groupBy("doc_id", "h", "root").count(), "rooted")
    discard(prints, comp)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("best"))
    best = materialize(best, "best")  # a plain table, so that skew in the join can be split
    judged = rows.join(best, "root").withColumn("stays", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.h") == F.col("h")))
    judged = materialize(judged.where("not stays or count > 1").select(F.col("doc_id").alias("of_id"), F.col("h").alias("of_hash"), "stays"), "judged")
    discard(rows, best)
    given, same = wrapped(docs), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash"))
    kept = given.join(judged, same, "left_anti")
    again = given.join(judged.where("stays"), same).select(*given.columns).groupBy("id", "hash").agg(F.any_value("given").alias("given"))
    return unwrapped(kept.select("given").union(again.select("given")), docs)


def simhash_query(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
