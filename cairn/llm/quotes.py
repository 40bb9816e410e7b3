"""Chat formatting: quoted passages linked to the messages they come from."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, running_totals, table

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
LEAD = re.compile(r"^(?:on .*(?:wrote|said)|am .*schrieb .*|le .*a écrit|el .*escribió) ?:$", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of the shortest sentences by which a part of a line is told.
TELLING = 3
JUNK = re.compile(r"[^\w]+")


def normal(text: str) -> str:
    """Letters, digits and single spaces only, in lower case; what quoting changes is gone."""
    return JUNK.sub(" ", text.lower()).strip()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and its quoted passages as ``(level, passage)``.

    A passage is a run of lines at one nesting level, without its marks. Lines
    that only introduce a quote ("On Monday X wrote:") go with it. Passages
    without a letter or digit are quotes of nothing and left out.
    """
    kept: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        now = m[1].count(">") if m else 0
        if now:
            if not level and kept and LEAD.match(kept[-1].strip()):
                kept.pop()
            body = line[m.end() :]
            if now != level:
                quotes.append((now, [body]))
            else:
                quotes[-1][1].append(body)
        else:
            kept.append(line)
        level = now
    passages = [(n, "\n".join(lines)) for n, lines in quotes]
    own = "\n".join(kept).strip("\n") if quotes else text or ""
    return own, [(n, p) for n, p in passages if normal(p)]


def _hash(words: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(words.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _hashed(text: str) -> list[int]:
    """Hashes of the text as a whole, its paragraphs, its lines and its sentences, each once."""
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return list(dict.fromkeys([*(_hash(n) for n in map(normal, parts) if n), *_sentences(text)]))


def _sentences(text: str) -> list[int]:
    """Hashes of the sentences of ``TELLING`` words or more, wherever lines break."""
    return [_hash(n) for n in map(normal, SENTENCE.split(text)) if n.count(" ") >= TELLING - 1]


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with its own text, quotes and the hashes by which others may quote it."""
    quote = pa.struct([("level", pa.int32()), ("whole", pa.int64()), ("lines", pa.list_(pa.int64()))])
    arrow = pa.schema([("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("own", pa.string()), ("quotes", pa.list_(quote)), ("parts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own, quotes = parse(text)
                found = [{"level": n, "whole": _hash(normal(p)), "lines": [*(_hash(x) for x in map(normal, p.split("\n")) if x), *_sentences(p)]} for n, p in quotes]
                rows.append({"conv_id": conv, "turn": turn, "role": role, "own": own, "quotes": found, "parts": _hashed(own)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    schema = "conv_id long, turn int, role string, own string, quotes array<struct<level:int,whole:long,lines:array<long>>>, parts array<long>"
    given = messages.select(messages["conv_id"].cast("long"), messages["turn"].cast("int"), messages["role"].cast("string"), messages["text"].cast("string"))
    return given.mapInArrow(run, schema)


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, linked to what it replies to, in reply order.

    Returns ``conv_id, turn, role, text, n_quotes, n_linked, reply_conv,
    reply_turn, thread_turn, depth, position`` for every row of ``messages``.

    A quoted passage (or, if that is unknown, its first known line, or else its
    first known sentence of ``TELLING`` words or more) is linked
    by the hash of its normalised text to the messages of the same conversation
    that say it in their own words: to the last of them before the quoting
    turn, or else to the first message of any conversation that does, by
    (conv_id, turn). The first quote of the outermost level that is linked
    within the conversation is what the message replies to; without one it
    begins a thread. ``thread_turn`` is its thread's first turn, ``depth`` the
    number of replies from there, and ``position`` counts the conversation's
    messages thread by thread, in turn order within.

    Links go only to earlier turns, so there are no rings. Null texts count as
    empty; rows with a null conversation or turn are kept but link to nothing;
    rows that share conversation and turn share their links and stay apart;
    an empty table gives an empty result.
    """
    base = materialize(parsed(messages), "messages")
    said = base.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("parts").alias("hash"))
    asks = base.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("quotes").alias("nth", "q"))
    asks = asks.select("conv_id", "turn", "nth", "q.level", F.posexplode(F.concat(F.array("q.whole"), "q.lines")).alias("part", "hash")).distinct()
    asks = materialize(asks, "asks")

    there = materialize(said.join(asks.select("hash").distinct(), "hash", "left_semi").distinct(), "said")
    # in turn order, quotes before what is said at their own turn, the largest turn said so far is the one quoted
    both = asks.withColumn("saying", F.lit(-1).cast("long")).unionByName(there.withColumn("saying", F.col("turn").cast("long")), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_last() for c in ("hash", "conv_id", "turn", "saying", "nth", "part")]
    near = running_totals(both, ["hash", "conv_id"], order, "saying", "to_turn", largest=True).where("nth is not null and to_turn >= 0")
    near = near.select(*asks.columns, F.col("conv_id").alias("to_conv"), F.col("to_turn").cast("int").alias("to_turn"))
    first = there.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    far = asks.join(first, "hash").where("first.conv_id <> conv_id").select(*asks.columns, F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"))
    found = near.withColumn("near", F.lit(0)).union(far.withColumn("near", F.lit(1)))
    linked = found.groupBy("conv_id", "turn", "nth", "level").agg(F.min(F.struct("near", "part", "to_conv", "to_turn")).alias("to"))
    # what a message replies to: its own conversation first, then the outermost level, then the first quote
    replies = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("to.near", "level", "nth", "to.to_conv", "to.to_turn")).alias("r"))
    replies = materialize(
        replies.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "n_linked", F.col("r.to_conv").alias("reply_conv"), F.col("r.to_turn").alias("reply_turn"), (F.col("r.near") == 0).alias("inside")), "replies"
    )
    # pointers double until all stand on the first turn of their thread
    ways = replies.where("inside").select(F.col("_conv").alias("conv"), F.col("_turn").alias("at"), F.col("reply_turn").alias("up"), F.lit(1).alias("steps"))
    while True:
        ways = materialize(ways, "ways")
        ahead = ways.select(F.col("conv").alias("c"), F.col("at").alias("t"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = ways.join(ahead, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        if joined.where("next is not null").isEmpty():
            break
        ways = joined.select("conv", "at", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    out = base.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").alias("n_quotes"))
    out = out.join(replies.drop("inside"), (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left").drop("_conv", "_turn")
    out = out.join(ways, (F.col("conv_id") == F.col("conv")) & (F.col("turn") == F.col("at")), "left")
    out = out.select(
        "conv_id", "turn", "role", "text", F.col("n_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn",
        F.coalesce("up", "turn").alias("thread_turn"), F.coalesce("steps", F.lit(0)).alias("depth"), F.lit(1).cast("long").alias("_one"),
    )
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "thread_turn", "turn", "role", "text")]
    return running_totals(out, ["conv_id"], order, "_one", "position").drop("_one")


def quotes_query(spark, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
