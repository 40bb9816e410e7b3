"""Alignment, resampling and packing against brute force, with the cases of their docstrings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm.alignment import aligned, grouped, link_counts, union_find, with_counts
from cairn.llm.packing import pack, packing_query, pieces_of, sequences, shelf_sizes
from cairn.llm.queries import QUERIES
from cairn.llm.resampling import crc32_of, resample, resampled
from cairn.llm.tokens import Texts, byte_bpe, sentence_pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "  x  y\n z  \n", " a", "a ", "a  \n b\x1c c\x85 d 　 e", "é é\xa0 é é ", "日本語 の 文 🙂🙂 x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "<s> x</s> <unk> <0x41>", "a ▁b", "x\x00y\tz", "don't we'll I'M", "word " * 3000, "y" * 5000, "same text twice", "same text twice",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "clash") for i, t in enumerate(ODD)] + [(None, "no id here", 1, "clash"), (18, "same text twice", 2, None)]
    return spark.createDataFrame(rows, "doc_id int, text string, n_a int, links string")


@pytest.fixture(scope="module")
def encode():
    plain, literal = Tokenizer.from_file(A), Tokenizer.from_file(A)
    literal.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    return lambda t: plain.encode(t, add_special_tokens=False).ids, lambda t: literal.encode(f" {t}", add_special_tokens=False).ids, pieces.encode


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'1. \n\t\x85\xa0 　é日🙂!"), max_size=40), min_size=1, max_size=4))
def test_units_give_the_ids_of_whole_texts(encode, texts):
    flat, counts = Texts(A).ids(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [encode[0](t) for t in texts]


def test_every_character_gives_the_same_ids(encode):
    texts = [f"a{c}1{c}! {c}  {c}a" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)])]
    flat, counts = Texts(A).ids(pa.array(texts))
    want = Tokenizer.from_file(A).encode_batch_fast(texts, add_special_tokens=False)
    assert flat.tolist() == [i for e in want for i in e.ids] and len(counts) == len(texts)


@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))))
def test_union_find(case):
    n, edges = case
    least = list(range(n))
    for _ in range(n):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    u, v = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
    assert union_find(n, u, v).tolist() == least


@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.lists(st.integers(1, 5), min_size=1, max_size=20))
def test_components_are_the_minimal_groups(a, b):
    more = sum(a) - sum(b)
    a, b = (a, [*b, more]) if more > 0 else ([*a, -more], b) if more < 0 else (a, b)
    a_group, b_group, u, v = grouped(np.array(a), np.array(b))
    a_ends, b_ends = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    common = sorted({*a_ends} & {*b_ends})
    assert a_group.tolist() == [sum(c < e for c in common) for e in a_ends]
    assert b_group.tolist() == [sum(c < e for c in common) for e in b_ends]
    assert sorted(zip(u.tolist(), v.tolist())) == [(i, j) for i, x in enumerate(a_ends) for j, y in enumerate(b_ends) if x == y]


def aligned_by_hand(rows, encode):
    content_a, content_b = byte_bpe(A)[1], sentence_pieces(B)[1]
    out, links = [], []
    for doc, text in rows:
        a, b = (encode[1](text), encode[2](text)) if text else ([], [])
        spelt = f" {text}".encode()
        if b"".join(content_a[i] for i in a) != spelt or b"".join(content_b[i] for i in b) != spelt:
            a, b = [], []
        ends = [np.cumsum([len(c[i]) for i in ids]).tolist() for c, ids in ((content_a, a), (content_b, b))]
        groups, low = [], 0
        for c in sorted({*ends[0]} & {*ends[1]}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es) if low < e <= c) for ids, es in zip((a, b), ends)))
            low = c
        at = dict(zip(ends[1], b))
        links.append([(i, at[e]) for i, e in zip(a, ends[0]) if e in at])
        text_of = ";".join(groups)
        out.append((doc, len(a), len(b), len(groups), hashlib.sha256(text_of.encode()).hexdigest() if text_of else "", len(links[-1]), text_of))
    n = Counter(x for one in links for x in one)
    most = defaultdict(int)
    for (_, j), k in n.items():
        most[j] = max(most[j], k)
    return [(*o[:6], sum(n[x] == most[x[1]] for x in one), sum(n[x] for x in one), o[6]) for o, one in zip(out, links)]


def test_alignment_of_odd_texts(spark, docs, encode):
    want = aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()], encode)
    rows = aligned(docs, A, B)
    got = with_counts(rows, link_counts(rows, A, B), A, B).select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*w[:4], w[8], *w[5:8])) for w in want)
    assert not aligned(docs.limit(0), A, B).collect()


def test_alignment_query(spark, sf_dir, encode):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, sf_dir).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(w[:8]) for w in aligned_by_hand(rows, encode))


@given(st.lists(st.binary(max_size=80), max_size=12))
def test_crc32_of_slices(parts):
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    assert crc32_of(data, np.cumsum(sizes) - sizes, sizes).tolist() == [zlib.crc32(p) for p in parts]


def resampled_by_hand(rows, target, share, least, runs, buckets=10_000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def counts(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1))

    docs = [(d, *counts(t)) for d, t in rows]
    s = sum((c for _, _, c in docs), Counter())
    t = sum((counts(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    scored = []
    for d, n, c in docs:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] * k for b, k in c.items())
        scored.append((d, n, c.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))[: share * sum(x[1] >= least for x in scored) // 100]
    ranks = {id(x): i + 1 for i, x in enumerate(fit)}
    return [(x[0], *x[2:], ranks.get(id(x))) for x in scored]


@pytest.mark.parametrize(("runs", "share", "least"), [(1, 10, 20), (3, 50, 2)])
def test_resampling(spark, docs, sf_dir, runs, share, least):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs.selectExpr("doc_id + 1000", "text"))
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").union(docs.select("text"))
    want = resampled_by_hand([tuple(r) for r in rows.collect()], [r.text for r in target.collect()], share, least, runs)
    got = resample(rows, target, share=share, least=least, runs=runs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_blocks_of_counts_are_small(spark):
    from cairn.llm.resampling import ENTRIES, column_sums, count_matrix, row_weights

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 30, 900, 60_000]))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    matrix = count_matrix(docs)
    sizes = matrix.selectExpr("size(ids) AS n", "size(indices) AS m", "element_at(indptr, -1) AS last", "size(indptr) AS p", "size(words) AS w").collect()
    assert sum(r.n for r in sizes) == 160 and len(sizes) > 5 and all(r.m == r.last and r.p == r.n + 1 and r.w == r.n and (r.m <= ENTRIES or r.n == 1) for r in sizes)
    gains = spark.range(10_000).selectExpr("id AS bucket", "id % 7 - 3 AS gain")
    want = {n: (len(t.split()), sum(zlib.crc32(w.encode()) % 10_000 % 7 - 3 for w in t.split())) for n, t in enumerate(texts)}
    assert {r.doc_id: (r.n_features, r.weight) for r in row_weights(matrix, gains).collect()} == want
    assert column_sums(matrix).agg({"n": "sum"}).first()[0] == sum(n for n, _ in want.values())


def test_resampled_rows_keep_their_columns(spark, docs):
    target = docs.select("text")
    got = resampled(docs, target, share=100, least=3)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} >= {16, 18, 19, None}
    assert not resample(docs.limit(0), target).collect()
    assert {r.weight for r in resample(docs, target.limit(0)).collect()} != {None}


def test_pieces_of_a_document():
    for capacity in (64, 1024):
        sizes = set(shelf_sizes(capacity).tolist())
        for n in [*range(1, 3 * capacity), 10**6]:
            pieces = pieces_of(n, capacity)
            assert sum(pieces) == n and max(pieces) <= capacity
            assert all(p in sizes for p in pieces[:-1])  # but for the last, all fill their share of a bin


def checked(pieces, docs, encode, capacity, most_padding):
    ids = defaultdict(dict)
    bins = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        bins[p.sequence_id].append((p.offset, p.length))
        ids[(p.doc_id, p.doc_tokens)].setdefault(p.start, []).append(np.frombuffer(p.ids, "<u4").tolist())
    padding = 0
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *np.cumsum([n for _, n in b])[:-1]]
        n = sum(n for _, n in b)
        assert 0 < n <= capacity
        padding += 0 if n.bit_count() == 1 else capacity - n
    assert padding <= most_padding * sum(p.length for p in pieces)
    want = Counter((d, tuple([*encode[0](t or ""), 0])) for d, t in docs)
    got = Counter()
    for (doc, total), parts in ids.items():
        n = {len(x) for x in parts.values()}
        assert len(n) == 1  # repeated rows are cut alike
        whole = tuple(i for s in sorted(parts) for i in parts[s][0])
        assert len(whole) == total
        got[(doc, whole)] += n.pop()
    assert got == want


def test_packing_of_odd_texts(spark, docs, encode):
    # repeated ids with unlike texts of one length, and rows that are cut again at a task's end, have no place in this check
    rows = docs.where("text <> 'same text twice' OR text IS NULL")
    for capacity in (1024, 64):
        pieces = pack(rows.repartition(3), A, capacity)
        checked(pieces.collect(), [(r.doc_id, r.text) for r in rows.collect()], encode, capacity, 0.02)
    twice = pack(docs.where("text = 'same text twice'").coalesce(1), A).collect()
    assert sum(p.length for p in twice) == 3 * 4 and len({(p.sequence_id, p.offset) for p in twice}) == len(twice)
    assert not pack(docs.limit(0), A).collect()


def test_packing_query(spark, sf_dir, encode):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), A).collect()
    checked(pieces, rows, encode, 1024, 0.01)
    got = packing_query(spark, sf_dir).collect()
    assert sorted((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.sequence_id, p.offset) for p in pieces) == sorted(tuple(r) for r in got)


def test_sequences(spark, docs):
    pieces = pack(docs, A, 64).persist()
    of = defaultdict(list)
    for p in sorted(pieces.collect(), key=lambda p: p.offset):
        of[p.sequence_id].append(p)
    rows = sequences(pieces, 64, 9).collect()
    assert len(rows) == len(of)
    for r in rows:
        whole = b"".join(p.ids for p in of[r.sequence_id])
        assert r.docs == [p.doc_id for p in of[r.sequence_id]] and r.starts == [p.offset for p in of[r.sequence_id]]
        n = len(whole) // 4
        assert r.n_tokens == n and bytes(r.ids) == whole + (b"" if n.bit_count() == 1 else (9).to_bytes(4, "little") * (64 - n))
    pieces.unpersist()
