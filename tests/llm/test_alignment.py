"""Cross-tokenizer alignment against a plain walk over both token lists."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest

from trustgrain.llm import alignment, queries
from trustgrain.llm.packing import BytePairs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    of_char = {c: x for x, c in BytePairs._byte_characters().items()}
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        vocabulary = {i: t for t, i in json.load(f)["model"]["vocab"].items()}

    def bytes_a(i):
        return bytes(of_char[c] for c in vocabulary[i])

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(f" {t}", add_special_tokens=False).ids, b.encode, bytes_a, bytes_b


def plain(docs, encoders):
    encode_a, encode_b, bytes_a, bytes_b = encoders
    rows, every = [], []
    for i, text in docs:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        whole = f" {text}".encode()
        if not text or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            rows.append((i, 0, 0, 0, ""))
            every.append([])
            continue
        x, y, links, groups, own_a, own_b = 0, 0, [], [], [a[0]], [b[0]]
        end_a, end_b = len(bytes_a(a[0])), len(bytes_b(b[0]))
        while True:
            links.append((a[x], b[y]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                own_a, own_b = [], []
            if step_a:
                x += 1
            if step_b:
                y += 1
            if x == len(a) and y == len(b):
                break
            if step_a:
                end_a += len(bytes_a(a[x]))
                own_a.append(a[x])
            if step_b:
                end_b += len(bytes_b(b[y]))
                own_b.append(b[y])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((i, len(a), len(b), len(groups), digest))
        every.append(links)
    held = Counter(pair for links in every for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (i, a, b, g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), digest)
        for (i, a, b, g, digest), ls in zip(rows, every, strict=True)
    ]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def test_every_document(spark, encoders):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = ordered(tuple(r) for r in queries.op12_alignment(spark, FOLDER).collect())
    assert got == ordered(plain(docs, encoders))
    assert sum(r[1] for r in got) > 10_000


def test_odd_rows(odd_docs, no_docs, encoders):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    args = (queries.TOKENIZER, queries.PATTERN, queries.PIECES)
    assert ordered(tuple(r) for r in alignment.align_tokens(odd_docs, *args).collect()) == ordered(plain(docs, encoders))
    assert alignment.align_tokens(no_docs, *args).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 40").coalesce(1)
    both = alignment.Tokenizers(queries.TOKENIZER, queries.PATTERN, queries.PIECES)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    whole = alignment.align_block(texts, both)[0]
    each = [alignment.align_block([t], both)[0] for t in texts]
    for column in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
        assert list(whole[column]) == [e[column][0] for e in each]


def test_long_texts_are_cut_where_it_is_exact(encoders):
    both = alignment.Tokenizers(queries.TOKENIZER, queries.PATTERN, queries.PIECES)
    assert both.cuts
    text = "It's 12 words, l'été don't  stop or go\n\n" * 400 + "x" * 3000 + " end of it " * 300
    parts = alignment.parts_of(f" {text}", 500)
    assert len(parts) > 20 and "".join(parts) == f" {text}"
    a = [i for p in parts for i in both.a.ids(p, special=False).tolist()]
    assert a == encoders[0](text)
    assert [i for p in parts for i in both.b.encode(p[1:])] == encoders[1](text)


def test_gallop_and_align():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = rng.integers(0, 400), rng.integers(0, 4000)
        keys = np.unique(rng.integers(0, rng.integers(2, 9000), n))
        values = np.unique(rng.integers(0, rng.integers(2, 9000), m))
        assert (alignment.gallop(keys, values) == np.searchsorted(values, keys)).all()
    for _ in range(200):
        end = int(rng.integers(1, 200))
        a, b = (np.union1d(rng.integers(1, end + 1, rng.integers(0, 150)), [end]) for _ in range(2))
        found = alignment.align(a, b)
        start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if start_a[i] < b[j] and start_b[j] < a[i]]
        assert sorted(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == want
        common = np.intersect1d(a, b)
        assert (found.group_a == np.searchsorted(common, a)).all() and (found.group_b == np.searchsorted(common, b)).all()
