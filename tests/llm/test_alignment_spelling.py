"""Token alignment, spelling variants and BPE with word ends, against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import align, spelling, wordbpe
from quillspark.llm.wordbpe import byte_characters

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [chr(c) for c in (*range(0x20, 0x7F), *[32] * 30, 9, 10, 13, 11, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0, 0x301, 0x308, 0x3A3, 0xDF, 0xAC00, 0x4E00, 0x4E8C, 0x1F600, 0x10400, 0xAD, 0xFB01)]
ODD += ["<|endoftext|>", "<|startoftext|>", "<|END", "<s>", "</s>", "<unk>", "<0x0A>", "  ", "    ", "====", "ing", "'LL", "\n\n"]


def odd_texts(n, seed=7):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) + ("▁" if i % 50 == 0 else "") for i in range(n)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, library):
    """The groups of a text, walked token by token over the whole encodings; none if bytes differ."""
    if not text:
        return []
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    first = library[0].encode(f" {text}", add_special_tokens=False)
    a = [bytes(byte_of[c] for c in t) for t in first.tokens]
    ids_a, ids = first.ids, library[1].encode(text)
    b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(library[1].id_to_piece, ids)]
    if not b"".join(a) == b"".join(b) == f" {text}".encode():
        return []
    out, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(a[i])
            left.append(ids_a[i])
            i += 1
        else:
            y += len(b[j])
            right.append(ids[j])
            j += 1
        if x == y and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def brute_alignment(docs, library):
    found = [(k, groups_of(t, library)) for k, t in docs]
    counts = Counter()
    for _, groups in found:
        counts.update({(p, q) for x, y in groups for p in x for q in y})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    rows = []
    for k, groups in found:
        links = [(p, q) for x, y in groups for p in x for q in y]
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        rows.append((k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), digest, sum(counts[z] == best[z[0]] for z in links), sum(counts[z] for z in links)))
    return sorted(rows)


def test_intervals_of_hand_made_tokens():
    a, b, closes = align.intervals(np.array([2, 5, 6]), np.array([1, 5, 6]))
    assert list(zip(a, b, closes)) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, True)]


def test_alignment_of_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()], library)
    assert sorted(map(tuple, align.op11(spark, "/root/testdata/sf0.001").collect())) == want
    assert sorted(map(tuple, align.align(docs, A, B, most=500).collect())) == want  # most pairs by the shuffle


def test_alignment_of_unusual_rows(spark, library, monkeypatch):
    docs = [(i, None if i % 97 == 0 else t) for i, t in enumerate(odd_texts(1500))]
    docs += [(9000, "=" * 70000), (9001, "一二" * 20000), (9002, "a b" * 1000 + " " * 5000 + "x"), (9003, "x "), (9004, " "), (9005, "same"), (9006, "same")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, n_links string")
    want = brute_alignment(docs, library)
    for most in (align.MOST, 100):
        assert sorted(map(tuple, align.align(df, A, B, most=most).collect())) == want
    assert align.align(df.limit(0), A, B).collect() == []
    twice = align.align(df.filter("doc_id = 9005").unionByName(df.filter("doc_id = 9005")), A, B).collect()
    assert len(twice) == 2 and all(r.count_sum == 2 * r.n_links for r in twice)
    spelled = {r.doc_id: r.groups for r in align.token_groups(df, A, B).collect()}
    assert all(hashlib.sha256(spelled[r[0]].encode()).hexdigest() == r[5] for r in want if r[5])


def test_alignment_in_slices_and_large_products(library, monkeypatch):
    monkeypatch.setattr(align, "SLICE", 50)
    monkeypatch.setattr(align, "PRODUCT", 2)
    monkeypatch.setattr(align, "KNOWN", 40)
    texts = odd_texts(300, seed=1)
    numbers, digests, sizes, pairs, times = align.Aligner(A, B).batch(texts, spell=True)
    ends = np.cumsum(sizes)
    for i, t in enumerate(texts):
        groups = groups_of(t, library)
        links = Counter(p * 32000 + q for x, y in groups for p in x for q in y)
        own = slice(ends[i] - sizes[i], ends[i])
        assert dict(zip(pairs[own].tolist(), times[own].tolist())) == links
        assert numbers[i].tolist() == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total()]
        assert digests[i] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def brute_variants(docs):
    counts = Counter()
    for k, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        x, y = sorted((x, y), key=len)
        i = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
        return x[i + (len(x) == len(y)) :] == y[i + 1 :]

    near = {w: [v for v in counts if v != w and one(v, w)] for w in counts}
    form = {}
    for w, own in near.items():
        top = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top and counts[top] >= 5 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items())


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_variants_against_all_pairs(spark):
    r = random.Random(5)
    docs = []
    for i in range(400):  # few letters, so that bigrams repeat within words and words meet in many ways
        base = "".join(r.choice("abé") for _ in range(r.randint(6, 9)))
        docs.append((i, " ".join([base] * r.choice((1, 5, 6, 30, 160, 800)))))
    docs += [(400, "Straße STRASSE straßen " * 9), (401, None), (402, ""), (None, "nullid " * 7), (403, "x" * 50000 + " " + "short " * 9), (403, "a×b÷cdé " * 8), (403, "a×b÷cdé " * 8)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs], "doc_id long, text string, word string")
    got = variant_rows(spelling.variants(df))
    assert got == brute_variants(docs)
    assert any(x[2] not in (x[0], x[1]) for x in got)  # a chain of forms
    assert spelling.variants(df.limit(0)).collect() == []


def test_variants_of_documents_equal_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.SQL})").fetchall()
    assert variant_rows(spelling.op12(spark, sf_dir)) == sorted(want)


@pytest.fixture(scope="module")
def word_bpe():
    return wordbpe.WordBpe(WORDS), Tokenizer.from_file(WORDS)


def ids_of(own, text):
    return own.ids([text])[0].tolist()


def test_word_bpe_equals_the_library(word_bpe, monkeypatch):
    own, library = word_bpe
    monkeypatch.setattr(wordbpe, "SLICE", 25)
    monkeypatch.setattr(wordbpe, "KNOWN", 500)
    r = random.Random(2)
    texts = odd_texts(5000) + ["".join(chr(r.choice((r.randrange(0xD800), r.randrange(0xE000, 0x30000), r.randrange(0x20, 0x250)))) for _ in range(20)) for _ in range(1500)]
    texts += ["Σίσυφος ΣΊΣΥΦΟΣ", "İstanbul", "ab" * 20000, "각" * 50, "ẹ́" * 30, "xqzj" * 300]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(own, text) == want
        assert own.decode(np.array(want, "<u4").tobytes()) == library.decode(want, skip_special_tokens=False)


def test_cuts_are_certain(word_bpe):
    own, _ = word_bpe
    assert own.cut.mean() > 0.9  # most pairs of bytes are in no token
    r = random.Random(3)
    for _ in range(300):
        word = bytes(r.choice(b"qxzjkvwaeiou\xc3\xa9") for _ in range(12))
        cuts = [i for i in range(1, 12) if own.cut[word[i - 1], word[i]]]
        parts = [own.merge(word[a:b], b == 12) for a, b in zip([0, *cuts], [*cuts, 12])]
        assert own.merge(word, True) == sum(parts, [])


def test_word_bpe_query_and_unusual_rows(spark, word_bpe):
    library = word_bpe[1]
    sf_dir = "/root/testdata/sf0.001"

    def digests(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, wordbpe.op13(spark, sf_dir).collect())) == sorted((r.doc_id, *digests(r.text)) for r in docs.collect())
    rows = [(1, None, 5), (2, "", 5), (3, "Twice <|endoftext|>", 5), (3, "Twice <|endoftext|>", 5), (4, "word " * 400000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = wordbpe.decode(wordbpe.encode(df, WORDS), WORDS).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(1, 0), (2, 0), (3, 2), (3, 2), (4, 400000)]
    assert {r.doc_id: r.decoded for r in out}[3] == "twice</w> <|endoftext|>"
    assert wordbpe.encode(df.limit(0), WORDS).collect() == [] and wordbpe.round_trip_digests(df.limit(0), WORDS).collect() == []
