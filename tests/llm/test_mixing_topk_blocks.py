"""Mixtures block by block, bounds on epochs, and top-k over many query blocks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing, topk


def test_a_tiny_source_is_not_repeated_without_bound(spark):
    docs = spark.createDataFrame([(i, "large", 10_000) for i in range(500)] + [(1000, "tiny", 1)], "doc_id long, source string, t long")
    with pytest.raises(ValueError, match="times"):
        mixing.mix(docs, F.col("t"), max_repeat=None, entropy=0.69).collect()


def test_every_epoch_shows_whole_blocks_up_to_the_budget(spark):
    r = random.Random(3)
    rows = [(i, s, r.randint(1, 400)) for i, s in enumerate(r.choices(("a", "b", "c"), (0.7, 0.25, 0.05), k=3000))]
    tokens = defaultdict(int)
    for _, s, t in rows:
        tokens[s] += t
    shown = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, t long"), F.col("t"), max_repeat=3.0).collect()
    wanted = {s: budget for s, (_, budget, _) in mixing.targets(tokens, max_repeat=3.0).items()}
    source_of, size_of = {i: s for i, s, _ in rows}, {i: t for i, _, t in rows}
    by_epoch = defaultdict(list)
    block_of = defaultdict(set)
    for x in shown:
        by_epoch[x.source, x.epoch].append(x.doc_id)
        block_of[x.doc_id].add(x.block)
        assert source_of[x.doc_id] == x.source and 0 <= x.place <= 1
    assert all(len(b) == 1 for b in block_of.values())  # a document is in one block
    for s, total in tokens.items():
        epochs = sorted(e for k, e in by_epoch if k == s)
        assert epochs == list(range(len(epochs)))
        for e in epochs[:-1]:  # all but the last epoch show every document once
            assert Counter(by_epoch[s, e]) == Counter(i for i, k, _ in rows if k == s)
        last = set(by_epoch[s, epochs[-1]])
        blocks = defaultdict(int)
        for i, k, t in rows:
            if k == s:
                blocks[next(iter(block_of[i]))] += t
        for b in {next(iter(block_of[i])) for i in last}:  # the last one whole blocks
            assert {i for i, k, _ in rows if k == s and block_of[i] == {b}} <= last
        gap = abs(sum(size_of[x.doc_id] for x in shown if x.source == s) - wanted[s])
        assert gap <= max(blocks.values()) / 2 + 1


def test_many_query_blocks_make_one_scan(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(-9, 9) for _ in range(5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, ints array<long>")
    one, many = (topk.search(df, F.col("vec_id") % 4 == 0, k=5, block=b) for b in (4096, 9))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert many._jdf.queryExecution().analyzed().toString().count("Relation") == 1
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for q in range(0, 400, 4):
        want = sorted(((-score(q, v), v) for v, _ in rows if v != q))[:5]
        assert [(-x.score, x.vec_id) for x in sorted(many.filter(F.col("query_id") == q).collect(), key=lambda x: x.rank)] == want if q % 80 == 0 else True


def test_records_with_bad_headers_and_large_frames(monkeypatch):
    import zstandard

    from quillspark.llm import warc

    record = warc.build_record(5, "http://a b/", b"<html>", None, False)
    assert warc.parse_record(record)[0] == 5
    changes = [(b"2024-01-01", b"2024-13-01"), (b"01T00", b"01 00"), (b"urn:uuid", b"urn:x"), (b"WARC-Target-URI: http://a%20b/\r\n", b""), (b"X-Page-ID: 5", b"X-Page-ID: 6"), (b"X-Payload-Length: 6", b"X-Payload-Length: x"), (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: md5:")]
    for old, new in changes:
        assert old in record
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(old, new))
    revisit = warc.build_record(7, None, b"x", 3, True)
    assert warc.parse_record(revisit)[4] == 3
    with pytest.raises(ValueError):
        warc.parse_record(revisit.replace(b"X-Refers-To-Page-ID: 3", b"X-Refers-To-Page-ID: 4"))
    for writer in (zstandard.ZstdCompressor(), zstandard.ZstdCompressor(write_content_size=False)):
        frame = writer.compress(b"a" * 100_000)
        assert warc.inflated(zstandard.ZstdDecompressor(), frame) == b"a" * 100_000
        with pytest.raises(ValueError, match="inflates"):
            warc.inflated(zstandard.ZstdDecompressor(), frame, 99_999)
    broken = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(bytes(range(256)) * 9))
    broken[20] ^= 1
    with pytest.raises(zstandard.ZstdError):
        warc.inflated(zstandard.ZstdDecompressor(), bytes(broken))
