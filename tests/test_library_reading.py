"""The library's generations, cursor reading, chunks, and sequential kernels over sorted partitions."""

import random
import uuid

import pytest

from quillspark.operators import reading, spans
from quillspark.operators.library import Library
from quillspark.storage import names, shared_dir
from quillspark.streaming import sessions


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(own, spark, query, top=8):
    return [(r.doc_id, r.mode) for r in own.search(spark.createDataFrame([(1, query)], "query_id long, query string"), top).orderBy("rank").collect()]


def test_library_generations(spark):
    own = Library(spark, shared_dir(spark, "library"))
    assert found(own, spark, "apple") == [] and own.status().collect()[0].documents == 0
    assert own.add(texts(spark, [(1, "apple tree"), (2, "apple apple pie"), (3, None), (4, "")])) == {"added": 3, "changed": 0, "unchanged": 0, "failed": 1}
    assert found(own, spark, "apple") == [(2, "lexical"), (1, "lexical")]
    assert own.add(texts(spark, [(1, "apple tree"), (2, "pear")])) == {"added": 0, "changed": 1, "unchanged": 1, "failed": 0}
    assert found(own, spark, "apple") == [(1, "lexical")] and found(own, spark, "pear") == [(2, "lexical")]
    own.remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert found(own, spark, "apple") == []
    own.add(texts(spark, [(1, "apple again")]))  # after its removal it is new
    assert found(own, spark, "apple tree") == [(1, "lexical")]
    before = own.status().collect()[0]
    own.merge()
    after = own.status().collect()[0]
    assert (before.documents, before.terms) == (after.documents, after.terms) == (3, 3) and (after.segments, after.tombstones) == (1, 0)
    own.clean()
    assert found(own, spark, "apple tree") == [(1, "lexical")] and len([x for x in names(spark, own.path) if x.startswith("segment")]) == 1
    with pytest.raises(ValueError):
        own.remove_missing(spark.createDataFrame([], "doc_id long"), complete=False)
    own.remove_missing(spark.createDataFrame([(2,)], "doc_id long"), complete=True)
    assert [r.doc_id for r in own.documents().collect()] == [2]
    with pytest.raises(ValueError):
        own.add(texts(spark, [(9, "a"), (9, "b")]))


def test_library_versions_and_broken_changes(spark, monkeypatch):
    own = Library(spark, shared_dir(spark, "library"))
    own.add(texts(spark, [(1, "one " * 9000), (2, "two")]))
    digest = {r.doc_id: r.digest for r in own.documents().collect()}
    asked = spark.createDataFrame([(1, digest[1]), (2, "other"), (7, "x")], "doc_id long, digest string")
    assert {r.doc_id if r.doc_id else 7: (r.status, r.text and len(r.text), r.more) for r in own.read(asked).collect()} == {1: ("ok", 12000, True), 2: ("stale", None, False), 7: ("source_unavailable", None, None)}

    def lost(*_, **__):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Library, "_publish", lost)
        with pytest.raises(RuntimeError):
            own.add(texts(spark, [(2, "changed"), (3, "three")]))
    assert found(own, spark, "changed three") == [] and found(own, spark, "two") == [(2, "lexical")]
    stale = own._state()
    own.add(texts(spark, [(5, "five")]))
    with pytest.raises(Exception, match="(?i)exist"):  # the second of two changes made at once
        own._publish(stale, segments=[])
    assert found(own, spark, "five") == [(5, "lexical")]
    own.clean()


def test_search_equals_brute_force(spark):
    import math

    r = random.Random(4)
    docs = [(i, " ".join(r.choice(("a1", "b2", "c3", "d4", "合计", "表")) for _ in range(r.randint(0, 12)))) for i in range(60)]
    own = Library(spark, shared_dir(spark, "library"))
    own.add(texts(spark, docs[:30]))
    own.add(texts(spark, docs[20:]))
    terms = {i: [w for w in t.split() if w != "表"] for i, t in docs}
    mean = sum(map(len, terms.values())) / len(terms)
    query = ["b2", "合计"]
    scores = []
    for i, own_terms in terms.items():
        score = 0.0
        for q in query:
            df, tf = sum(q in t for t in terms.values()), own_terms.count(q)
            score += math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own_terms) / mean))
        if score:
            scores.append((-round(score, 9), i))
    assert [x for x, _ in found(own, spark, "B2 合计 b2", 20)] == [i for _, i in sorted(scores)[:20]]


def test_reading_to_the_end_gives_the_text_back(spark):
    r = random.Random(9)
    rows = [(d, p, o, "".join(r.choice("abcé字😀") for _ in range(r.choice((0, 1, 7, 40))))) for d in range(5) for p in range(3) for o in range(4)] + [(5, 1, 1, None), (6, 1, 1, "x" * 95)]
    blocks = spark.createDataFrame(rows, "document_id long, page long, ord long, text string")
    whole = {d: "".join(t or "" for e, _, _, t in sorted(rows, key=lambda x: x[:3]) if e == d) for d in range(7)}
    at, got, n = {d: None for d in range(7)}, {d: "" for d in range(7)}, 0
    while at:
        read = reading.read_on(blocks, spark.createDataFrame(list(at.items()), "document_id long, cursor string"), 20).collect()
        for d in list(at):
            own = sorted((x for x in read if x.document_id == d), key=lambda x: (x.page, x.ord))
            assert sum(len(x.text) for x in own) <= 20
            got[d] += "".join(x.text for x in own)
            at[d] = own[0].cursor if own else None
            if at[d] is None:
                del at[d]
        n += 1
    assert got == whole and n > 3
    pieces = reading.all_reads(blocks, 20).collect()
    for d, text in whole.items():
        own = sorted((x for x in pieces if x.document_id == d), key=lambda x: (x.page, x.ord, x.first))
        assert "".join(x.text for x in own) == text and all(sum(len(y.text) for y in own if y.read == k) == 20 for k in {x.read for x in own if x.read < len(text) // 20})
    with pytest.raises(ValueError):
        reading.read_on(blocks, spark.createDataFrame([], "document_id long, cursor string"), 40_000)


def test_chunks_keep_numbers_tables_and_all_tokens(spark):
    r = random.Random(3)
    rows = []
    for d in range(8):
        o = 0
        for _ in range(r.randint(1, 5)):
            rows.append((d, 1, (o := o + 1), "heading", f"Part {o}"))
            for _ in range(r.randint(0, 3)):
                rows.append((d, 1, (o := o + 1), "paragraph", " ".join(r.choice(("word", "合计表格", "12 345 678,90", "1,234.5%", "x")) for _ in range(r.randint(0, 60)))))
            rows.append((d, 1, (o := o + 1), "table_header", "name | amount"))
            rows += [(d, 1, (o := o + 1), "table_row", f"row{k} 9,{k:03d}") for k in range(r.randint(0, 9))]
    rows.append((99, 1, 1, None, None))
    blocks = spark.createDataFrame(rows, "document_id long, page long, ord long, kind string, text string")
    found = [tuple(x) for x in reading.chunks(blocks, 12, 3).collect()]
    for d in range(8):
        own = sorted(x for x in found if x[0] == d)
        assert [x[1] for x in own] == list(range(len(own)))
        tokens = [reading.TOKEN.findall(x[5]) for x in own]
        assert all(x[4] == len(t) <= 12 for x, t in zip(own, tokens))
        want = [t for row in sorted(rows[:-1]) if row[0] == d for t in reading.TOKEN.findall(row[4])]
        assert set(want) == {t for own_tokens in tokens for t in own_tokens}  # a cut number would be another token
        for x in own:
            lines = x[5].split("\n")
            assert not lines[0].startswith("row")  # the header stands before rows
            assert not any(line.startswith("Part ") for line in lines[1:])
    assert [x for x in found if x[0] == 99] == [] and reading.chunks(blocks.limit(0)).collect() == []


def brute_match(gold, engine):
    """The best offer left, time and again, over all pairs of a page."""
    claims, done, out = {}, set(), []
    while True:
        best = None
        for g, want in gold:
            for e, have in engine:
                if g in done or not want or not have:
                    continue
                left = list(have)
                for a, b in claims.get(e, []):
                    left[a:b] = "\0" * (b - a)
                block = spans.Block(have)
                for a, b in claims.get(e, []):
                    block.claim(a, b)
                o = spans.span_search(spans._codes(want), block.codes)
                if o[0] > spans.ACCEPT * len(want) or any(a < o[2] and o[1] < b for a, b in claims.get(e, [])):
                    continue
                rank = (len(want) < spans.LONG, o[0] / len(want), True, e, o[1], g)
                if best is None or rank < best[0]:
                    best = rank, o
        if best is None:
            return sorted(out)
        (_, share, _, e, start, g), (_, _, end) = best
        claims.setdefault(e, []).append((start, end))
        done.add(g)
        out.append((g, e, start, end, round(share, 6)))


def blocks_of(spark, pages):
    cell = "struct<row:int,col:int,rowSpan:int,colSpan:int>"
    gold = [(p, k, g, t, None, None) for p, (golds, _) in pages.items() for k, (g, t) in enumerate(golds)]
    engine = [(p, e, t, None, None, f"r{e}") for p, (_, engines) in pages.items() for e, t in engines]
    return spark.createDataFrame(gold, f"page_id string, pos int, gold_id string, text string, box array<double>, cell {cell}"), spark.createDataFrame(engine, f"page_id string, idx int, text string, box array<double>, cell {cell}, engine_ref string")


def test_matches_equal_the_best_offer_taken_again_and_again(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    pages = {f"p{k}": ([(f"g{i}", word(r.randint(2, 7))) for i in range(7)], [(e, word(r.randint(3, 16))) for e in range(3)]) for k in range(12)}
    taken = spans.match(*blocks_of(spark, pages)).collect()
    for p, (golds, engines) in pages.items():
        assert sorted((x.gold_id, x.idx, x.start, x.end, round(x.share, 6)) for x in taken if x.page_id == p) == brute_match(golds, engines)


def test_a_page_with_a_thousand_equal_blocks(spark):
    golds = [(f"g{i:04d}", "same text") for i in range(1000)]
    pages = {"p": (golds, [(0, "same text " * 600), (1, "same text " * 500)]), "q": (golds[:3], [(0, "same text")])}
    taken = spans.match(*blocks_of(spark, pages)).collect()
    own = sorted((x.idx, x.start) for x in taken if x.page_id == "p")
    assert own == [(0, 8 * i) for i in range(600)] + [(1, 8 * i) for i in range(400)] and len({x.gold_id for x in taken if x.page_id == "p"}) == 1000
    assert [x.gold_id for x in taken if x.page_id == "q"] == ["g0000"]


def test_one_session_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    loud, still = b"\x40\x1f" * 480, b"\0\0" * 480
    rows = [("hot", i + 1, "audio", loud if i % 40 < 30 else still) for i in range(2000)] + [("hot", 0, "open", None), ("cold", 0, "open", None), ("cold", 1, "audio", loud), ("cold", 2, "finish", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, seq long, control string, pcm16 binary").repartition(7)
    want = {}
    for n in (10_000, 13):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        want[n] = sorted(map(str, sessions.segment_batch(df, sessions.Rules(silence=0.2)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert want[13] == want[10_000] and len(want[13]) == len(rows) and sum("endMs" in x for x in want[13]) > 40


def test_admission_over_many_batches(spark):
    r = random.Random(6)
    rows = [(s, f"{s}-{i:03d}-{uuid.UUID(int=r.getrandbits(128))}", t := r.randint(0, 300), t + r.randint(0, 40)) for s in range(3) for i in range(60)]
    got = {x.session_id: x.status for x in sessions.admit(spark.createDataFrame(rows, "server int, session_id string, first_ts long, last_ts long"), 2, by="server").collect()}
    for s in range(3):
        busy = []
        for _, name, a, b in sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])):
            busy = [t for t in busy if t >= a]
            assert got[name] == ("open" if len(busy) < 2 else "rejected")
            if len(busy) < 2:
                busy.append(b)


def test_later_pairs_equal_all_pairs(spark):
    from quillspark.operators.scoring import later_pairs

    r = random.Random(7)
    rows = [(p, r.randint(0, 30), r.choice((None, r.randint(0, 9))), r.choice("ab")) for p in range(4) for _ in range(40)]
    got = {(x.page, x.kind): (x.pairs, x.rising) for x in later_pairs(spark.createDataFrame(rows, "page long, pos long, ord long, kind string"), "page", "pos", "ord", "kind").collect()}
    for p in range(4):
        for k in "ab":
            pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] == p and x[3] == k and x[1] < y[1]]
            assert got.get((p, k), (0, 0)) == (len(pairs), sum(x[2] is not None and y[2] is not None and x[2] < y[2] for x, y in pairs))


def test_numbers_that_stand_alone(spark):
    from pyspark.sql import functions as F

    from quillspark.functions.text import whole_number
    from quillspark.operators.scoring import stands_alone

    r = random.Random(2)
    rows = [("".join(r.choice("11,.%(a-") for _ in range(r.randint(0, 9))), r.choice(("1", "11", "1,1", "1.1", "(1)", "-1", "1%", "1,", r"\E1"))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.filter(stands_alone(F.col("a"), F.col("b")) != whole_number(F.col("a"), F.col("b"))).collect() == []


def test_numbering_and_relations(spark):
    from quillspark.operators import relations

    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS v").repartition(7)
    assert sorted((x.v, x.place) for x in relations.numbered(df, "v").collect()) == [(i, i + 1) for i in range(1000)]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    assert sorted(map(tuple, relations.both_ways(a, b).collect())) == [(1, "missing"), (2, "missing"), (3, "extra")]
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "x"), (1, 4, "x"), (1, 5, None)], "k long, o long, v string")
    assert [x.o for x in relations.changes(nulls, "k", ["o"], "v").orderBy("o").collect()] == [1, 3, 5]
    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 0, 4), (1, 2, 9)], "r long, c long, v long")
    assert {x.side: (x.pairs, x.rising) for x in relations.beside(cells, "r", "c", "v").collect()} == {"right": (1, 1), "down": (1, 0)}


def test_spans_of_many_pairs_equal_those_of_each():
    r = random.Random(21)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(1, 6))), "".join(r.choice("abcd") for _ in range(r.randint(0, 15)))) for _ in range(800)]
    codes = [(spans._codes(a), spans._codes(b)) for a, b in pairs]
    for cells in (1, 40, 1 << 20):
        assert spans.span_search_many([a for a, _ in codes], [b for _, b in codes], cells) == [spans.span_search(a, b) for a, b in codes]
