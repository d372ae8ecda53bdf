"""Golden cases of the kernels and column functions."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import scoring, transform
from quillspark.operators.spans import ENGINE, GOLD, Block, Finder, assign, best_span, near_spans, normalize
from quillspark.sources import documents, media, tabular
from quillspark.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    raw = " （－１２．５０） 元 \n"
    assert normalize(raw) == one(spark, t.normalize(F.lit(raw))) == "(-12.50)元"


def test_best_span_literals():
    assert best_span("右栏1", "左栏1右栏1左栏2") == (0, 3, 6)
    assert best_span("12.50", "合计12.60元") == (1, 2, 7)
    assert best_span("ab", "") == (2, 0, 0)


def slow_span(gold, text):
    """All substrings, by the plain recurrence of edit distance."""

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    return min(dist(gold, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=8))
def test_best_span_costs(gold, text):
    cost, a, b = best_span(gold, text)
    assert cost == slow_span(gold, text) and 0 <= a <= b <= len(text)


def pages(spark, given):
    """Assigned rows by page and gold id (None: those of unmatched blocks) of pages (golds, blocks)."""
    golds = [(p, i, k, x, box, cell) for p, (own, _) in given.items() for i, (k, x, box, cell) in enumerate(own)]
    blocks = [(p, i, x, box, cell, f"b{i}") for p, (_, own) in given.items() for i, (x, box, cell) in enumerate(own)]
    out = {p: {} for p in given}
    for r in assign(spark.createDataFrame(golds, GOLD), spark.createDataFrame(blocks, ENGINE)).collect():
        if r.gold_id is None:
            out[r.page_id].setdefault(None, []).append(r.engine_ref)
        else:
            assert r.gold_id not in out[r.page_id]
            out[r.page_id][r.gold_id] = r
    return out


def offered(want, have, whole, claims):
    block = Block(have)
    for a, b in claims:
        block.claim(a, b)
    return block.offer(want, whole)


def plainly(golds, blocks):
    """Gold id -> (block, start, end) by the plain rule: the best offer of a page time and again, priced anew if its span is gone."""
    claims, offers, done = {i: [] for i in range(len(blocks))}, {}, {}

    def inside(a, b):
        if a is None or b is None or (a[2] - a[0]) * (a[3] - a[1]) == 0:
            return 0.0
        return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / ((a[2] - a[0]) * (a[3] - a[1]))

    def price(gold, i):
        k, x, box, cell = gold
        (y, place, spot), want = blocks[i], normalize(x)
        have, whole = normalize(y), cell is not None and spot is None
        if want:
            found = have and not (whole and abs(len(have) - len(want)) > 0.5 * len(want)) and offered(want, have, whole, claims[i])
        else:
            found = not have and not claims[i] and cell is not None and cell == spot and (0, 0, 0)
        return found and (len(want) < 4, found[0] / max(1, len(want)), inside(box, place) < 0.5, i, found[1], k, found[2])

    for g in golds:
        offers |= {(g[0], i): (x, g) for i in range(len(blocks)) if (x := price(g, i))}
    while offers:
        key = min(offers, key=lambda o: offers[o][0])
        (*_, i, start, k, end), g = offers.pop(key)
        if k not in done:
            if any(a < end and start < b for a, b in claims[i]) or start == end and claims[i]:
                offers |= {key: (x, g) for x in [price(g, i)] if x}
            else:
                claims[i].append((start, end))
                done[k] = i, start, end
    return done


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab c中", max_size=45), max_size=4), st.text("ab c中", max_size=60), st.data())
def test_finder_equals_brute_force(patterns, text, data):
    for p in patterns:  # a copy with a few edits
        p = list(p)
        for at in data.draw(st.lists(st.integers(0, 44), max_size=4)):
            p[at : at + 1] = data.draw(st.sampled_from(["", "x", "bb"]))
        text += "".join(p)
    want = [(i, *best_span(p, text)) for i, p in enumerate(patterns) if p]
    assert sorted(Finder(list(enumerate(patterns))).find(text)) == [r for r in want if r[1] <= len(patterns[r[0]]) // 10]


def test_near_spans_in_long_documents(spark):
    passage = "the quick brown fox jumps over the lazy dog near the bank of the river"
    near = passage.replace("quick", "quack").replace("river", "rivers")
    texts = ["filler text " * 600 + near, passage, "nothing", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, ""), (9, None), (10, "nothing")], "item_id long, pattern string")
    want = sorted((i, d, *best_span(p, texts[d])) for i, p, d in ((7, passage, 0), (7, passage, 1), (10, "nothing", 2)))
    for block in (1, 4096):
        assert sorted(map(tuple, near_spans(docs, items, block).collect())) == want
    assert want[0][2] == 1


def test_assignments(spark):
    cell, top, low = (0, 0, 1, 1), [0.0, 0.0, 1.0, 0.1], [0.0, 0.8, 1.0, 0.9]
    line, share = ("line", "增长 5%", None, None), ("cell", "%", None, cell)
    out = pages(spark, {
        "merged": ([("l1", "左栏第1段", None, None), ("l2", "左栏第2段", None, None), ("r1", "右栏第1段", None, None)], [("左栏第1段 右栏第1段 左栏第2段", None, None)]),
        "steal": ([line, share], [("增长 5%", None, None)]), "both": ([line, share], [("增长 5%", None, None), ("%", None, None)]),
        "once": ([("a", "核对", None, None), ("b", "核对", None, None)], [("核对", None, None)]),
        "place": ([("a", "同一句话", low, None), ("b", "同一句话", top, None)], [("同一句话", top, None), ("同一句话", low, None)]),
        "anew": ([("a", "重复短语", None, None), ("b", "重复短语", None, None)], [("重复短语重复短语", None, None)]),
        "empty": ([("e", "", None, (0, 1, 1, 1))], [("", None, (0, 1, 1, 1))]), "elsewhere": ([("e", "", None, (0, 1, 1, 1))], [("", None, cell)]),
        "two empty": ([("e", None, None, cell), ("f", "", None, cell)], [(None, None, cell)]), "no engine": ([("a", "x", None, None)], []), "no gold": ([], [("spare", None, None), (" ", None, None)]),
    })
    proposed = {p: {k: r for k, r in own.items() if k and r.status == "proposed"} for p, own in out.items()}
    m = proposed["merged"]
    assert m["r1"].text == "右栏第1段" and m["l1"].ord < m["r1"].ord < m["l2"].ord and not m["r1"].whole
    assert set(proposed["steal"]) == {"line"} and set(proposed["both"]) == {"line", "cell"} and len(proposed["once"]) == 1
    assert proposed["place"]["a"].engine_ref == "b1" and proposed["place"]["b"].located
    assert sorted(r.first for r in proposed["anew"].values()) == [0, 4]
    assert len(proposed["empty"]) == 1 and not proposed["elsewhere"] and set(proposed["two empty"]) == {"e"}
    assert out["no engine"]["a"].status == "missing" and out["no gold"] == {None: ["b0"]} and not proposed["no engine"]


def test_assignment_equals_the_plain_rule(spark):
    rng, given = random.Random(12), {}
    words = ["甲乙", "abc", "丙丁戊", "12.50", "x", "合计金额", ""]
    boxes = [None, [0.0, 0.0, 0.5, 0.5], [0.0, 0.0, 1.0, 1.0], [0.5, 0.5, 1.0, 1.0]]
    cells = [None, None, (0, 0, 1, 1), (0, 1, 1, 1)]
    for p in range(120):
        text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
        golds = [(f"g{i}", text(4), rng.choice(boxes), rng.choice(cells)) for i in range(rng.randrange(6))]
        blocks = [(text(9), rng.choice(boxes), rng.choice(cells)) for _ in range(rng.randrange(4))]
        given[f"p{p}"] = golds, blocks
    out = pages(spark, given)
    for p, (golds, blocks) in given.items():
        got = {k: (int(r.engine_ref[1:]), r.first, r.end) for k, r in out[p].items() if k and r.status == "proposed"}
        assert got == plainly(golds, blocks), (golds, blocks)


def test_whole_numbers(spark):
    for text, token, want in (("(12.50)元", "(-12.50)元", False), ("共925元", "925", True), ("1925", "925", False), ("48,781.88", "781", False), ("+1.5%", "+1.5%", True), ("增1.5%", "1.5", False)):
        assert one(spark, t.whole_number(F.lit(text), F.lit(token))) is want


BLOCK = "page_id string, category string, sha string, pos int, gold_id string, text string, cell struct<row:int,col:int,rowSpan:int,colSpan:int>, key_number boolean, numbers array<string>"
ACTUAL = "page_id string, gold_id string, text string, ord long, sha string, page int, cell struct<row:int,col:int,rowSpan:int,colSpan:int>, verified boolean, proposed boolean"


def test_counters(spark):
    names = ["L1", "R1", "L2", "R2", "L3", "R3"]
    order = {"L1": 0, "L2": 1, "L3": 2, "R1": 3, "R2": 4, "R3": 5}
    gold = spark.createDataFrame([("p", "c", "h", i, n, n, None, False, []) for i, n in enumerate(sorted(order, key=order.get))], BLOCK)
    actual = spark.createDataFrame([("p", n, n, i, "h", 1, None, False, True) for i, n in enumerate(names)], ACTUAL)
    r = scoring.ratios(scoring.counters(gold, actual)).first()
    assert (r.correctOrderPairs, r.orderPairs, r.correctAllOrderPairs, r.allOrderPairs) == (4, 5, 12, 15)
    assert r.orderAccuracy == 0.8 and r.correctSources == 0 and r.cellAccuracy is None
    assert scoring.counters(gold, actual, provisional=True).first().correctSources == 6


def test_missing_page_and_shifted_table(spark):
    cells = [(0, 0), (0, 1), (1, 0), (1, 1)]
    gold = spark.createDataFrame([("p", "c", "h", i, str(i), f"x{i}", (r, c, 1, 1), True, []) for i, (r, c) in enumerate(cells)], BLOCK)
    none = scoring.ratios(scoring.counters(gold, spark.createDataFrame([], ACTUAL))).first()
    assert (none.cells, none.cellAccuracy, none.numberAccuracy, none.characterErrorRate) == (4, 0.0, 0.0, 1.0)
    moved = spark.createDataFrame([("p", str(i), f"x{i}", i, "h", 1, (r, c + 1, 1, 1), True, None) for i, (r, c) in enumerate(cells)], ACTUAL)
    r = scoring.ratios(scoring.counters(gold, moved)).first()
    assert (r.cellAccuracy, r.cellTextAccuracy, r.cellNeighbourAccuracy, r.sourceAccuracy) == (0.0, 1.0, 1.0, 1.0)


def test_guards(spark):
    gold = spark.createDataFrame([("p", "c", "h", 0, "a", "x", None, False, [])], BLOCK)
    row = ("p", "a", "x", 0, "h", 1, None, True, None)
    with pytest.raises(scoring.GuardError):
        scoring.counters(gold, spark.createDataFrame([row, row], ACTUAL))
    with pytest.raises(scoring.GuardError):
        scoring.counters(gold, spark.createDataFrame([("p", "z", *row[2:])], ACTUAL))
    with pytest.raises(scoring.GuardError):
        scoring.select_pages(gold, "holdout", runner=True)


def test_segmenter_timeline():
    rules, s = sessions.Rules(), sessions.Segmenter()
    speech = lambda n: (b"\x40\x1f") * int(16000 * n)
    assert s.feed(speech(1.0), rules) == ("字字", [])
    assert s.feed(speech(0.5), rules) == ("字字字", [])
    assert s.feed(bytes(2 * int(16000 * 0.8)), rules) == ("", [("字字字", 0, 2300)])
    assert s.feed(speech(0.5), rules) == ("字", [])
    assert s.finish(rules) == [("字", 2300, 2800)]
    late = sessions.Segmenter()
    assert late.feed(bytes(2 * 48000), rules) == ("", []) and late.start == 48000
    assert late.feed(speech(1.0), rules) == ("字字", []) and late.feed(bytes(2 * 16000), rules) == ("", [("字字", 3000, 5000)])
    talk = sessions.Segmenter()
    assert [talk.feed(speech(5.0), rules)[1] for _ in range(4)] == [[], [], [], [("字" * 40, 0, 20000)]] and talk.start == talk.total
    quiet = sessions.Segmenter()
    assert quiet.feed(bytes(96000), rules) == ("", []) and quiet.finish(rules) == []


def test_stream_equals_batch(spark, tmp_path):
    from quillspark.plans.sessions import _chunks

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _chunks(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = sessions.segment_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    want = sessions.segment_batch(rows).collect()
    for _ in range(120):  # a query with timers of processing time doesn't end by itself
        if spark.table("segments").count() >= len(want) or not q.isActive:
            break
        time.sleep(1)
    q.stop()
    key = lambda r: (r.session_id, r.seq)
    assert sorted(spark.table("segments").collect(), key=key) == sorted(want, key=key)


def test_hotwords(spark):
    words = ["词组", " 短语 ", "", "词组", "x" * 100]
    assert one(spark, t.hotwords(F.array(*map(F.lit, words)))) == ["词组", "短语", "x" * 40]


def wav(samples, width, channels=1, rate=16000):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def test_audio(spark):
    assert media.pcm16(b"\x00\x80\xff\x7f").tolist() == [-1.0, np.float32(32767 / 32768)]
    with pytest.raises(ValueError):
        media.pcm16(b"\x00")
    assert len(media.decode_wav(wav(bytes(16000), 2))) == 8000
    assert len(media.decode_wav(wav(bytes(16000), 2, channels=2))) == 4000
    assert len(media.decode_wav(wav(bytes(88200), 2, rate=44100))) == 16000
    assert media.decode_wav(wav(b"\x00\x00\x80" * 4, 3)).tolist() == [-1.0] * 4
    assert media.decode_wav(wav(b"\x80" * 4, 1)).tolist() == [0.0] * 4
    with pytest.raises(media.Unsupported):
        media.decode_wav(wav(b"", 2), strict=True)
    rows = spark.createDataFrame([(bytearray(wav(bytes(16000), 2)),), (bytearray(b"junk"),)], "b binary").select(media.wav_frames("b").alias("r")).collect()
    assert [r.r.status for r in rows] == ["ok", "unsupported"]


def test_form_body(spark):
    head = b'--b\r\nContent-Disposition: form-data; name="f"; filename*=UTF-8\'\'%E4%B8%AD.wav\r\n\r\n'
    body = head + b"x\r\n--bad--b\r\n--b\r\nContent-Disposition: form-data; name=\"t\"\r\n\r\nhi\r\n--b--"
    parts = media.parse_form(body, b"b")
    assert [(p["name"], p["filename"], p["data"]) for p in parts] == [("f", "中.wav", b"x\r\n--bad--b"), ("t", None, b"hi")]
    for bad in (body[:-6], b"nothing"):
        with pytest.raises(ValueError):
            media.parse_form(bad, b"b")
    with pytest.raises(ValueError):
        media.parse_form(body, b"b", most=1)
    r = spark.createDataFrame([(bytearray(body), "b")], "b binary, m string").select(media.form_parts("b", "m").alias("r")).select(media.first_field(F.col("r.parts"), "t").alias("t"), F.size("r.parts").alias("n")).first()
    assert (r.t, r.n) == ("hi", 2)
    assert media.decode_chunked(b"3\r\nabc\r\n0\r\n\r\n", 10) == b"abc"
    with pytest.raises(ValueError):
        media.decode_chunked(b"3\r\nabc\r\n0\r\n\r\n", 2)


def test_engine_adapters(spark):
    tree = {
        "pages": {"1": {"size": {"width": 100, "height": 200}}}, "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/tables/0"}]},
        "texts": [{"self_ref": "#/texts/0", "text": "标题", "prov": [{"bbox": {"l": 10, "t": 190, "r": 50, "b": 180, "coord_origin": "BOTTOMLEFT"}}]}],
        "tables": [{"self_ref": "#/tables/0", "data": {"grid": [[{"start_row_offset_idx": 0, "start_col_offset_idx": c, "text": x, "row_span": 1, "col_span": 1} for c, x in ((0, "a"), (1, ""))]]}}],
    }
    blocks = documents.tree_blocks(tree)
    assert [b[0] for b in blocks] == ["标题", "a", ""] and blocks[0][1] == [0.1, 0.05, 0.5, 0.1]
    raw = {"width": 100, "height": 100, "table_res_list": [{"cell_box_list": [[0, 50, 50, 70], [50, 50, 100, 70]]}], "parsing_res_list": [
        {"block_bbox": [0, 0, 10, 10], "block_content": "先", "block_label": "text"}, {"block_bbox": [0, 50, 100, 70], "block_content": "<table><tr><td>a</td><td></td></tr></table>", "block_label": "table"},
        {"block_bbox": [0, 90, 10, 100], "block_content": "注", "block_label": "footnote"}]}
    other = json.loads(json.dumps(raw)) | {"table_res_list": [{"cell_box_list": [[0, 50, 50, 70]]}]}
    given = spark.createDataFrame([("p", json.dumps(raw)), ("q", json.dumps({"res": other}))], "page_id string, raw string")
    found = documents.engine_blocks(given, "list").orderBy("page_id", "idx").collect()
    assert [(b.page_id, b.idx, b.text, b.engineRef) for b in found] == [(p, i, x, r) for p in "pq" for i, (x, r) in enumerate((("先", "parsing/0"), ("a", "parsing/1"), ("", "parsing/1"), ("注", "parsing/2")))]
    assert found[2].bbox == [0.5, 0.5, 1.0, 0.7] and found[6].bbox == [0.0, 0.5, 1.0, 0.7] and tuple(found[2].cell) == (0, 1, 1, 1) and found[0].cell is None
    assert documents.engine_blocks(given, "tree").schema.names == documents.engine_blocks(given, "list").schema.names


def test_table_cells():
    html = "<table><tr><td rowspan='2'>a<th colspan=2> b &amp; c </th></tr><tr><td>d</td><td>e</td><td>f</td></tr><tr></tr><tr><td>g</td></table>"
    assert media.table_cells(html) == [(0, 1, 1, 2, "b & c"), (1, 1, 1, 1, "d"), (1, 2, 1, 1, "e"), (1, 3, 1, 1, "f"), (3, 0, 1, 1, "g")]
    assert media.table_cells("no table") == [] and media.table_cells("<td>x</td>") == [(0, 0, 1, 1, "x")]


def test_journal_and_inventory(spark, tmp_path):
    assert documents.journal_records('{"a": 1}\n{"a"') == [{"a": 1}]
    with pytest.raises(ValueError):
        documents.journal_records('{"a"\n{"a": 1}\n')
    (tmp_path / "j").write_text('{"id": "x"}\n{"id"')
    assert [r.record.id for r in documents.read_journal(spark, str(tmp_path / "j"), "id string").collect()] == ["x"]
    root = tmp_path / "m"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for name in ("a.txt", "sub/b.bin", "x.log", "y.pyc", "_c", ".d", ".git/e"):
        (root / name).write_text(name)
    rows = documents.inventory(spark, str(root)).orderBy("path").collect()
    assert [(r.path, r.bytes, r.sha256) for r in rows] == [(n, len(n), hashlib.sha256(n.encode()).hexdigest()) for n in ("_c", "a.txt", "sub/b.bin")]
    (root / "out").symlink_to(tmp_path / "j")
    with pytest.raises(ValueError, match="outside"):
        documents.inventory(spark, str(root))


def test_publish_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("-5", 2)], "a string, b int")
    tabular.publish(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="exists"):
        tabular.publish(df, str(tmp_path / "o"))
    tabular.publish(df, str(tmp_path / "o"), replace=True)
    tabular.export_csv(df, str(tmp_path / "c"))
    back = tabular.read_csv(spark, str(tmp_path / "c"), "a string, b int")
    assert {r.a for r in back.collect()} == {"'=1+1", "-5"}
    (tmp_path / "bad.csv").write_text("a,b\nx,1\ny,zz\n")
    assert tuple(tabular.preview(tabular.read_csv(spark, str(tmp_path / "bad.csv"), "a string, b int").cache())[1].first()) == (2, 1)


def test_journal_and_export(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("-5", 2), (None, 3)], "a string, b int")
    for part in (df.filter("b = 1"), df.filter("b > 1")):
        tabular.append_journal(part, str(tmp_path / "j"))
    assert documents.read_journal(spark, str(tmp_path / "j"), "a string, b int").count() == 3
    made = [tabular.export(df, str(tmp_path / kind), kind).first() for kind in ("csv", "parquet", "json")]
    assert [(m.format, m.columns, m.rows, m.guarded) for m in made] == [("csv", "a,b", 3, 1), ("parquet", "a,b", 3, 0), ("json", "a,b", 3, 0)] and len({m.digest for m in made}) == 1
    with pytest.raises(Exception, match="exists"):
        tabular.export(df, str(tmp_path / "csv"))


def test_subtitles(spark):
    rows = spark.createDataFrame([("d", 2, 1500, 2000, "two"), ("d", 1, 0, 1499, "one")], "doc string, no int, first_ms long, last_ms long, text string")
    body = {k: tabular.subtitles(rows, k).first().body for k in ("txt", "json", "srt", "vtt")}
    assert body["txt"] == "one\ntwo" and json.loads(body["json"])[1] == {"startMs": 1500, "endMs": 2000, "text": "two"}
    assert body["srt"].startswith("1\n00:00:00,000 --> 00:00:01,499\none\n\n2\n") and body["vtt"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.499\none\n")
    with pytest.raises(ValueError):
        tabular.subtitles(rows, "doc")


def test_transform_rejects_what_it_does_not_know(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for bad in ({"step": "select", "columns": ["a; drop"]}, {"step": "filter", "column": "a", "op": "like", "value": 1}, {"step": "sql"}, {"step": "cast", "column": "a", "type": "map<int,int>"}, {"step": "join", "table": "t", "on": ["a"]}):
        with pytest.raises(transform.StepError):
            transform.transform(df, [bad])
    assert transform.result_hash(df).first() == transform.result_hash(df.repartition(2)).first()


def test_wrap():
    assert media.wrap_text("中文字，换行", 3) == ["中文字，", "换行"]
    assert media.wrap_text("one two three", 7) == ["one two", "three"]
    assert media.wrap_text("甲乙丙％", 3) == ["甲乙丙％"]
