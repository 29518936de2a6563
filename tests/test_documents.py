import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.functions import text as X
from lodestone.operators import chunking, compare, contracts, evidence, index, prefix, search, tables
from lodestone.sources import files
from lodestone.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("text, expected", [("  a   b\t\tc\n\n\n\nd ", "a b c\n\nd"), ("", ""), (None, None), (" x ", "x")])
def test_normalize(spark, text, expected):
    assert one(spark, X.normalize_text(F.lit(text))) == expected


def test_scientific(spark):
    assert one(spark, X.normalize_scientific(F.lit(r"at 2 5 \ ^ { \circ } C for 1 0 min"))) == "at 25 C for 10 min"
    assert one(spark, X.normalize_scientific(F.lit("$ 93 . 4 $ and 4 5 %"))) == " 93 . 4 and 45 %"


@pytest.mark.parametrize("start, end, expected", [(9, 9, "A.pdf:p10"), (9, 10, "A.pdf:p10-p11"), (None, 3, "A.pdf"), (0, None, "A.pdf:p1")])
def test_citation(spark, start, end, expected):
    cited = X.citation(F.lit("A.pdf"), F.lit("A"), F.lit(start).cast("int"), F.lit(end).cast("int"))
    assert one(spark, cited) == expected
    assert one(spark, X.cited_page(cited)) == (None if start is None else start + 1)


def test_mentions_and_flags(spark):
    text = F.lit("93.4% end, 5%w, 7 mg, 7 mg, 12 min and 400%")
    assert one(spark, S.numeric_mentions(text)) == sorted({"5%", "7 mg", "12 min"})
    assert one(spark, S.quality_flags(text)) == ["suspicious_percent_gt_300"]
    assert one(spark, S.quality_flags(F.lit("same words " * 40))) == ["possible_ocr_duplicate_text"]
    assert one(spark, S.signals(F.lit(None).cast("string"))) == []


def test_conditions_and_metrics(spark):
    text = F.lit("loading of 20 mg, then loading 25 mg; pH 7, pH was 8.5; at 5 °C, 60 °C and 200 °C; adsorption time 30 min, adsorption time 40 min. activity recovery up to 91.2 %, activity recovery of 91.2 %; reused for eight cycles")
    assert one(spark, evidence.conditions(text)).asDict(True) == {"enzyme_loading": {"value": 25.0, "unit": "mg"}, "adsorption_time": {"value": 30.0, "unit": "min"}, "pH": 8.5, "immobilization_temperature": {"value": 60.0, "unit": "degC"}}
    assert [(m["name"], m["value"]) for m in one(spark, evidence.metrics(text))] == [("activity_recovery", 91.2), ("reuse_cycles", 8.0)]
    assert one(spark, evidence.identity(F.lit("the BCL powder"))).enzyme_abbreviation == "BCL"


def test_html_tables(spark):
    html = "<table><tr><th>A&amp;B</th><th>C</th></tr><tr><td></td><td> </td></tr><tr><td>1<br>2</td><td>x &lt;b&gt; &#945;&#x3b2; &bogus; & y</td></tr></table>"
    nested = "<tr><td>out<table><tr><td>in</td></tr></table></td></tr><TR><TD class='a'>open<td>b</TD></TR><!-- <tr><td>no</td></tr> --><tr><td>lost"
    df = spark.createDataFrame([(html,), (None,), (nested,), ("",)], "h string").select(tables.parse_html(F.col("h")).alias("r"))
    assert [r.r for r in df.collect()] == [[["A&B", "C"], ["1 2", "x <b> αβ &bogus; & y"]], [], [["in"], ["b"]], []]
    grid = spark.range(1).select(tables.parse_html(tables.to_html(F.array(F.lit("a<b"), F.lit("c")), F.array(F.array(F.lit("1 & 2"), F.lit("")), F.array(F.lit(""), F.lit(""))))).alias("r"))
    assert grid.head().r == [["a<b", "c"], ["1 & 2", ""]]


def test_running_values(spark):
    rows = [(g, i, None if i % 3 else f"{g}{i}", i) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v string, n int").repartition(5)
    got = {(r.g, r.i): r for r in prefix.running(df, ["g"], "i", {"last": ("last", F.col("v")), "total": ("sum", F.col("n")), "before": ("previous", F.col("n"))}, 7).collect()}
    assert len(got) == 150
    for (g, i), r in got.items():
        assert r.last == f"{g}{i - i % 3}" and r.total == i * (i + 1) // 2 and (r.before.v if r.before else None) == (i - 1 if i else None)


BLOCKS = "document_id string, block_index int, block_type string, text string, page_idx int, section string, bbox array<double>"


def placed(spark, rows, **options):
    df = spark.createDataFrame(rows, BLOCKS)
    return df, chunking.layout(df, F.col("section"), **options)


def test_packing(spark):
    rows = [("d", i, "text", "x" * n, p, s, None) for i, (n, s, p) in enumerate([(500, "s", 0), (500, "s", 0), (300, "s", 0), (2000, "s", 0), (10, "t", 0), (10, "t", 5), (10, None, 6), (10, None, 6)])]
    rows += [("d", 20, "header", "running", 0, "not a section", None), ("d", 21, "text", None, 6, None, None), ("d", 22, "table", "", 6, None, None)]
    df, at = placed(spark, rows)
    assert sorted((r.first_index, r.last_index) for r in chunking.packed(df, at).collect()) == [(0, 1), (2, 2), (3, 3), (4, 4), (5, 7)]
    made = {r.chunk_index: r for r in chunking.chunks(df, at).collect()}
    assert {k: r.source_block_indices for k, r in made.items()} == {0: [0, 1], 1: [2], 2: [3, 4, 5, 6, 7]}
    assert made[2].text_sha256 == hashlib.sha256(b"x" * 2000).hexdigest() and made[2].section == "s" and made[2].page_end == 6
    assert [r.section for r in at.where("route = 'table'").collect()] == ["t"]
    assert placed(spark, rows[:0])[1].count() == 0


def packed_one_by_one(rows, limit, least):
    """The blocks of each chunk, by going through the blocks of one document in order."""
    section, packs, last = None, [], None
    for _, index, kind, text, page, title, _ in sorted(rows, key=lambda r: r[1]):
        if kind in chunking.SKIPPED:
            continue
        section = title if title is not None else section
        if kind != "text" or not (text or "").strip():
            continue
        page = page or 0
        if packs and sum(len(t) + 2 for _, t in packs[-1]) + len(text) <= limit and last[0] == section and page <= last[1] + 1:
            packs[-1].append((index, text))
        else:
            packs.append([(index, text)])
        last = (section, page)
    out = []
    for pack in packs:
        short = sum(len(t) + 2 for _, t in pack) - 2 < least
        if short and out:
            out[-1] += [i for i, _ in pack]
        elif not short or "lipase" in "".join(t for _, t in pack):
            out.append([i for i, _ in pack])
    return out


def test_packing_over_buckets_equals_one_pass(spark):
    draw, rows = random.Random(4), []
    for document in range(12):
        for i in range(draw.choice([1, 7, 60, 150])):
            text = draw.choice(["", " ", None, "lipase", "x" * draw.randint(1, 30), "y" * draw.randint(30, 260)])
            rows.append((f"d{document}", i * draw.choice([1, 3]) + 200 * i, draw.choice(["text"] * 8 + ["header", "table", "other"]), text, draw.choice([None, i // 20, i // 20 + 1]), draw.choice([None] * 15 + ["a", "b"]), None))
    df, at = placed(spark, rows, limit=200, least=40, bucket=800)
    got = {}
    for r in chunking.chunks(df, at).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.source_block_indices))
    for document in {r[0] for r in rows}:
        expected = packed_one_by_one([r for r in rows if r[0] == document], 200, 40)
        assert [b for _, b in sorted(got.get(document, []))] == expected and [i for i, _ in sorted(got.get(document, []))] == list(range(len(expected)))


def test_tables_and_candidates(spark):
    df, at = placed(spark, [("d", 0, "text", "lipase with a yield of 5 % " * 5, 0, "s", [0.0, 1.0, 2.0, 3.0]), ("d", 1, "text", "nothing of note in this rather long block of plain words, it goes on and on", 9, None, None)])
    body = spark.createDataFrame([("d", 3, 2, None, "s", "Table 1", ["Enzyme", "Yield (%)", "References"], [["lipase", "120", "[3]"], ["", "5", "x"]]), ("d", 4, None, [1.0], None, None, [], [])], "document_id string, block_index int, page_idx int, bbox array<double>, section string, caption string, columns array<string>, rows array<array<string>>")
    made = {r.source_block_index: r for r in tables.records(body).collect()}
    assert made[3].table_id == "d_p2_t3" and made[3].row_count == 2 and made[3].quality_flags == ["suspicious_reference_cell", "suspicious_table_yield_gt_100"]
    assert made[3].text == "Columns: Enzyme | Yield (%) | References\nRow 1: Enzyme: lipase; Yield (%): 120; References: [3]\nRow 2: Enzyme: ; Yield (%): 5; References: x"
    assert (made[4].table_id, made[4].text, made[4].quality_flags, made[4].bbox) == ("d_p0_t4", "", ["table_parse_empty"], None)
    mirrored = {r.table_id: r for r in tables.chunks(tables.records(body)).collect()}
    assert mirrored["d_p2_t3"].chunk_id == "d_table_chunk_0000" and mirrored["d_p2_t3"].text.startswith("Table 1\nColumns")
    found = {r.candidate_id: r for r in chunking.extraction_candidates(chunking.chunks(df, at), tables.records(body)).collect()}
    assert set(found) == {"cand_d_chunk_0000", "cand_d_p2_t3", "cand_d_p0_t4"} and found["cand_d_p0_t4"].candidate_types == ["table_metric"]
    assert found["cand_d_chunk_0000"].candidate_types == ["enzyme_identity", "performance_metric"] and found["cand_d_chunk_0000"].bbox == [0.0, 1.0, 2.0, 3.0]
    records = {r.source_id: r for r in evidence.records_from_tables(tables.records(body)).where("extracted LIKE '%:1}'").collect()}
    assert json.loads(records["d_p2_t3"].extracted) == {"enzyme_name": "lipase", "substrate": None, "operating_conditions": None, "reaction_system": None, "acyl_acceptor": None, "reference": "[3]", "table_id": "d_p2_t3", "row_index": 1}
    assert records["d_p2_t3"].quality_flags == ["suspicious_table_yield_gt_100"] and records["d_p2_t3"].review_reasons == ["metric_percent_gt_100", "upstream_quality_flags"]


def test_ids_and_vectors(spark):
    assert one(spark, X.name_uuid(F.lit("chunk:é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:é"))
    words = ["bcl", "burkholderia", "cepacia", "lipase", "zif-8", "zif", "mof", "metal", "organic", "framework", "5.5%"]
    assert one(spark, index.tokens(F.lit("BCL- ZIF-8 5.5%"))) == words
    vector = [0.0] * 16
    for name in words + [f"{a}_{b}" for a, b in zip(words, words[1:])]:
        value = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
        vector[value % 16] += -1.0 if value >> 63 else 1.0
    norm = sum(v * v for v in vector) ** 0.5
    assert one(spark, index.HashEmbedder(16).embed(F.lit("BCL- ZIF-8 5.5%"))) == pytest.approx([v / norm for v in vector])
    assert one(spark, index.HashEmbedder(4).embed(F.lit(None).cast("string"))) == [0.0] * 4
    with pytest.raises(ValueError):
        index.HashEmbedder(0)


def test_points_are_chunks_tables_and_evidence(spark):
    common = "document_id string, source_pdf string, section string, quality_flags array<string>, signals array<string>, text string"
    chunk = spark.createDataFrame([("B10", "B10.pdf", "s", [], ["x"], "lipase text", "c1", "text", 0, 0)], common + ", chunk_id string, chunk_type string, page_start int, page_end int")
    made_tables = spark.createDataFrame([("B10", "B10.pdf", "s", ["low"], [], "body", "t1", 3, "cap", ["a"], 1)], common + ", table_id string, page_idx int, caption string, columns array<string>, row_count int")
    kind = "evidence_id string, source_id string, record_type string, document_id string, source_pdf string, section string, page_start int, page_end int, quality_flags array<string>, review_reasons array<string>, confidence string, requires_review boolean, extracted string, metrics array<struct<name string, value double>>, evidence_span string"
    record = spark.createDataFrame([("ev_1", "c1", "performance_metric", "B10", "B10.pdf", "s", 0, 1, [], ["low"], "low", True, "{}", [], "span")], kind)
    made = {r.point_type: r for r in index.points(chunk, made_tables, record, index.provider("hash_v1", dimensions=64)).collect()}
    assert {(r.point_type, r.citation, len(r.vector), r.usable_for_ranking) for r in made.values()} == {("rag_chunk", "B10.pdf:p1", 64, True), ("table_record", "B10.pdf:p4", 64, False), ("evidence_record", "B10.pdf:p1-p2", 64, False)}
    assert made["table_record"].text == "cap\nbody" and made["evidence_record"].parent_source_id == "c1"
    asked = spark.createDataFrame([("q", "lipase text"), ("none", "")], "k string, t string")
    hits = search.retrieve(spark.createDataFrame(list(made.values()), schema=index.points(chunk, made_tables, record, index.provider("hash_v1", dimensions=64)).schema), asked, "k", "t", index.HashEmbedder(64), 2, usable_only=False).collect()
    assert sorted((r.k, r["rank"], r.source_id) for r in hits)[0] == ("q", 1, "c1") and len(hits) == 2
    with pytest.raises(ValueError):
        index.provider("unknown")


def test_collection(spark, tmp_path):
    rows = lambda *items: spark.createDataFrame([(i, "rag_chunk", v) for i, v in items], "id string, point_type string, vector array<double>")
    made = index.Collection(spark, str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        made.upsert(rows(("a", [1.0])))
    made.ensure(2)
    made.ensure(2)
    with pytest.raises(RuntimeError):
        made.ensure(3)
    made.upsert(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    made.upsert(rows(("b", [1.0, 1.0])))
    assert sorted((r.id, r.vector) for r in made.points().collect()) == [("a", [1.0, 0.0]), ("b", [1.0, 1.0])]
    with pytest.raises(RuntimeError):
        made.upsert(rows(("c", [1.0])))
    made.ensure(3, recreate=True)
    assert made.size() == 3 and index.named_size({"a": {"size": 4}, "b": {"size": 4}}) == 4 and index.named_size({"a": {"size": 4}, "b": {"size": 5}}) is None


def test_sentence_provider(spark):
    made = index.provider("sentence", load=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], dimensions=2)
    assert one(spark, made.embed(F.lit("abc"))) == [3.0, 1.0] and one(spark, made.embed(F.lit(None).cast("string"))) == [0.0, 1.0]


def test_context(spark):
    kind = "g int, hit_rank int, score double, point_type string, record_type string, source_id string, citation string, usable_for_ranking boolean, quality_flags array<string>, extracted string, metrics array<struct<name string, value double>>, text string"
    df = spark.createDataFrame([(1, 2, 0.51236, "evidence_record", "x", "ev_1", "A.pdf:p1", True, ["a", "b"], '{"carrier": "ZIF-8", "n": null, "ok": true}', [("y", 5.0)], "t" * 20), (1, 3, 0.25, "rag_chunk", None, "c1", None, False, None, None, None, None)], kind)
    first = "[1] score=0.5124 type=evidence_record record_type=x\nsource_id=ev_1 citation=A.pdf:p1 usable=True flags=['a', 'b']\nextracted={'carrier': 'ZIF-8', 'n': None, 'ok': True}\nmetrics=[{'name': 'y', 'value': 5.0}]\ntext=" + "t" * 9
    assert search.context(df, "g", 9).head().context == first + "\n\n[2] score=0.2500 type=rag_chunk record_type=-\nsource_id=c1 citation=- usable=False flags=[]\nextracted={}\nmetrics=[]\ntext="


def test_enrich(spark):
    hits = spark.createDataFrame([("d", "ev", "c1", None), ("d", "t1", None, None), ("e", "c1", "", "given"), ("e", "c1", None, None)], "document_id string, source_id string, parent_source_id string, source_chunk_text string")
    chunks = spark.createDataFrame([("d", "c1", "chunk"), ("d", "t1", "mirror")], "document_id string, chunk_id string, text string")
    own = spark.createDataFrame([("d", "t1", "table")], "document_id string, table_id string, text string")
    assert sorted((r.document_id, r.source_id, r.source_chunk_text or "") for r in search.enrich(hits, chunks, own).collect()) == [("d", "ev", "chunk"), ("d", "t1", "table"), ("e", "c1", ""), ("e", "c1", "given")]


def test_references(spark):
    hits = spark.createDataFrame([(1, 1, "ev_1", "B10.pdf:p8"), (1, 2, "ev_2", "B10.pdf:p3")], "group_id int, rank int, source_id string, citation string")
    refs = spark.createDataFrame([(1, i, r) for i, r in enumerate(["1", "ev_2", "ev_fake", "B10.pdf:p8", "fake.pdf:p1", "7", " ", None])], "group_id int, ord int, ref string")
    assert sorted((r.ord, r.source_id) for r in search.resolve(refs, hits).collect()) == [(0, "ev_1"), (1, "ev_2"), (3, "ev_1")]


def test_search(spark):
    df = spark.createDataFrame([("a", "rag_chunk", True, [1.0, 0.0]), ("b", "rag_chunk", True, [0.0, 0.0]), ("c", "rag_chunk", False, [1.0, 1.0]), ("d", "rag_chunk", True, [1.0, 1.0]), ("e", "rag_chunk", True, None)], "payload_key string, point_type string, usable_for_ranking boolean, vector array<double>")
    assert [(r.payload_key, round(r.score, 3)) for r in search.search(df, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("d", 0.707), ("b", 0.0)]
    with pytest.raises(ValueError):
        search.search(df, [1.0, 0.0], 0)


ITEMS = "group_id int, rank int, record_type string, source_id string, citation string, confidence string, extracted string"


def test_settings(spark):
    tree = json.dumps({"carrier": "ZIF-8", "buffer": {"pH": 8}, "enzyme": {"loading": {"value": 500, "unit": "mg"}}, "support": None, "additives": ["b", "a"], "label": "8"})
    assert compare.members(tree)[1][:3] == (1, 1, "buffer") and compare.members("[1]") == compare.members("broken") == compare.members(None) == []
    own = compare.settings(spark.createDataFrame([(1, tree.replace('"support": null, ', ""))], "group_id int, t string"), "group_id", "t")
    assert {r.setting: r.value for r in own.collect()} == {"carrier": '"ZIF-8"', "buffer": '{"pH": 8}', "pH": "8", "enzyme": '{"loading": {"unit": "mg", "value": 500}}', "enzyme_loading": '{"unit": "mg", "value": 500}', "value": "500", "unit": '"mg"', "additives": '["b", "a"]', "label": '"8"'}
    hit = lambda rank, tells, kind="formulation_condition": (1, rank, kind, f"ev_{rank}", None, None, json.dumps(tells))
    hits = [hit(1, {"carrier": " zif-8 ", "enzyme_loading": {"unit": "MG", "value": 500}}), hit(2, {"carrier_variant": "silica", "pH": 8.0, "note": "x", "additives": []}), hit(3, {"ph": "8", "additives": ["A", "b"]}), hit(4, {"pH": 7}, "other"), hit(5, {"pH": 6.5, "temperature": {"value": 3}})]
    found = compare.changes(own, compare.reference_items(spark.createDataFrame(hits, ITEMS))).orderBy("ord").collect()
    assert [(r.field_path, r.current_value, r.recommended_value, r.evidence_ids, r.confidence) for r in found] == [
        ("carrier", '"ZIF-8"', '"silica"', ["ev_2"], "medium"), ("additives", '["b", "a"]', '["A", "b"]', ["ev_3"], "medium"), ("buffer.pH", "8", "6.5", ["ev_5"], "medium"), ("immobilization_conditions.temperature", None, '{"value": 3}', ["ev_5"], "medium")
    ]
    assert found[0].rationale.startswith("Evidence reports carrier_variant=silica for") and "additives=['A', 'b'] for" in found[1].rationale


def test_generated_changes(spark):
    hits = spark.createDataFrame([(g, 1, "formulation_condition", "ev_1", "A.pdf:p1", None, '{"pH": 7}') for g in (1, 2)], ITEMS)
    change = {"field_path": "buffer.pH", "current_value": 8, "recommended_value": {"a": 1}, "rationale": "r", "evidence_ids": ["1", "fake"], "confidence": "sure"}
    answer = json.dumps({"changes": [change, {**change, "extra": 1}, {**change, "evidence_ids": ["fake"]}, {**change, "rationale": 3}, "text"]})
    own = compare.settings(spark.createDataFrame([(1, '{"ph": 8}'), (2, '{"ph": 8}')], "group_id int, t string"), "group_id", "t")
    made = compare.all_changes(spark.createDataFrame([(1, answer), (2, "broken"), (3, None)], "group_id int, answer string"), hits, own).orderBy("group_id").collect()
    assert [(r.group_id, r.origin, r.field_path, r.current_value, r.recommended_value, r.evidence_ids, r.confidence) for r in made] == [(1, "generated", "buffer.pH", "8", '{"a":1}', ["ev_1"], "medium"), (2, "evidence", "buffer.pH", "8", "7", ["ev_1"], "medium")]


def test_evidence_ids(spark):
    expected = "ev_" + hashlib.sha1(json.dumps({"record_type": "t", "source_id": "s", "extracted": {"b": 1, "a": None}, "metrics": [], "span": "é"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    assert evidence.evidence_id("t", "s", {"a": None, "b": 1}, [], "é") == expected


def test_event_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", "x" * 250), ("b", None), ("c", "")], "k string, t string")
    kinds = {}
    for r in events.event_stream(df, "k", "t").orderBy("k", "seq").collect():
        kinds.setdefault(r.k, []).append(r.event)
    assert kinds == {"a": ["status", "status", "delta", "delta", "delta", "final"], "b": ["status", "error"], "c": ["status", "status", "final"]}
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"stream_id": "s", "seq": i, "event": "delta", "delta": "ab"}) for i in range(5)] + ["broken", json.dumps({"stream_id": "s", "seq": 5, "event": "final"})]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    totals = events.streaming_totals(events.read_events(spark.readStream.text(str(tmp_path / "in"))))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("totals").collect()] == [("s", 5, 10, True)]
    parsed = [one(spark, events.server_sent(F.lit(x))) for x in ("data: {}", ": comment", "", "data: [DONE]")]
    assert parsed == ["{}", None, None, None]


def test_files(spark, tmp_path):
    folder = tmp_path / "B10" / "auto"
    folder.mkdir(parents=True)
    (folder / "B10_content_list.json").write_text(json.dumps([{"type": "text", "text": "1. Intro", "page_idx": 0}, {"type": "list", "list_body": "- a"}]))
    (folder / "B10_content_list_v2.json").write_text("[]")
    items = files.read_content_lists(spark, str(tmp_path / "*" / "*" / "*.json"))
    assert sorted((r.document_id, r.block_index, r.type) for r in items.collect()) == [("B10", 0, "text"), ("B10", 1, "list")]
    assert one(spark, files.block_text(F.lit("list"), F.lit(None).cast("string"), F.lit("- a"))) == "- a"
    made = files.provenance(spark, str(folder / "B10_content_list_v2.json")).head()
    assert (made.length, made.sha256) == (2, hashlib.sha256(b"[]").hexdigest())
    (tmp_path / "x.jsonl").write_text('{"type": "text"}\n\nbroken\n')
    assert files.read_jsonl(spark, str(tmp_path / "x.jsonl"), files.CONTENT_ITEM, strict=False).where("type IS NOT NULL").count() == 1


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert sorted(map(tuple, index.upsert(old, new, "k", "v").collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_small_helpers(spark, tmp_path):
    assert one(spark, X.named_enzyme(F.lit("please use bcl, on resin"))) == "Burkholderia cepacia lipase" and one(spark, X.named_enzyme(F.lit("Laccase。on"))) == "Laccase"
    assert one(spark, X.plain_symbols(F.lit("$K _ { m }$ and $V _ { m a x }$"))) == "Km and Vmax"
    assert one(spark, X.first_present(F.lit(None), F.lit(" "), F.lit(5))) == "5"
    assert one(spark, X.plain_items(F.array(F.lit(" a "), F.lit(""), F.lit(None)))) == ["a"]
    assert [one(spark, X.object_or_null(F.lit(x))) for x in ('{"a": 1}', "[1]", "broken", None)] == ['{"a": 1}', None, None, None]
    assert one(spark, files.is_zip(F.lit(bytearray(b"PK\x03\x04rest")))) is True
    for name in ("B1.pdf", "B1 .pdf", "C.md"):
        (tmp_path / name).write_bytes(b"x")
    paths = files.provenance(spark, str(tmp_path / "*")).select(F.regexp_replace("path", "%20", " ").alias("path"))
    assert files.located(paths, "B1").head().path.endswith("/B1.pdf") and files.located(paths, "../B1").count() == 0
    assert {r.kind: r.n_files for r in files.profile(spark, str(tmp_path / "*")).collect()} == {"pdf": 2, "markdown": 1}
    with pytest.raises(ValueError):
        files.artifact_folder(spark, str(tmp_path / "*"))


def test_search_many(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0])], "k bigint, v array<double>")
    got = search.search_many(df, df.where("k % 10 = 0"), "k", "v", 3, 4, chunk=13).toPandas()
    import numpy as np

    m = np.array([[i % 7, i % 5, 1.0] for i in range(60)])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for q, rows in got.groupby("query"):
        scores = m @ m[q]
        scores[q] = -3
        assert np.allclose(sorted(rows.score), np.sort(scores)[-4:])
    assert set(got["query"]) == set(range(0, 60, 10)) and got.groupby("query").size().eq(4).all()


@pytest.mark.parametrize("own", [False, True])
def test_best_of_a_chunk(own):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    counts = draw.integers(-2, 3, (9000, 12)) + [3] * 12
    counts[draw.random(9000) < 0.3] = counts[0]  # many equal vectors
    units = counts / np.linalg.norm(counts, axis=1)[:, None]
    order = draw.permutation(9000)
    got = search._Chunk(pa.array(order), units[order], 5, own).best(pa.array(np.arange(0, 9000, 100)), units[::100])
    scores = (units[::100, None, :] * units[None, :, :]).sum(axis=2)
    if own:
        scores[np.arange(90), np.arange(0, 9000, 100)] = -3
    expected = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    ids = search._Chunk(pa.array(order), units[order], 5, own).ids.to_numpy()
    assert np.array_equal(got[0], np.repeat(np.arange(90), 5)) and np.array_equal(ids[got[1]].reshape(90, 5), expected)
    assert np.array_equal(got[2].reshape(90, 5), np.take_along_axis(scores, expected, 1))


def test_equal_texts_are_asked_once(spark):
    count = spark.sparkContext.accumulator(0)

    class Counting(index.HashEmbedder):
        def embed(self, text):
            @F.pandas_udf("string")
            def seen(texts):
                count.add(len(texts))
                return texts

            return super().embed(seen(text))

    made = spark.range(300).select(F.format_string("p%04d", "id").alias("id"), F.lit("rag_chunk").alias("point_type"), F.lit(True).alias("usable_for_ranking"), index.HashEmbedder(64).embed(F.format_string("lipase %d", F.col("id") % 3)).alias("vector"))
    asked = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") % 4 < 3, F.format_string("lipase %d", F.col("id") % 4)).alias("t"))
    got = {}
    for r in search.retrieve(made, asked, "k", "t", Counting(64), 4).collect():
        got.setdefault(r.k, {})[r["rank"]] = r.id
    assert count.value <= 6  # the three texts, for the filter and for the search
    assert got == {k: {n + 1: f"p{k % 4 + 3 * n:04d}" for n in range(4)} for k in range(600) if k % 4 < 3}


def test_artifacts(spark, tmp_path):
    kind = "path string, modified int"
    rows = [("/a/auto/B1_content_list.json", 5), ("/a/hybrid_auto/B1_content_list.json", 5), ("/b/auto/B1_content_list.json", 3), ("/a/hybrid_auto/B1.md", 5), ("/c/auto/B2_content_list.json", 1)]
    df = spark.createDataFrame(rows, kind)
    assert sorted((r.document_id, r.path) for r in files.latest_artifacts(df).collect()) == [("B1", "/a/hybrid_auto/B1_content_list.json"), ("B2", "/c/auto/B2_content_list.json")]
    assert {r.path: (r.md, r.middle) for r in files.with_siblings(df, ".md", "_middle.json").collect()}["/a/hybrid_auto/B1_content_list.json"] == ("/a/hybrid_auto/B1.md", None)
    assert [r.document_id for r in files.pending(spark.createDataFrame([("B1",), ("B3",)], "document_id string"), files.latest_artifacts(df)).collect()] == ["B3"]
    (tmp_path / "t.jsonl").write_text('{"id": "a", "text": "1"}\n\nbroken\n{"id": 5, "text": "x"}\n{"id": "b", "text": null}\n{"id": "a", "text": "2"}\n')
    assert [tuple(r) for r in files.tolerant_texts(spark, str(tmp_path / "t.jsonl")).collect()] == [("a", "2")] and files.tolerant_texts(spark, str(tmp_path / "no.jsonl")).count() == 0


def test_contracts(spark):
    row = spark.range(1).select(contracts.confidence_in_range(F.lit(1.2)).alias("a"), contracts.ranked(F.lit(1), F.array(F.lit("e"))).alias("b"), contracts.ranked(F.lit(0), F.array(F.lit("e"))).alias("c"), *contracts.linked(same=(F.lit("x"), F.lit("x")), other=(F.lit("x"), F.lit(None)))).head()
    assert tuple(row) == (False, True, False, True, False)
