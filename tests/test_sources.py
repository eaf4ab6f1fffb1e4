"""Scans and sinks on small files."""

import json

from pyspark.sql import functions as F

from tracewright.operators import records
from tracewright.operators.validation import fixture_issues
from tracewright.sources import coco, documents, entries, labels, tables, tasks


def test_coco_round_trip(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 50}], "categories": [{"id": 1, "name": "resistor"}],
        "annotations": [{"id": 7, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "area": 12.0, "iscrowd": 0, "rotation": 15, "attributes": {"designator": "R1"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{")
    t = coco.read(spark, str(tmp_path))
    a = t["annotations"].first()
    assert (a.id, a.bbox, a.rotation, a.attributes["designator"], a.pos) == (7, [1.0, 2.0, 3.0, 4.0], 15.0, "R1", 0)
    assert t["images"].count() == t["categories"].count() == 1
    coco.write_documents({k: v.drop("file_id", "pos") for k, v in t.items()}, str(tmp_path / "out"))
    again = coco.read(spark, str(tmp_path / "out" / "*.txt"))
    assert again["annotations"].first().bbox == [1.0, 2.0, 3.0, 4.0]
    many = {
        "images": spark.range(40).selectExpr("id", "concat('f', id) AS file_name"), "categories": t["categories"].drop("file_id", "pos"),
        "annotations": spark.range(90).selectExpr("id", "id % 40 AS image_id", "1 AS category_id")}
    coco.write_documents(many, str(tmp_path / "shards"), shards=3)
    assert len(list((tmp_path / "shards").glob("*.txt"))) == 3
    again = coco.read(spark, str(tmp_path / "shards" / "*.txt"))
    assert (again["images"].count(), again["annotations"].count(), again["categories"].count()) == (40, 90, 3)
    files = lambda name, c: {(r.file_id, r[1]) for r in again[name].select("file_id", c).collect()}
    assert files("annotations", "image_id") <= files("images", "id")
    coco.write_tables({"images": t["images"].withColumn("split", F.lit("train"))}, str(tmp_path / "tables"))
    assert (tmp_path / "tables" / "images" / "split=train").exists()


def test_tasks(spark, tmp_path):
    res = {"type": "rectanglelabels", "from_name": "label", "value": {"x": 10, "y": 20, "width": 30, "height": 40, "rectanglelabels": ["resistor"]}, "meta": {"text": ["designator=R5 value=10k"]}}
    full = [{"id": 1, "data": {"image": "/up/x.png"}, "annotations": [{"result": []}, {"result": [res]}]}, {"id": 2, "data": {"image": "y.png"}, "predictions": [{"result": [res, res]}]}]
    (tmp_path / "list.json").write_text(json.dumps(full))
    (tmp_path / "wrapped.json").write_text(json.dumps({"tasks": [{"id": 3, "data": {"image": "z.png"}, "result": [res]}]}))
    rows = tasks.first_results(tasks.read(spark, str(tmp_path)))
    c = tasks.component(F.col("r"))
    got = sorted((r.id, r.idx, r.image, r.label, r.value, r.bbox) for r in rows.select("id", "idx", tasks.image_name().alias("image"), *[v.alias(k) for k, v in c.items()]).collect())
    assert got == [(1, 0, "x.png", "R5", "10k", [10.0, 20.0, 30.0, 40.0]), (2, 0, "y.png", "R5", "10k", [10.0, 20.0, 30.0, 40.0]),
                   (2, 1, "y.png", "R5", "10k", [10.0, 20.0, 30.0, 40.0]), (3, 0, "z.png", "R5", "10k", [10.0, 20.0, 30.0, 40.0])]


def test_label_files(spark, tmp_path):
    rows = [("train", "a", 1, "1 0.2 0.2"), ("train", "a", 0, "0 0.1 0.1 0.5"), ("val", "b", 0, "2 0.5")]
    out = str(tmp_path / "labels")
    labels.write(spark.createDataFrame(rows, "split string, stem string, line_no int, line string"), out)
    files = list((tmp_path / "labels" / "split=train").glob("*.txt"))
    assert [f.read_text() for f in files] == ["a\t0 0.1 0.1 0.5\na\t1 0.2 0.2\n"]
    assert sorted(tuple(r) for r in labels.read(spark, out + "/split=*").collect()) == [("a", 0, [0.1, 0.1, 0.5]), ("a", 1, [0.2, 0.2])]
    src = tmp_path / "src"
    src.mkdir()
    (src / "img_1.txt").write_text("0 0.1 0.2 0.3\n3 0.5\n\n")
    assert [tuple(r) for r in labels.read(spark, str(src)).collect()] == [("img_1", 0, [0.1, 0.2, 0.3])]
    labels.write_class_list(spark.createDataFrame([(3, "b"), (1, "a")], "category_id int, name string"), str(tmp_path / "names"))
    text = next((tmp_path / "names").glob("*.txt")).read_text()
    assert text == "  0: a\n  1: b\n"


def test_corrections_and_manifest(spark, tmp_path):
    (tmp_path / "1_corrections.json").write_text(json.dumps({"request_id": "1", "corrections": [{"component": "R1", "value": "10k"}, {"component": "", "value": " "}]}))
    (tmp_path / "2_corrections.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    got = tables.read_corrections(spark, str(tmp_path))
    assert got.count() == 2
    assert {(r.kind, r.item, r.n) for r in records.correction_counts(got).collect()} == {("component", "R1", 1), ("value", "10k", 1), ("entries", "", 1)}
    tables.append_corrections(got, str(tmp_path / "store"))
    assert sorted((r.request_id, r.component) for r in tables.read_appended(spark, str(tmp_path / "store")).collect()) == [("1", ""), ("1", "R1")]
    tables.append_corrections(got.where("component = 'R1'"), str(tmp_path / "store"))
    assert [(r.request_id, r.component) for r in tables.read_appended(spark, str(tmp_path / "store")).collect()] == [("1", "R1")]
    m = spark.createDataFrame([("a.png", "dot", "n1", "2", "3", "4", "t")], "filename string, label string, node_id string, degree string, position_row string, position_col string, timestamp string")
    tables.append_manifest(m, str(tmp_path / "manifest"))
    tables.append_manifest(m, str(tmp_path / "manifest"))
    assert tables.read_manifest(spark, str(tmp_path / "manifest")).count() == 2


def test_epochs_csv(spark, tmp_path):
    (tmp_path / "results.csv").write_text("epoch,time,train/box_loss,train/seg_loss,val/box_loss,val/seg_loss,metrics/mAP50(B),metrics/mAP50(M)\n1,30.5,1,2,3,4,0.5,0.4\n")
    r = tables.read_epochs(spark, str(tmp_path)).first()
    assert (r["epoch"], r["time"], r["metrics/mAP50(B)"]) == (1, 30.5, 0.5)


def test_benchmarks(spark, tmp_path):
    put = lambda n, d: (tmp_path / n).write_text(d if isinstance(d, str) else json.dumps(d))
    put("benchmark_1.json", {"results": [{"model": "m", "time_sec": 3.5}, {"model": "k", "time_sec": 2}], "device": "cpu", "batch": 4, "timestamp": "t1"})
    put("inference.json", {"mean_latency_ms": 20.5, "fps": 48.8, "weights": "runs/best.pt", "run_dir": "runs/x7"})
    put("list.json", [{"model": "p", "time_sec": 1.5}])
    put("single.json", {"time_sec": 9})
    put("odd.json", {"a": 1})
    put("bad.json", "{")
    got = {(r.type, r.run_name, r.model, r.time_sec, r.batch, r.fps) for r in tables.read_benchmarks(spark, str(tmp_path)).collect()}
    assert got == {
        ("1-ep-benchmark", "t1", "k", 2.0, 4, None), ("1-ep-benchmark", "t1", "m", 3.5, 4, None), ("inference", "x7", "best", None, None, 48.8),
        ("poc", "list", "p", 1.5, None, None), ("poc", "single", None, 9.0, None, None), ("unknown", "odd", None, None, None, None), ("error", "bad", None, None, None, None)}


def test_entry_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert entries.read_entries(spark, path).count() == 0
    kind = "id string, type string, label string, filename string, payload string, is_delete boolean, seq long"
    entries.merge_entries(spark.createDataFrame([("1", "page", "A", "f1", "{}", False, 0), ("2", "crop", "B", "f2", "{}", False, 0)], kind), path)
    ch = spark.createDataFrame([("2", "crop", "B2", "f2", "{}", False, 1), ("1", "page", "A", "f1", "{}", True, 2), ("3", "page", "Żółć", "f3", "{}", False, 3)],
                               kind)
    entries.merge_entries(ch, path)
    # older changes that come late decide nothing
    entries.merge_entries(spark.createDataFrame([("1", "page", "old", "f1", "{}", False, 1), ("3", "page", "old", "f3", "{}", True, 2)], kind), path)
    entries.merge_entries(ch.limit(0), path)
    assert {(r.id, r.label) for r in entries.read_entries(spark, path).collect()} == {("2", "B2"), ("3", "Żółć")}


def test_inventory_and_fixture_rules(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.png").write_bytes(b"x" * 10)
    (d / "b.txt").write_bytes(b"x" * 10)
    files = tables.list_files(spark, str(d))
    assert {r.length for r in files.collect()} == {10}
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.lit("h").alias("hash"))
    ann = spark.createDataFrame([("a", True, False)], "stem string, has_image boolean, has_annotations boolean")
    got = {(r.name, r.code) for r in fixture_issues(named, ann, 5).collect()}
    assert got == {("a.png", "too_large"), ("a.png", "missing_keys"), ("a.png", "duplicate"), ("b.txt", "extension"), ("b.txt", "too_large"), ("b.txt", "missing_annotation"), ("b.txt", "duplicate")}


def test_reports(spark, tmp_path):
    tables.write_report(spark.range(3), str(tmp_path / "r"), "csv")
    lines = [x for f in (tmp_path / "r").glob("*.csv") for x in f.read_text().splitlines()]
    assert sorted(set(lines)) == ["0", "1", "2", "id"]


def _cuts(text, n):
    """The text in ranges as Spark cuts them: n equal parts, each moved on to the brace that ends a piece."""
    pieces = text.split("}")
    if pieces[-1] == "":
        pieces.pop()
    out, at, size = {}, 0, max(1, len(text) // n)
    for p in pieces:
        out.setdefault(at // size, []).append(p)
        at += len(p) + 1
    return list(out.values())


def _records_of(text, n):
    """The two passes of `documents` by hand, without Spark."""
    import pyarrow as pa

    ranges, size = _cuts(text, n), len(text.encode())
    batch = pa.RecordBatch.from_pydict({
        "value": [p for r in ranges for p in r], "file": ["f" for r in ranges for _ in r],
        "block": pa.array([b for b, r in enumerate(ranges) for _ in r], pa.int64()), "size": pa.array([size for r in ranges for _ in r], pa.int64())})
    states = [r for b in documents._states(documents._summaries([batch])) for r in b.to_pylist()]
    starts = {("f", r["block"]): r["state"] for r in states}
    rows = [r for b in documents._cutter(starts)([batch]) for r in b.to_pylist()]
    parts = sorted((r for r in rows if r["kind"] in (1, 2, 3)), key=lambda r: (r["block"], r["kind"] == 1))
    if parts:
        rows += [r for b in documents._joined([pa.RecordBatch.from_pylist(parts, schema=documents._CUT)]) for r in b.to_pylist()]
    found = sorted((r for r in rows if r["kind"] == 0), key=lambda r: (r["key"] or "", r["block"], r["idx"]))
    return [(r["key"], json.loads(r["record"])) for r in found], states[-1]["broken"], [r["record"] for r in rows if r["kind"] == 4]


def test_documents_in_ranges():
    """Braces, quotes and backslashes inside strings, nesting, white space, and a document cut anywhere."""
    import random

    rnd = random.Random(1)
    odd = ['a}b{', 'quo"te', "back\\", '\\"}', "]}[{", "ź" * 5, "", '"', "\\\\"]
    deep = lambda d: rnd.choice([1, None, rnd.choice(odd)]) if d == 0 else {rnd.choice(["k", "a]", 'x"y']): deep(d - 1), "l": [deep(d - 1), {}]}
    for indent in (None, 2):
        for n in (1, 2, 3, 7, 40, 200):
            doc = {"info": {"name": odd[0], "more": [1, 2]}, "images": [deep(rnd.randint(1, 3)) for _ in range(9)], "note": odd[3], "empty": [], "annotations": [{"id": i, "t": rnd.choice(odd)} for i in range(30)]}
            found, broken, whole = _records_of(json.dumps(doc, indent=indent, ensure_ascii=False), n)
            assert not broken and found == [("annotations", x) for x in doc["annotations"]] + [("images", x) for x in doc["images"]]
            assert n > 1 or [json.loads(w) for w in whole] == [doc]
            tasks_ = [deep(2) for _ in range(20)] + [[{"a": 1}, 2], {}]
            found, broken, whole = _records_of(json.dumps(tasks_, indent=indent) + "\n", n)
            assert not broken and found == [(None, x) for x in tasks_] and not whole
            assert _records_of(json.dumps(doc, indent=indent)[:-5], n)[1] and _records_of(json.dumps(tasks_)[:-30], n)[1]


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    s.conf.set("spark.sql.files.openCostInBytes", "1000")
    doc = {"images": [{"id": i, "file_name": f"{{{i}}}.png"} for i in range(400)], "annotations": [{"id": i, "image_id": i % 400, "bbox": [i, 1, 2, 3]} for i in range(3000)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"images": [{"id": 7}], "categories": [{"id": 1, "name": "}"}]}, indent=1))
    (tmp_path / "cut.json").write_text(json.dumps(doc)[:90_000])
    pieces = s.read.option("lineSep", "}").text(str(tmp_path / "a.json"))
    assert pieces.rdd.getNumPartitions() > 5
    t = coco.read(s, str(tmp_path))
    got = [(r.id, r.pos, r.image_id, r.bbox[0]) for r in t["annotations"].orderBy("pos").collect()]
    assert got == [(i, i, i % 400, float(i)) for i in range(3000)]
    assert sorted((r.file_id[-6:], r.pos, r.id, r.file_name) for r in t["images"].collect()) == sorted([("a.json", i, i, f"{{{i}}}.png") for i in range(400)] + [("b.json", 0, 7, None)])
    assert [(r.pos, r.name) for r in t["categories"].collect()] == [(0, "}")]
    export = [{"id": i, "data": {"note": "x", "any": f"http://host/p/{i}.png?v=1", "later": "z.png"}, "annotations": [{"response": [{"type": "t", "value": {"text": "}"}}]}]} for i in range(500)]
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "list.json").write_text(json.dumps(export))
    (tmp_path / "tasks" / "one.json").write_text(json.dumps({"id": 900, "data": {"image": "/a/x.JPG"}, "annotations": [{"result": [{"type": "u"}]}]}))
    (tmp_path / "tasks" / "none.json").write_text(json.dumps({"tasks": []}))
    rows = tasks.first_results(tasks.read(s, str(tmp_path / "tasks"))).select("id", "idx", tasks.image_name().alias("image"), "r.type").collect()
    assert sorted(map(tuple, rows)) == [(i, 0, f"{i}.png?v=1", "t") for i in range(500)] + [(900, 0, "x.JPG", "u")]


def test_entry_store_parts_its_buckets(spark, tmp_path):
    """Batches in reversed order into small buckets against a dictionary; readers of an older version keep what they saw."""
    import random

    path, kind = str(tmp_path / "store"), "id string, type string, label string, filename string, payload string, is_delete boolean, seq long"
    rnd, state, seq = random.Random(6), {}, list(range(1200))
    changes = [(str(rnd.randint(0, 500)), "t", f"l{i}", None, None, rnd.random() < 0.2, i) for i in seq]
    for c in changes:
        state[c[0]] = c
    before = None
    for k in range(3, -1, -1):
        entries.merge_entries(spark.createDataFrame(changes[300 * k : 300 * k + 300], kind), path, 60)
        if k == 3:
            before = entries.read_entries(spark, path)
            seen = sorted(map(tuple, before.collect()))
    entries.merge_entries(spark.createDataFrame(changes[100:200], kind), path, 60)
    got = {r.id: r.label for r in entries.read_entries(spark, path).collect()}
    assert got == {k: c[2] for k, c in state.items() if not c[5]}
    m = entries.manifest(spark, path).collect()
    assert max(r.rows for r in m) <= 90 and sum(2.0 ** -r.bits for r in m) == 1 and len({(r.bits, r.prefix) for r in m}) == len(m) > 7
    assert sum(r.rows for r in m) == len(state)
    assert {r.version for r in entries._manifests(spark, path).select("version").distinct().collect()} == {3, 4, 5}
    names = {r.folder.split("/")[0] for r in entries._manifests(spark, path).where("folder IS NOT NULL").collect()}
    assert names == {p.name for p in (tmp_path / "store" / "data").iterdir()}
    one = str(tmp_path / "kept")
    entries.merge_entries(spark.createDataFrame(changes[900:], kind), one, 60)
    old = entries.read_entries(spark, one)
    entries.merge_entries(spark.createDataFrame(changes[:900], kind), one, 60)
    assert sorted(map(tuple, old.collect())) == seen
