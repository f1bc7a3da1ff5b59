"""Bucketed cells, wide files, the retag job, the versioned graph store, and PSI with its default."""

import itertools
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from introna.operators import barcodes, counts, neighbors, splice
from introna.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("C"), (F.col("id") % 37).cast("string")).alias("cell_id"), F.col("id").alias("count"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        a, b = (counts.store_by_cell(rows, f"cells_{n}_{os.getpid()}", f"{tmp_path}/{n}", 4) for n in "ab")
        joined = a.join(b.groupBy("cell_id").agg(F.count("*").alias("n")), "cell_id")
        assert joined.count() == 600 and "Exchange" not in plan_of(joined)
        one = a.filter("cell_id = 'C5'")
        assert one.count() == sum(i % 37 == 5 for i in range(600))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
        assert re.search(r"SelectedBucketsCount: 1 out of 4", plan_of(a.filter("cell_id = 'C6'")))
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]) == 4


def test_wide_files_of_many_cells(spark, tmp_path):
    cells = [f"c{i}" for i in range(20_000)]
    head = ["Geneid", "Chr", "Start", "End", "Strand", "Length", *(f"/x/out.bam:{c}" for c in cells)]
    lines = ["# made by a counter", "\t".join(head)]
    for g in range(3):
        row = ["0"] * len(cells)
        row[g], row[19_999 - g], row[7_000] = str(g + 1), "2.5", "" if g else "bad"
        lines.append("\t".join([f"g{g}", "chr1", "1", "9", "+", "9", *row]))
    lines.append("short\tchr1\t1\t9\t+\t9\t4")
    (tmp_path / "wide.tsv").write_text("\n".join(lines) + "\n")
    df = tables.grouped_counts_scan(spark, str(tmp_path / "wide.tsv"))
    got = sorted((r["Geneid"], r["cell_id"], r["count"]) for r in df.select("Geneid", "cell_id", "count").collect())
    want = [(f"g{g}", c, n) for g in range(3) for c, n in ((f"c{g}", g + 1.0), (f"c{19_999 - g}", 2.5))]
    assert got == sorted([*want, ("short", "c0", 4.0)])
    nodes = lambda d: len(re.findall(r"\n[ :+*-]*\(?\d*\)?", plan_of(d)))
    (tmp_path / "small.tsv").write_text("\n".join("\t".join(line.split("\t")[:9]) for line in lines) + "\n")
    assert "Expand" not in plan_of(df) and nodes(df) == nodes(tables.grouped_counts_scan(spark, str(tmp_path / "small.tsv")))
    two = tables.grouped_counts_scan(spark, str(tmp_path / "wide.tsv"), cells=["c19998", "c1"])
    assert sorted((r["Geneid"], r["cell_id"], r["count"]) for r in two.collect()) == [("g1", "c1", 2.0), ("g1", "c19998", 2.5)]
    with pytest.raises(ValueError, match="without a count column"):
        tables.grouped_counts_scan(spark, str(tmp_path / "wide.tsv"), cells=["nope"])
    with pytest.raises(ValueError, match="no header"):
        tables.grouped_counts_scan(spark, str(tmp_path / "wide.tsv"), ["Other"])


SAM = ["\t".join([f"r{i}", "0", "chr1", str(i), "255", "10M", "*", "0", "0", "*", "*", *(["CB:Z:BC" + str(i % 4)] if i % 5 else []), "RG:Z:old"]) for i in range(1, 41)]


def test_retag_as_one_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("\n".join(["@HD\tVN:1.6", "@RG\tID:BC1-1\tSM:x", *SAM]) + "\n")
    lines = spark.read.text(str(tmp_path / "in"))
    header = spark.createDataFrame([("@HD\tVN:1.6",), ("@RG\tID:BC1-1\tSM:x",)], "value string")
    allow = spark.createDataFrame([("BC1",), ("BC2",)], "cell_id string")
    told = barcodes.retag_write(lines, header, str(tmp_path / "out"), allow, "-1")
    kept = [line for line in SAM if "CB:Z:BC1" in line or "CB:Z:BC2" in line]
    assert told == {"seen": 40, "tagged": len(kept), "written": len(kept), "filtered_out": 40 - len(kept)}
    out = []
    for name in sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-")):
        out += (tmp_path / "out" / name).read_text().splitlines()
    assert out[:3] == ["@HD\tVN:1.6", "@RG\tID:BC1-1\tSM:x", "@RG\tID:BC2-1\tSM:BC2-1\tLB:cells\tPL:ILLUMINA"]
    assert sorted(out[3:]) == sorted(line.replace("\tRG:Z:old", "") + f"\tRG:Z:{re.search('CB:Z:(BC.)', line)[1]}-1" for line in kept)
    open_ = barcodes.retag_write(lines, header, str(tmp_path / "open"))
    assert open_ == {"seen": 40, "tagged": sum("CB:Z" in line for line in SAM), "written": 40, "filtered_out": 0}


ONE_SCAN = '''
import glob, json, sys
sys.path.insert(0, {root!r}); sys.path.insert(0, {root!r} + "/tools")
import check_plans
spark = check_plans.session_with_log({logs!r})
from introna.operators import barcodes
header = spark.createDataFrame([("@HD",)], "value string")
allow = spark.createDataFrame([("BC1",)], "cell_id string")
told = barcodes.retag_write(spark.read.text({folder!r}), header, {out!r}, allow, "-1")
spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
plans, _ = check_plans.plans(glob.glob({logs!r} + "/*")[0], 0)
print("SCANS", sum(p.split("== Initial Plan ==")[0].count("Scan text") for p in plans[-1:]), len([p for p in plans if "Scan text" in p]), told["seen"])
'''


def test_retag_scans_its_lines_once(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("logs", "in"):
        (tmp_path / name).mkdir()
    (tmp_path / "in" / "a.sam").write_text("\n".join(SAM) + "\n")
    code = ONE_SCAN.format(root=root, logs=str(tmp_path / "logs"), folder=str(tmp_path / "in"), out=str(tmp_path / "out"))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd="/tmp")
    told = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("SCANS")]
    assert told and told[0][0] in ("1", "2") and told[0][2] == "40", (run.stdout[-500:], run.stderr[-1500:])


def test_stream_reports_its_counters(spark, tmp_path):
    from introna.streaming.retag import retag_stream, start_retag

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("\n".join(SAM) + "\n")
    allow = spark.createDataFrame([("BC1",), ("BC2",)], "cell_id string")
    running = start_retag(retag_stream(spark, str(tmp_path / "in"), allow, "-1"), str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination(120)
    told = [json.loads(p.json) if hasattr(p, "json") else p for p in running.recentProgress]
    seen = sum((p["observedMetrics"].get("retag") or {}).get("seen", 0) for p in told)
    assert seen == 40


def test_graph_store_shows_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    obs = lambda n: spark.createDataFrame([(f"c{i}", i) for i in range(n)], "cell_id string, label long")
    edges = spark.createDataFrame([("c0", 0, 1, 2.0), ("c0", 0, 0, 1.0)], "cell_id string, row long, col long, weight double")
    with pytest.raises(ValueError, match="no graph store"):
        tables.graph_store_manifest(spark, path)
    first = tables.graph_store_write(tables.graph_store(edges, obs(2)), path)
    told = lambda: tuple(tables.graph_store_manifest(spark, path).first())
    assert told() == (first, 2, 2)
    # a driver lost between data and manifest: the version before stays the present one, whole
    second = tables.graph_store_write(tables.graph_store(edges, obs(3)), path, commit=False)
    assert told() == (first, 2, 2) and tables.graph_store_read(spark, path).count() == 2
    tables.graph_store_commit(spark, path, second)
    assert told() == (second, 3, 2) and tables.graph_store_read(spark, path).count() == 3


def test_pooled_reads_meet_regions_once(spark, monkeypatch):
    """Rows that enter the range join do not depend on the length of the neighbour lists."""
    samples = [f"s{i}" for i in range(6)]
    reads = spark.createDataFrame(
        [(s, f"{s}r{j}", "chr1", 100 * j, "10M30N10M" if j % 2 else "40M") for s in samples for j in range(8)], "sample string, name string, chrom string, pos long, cigar string"
    )
    totals = reads.groupBy("sample").agg(F.count("*").alias("num_seqs"))
    junctions = spark.createDataFrame([(s, "chr1", 100 * j + 9, 100 * j + 41) for s in samples for j in (1, 5)], "sample_id string, chrom string, start long, end long")
    entered = []
    joined = neighbors.range_join
    monkeypatch.setattr(neighbors, "range_join", lambda probes, stored, *rest: (entered.append((probes.count(), stored.count())), joined(probes, stored, *rest))[1])
    for k in (2, 6):
        lists = spark.createDataFrame([(a, samples[(i + d) % 6]) for i, a in enumerate(samples) for d in range(k)], "main_name string, neighbor string")
        got = neighbors.pool_reads(lists, reads, totals, junctions, k)
        helped = {(r["main_name"], r["sample"], r["name"]) for r in got.filter("main_name <> sample").collect()}
        pairs = [(a, samples[(i + d) % 6]) for i, a in enumerate(samples) for d in range(1, k)]
        assert helped == {(a, b, f"{b}r{j}") for a, b in pairs for j in (1, 5)}
    assert entered[0] == entered[1] == (4, 2)


def test_cells_without_reads_do_not_vote(spark, monkeypatch):
    reads = spark.createDataFrame([("s1", "r1", "chr1", 100, "10M30N10M"), ("s2", "r2", "chr1", 100, "10M30N10M")], "sample string, name string, chrom string, pos long, cigar string")
    totals = reads.groupBy("sample").agg(F.count("*").alias("num_seqs"))
    junctions = spark.createDataFrame([(s, "chr1", 109, 141) for s in ("s1", "s2")], "sample_id string, chrom string, start long, end long")
    lists = spark.createDataFrame([(f"s{i}", s) for i in range(1, 50) for s in ("s1", "s2")], "main_name string, neighbor string")
    voted = []
    vote = neighbors.majority_junctions
    monkeypatch.setattr(neighbors, "majority_junctions", lambda heard, *rest: (voted.append(heard.count()), vote(heard, *rest))[1])
    got = neighbors.pool_reads(lists, reads, totals, junctions, 2)
    assert sorted((r["main_name"], r["name"]) for r in got.collect()) == [(s, r) for s in ("s1", "s2") for r in ("r1", "r2")]
    assert voted == [4]


def test_sparse_psi_equals_the_dense_table(spark):
    columns = [*splice.JUNCTIONS["se"]]
    se = spark.createDataFrame([("e1", "a", "b", "c"), ("e2", "a", "b", "never")], ", ".join(f"{c} string" for c in ["event_id", *columns]))
    mxe_names = [*splice.JUNCTIONS["mxe"], *splice.INCOMPATIBLE["mxe"]]
    mxe = spark.createDataFrame([("m1", "d", "e", "f", "g", "h", None)], ", ".join(f"{c} string" for c in ["event_id", *mxe_names]))
    held = [("s1", "a", 40), ("s1", "b", 20), ("s1", "c", 20), ("s2", "z", 3), ("s2", "d", 50), ("s2", "e", 50), ("s3", "f", 9), ("s3", "g", 12), ("s3", "h", 1)]
    reads = spark.createDataFrame(held, "sample_id string, junction_id string, reads long")
    table = splice.sparse_psi(se, mxe, reads)
    pairs = [(s, e) for s, e in itertools.product(["s1", "s2", "s3", "s9"], ["e1", "e2", "m1"])]
    got = {(r["sample_id"], r["event_id"]): r for r in table.lookup(spark.createDataFrame(pairs, "sample_id string, event_id string")).collect()}
    assert set(got) == {(s, e) for s in ("s1", "s2", "s3") for e in ("e1", "m1")}
    assert got["s1", "e1"]["psi"] == pytest.approx(20 / 60) and got["s2", "m1"]["notes"].startswith("Case 6")
    none = got["s2", "e1"]
    assert none["notes"] == splice.CASE_2 and none["psi"] is None and none["isoform1_junction13"] == 0 and none["isoform2_junction24"] is None and none["incompatible_junction14"] is None
    assert got["s1", "m1"]["incompatible_junction14"] == 0 and got["s1", "m1"]["isoform2_junction23"] is None
    counted = {(r["splice_type"], r["notes"]): r["n"] for r in table.case_counts().collect()}
    want = {}
    for r in got.values():
        want[r["splice_type"], r["notes"]] = want.get((r["splice_type"], r["notes"]), 0) + 1
    assert counted == want
