"""PSI cases, events against brute force, pooling rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from introna.operators import markers, neighbors, psi, splice

SE_CASES = [
    ((0, 0, 0), "Case 2", None), ((3, 4, 5), "Case 3", None), ((3, 20, 5), "Case 4", None), ((20, 500, 10), "Case 5", None),
    ((20, 0, 0), "Case 6", 0.0), ((0, 20, 20), "Case 7", 1.0), ((20, 20, 20), "Case 8", 0.5), ((20, 9, 8), "Case 9a", 8.5 / 28.5),
    ((12, 2, 3), "Case 9b", None), ((5, 20, 20), "Case 10a", 0.8), ((5, 12, 12), "Case 10b", None),
]
MXE_CASES = [
    ((20, 20, 20, 20, 15, 0), "Case 1", None), ((20, 5, 20, 5, 0, 0), "Case 11a", 0.5), ((12, 5, 12, 5, 0, 9), "Case 11b", None),
    ((20, 20, 20, 20, 9, 9), "Case 8", 0.5), ((500, 10, 20, 20, 0, 0), "Case 5", None),
]


def noted(spark, values, names, iso1, iso2, extra):
    df = spark.createDataFrame([values], ", ".join(f"{n} long" for n in names))
    one, two = [F.col(c) for c in iso1], [F.col(c) for c in iso2]
    note = splice.psi_note(one, two, F.greatest(*extra) if extra else None)
    return df.select(note.alias("note")).select("note", splice.scored(F.col("note")).alias("ok")).first()


@pytest.mark.parametrize("reads,case,value", SE_CASES)
def test_se_cases(spark, reads, case, value):
    row = noted(spark, reads, ["a", "c", "d"], ["a"], ["c", "d"], [])
    assert row["note"].startswith(case + ":") and row["ok"] == (value is not None)
    if value is not None:
        got = spark.range(1).select(splice.psi_value([F.lit(reads[0])], [F.lit(reads[1]), F.lit(reads[2])])).first()[0]
        assert got == pytest.approx(value)


@pytest.mark.parametrize("reads,case,value", MXE_CASES)
def test_mxe_cases(spark, reads, case, value):
    row = noted(spark, reads, list("abcdxy"), ["a", "b"], ["c", "d"], ["x", "y"])
    assert row["note"].startswith(case + ":") and row["ok"] == (value is not None)


@pytest.mark.parametrize("strand", ["+", "-", "."])
def test_events_against_brute_force(spark, strand):
    rng = random.Random(11)
    exons = [(f"exon:c:{100 * i}-{100 * i + (149 if i == 4 else 49)}:{strand}", "c", 100 * i, 100 * i + (149 if i == 4 else 49), strand) for i in range(1, 9)]
    links = [(a, b) for a, b in itertools.combinations(exons, 2) if a[3] < b[2] and rng.random() < 0.6]
    junctions = [(f"junction:c:{a[3] + 1}-{b[2] - 1}:{strand}", "c", strand, b[2], a[3]) for a, b in links]
    ex = spark.createDataFrame(exons, "exon_id string, chrom string, start long, stop long, strand string")
    js = spark.createDataFrame(junctions, "junction_id string, chrom string, strand string, exon_start long, exon_stop long")
    graph = splice.exon_edges(splice.exon_junction_triples(ex, js), ex)
    directed = set()
    # exons 4 and 5 end at the same base, so a junction from one is a junction from both
    for j in junctions:
        before, after = [e[0] for e in exons if e[3] == j[4]], [e[0] for e in exons if e[2] == j[3]]
        if strand == ".":
            # an unknown strand puts every exon at the junction on both of its sides
            directed |= set(itertools.permutations(before + after, 2))
        else:
            directed |= {(a, b) if strand == "+" else (b, a) for a in before for b in after}
    place = {e[0]: e for e in exons}
    apart = lambda a, b: place[a][2] > place[b][3] or place[a][3] < place[b][2]
    signed = lambda a: -place[a][2] if strand == "-" else place[a][2]
    names = [e[0] for e in exons]
    want_se = {t for t in itertools.permutations(names, 3) if (t[0], t[1]) in directed and (t[1], t[2]) in directed and (t[0], t[2]) in directed and apart(t[1], t[2]) and signed(t[1]) < signed(t[2])}
    got_se = [(r["exon1"], r["exon2"], r["exon3"]) for r in splice.skipped_exon_events(graph).collect()]
    assert len(got_se) == len(set(got_se)) and set(got_se) == want_se and want_se
    want_mxe = {t for t in itertools.permutations(names, 4) if {(t[0], t[1]), (t[0], t[2]), (t[1], t[3]), (t[2], t[3])} <= directed and apart(t[1], t[2]) and signed(t[1]) < signed(t[2])}
    got_mxe = [(r["exon1"], r["exon2"], r["exon3"], r["exon4"]) for r in splice.mutually_exclusive_events(graph).collect()]
    assert len(got_mxe) == len(set(got_mxe)) and set(got_mxe) == want_mxe and want_mxe


def test_pool_junctions(spark):
    key = "sample_id long, chrom string, start long, end long, strand long, motif long, annotated long, uniq double, multi double, max_overhang long"
    rows = [
        (1, "c", 10, 20, 0, 0, 0, 4.0, 0.0, 5), (2, "c", 10, 20, 2, 3, 1, 6.0, 2.0, 9), (2, "c", 30, 40, 1, 1, 0, 8.0, 0.0, 2),
        (3, "c", 30, 40, 2, 2, 1, 2.0, 2.0, 7), (4, "c", 10, 20, 1, 1, 1, 100.0, 0.0, 50),
    ]
    junctions = spark.createDataFrame(rows, key)
    reads = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 5.0), (4, 0.0)], "sample_id long, num_seqs double")
    lists = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4)], "main_name long, neighbor long")

    def pooled(n):
        found = neighbors.pool_junctions(lists, junctions, reads, n)
        return {(r["start"], r["end"]): tuple(r[c] for c in ("strand", "motif", "annotated", "uniq", "multi", "max_overhang")) for r in found.collect()}

    # votes: three for the first junction, two for the second; sample 4 has no reads and adds nothing
    assert pooled(6) == {(10, 20): (2, 3, 1, 7.0, 1.0, 9)}
    assert pooled(4) == {(10, 20): (2, 3, 1, 7.0, 1.0, 9), (30, 40): (1, 1, 1, 8.0, 4.0, 7)}
    # nothing kept at all: every neighbour row passes
    assert pooled(20) == pooled(4)


def test_depth_match(spark):
    reads = spark.createDataFrame([(f"r{i}",) for i in range(1000)], "name string")
    whole = neighbors.depth_match(reads, F.lit(1000.0), F.lit(1000.0))
    assert whole.count() == 1000
    more = neighbors.depth_match(reads, F.lit(1000.0), F.lit(2500.0)).groupBy("name").count()
    assert {r[0] for r in more.select("count").distinct().collect()} == {2, 3}
    assert abs(more.agg(F.sum("count")).first()[0] - 2500) < 100
    less = neighbors.depth_match(reads, F.lit(1000.0), F.lit(250.0))
    again = neighbors.depth_match(reads.repartition(5), F.lit(1000.0), F.lit(250.0))
    assert abs(less.count() - 250) < 60 and sorted(r[0] for r in less.select("name").collect()) == sorted(r[0] for r in again.select("name").collect())


def test_rank_sum(spark):
    from math import erfc, sqrt

    data = [(i, "e", v) for i, v in enumerate([0.1, 0.5, 0.5, 0.9, 0.0, 0.5, 1.0])]
    groups = [(i, "a" if i < 3 else "b") for i in range(7)]
    got = psi.rank_sum_test(spark.createDataFrame(data, "cell_id long, event_id string, psi double"), spark.createDataFrame(groups, "cell_id long, group string"))
    row = got.filter("group = 'a'").first()
    z = (2 + 4 + 4 - 3 * 8 / 2) / sqrt(3 * 4 * 8 / 12)
    assert row["z"] == pytest.approx(z) and row["p_val"] == pytest.approx(erfc(abs(z) / sqrt(2)), rel=1e-6)


def exchanges(df) -> int:
    """Shuffles of a plan before any of them has run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_rank_sum_moves_rows_once(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i, e, rng.choice([0.0, 0.25, 0.3, 0.9, 1.0, None])) for i in range(40) for e in ("e1", "e2", "e3")]
    psis = spark.createDataFrame(data, "cell_id long, event_id string, psi double")
    groups = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(40)], "cell_id long, group string")
    extra = spark.createDataFrame([("e1", "a", 0.3, 5), ("e2", "c", 0.95, 2)], "event_id string, group string, psi double, c long")
    whole = {}
    for e in ("e1", "e2", "e3"):
        held = [(v, "abc"[i % 3]) for i, event, v in data if event == e and v is not None]
        held += [(p, g) for event, g, p, c in extra.collect() for _ in range(c) if event == e]
        for g in "abc":
            mine = [v for v, group in held if group == g]
            ranks = sum(sum(w < v for w, _ in held) + (sum(w == v for w, _ in held) + 1) / 2 for v in mine)
            n, total = len(mine), len(held)
            whole[e, g] = n, (ranks - n * (total + 1) / 2) / (n * (total - n) * (total + 1) / 12) ** 0.5
    for cells in (1 << 16, 1):
        monkeypatch.setattr(psi, "STRETCH_CELLS", cells)
        found = psi.rank_sum_test(psis, groups, 4, extra)
        got = {(r["event_id"], r["group"]): (r["n"], r["z"]) for r in found.collect()}
        assert got.keys() == whole.keys()
        assert all(got[k][0] == n and got[k][1] == pytest.approx(z) for k, (n, z) in whole.items())
    # by event and stretch, then by event
    assert exchanges(psi.rank_sum_test(psis.coalesce(1), F.broadcast(groups))) <= 2


def test_cluster_fill_moves_counts_once(spark):
    rows = spark.createDataFrame([(i, e, 0.5 if i % 2 else None) for i in range(8) for e in ("e1", "e2")] + [(9, "e1", 0.25)], "cell_id long, event_id string, psi double")
    clusters = spark.createDataFrame([(i, i % 2) for i in range(9)], "cell_id long, cluster long")
    got = {(r["event_id"], r["cluster"]): (r["fill"], r["missing"]) for r in psi.psi_cluster_fill(rows, clusters, 5).collect()}
    assert got == {("e1", 0): (None, 5)}
    got = {(r["event_id"], r["cluster"]): (r["fill"], r["missing"]) for r in psi.psi_cluster_fill(rows, clusters, 4).collect()}
    assert got == {("e1", 0): (None, 5), ("e2", 0): (None, 5)}
    plan = psi.psi_cluster_fill(rows, F.broadcast(clusters), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(event_id") == 1


def test_stouffer_null_rule(spark):
    rows = [("k", "full", 0.01, 1.0, 10), ("k", "full", 0.2, -2.0, 30), ("k", "gap", 0.01, 1.0, None), ("k", "gap", 0.2, 1.0, 30), ("k", "zero", 0.0, 1.0, 5), ("k", "sure", 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "cluster string, gene string, p_val double, avg_log2fc double, exon_length long")
    weighted = markers.length_weights(df)
    got = {r["gene"]: r["stouffer_p"] for r in markers.weighted_stouffer(weighted).collect()}
    assert got["gap"] is None and got["sure"] == pytest.approx(1.0) and got["zero"] < 1e-300
    from statistics import NormalDist

    nd = NormalDist()
    z = (0.25 * -nd.inv_cdf(0.01) + 0.75 * -nd.inv_cdf(0.2)) / (0.25 ** 2 + 0.75 ** 2) ** 0.5
    assert got["full"] == pytest.approx(1 - nd.cdf(z), rel=1e-5)
    fold = {r["gene"]: r["abs_log2fc"] for r in markers.weighted_abs_log2fc(weighted).collect()}
    assert fold["full"] == pytest.approx(1.75) and fold["gap"] is None


def test_adjusted_p(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.9]
    df = spark.createDataFrame([(f"g{i}", v) for i, v in enumerate(p)], "gene string, p double")
    got = {r["gene"]: r for r in markers.adjust_bh(markers.adjust_bonferroni(df, "p"), "p", ["gene"]).collect()}
    assert got["g4"]["p_bh"] is None and got["g4"]["p_bonferroni"] is None
    assert [round(got[f"g{i}"]["p_bh"], 6) for i in (0, 1, 2, 3, 5)] == [0.025, 0.05, 0.05, 0.025, 0.9]
    assert got["g5"]["p_bonferroni"] == 1.0 and got["g0"]["p_bonferroni"] == pytest.approx(0.05)


def _graph(spark, pairs):
    place = lambda x: ("c", 100 * x, 100 * x + 50, "+", 100 * x)
    rows = [(f"e{a}", f"e{b}", f"j{a}_{b}", place(a), place(b)) for a, b in sorted(pairs)]
    at = "struct<chrom:string,start:long,stop:long,strand:string,signed:long>"
    return spark.createDataFrame(rows, f"up string, down string, junction string, up_at {at}, down_at {at}")


def test_mutually_exclusive_events_of_random_graphs(spark):
    import random

    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(60)) if a != b}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()
    for one in out:
        for two in out[one]:
            for three in out[one]:
                if two < three:
                    for four in out.get(two, set()) & out.get(three, set()):
                        if four != one:
                            want.add((f"e{one}", f"e{two}", f"e{three}", f"e{four}", f"j{one}_{two}", f"j{two}_{four}", f"j{one}_{three}", f"j{three}_{four}"))
    rows = splice.mutually_exclusive_events(_graph(spark, pairs)).collect()
    got = [(r.exon1, r.exon2, r.exon3, r.exon4, r.junction12, r.junction24, r.junction13, r.junction34) for r in rows]
    assert len(got) == len(want) and set(got) == want


def test_hub_exons_are_not_paired_out(spark):
    """5,000 exons lead into one and 5,000 out of it: 25 million paths, one event."""
    pairs = {(i, 10_000) for i in range(5_000)} | {(10_000, 20_000 + i) for i in range(5_000)} | {(7, 15_000), (15_000, 20_003)}
    rows = splice.mutually_exclusive_events(_graph(spark, pairs)).collect()
    assert [(r.exon1, r.exon2, r.exon3, r.exon4) for r in rows] == [("e7", "e10000", "e15000", "e20003")]


def test_event_ids_travel_once_a_tile_of_samples(spark):
    names = splice.JUNCTIONS["se"]
    se = spark.createDataFrame([("e1", "a", "b", "c"), ("e2", "a", "c", "b")], ", ".join(f"{c} string" for c in ["event_id", *names]))
    held = [(f"s{i}", j, i + 12 if j == "a" else 20) for i in range(130) for j in "abc" if (i + ord(j)) % 5]
    reads = spark.createDataFrame(held, "sample_id string, junction_id string, reads long")
    table = splice.sparse_psi(se, None, reads)
    assert table.tiles.count() == 2 * 3
    # neither the events nor their tiles are gathered on the driver
    assert "strategy=merge" in table.lookup(spark.createDataFrame([("s1", "e1")], "sample_id string, event_id string"))._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["sample_id"], r["event_id"]): (r["isoform1_junction13"], r["isoform2_junction12"], r["isoform2_junction23"]) for r in table.rows.collect()}
    sums = {(s, j): n for s, j, n in held}
    order = {"e1": "abc", "e2": "acb"}
    assert got == {(f"s{i}", e): tuple(sums.get((f"s{i}", j), 0) for j in order[e]) for i in range(130) for e in order}


def test_psi_tables_are_compared_without_a_join_of_their_rows(spark):
    from introna.operators import psi

    a = spark.createDataFrame([(1, "e", 0.5), (2, "e", None), (3, "e", 0.25), (9, "e", 0.1), (1, "only", 0.3)], "cell_id long, event_id string, psi double")
    b = spark.createDataFrame([(1, "e", 0.25), (2, "e", None), (3, "f", 0.5), (1, "f", 0.1), (None, "e", 0.2)], "cell_id long, event_id string, psi double")
    found = psi.compare_psi(a, b)
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row.shared_cells, row.shared_events, row.exact_equal, row.max_abs_diff, row.pearson) == (3, 1, False, 0.25, None)


def test_first_values_are_found_where_the_events_lie(spark):
    """The rows of a PSI table are not shuffled again by cell and event, nor by cell."""
    names = ["junction13", "junction12", "junction23"]
    se = spark.createDataFrame([("e1", "a", "b", "c"), ("e2", "a", "c", "b")], ", ".join(f"{c} string" for c in ["event_id", *names]))
    held = [(f"S{i}.{k}", j, 10 + i + k if i != 3 else 1) for i in range(40) for k in range(2) for j in "abc" if i or k]
    table = splice.psi_table(se, None, spark.createDataFrame(held, "sample_id string, junction_id string, reads long"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    assert plan(psi.first_values(table, "sample_id")) == plan(table)
    cells = spark.createDataFrame([("S0",), ("S1",), ("S1",), ("S3",), ("none",), (None,)], "cell_id string")
    rows = psi.psi_matrix(table, cells, "sample_id").collect()
    first = {(r["sample_id"], r["event_id"]): r["psi"] for r in table.collect()}
    want = [(c, e, first[(f"{c}.{k}", e)], f"{c}.{k}") for c, k in (("S0", 1), ("S1", 0), ("S1", 0), ("S3", 0)) for e in ("e1", "e2")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["cell_id"], r["event_id"], r["psi"], r["first_seen"]) for r in rows), key=key) == sorted(
        [*want, ("none", None, None, None), (None, None, None, None)], key=key
    )
    assert first[("S3.0", "e1")] is None and first[("S0.1", "e1")] is not None


def test_samples_of_a_junction_lie_together(spark):
    """Summing the reads deals them by junction, so what follows per junction needs no other exchange."""
    from introna.plans.bindings import Tables

    reads = Tables(spark, "/root/testdata/sf0.001").b5()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    assert plan(reads.groupBy("chrom", "a", "b").agg(F.sum("reads"))) == plan(reads) == 1


def test_cases_cover_every_event_and_sample(spark):
    """Samples without a read on an event count as well."""
    from introna.plans import splice_queries
    from introna.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    counted = {(r.splice_type, r.notes): r.n for r in splice_queries._cases(t).collect()}
    samples = t.b5().select("sample_id").distinct().count()
    for kind in ("se", "mxe"):
        events = splice_queries.events(t, kind).select("event_id").distinct().count()
        assert sum(n for (k, _), n in counted.items() if k == kind) == events * samples
    assert counted[("se", "Case 2: Zero observed reads")] > 0


def test_exons_edges_and_events_are_not_gathered_on_the_driver(spark):
    """They look small in packed files, at any size, so the joins of the graph are dealt out by a hint."""
    from introna.plans import splice_queries
    from introna.plans.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for rows in (splice_queries.edges(t), splice_queries.events(t, "se"), splice_queries.events(t, "mxe")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_events_that_lack_a_junction_are_left_out_and_listed_once(spark):
    names = splice.JUNCTIONS["se"]
    rows = [("e1", "a", "b", "c"), ("e1", "a", "b", "c"), ("e2", "a", "b", "gone"), ("e3", "lost", "b", "gone"), ("e4", None, "b", "c")]
    se = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["event_id", *names]))
    reads = spark.createDataFrame([("s1", j, 20) for j in "abc"], "sample_id string, junction_id string, reads long")
    table = splice.sparse_psi(se, None, reads)
    assert [r["event_id"] for r in table.events.collect()] == ["e1"] and [r["event_id"] for r in table.rows.collect()] == ["e1"]
    # the events are found once, not again for the list of them
    plan = table.events._jdf.queryExecution().executedPlan().toString()
    assert "min(junction13" not in plan and "FileScan" in plan
