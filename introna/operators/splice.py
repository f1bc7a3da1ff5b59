"""Junction tables, splice events on the exon-junction graph, and percent spliced-in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from introna.functions.cigar import introns
from introna.functions.columns import region_name, signed_start
from introna.operators.scans import running_before
from introna.session import stored
from introna.sources.sequence import fetch_stranded

# Event composition, thresholds, motifs and note texts.
ISOFORM_COMPONENTS = {
    "se": (["junction13"], ["junction12", "exon2", "junction23"]),
    "mxe": (["junction13", "exon3", "junction34"], ["junction12", "exon2", "junction24"]),
}
ISOFORM_EXONS = {
    "se": (["exon1", "exon3"], ["exon1", "exon2", "exon3"]),
    "mxe": (["exon1", "exon3", "exon4"], ["exon1", "exon2", "exon4"]),
}
ISOFORM_JUNCTIONS = {
    "se": (["junction13"], ["junction12", "junction23"]),
    "mxe": (["junction13", "junction34"], ["junction12", "junction24"]),
}
EXONS = {"se": ["exon1", "exon2", "exon3"], "mxe": ["exon1", "exon2", "exon3", "exon4"]}
JUNCTIONS = {
    "se": ["junction13", "junction12", "junction23"],
    "mxe": ["junction13", "junction34", "junction12", "junction24"],
}
INCOMPATIBLE = {"se": [], "mxe": ["junction14", "junction23"]}
MIN_READS = 10
UNEVEN = 10
SPLICE_SITES = ["GT/AG", "GC/AG", "AT/AC"]
MOTIF_CODES = {"GT/AG": 1, "CT/AC": 2, "GC/AG": 3, "CT/GC": 4, "AT/AC": 5, "GT/AT": 6}
CASE_1 = "Case 1: >= {m} reads on junctions that are incompatible with the annotation"
CASE_2 = "Case 2: Zero observed reads"
CASE_3 = "Case 3: All junctions with insufficient reads"
CASE_4 = "Case 4: Only one junction with sufficient reads"
CASE_5 = "Case 5: Unequal read coverage (one side has at least {u}x more reads)"
CASE_6 = "Case 6: Exclusion"
CASE_7 = "Case 7: Inclusion"
CASE_8 = "Case 8: Sufficient reads on all junctions"
CASE_9 = "Case 9{}: Isoform1 with sufficient reads but Isoform2 has 1+ junctions with insufficient reads"
CASE_10 = "Case 10{}: Isoform1 has 1+ junction with insufficient reads but Isoform2 with sufficient reads"
CASE_11 = "Case 11{}: Isoform1 and Isoform2 each have both sufficient and insufficient junctions"
ENOUGH = ": There are sufficient junction reads"
TOO_FEW = ": There are insufficient junction reads"


# Junction tables -------------------------------------------------------------------------------


def cigar_junctions(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, chrom, start, stop, strand, uniq, multi): reads over each gap of the alignments.

    ``reads``: (chrom, pos, cigar, flag, mapq). Equal alignments are counted first, and each
    distinct alignment string is walked once; mapping quality 255 counts as unique.
    """
    spliced = reads.filter(F.col("cigar").contains("N"))
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    unique = F.col("mapq") >= 255
    shapes = spliced.groupBy(*by, "chrom", "pos", "cigar", strand.alias("strand")).agg(
        F.count_if(unique).alias("u"), F.count_if(~unique).alias("m")
    )
    walked = spliced.select("cigar").distinct().withColumn("_gaps", introns(F.col("cigar"), F.lit(0)))
    spread = shapes.join(walked, "cigar").withColumn("_i", F.explode("_gaps"))
    start, stop = F.col("pos") + F.col("_i.start"), F.col("pos") + F.col("_i.end")
    return spread.groupBy(*by, "chrom", start.alias("start"), stop.alias("stop"), "strand").agg(
        F.sum("u").alias("uniq"), F.sum("m").alias("multi")
    )


def majority_strand(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts summed over the strands, under the strand with most reads (plus on a tie)."""
    best = F.max(F.struct(F.col(value).alias("n"), (F.col("strand") == "+").alias("plus"), "strand")).getField("strand")
    rows = counts.filter(F.col(value) > 0)
    return rows.groupBy(*by, "chrom", "start", "stop").agg(best.alias("strand"), F.sum(value).alias(value))


def combine_unique_multi(unique: DataFrame, multi: DataFrame, by: Sequence[str] = (), ignore_multimapping: bool = False) -> DataFrame:
    """Multi-mapped counts joined onto the unique ones by place and strand; one-base rows dropped.

    A group (``by``) without any unique row keeps its multi rows; otherwise multi-only rows are lost.
    """
    key = [*by, "chrom", "start", "stop", "strand"]
    joined = unique.join(multi, key, "left")
    if by:
        alone = multi.join(unique.select(*by).distinct(), list(by), "left_anti")
    else:
        found = unique.select(F.lit(1).alias("_v")).limit(1).agg(F.count("_v")).scalar()
        alone = multi.filter(found == 0)
    both = joined.unionByName(alone, allowMissingColumns=True).fillna(0, ["uniq", "multi"])
    reads = F.col("uniq") if ignore_multimapping else F.col("uniq") + F.col("multi")
    return both.filter("start <> stop").withColumn("reads", reads)


def junction_metadata(junctions: DataFrame, columns: Sequence[str], min_reads: int = MIN_READS) -> DataFrame:
    """Distinct attributes of the junctions that reach ``min_reads`` in any row."""
    return junctions.filter(F.col("reads") >= min_reads).select(*columns).distinct()


def novel_exons(junctions: DataFrame, known: DataFrame, max_length: int = 100) -> DataFrame:
    """(chrom, start, stop, strand): gaps of at most ``max_length`` from one junction's end to another's start.

    Only distinct ends and distinct starts meet, each end with the bins of ``max_length`` bases
    it can reach, so a place used by very many junctions counts once.
    """
    ends = junctions.select("chrom", F.col("stop").alias("e"), F.col("strand").alias("s1")).distinct()
    starts = junctions.select("chrom", F.col("start").alias("b"), F.col("strand").alias("s2")).distinct()
    at = F.floor(F.col("e") / max_length)
    reach = ends.withColumn("_bin", F.explode(F.array(at, at + 1)))
    pairs = reach.join(starts.withColumn("_bin", F.floor(F.col("b") / max_length)), ["chrom", "_bin"])
    gap = F.col("b") - F.col("e")
    exons = pairs.filter((gap > 0) & (gap <= max_length)).select(
        "chrom", (F.col("e") + 1).alias("start"), (F.col("b") - 1).alias("stop"),
        F.when(F.col("s1") == F.col("s2"), F.col("s1")).otherwise(".").alias("strand"),
    ).distinct()
    return exons.join(known.select("chrom", "start", "stop", "strand"), ["chrom", "start", "stop", "strand"], "left_anti")


def splice_motif(junctions: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Add ``motif`` (1-6, else 0) from the first and last two bases of the intron.

    Two bases lie in one chunk once it is followed by the next one's first base, so a junction meets one chunk
    per end and nothing else.
    """
    reaching = chunks.select("chrom", F.col("chunk_no").cast("long").alias("chunk_no"), "seq", F.lit(None).cast("string").alias("next")).unionByName(
        chunks.select("chrom", (F.col("chunk_no") - 1).cast("long").alias("chunk_no"), F.lit(None).cast("string").alias("seq"), F.substring("seq", 1, 1).alias("next"))
    )
    # an "N" is in no motif, nor is one base alone
    whole = F.concat(F.rpad(F.max("seq"), chunk, "N"), F.coalesce(F.max("next"), F.lit("")))
    bases = reaching.groupBy("chrom", "chunk_no").agg(F.upper(whole).alias("_bases"))

    def at(rows: DataFrame, first: Column, name: str) -> DataFrame:
        placed = rows.withColumn("_chunk", F.floor((first - 1) / chunk))
        met = placed.join(bases.select("chrom", F.col("chunk_no").alias("_chunk"), "_bases"), ["chrom", "_chunk"], "left")
        return met.withColumn(name, F.substr("_bases", (first - F.col("_chunk") * chunk).cast("int"), F.lit(2))).drop("_chunk", "_bases")

    both = at(at(junctions, F.col("start"), "_d"), F.col("end") - 1, "_a")
    seen = F.concat(F.coalesce("_d", F.lit("")), F.lit("/"), F.coalesce("_a", F.lit("")))
    code = reduce(lambda c, item: c.when(seen == item[0], item[1]), MOTIF_CODES.items(), F.when(F.lit(False), 0)).otherwise(0)
    return both.withColumn("motif", code.cast("long")).drop("_d", "_a")


def backfill_annotation(junctions: DataFrame, annotated_introns: DataFrame | None = None) -> DataFrame:
    """Set ``strand`` and ``annotated`` of rows that carry ``motif``.

    An annotated intron gives its strand when it has one only, else the motif's strand. Without ``annotated_introns``
    the rows hold the intron's ``strands`` already, NULL where there is none.
    """
    by_motif = F.when(F.col("motif") == 0, 0).when(F.col("motif") % 2 == 1, 1).otherwise(2)
    joined = junctions
    if annotated_introns is not None:
        joined = junctions.join(annotated_introns.select("chrom", "start", "end", "strands"), ["chrom", "start", "end"], "left")
    strand = F.when(F.size("strands") == 1, F.element_at("strands", 1)).otherwise(by_motif)
    return joined.withColumns(
        {
            "strand": F.when(F.col("strands").isNotNull(), strand).otherwise(by_motif).cast("long"),
            "annotated": F.when(F.col("strands").isNotNull(), 1).otherwise(F.col("annotated")).cast("long"),
        }
    ).drop("strands")


# Events ----------------------------------------------------------------------------------------


def by_merge(df: DataFrame) -> DataFrame:
    """One side of a join that is dealt out, whatever its size seems to be.

    Exons, edges and events grow with the annotation, but their sizes are guessed from packed files and from rows
    before they are listed, many times too small; a join that is broadcast for it gathers them all on the driver.
    """
    return df.hint("merge")


def exon_junction_triples(exons: DataFrame, junctions: DataFrame) -> DataFrame:
    """(exon_id, direction, junction_id); an exon is upstream where the junction starts after it.

    ``exons``: (exon_id, chrom, start, stop, strand); ``junctions``: (junction_id, chrom, strand,
    exon_start, exon_stop). Directions swap on the minus strand; an unknown strand gives both.
    """
    ids = by_merge(junctions.select("junction_id", "chrom", "strand", "exon_start", "exon_stop").distinct())
    held = exons.select("exon_id", "chrom", "start", "stop", "strand").distinct()
    before = held.join(ids, (held.chrom == ids.chrom) & (held.strand == ids.strand) & (held.stop == ids.exon_stop))
    after = held.join(ids, (held.chrom == ids.chrom) & (held.strand == ids.strand) & (held.start == ids.exon_start))

    def sides(rows: DataFrame, plus: str, minus: str) -> DataFrame:
        told = F.when(held.strand == "+", F.array(F.lit(plus))).when(held.strand == "-", F.array(F.lit(minus)))
        told = told.otherwise(F.array(F.lit("upstream"), F.lit("downstream")))
        return rows.select("exon_id", F.explode(told).alias("direction"), "junction_id")

    return sides(before, "upstream", "downstream").unionByName(sides(after, "downstream", "upstream")).distinct()


def exon_edges(triples: DataFrame, exons: DataFrame) -> DataFrame:
    """Directed edges (up, down, junction) between exons, with both exons' places.

    A junction of unknown strand has each of its exons on both sides; an edge from an exon to
    itself, which that would also give, is left out. Of several junctions between two exons,
    which only an unknown strand can give, the first by name stands for the pair.
    """
    up = triples.filter("direction = 'upstream'").select(F.col("exon_id").alias("up"), F.col("junction_id").alias("junction"))
    down = triples.filter("direction = 'downstream'").select(F.col("exon_id").alias("down"), F.col("junction_id").alias("junction"))
    place = exons.select("exon_id", F.struct("chrom", "start", "stop", "strand", signed_start(F.col("start"), F.col("strand")).alias("signed")).alias("p")).distinct()
    edges = up.join(by_merge(down), "junction").filter("up <> down").groupBy("up", "down").agg(F.min("junction").alias("junction"))
    for end in ("up", "down"):
        edges = edges.join(by_merge(place.select(F.col("exon_id").alias(end), F.col("p").alias(f"{end}_at"))), end)
    return edges


def _apart(a: str, b: str) -> Column:
    return (F.col(f"{a}.start") > F.col(f"{b}.stop")) | (F.col(f"{a}.stop") < F.col(f"{b}.start")) | (F.col(f"{a}.chrom") != F.col(f"{b}.chrom"))


def skipped_exon_events(edges: DataFrame) -> DataFrame:
    """exon1 -> exon2 -> exon3 with exon1 -> exon3, exon2 before exon3 and not overlapping it.

    These are directed triangles. Every undirected pair is turned towards its busier exon, so
    the two edges that meet at the least busy exon of a triangle list it once and an exon with
    very many neighbours never pairs them all; the closing pair is an equi-join.
    """
    low, high = F.least("up", "down"), F.greatest("up", "down")
    side = F.when(F.col("up") < F.col("down"), "f").otherwise("r")
    pairs = edges.groupBy(low.alias("a"), high.alias("b")).agg(
        F.min(F.when(side == "f", F.col("junction"))).alias("f"), F.min(F.when(side == "r", F.col("junction"))).alias("r")
    )
    busy = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(by_merge(busy.select(F.col("x").alias("a"), F.col("d").alias("da"))), "a").join(by_merge(busy.select(F.col("x").alias("b"), F.col("d").alias("db"))), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    turned = ranked.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"),
        F.when(first, F.struct(F.col("db").alias("d"), F.col("b").alias("v"))).otherwise(F.struct(F.col("da").alias("d"), F.col("a").alias("v"))).alias("w"),
        F.when(first, F.col("f")).otherwise(F.col("r")).alias("out"), F.when(first, F.col("r")).otherwise(F.col("f")).alias("back"),
    )
    name = lambda df, t: df.select("u", *[F.col(c).alias(f"{c}_{t}") for c in ("w", "out", "back")])
    wedges = name(turned, "1").join(by_merge(name(turned, "2")), "u").filter(F.col("w_1") < F.col("w_2"))
    close = turned.select(F.col("u").alias("c_u"), F.col("w.v").alias("c_v"), F.col("out").alias("out_3"), F.col("back").alias("back_3"))
    triangles = wedges.join(by_merge(close), (F.col("w_1.v") == F.col("c_u")) & (F.col("w_2.v") == F.col("c_v")))
    x, y, z = F.col("u"), F.col("w_1.v"), F.col("w_2.v")
    link = {
        ("x", "y"): F.col("out_1"), ("y", "x"): F.col("back_1"), ("x", "z"): F.col("out_2"), ("z", "x"): F.col("back_2"),
        ("y", "z"): F.col("out_3"), ("z", "y"): F.col("back_3"),
    }
    node = {"x": x, "y": y, "z": z}
    orders = [("x", "y", "z"), ("x", "z", "y"), ("y", "x", "z"), ("y", "z", "x"), ("z", "x", "y"), ("z", "y", "x")]
    roles = [
        F.struct(
            node[i].alias("exon1"), node[j].alias("exon2"), node[k].alias("exon3"),
            link[(i, k)].alias("junction13"), link[(i, j)].alias("junction12"), link[(j, k)].alias("junction23"),
        )
        for i, j, k in orders
    ]
    found = triangles.select(F.explode(F.array(*roles)).alias("e")).select("e.*").filter(
        "junction13 IS NOT NULL AND junction12 IS NOT NULL AND junction23 IS NOT NULL"
    )
    at = edges.select(F.explode(F.array(F.struct(F.col("up").alias("x"), F.col("up_at").alias("p")), F.struct(F.col("down").alias("x"), F.col("down_at").alias("p")))).alias("e")).select("e.*").distinct()
    for exon in ("exon1", "exon2", "exon3"):
        found = found.join(by_merge(at.select(F.col("x").alias(exon), F.col("p").alias(f"{exon}_at"))), exon)
    return found.filter(_apart("exon2_at", "exon3_at") & (F.col("exon2_at.signed") < F.col("exon3_at.signed")))


def mutually_exclusive_events(edges: DataFrame) -> DataFrame:
    """exon1 -> exon2 -> exon4 and exon1 -> exon3 -> exon4, exon2 before exon3 and not overlapping it.

    These are cycles of four exons. Each is listed from its busiest exon: two steps lead from it over
    a less busy exon to the one across, so an exon with very many neighbours is never the middle of all
    pairs of them. If the busiest is exon1 or exon4, the paths between the two ends meet; if it is one of
    the middle exons, the shared starts of both middle exons meet their shared ends.
    """
    busy = edges.select(F.explode(F.array("up", "down")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    both = edges.select(F.explode(F.array(
        F.struct(F.col("up").alias("x"), F.col("down").alias("y"), F.col("junction").alias("j"), F.lit("out").alias("way")),
        F.struct(F.col("down").alias("x"), F.col("up").alias("y"), F.col("junction").alias("j"), F.lit("in").alias("way")),
    )).alias("e")).select("e.*")
    both = both.join(by_merge(busy.select(F.col("x"), F.struct("d", "x").alias("rank_x"))), "x")
    both = both.join(by_merge(busy.select(F.col("x").alias("y"), F.struct("d", F.col("x").alias("x")).alias("rank_y"))), "y")
    # from the middle exon m up to the busiest v, and on to u across
    rise = both.filter(F.col("rank_x") < F.col("rank_y")).select(F.col("x").alias("m"), F.col("y").alias("v"), F.col("j").alias("jv"), F.col("way").alias("to_v"), F.col("rank_y").alias("rank_v"))
    step = both.select(F.col("x").alias("m"), F.col("y").alias("u"), F.col("j").alias("ju"), F.col("way").alias("to_u"), F.col("rank_y").alias("rank_u"))
    wedges = rise.join(by_merge(step), "m").filter(F.col("rank_u") < F.col("rank_v")).drop("rank_u", "rank_v")

    through = F.col("to_v") != F.col("to_u")
    down = F.col("to_v") == "in"  # v -> m -> u
    paths = wedges.filter(through).select(
        F.when(down, F.col("v")).otherwise(F.col("u")).alias("exon1"), F.when(down, F.col("u")).otherwise(F.col("v")).alias("exon4"), "m",
        F.when(down, F.col("jv")).otherwise(F.col("ju")).alias("j1"), F.when(down, F.col("ju")).otherwise(F.col("jv")).alias("j2"),
    )
    ends = ["exon1", "exon4"]
    several = paths.groupBy(*ends).agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a <> b").select(*ends)
    paths = paths.join(by_merge(several), ends, "left_semi")
    lower = paths.select(*ends, F.col("m").alias("exon2"), F.col("j1").alias("junction12"), F.col("j2").alias("junction24"))
    upper = paths.select(*ends, F.col("m").alias("exon3"), F.col("j1").alias("junction13"), F.col("j2").alias("junction34"))
    by_ends = lower.join(by_merge(upper), ends).filter("exon2 <> exon3")

    starts = wedges.filter("to_v = 'out' AND to_u = 'out'").select("v", "u", F.col("m").alias("exon1"), F.col("jv").alias("sv"), F.col("ju").alias("su"))
    stops = wedges.filter("to_v = 'in' AND to_u = 'in'").select("v", "u", F.col("m").alias("exon4"), F.col("jv").alias("ev"), F.col("ju").alias("eu"))
    middles = starts.join(by_merge(stops), ["v", "u"]).filter("exon1 <> exon4")

    def order(two: str, three: str) -> Column:
        return F.struct(
            "exon1", "exon4", F.col(two).alias("exon2"), F.col(f"s{two}").alias("junction12"), F.col(f"e{two}").alias("junction24"),
            F.col(three).alias("exon3"), F.col(f"s{three}").alias("junction13"), F.col(f"e{three}").alias("junction34"),
        )

    by_middles = middles.select(F.explode(F.array(order("v", "u"), order("u", "v"))).alias("e")).select("e.*")
    found = by_ends.unionByName(by_middles)
    at = edges.select(F.explode(F.array(F.struct(F.col("up").alias("x"), F.col("up_at").alias("p")), F.struct(F.col("down").alias("x"), F.col("down_at").alias("p")))).alias("e")).select("e.*").distinct()
    for exon in ("exon1", "exon2", "exon3", "exon4"):
        found = found.join(by_merge(at.select(F.col("x").alias(exon), F.col("p").alias(f"{exon}_at"))), exon)
    return found.filter(_apart("exon2_at", "exon3_at") & (F.col("exon2_at.signed") < F.col("exon3_at.signed")))


def event_ids(events: DataFrame, splice_type: str) -> DataFrame:
    """Add ``event_id``, the joined ``exons`` and ``junctions``, and the strand of exon1."""
    one, two = ISOFORM_COMPONENTS[splice_type]
    name = F.concat(F.lit("isoform1="), F.concat_ws("@", *one), F.lit("|isoform2="), F.concat_ws("@", *two))
    return events.withColumns(
        {
            "event_id": name, "exons": F.concat_ws("@", *EXONS[splice_type]), "junctions": F.concat_ws("@", *JUNCTIONS[splice_type]),
            "strand": F.col("exon1_at.strand"), "splice_type": F.lit(splice_type),
        }
    )


def incompatible_junctions(events: DataFrame) -> DataFrame:
    """Add junction14 and junction23 of MXE events and their joined name.

    Both follow from the exons: they would join exon1 to exon4 and exon2 to exon3.
    """
    def between(a: str, b: str) -> Column:
        plus = F.col("strand") == "+"
        start = F.when(plus, F.col(f"{a}.stop")).otherwise(F.col(f"{b}.stop")) + 1
        stop = F.when(plus, F.col(f"{b}.start")).otherwise(F.col(f"{a}.start")) - 1
        return F.when(F.col("strand").isin("+", "-"), region_name("junction", F.col(f"{a}.chrom"), start, stop, F.col("strand")))

    one, two = between("exon1_at", "exon4_at"), between("exon2_at", "exon3_at")
    return events.withColumns({"junction14": one, "junction23": two, "incompatible_junctions": F.concat(one, F.lit("|"), two)})


def event_regions(events: DataFrame, splice_type: str) -> DataFrame:
    """Add exon lengths and the intron and event regions with their lengths."""
    first, last = "exon1_at", f"{EXONS[splice_type][-1]}_at"
    minus = F.col(f"{first}.strand") == "-"
    pick = lambda a, b: F.when(minus, F.col(a)).otherwise(F.col(b))
    i_start, i_stop = pick(f"{last}.stop", f"{first}.stop"), pick(f"{first}.start", f"{last}.start")
    e_start, e_stop = pick(f"{last}.start", f"{first}.start"), pick(f"{first}.stop", f"{last}.stop")
    chrom, strand = F.col(f"{first}.chrom"), F.col(f"{first}.strand")
    lengths = {f"{e}_length": F.col(f"{e}_at.stop") - F.col(f"{e}_at.start") + 1 for e in EXONS[splice_type]}
    return events.withColumns(
        {
            **lengths, "intron_length": i_stop - i_start + 1, "event_length": e_stop - e_start + 1,
            "intron_location": region_name("intron", chrom, i_start, i_stop, strand),
            "event_location": region_name("event", chrom, e_start, e_stop, strand),
        }
    )


def event_attributes(events: DataFrame, splice_type: str, attributes: DataFrame) -> DataFrame:
    """(event_id, isoform, key, value): attribute values shared by all exons of the isoform, joined by commas.

    ``attributes`` is long: (exon_id, key, value); ids of places and exons are ignored.
    """
    members = F.array(*[
        F.struct(F.lit(f"isoform{n + 1}").alias("isoform"), F.array(*exons).alias("exons"))
        for n, exons in enumerate(ISOFORM_EXONS[splice_type])
    ])
    listed = events.select("event_id", F.explode(members).alias("m")).select(
        "event_id", "m.isoform", F.size("m.exons").alias("n"), F.explode("m.exons").alias("exon_id")
    )
    useful = attributes.filter(~F.col("key").isin("location_id", "exon_id", "exon_number")).distinct()
    shared = listed.join(useful, "exon_id").groupBy("event_id", "isoform", "n", "key", "value").agg(F.count(F.lit(1)).alias("c"))
    # a key that occurs but is not shared stays, with an empty text; few values exist per exon
    kept = shared.groupBy("event_id", "isoform", "key").agg(F.array_sort(F.collect_set(F.when(F.col("c") == F.col("n"), F.col("value")))).alias("v"))
    return kept.select("event_id", "isoform", "key", F.concat_ws(",", "v").alias("value"))


def splice_sites(events: DataFrame, splice_type: str, chunks: DataFrame, chunk: int) -> DataFrame:
    """(event_id, isoform, pair, site, valid) for every neighbouring exon pair of the isoforms."""
    rows = []
    for n, exons in enumerate(ISOFORM_EXONS[splice_type]):
        for a, b in zip(exons, exons[1:]):
            rows.append(F.struct(F.lit(f"isoform{n + 1}").alias("isoform"), F.lit(f"{a}-{b}").alias("pair"), F.col(f"{a}_at").alias("a"), F.col(f"{b}_at").alias("b")))
    pairs = events.select("event_id", F.explode(F.array(*rows)).alias("p")).select("event_id", "p.*")
    minus = F.col("a.strand") == "-"
    donor = pairs.select(
        "event_id", "isoform", "pair", "b", F.col("a.chrom").alias("chrom"), F.col("a.strand").alias("strand"),
        F.when(minus, F.col("a.start") - 2).otherwise(F.col("a.stop") + 1).alias("start"),
        F.when(minus, F.col("a.start") - 1).otherwise(F.col("a.stop") + 2).alias("end"),
    )
    left = fetch_stranded(donor, chunks, chunk).withColumnRenamed("bases", "d").drop("start", "end")
    minus = F.col("b.strand") == "-"
    acceptor = left.withColumns({
        "start": F.when(minus, F.col("b.stop") + 1).otherwise(F.col("b.start") - 2),
        "end": F.when(minus, F.col("b.stop") + 2).otherwise(F.col("b.start") - 1),
    })
    both = fetch_stranded(acceptor, chunks, chunk)
    site = F.concat(F.coalesce("d", F.lit("")), F.lit("/"), F.coalesce("bases", F.lit("")))
    return both.select("event_id", "isoform", "pair", site.alias("site"), site.isin(*SPLICE_SITES).alias("valid"))


def validate_splice_sites(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Events all of whose exon pairs have an allowed site."""
    good = sites.groupBy("event_id").agg(F.bool_and("valid").alias("ok")).filter("ok")
    return events.join(good.select("event_id"), "event_id", "left_semi")


# Percent spliced-in ----------------------------------------------------------------------------


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def psi_note(iso1: Sequence[Column], iso2: Sequence[Column], incompatible: Column | None, m: int = MIN_READS, u: int = UNEVEN) -> Column:
    """The case text of one sample and event; cases in order, the first that fits."""
    both = [*iso1, *iso2]
    enough1, enough2 = _all([c >= m for c in iso1]), _all([c >= m for c in iso2])
    none1, none2 = _all([c < m for c in iso1]), _all([c < m for c in iso2])
    zero1, zero2 = _all([c == 0 for c in iso1]), _all([c == 0 for c in iso2])

    def uneven(pair: Sequence[Column]) -> Column:
        return F.lit(False) if len(pair) == 1 else F.greatest(*pair) + 1 > (F.least(*pair) + 1) * u

    total = reduce(lambda a, b: a + b, both)
    told = lambda text: F.when(total >= m * len(both), text.format("a") + ENOUGH).otherwise(text.format("b") + TOO_FEW)
    mixed = lambda pair: _any([c < m for c in pair]) & _any([c >= m for c in pair])
    steps = F.when(incompatible >= m, CASE_1.format(m=m)) if incompatible is not None else F.when(F.lit(False), "")
    return (
        steps.when(zero1 & zero2, CASE_2).when(none1 & none2, CASE_3)
        .when((~enough1 & none2) | (none1 & ~enough2), CASE_4)
        .when(uneven(iso1) | uneven(iso2), CASE_5.format(u=u))
        .when(enough1 & zero2, CASE_6).when(zero1 & enough2, CASE_7).when(enough1 & enough2, CASE_8)
        .when(enough1, told(CASE_9)).when(enough2, told(CASE_10)).when(mixed(iso1) | mixed(iso2), told(CASE_11))
        .otherwise("Case ???")
    )


def scored(note: Column) -> Column:
    return note.rlike("^Case (6|7|8|9a|10a|11a)")


def psi_value(iso1: Sequence[Column], iso2: Sequence[Column], method: str = "mean") -> Column:
    fold = {
        "mean": lambda pair: reduce(lambda a, b: a + b, pair) / len(pair),
        "min": lambda pair: F.least(*pair) if len(pair) > 1 else pair[0],
    }[method]
    one, two = fold(iso1).cast("double"), fold(iso2).cast("double")
    return F.try_divide(two, one + two)


def _count_columns(splice_type: str) -> list[str]:
    own = [f"isoform{n + 1}_{c}" for n, part in enumerate(ISOFORM_JUNCTIONS[splice_type]) for c in part]
    return own + [f"incompatible_{c}" for c in INCOMPATIBLE[splice_type]]


def _listed_events(events: DataFrame, splice_type: str) -> DataFrame:
    """(event_id, splice_type, junctions): every event once, with all of its own junctions known."""
    names = [*JUNCTIONS[splice_type], *INCOMPATIBLE[splice_type]]
    one_row = events.groupBy("event_id").agg(*[F.min(c).alias(c) for c in names]).dropna(subset=JUNCTIONS[splice_type])
    return stored(one_row.withColumn("splice_type", F.lit(splice_type)), "events")


def _whole_events(listed: DataFrame, present: DataFrame, splice_type: str) -> tuple[DataFrame, DataFrame]:
    """(event_id, splice_type) of the events all of whose own junctions occur in the data, and their (event_id, splice_type, role, junction_id)."""
    roles = F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(role.split("_", 1)[1]).alias("junction_id"), F.lit(not role.startswith("incompatible_")).alias("own"))
        for role in _count_columns(splice_type)
    ])
    long = listed.select("event_id", "splice_type", F.explode(roles).alias("r")).select("event_id", "splice_type", "r.*").filter("junction_id IS NOT NULL")
    # only events that lack a junction travel again, not those that have all
    own = F.array(*[F.col(c) for c in JUNCTIONS[splice_type]])
    absent = listed.select(F.explode(own).alias("junction_id")).distinct().join(by_merge(present), "junction_id", "left_anti")
    broken = long.filter("own").join(stored(absent, "absent"), "junction_id", "left_semi").select("event_id").distinct()
    kept = lambda df: df.join(broken, "event_id", "left_anti")
    return kept(listed.select("event_id", "splice_type")), kept(long).select("event_id", "splice_type", "role", "junction_id")


TILE = 64  # samples side by side in one row; longer rows would hold more zeros of sparse data


def number_samples(reads: DataFrame) -> DataFrame:
    """(sample_id, tile, slot): the samples in order, ``TILE`` to a tile."""
    ranked = running_before(stored(reads.select("sample_id").distinct(), "samples"), ["sample_id"], {"_at": F.lit(1).cast("long")})
    return stored(ranked.select("sample_id", F.floor(F.col("_at") / TILE).alias("tile"), (F.col("_at") % TILE).cast("int").alias("slot")), "samples")


def _read_tiles(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """(junction_id, tile, reads): the reads of a tile's samples by slot, zero where there are none."""
    numbered = reads.join(samples, reads.sample_id.eqNullSafe(samples.sample_id)).select("junction_id", "tile", "slot", "reads")
    # one exchange for both sums
    dealt = numbered.repartition("junction_id", "tile").groupBy("junction_id", "tile", "slot").agg(F.sum("reads").alias("reads"))
    held = dealt.groupBy("junction_id", "tile").agg(F.map_from_entries(F.collect_list(F.struct("slot", "reads"))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(TILE - 1))
    return held.select("junction_id", "tile", F.transform(slots, lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long"))).alias("reads"))


@dataclass
class SparsePsi:
    """A PSI table with a default: ``rows`` holds every pair with a read, any other pair of a scored event and a known sample reads "Case 2" without a value.

    ``tiles`` holds the reads of an event's junctions over a tile of samples in one row, so that event ids,
    which are long, travel once per tile and not once per sample.
    """

    tiles: DataFrame  # (event_id, splice_type, tile, one array of reads per count column)
    events: DataFrame  # (event_id, splice_type), every scored event once
    samples: DataFrame  # (sample_id, tile, slot), every sample once
    kinds: tuple[str, ...] = ("se", "mxe")
    min_reads: int = MIN_READS
    uneven: int = UNEVEN
    method: str = "mean"

    @property
    def counts(self) -> list[str]:
        return list(dict.fromkeys(c for k in self.kinds for c in _count_columns(k)))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """The table's columns of rows (sample_id, event_id, splice_type, c), ``c`` the struct of all counts."""
        notes, values = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
        for kind in self.kinds:
            iso1, iso2 = [[F.col(f"c.isoform{n + 1}_{c}") for c in part] for n, part in enumerate(ISOFORM_JUNCTIONS[kind])]
            extra = [F.col(f"c.incompatible_{c}") for c in INCOMPATIBLE[kind]]
            mine = F.col("splice_type") == kind
            notes = notes.when(mine, psi_note(iso1, iso2, F.greatest(*extra) if extra else None, self.min_reads, self.uneven))
            values = values.when(mine, psi_value(iso1, iso2, self.method))
        own = lambda c: F.col("splice_type").isin(*[k for k in self.kinds if c in _count_columns(k)])
        first = _count_columns(self.kinds[0])
        column = {c: F.when(own(c), F.col(f"c.{c}")).alias(c) for c in self.counts}
        return pairs.withColumn("notes", notes).select(
            "sample_id", "event_id", *[column[c] for c in first], F.when(scored(F.col("notes")), values).alias("psi"), "notes", "splice_type",
            *[column[c] for c in self.counts if c not in first],
        )

    @property
    def rows(self) -> DataFrame:
        """The pairs with a read on any of the event's junctions."""
        listed = self.samples.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("slot", "sample_id"))).alias("_s"))
        zipped = F.arrays_zip(F.col("_s.sample_id").alias("sample_id"), *self.counts)
        read = self.tiles.join(listed, "tile").select("event_id", "splice_type", F.explode(zipped).alias("c"))
        read = read.filter(_any([F.col(f"c.{c}") > 0 for c in self.counts]))
        return self._scored(read.select(F.col("c.sample_id").alias("sample_id"), "event_id", "splice_type", "c"))

    def lookup(self, pairs: DataFrame) -> DataFrame:
        """The row of each pair (sample_id, event_id), stored or default; pairs of unknown samples or events give none."""
        asked = pairs.select("sample_id", "event_id").join(self.samples, "sample_id").repartition("event_id", "tile")
        asked = asked.groupBy("event_id", "tile").agg(F.collect_list(F.struct("slot", "sample_id")).alias("_a"))
        # packed in files, millions of long ids look small enough for a broadcast
        found = asked.join(self.events.hint("merge"), "event_id").join(self.tiles.drop("splice_type").hint("merge"), ["event_id", "tile"], "left")
        at = found.select("event_id", "splice_type", F.explode("_a").alias("a"), *self.counts)
        count = lambda c: F.coalesce(F.get(c, F.col("a.slot")), F.lit(0).cast("long")).alias(c)
        return self._scored(at.select(F.col("a.sample_id").alias("sample_id"), "event_id", "splice_type", F.struct(*[count(c) for c in self.counts]).alias("c")))

    def case_counts(self) -> DataFrame:
        """(splice_type, notes, n) over all pairs; those not stored are counted, not listed."""
        stored_rows = self.rows.groupBy("splice_type", "notes").agg(F.count(F.lit(1)).alias("n"))
        samples = self.samples.agg(F.count(F.lit(1))).scalar()
        rest = self.events.groupBy("splice_type").agg((F.count(F.lit(1)) * samples).alias("n")).withColumn("notes", F.lit(CASE_2))
        held = stored_rows.select("splice_type", (-F.col("n")).alias("n"), F.lit(CASE_2).alias("notes"))
        every = stored_rows.unionByName(rest).unionByName(held)
        return every.groupBy("splice_type", "notes").agg(F.sum("n").alias("n")).filter("n > 0")


def sparse_psi(
    se: DataFrame | None, mxe: DataFrame | None, reads: DataFrame, min_reads: int = MIN_READS, uneven: int = UNEVEN, method: str = "mean"
) -> SparsePsi:
    """Scores of the events whose junctions all occur in ``reads`` (sample_id, junction_id, reads)."""
    samples = number_samples(reads)
    packs = stored(_read_tiles(reads, samples), "tiles")
    present = packs.select("junction_id").distinct()
    given = {t: _whole_events(_listed_events(e, t), present, t) for e, t in ((se, "se"), (mxe, "mxe")) if e is not None}
    kinds = tuple(given)
    counts = list(dict.fromkeys(c for k in kinds for c in _count_columns(k)))
    key = ["event_id", "splice_type", "tile"]
    zeros = F.array_repeat(F.lit(0).cast("long"), TILE)
    hits = reduce(DataFrame.unionByName, [long for _, long in given.values()]).join(by_merge(packs), "junction_id")
    # rows meet before they are summed up: there is one of a role and tile; steps by event find them where they are
    met = hits.repartition("event_id").groupBy(*key).agg(*[F.max(F.when(F.col("role") == c, F.col("reads"))).alias(c) for c in counts])
    tiles = met.withColumns({c: F.coalesce(c, zeros) for c in counts})
    return SparsePsi(tiles, reduce(DataFrame.unionByName, [whole for whole, _ in given.values()]), samples, kinds, min_reads, uneven, method)


def psi_table(
    se: DataFrame | None, mxe: DataFrame | None, reads: DataFrame, min_reads: int = MIN_READS, uneven: int = UNEVEN, method: str = "mean"
) -> DataFrame:
    """(sample_id, event_id, isoform reads, incompatible reads, psi, notes, splice_type) of SE and MXE events.

    ``reads``: (sample_id, junction_id, reads). Only events whose junctions all occur in the data
    are scored. Samples without a read on any of an event's junctions are left out: they are
    exactly the "Case 2" rows with a NULL psi, which `SparsePsi.lookup` gives.
    """
    return sparse_psi(se, mxe, reads, min_reads, uneven, method).rows
