"""Domain tables derived from the driver's Parquet tables, as lazy views (FIXTURES.md, B1-B10).

Each ``bN`` returns a DataFrame; ``SQL["bN"]`` is the same definition for the check engine.
Order-bearing tables carry ``line_no``: here a struct of the full row, which sorts like the
row number over the full row without a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


class Tables:
    """The driver's tables of one folder, plus the bindings over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _lines_orders(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        return self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def b1(self, lines: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Exon annotation; of ``lines``, the line items with further columns ``keep``, if given."""
        s = F.col("l_suppkey")
        start = F.col("l_partkey") * 10
        gene = F.concat(F.lit("gene"), s.cast("string"))
        return (self.read("lineitem") if lines is None else lines).select(
            *keep,
            F.struct(*LINE_COLUMNS).alias("line_no"),
            gene.alias("gene_id"),
            F.when(s % 11 != 0, F.concat(F.lit("N"), (s % 37).cast("string"))).alias("gene_name"),
            F.concat(gene, F.lit("-t"), (F.col("l_linenumber") % 3).cast("string")).alias("transcript_id"),
            F.concat(F.lit("chr"), (s % 5 + 1).cast("string")).alias("seqname"),
            F.when(s % 2 == 0, "+").otherwise("-").alias("strand"),
            start.alias("start"),
            (start + F.floor("l_quantity") - 1).alias("end"),
            F.col("l_linenumber").cast("string").alias("exon_number"),
            F.when(F.col("l_orderkey") % 10 == 0, "CDS").otherwise("exon").alias("feature"),
        )

    def b1_exons(self) -> DataFrame:
        """B1 with every row read as an exon."""
        return self.b1().withColumn("feature", F.lit("exon"))

    def b2(self, fold_exons: bool = False, samples: bool = False) -> DataFrame:
        """Exon counts per cell. ``fold_exons`` wraps the exon number into the gene's 1..n of B3."""
        s = F.col("l_suppkey")
        n = s % 7 + 1
        exon = F.col("l_linenumber").cast("long")
        exon = (F.pmod(exon - 1, n) + 1) if fold_exons else exon
        keys = [
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cell_id"),
            F.concat(F.lit("gene"), s.cast("string")).alias("gene_id"),
            F.concat(F.when(s % 10 == 0, "MT-").otherwise(""), F.lit("gene"), s.cast("string")).alias("gene_name"),
            exon.alias("exon_number"),
        ]
        if samples:
            keys.append(F.col("o_orderpriority").alias("sample"))
        return self._lines_orders().groupBy(*keys).agg(F.sum("l_quantity").alias("count"))

    def genes(self) -> DataFrame:
        """The suppliers as genes: (gene_id, gene_name, gene_number, n)."""
        s = F.col("s_suppkey")
        return self.read("supplier").select(
            F.concat(F.lit("gene"), s.cast("string")).alias("gene_id"),
            F.concat(F.when(s % 10 == 0, "MT-").otherwise(""), F.lit("gene"), s.cast("string")).alias("gene_name"),
            s.alias("gene_number"),
            (s % 7 + 1).alias("n"),
        )

    def exons(self, fixed: int | None = None) -> DataFrame:
        """Exon i of a gene is [100i, 100i+49], i = 1..n (or 1..fixed)."""
        last = F.lit(fixed).cast("long") if fixed else F.col("n")
        listed = self.genes().withColumn("exon_number", F.explode(F.sequence(F.lit(1).cast("long"), last)))
        return listed.select(
            F.struct("gene_number", "exon_number").alias("line_no"), "gene_id", "gene_name", "exon_number",
            (F.col("exon_number") * 100).alias("start"), (F.col("exon_number") * 100 + 49).alias("end"),
        )

    def b3(self) -> DataFrame:
        """Junction rows per cell."""
        s = F.col("l_suppkey")
        start = 100 * F.col("l_linenumber").cast("long") + F.col("l_partkey") % 120 - 60
        return self._lines_orders().select(
            F.struct(*LINE_COLUMNS).alias("line_no"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cell_id"),
            F.concat(F.lit("gene"), s.cast("string")).alias("gene_id"),
            F.concat(F.lit("chr"), (s % 5 + 1).cast("string")).alias("chrom"),
            (s % 3).cast("long").alias("strand"),
            start.alias("start"),
            (start + 40 + F.floor("l_extendedprice") % 400).alias("end"),
            F.floor("l_quantity").alias("uniq"),
            F.round(F.col("l_discount") * 100).cast("long").alias("multi"),
            (F.col("l_linenumber") % 7).cast("long").alias("motif"),
            (F.col("l_returnflag") == "R").cast("long").alias("annotated"),
            (F.col("l_partkey") % 50).alias("max_overhang"),
            F.col("l_partkey").alias("part_key"),
            F.col("o_orderpriority").alias("sample"),
        )

    def b3_places(self) -> DataFrame:
        """(chrom, start, end, annotated) of B3's rows, cut down before they are joined with the orders."""
        start = 100 * F.col("l_linenumber").cast("long") + F.col("l_partkey") % 120 - 60
        lines = self.read("lineitem").select(
            "l_orderkey", (F.col("l_suppkey") % 5 + 1).cast("int").alias("c"), start.alias("start"),
            (start + 40 + F.floor("l_extendedprice") % 400).alias("end"), (F.col("l_returnflag") == "R").cast("long").alias("annotated"),
        )
        rows = lines.join(self.read("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(F.concat(F.lit("chr"), F.col("c").cast("string")).alias("chrom"), "start", "end", "annotated")

    def gene_tokens(self) -> DataFrame:
        """Comma lists of gene tokens for both ends of a junction, per part."""
        k = F.col("p_partkey")
        one = (
            F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, F.lit("NA"))
            .when(k % 6 == 2, F.col("p_brand"))
            .otherwise(F.concat("p_brand", F.lit(","), "p_type"))
        )
        two = (
            F.when(k % 5 == 0, F.concat(F.lit(" "), "p_brand", F.lit(" ,NA")))
            .when(k % 5 == 1, F.concat("p_type", F.lit(","), "p_type"))
            .when(k % 5 == 2, F.lit(""))
            .otherwise(F.concat("p_type", F.lit(","), "p_brand"))
        )
        return self.read("part").select(k.alias("part_key"), one.alias("gene_sp1"), two.alias("gene_sp2"))

    def b3p(self) -> DataFrame:
        """Junction rows pooled onto the samples of the embedding table."""
        s = F.col("l_suppkey")
        cells = self.read("embeddings").agg(F.count(F.lit(1))).scalar()
        a = F.col("l_linenumber").cast("long")
        b = a + 1 + F.col("l_partkey") % 3
        rows = self._lines_orders().select(
            (F.col("o_custkey") % cells).alias("sample_id"),
            F.concat(F.lit("chr"), (s % 10 + 1).cast("string")).alias("chrom"),
            (100 * a + 50).alias("start"), (100 * b - 1).alias("end"), b.alias("b"),
            (s % 3).cast("long").alias("strand"), (F.col("l_linenumber") % 7).cast("long").alias("motif"),
            (F.col("l_returnflag") == "R").cast("long").alias("annotated"),
            F.floor("l_quantity").alias("uniq"), F.round(F.col("l_discount") * 100).cast("long").alias("multi"),
            (F.col("l_partkey") % 50).alias("max_overhang"),
        )
        return rows.filter("b <= 7").groupBy("sample_id", "chrom", "start", "end").agg(
            F.max("strand").alias("strand"), F.max("motif").alias("motif"), F.max("annotated").alias("annotated"),
            F.sum("uniq").cast("double").alias("uniq"), F.max("multi").cast("double").alias("multi"),
            F.max("max_overhang").alias("max_overhang"),
        )

    def b4(self) -> DataFrame:
        """Embedding."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("x_z"),
            F.col("label").cast("long").alias("label"),
        )

    def b4_reads(self, junctions: DataFrame | None = None) -> DataFrame:
        """Reads per cell of the embedding, from ``junctions`` if B3p is at hand."""
        totals = (junctions or self.b3p()).groupBy("sample_id").agg(F.sum(F.col("uniq") + F.col("multi")).alias("num_seqs"))
        cells = self.b4().select(F.col("cell_id").alias("sample_id"))
        return cells.join(totals, "sample_id", "left").fillna({"num_seqs": 0.0})

    def b5(self) -> DataFrame:
        """Splice reads per sample and junction; every gene is its own contig."""
        s = F.col("l_suppkey")
        a = F.col("l_linenumber").cast("long")
        rows = self.read("lineitem").select(
            (F.col("l_partkey") % 50).alias("sample_id"),
            F.concat(F.lit("gene"), s.cast("string")).alias("gene_id"),
            F.concat(F.lit("chr"), s.cast("string")).alias("chrom"),
            F.when(s % 2 == 0, "+").otherwise("-").alias("strand"),
            a.alias("a"), (a + 1 + F.col("l_partkey") % 3).alias("b"), F.floor("l_quantity").alias("q"),
        ).filter("b <= 7")
        # a junction's samples lie together, so later steps shuffle it once and not once per sample
        return rows.repartition("chrom", "a", "b").groupBy("sample_id", "gene_id", "chrom", "strand", "a", "b").agg(
            F.sum("q").alias("reads")
        ).select(
            "*", (100 * F.col("a") + 50).alias("start"), (100 * F.col("b") - 1).alias("stop"),
            F.format_string("junction:%s:%d-%d:%s", "chrom", 100 * F.col("a") + 50, 100 * F.col("b") - 1, "strand").alias("junction_id"),
        )

    def b5_exons(self) -> DataFrame:
        """The seven exons of each contig of B5, with the gene attributes used by the event tables."""
        s = F.col("s_suppkey")
        listed = self.read("supplier").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))))
        chrom = F.concat(F.lit("chr"), s.cast("string"))
        strand = F.when(s % 2 == 0, "+").otherwise("-")
        start, stop = F.col("i") * 100, F.col("i") * 100 + 49
        return listed.select(
            F.format_string("exon:%s:%d-%d:%s", chrom, start, stop, strand).alias("exon_id"),
            chrom.alias("chrom"), start.alias("start"), stop.alias("stop"), strand.alias("strand"),
            F.concat(F.lit("gene"), s.cast("string")).alias("gene_id"),
            F.when(s % 11 != 0, F.concat(F.lit("N"), (s % 37).cast("string"))).alias("gene_name"),
            F.concat(F.lit("t"), (F.col("i") % 2).cast("string")).alias("transcript_id"),
        )

    def b6(self) -> DataFrame:
        """Cell metadata with repeated, conflicting barcodes."""
        k = F.col("c_custkey")
        nations = self.read("nation").select("n_nationkey", "n_name")
        return self.read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            k.alias("cell_pos"),
            F.concat(F.lit("BC"), (k % 300).cast("string"), F.lit("-1_"), "c_mktsegment").alias("CB"),
            F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
        )

    def b7(self) -> DataFrame:
        """Marker input: exon counts with the cell's cluster."""
        cells = self.read("customer").select(
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("cell_id"),
            F.col("c_mktsegment").alias("cluster"),
        )
        feature = F.concat("gene_id", F.lit("-"), F.col("exon_number").cast("string"))
        counts = self.b2().select("cell_id", feature.alias("feature_id"), F.col("count").alias("value"))
        return counts.join(cells, "cell_id")

    def b7_cells(self) -> DataFrame:
        """Cells with any count, and their cluster."""
        return self.b7().select("cell_id", "cluster").distinct()

    def b8(self) -> DataFrame:
        """Reference sequence: 32 bases per chunk."""
        from introna.operators.scans import running_before

        chunks = self.read("documents").select(
            (F.col("doc_id") % 5).alias("residue"), "doc_id",
            F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"),
        )
        # rank of the document inside its chromosome, from one running count per chromosome
        marks = {f"_r{i}": (F.col("residue") == i).cast("long") for i in range(5)}
        ranked = running_before(chunks, ["doc_id"], marks)
        rank = F.element_at(F.array(*[F.col(f"_r{i}") for i in range(5)]), (F.col("residue") + 1).cast("int"))
        return ranked.select(
            F.concat(F.lit("chr"), (F.col("residue") + 1).cast("string")).alias("chrom"),
            rank.alias("chunk_no"), "seq",
        )

    def b9(self) -> DataFrame:
        """Alignment lines as text, with the values they were written from."""
        s, k = F.col("l_suppkey"), F.col("l_partkey")
        text = lambda c: c.cast("string")
        barcode = F.concat(F.lit("BC"), text(F.col("l_orderkey") % 300))
        tags = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("CB:Z:"), barcode, F.lit("\tRG:Z:old"))).otherwise("RG:Z:old")
        cigar = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("50M"), text(100 + k % 7 * 10), F.lit("N50M"))).otherwise("100M")
        line = F.concat_ws(
            "\t",
            F.concat_ws(".", text(F.col("l_orderkey")), text(F.col("l_linenumber")), text(k)),
            F.when(s % 2 == 1, "16").otherwise("0"),
            F.concat(F.lit("chr"), text(s % 5 + 1)),
            text(k * 10),
            F.when(F.col("l_tax") < 0.03, "255").otherwise("3"),
            cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), tags,
        )
        return self.read("lineitem").select(line.alias("value"))

    def b10(self, items: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Annotation lines as text; of the line items ``items`` with further columns ``keep``, if given."""
        name = F.when(F.col("gene_name").isNotNull(), F.concat(F.lit('gene_name "'), "gene_name", F.lit('"; ')))
        attributes = F.concat(
            F.lit('gene_id "'), "gene_id", F.lit('"; '), F.coalesce(name, F.lit("")),
            F.lit('transcript_id "'), "transcript_id", F.lit('"; exon_number "'), "exon_number", F.lit('";'),
        )
        rows = self.b1(items, keep)
        lines = rows.select(
            *keep, "line_no",
            F.concat_ws(
                "\t", "seqname", F.lit("driver"), "feature", F.col("start").cast("string"),
                F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes,
            ).alias("value"),
        )
        header = self.read("region").select(
            *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in (*keep, "line_no")],
            F.concat(F.lit("#!region "), "r_name").alias("value"),
        )
        return header.unionByName(lines)


_ROW = ", ".join(LINE_COLUMNS)

SQL = {
    "lo": "lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "b1": f"""b1 AS (SELECT row_number() OVER (ORDER BY {_ROW}) AS line_no,
  'gene' || l_suppkey AS gene_id, CASE WHEN l_suppkey % 11 <> 0 THEN 'N' || (l_suppkey % 37) END AS gene_name,
  'gene' || l_suppkey || '-t' || (l_linenumber % 3) AS transcript_id, 'chr' || (l_suppkey % 5 + 1) AS seqname,
  CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey * 10 AS "start",
  l_partkey * 10 + CAST(floor(l_quantity) AS BIGINT) - 1 AS "end", CAST(l_linenumber AS VARCHAR) AS exon_number,
  CASE WHEN l_orderkey % 10 = 0 THEN 'CDS' ELSE 'exon' END AS feature FROM lineitem)""",
    "b2": """b2 AS (SELECT 'C' || o_custkey AS cell_id, 'gene' || l_suppkey AS gene_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 'MT-' ELSE '' END || 'gene' || l_suppkey AS gene_name,
  CAST(l_linenumber AS BIGINT) AS exon_number, sum(l_quantity) AS "count" FROM lo GROUP BY ALL)""",
    "b2s": """b2s AS (SELECT 'C' || o_custkey AS cell_id, 'gene' || l_suppkey AS gene_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 'MT-' ELSE '' END || 'gene' || l_suppkey AS gene_name,
  CAST(l_linenumber AS BIGINT) AS exon_number, o_orderpriority AS sample, sum(l_quantity) AS "count"
  FROM lo GROUP BY ALL)""",
    "b2f": """b2f AS (SELECT 'C' || o_custkey AS cell_id, 'gene' || l_suppkey AS gene_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 'MT-' ELSE '' END || 'gene' || l_suppkey AS gene_name,
  CAST((l_linenumber - 1) % (l_suppkey % 7 + 1) + 1 AS BIGINT) AS exon_number, sum(l_quantity) AS "count"
  FROM lo GROUP BY ALL)""",
    "genes": """genes AS (SELECT 'gene' || s_suppkey AS gene_id,
  CASE WHEN s_suppkey % 10 = 0 THEN 'MT-' ELSE '' END || 'gene' || s_suppkey AS gene_name,
  s_suppkey AS gene_number, s_suppkey % 7 + 1 AS n FROM supplier)""",
    "exons": """exons AS (SELECT gene_id, gene_name, gene_number, i AS exon_number, i * 100 AS "start", i * 100 + 49 AS "end",
  row_number() OVER (ORDER BY gene_number, i) - 1 AS exon_pos
  FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM genes))""",
    "exons7": """exons7 AS (SELECT gene_id, gene_name, gene_number, i AS exon_number, i * 100 AS "start", i * 100 + 49 AS "end",
  row_number() OVER (ORDER BY gene_number, i) - 1 AS exon_pos
  FROM (SELECT *, unnest(generate_series(1, 7)) AS i FROM genes))""",
    "b3": f"""b3 AS (SELECT row_number() OVER (ORDER BY {_ROW}) AS line_no, 'C' || o_custkey AS cell_id,
  'gene' || l_suppkey AS gene_id, 'chr' || (l_suppkey % 5 + 1) AS chrom, l_suppkey % 3 AS strand,
  100 * l_linenumber + l_partkey % 120 - 60 AS "start",
  100 * l_linenumber + l_partkey % 120 - 60 + 40 + CAST(floor(l_extendedprice) AS BIGINT) % 400 AS "end",
  CAST(floor(l_quantity) AS BIGINT) AS uniq, CAST(round(l_discount * 100) AS BIGINT) AS multi,
  CAST(l_linenumber % 7 AS BIGINT) AS motif, CAST(l_returnflag = 'R' AS BIGINT) AS annotated,
  l_partkey % 50 AS max_overhang, l_partkey AS part_key, o_orderpriority AS sample FROM lo)""",
    "tokens": """tokens AS (SELECT p_partkey AS part_key,
  CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 'NA' WHEN p_partkey % 6 = 2 THEN p_brand
    ELSE p_brand || ',' || p_type END AS gene_sp1,
  CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_brand || ' ,NA' WHEN p_partkey % 5 = 1 THEN p_type || ',' || p_type
    WHEN p_partkey % 5 = 2 THEN '' ELSE p_type || ',' || p_brand END AS gene_sp2 FROM part)""",
    "b3p": """b3p AS (SELECT o_custkey % (SELECT count(*) FROM embeddings) AS sample_id, 'chr' || (l_suppkey % 10 + 1) AS chrom,
  100 * l_linenumber + 50 AS "start", 100 * (l_linenumber + 1 + l_partkey % 3) - 1 AS "end",
  max(l_suppkey % 3) AS strand, CAST(max(l_linenumber % 7) AS BIGINT) AS motif,
  max(CAST(l_returnflag = 'R' AS BIGINT)) AS annotated, CAST(sum(floor(l_quantity)) AS DOUBLE) AS uniq,
  CAST(max(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS multi, max(l_partkey % 50) AS max_overhang
  FROM lo WHERE l_linenumber + 1 + l_partkey % 3 <= 7 GROUP BY 1, 2, 3, 4)""",
    "b4": """b4 AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS x_z, CAST(label AS BIGINT) AS label FROM embeddings)""",
    "b4_reads": """b4_reads AS (SELECT cell_id AS sample_id, coalesce(t, 0.0) AS num_seqs FROM b4 LEFT JOIN
  (SELECT sample_id, sum(uniq + multi) AS t FROM b3p GROUP BY 1) q ON cell_id = q.sample_id)""",
    "b5": """b5 AS (SELECT *, 100 * a + 50 AS "start", 100 * b - 1 AS stop,
  'junction:' || chrom || ':' || (100 * a + 50) || '-' || (100 * b - 1) || ':' || strand AS junction_id FROM (
  SELECT l_partkey % 50 AS sample_id, 'gene' || l_suppkey AS gene_id, 'chr' || l_suppkey AS chrom,
  CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(l_linenumber AS BIGINT) AS a,
  l_linenumber + 1 + l_partkey % 3 AS b, CAST(sum(floor(l_quantity)) AS BIGINT) AS reads
  FROM lineitem WHERE l_linenumber + 1 + l_partkey % 3 <= 7 GROUP BY ALL))""",
    "b5_exons": """b5_exons AS (SELECT 'exon:' || chrom || ':' || "start" || '-' || stop || ':' || strand AS exon_id, * FROM (
  SELECT 'chr' || s_suppkey AS chrom, i * 100 AS "start", i * 100 + 49 AS stop,
  CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'gene' || s_suppkey AS gene_id,
  CASE WHEN s_suppkey % 11 <> 0 THEN 'N' || (s_suppkey % 37) END AS gene_name, 't' || (i % 2) AS transcript_id
  FROM (SELECT *, unnest(generate_series(1, 7)) AS i FROM supplier)))""",
    "b6": """b6 AS (SELECT c_custkey AS cell_pos, 'BC' || (c_custkey % 300) || '-1_' || c_mktsegment AS CB,
  c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "b7": """b7 AS (SELECT cell_id, gene_id || '-' || exon_number AS feature_id, "count" AS value, c_mktsegment AS cluster
  FROM b2 JOIN customer ON cell_id = 'C' || c_custkey)""",
    "b8": """b8 AS (SELECT 'chr' || (doc_id % 5 + 1) AS chrom, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - 1 AS chunk_no,
  translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents)""",
    "b9": """b9 AS (SELECT l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name,
  CASE WHEN l_suppkey % 2 = 1 THEN 16 ELSE 0 END AS flag, 'chr' || (l_suppkey % 5 + 1) AS chrom, l_partkey * 10 AS pos,
  CASE WHEN l_tax < 0.03 THEN 255 ELSE 3 END AS mapq, l_linestatus = 'F' AS spliced, 100 + l_partkey % 7 * 10 AS gap,
  CASE WHEN l_linestatus = 'F' THEN '50M' || (100 + l_partkey % 7 * 10) || 'N50M' ELSE '100M' END AS cigar,
  CASE WHEN l_linenumber <> 7 THEN 'BC' || (l_orderkey % 300) END AS barcode,
  CASE WHEN l_suppkey % 2 = 1 THEN '-' ELSE '+' END AS strand FROM lineitem)""",
}

NEEDS = {
    "b2": ["lo"], "b2s": ["lo"], "b2f": ["lo"], "b3": ["lo"], "b3p": ["lo"], "exons": ["genes"], "exons7": ["genes"],
    "b4_reads": ["b4", "b3p"], "b7": ["b2"],
}


def with_sql(names: str, body: str) -> str:
    """``WITH`` the named bindings (and what they need) before ``body``; ``body`` may go on with
    more CTEs when it starts with a comma."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(SQL[n] for n in ordered)
    return f"WITH {head}{body}" if body.lstrip().startswith(",") else f"WITH {head}\n{body}"
