"""A synthetic genome over the driver's tables, from functions that Spark and DuckDB evaluate alike.

Transcripts come from `part`: 1 to 4 exons of 90 bases, 50 bases apart, on five chromosomes, 100 bases between starts.
Variants come from `lineitem`. One template gives the SQL of both engines; the Spark side adds the nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DNA = "translate({}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _sql(text: str, duck: bool) -> str:
    return text.replace("{div}", "//" if duck else "div").replace("{text}", "VARCHAR" if duck else "STRING").replace("{cat}", "||")


TX = """
SELECT k, 'ENST' {cat} lpad(CAST(k AS {text}), 6, '0') {cat} '.' {cat} CAST(k % 9 + 1 AS {text}) AS transcript_id, 'ENSG' {cat} lpad(CAST(k % 400 AS {text}), 6, '0') AS gene_id,
  'GENE' {cat} CAST(k % 400 AS {text}) AS gene_name, CAST(k % 5 + 1 AS {text}) AS chrom, 1000 + (k {div} 5) * 100 AS s, 1000 + (k {div} 5) * 100 + (n - 1) * 140 + 89 AS e, n,
  CASE WHEN (k {div} 2) % 2 = 0 THEN 1 ELSE -1 END AS strand,
  CASE WHEN k % 8 = 0 THEN 'miRNA' WHEN k % 4 = 0 THEN 'lncRNA' WHEN k % 7 = 0 THEN 'nonsense_mediated_decay' ELSE 'protein_coding' END AS biotype,
  k % 5 < 2 AS canonical, k % 3 = 0 AS msk_canonical, k % 10 = 1 AS mane_select,
  CASE WHEN k % 4 = 0 THEN 0 ELSE 1000 + (k {div} 5) * 100 + 20 END AS cds_start, CASE WHEN k % 4 = 0 THEN 0 ELSE 1000 + (k {div} 5) * 100 + (n - 1) * 140 + 64 END AS cds_end,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'ATG' {cat} substr(""" + " {cat} ".join(DNA.format(f"md5(CAST(k AS {{text}}) {{cat}} '-{j}')") for j in range(1, 11)) + """, 1, CAST(90 * n - 51 AS INT)) {cat} 'TAA' END AS cds_sequence,
  CASE WHEN k % 4 = 0 THEN '' ELSE """ + DNA.format("md5('u' {cat} CAST(k AS {text}))") + """ END AS utr3_sequence
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(1 + p_size % 4 AS BIGINT) AS n FROM part) p
"""  # fmt: skip

VARIANTS = """
SELECT record_id, chrom, pos, kind, ln,
  CASE kind WHEN 0 THEN substr(h, 1, 2 + ln % 4) WHEN 2 THEN substr(h, 1, 2) ELSE substr(h, 1, 1) END AS ref,
  CASE kind WHEN 0 THEN substr(h, 1, 1) WHEN 1 THEN substr(h, 1, 2 + ln % 4) WHEN 2 THEN translate(substr(h, 1, 2), 'ACGT', 'CGTA')
    ELSE translate(substr(h, 1, 1), 'ACGT', CASE ln % 3 WHEN 0 THEN 'CGTA' WHEN 1 THEN 'GTAC' ELSE 'TACG' END) END AS alt
FROM (SELECT CAST(((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS BIGINT) AS record_id, CAST(l_partkey % 5 + 1 AS {text}) AS chrom, CAST(1000 + (l_partkey {div} 5) * 100 + (l_orderkey * 7 + l_linenumber * 37) % 600 AS BIGINT) AS pos,
  CAST(CASE WHEN l_orderkey % 10 < 3 THEN l_orderkey % 10 ELSE 3 END AS INT) AS kind, CAST(l_linenumber AS INT) AS ln,
  """ + DNA.format("md5(CAST(l_orderkey AS {text}) {cat} '-' {cat} CAST(l_linenumber AS {text}) {cat} '-' {cat} CAST(l_partkey AS {text}) {cat} '-' {cat} CAST(l_suppkey AS {text}))") + """ AS h FROM lineitem) l
"""  # fmt: skip


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def dealt(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt to all cores by their values before anything is worked out from them: prediction is work, and
    a file of any size can be one row group."""
    df = spark.read.parquet(path).select(*columns)
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions()), *columns)


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the engine's transcript schema, with k and n besides."""
    t = spark.sql(_sql(TX, False).replace("FROM part)", "FROM {part})"), part=dealt(spark, f"{sf_dir}/part.parquet", "p_partkey", "p_size"))
    part = "CASE WHEN cds_start = 0 THEN 0 WHEN {0} THEN {1} ELSE {2} END"
    exon = f"named_struct('number', CAST(CASE WHEN strand = 1 THEN i + 1 ELSE n - i END AS INT), 'start', s + 140 * i, 'end', s + 140 * i + 89, 'cds_start', {part.format('i = 0', 'cds_start', 's + 140 * i')}, 'cds_end', {part.format('i = n - 1', 'cds_end', 's + 140 * i + 89')}, 'frame', 0)"
    offset = "CASE WHEN strand = 1 THEN greatest(90 * i - 20, 0) ELSE greatest(90 * (n - 1 - i) - 25, 0) END"
    region = f"named_struct('start', {part.format('i = 0', 'cds_start', 's + 140 * i')}, 'end', {part.format('i = n - 1', 'cds_end', 's + 140 * i + 89')}, 'offset', {offset})"
    each = "transform(sequence(0L, n - 1), i -> {})"
    return t.selectExpr(
        "k", "n", "transcript_id", "gene_id", "gene_name", "chrom", "s AS start", "e AS end", "strand", "biotype", "canonical", "msk_canonical", "mane_select", "cds_start", "cds_end", "concat('ENSP', lpad(k, 6, '0')) AS protein_id", "CAST(k % 400 + 1 AS STRING) AS entrez_id",
        f"{each.format(exon)} AS exons", f"CASE WHEN cds_start = 0 THEN filter({each.format(region)}, x -> false) ELSE {each.format(region)} END AS cds_regions", f"{each.format('CASE WHEN strand = 1 THEN 90 * i ELSE 90 * (n - 1 - i) END')} AS exon_cum", "cds_sequence", "utr3_sequence",
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = dealt(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # alleles take at most five bases of a digest: no more of it is translated
    sql = _sql(VARIANTS, False).replace("translate(md5(", "translate(left(md5(").replace("AS STRING)), '0123", "AS STRING)), 5), '0123")
    return spark.sql(sql.replace("FROM lineitem)", "FROM {lineitem})"), lineitem=lineitem)


def duck(**more: str) -> str:
    """WITH clause of the tables tx and v, and of further ones."""
    parts = {"tx": _sql(TX, True), "v": _sql(VARIANTS, True)} | more
    return "WITH " + ", ".join(f"{k} AS ({q.strip()})" for k, q in parts.items()) + "\n"


#: Transcript positions by arithmetic: i the exon or intron place, o the offset in it.
JOINED = "SELECT v.*, t.* EXCLUDE (chrom), (pos - s) // 140 AS i, (pos - s) % 140 AS o FROM v LEFT JOIN tx t ON v.chrom = t.chrom AND v.pos BETWEEN t.s AND t.e"

AA = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * (strpos('TCAG', substr({0}, 1, 1)) - 1) + 4 * (strpos('TCAG', substr({0}, 2, 1)) - 1) + strpos('TCAG', substr({0}, 3, 1)) AS INT), 1)"
RESIDUES = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter"}
THREE = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RESIDUES.items()) + " ELSE 'Xaa' END"

#: Annotations of single-base variants (ones), step by step; the steps before the last are of every variant.
SNV_STEPS = {
    "j": JOINED,
    "j1": "SELECT *, o < 90 AS ex, cds_start > 0 AS cod, CASE WHEN o < 90 AND cds_start > 0 AND pos BETWEEN cds_start AND cds_end THEN CASE WHEN strand = 1 THEN 90 * i + o - 20 + 1 ELSE 90 * (n - 1 - i) + (89 - o) - 25 + 1 END ELSE 0 END AS cds, o <= 2 OR o BETWEEN 87 AND 89 OR o BETWEEN 92 AND 97 OR o BETWEEN 132 AND 137 AS near FROM j",
    "j2": "SELECT *, CASE WHEN cds > 0 THEN (cds - 1) // 3 + 1 ELSE 0 END AS num, CASE WHEN cds > 0 THEN (cds - 1) % 3 ELSE 0 END AS off, CASE WHEN cds > 0 THEN substr(cds_sequence, CAST((cds - 1) // 3 * 3 + 1 AS INT), 3) ELSE '' END AS rc, CASE WHEN strand = 1 THEN alt ELSE translate(alt, 'ACGT', 'TGCA') END AS ab, CASE WHEN strand = 1 THEN ref ELSE translate(ref, 'ACGT', 'TGCA') END AS rb FROM j1",
    "j3": "SELECT *, CASE WHEN cds > 0 THEN substr(rc, 1, CAST(off AS INT)) || ab || substr(rc, CAST(off + 2 AS INT)) ELSE '' END AS ac FROM j2",
    "j4": f"SELECT *, CASE WHEN cds > 0 THEN {AA.format('rc')} ELSE '' END AS ra, CASE WHEN cds > 0 THEN {AA.format('ac')} ELSE '' END AS aa FROM j3",
    "j5": """SELECT *, CASE WHEN ra = aa AND ra = '*' THEN 'stop_retained_variant' WHEN ra = aa THEN 'synonymous_variant' WHEN aa = '*' THEN 'stop_gained' WHEN ra = '*' THEN 'stop_lost' WHEN ra = 'M' AND num = 1 THEN 'start_lost' ELSE 'missense_variant' END AS term,
  CASE WHEN o < 90 THEN '' WHEN o <= 91 THEN CASE WHEN strand = 1 THEN 'splice_donor_variant' ELSE 'splice_acceptor_variant' END WHEN o >= 138 THEN CASE WHEN strand = 1 THEN 'splice_acceptor_variant' ELSE 'splice_donor_variant' END ELSE '' END AS site,
  list_min(list_filter(range(1, length(utr3_sequence) // 3 + 1), lambda x: substr(utr3_sequence, CAST(x * 3 - 2 AS INT), 3) IN ('TAA', 'TAG', 'TGA'))) AS ext,
  CASE WHEN o - 89 <= 140 - o THEN i ELSE i + 1 END AS bi, o - 89 <= 140 - o AS low FROM j4""",
    "j6": """SELECT *, CASE WHEN cod THEN CASE WHEN strand = 1 THEN 90 * bi + (CASE WHEN low THEN 89 ELSE 0 END) - 19 ELSE 90 * (n - 1 - bi) + (CASE WHEN low THEN 0 ELSE 89 END) - 24 END
    ELSE CASE WHEN strand = 1 THEN 90 * bi + (CASE WHEN low THEN 89 ELSE 0 END) + 1 ELSE 90 * (n - 1 - bi) + (CASE WHEN low THEN 0 ELSE 89 END) + 1 END END AS edge,
  CASE WHEN o IN (90, 91) THEN CASE WHEN strand = 1 THEN 90 * i + 70 ELSE 90 * (n - 1 - i) - 24 END WHEN o IN (138, 139) THEN CASE WHEN strand = 1 THEN 90 * (i + 1) - 19 ELSE 90 * (n - 2 - i) + 65 END ELSE 0 END AS scds FROM j5""",
    "j7": """SELECT *, CASE WHEN NOT ex THEN CAST(edge AS VARCHAR) || (CASE WHEN low = (strand = 1) THEN '+' ELSE '-' END) || CAST(CASE WHEN low THEN o - 89 ELSE 140 - o END AS VARCHAR)
    WHEN NOT cod THEN CAST(CASE WHEN strand = 1 THEN 90 * i + o + 1 ELSE 90 * (n - 1 - i) + 89 - o + 1 END AS VARCHAR) WHEN cds > 0 THEN CAST(cds AS VARCHAR)
    WHEN pos < cds_start THEN (CASE WHEN strand = 1 THEN '-' ELSE '*' END) || CAST(cds_start - pos AS VARCHAR) ELSE (CASE WHEN strand = 1 THEN '*' ELSE '-' END) || CAST(pos - cds_end AS VARCHAR) END AS loc,
  CASE WHEN k IS NULL THEN 'intergenic_variant' WHEN NOT ex THEN CASE WHEN site <> '' THEN site WHEN near THEN 'splice_region_variant,intron_variant' ELSE 'intron_variant' END
    WHEN NOT cod THEN CASE WHEN biotype = 'miRNA' THEN 'mature_miRNA_variant' ELSE 'non_coding_transcript_exon_variant' END
    WHEN pos < cds_start THEN CASE WHEN strand = 1 THEN '5_prime_UTR_variant' ELSE '3_prime_UTR_variant' END WHEN pos > cds_end THEN CASE WHEN strand = 1 THEN '3_prime_UTR_variant' ELSE '5_prime_UTR_variant' END
    ELSE term || CASE WHEN near THEN ',splice_region_variant' ELSE '' END END AS base FROM j6""",
    "ones": f"""SELECT record_id, chrom, pos, ref, alt, coalesce(transcript_id, '') AS transcript_id, coalesce(gene_id, '') AS gene_id, coalesce(gene_name, '') AS gene_name, coalesce(biotype, '') AS biotype, coalesce(msk_canonical, false) AS msk_canonical, coalesce(canonical, false) AS canonical, coalesce(s, 0) AS tx_start, coalesce(k, 0) AS k, coalesce(cds_sequence, '') AS cds_sequence,
  base || CASE WHEN biotype = 'nonsense_mediated_decay' THEN ',NMD_transcript_variant' ELSE '' END AS consequence,
  CASE WHEN split_part(base, ',', 1) IN ('splice_acceptor_variant', 'splice_donor_variant', 'stop_gained', 'stop_lost', 'start_lost') THEN 'HIGH' WHEN split_part(base, ',', 1) = 'missense_variant' THEN 'MODERATE' WHEN split_part(base, ',', 1) IN ('splice_region_variant', 'stop_retained_variant', 'synonymous_variant') THEN 'LOW' ELSE 'MODIFIER' END AS impact,
  CASE WHEN cds > 0 THEN cds ELSE 0 END AS cds_position, CASE WHEN cds > 0 THEN num WHEN cod AND NOT ex AND site <> '' THEN (scds - 1) // 3 + 1 ELSE 0 END AS protein_position,
  CASE WHEN cds > 0 AND term IN ('missense_variant', 'stop_gained', 'stop_lost', 'start_lost') THEN ra || CAST(num AS VARCHAR) || aa ELSE '' END AS amino_acid_change,
  CASE WHEN cds > 0 THEN lower(rc) || '/' || lower(substr(ac, 1, CAST(off AS INT))) || upper(substr(ac, CAST(off + 1 AS INT), 1)) || lower(substr(ac, CAST(off + 2 AS INT))) ELSE '' END AS codon_change,
  CASE WHEN ex THEN CAST(CASE WHEN strand = 1 THEN i + 1 ELSE n - i END AS VARCHAR) || '/' || CAST(n AS VARCHAR) ELSE '' END AS exon_number,
  CASE WHEN cds > 0 THEN CASE term WHEN 'missense_variant' THEN 'p.' || {THREE.format('ra')} || CAST(num AS VARCHAR) || {THREE.format('aa')} WHEN 'synonymous_variant' THEN 'p.' || {THREE.format('ra')} || CAST(num AS VARCHAR) || '=' WHEN 'stop_gained' THEN 'p.' || {THREE.format('ra')} || CAST(num AS VARCHAR) || 'Ter'
    WHEN 'stop_lost' THEN 'p.Ter' || CAST(num AS VARCHAR) || {THREE.format('aa')} || 'ext*' || coalesce(CAST(ext AS VARCHAR), '?') WHEN 'stop_retained_variant' THEN 'p.Ter' || CAST(num AS VARCHAR) || '=' ELSE 'p.Met1?' END
    WHEN cod AND NOT ex AND site <> '' THEN 'p.X' || CAST((scds - 1) // 3 + 1 AS VARCHAR) || '_splice' ELSE '' END AS hgvsp,
  CASE WHEN k IS NULL THEN '' WHEN ref = alt THEN (CASE WHEN cod THEN 'c.' ELSE 'n.' END) || loc || '=' ELSE (CASE WHEN cod THEN 'c.' ELSE 'n.' END) || loc || rb || '>' || ab END AS hgvsc FROM j7 WHERE kind = 3""",
}


def _cds(p: str) -> str:
    """Coding position of a genomic one, or 0."""
    return f"(CASE WHEN cds_start > 0 AND {p} BETWEEN cds_start AND cds_end AND ({p} - s) % 140 < 90 THEN CASE WHEN strand = 1 THEN 90 * (({p} - s) // 140) + ({p} - s) % 140 - 19 ELSE 90 * (n - 1 - ({p} - s) // 140) + 65 - ({p} - s) % 140 END ELSE 0 END)"


def _loc(p: str) -> str:
    """Notation of a genomic position: in an exon, or from the nearer exon's edge."""
    i, o = f"(({p} - s) // 140)", f"(({p} - s) % 140)"
    exonic = lambda i, o: f"(CASE WHEN NOT cod THEN CAST(CASE WHEN strand = 1 THEN 90 * {i} + {o} + 1 ELSE 90 * (n - 1 - {i}) + 90 - {o} END AS VARCHAR) WHEN 140 * {i} + {o} + s < cds_start THEN (CASE WHEN strand = 1 THEN '-' ELSE '*' END) || CAST(cds_start - s - 140 * {i} - {o} AS VARCHAR) WHEN 140 * {i} + {o} + s > cds_end THEN (CASE WHEN strand = 1 THEN '*' ELSE '-' END) || CAST(s + 140 * {i} + {o} - cds_end AS VARCHAR) ELSE CAST({_cds(f'(140 * {i} + {o} + s)')} AS VARCHAR) END)"
    low = f"({o} - 89 <= 140 - {o} OR {p} > e)"
    return f"(CASE WHEN {o} < 90 THEN {exonic(i, o)} WHEN {low} THEN {exonic(i, '89')} || (CASE WHEN strand = 1 THEN '+' ELSE '-' END) || CAST({o} - 89 AS VARCHAR) ELSE {exonic(f'({i} + 1)', '0')} || (CASE WHEN strand = 1 THEN '-' ELSE '+' END) || CAST(140 - {o} AS VARCHAR) END)"


def _sub(x: str, at: str, n: str | None = None) -> str:
    """Characters from a place (from 0)."""
    return f"substr({x}, CAST({at} + 1 AS INT)" + (f", CAST({n} AS INT))" if n else ")")


def _peptide(x: str) -> str:
    return f"array_to_string(list_transform(range(1, length({x}) // 3 + 1), lambda z: {AA.format(f'substr({x}, CAST(z * 3 - 2 AS INT), 3)')}), '')"


#: How many leading characters two texts share.
LCP = "coalesce(list_min(list_filter(range(1, 1 + least(length({0}), length({1}))), lambda x: substr({0}, CAST(x AS INT), 1) <> substr({1}, CAST(x AS INT), 1))) - 1, least(length({0}), length({1})))"
_STOPS = "('TAA', 'TAG', 'TGA')"
_flip = lambda x: f"CASE WHEN strand = 1 THEN {x} ELSE reverse(translate({x}, 'ACGT', 'TGCA')) END"
_res = lambda at: f"(CASE WHEN {at} >= 1 THEN substr(pp, CAST({at} AS INT), 1) ELSE '' END)"
_either = lambda a, b: f"(CASE WHEN {a} <> '' THEN {a} ELSE {b} END)"
_three = lambda a: f"({THREE.format(a)})"
_threes = lambda x: f"(CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_transform(range(1, length({x}) + 1), lambda z: {THREE.format(f'substr({x}, CAST(z AS INT), 1)')}), '') END)"
#: Last coding index of the exon that holds one (the first exon holds 70 bases, or 65 on the other strand).
_end_of = lambda x: f"least(cl - 1, (CASE WHEN strand = 1 THEN 70 ELSE 65 END) + CASE WHEN {x} < (CASE WHEN strand = 1 THEN 70 ELSE 65 END) THEN 0 ELSE 90 * (({x} - (CASE WHEN strand = 1 THEN 70 ELSE 65 END)) // 90 + 1) END - 1)"
_span = lambda a, b, what: f"('c.' || CAST({a} AS VARCHAR) || CASE WHEN {a} = {b} THEN '' ELSE '_' || CAST({b} AS VARCHAR) END || '{what}')"

#: Annotations of all other variants (others), step by step: mutant sequences are built, translated and compared.
#: An index on the coding strand counts from 0, a residue from 1.
INDEL_STEPS = {
    "m0": f"""SELECT *, length(ref) AS rl, length(alt) AS al, length(alt) - length(ref) AS g, length(cds_sequence) AS cl, {_flip('alt')} AS sa, coalesce(biotype, '') = 'nonsense_mediated_decay' AS nmd,
  CASE WHEN length(ref) > 1 AND length(ref) <> length(alt) THEN list_filter(range(pos, pos + length(ref)), lambda x: (x - s) % 140 IN (90, 91, 138, 139))[1] END AS hit,
  CASE WHEN strand = 1 THEN cds - 1 ELSE greatest(0, cds - length(ref)) END AS at0 FROM j7 WHERE kind < 3""",
    "m1": f"""SELECT *, CASE WHEN hit IS NULL THEN '' WHEN ((hit - s) % 140 <= 91) = (strand = 1) THEN 'splice_donor_variant' ELSE 'splice_acceptor_variant' END AS isite, at0 // 3 * 3 AS bg, least(at0 + rl, cl) AS rest,
  CASE WHEN cds > 0 THEN {_sub('cds_sequence', '0', 'cds - 1')} || sa || {_sub('cds_sequence', 'least(cds - 1 + rl, cl)')} ELSE '' END AS um FROM m0""",
    "m2": f"""SELECT *, CASE WHEN cds > 0 THEN {_sub('cds_sequence', 'bg', '60')} ELSE '' END AS wb, CASE WHEN cds > 0 THEN {_sub('cds_sequence', 'bg', 'at0 - bg')} || sa || {_sub(_sub('cds_sequence', 'bg', '60'), 'rest - bg')} ELSE '' END AS wa,
  CASE WHEN cds > 0 THEN {_sub('cds_sequence', 'bg', 'at0 - bg')} || sa || {_sub('cds_sequence', 'rest')} || utr3_sequence ELSE '' END AS fs, CASE WHEN cds > 0 THEN {_sub('cds_sequence', 'bg')} ELSE '' END AS fo FROM m1""",
    "m3": f"SELECT *, {_peptide('wb')} AS pb, {_peptide('wa')} AS pa, {_peptide('fs')} AS pm, {_peptide('fo')} AS po, CASE WHEN cds > 0 THEN {_peptide('cds_sequence')} ELSE '' END AS pp FROM m2",
    "m4": f"SELECT *, {LCP.format('pb', 'pa')} AS head, {LCP.format('pm', 'po')} AS same FROM m3",
    "m5": "SELECT *, substr(pb, CAST(head + 1 AS INT)) AS tb, substr(pa, CAST(head + 1 AS INT)) AS ta FROM m4",
    "m6": f"SELECT *, {LCP.format('reverse(tb)', 'reverse(ta)')} AS tl FROM m5",
    "m7": "SELECT *, CASE WHEN pb = '' OR pa = '' THEN '' ELSE left(tb, CAST(length(tb) - tl AS INT)) END AS gone, CASE WHEN pb = '' OR pa = '' THEN '' ELSE left(ta, CAST(length(ta) - tl AS INT)) END AS fresh FROM m6",
    "m8": f"""SELECT *, CASE WHEN gone <> '' OR fresh <> '' THEN bg // 3 + 1 + head ELSE 0 END AS first_, CASE WHEN gone <> '' THEN bg // 3 + head + length(gone) ELSE 0 END AS last_, CASE WHEN same < length(pm) THEN bg // 3 + 1 + same ELSE 0 END AS fs_at, substr(po, CAST(same + 1 AS INT), 1) AS fs_old, substr(pm, CAST(same + 1 AS INT), 1) AS fs_new, strpos(substr(pm, CAST(same + 1 AS INT)), '*') AS dist,
  CASE WHEN strand = 1 THEN {_cds('(pos + 1)')} ELSE {_cds('(pos + rl - 1)')} END AS e0, CASE WHEN strand = 1 THEN {_cds('(pos + rl - 1)')} ELSE {_cds('(pos + 1)')} END AS e1, (cds - 1) // 3 + 1 AS p0,
  {_sub('um', 'cl - 3', '3')} IN {_STOPS} OR (cl - 3 + g >= 0 AND {_sub('um', 'cl - 3 + g', '3')} IN {_STOPS}) AS keeps, {_sub('um', '(cds - 1) // 3 * 3', '3')} AS u1, {_sub('um', '(cds - 1) // 3 * 3 + 3', '3')} AS u2, {_sub('cds_sequence', '(cds - 1) // 3 * 3', '3')} AS c1, {_sub('cds_sequence', '(cds - 1) // 3 * 3 + 3', '3')} AS c2 FROM m7""",
    "m9": f"""SELECT *, CASE WHEN u1 IN {_STOPS} THEN c1 NOT IN {_STOPS} WHEN length(u1) = 3 AND u2 IN {_STOPS} THEN c2 NOT IN {_STOPS} ELSE false END AS makes, CASE WHEN g < 0 AND e0 > 0 THEN (e0 - 1) // 3 + 1 ELSE p0 END AS dp, CASE WHEN g < 0 AND e1 > 0 THEN (e1 - 1) // 3 + 1 ELSE 0 END AS dl, cl - 2 <= cds + rl - 1 AS reaches FROM m8""",
    "m10": f"SELECT *, {_res('dp')} AS r0, CASE WHEN cds < 1 THEN '' WHEN g = 0 THEN 'sub' WHEN g > 0 AND cl - 2 <= cds AND keeps THEN 'retain' WHEN g % 3 <> 0 THEN 'shift' WHEN g > 0 AND makes THEN 'stop' WHEN g > 0 AND fresh = '' THEN 'bare' WHEN g > 0 AND gone <> '' THEN 'swap' WHEN g > 0 THEN 'ins' ELSE 'del' END AS br, CASE WHEN first_ > 1 THEN first_ - 1 ELSE p0 END AS q FROM m9",
    "m11": f"SELECT *, q - length(fresh) + 1 AS q0, length(gone) = 1 AND length(fresh) = 1 AS single FROM m10",
    "m12": """SELECT *, br = 'ins' AND q0 >= 1 AND substr(pp, CAST(greatest(q0, 1) AS INT), length(fresh)) = fresh AS dup, CASE br WHEN 'sub' THEN
    CASE WHEN first_ = 0 THEN 'synonymous_variant' WHEN single THEN CASE WHEN fresh = '*' THEN 'stop_gained' WHEN gone = '*' THEN 'stop_lost' WHEN gone = 'M' AND first_ = 1 THEN 'start_lost' ELSE 'missense_variant' END
      WHEN contains(fresh, '*') AND NOT contains(gone, '*') THEN 'stop_gained' WHEN contains(gone, '*') AND NOT contains(fresh, '*') THEN 'stop_lost' WHEN first_ = 1 AND left(gone, 1) IN ('', 'M') THEN 'start_lost' ELSE 'missense_variant' END
    WHEN 'retain' THEN 'inframe_insertion,stop_retained_variant' WHEN 'shift' THEN CASE WHEN fs_at > 0 AND fs_new = '*' THEN 'stop_gained' WHEN reaches THEN 'frameshift_variant,stop_lost' ELSE 'frameshift_variant' END
    WHEN 'stop' THEN 'stop_gained' WHEN 'del' THEN CASE WHEN reaches THEN 'stop_lost,3_prime_UTR_variant' WHEN makes THEN 'stop_gained,inframe_deletion' ELSE 'inframe_deletion' END WHEN '' THEN '' ELSE 'inframe_insertion' END AS mterm FROM m11""",
    "m13": f"""SELECT *, CASE br WHEN 'sub' THEN CASE WHEN first_ > 0 THEN first_ ELSE p0 END WHEN 'shift' THEN CASE WHEN fs_at > 0 THEN fs_at ELSE dp END WHEN 'swap' THEN first_ WHEN 'ins' THEN CASE WHEN dup THEN q0 ELSE q END WHEN 'del' THEN CASE WHEN first_ > 0 THEN first_ ELSE dp END ELSE dp END AS mp,
  CASE br WHEN 'sub' THEN CASE WHEN first_ > 0 THEN left(gone, 1) ELSE '' END WHEN 'shift' THEN CASE WHEN fs_at > 0 THEN fs_old ELSE r0 END WHEN 'swap' THEN {_either(_res('first_'), 'r0')} WHEN 'ins' THEN CASE WHEN dup THEN {_res('q0')} WHEN first_ > 1 THEN {_either(_res('(first_ - 1)'), 'r0')} ELSE r0 END WHEN 'del' THEN CASE WHEN first_ > 0 THEN {_either(_res('first_'), 'r0')} ELSE r0 END ELSE r0 END AS mr,
  CASE br WHEN 'sub' THEN CASE WHEN NOT single AND length(gone) > 1 THEN last_ ELSE 0 END WHEN 'swap' THEN CASE WHEN last_ > first_ THEN last_ ELSE 0 END WHEN 'ins' THEN CASE WHEN dup THEN q ELSE 0 END WHEN 'del' THEN CASE WHEN first_ > 0 THEN last_ WHEN dl > dp THEN dl ELSE 0 END ELSE 0 END AS me,
  CASE br WHEN 'sub' THEN right(gone, 1) WHEN 'swap' THEN {_res('last_')} WHEN 'ins' THEN CASE WHEN dup AND length(fresh) > 1 THEN {_res('q')} WHEN first_ > 1 THEN {_res('first_')} ELSE '' END WHEN 'del' THEN CASE WHEN first_ > 0 THEN {_res('last_')} WHEN dl > dp THEN {_res('dl')} ELSE '' END ELSE '' END AS ma FROM m12""",
    "m14": f"SELECT *, CASE WHEN mr = '' THEN '' ELSE {_three('mr')} END AS rt, CASE WHEN me > mp AND ma <> '' THEN '_' || {_three('ma')} || CAST(me AS VARCHAR) ELSE '' END AS upto, CAST(mp AS VARCHAR) AS mn FROM m13",
    "m15": f"""SELECT *, CASE split_part(mterm, ',', 1) WHEN 'start_lost' THEN 'p.Met1?' WHEN 'missense_variant' THEN CASE WHEN single THEN 'p.' || {_three('mr')} || mn || {_three('fresh')} ELSE 'p.' || rt || mn || upto || 'delins' || {_threes('fresh')} END
    WHEN 'synonymous_variant' THEN 'p.' || {_three('mr')} || mn || '=' WHEN 'stop_gained' THEN 'p.' || {_three('mr')} || mn || 'Ter' WHEN 'stop_lost' THEN 'p.Ter' || mn || CASE WHEN br = 'sub' AND single THEN {_three('fresh')} ELSE 'Xaa' END || 'ext*?'
    WHEN 'frameshift_variant' THEN 'p.' || rt || mn || CASE WHEN fs_at > 0 THEN {_three('fs_new')} ELSE '' END || 'fs' || CASE WHEN fs_at > 0 AND dist > 0 THEN 'Ter' || CAST(dist AS VARCHAR) ELSE '' END
    WHEN 'inframe_deletion' THEN 'p.' || rt || mn || upto || CASE WHEN first_ > 0 AND fresh <> '' THEN 'delins' || {_threes('fresh')} ELSE 'del' END
    WHEN 'inframe_insertion' THEN CASE WHEN br = 'swap' THEN 'p.' || rt || mn || upto || 'delins' || {_threes('fresh')} WHEN dup THEN 'p.' || rt || mn || upto || 'dup' ELSE 'p.' || rt || mn || '_' || CASE WHEN ma = '' THEN '' ELSE {_three('ma')} END || CAST(mp + 1 AS VARCHAR) || 'ins' || CASE WHEN br = 'ins' THEN {_threes('fresh')} ELSE '' END END ELSE '' END AS mprot FROM m14""",
    "m16": """SELECT *, pos + rl - 1 AS pe, CASE WHEN strand = 1 THEN pos < cds_start ELSE pos > cds_end END AS five, CASE WHEN strand = 1 THEN pos + rl - 1 >= cds_start AND pos <= cds_start + 2 ELSE pos + rl - 1 >= cds_end - 2 AND pos <= cds_end END AS on_start, CASE WHEN strand = 1 THEN pos + rl - 1 >= cds_end - 2 AND pos <= cds_end ELSE pos + rl - 1 >= cds_start AND pos <= cds_start + 2 END AS on_stop FROM m15""",
    "m17": """SELECT *, CASE WHEN k IS NULL THEN 'intergenic_variant' WHEN NOT ex THEN CASE WHEN isite <> '' THEN isite WHEN site <> '' THEN site WHEN near THEN 'splice_region_variant,intron_variant' ELSE 'intron_variant' END
    WHEN NOT cod THEN CASE WHEN biotype = 'miRNA' THEN 'mature_miRNA_variant' ELSE 'non_coding_transcript_exon_variant' END
    WHEN pos < cds_start OR pos > cds_end THEN CASE WHEN rl > 1 AND g <> 0 AND isite <> '' THEN isite WHEN rl > 1 AND five AND on_start THEN 'start_lost' WHEN rl > 1 AND NOT five AND on_stop THEN 'stop_lost,3_prime_UTR_variant' WHEN five THEN '5_prime_UTR_variant' ELSE '3_prime_UTR_variant' END
    WHEN g <> 0 AND rl > 1 AND on_start THEN 'start_lost' WHEN isite <> '' THEN isite ELSE mterm || CASE WHEN near THEN ',splice_region_variant' ELSE '' END END AS mc FROM m16""",
    # coding notation: an insertion moves to its last place, a deletion too, both within their exon
    "m18": f"""SELECT *, substr(sa, CASE WHEN strand = 1 THEN CAST(rl + 1 AS INT) ELSE 1 END, CAST(g AS INT)) AS nw, greatest(0, cds - 1 - CASE WHEN strand = 1 THEN 0 ELSE 1 END) AS an, {_cds('(pos + 1)')} AS bes, {_loc('pos')} AS la, {_loc('(pos + 1)')} AS lb, {_loc('(pos + rl - 1)')} AS lc, CASE WHEN strand = 1 THEN {_cds('(pos + 1)')} ELSE {_cds('(pos + rl - 1)')} END AS ci, CASE WHEN strand = 1 THEN {_cds('(pos + rl - 1)')} ELSE {_cds('(pos + 1)')} END AS cj FROM m17""",
    "m19": f"SELECT *, greatest(0, {_end_of('an')} - an) AS room, greatest(0, {_end_of('(cj - 1)')} - (cj - 1)) AS droom FROM m18",
    "m20": f"""SELECT *, CASE WHEN g > 0 AND cds > 0 THEN coalesce(list_filter(range(0, room), lambda x: {_sub('cds_sequence', 'an + 1 + x', '1')} <> {_sub('nw', 'x % g', '1')})[1], room) ELSE 0 END AS sh, CASE WHEN g < 0 AND ci > 0 AND cj > 0 THEN coalesce(list_filter(range(0, droom), lambda x: {_sub('cds_sequence', 'ci - 1 + x', '1')} <> {_sub('cds_sequence', 'cj + x', '1')})[1], droom) ELSE 0 END AS dsh FROM m19""",
    "m21": f"SELECT *, an + sh AS am, CASE WHEN g > 0 THEN {_sub('nw', 'sh % g')} || {_sub('nw', '0', 'sh % g')} ELSE '' END AS rot, CASE WHEN cod THEN 'c.' ELSE 'n.' END AS pre FROM m20",
    "m22": f"""SELECT *, CASE WHEN k IS NULL THEN '' WHEN g = 0 THEN pre || CASE WHEN strand = 1 THEN la || '_' || lb ELSE lb || '_' || la END || 'delins' || sa
    WHEN g > 0 THEN CASE WHEN cds > 0 THEN CASE WHEN am - g + 1 >= 0 AND {_sub('cds_sequence', 'greatest(0, am - g + 1)', 'g')} = rot THEN {_span('(am - g + 2)', '(am + 1)', 'dup')} WHEN {_sub('cds_sequence', 'am + 1', 'g')} = rot THEN {_span('(am + 2)', '(am + 1 + g)', 'dup')}
        WHEN am + 2 <= cl THEN 'c.' || CAST(am + 1 AS VARCHAR) || '_' || CAST(am + 2 AS VARCHAR) || 'ins' || rot ELSE pre || CAST(am + 1 AS VARCHAR) || '_*1ins' || rot END
      WHEN cod AND bes > 0 AND {_sub('cds_sequence', 'bes - 1', 'g')} = nw THEN {_span('bes', '(bes + g - 1)', 'dup')} ELSE pre || CASE WHEN strand = 1 THEN la || '_' || lb ELSE lb || '_' || la END || 'ins' || nw END
    WHEN ci > 0 AND cj > 0 THEN {_span('(ci + dsh)', '(cj + dsh)', 'del')} WHEN rl = 2 THEN pre || lb || 'del' ELSE pre || CASE WHEN strand = 1 THEN lb || '_' || lc ELSE lc || '_' || lb END || 'del' END AS mh FROM m21""",
    "others": """SELECT record_id, chrom, pos, ref, alt, coalesce(transcript_id, '') AS transcript_id, coalesce(gene_id, '') AS gene_id, coalesce(gene_name, '') AS gene_name, coalesce(biotype, '') AS biotype, coalesce(msk_canonical, false) AS msk_canonical, coalesce(canonical, false) AS canonical, coalesce(s, 0) AS tx_start, coalesce(k, 0) AS k, coalesce(cds_sequence, '') AS cds_sequence, mc || CASE WHEN nmd THEN ',NMD_transcript_variant' ELSE '' END AS consequence,
  CASE WHEN split_part(mc, ',', 1) IN ('splice_acceptor_variant', 'splice_donor_variant', 'stop_gained', 'stop_lost', 'start_lost', 'frameshift_variant') THEN 'HIGH' WHEN split_part(mc, ',', 1) IN ('missense_variant', 'inframe_insertion', 'inframe_deletion') THEN 'MODERATE' WHEN split_part(mc, ',', 1) IN ('splice_region_variant', 'stop_retained_variant', 'synonymous_variant') THEN 'LOW' ELSE 'MODIFIER' END AS impact,
  CASE WHEN cds > 0 THEN cds ELSE 0 END AS cds_position, CASE WHEN mc = 'start_lost' AND (cds = 0 OR (g <> 0 AND rl > 1)) THEN 1 WHEN cds > 0 THEN mp WHEN cod AND NOT ex AND mc IN ('splice_donor_variant', 'splice_acceptor_variant') AND scds > 0 THEN (scds - 1) // 3 + 1 ELSE 0 END AS protein_position,
  CASE WHEN cds > 0 AND br = 'sub' AND single AND mterm IN ('missense_variant', 'stop_gained') THEN gone || CAST(mp AS VARCHAR) || fresh ELSE '' END AS amino_acid_change, '' AS codon_change, CASE WHEN ex THEN CAST(CASE WHEN strand = 1 THEN i + 1 ELSE n - i END AS VARCHAR) || '/' || CAST(n AS VARCHAR) ELSE '' END AS exon_number,
  CASE WHEN mc = 'start_lost' AND (cds = 0 OR (g <> 0 AND rl > 1)) THEN 'p.Met1?' WHEN cds > 0 THEN mprot WHEN cod AND NOT ex AND mc IN ('splice_donor_variant', 'splice_acceptor_variant') AND scds > 0 THEN 'p.X' || CAST((scds - 1) // 3 + 1 AS VARCHAR) || '_splice' ELSE '' END AS hgvsp, mh AS hgvsc FROM m22""",
}
#: Annotations of every variant.
STEPS = SNV_STEPS | INDEL_STEPS | {"ann": "SELECT * FROM ones UNION ALL SELECT * FROM others"}
