"""Variant tables: clinical tables from tab-separated text, and the variants that queries derive from `orders`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLINICAL_SCHEMA = (
    "Assembly string, Chromosome string, ChromosomeAccession string, PositionVCF long, "
    "ReferenceAlleleVCF string, AlternateAlleleVCF string, ClinicalSignificance string"
)
CLINICAL_COLUMNS = [c.split()[0] for c in CLINICAL_SCHEMA.split(", ")]


def read_clinical(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The model columns of a (gzipped) tab-separated clinical table with a header, whatever its other columns.

    A gzip file is one task's; partitions deals its rows out for what follows.
    """
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = raw.select(*[F.col(c).cast("long") if c == "PositionVCF" else F.col(c) for c in CLINICAL_COLUMNS])
    return out.repartition(partitions) if partitions else out


def write_clinical(df: DataFrame, path: str) -> None:
    """Filtered variants as CSV with a header, a file for each partition."""
    df.write.mode("overwrite").csv(path, header=True)


def drop_literal_na(df: DataFrame) -> DataFrame:
    """Rows without nulls and without a string cell that is `na` in any case."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    out = df.na.drop("any")
    return out.where(~F.exists(F.array(*text), lambda x: F.lower(x) == "na")) if text else out


def clinical_filter(df: DataFrame) -> DataFrame:
    """Benign and pathogenic variants of the current assembly's placed chromosomes."""
    kept = drop_literal_na(df.select(*CLINICAL_COLUMNS))
    placed = ~F.col("Chromosome").contains("MT") & ~F.col("Chromosome").contains("Un") & ~F.col("Assembly").contains("GRCh37")
    return kept.where(placed & F.col("ClinicalSignificance").isin("Pathogenic", "Benign"))


def chromosome_number(name: Column) -> Column:
    """X is 23, Y is 24, others their number; null if it is none."""
    return F.when(name == "X", 23).when(name == "Y", 24).otherwise(name.try_cast("int"))


def label(significance: Column) -> Column:
    """Benign 0, Pathogenic 1, null otherwise."""
    return F.when(significance == "Benign", 0).when(significance == "Pathogenic", 1)


def block(key: Column, i: int) -> Column:
    """32 bases that hang on a key."""
    return F.translate(F.md5(F.concat(key.cast("string"), F.lit(f":{i}"))), "0123456789abcdef", "ACGTACGTACGTACGT")


def fasta_text(width: int = 60) -> Column:
    """The tagged records of a variant, flanks before alleles, in lines of one width; the later lines in lower case."""
    parts = [("flank_2", "flank_2"), ("alt", "alt_allele"), ("flank1", "flank_1"), ("ref", "ref_allele")]
    body = lambda c: F.concat(F.left(c, F.lit(width)), F.lit("\n"), F.lower(F.substr(c, F.lit(width + 1))))
    head = lambda tag: F.concat(F.lit(">chr"), F.col("chromosome").cast("string"), F.lit(f"|{tag}|v"), F.col("variant_id").cast("string"), F.lit("\n"))
    return F.concat_ws("\n", *[F.concat(head(tag), body(F.col(c))) for tag, c in parts])


#: Blocks of a flank, and of the long flanks that one variant of LONG_EVERY has, so that windows of up to 500 bases end within them.
BLOCKS, LONG_BLOCKS, LONG_EVERY, LONG_FROM = 4, 16, 8, 10


def flank(key: Column, first: int) -> Column:
    """The bases of a flank; the further blocks of long ones have numbers of their own."""
    more = range(LONG_FROM + 3 * first, LONG_FROM + 3 * first + LONG_BLOCKS - BLOCKS)
    short = [block(key, i) for i in range(first, first + BLOCKS)]
    return F.concat(*short, F.when(key % LONG_EVERY == 3, F.concat(*[block(key, i) for i in more])).otherwise(""))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions: a variant's features cost far more than moving its few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant for each order: substitutions, microsatellites, insertions of runs, indels and ambiguous bases."""
    k = F.col("o_orderkey")
    plain = F.substring(block(k, 8), 1, 12)
    ref = (
        F.when(k % 5 == 0, F.expr("repeat('CA', int(5 + o_orderkey % 3))"))
        .when(k % 35 == 4, F.concat(F.lit("N"), F.substring(plain, 1, 6)))
        .otherwise(F.substr(plain, F.lit(1), (1 + k % 12).cast("int")))
    )
    other = block(k, 9)
    alt = (
        F.when(k % 5 == 0, F.expr("repeat('CA', int(4 + o_orderkey % 7))"))
        .when(k % 5 == 1, F.concat(F.translate(F.substring("ref_allele", 1, 1), "ACGT", "CGTA"), F.expr("substring(ref_allele, 2)")))
        .when(k % 5 == 3, F.concat("ref_allele", F.lit("AAAAAAA")))
        .otherwise(F.substr(other, F.lit(1), (1 + k % 9).cast("int")))
    )
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"))
    return (
        orders.withColumn("ref_allele", ref)
        .withColumn("alt_allele", alt)
        .select(
            k.alias("variant_id"),
            (1 + k % 24).cast("int").alias("chromosome"),
            "ref_allele",
            "alt_allele",
            flank(k, 0).alias("flank_1"),
            flank(k, 4).alias("flank_2"),
            F.when(F.col("o_orderstatus") == "F", "Benign").when(F.col("o_orderstatus") == "O", "Pathogenic").otherwise("Uncertain").alias("clinical_significance"),
        )
    )


def _sql_block(i: int) -> str:
    return f"translate(md5(concat(o_orderkey::varchar, ':{i}')), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _sql_flank(first: int) -> str:
    more = range(LONG_FROM + 3 * first, LONG_FROM + 3 * first + LONG_BLOCKS - BLOCKS)
    short = " || ".join(_sql_block(i) for i in range(first, first + BLOCKS))
    return f"{short} || CASE WHEN o_orderkey % {LONG_EVERY} = 3 THEN {' || '.join(_sql_block(i) for i in more)} ELSE '' END"


#: The same variants in DuckDB, as the CTE `v` that oracles start with.
VARIANTS_SQL = f"""WITH v0 AS (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN repeat('CA', (5 + o_orderkey % 3)::INT)
    WHEN o_orderkey % 35 = 4 THEN 'N' || substr({_sql_block(8)}, 1, 6)
    ELSE substr({_sql_block(8)}, 1, (1 + o_orderkey % 12)::INT) END AS ref_allele FROM orders),
v AS (
  SELECT o_orderkey AS variant_id, (1 + o_orderkey % 24)::INT AS chromosome, ref_allele,
    CASE WHEN o_orderkey % 5 = 0 THEN repeat('CA', (4 + o_orderkey % 7)::INT)
      WHEN o_orderkey % 5 = 1 THEN translate(substr(ref_allele, 1, 1), 'ACGT', 'CGTA') || substr(ref_allele, 2)
      WHEN o_orderkey % 5 = 3 THEN ref_allele || 'AAAAAAA'
      ELSE substr({_sql_block(9)}, 1, (1 + o_orderkey % 9)::INT) END AS alt_allele,
    {_sql_flank(0)} AS flank_1, {_sql_flank(4)} AS flank_2,
    CASE o_orderstatus WHEN 'F' THEN 'Benign' WHEN 'O' THEN 'Pathogenic' ELSE 'Uncertain' END AS clinical_significance
  FROM v0)
"""
