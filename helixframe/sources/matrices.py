"""Matrices in text: position-weight matrices and substitution matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.motifs import Motif

DNA_ORDER, PROTEIN_ORDER = "ACGT", "ACDEFGHIKLMNPQRSTVWY"


def parse_pwm(lines: DataFrame, order: str = DNA_ORDER) -> DataFrame:
    """(motif, pos, symbol, p) of (motif, pos, line): a line holds a place's probabilities, parted by white space."""
    values = F.split(F.trim("line"), r"\s+")
    cells = F.transform(values, lambda v, i: F.struct(F.substr(F.lit(order), i + 1, F.lit(1)).alias("symbol"), v.cast("double").alias("p")))
    return lines.where(F.trim("line") != "").select("motif", "pos", F.explode(cells).alias("c")).select("motif", "pos", "c.symbol", "c.p")


def read_pwms(spark: SparkSession, folder: str, order: str = DNA_ORDER) -> DataFrame:
    """(motif, pos, symbol, p) of a folder of matrix files, each named by its file."""
    raw = spark.read.text(folder, wholetext=True).withColumn("motif", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return parse_pwm(raw.select("motif", F.posexplode(lines).alias("pos", "line")), order)


#: Rows of a table of matrices, which goes to every task.
MOST_CELLS = 200_000


def read_motifs(spark: SparkSession, folder: str, order: str = DNA_ORDER) -> list[Motif]:
    """Motifs of a folder of matrix files, one folder `domain=<name>` for each domain; by domain, then name.

    A motif is named by its file, or by a folder `name=<name>` around it.
    """
    raw = spark.read.text(folder, wholetext=True)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1)
    raw = raw.withColumn("motif", F.col("name").cast("string") if "name" in raw.columns else file)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    found = raw.select(F.col("domain").cast("string").alias("domain"), "motif", F.posexplode(lines).alias("pos", "line"))
    return as_motifs(parse_pwm(found.select(F.concat_ws("/", "domain", "motif").alias("motif"), "pos", "line"), order), order)


def as_motifs(table: DataFrame, order: str = DNA_ORDER) -> list[Motif]:
    """Motifs of (motif, pos, symbol, p) whose motifs are `domain/name`; more rows than MOST_CELLS are an error."""
    rows = table.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of matrices")
    cells: dict[str, dict[int, dict[str, float]]] = {}
    for r in rows:
        cells.setdefault(r["motif"], {}).setdefault(r["pos"], {})[r["symbol"]] = r["p"]
    names = sorted(cells, key=lambda m: m.split("/", 1))
    return [Motif(m.split("/", 1)[1], m.split("/", 1)[0], tuple(tuple(cells[m][i][a] for a in order) for i in sorted(cells[m])), order) for m in names]


def motifs(table: DataFrame, domains: dict[str, str], order: str = DNA_ORDER) -> list[Motif]:
    """Motifs of a matrix table for the operators; domains: of each motif's name.  A matrix is a few dozen rows."""
    found: dict[str, dict[int, dict[str, float]]] = {}
    for r in table.where(F.col("motif").isin(list(domains))).collect():
        found.setdefault(r["motif"], {}).setdefault(r["pos"], {})[r["symbol"]] = r["p"]
    return [Motif(m, domains[m], tuple(tuple(found[m][i][a] for a in order) for i in sorted(found[m])), order) for m in domains if m in found]


def thresholds(table: DataFrame, share: float, letters: int = 4) -> DataFrame:
    """(motif, threshold): the score at a share of the way from the smallest to the largest one."""
    odds = F.log2(F.greatest("p", F.lit(1e-10)) * letters)
    ends = table.groupBy("motif", "pos").agg(F.min(odds).alias("low"), F.max(odds).alias("high"))
    total = ends.groupBy("motif").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return total.select("motif", (F.col("low") + share * (F.col("high") - F.col("low"))).alias("threshold"))


def parse_substitutions(lines: DataFrame, alphabet: str) -> DataFrame:
    """(first, second, score) of (first, line): a line holds a symbol's scores in the alphabet's order."""
    scores = F.transform(F.split(F.trim("line"), r"\s+"), lambda v, i: F.struct(F.substr(F.lit(alphabet), i + 1, F.lit(1)).alias("second"), v.cast("int").alias("score")))
    return lines.select("first", F.explode(scores).alias("s")).select("first", "s.second", "s.score")


def read_substitutions(spark: SparkSession, path: str) -> dict[tuple[str, str], int]:
    """Scores of all pairs from a matrix file: a header of symbols, then a row for each; lines that start with # are notes.

    Gzipped or plain; a matrix is a few hundred numbers.
    """
    rows = [r["value"].split() for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].startswith("#")]
    return {(row[0], symbol): int(x) for row in rows[1:] for symbol, x in zip(rows[0], row[1:])}


