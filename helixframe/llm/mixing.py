"""Mixing sources to target weights over a tree of domains, languages and sources.

Tokens here are runs of characters that are not white space.

A token budget goes down the tree by the children's weights.  A node can't take more than its subtree's tokens
times the most epochs; what it can't take goes to its siblings by their weights, and only what no sibling
can take is left to the level above.  A leaf's budget is filled with whole epochs, each of all its documents,
and a prefix of one more epoch: its documents in the order of a hash of seed, epoch and doc_id, as many as
fit the rest of the budget.

Documents without words have no tokens and are never selected.  Null domains, languages and sources count as
empty names.  Rows that repeat a doc_id are ordered together and share their fate if all of them fit.  A tree without weights
or tokens selects nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, free_name, table

LEAF = ("domain", "lang", "source")
#: Most leaves of a tree; leaves, not documents, are what the driver holds.
MOST_LEAVES = 100_000
#: Documents in a range of hashes within which a prefix is summed document by document.
RANGE_DOCS = 2048


@dataclass
class Recipe:
    """Weights of the tree, and how many tokens to take."""

    domains: Mapping[str, float] = field(default_factory=dict)
    langs: Mapping[str, float] = field(default_factory=dict)
    sources: Mapping[str, float] = field(default_factory=dict)
    #: Weight of a name that has none of its own.
    other: float = 1.0
    #: Budget as a share of all tokens, or as a number of tokens.
    share: float = 0.9
    tokens: int | None = None
    most_epochs: int = 2
    seed: int = 17

    def weight(self, level: int, name: str) -> Fraction:
        return Fraction((self.domains, self.langs, self.sources)[level].get(name, self.other)).limit_denominator(10**6)


def share_out(budget: int, weights: list[Fraction], most: list[int]) -> list[int]:
    """Shares of a budget by weight, none above its most; whole tokens, the largest remainders first, then in order."""
    got = [Fraction(0)] * len(weights)
    left, open_ = Fraction(min(budget, sum(m for m, w in zip(most, weights) if w > 0))), [i for i, w in enumerate(weights) if w > 0]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most[i]]
        if not full:
            for i in open_:
                got[i] = left * weights[i] / total
            break
        for i in full:
            got[i] = Fraction(most[i])
        left -= sum(most[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    whole = [int(g) for g in got]
    spare = int(sum(got)) - sum(whole)
    for i in sorted(range(len(got)), key=lambda i: (whole[i] - got[i], i))[:spare]:
        whole[i] += 1
    return whole


def budgets(tokens: Mapping[tuple[str, str, str], int], recipe: Recipe) -> dict[tuple[str, str, str], int]:
    """Token budget of each leaf (domain, lang, source)."""
    out: dict[tuple[str, str, str], int] = {}

    def down(leaves: dict[tuple[str, str, str], int], level: int, budget: int) -> None:
        if level == len(LEAF):
            out.update(dict.fromkeys(leaves, budget))
            return
        children: dict[str, dict] = {}
        for leaf, n in sorted(leaves.items()):
            children.setdefault(leaf[level], {})[leaf] = n
        most = [subtree(c, level + 1) for c in children.values()]
        for child, got in zip(children, share_out(budget, [recipe.weight(level, c) for c in children], most)):
            down(children[child], level + 1, got)

    def subtree(leaves: dict[tuple[str, str, str], int], level: int) -> int:
        """What a subtree can take: leaves below a weight of zero take nothing."""
        return sum(n * recipe.most_epochs for leaf, n in leaves.items() if all(recipe.weight(k, leaf[k]) > 0 for k in range(level, len(LEAF))))

    total = sum(tokens.values())
    down(dict(tokens), 0, recipe.tokens if recipe.tokens is not None else int(total * Fraction(recipe.share).limit_denominator(10**6)))
    return out


def place(epoch: Column, seed: int) -> Column:
    """A document's place in the order of an epoch."""
    return F.xxhash64(F.lit(seed), epoch, F.col("_id")).bitwiseAND(F.lit((1 << 62) - 1))


def plan(docs: DataFrame, domain: Column, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, whole_epochs, cut_place, cut_id): how far each leaf's documents are taken.

    A row for each leaf.  Text is read once, to count words, and never shuffled.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    sized = cut(keyed(docs, domain, words.alias("n")).where("n > 0"))
    sums = sized.groupBy(*LEAF_COLUMNS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    leaves = sums.limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves")
    tokens = {(r["_domain"], r["_lang"], r["_source"]): r["tokens"] for r in leaves}
    given = budgets(tokens, recipe) if tokens else {}
    # the hash space of each leaf is cut into ranges of about RANGE_DOCS documents
    ranges = {(r["_domain"], r["_lang"], r["_source"]): max(0, r["docs"] // RANGE_DOCS).bit_length() for r in leaves}
    rows = [(*leaf, given[leaf] // n, given[leaf] % n, 62 - ranges[leaf]) for leaf, n in tokens.items()]
    schema = "_domain string, _lang string, _source string, _whole int, _rest long, _shift int"
    targets = spark.createDataFrame(rows, schema)
    placed = sized.join(targets, LEAF_COLUMNS).where("_rest > 0").withColumn("_place", place(F.col("_whole"), recipe.seed))
    # tokens before each range, then the range in which the rest runs out, then its documents one by one
    placed = placed.withColumn("_range", F.expr("shiftright(_place, _shift)"))
    per_range = placed.groupBy(*LEAF_COLUMNS, "_range", "_rest").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*LEAF_COLUMNS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    edges = (
        per_range.withColumn("_before", F.coalesce(before, F.lit(0)))
        .where("_before <= _rest and _before + n > _rest")
        .select(*LEAF_COLUMNS, "_range", "_before")
    )
    here = placed.join(edges, [*LEAF_COLUMNS, "_range"])
    so_far = F.sum("n").over(Window.partitionBy(*LEAF_COLUMNS).orderBy("_place", "_id"))
    # the first place that does not fit; every leaf with a rest has one, as its tokens exceed the rest
    cuts = (
        here.withColumn("_sum", F.col("_before") + so_far)
        .where("_sum > _rest")
        .groupBy(*LEAF_COLUMNS)
        .agg(F.min(F.struct("_place", "_id")).alias("_cut"))
    )
    return cut(targets.join(cuts, LEAF_COLUMNS, "left").select(*LEAF_COLUMNS, "_whole", F.col("_cut._place").alias("_cut_place"), F.col("_cut._id").alias("_cut_id")))


LEAF_COLUMNS = ["_domain", "_lang", "_source"]


def keyed(docs: DataFrame, domain: Column, *more: Column) -> DataFrame:
    """The leaf and id of each row and what else is asked for; docs' own columns only if asked for, so no name clashes."""
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEAF_COLUMNS)]
    return docs.select(*named, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"), *more)


def mix(docs: DataFrame, domain: Column, recipe: Recipe, epoch: str | None = "_epoch") -> DataFrame:
    """docs as often as the recipe takes them, with the epoch (from 0) as one more last column, unless epoch is None.

    docs: doc_id, text, lang, source; all columns stay as they are, whatever their names: an epoch whose name docs
    has gets underscores behind it.  domain: a column of docs' columns.
    """
    taken = plan(docs, domain, recipe)
    # plan() refuses more than MOST_LEAVES rows of three names and numbers, so they can go to every task
    has_words = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("_has_words")
    out = keyed(docs, domain, has_words, F.struct(*[docs[c] for c in docs.columns]).alias("_doc")).join(F.broadcast(taken), LEAF_COLUMNS)
    at = place(F.col("_whole"), recipe.seed)
    within = F.coalesce((at < F.col("_cut_place")) | (at == F.col("_cut_place")) & (F.col("_id") < F.col("_cut_id")), F.lit(False))
    copies = F.when(F.col("_has_words"), F.col("_whole") + within.cast("int")).otherwise(0)
    made = out.select("_doc", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))).alias("_nth"))
    named = [] if epoch is None else [F.col("_nth").alias(free_name(epoch, docs.columns))]
    return made.select("_doc.*", *named)


def domain_of(source: Column) -> Column:
    """The domain of a source in the registered query: one of four, by the source's name."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 4)


#: The registered query's and the pipeline's weights.
RECIPE = Recipe(
    domains={"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1},
    langs={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    other=0.05,
)


def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    domain = domain_of(F.col("source"))
    out = mix(docs, domain, RECIPE)
    words = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    return out.select("doc_id", domain.alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"), words.alias("n_tokens"))
