"""Choosing one annotation of a variant, and lists of effects. All orders end in (transcript start descending, id), so
that results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms, text

def ties() -> list[Column]:
    return [F.desc("tx_start"), F.asc("transcript_id")]



def _coding() -> Column:
    return terms.is_coding_biotype(F.col("biotype")).cast("int")


def better() -> list[Column]:
    """Coding biotype, MSK canonical, impact, protein notation present."""
    return [_coding().desc(), F.col("msk_canonical").desc(), terms.rank_of_impact(F.col("impact")).desc(), (F.col("hgvsp") != "").desc(), *ties()]


def severe() -> list[Column]:
    """Impact, MSK canonical, coding biotype."""
    return [terms.rank_of_impact(F.col("impact")).desc(), F.col("msk_canonical").desc(), _coding().desc(), *ties()]


def top(annotations: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A window with a limit of one: each map task passes on one row of a key at most."""
    return annotations.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def pick_best(annotations: DataFrame, key: list[str]) -> DataFrame:
    return top(annotations, key, better())


def most_severe(annotations: DataFrame, key: list[str]) -> DataFrame:
    return top(annotations, key, severe())


def best_for_maf(annotations: DataFrame, key: list[str], maf_transcript: str = "maf_transcript", maf_gene: str = "maf_gene", maf_consequence: str = "maf_consequence") -> DataFrame:
    """The annotation to hold against a MAF row: its own transcript (unless the row is coding and the transcript isn't),
    else its gene, else any."""
    same = (F.col(maf_transcript) != "") & (text.unversioned(F.col("transcript_id")) == text.unversioned(F.col(maf_transcript)))
    # only the first row of that transcript is looked at
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(same), *ties()))  # dealt by the key alone, as `top` is
    usable = same & (nth == 1) & ~(terms.has_coding(F.col(maf_consequence)) & ~terms.is_coding_biotype(F.col("biotype")))
    level = F.when(usable, 0).when((F.col(maf_gene) != "") & (F.col("gene_name") == F.col(maf_gene)), 1).otherwise(2)
    return top(annotations.withColumn("_level", level), key, [F.asc("_level"), *better()]).drop("_level")


def most_severe_term(annotations: DataFrame, key: list[str], ordinal: str = "ord") -> DataFrame:
    """The first term of the first annotation of highest impact."""
    first = F.element_at(F.split("consequence", ","), 1)
    return annotations.groupBy(*key).agg(F.max_by(first, F.struct(terms.rank_of_impact(F.col("impact")), -F.col(ordinal))).alias("most_severe_consequence"))


def all_effects(annotations: DataFrame, key: list[str]) -> DataFrame:
    """Every effect of a variant as `gene,consequence,hgvsp,transcript,hgvsc,impact,canonical` joined by semicolons."""
    one = F.concat_ws(",", "gene_name", "consequence", "hgvsp", "transcript_id", "hgvsc", "impact", F.when(F.col("msk_canonical"), "YES").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("tx_start")).alias("a"), F.col("transcript_id").alias("b"), one.alias("e"))))
    return annotations.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ";").alias("all_effects"))
