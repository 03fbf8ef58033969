"""Summaries of stages and reports on validated genes: sorted tables and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.functions.columns import ladder, optional
from rankmill.operators.tables import value_counts
from rankmill.plans.features import unique_genes


def stage_summary(df: DataFrame, stage: int, key: str = "gene_symbol") -> DataFrame:
    """A row per gene with the stage's columns of those that the table has, sorted as that stage is; ties by gene."""
    columns, by, down = rules.SUMMARIES[stage]
    held = df.select(key, *[c for c in columns if c in df.columns])
    order = [F.desc_nulls_last(by) if down else F.asc_nulls_last(by)] if by in df.columns else []
    return unique_genes(held, key).orderBy(*order, key)


def score_counts(df: DataFrame, score: str) -> DataFrame:
    """How many genes have each score, the greatest score first."""
    return value_counts(unique_genes(df.select("gene_symbol", score)), score, down=True)


def family_kinds(df: DataFrame, column: str = "druggable_family_type") -> DataFrame:
    """Families and how many genes are in each, with the kind of family; a gene counts for each of its families."""
    family = F.explode(F.transform(F.split(column, r"\|"), lambda f: F.trim(f)))
    counted = df.where(F.coalesce(column, F.lit("")) != "").select(family.alias("family")).groupBy("family").agg(F.count("*").alias("n"))
    kind = ladder(*[(F.col("family").isin(list(names)), k) for k, names in rules.FAMILY_KINDS.items()], default="other")
    return counted.select(kind.alias("kind"), "family", "n")


def family_coverage(df: DataFrame) -> DataFrame:
    """One row: genes, those with domains of each source and their shares, and the mean numbers of domains."""
    out = [F.count("*").alias("n_genes")]
    for kind in ("pfam", "interpro"):
        count = F.coalesce(f"{kind}_domain_count", F.lit(0))
        out += [F.count_if(count > 0).alias(f"n_{kind}"), F.round(100.0 * F.avg((count > 0).cast("int")), 1).alias(f"pct_{kind}"), F.round(F.avg(count), 1).alias(f"mean_{kind}")]
    return df.agg(*out)


def validation_report(df: DataFrame) -> DataFrame:
    """(score, gene_symbol, value): a block of text for each gene with a validation level, the best validated first.

    Ties are in the order of genes. What the table lacks is 0, or Unknown.
    """
    number = lambda c: F.coalesce(optional(df, c, 0, "double"), F.lit(0.0))
    whole = lambda c: F.coalesce(optional(df, c, 0, "long"), F.lit(0))
    text = lambda c: F.coalesce(optional(df, c, "Unknown", "string"), F.lit("Unknown"))
    track = lambda label, name, read: F.format_string(f"  {label}: %.1f/100 (Literature: %.0f/100)", number(name), number(read))
    blocks: list[Column] = [
        F.concat(F.lit("TARGET: "), F.col("gene_symbol")), F.lit("-" * 80), F.lit(""),
        F.lit("SCORES:"), F.format_string("  Composite: %.1f/100", number("Step11_Composite_Score")),
        track("Small Molecule", "Step11_SmallMolecule_Score", "Step12_SM_Literature_Score"), track("Biologic", "Step11_Biologic_Score", "Step12_Bio_Literature_Score"),
        F.concat(F.lit("  Best Modality: "), text("Step11_Best_Modality")), F.lit(""),
        F.lit("VALIDATION:"), F.concat(F.lit("  Level: "), F.col("Step12_Validation_Level")), F.format_string("  Score: %d/10", whole("Step12_Validation_Score")),
        F.format_string("  Publications: %d", whole("Step12_Literature_Publications")), F.format_string("  Clinical Trials: %d", whole("Step12_Total_Clinical_Trials")),
    ]
    held = df.where("Step12_Validation_Level IS NOT NULL")
    score = whole("Step12_Validation_Score")
    return held.select(score.alias("score"), "gene_symbol", F.concat_ws("\n", *blocks).alias("value")).orderBy(F.desc("score"), "gene_symbol")


def report_head(n: int, made: str) -> str:
    """What stands above the blocks."""
    bar = "=" * 80
    return f"{bar}\nHIGH-PRIORITY CANDIDATE VALIDATION REPORT\nGenerated: {made}\nValidated Candidates: {n}\n{bar}\n"
