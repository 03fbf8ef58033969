"""The whole pipeline, from snapshots to scored and validated genes, a table per stage."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.operators.tables import attach, lookup, resolve_key
from rankmill.plans import composite, features, validation
from rankmill.plans import reports as reports_of
from rankmill.sources import sinks
from rankmill.sources.sinks import stage_store
from rankmill.sources.snapshots import failed_answers, ingest

LAST = 12


def run(
    spark: SparkSession, genes: DataFrame, root: str, *, families: dict | DataFrame | None = None, pockets: DataFrame | None = None, files: DataFrame | None = None, census: DataFrame | None = None,
    sequences: DataFrame | None = None, confidence: DataFrame | None = None, until: int = LAST, location_default: str = "", stages: str | None = None, reports: str | None = None, disease: str = validation.DISEASE,
) -> DataFrame:
    """Stages 1 to ``until`` over the snapshots under ``root``; genes has gene_symbol, or one of its other names.

    Each stage's table is kept under ``stages`` (see ``stage_store``), and so are the snapshots, parsed once; failed answers are left out
    and kept as the table ``refetch``. A stage makes its new columns on the keys alone (``own``) and attaches them to the wide table at
    once, by gene: that table, kept in buckets of genes, isn't shuffled. Pockets (gene_symbol and the pocket numbers), sequences and
    confidence come from their readers, where there are any. Families are those of ``rules.FAMILIES`` unless others are
    given, as a dict or as a table of rules. Files (structure, path) are those of ``structure_files``. The census is that of ``pocket_census``.
    With ``reports`` the exports of the last stage are written there, see ``write_reports``.
    """
    keep = stage_store(spark, stages)
    taken: dict[str, DataFrame] = {}

    def snap(name: str) -> DataFrame:
        if name not in taken:
            taken[name] = ingest(spark, root, name, f"{keep.base}/snapshots")
        return taken[name]

    def own(df: DataFrame, *more: str) -> DataFrame:
        return df.select("gene_symbol", *more)

    def grown(df: DataFrame, side: DataFrame) -> DataFrame:
        """The wide table with the columns of a side that has its genes."""
        return attach(df, side.drop(*[c for c in side.columns if c != "gene_symbol" and c in df.columns]), "gene_symbol", both=True)

    proteins = snap("protein_entry")
    named = genes.select(F.col(resolve_key(genes)).alias("gene_symbol"))
    df = attach(features.unique_genes(named), features.identifiers(snap("gene_annotation"), proteins), "gene_symbol", both=True)
    df = keep(df, "stage01")
    if until >= 2:
        side = attach(own(df, "ensembl_gene_id"), features.drug_interactions(snap("drug_interactions")), "gene_symbol", {"dgidb_found": False, "dgidb_num_interactions": 0, "dgidb_num_approved": 0}, both=True)
        side = attach(side, features.compound_activities(snap("compound_activities")), "gene_symbol", {"chembl_found": False}, both=True)
        side = lookup(side, features.known_drugs(snap("known_drugs")), "ensembl_gene_id", {"opentargets_found": False})
        df = grown(df, features.drug_evidence(side))
    df = keep(df, "stage02")
    entry = proteins.groupBy(F.col("gene").alias("gene_symbol")).agg(F.min_by(F.struct("keywords", "comments", "proteinDescription", "uniProtKBCrossReferences"), features.best_first()).alias("entry"))
    if until >= 3:
        side = attach(own(df, "uniprot_swissprot"), entry, "gene_symbol", both=True)
        side = attach(side, features.annotated_domains(snap("gene_annotation")), "gene_symbol", both=True)
        side = lookup(side, features.domain_entries(snap("domain_entries")).withColumnRenamed("uniprot", "uniprot_swissprot"), "uniprot_swissprot")
        told = keep(features.protein_texts(side), "stage03_texts")  # the rules read it several times
        df = grown(df, features.family_columns(told, families))
    df = keep(df, "stage03")
    if until >= 4:
        named = own(df, "uniprot_swissprot").withColumnRenamed("uniprot_swissprot", "uniprot")
        df = grown(df, features.structures(named, snap("structure_search"), snap("structure_meta"), snap("predicted_structure"), files).drop("uniprot"))
    df = keep(df, "stage04")
    if until >= 5 and pockets is not None:
        df = attach(df, features.best_pockets(features.assess_pockets(pockets)), "gene_symbol", {"fpocket_run": False, "has_druggable_pocket": False}, both=True)
    df = keep(df, "stage05")
    if until >= 6:
        places, sides = features.locations("entry.comments")
        seen = entry.select("gene_symbol", F.array_join(places, "; ").alias("Step6_Subcellular_Location"), F.array_join(sides, "; ").alias("Step6_Topology"))
        counted = {"Step6_Total_Pockets": 0, "Step6_PDB_Structures": 0, "Step6_Avg_Pockets_Per_Structure": 0.0}
        held = census if census is not None else spark.createDataFrame([], "gene string, Step6_Total_Pockets long, Step6_PDB_Structures long, Step6_Avg_Pockets_Per_Structure double")
        side = attach(own(df), held.select(F.col("gene").alias("gene_symbol"), *counted), "gene_symbol", counted, both=True)
        side = attach(side, seen, "gene_symbol", {"Step6_Subcellular_Location": location_default, "Step6_Topology": ""}, both=True)
        df = grown(df, features.accessibility(side))
    df = keep(df, "stage06")
    if until >= 7:
        df = attach(df, features.expression_profile(features.by_gene(snap("tissue_expression"), snap("gene_reference"))), "gene_symbol", {"Step7_GTEx_Data_Available": False}, both=True)
    df = keep(df, "stage07")
    if until >= 8:
        none = lambda schema: spark.createDataFrame([], schema)
        named = own(df, "uniprot_swissprot").withColumnRenamed("uniprot_swissprot", "uniprot")
        low, letters = confidence or none("uniprot string, n_low long, n_records long"), sequences or none("uniprot string, sequence string")
        df = grown(df, features.disorder(named, snap("disorder"), low, letters))
    df = keep(df, "stage08")
    if until >= 9:
        df = attach(df, features.development(snap("target_level")), "gene_symbol", {"Step9_Pharos_Data_Available": False}, both=True)
    df = keep(df, "stage09")
    if until >= 10:
        df = attach(df, features.network(snap("network_edges"), snap("enrichment")), "gene_symbol", {"Step10_STRING_Data_Available": False}, both=True)
    df = keep(df, "stage10")
    if until >= 11:
        df = composite.composite(df)
    df = keep(df, "stage11")
    if until >= 12:
        df = validation.validate(df, validation.evidence(snap("literature"), snap("trials"), disease))
    keep(failed_answers(spark, f"{keep.base}/snapshots", taken), "refetch")
    if reports is not None:
        df = keep(df, "stage12")
        write_reports(df, reports)
    return df


def write_reports(df: DataFrame, path: str) -> None:
    """The last table's exports: itself, a sorted summary of each stage, genes of good access, and, of a validated table, predictions,
    protocols, the validation report and the metrics of both tracks."""
    sinks.write_csv(export_names(df), f"{path}/genes")
    for stage in rules.SUMMARIES:
        sinks.write_csv(reports_of.stage_summary(df, stage), f"{path}/summary{stage:02d}")
    if "Step6_Accessibility_Score" in df.columns:
        sinks.write_priorities(df, f"{path}/accessible")
    if "Step12_Validation_Level" not in df.columns:
        return
    sinks.write_csv(validation.predictions(df), f"{path}/predictions")
    sinks.write_protocols(validation.protocol(df), f"{path}/protocols")
    watch = Observation()
    blocks = reports_of.validation_report(df).observe(watch, F.count(F.lit(1)).alias("n"))
    blocks.select("value").write.mode("overwrite").option("lineSep", "\n\n").text(f"{path}/validation")
    head = reports_of.report_head(watch.get["n"], datetime.datetime.now().isoformat(timespec="seconds"))
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/validation_head")
    for track, score, label in (("small", "Step11_SmallMolecule_Score", "Step12_SM_Literature_Score"), ("biologic", "Step11_Biologic_Score", "Step12_Bio_Literature_Score")):
        row = validation.metrics_with_probability(validation.performance(df, score, label).first().asDict())
        measured = df.sparkSession.createDataFrame([row], ", ".join(f"{c} double" if isinstance(v, float) or v is None else f"{c} long" for c, v in row.items()))
        sinks.metrics_report(measured).write.mode("overwrite").text(f"{path}/metrics_{track}")


def export_names(df: DataFrame) -> DataFrame:
    """Later copies of a column (``name__s3``, ``name__s4``) as ``name.1``, as flat exports have them."""
    return df.toDF(*[c[:-4] + ".1" if c.endswith(("__s3", "__s4")) else c for c in df.columns])
