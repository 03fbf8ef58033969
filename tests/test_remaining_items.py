"""Readers, exports and labels that stages give; hand-made rows."""

import json
import os

import pytest

from rankmill.functions.columns import sentinel_null
from rankmill.operators.tables import resolve_key
from rankmill.plans import features, targets
from rankmill.sources import sinks, snapshots


def test_exports_are_read_again_without_their_marks(spark, tmp_path):
    rows = [("A", ["x", "y"], 'say "it"\nand, more', 1.5), ("B", [], "N/A", None), ("C", None, "", 2.0), ("D", ["z"], "nan", 0.0)]
    sinks.write_csv(spark.createDataFrame(rows, "g string, l array<string>, t string, v double"), f"{tmp_path}/csv")
    found = {r["g"]: tuple(r)[1:] for r in snapshots.read_stage_csv(spark, f"{tmp_path}/csv", "g string, l string, t string, v double").collect()}
    assert found == {"A": ("x|y", 'say "it"\nand, more', 1.5), "B": (None, None, None), "C": (None, None, 2.0), "D": ("z", None, 0.0)}


def test_priorities_are_written_if_there_are_any(spark, tmp_path):
    rows = spark.createDataFrame([("A", 5), ("B", 3), ("C", 2), ("D", None)], "gene_symbol string, Step6_Accessibility_Score int")
    assert sinks.write_priorities(rows, f"{tmp_path}/some") and not sinks.write_priorities(rows.where("Step6_Accessibility_Score < 3"), f"{tmp_path}/none")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/some").collect()) == ["A", "B"] and not os.path.exists(f"{tmp_path}/none")


def test_a_gene_column_has_several_names(spark):
    for name in ("Gene", "gene", "Gene_Symbol", "gene_symbol"):
        assert resolve_key(spark.createDataFrame([("A", 1)], f"{name} string, x int")) == name
    with pytest.raises(ValueError, match="none of"):
        resolve_key(spark.createDataFrame([(1,)], "x int"))
    copies = spark.createDataFrame([("A", "p", "q")], "Gene string, pfam_domains string, pfam_domains__s3 string")
    assert targets.export_names(copies).columns == ["Gene", "pfam_domains", "pfam_domains.1"]


def test_marks_of_nothing_are_null(spark):
    said = ["N/A", "Not Found", "Error", "Unknown", "nan", "", None, "unknown", "0", " "]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select(sentinel_null("t")).collect()
    assert [r[0] for r in rows] == [None] * 7 + ["unknown", "0", " "]


def profile(spark, tissues):
    rows = spark.createDataFrame([(g, None, [(t, float(v)) for t, v in d]) for g, d in tissues.items()], snapshots.SCHEMAS["tissue_expression"])
    return {r["gene_symbol"]: r for r in features.expression_profile(rows).collect()}


def test_quality_feasibility_delivery_and_risk_of_expression(spark):
    wide = [(f"Tissue_{i}", 5) for i in range(20)]
    found = profile(spark, {"BLOOD": [("Whole_Blood", 60)], "BRAIN": [("Brain_Cortex", 12)], "LIVER": [("Liver", 3), ("Lung", 0.5)], "WIDE": wide, "FAINT": [("Liver", 0.05)], "NONE": []})
    told = {g: (r["Step7_Expression_Quality"], r["Step7_Target_Validation_Feasibility"].split(" - ")[0], r["Step7_Drug_Delivery_Considerations"], r["Step7_Off_Target_Risk"].split(" - ")[0]) for g, r in found.items()}
    assert told["BLOOD"] == ("Excellent", "Excellent", "Systemic delivery feasible", "Low")
    assert told["BRAIN"] == ("Good", "Excellent", "CNS delivery required (BBB penetration)", "Low")
    assert told["LIVER"] == ("Moderate", "Good", "Targeted delivery to Gastrointestinal may be needed", "Low")
    assert told["WIDE"][0] == "Moderate" and told["WIDE"][3] == "High"
    assert told["FAINT"][:2] == ("Poor", "Poor") and told["NONE"][1:] == ("Poor", "Targeted delivery to Unknown may be needed", "High")


def test_impact_scores_and_confidence_of_disorder(spark):
    genes = spark.createDataFrame([(g, f"U{g}") for g in ("A", "B", "C", "D", "E", "NONE")], "gene_symbol string, uniprot string")
    shares = {"A": [(1, 5)], "B": [(1, 15)], "C": [(1, 30)], "D": [(1, 60)], "E": [(1, 90)]}
    consensus = spark.createDataFrame([(f"U{g}", 100, r) for g, r in shares.items()], snapshots.SCHEMAS["disorder"])
    none = spark.createDataFrame([], "uniprot string, n_low long, n_records long"), spark.createDataFrame([], "uniprot string, sequence string")
    found = {r["gene_symbol"]: r for r in features.disorder(genes, consensus, *none).collect()}
    told = {g: (r["Step8_Druggability_Impact"].split(" - ")[0], r["Step8_Disorder_Score"], r["Step8_Structural_Quality_Score"], r["Step8_Druggability_Confidence"]) for g, r in found.items()}
    sure = "High - MobiDB Consensus"
    assert told == {"A": ("Excellent", 5, 5, sure), "B": ("Excellent", 4, 4, sure), "C": ("Good", 3, 3, sure), "D": ("Challenging", 2, 2, sure), "E": ("Poor", 1, 2, sure), "NONE": ("Unknown", 0, 0, "Low - No Data")}


def test_expression_is_found_through_the_reference(spark):
    reference = spark.createDataFrame([("A", 2, "G9.1"), ("A", 1, "G1.4"), ("B", 1, "G2.1"), ("C", 1, ""), ("D", 1, "G404"), (None, 1, "G1.4")], snapshots.SCHEMAS["gene_reference"])
    one = lambda v: [("Liver", v)]
    expression = spark.createDataFrame([("B", "G1.4", one(1.0)), (None, "G2.1", one(2.0)), ("C", None, one(3.0)), ("E", "G5", one(5.0)), ("A", "G9.1", one(9.0))], snapshots.SCHEMAS["tissue_expression"])
    found = {r["gene"]: r["data"][0]["median"] for r in features.by_gene(expression, reference).collect()}
    assert found == {"A": 1.0, "B": 2.0, "E": 5.0}


def test_a_run_writes_its_reports(spark, tmp_path):
    base = tmp_path / "in"
    rows = {
        "gene_annotation": [{"query": g, "symbol": g, "uniprot": f"U{g}", "name": "kinase" if g == "A" else "other"} for g in "AB"],
        "drug_interactions": [{"gene": "A", "interactions": [{"drug": {"name": f"d{i}", "approved": True}, "interactionScore": 1.0} for i in range(12)]}],
        "protein_entry": [{"gene": "A", "reviewed": True, "primaryAccession": "UA", "keywords": [{"name": "Tyrosine kinase"}], "comments": [{"commentType": "SUBCELLULAR LOCATION", "subcellularLocations": [{"location": {"value": "Secreted"}}]}]}],
        "gene_reference": [{"geneId": "A", "gencodeId": "G1"}], "tissue_expression": [{"gencodeId": "G1", "data": [{"tissueSiteDetailId": "Whole_Blood", "median": 60.0}]}],
        "target_level": [{"sym": "A", "tdl": "Tclin", "fam": "Kinase"}], "literature": [{"gene": "A", "disease": "migraine", "count": 4}],
    }
    for name in snapshots.SCHEMAS:
        (base / name).mkdir(parents=True)
        (base / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in rows.get(name, [])))
    genes = spark.createDataFrame([("A",), ("B",)], "Gene string")
    out, where = targets.run(spark, genes, str(base), reports=f"{tmp_path}/reports", stages=f"{tmp_path}/stages"), f"{tmp_path}/reports"
    held = {r["gene_symbol"]: r for r in out.collect()}
    assert held["A"]["Step7_Max_TPM"] == 60.0 and held["B"]["Step7_GTEx_Data_Available"] is False
    exported = {r["gene_symbol"]: r for r in spark.read.csv(f"{where}/genes", header=True, multiLine=True, escape='"').collect()}
    assert exported["A"]["Step11_Priority"] == held["A"]["Step11_Priority"] and exported.keys() == held.keys()
    assert [r["gene_symbol"] for r in spark.read.csv(f"{where}/summary07", header=True).collect()] == ["A", "B"]
    assert [r["gene_symbol"] for r in spark.read.parquet(f"{where}/accessible").collect()] == ["A"]
    blocks = "\n\n".join(r[0] for r in spark.read.text(f"{where}/validation", wholetext=True).collect())
    assert blocks.count("TARGET: ") == 2 and blocks.index("TARGET: A") < blocks.index("TARGET: B")
    assert "Validated Candidates: 2" in "\n".join(r[0] for r in spark.read.text(f"{where}/validation_head").collect())
    assert "auc: " in "\n".join(r[0] for r in spark.read.text(f"{where}/metrics_small").collect())
    assert spark.read.csv(f"{where}/predictions", header=True).count() == 2
