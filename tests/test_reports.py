"""Names of domains, structures and their files, summaries and the report."""

import pytest

from rankmill.functions import rules
from rankmill.plans import features, reports
from rankmill.sources.snapshots import SCHEMAS, read_snapshot, still_missing, structure_files


def test_entries_have_names_families_and_types(spark, tmp_path):
    lines = [
        '{"uniprot": "U1", "seq": 2, "results": [{"metadata": {"accession": "I3", "name": "late", "type": "Family"}}]}',
        '{"uniprot": "U1", "seq": 1, "results": [{"metadata": {"accession": "I1", "name": {"name": "from an object"}, "type": "Family"}}, {"metadata": {"accession": "I2", "name": "plain", "type": "Domain"}}, {"metadata": {"accession": "I4", "name": "", "type": "Family"}}]}',
        '{"uniprot": "U2", "results": []}',
        '{"uniprot": "U3"}',
    ]
    (tmp_path / "domain_entries").write_text("\n".join(lines))
    out = {r["uniprot"]: r for r in features.domain_entries(read_snapshot(spark, str(tmp_path), "domain_entries")).collect()}
    assert out["U1"]["__entries"] == ["I1", "I2", "I4", "I3"]
    assert (out["U1"]["interpro_families"], out["U1"]["interpro_entry_types"]) == ("I1:from an object|I3:late", "Family|Domain")
    assert all((out[u]["interpro_families"], out[u]["interpro_entry_types"]) == (None, None) for u in ("U2", "U3"))


def test_cross_references_have_names(spark):
    schema = "refs array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>"
    rows = [([("Pfam", "PF1", [("EntryName", "one"), ("x", "y")]), ("Pfam", "PF2", []), ("Pfam", "PF3", None), ("InterPro", "I1", [("EntryName", "")]), ("Pfam", None, None)],), (None,), ([],)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(*features.cross_references("refs", "Pfam")).collect()
    assert [tuple(r) for r in got] == [(["PF1", "PF2", "PF3"], ["PF1:one", "PF2", "PF3"]), ([], []), ([], [])]


def test_evidence_names_family_and_kind(spark):
    families = {"A": {"keywords": ["kin"], "ids": ["IPR2", "IPR1", "PF1"]}, "B": {"keywords": [], "ids": ["PF1"]}}
    df = spark.createDataFrame([("Kinase", ["PF1", "IPR1", "IPR2"]), ("other", []), (None, None)], "t string, i array<string>")
    rows = features.classify_families(df, df["t"], features.first_list("i"), families).collect()
    assert rows[0]["druggable_family_evidence"] == "A: Keyword: kin|A: InterPro: IPR2|A: InterPro: IPR1|A: Pfam: PF1|B: Pfam: PF1"
    assert [(r["druggable_family_type"], r["druggable_family_confidence"], r["druggable_family_evidence"]) for r in rows[1:]] == [("", "NONE", "")] * 2
    assert rows[0].asDict().keys() == {"t", "i", "is_druggable_family", "druggable_family_type", "druggable_family_confidence", "druggable_family_evidence"}


def _structures(spark, files):
    genes = spark.createDataFrame([(g, f"U{g}") for g in "ABCDEFG"] + [("H", None)], "gene_symbol string, uniprot string")
    search = spark.createDataFrame([(f"U{g}", [f"{g}1", "X"]) for g in "ABCD"] + [("UG", [])], "uniprot string, ids array<string>")
    meta = spark.createDataFrame([("A1", "t", "X-RAY", 2.0, "d", "o"), ("B1", None, None, 2.6, None, None), ("C1", None, None, 3.26, None, None)], SCHEMAS["structure_meta"])
    model = spark.createDataFrame([(f"U{g}", "2022", None, None, p) for g, p in (("A", 95.0), ("E", 49.9), ("F", None), ("G", 70.0))], SCHEMAS["predicted_structure"])
    return {r["gene_symbol"]: r for r in features.structures(genes, search, meta, model, files).collect()}


def test_quality_of_structures(spark):
    out = _structures(spark, None)
    assert {g: r["structure_quality_score"] for g, r in out.items()} == {"A": "Excellent (<2.0Å)", "B": "Moderate (2.5-3.0Å)", "C": "Low (>3.3Å)", "D": None, "E": "Very Low (<50)", "F": "Unknown", "G": "High (70-90)", "H": None}
    assert {g: r["structure_source"] for g, r in out.items()} == {"A": "PDB", "B": "PDB", "C": "PDB", "D": "PDB", "E": "AlphaFold", "F": "AlphaFold", "G": "AlphaFold", "H": None}
    assert (out["A"]["alphafold_quality"], out["B"]["alphafold_quality"]) == ("Very High (>90)", None)
    assert out["A"]["alphafold_model_url"] == f"{rules.MODEL_FILES}/AF-UA-F1-model_v4.pdb" and out["B"]["alphafold_model_url"] is None
    assert (out["A"]["best_pdb_title"], out["A"]["best_pdb_date"], out["A"]["best_pdb_organism"]) == ("t", "d", "o")


def test_files_decide_the_source(spark, tmp_path):
    for folder, names in (("own", ("A1.pdb", "notes.txt")), ("model", ("AF-UE-F1-model_v4.pdb", "AF-UA-F1-model_v4.pdb"))):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_text("ATOM")
    files = structure_files(spark, f"{tmp_path}/own", f"{tmp_path}/model")
    assert {r["structure"]: r["path"].rsplit("/", 1)[1] for r in files.collect()} == {"A1": "A1.pdb", "UE": "AF-UE-F1-model_v4.pdb", "UA": "AF-UA-F1-model_v4.pdb"}
    out = _structures(spark, files)
    assert {g: r["structure_source"] for g, r in out.items()} == {"A": "PDB", "E": "AlphaFold"} | dict.fromkeys("BCDFGH")
    assert out["A"]["structure_file"].endswith("A1.pdb") and out["A"]["alphafold_structure_file"].endswith("AF-UA-F1-model_v4.pdb")
    wanted = spark.createDataFrame([("A1",), ("B1",), ("B1",), (None,)], "structure string")
    assert [r[0] for r in still_missing(wanted, files).collect()] == ["B1"]


def test_pockets_are_listed(spark):
    rows = [("A", 2, 0.4, 0.8, 600.5, None), ("A", 1, 0.4, None, 0.0, None), ("A", 3, None, 0.25, None, None)]
    df = spark.createDataFrame(rows, "gene_symbol string, pocket_id int, score double, druggability double, volume double, hydrophobicity double")
    r = features.best_pockets(features.assess_pockets(df)).first()
    assert (r["pocket_details"], r["all_pockets_volumes"], r["all_pockets_druggability"]) == ("P1:Vol=0:Drug=0.00|P2:Vol=600:Drug=0.80|P3:Vol=0:Drug=0.25", "600", "0.80|0.25")


def test_summaries(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("B", 5, "y"), ("C", None, "z"), ("D", 5, "y"), ("D", 5, "y")], "gene_symbol string, Step9_Overall_Pharos_Score int, Step9_Protein_Family string")
    out = reports.stage_summary(df, 9)
    assert out.columns == ["gene_symbol", "Step9_Overall_Pharos_Score", "Step9_Protein_Family"]
    assert [r[0] for r in out.collect()] == ["B", "D", "A", "C"]
    assert [tuple(r) for r in reports.score_counts(df, "Step9_Overall_Pharos_Score").collect()] == [(5, 2), (1, 1), (None, 1)]
    assert reports.stage_summary(df.select("gene_symbol"), 6).count() == 4


@pytest.mark.parametrize("stage", sorted(rules.SUMMARIES))
def test_summary_of_empty_table(spark, stage):
    assert reports.stage_summary(spark.createDataFrame([], "gene_symbol string"), stage).count() == 0


def test_families_by_kind(spark):
    df = spark.createDataFrame([("GPCR|Tubulin",), ("GPCR",), ("Odd",), ("",), (None,)], "druggable_family_type string")
    assert {tuple(r) for r in reports.family_kinds(df).collect()} == {("classic", "GPCR", 2), ("structural", "Tubulin", 1), ("other", "Odd", 1)}
    counts = spark.createDataFrame([(2, 0), (1, None), (0, 0)], "pfam_domain_count int, interpro_domain_count int")
    assert tuple(reports.family_coverage(counts).first()) == (3, 2, 66.7, 1.0, 0, 0.0, 0.0)


def test_report_blocks(spark):
    schema = "gene_symbol string, Step11_Composite_Score double, Step12_SM_Literature_Score int, Step12_Validation_Level string, Step12_Validation_Score int, Step12_Literature_Publications int"
    df = spark.createDataFrame([("A", 81.26, 70, "Moderate Validation", 5, 3), ("B", None, None, "Excellent Validation", 8, None), ("C", 1.0, 1, None, 9, 1)], schema)
    rows = reports.validation_report(df).collect()
    assert [r["gene_symbol"] for r in rows] == ["B", "A"]
    lines = rows[1]["value"].split("\n")
    assert lines[0] == "TARGET: A" and "  Composite: 81.3/100" in lines and "  Small Molecule: 0.0/100 (Literature: 70/100)" in lines
    assert "  Best Modality: Unknown" in lines and "  Score: 5/10" in lines and "  Publications: 3" in lines
    assert "Validated Candidates: 2" in reports.report_head(2, "now")
