import pytest

from rankmill.plans.composite import composite

SCHEMA = "gene_symbol string, dgidb_num_approved int, has_approved_drugs boolean, opentargets_drug_types string, Step9_Protein_Family string, druggable_family_type string, druggable_family_confidence string, has_druggable_pocket boolean, best_pocket_volume double, best_pocket_druggability double, Step6_Druggability_Tier string, Step6_Subcellular_Location string, Step6_Topology string, Step7_GTEx_Data_Available boolean, Step7_Tissues_With_Expression int, Step7_Max_TPM double, Step8_Disorder_Percentage double, Step9_Target_Development_Level string, Step10_STRING_Data_Available boolean, Step10_Drug_Target_Interactions int, Step10_Network_Hub boolean"


def row(gene, approved, pocket, disorder, tpm, targets):
    return (gene, approved, True, "Small molecule", "GPCR", "GPCR", "HIGH", pocket[0], pocket[1], pocket[2], "Tier 1 - High", "Cell membrane; Early endosome", "Multi-pass; Extracellular; Cytoplasmic", True, 54, tpm, disorder, "Tclin", True, targets, True)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [row("ADRB2", 85, (True, 389.616, 0.095), 19.73, 31.851, 1), row("ADRB1", 69, (True, 388.968, 0.157), 23.36, 24.293, 0), row("ADRA1A", 81, (False, None, None), 38.74, 14.138, 0)]
    rows.append(("IL17A", 0, None, "Antibody", "Unknown", None, None, None, None, None, None, "Secreted", None, None, None, None, None, "Tbio", None, None, None))
    rows.append(("EMPTY", *[None] * 20))
    return {r["gene_symbol"]: r for r in composite(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(("gene", "sm", "bio", "label"), [("ADRB2", 80.34, 53.0, "High"), ("ADRB1", 78.28, 52.0, "Medium"), ("ADRA1A", 75.17, 52.0, "Medium")])
def test_known_scores(scored, gene, sm, bio, label):
    r = scored[gene]
    assert (r["Step11_SmallMolecule_Score"], r["Step11_Biologic_Score"]) == (sm, bio)
    assert r["Step11_Classification"] == f"{label} Druggability" and r["Step11_Best_Modality"] == "Small Molecule"


def test_biologic_only_and_empty(scored):
    il = scored["IL17A"]
    assert il["Step11_Is_Biologic_Only"] and il["Step11_SmallMolecule_Score"] <= 20 and il["Step11_Best_Modality"] == "Biologic"
    assert il["Step11_Bio_Access_Score"] == 10 and il["Step11_Bio_Drugs_Score"] == 8
    empty = scored["EMPTY"]
    assert empty["Step11_SmallMolecule_Score"] == 0 and empty["Step11_Evidence"] == "Limited evidence" and not empty["Step11_Is_Biologic_Only"]
