import json

import pytest
from pyspark.sql import functions as F

from rankmill.operators.metrics import correlation_p
from rankmill.plans import catalogue, features, targets, validation
from rankmill.sources import sinks, snapshots
from rankmill.streaming.scores import attach_each, score_stream

GENES = ("ADRB2", "IL6", "NONE1")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("snapshots")
    rows = {
        "gene_annotation": [
            {"query": "ADRB2", "seq": 1, "symbol": "OLD"},
            {"query": "ADRB2", "seq": 2, "symbol": "ADRB2", "name": "adrenoceptor beta 2", "alias": ["B2AR", "BAR"], "ensembl": [{"gene": "ENSG1", "transcript": ["T1", "T2"]}, {"gene": "ENSG2"}], "uniprot": {"Swiss-Prot": "P07550", "TrEMBL": ["Q1", "Q2", "Q3", "Q4"]}, "pfam": "PF00001", "interpro": [{"id": "IPR1"}, {"id": "IPR2"}], "genomic_pos": {"chr": "5", "start": 10, "end": 20, "strand": 1}, "pathway": {"kegg": [{"id": "hsa1"}, {"id": "hsa2"}], "reactome": {"id": "R1"}}},
            {"query": "IL6", "symbol": "IL6", "alias": "BSF2", "ensembl": {"gene": "ENSG6"}, "uniprot": "P05231"},
        ],
        "protein_entry": [{"gene": "ADRB2", "reviewed": True, "primaryAccession": "P07550", "sequence": {"length": 413}, "comments": [{"commentType": "SUBCELLULAR LOCATION", "subcellularLocations": [{"location": {"value": "Cell membrane"}, "topology": {"value": "Extracellular"}}]}], "keywords": [{"name": "G-protein coupled receptor"}], "uniProtKBCrossReferences": [{"database": "STRING", "id": "9606.E"}, {"database": "PDB", "id": "2RH1"}]}, {"gene": "ADRB2", "reviewed": False, "primaryAccession": "XX"}, {"gene": "IL6", "reviewed": True, "primaryAccession": "P05231", "comments": [{"commentType": "SUBCELLULAR LOCATION", "subcellularLocations": [{"location": {"value": "Secreted"}}]}]}],
        "drug_interactions": [{"gene": "ADRB2", "interactions": [{"drug": {"name": "a", "approved": True}, "interactionScore": 0.5, "interactionTypes": [{"type": "agonist"}]}, {"drug": {"name": "b", "approved": False}, "interactionScore": 2.0}, {"drug": {"name": "c", "approved": True}}]}],
        "compound_activities": [{"gene": "ADRB2", "target_chembl_id": "C1", "target_type": "SINGLE", "activities": [{"molecule_chembl_id": "m1", "molecule_max_phase": 4}, {"molecule_chembl_id": "m1", "molecule_max_phase": 2}, {"molecule_chembl_id": "m2"}]}],
        "known_drugs": [{"ensembl_id": "ENSG1", "uniqueDrugs": 1, "rows": [{"drug": {"name": "x"}, "drugType": "Small molecule", "phase": 4}, {"drug": {"name": "x"}, "drugType": "Small molecule"}]}],
        "domain_entries": [], "structure_search": [{"uniprot": "P07550", "ids": ["2RH1", "3D4S"]}], "structure_meta": [{"pdb_id": "2RH1", "resolution": 2.4, "method": "X-RAY"}], "predicted_structure": [{"uniprot": "P05231", "avgPlddt": 91.0}],
        "tissue_expression": [{"gene": "ADRB2", "data": [{"tissueSiteDetailId": "Whole_Blood", "median": 12.0}, {"tissueSiteDetailId": "Lung", "median": 4.0}, {"tissueSiteDetailId": "Brain_Cortex", "median": 0.0}, {"tissueSiteDetailId": "Skin_A", "median": 1.0}, {"tissueSiteDetailId": "Spleen", "median": 2.0}]}],
        "disorder": [{"uniprot": "P07550", "length": 100, "regions": [{"start": 1, "end": 10}, {"start": 5, "end": 20}]}],
        "target_level": [{"sym": "ADRB2", "tdl": "Tclin", "fam": "GPCR", "novelty": 0.05}, {"sym": "IL6", "tdl": "Tbio"}],
        "network_edges": [{"gene": "ADRB2", "preferredName_B": p, "score": s} for p, s in (("AKT1", 0.9), ("MAPK1", 0.8), ("ZZZ", 0.99))],
        "enrichment": [{"gene": "ADRB2", "category": "KEGG", "description": "signalling"}, {"gene": "ADRB2", "category": "Process", "description": "response"}],
        "literature": [{"gene": "ADRB2", "count": 12, "papers": [{"pmid": "1", "title": "t", "pubdate": "2020 Jan"}]}], "trials": [{"gene": "ADRB2", "studies": [{"overallStatus": "RECRUITING"}, {"overallStatus": "ACTIVE_NOT_RECRUITING"}]}],
    }
    for name, held in rows.items():
        (base / name).mkdir()
        (base / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in held))
    (base / "genes.json").write_text(sinks.gene_list_json(list(GENES)))
    return str(base)


@pytest.fixture(scope="module")
def table(spark, root):
    genes = snapshots.read_gene_list(spark, f"{root}/genes.json")
    pockets = spark.createDataFrame([("ADRB2", 1, 0.4, 0.2, 600.0, 0.6), ("ADRB2", 2, 0.6, 0.8, 550.0, 0.6), ("IL6", 1, None, 0.0, 0.0, None)], "gene_symbol string, pocket_id int, score double, druggability double, volume double, hydrophobicity double")
    letters = spark.createDataFrame([("P05231", "AAAA")], "uniprot string, sequence string")
    out = targets.run(spark, genes, root, families={"GPCR": {"keywords": ["g-protein coupled receptor", "GPCR"], "ids": ["PF00001"]}, "Cytokine": {"keywords": ["cytokine"]}}, pockets=pockets, sequences=letters)
    return out, {r["gene_symbol"]: r.asDict(recursive=True) for r in out.collect()}


def test_identifiers_and_drugs(table):
    a, i = table[1]["ADRB2"], table[1]["IL6"]
    assert set(table[1]) == set(GENES)
    assert (a["gene_symbol_official"], a["aliases"], a["ensembl_gene_id"], a["uniprot_swissprot"], a["uniprot_trembl"]) == ("ADRB2", "B2AR|BAR", "ENSG1", "P07550", "Q1|Q2|Q3")
    assert (a["interpro_domains"], a["chromosome"], a["start_position"], a["string_id"], a["pdb_ids"]) == ("IPR1|IPR2", "5", 10, "9606.E", "2RH1")
    assert set(a["pathways"].split("|")) == {"kegg:hsa1", "kegg:hsa2", "reactome:R1"} and (i["aliases"], i["uniprot_swissprot"]) == ("BSF2", "P05231")
    assert (a["dgidb_num_interactions"], a["dgidb_num_approved"], a["dgidb_top_5_drugs"]) == (3, 2, "b|a|c")
    assert (a["chembl_approved_drugs"], a["chembl_clinical_compounds"], a["chembl_bioactive_compounds"], a["chembl_total_compounds"], a["chembl_total_activities"]) == (1, 1, 1, 2, 3)
    assert (a["opentargets_approved"], a["druggability_evidence"][:4], table[1]["NONE1"]["druggability_evidence"][:4]) == (1, "HIGH", "NONE")


def test_structure_to_network(table):
    a, i, n = (table[1][g] for g in GENES)
    assert (a["druggable_family_type"], a["druggable_family_confidence"], a["protein_class"]) == ("GPCR", "MEDIUM", "GPCR")
    assert (a["structure_source"], a["structure_quality_score"], i["structure_source"], i["alphafold_quality"], n["structure_source"]) == ("PDB", "Good (2.0-2.5Å)", "AlphaFold", "Very High (>90)", None)
    assert (a["best_pocket_id"], a["has_druggable_pocket"], a["best_pocket_category"], i["has_druggable_pocket"], i["best_pocket_category"]) == (2, True, "Excellent", False, "Poor")
    assert (a["Step6_Druggability_Tier"], i["Step6_Location_Category"], n["Step6_Druggability_Tier"]) == ("Tier 1 - High", "Extracellular/Secreted", "Unassessed")
    assert (a["Step7_Median_TPM"], a["Step7_Tissues_With_Expression"], a["Step7_Blood_Expression"], a["Step7_Overall_Expression_Score"]) == (4.0, 4, "Yes", 9)
    assert (a["Step8_Disordered_Residues"], a["Step8_Disorder_Percentage"], i["Step8_Disorder_Method"], i["Step8_Disorder_Percentage"]) == (26, 26.0, "Composition-based", 90.0)
    assert (n["Step8_Disorder_Percentage"], n["Step8_Disorder_Category"], n["Step8_Disorder_Method"]) == (0.0, "Unknown", "None")
    assert (a["Step9_Overall_Pharos_Score"], i["Step9_Novelty_Score"], i["Step9_Target_Quality"]) == (10, 2, "Good")
    assert (a["Step10_Total_Interactions"], a["Step10_Drug_Target_Partners"], a["Step10_Network_Confidence"], a["Step10_Pathway_Summary"]) == (3, "AKT1; MAPK1", "Low - Limited Evidence", "signalling")


def test_validation(spark, table, tmp_path):
    a = table[1]["ADRB2"]
    assert a["Step12_SM_Literature_Score"] == 70 and a["Step12_SM_Is_Druggable"] == 1
    out = validation.predictions(table[0])
    assert out.count() == 3
    line = validation.performance(table[0], "Step11_SmallMolecule_Score", "Step12_SM_Literature_Score").first().asDict()
    assert line["n"] == 3 and line["tn"] + line["fp"] + line["fn"] + line["tp"] == 3
    assert "auc" in sinks.metrics_report(spark.createDataFrame([line])).first()["value"]
    sinks.write_csv(table[0].select("gene_symbol", "aliases"), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3


def test_text_readers(spark, tmp_path):
    text = "Pocket 1 :\n\tScore :  0.5\n\tDruggability Score : 0.9\n\tVolume : 600.5\n\tHydrophobicity score: -3.2\n\tNumber of Alpha Spheres : 7\nPocket 2 :\n\tScore : 0.1\n"
    rows = [r.asDict() for r in snapshots.pocket_sections(spark.createDataFrame([("p", text)], "path string, value string")).orderBy("pocket_id").collect()]
    assert (rows[0]["pocket_id"], rows[0]["score"], rows[0]["druggability"], rows[0]["volume"], rows[0]["hydrophobicity"], rows[0]["alpha_spheres"]) == (1, 0.5, 0.9, 600.5, None, 7)
    assert rows[1]["pocket_id"] == 2 and rows[1]["volume"] is None
    (tmp_path / "P1.fasta").write_text(">sp|P1\nMKV\nLA\n")
    assert snapshots.read_sequences(spark, f"{tmp_path}/*.fasta").collect()[0]["sequence"] == "MKVLA"
    (tmp_path / "AF-P1-F1.pdb").write_text("".join(f"ATOM  {1:5d}  CA  ALA A   1      11.000  11.000  11.000  1.00{x:6.2f}\n" for x in (40.0, 80.0)) + "TER\n")
    assert snapshots.read_confidence(spark, f"{tmp_path}/*.pdb").collect()[0][1:] == (60.0, 1, 2)
    census = snapshots.pocket_census(spark.createDataFrame([(f"/x/binding_pockets/G/{s}_out/pockets/pocket{k}_atm.pdb",) for s, k in (("a", 1), ("a", 2), ("b", 1))], "path string")).first()
    assert (census["Step6_PDB_Structures"], census["Step6_Total_Pockets"], census["Step6_Avg_Pockets_Per_Structure"]) == (2, 3, 1.5)


def test_overlapping_regions_can_be_merged(spark):
    genes = spark.createDataFrame([("G", "U")], "gene_symbol string, uniprot string")
    regions = spark.createDataFrame([("U", 100, [(1, 10), (5, 20)])], "uniprot string, length int, regions array<struct<start:int,end:int>>")
    none = spark.createDataFrame([], "uniprot string, n_low long, n_records long"), spark.createDataFrame([], "uniprot string, sequence string")
    assert [features.disorder(genes, regions, *none, merged=m).first()["Step8_Disordered_Residues"] for m in (False, True)] == [26, 20]


def test_probability_of_correlation():
    assert correlation_p(0.5, 12) == pytest.approx(0.0979, abs=2e-4) and correlation_p(0.0, 10) == pytest.approx(1.0) and correlation_p(None, 5) is None


def test_streams_score_like_batches(spark, tmp_path):
    rows = spark.createDataFrame([("A", 12, "GPCR"), ("B", 0, None)], "gene_symbol string, dgidb_num_approved int, Step9_Protein_Family string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    attach_each(stream, score_stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    found = sorted((r["gene_symbol"], r["Step11_SmallMolecule_Score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == sorted((r["gene_symbol"], r["Step11_SmallMolecule_Score"]) for r in score_stream(rows).collect())


def test_catalogue_is_complete():
    assert len(catalogue.QUERIES) >= 45 and set(catalogue.SQL) == set(catalogue.QUERIES)
    assert F is not None
