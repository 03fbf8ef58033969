import json

import pytest
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.plans import features, targets, validation
from rankmill.sources import sinks
from rankmill.sources.snapshots import SCHEMAS, pocket_census

MANY = [{"metadata": {"accession": f"IPR9{i:05d}"}} for i in range(12)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """rows of a few snapshots, all others empty -> the table's rows by gene"""

    def of(rows, until, **more):
        base = tmp_path_factory.mktemp("whole")
        for name in SCHEMAS:
            (base / name).mkdir()
            (base / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in rows.get(name, [])))
        genes = spark.createDataFrame([(r["query"],) for r in rows["gene_annotation"]], "gene_symbol string")
        return {r["gene_symbol"]: r.asDict(recursive=True) for r in targets.run(spark, genes, str(base), until=until, **more).collect()}

    return of


def test_all_domain_ids_classify(run):
    late = {"query": "LATE", "uniprot": "U3", "interpro": [{"id": f"IPR8{i:05d}"} for i in range(12)] + [{"id": "IPR1"}], "pfam": [f"PF8{i:04d}" for i in range(12)] + ["PF1"]}
    rows = {
        "gene_annotation": [{"query": "ENTRY", "uniprot": "U1"}, {"query": "XREF", "uniprot": "U2"}, late, {"query": "NONE", "uniprot": "U4"}],
        "domain_entries": [{"uniprot": "U1", "results": MANY}, {"uniprot": "U1", "results": [{"metadata": {"accession": "IPR1"}}]}, {"uniprot": "U4", "results": MANY}],
        "protein_entry": [{"gene": "XREF", "reviewed": True, "primaryAccession": "U2", "uniProtKBCrossReferences": [{"database": "Pfam", "id": f"PF9{i:04d}"} for i in range(12)] + [{"database": "Pfam", "id": "PF1"}, {"database": "InterPro", "id": "IPR1"}]}],
    }
    out = run(rows, 3, families={"X": {"keywords": [], "ids": ["IPR1", "PF1"]}})
    assert {g: (r["druggable_family_type"], r["druggable_family_confidence"]) for g, r in out.items()} == {"ENTRY": ("X", "LOW"), "XREF": ("X", "LOW"), "LATE": ("X", "MEDIUM"), "NONE": ("", "NONE")}
    assert len(out["LATE"]["interpro_domains"].split("|")) == 10
    assert not [c for c in out["LATE"] if c.startswith("__")]


def test_families_by_default(run):
    rows = {
        "gene_annotation": [{"query": "A", "uniprot": "U1", "pfam": "PF00439"}, {"query": "B", "uniprot": "U2"}, {"query": "C", "uniprot": "U3"}],
        "protein_entry": [{"gene": "B", "reviewed": True, "primaryAccession": "U2", "keywords": [{"name": "Tyrosine kinase"}]}],
    }
    out = run(rows, 3)
    assert len(rules.FAMILIES) == 35
    assert (out["A"]["druggable_family_type"], out["A"]["druggable_family_confidence"]) == ("Bromodomain Protein", "LOW")
    assert (out["B"]["druggable_family_type"], out["B"]["druggable_family_confidence"], out["C"]["is_druggable_family"]) == ("Kinase", "MEDIUM", False)
    assert not any(r["is_druggable_family"] for r in run(rows, 3, families={}).values())


def test_pathways_are_the_first_three_of_their_categories(run):
    answer = [("Component", "aaa"), ("Reactome", "zinc"), ("PMID", "aab"), ("KEGG", "yeast"), ("Process", "p9"), ("Keyword", "aac"), ("WikiPathways", "xeno"), ("KEGG", "alpha"), ("Function", "aad"), ("Process", "p8"), ("Process", "p7"), ("Process", "p1")]
    rows = {
        "gene_annotation": [{"query": "A"}, {"query": "B"}],
        "network_edges": [{"gene": g, "preferredName_B": "AKT1", "score": 900} for g in "AB"],
        "enrichment": [{"gene": "A", "seq": i, "category": c, "description": d} for i, (c, d) in reversed(list(enumerate(answer)))] + [{"gene": "B", "seq": 1, "category": "Component", "description": "aaa"}],
    }
    out = run(rows, 10)
    assert (out["A"]["Step10_Pathways"], out["A"]["Step10_Biological_Processes"]) == ("zinc; yeast; xeno", "p9; p8; p7")
    assert (out["B"]["Step10_Pathways"], out["B"]["Step10_Pathway_Relevance_Score"], out["B"]["Step10_Pathway_Summary"]) == ("", 2, "No pathway data")


def test_combinations(spark):
    schema = "gene_symbol string, Step11_Priority string, Step10_Drug_Target_Interactions int, Step10_Drug_Target_Partners string, Step10_Drug_Target_Families string, Step10_Pathways string, druggable_family_type string, dgidb_num_approved int, Step10_Network_Hub boolean"
    high = "High Priority"
    rows = [("A", high, 1, "AKT1", "Kinases", "Neuroinflammation; Serotonin release; Ion transport", "Enzyme|Kinase", 0, False), ("B", high, 0, "", "", "Calcium signalling", "GPCR", 5, True), ("C", "Medium Priority", 4, "AKT1", "Kinases", "Calcium", "GPCR", 0, False), ("D", high, None, None, None, None, None, 0, False)]
    df = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "gene_symbol string, Step12_Literature_Publications int, Step12_Total_Clinical_Trials int, Step12_Active_Trials int, Step12_Recruiting_Trials int, Step12_Has_Literature_Evidence boolean, Step12_Has_Clinical_Trials boolean")
    out = {r["gene_symbol"]: r for r in validation.validate(df, none).collect()}
    a, b = out["A"], out["B"]
    assert a["Step12_Combination_Strategies"] == "Polypharmacology: Target alongside AKT1; Multi-target approach within Kinases pathways; Sequential dosing to minimize resistance"
    assert a["Step12_Pathway_Combinations"] == "Anti-inflammatory combination (e.g., with NSAIDs or biologics); Serotonergic modulation combination (e.g., with triptans or SSRIs)"
    assert a["Step12_Synthetic_Lethality"] == "Synthetic lethality with phosphatase inhibitors" and a["Step12_Validation_Score"] == 2
    assert (b["Step12_Has_Combination_Potential"], b["Step12_Combination_Strategies"], b["Step12_Validation_Score"]) == (False, "", 2)
    assert b["Step12_Pathway_Combinations"].startswith("Ion channel") and b["Step12_Synthetic_Lethality"].startswith("GPCR desensitization")
    for gene in "CD":
        assert [out[gene][f"Step12_{c}"] for c in ("Has_Combination_Potential", "Combination_Strategies", "Pathway_Combinations", "Synthetic_Lethality")] == [False, "", "", ""]


def test_census_of_pockets(spark, run):
    paths = [(f"/x/binding_pockets/A/{s}_out/pockets/pocket{k}_atm.pdb",) for s, k in (("a", 1), ("a", 2), ("b", 1))]
    rows = {"gene_annotation": [{"query": "A"}, {"query": "B"}]}
    for census, a in ((pocket_census(spark.createDataFrame(paths, "path string")), (3, 2, 1.5)), (None, (0, 0, 0.0))):
        out = run(rows, 6, census=census)
        assert [tuple(out[g][f"Step6_{c}"] for c in ("Total_Pockets", "PDB_Structures", "Avg_Pockets_Per_Structure")) for g in "AB"] == [a, (0, 0, 0.0)]


def test_predictions_by_branch(spark):
    schema = "gene_symbol string, Step11_Composite_Score double, Step12_Literature_Publications int, Step12_Total_Clinical_Trials int, has_approved_drugs boolean, Step9_Target_Development_Level string"
    rows = [("A", 85.04, 5, 0, True, "Tclin"), ("B", 80.0, 4, 0, False, "Tchem"), ("C", 50.0, 10, 1, None, None), ("D", 79.9, 9, 0, False, "Tbio"), ("E", None, 0, 0, False, "Tclin"), ("F", 90.0, 0, 1, False, None)]
    out = {r["Gene"]: r for r in validation.predictions(spark.createDataFrame(rows, schema)).collect()}
    assert len(out["A"]) == 18
    assert {g: r["Final_Confidence"] for g, r in out.items()} == {"A": "Very High", "B": "High", "C": "Medium-High", "D": "Medium", "E": "Low", "F": "Very High"}
    assert {g: r["Literature_Confidence"] for g, r in out.items()} == {"A": "Medium", "B": "Low", "C": "High", "D": "Medium", "E": "Very Low", "F": "Medium"}
    assert (out["A"]["Pipeline_Druggability_Score"], out["A"]["Pipeline_Reasoning"], out["A"]["Literature_Reasoning"]) == (85.0, "Approved drugs exist; Clinical target (Tclin)", "5 publications")
    assert (out["C"]["Pipeline_Reasoning"], out["C"]["Literature_Reasoning"]) == ("Limited evidence", "10 publications; 1 clinical trial(s)")
    assert out["E"]["Final_Prediction"].startswith("CHALLENGING") and out["E"]["Literature_Reasoning"] == "No literature evidence found"


def test_trials_count_once(spark):
    studies = [("ACTIVE_NOT_RECRUITING",), ("RECRUITING",), ("active",), ("COMPLETED",), (None,), ("RECRUITING",)]
    trials = spark.createDataFrame([("A", studies)], "gene string, studies array<struct<overallStatus:string>>")
    papers = spark.createDataFrame([], "gene string, count int, papers array<struct<pmid:string,title:string,pubdate:string>>")
    r = validation.evidence(papers, trials).first()
    assert (r["Step12_Total_Clinical_Trials"], r["Step12_Active_Trials"], r["Step12_Recruiting_Trials"]) == (6, 3, 2)


def test_protocol_lists(spark, tmp_path):
    schema = "gene_symbol string, Step11_Priority string, Step11_Best_Modality string, Step11_SmallMolecule_Score double, Step11_Biologic_Score double, Step11_Is_Biologic_Only boolean, Step9_Protein_Family string, has_approved_drugs boolean"
    rows = [("A", "High Priority", "Small Molecule", 80.0, 50.0, False, "GPCR", True), ("B", "High Priority", "Biologic", 20.0, 70.0, True, "IC", None), ("C", "Low Priority", "Biologic", 1.0, 2.0, True, None, False)]
    found = {}
    for r in sorted(validation.protocol(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r["line"]):
        found.setdefault((r["gene_symbol"], r["section"]), []).append(r["text"])
    assert {g for g, _ in found} == {"A", "B"} and len({s for _, s in found}) == 7
    a, b = found["A", "literature_search_queries"], found["B", "literature_search_queries"]
    assert len(a) == 1 + 4 + 2 and len(b) == 1 + 3 + 1 and a[0] == '"A" AND (drug OR inhibitor OR agonist OR antagonist)'
    assert found["A", "key_evidence_to_find"][0] == "1. Approved drug mechanisms" and found["B", "key_evidence_to_find"][0] == "1. Tool compound papers"
    assert found["A", "validation_experiments"][0] == "Biochemical assays" and found["B", "expected_druggability_markers"][0] == "Secreted or extracellular"
    sinks.write_protocols(validation.protocol(spark.createDataFrame(rows, schema)), f"{tmp_path}/p")
    assert sorted(p.name for p in (tmp_path / "p").glob("gene_symbol=*")) == ["gene_symbol=A", "gene_symbol=B"]


def test_weak_edges_do_not_count(spark):
    edges = spark.createDataFrame([("A", "AKT1", s) for s in (0.39, 0.4, 399.0, 400.0)] + [("B", "AKT1", 0.1)], "gene string, preferredName_B string, score double").withColumn("stringId_B", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "gene string, seq long, category string, description string, term string")
    out = {r["gene_symbol"]: r["Step10_Total_Interactions"] for r in features.network(edges, none).collect()}
    assert out == {"A": 2}


def test_first_reviewed_entry(run):
    rows = {"gene_annotation": [{"query": "A"}], "protein_entry": [{"gene": "A", "seq": 3, "reviewed": True, "primaryAccession": "P1"}, {"gene": "A", "seq": 2, "reviewed": True, "primaryAccession": "P2"}, {"gene": "A", "seq": 1, "reviewed": False, "primaryAccession": "P0"}]}
    assert run(rows, 1)["A"]["uniprot_swissprot"] == "P2"


def test_counts_by_value(spark):
    from rankmill.operators.tables import value_counts

    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in value_counts(df, "x", by_value=True).collect()] == [(None, 1), ("a", 1), ("b", 2)]
    assert [tuple(r) for r in value_counts(df, "x").collect()][0] == ("b", 2)
