"""The stages themselves over rows made of the analytic tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.operators.tables import attach, lookup
from rankmill.plans import features, validation
from rankmill.plans.catalogue import query
from rankmill.sources.tables import table


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


# -- evidence, truth and validation ------------------------------------------------------------------------------------

_GENES = """SELECT 'P' || p_partkey AS gene, CASE WHEN p_size > 25 THEN 'High Priority' ELSE 'Low Priority' END AS priority, p_partkey % 12 AS approved, p_size * 3 % 130 AS bioactive, p_size % 4 AS total, p_partkey % 4 AS partners,
    CASE p_partkey % 5 WHEN 0 THEN 'Small molecule' WHEN 1 THEN 'Antibody|Protein' WHEN 2 THEN 'Small molecule|Antibody' ELSE '' END AS kinds, p_partkey % 6 = 0 AS clinical,
    CASE p_partkey % 7 WHEN 0 THEN 'Secreted' WHEN 1 THEN 'Cell membrane' ELSE 'Nucleus' END AS place, CASE p_partkey % 9 WHEN 0 THEN 'Tclin' WHEN 1 THEN 'Tchem' ELSE 'Tbio' END AS tdl FROM part"""


def _genes(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), key).alias("gene_symbol"), F.when(size > 25, "High Priority").otherwise("Low Priority").alias("Step11_Priority"), (key % 12).alias("dgidb_num_approved"), (size * 3 % 130).alias("chembl_bioactive_compounds"),
        (size % 4).alias("chembl_total_compounds"), (key % 4).alias("Step10_Drug_Target_Interactions"), (key % 6 == 0).alias("has_clinical_drugs"),
        F.when(key % 5 == 0, "Small molecule").when(key % 5 == 1, "Antibody|Protein").when(key % 5 == 2, "Small molecule|Antibody").otherwise("").alias("opentargets_drug_types"),
        F.when(key % 7 == 0, "Secreted").when(key % 7 == 1, "Cell membrane").otherwise("Nucleus").alias("subcellular_location"), F.when(key % 9 == 0, "Tclin").when(key % 9 == 1, "Tchem").otherwise("Tbio").alias("Step9_Target_Development_Level"),
    )


@query(f"""WITH genes AS ({_GENES}), papers AS (SELECT 'P' || l_partkey AS gene, count(*) FILTER (l_linestatus <> 'F') AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1),
studies AS (SELECT 'P' || l_partkey AS gene, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1), truth AS (
SELECT gene, CASE WHEN contains(kinds, 'Small molecule') AND approved >= 10 THEN 100 WHEN contains(kinds, 'Small molecule') AND approved >= 5 THEN 90 WHEN contains(kinds, 'Small molecule') AND approved >= 3 THEN 80
  WHEN contains(kinds, 'Small molecule') AND approved >= 1 THEN 70 WHEN clinical AND contains(kinds, 'Small molecule') THEN 60 WHEN bioactive >= 100 THEN 50 WHEN bioactive >= 50 THEN 40 WHEN bioactive >= 10 THEN 30
  WHEN tdl = 'Tclin' THEN 50 WHEN tdl = 'Tchem' THEN 40 ELSE 20 END AS sm,
  CASE WHEN contains(kinds, 'Antibody') AND approved >= 5 THEN 100 WHEN contains(kinds, 'Antibody') AND approved >= 1 THEN 90 WHEN clinical AND contains(kinds, 'Antibody') THEN 70 WHEN place = 'Secreted' THEN 60 WHEN place = 'Cell membrane' THEN 50 ELSE 30 END AS bio FROM genes),
seen AS (SELECT genes.*, sm, bio, priority = 'High Priority' AS asked, CASE WHEN priority = 'High Priority' THEN coalesce(papers.n, 0) ELSE 0 END AS papers, CASE WHEN priority = 'High Priority' THEN coalesce(studies.n, 0) ELSE 0 END AS trials
  FROM genes JOIN truth USING (gene) LEFT JOIN papers USING (gene) LEFT JOIN studies USING (gene)),
scored AS (SELECT *, 3 * CAST(papers > 0 AS INT) + 3 * CAST(trials > 0 AS INT) + 2 * CAST(asked AND (approved > 0 OR bioactive > 0) AS INT) + 2 * CAST(asked AND partners > 0 AS INT) AS score FROM seen)
SELECT gene, CAST(sm AS BIGINT) AS sm, CAST(bio AS BIGINT) AS bio, CAST(sm >= 70 AS BIGINT) AS sm_truth, CAST(bio >= 70 AS BIGINT) AS bio_truth, CAST(papers AS BIGINT) AS papers, CAST(trials AS BIGINT) AS trials, CAST(least(trials, 5) // 2 AS BIGINT) * CAST(asked AS BIGINT) AS recruiting,
CASE WHEN NOT asked THEN 'Not assessed' WHEN approved > 0 THEN 'Excellent - Approved drugs available' WHEN bioactive >= 10 THEN 'Good - Multiple bioactive compounds' WHEN bioactive > 0 THEN 'Moderate - Limited compounds'
  WHEN total > 0 THEN 'Poor - Only screening compounds' ELSE 'None - No compounds available' END AS probes, CAST(score AS BIGINT) AS score,
CASE WHEN score >= 8 THEN 'Excellent Validation' WHEN score >= 6 THEN 'Strong Validation' WHEN score >= 4 THEN 'Moderate Validation' WHEN score >= 2 THEN 'Preliminary Validation' ELSE 'Limited Validation' END AS level FROM scored""")
def q_stage_validation(spark, sf):
    lines, gene = table(spark, sf, "lineitem"), F.concat(F.lit("P"), "l_partkey").alias("gene")
    none = F.array().cast("array<struct<pmid:string,title:string,pubdate:string>>")
    papers = lines.where("l_partkey % 3 <> 0").groupBy(gene).agg(F.count_if(F.col("l_linestatus") != "F").cast("int").alias("count")).withColumn("papers", none)
    trials = lines.where("l_partkey % 2 = 0").groupBy(gene).agg(F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n"))
    status = lambda i: F.struct(F.when(i % 2 == 0, "RECRUITING").otherwise("COMPLETED").alias("overallStatus"))
    trials = trials.select("gene", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), "n"), status)).otherwise(F.array().cast("array<struct<overallStatus:string>>")).alias("studies"))
    out = validation.validate(_genes(spark, sf), validation.evidence(papers, trials))
    shown = {"sm": "SM_Literature_Score", "bio": "Bio_Literature_Score", "sm_truth": "SM_Is_Druggable", "bio_truth": "Bio_Is_Druggable", "papers": "Literature_Publications", "trials": "Total_Clinical_Trials", "recruiting": "Recruiting_Trials", "score": "Validation_Score"}
    return out.select(F.col("gene_symbol").alias("gene"), *[F.col(f"Step12_{c}").cast("bigint").alias(k) for k, c in shown.items()], F.col("Step12_Probe_Quality").alias("probes"), F.col("Step12_Validation_Level").alias("level"))


# -- protocols ---------------------------------------------------------------------------------------------------------

_FAMILY = "CASE p_partkey % 4 WHEN 0 THEN 'GPCR' WHEN 1 THEN 'Kinase' WHEN 2 THEN 'IC' ELSE 'NR' END"
_ASKED = {"any": "true", "small": "(modality = 'Small Molecule' OR sm > bio)", "biologic": "(modality = 'Biologic' OR bio > sm)", **{f: f"family = '{f}'" for f in ("GPCR", "Kinase", "IC")}}
_QUERIES = ", ".join(f"CASE WHEN {_ASKED[k]} THEN '\"' || gene || '\" AND ' || {quoted(q)} END" for k, each in rules.SEARCHES for q in each)
_either = lambda when, yes, no: f"CASE WHEN {when} THEN {listed(yes)} ELSE {listed(no)} END"
_SECTIONS = {
    "predicted_modality": "[modality]",
    "literature_search_queries": f"[q FOR q IN [{_QUERIES}] IF q IS NOT NULL]",
    "key_evidence_to_find": _either("drugs", rules.EVIDENCE_WITH_DRUGS, rules.EVIDENCE_WITHOUT),
    "validation_experiments": _either("modality = 'Small Molecule'", rules.EXPERIMENTS_SMALL, rules.EXPERIMENTS_OTHER),
    "red_flags_to_check": listed(rules.RED_FLAGS),
    "expected_druggability_markers": _either("modality = 'Small Molecule'", rules.MARKERS_SMALL, rules.MARKERS_OTHER),
    "literature_validation_checklist": listed(rules.CHECKLIST),
}


@query(f"""WITH genes AS (SELECT 'P' || p_partkey AS gene, CASE p_partkey % 3 WHEN 0 THEN 'Small Molecule' WHEN 1 THEN 'Biologic' ELSE 'Both' END AS modality, p_size % 10 AS sm, p_partkey % 10 AS bio, {_FAMILY} AS family, p_partkey % 2 = 0 AS drugs FROM part WHERE p_size > 40),
told AS ({" UNION ALL ".join(f"SELECT gene, '{name}' AS section, {texts} AS t FROM genes" for name, texts in _SECTIONS.items())})
SELECT gene, section, CAST(i AS BIGINT) AS line, t[i + 1] AS text FROM (SELECT gene, section, t, unnest(range(len(t))) AS i FROM told)""")
def q_stage_protocol(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("P"), key).alias("gene_symbol"), F.when(size > 40, "High Priority").otherwise("Medium Priority").alias("Step11_Priority"), F.when(key % 3 == 0, "Small Molecule").when(key % 3 == 1, "Biologic").otherwise("Both").alias("Step11_Best_Modality"),
        (size % 10).alias("Step11_SmallMolecule_Score"), (key % 10).alias("Step11_Biologic_Score"), F.when(key % 4 == 0, "GPCR").when(key % 4 == 1, "Kinase").when(key % 4 == 2, "IC").otherwise("NR").alias("Step9_Protein_Family"), (key % 2 == 0).alias("has_approved_drugs"),
    )
    return validation.protocol(rows).select(F.col("gene_symbol").alias("gene"), "section", F.col("line").cast("bigint").alias("line"), "text")


# -- networks ----------------------------------------------------------------------------------------------------------

_KNOWN = [(k, v) for k, vs in rules.DRUG_TARGETS.items() for v in vs]
_NAMES = [v for _, v in _KNOWN] + [f"X{i}" for i in range(40)]


@query(f"""WITH known(family, partner) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in dict((v, k) for k, v in reversed(_KNOWN)).items() for k, v in [(v, k)])}), edges AS (
SELECT gene, partner, max(q) * 20.0 AS score FROM (SELECT 'P' || l_partkey AS gene, {listed(_NAMES)}[1 + l_suppkey * 7 % {len(_NAMES)}] AS partner, l_quantity AS q FROM lineitem) GROUP BY 1, 2),
top AS (SELECT e.*, family, row_number() OVER (PARTITION BY gene ORDER BY score DESC, e.partner) AS r FROM edges e LEFT JOIN known USING (partner) WHERE score >= 400 QUALIFY r <= 20), kinds AS (
SELECT gene, string_agg(family, '; ' ORDER BY r) AS families FROM (SELECT gene, family, min(r) AS r FROM top WHERE family IS NOT NULL GROUP BY 1, 2) GROUP BY 1), sums AS (
SELECT gene, count(*) AS n, count(*) FILTER (score > 700) AS high, count(family) AS dt, list(partner ORDER BY r) AS partners, coalesce(list(partner ORDER BY r) FILTER (family IS NOT NULL), []) AS targets FROM top GROUP BY 1), terms AS (
SELECT 'P' || l_partkey AS gene, CASE l_linenumber % 3 WHEN 0 THEN 'process' WHEN 1 THEN 'pathway' END AS kind, l_orderkey AS seq, l_linestatus || ' ' || l_linenumber AS text FROM lineitem WHERE l_linenumber % 3 < 2 AND l_returnflag = 'R'),
first AS (SELECT gene, string_agg(text, '; ' ORDER BY r) FILTER (kind = 'pathway') AS pathways, string_agg(text, '; ' ORDER BY r) FILTER (kind = 'process') AS processes, greatest(count(*) FILTER (kind = 'pathway'), count(*) FILTER (kind = 'process')) AS terms FROM
(SELECT *, row_number() OVER (PARTITION BY gene, kind ORDER BY seq, text) AS r FROM terms QUALIFY r <= 3) GROUP BY 1), points AS (
SELECT *, CASE WHEN n >= 15 THEN 5 WHEN n >= 10 THEN 4 WHEN n >= 5 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END AS a, CASE WHEN dt >= 5 THEN 5 WHEN dt >= 3 THEN 4 WHEN dt >= 2 THEN 3 WHEN dt >= 1 THEN 2 ELSE 1 END AS b FROM sums FULL JOIN first USING (gene) LEFT JOIN kinds USING (gene))
SELECT gene, n IS NOT NULL AS known, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(dt, 0) AS targets, coalesce(n >= 15, false) AS hub, coalesce(array_to_string(targets[:5], '; '), '') AS target_names, coalesce(families, '') AS families, array_to_string(partners[:10], '; ') AS partners,
coalesce(pathways, '') AS pathways, coalesce(processes, '') AS processes, CASE WHEN n IS NULL THEN 0 ELSE least(a + b, 10) END AS score, CASE WHEN n IS NULL THEN 0 WHEN terms >= 3 THEN 5 WHEN terms = 2 THEN 4 WHEN terms = 1 THEN 3 ELSE 2 END AS relevance,
CASE WHEN n IS NULL THEN 'Unknown' WHEN n >= 15 THEN 'Highly Connected (Hub)' WHEN n >= 10 THEN 'Well Connected' WHEN n >= 5 THEN 'Moderately Connected' ELSE 'Poorly Connected' END AS connectivity,
CASE WHEN n IS NULL THEN 'Unknown' WHEN least(a + b, 10) >= 8 THEN 'Excellent' WHEN least(a + b, 10) >= 6 THEN 'Very Good' WHEN least(a + b, 10) >= 4 THEN 'Good' ELSE 'Moderate' END AS quality FROM points""")
def q_stage_network(spark, sf):
    lines, gene = table(spark, sf, "lineitem"), F.concat(F.lit("P"), "l_partkey").alias("gene")
    partner = F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_suppkey") * 7 % len(_NAMES)).cast("int"))
    edges = lines.groupBy(gene, partner.alias("preferredName_B")).agg((F.max("l_quantity") * 20.0).cast("double").alias("score")).withColumn("stringId_B", F.lit(None).cast("string"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "Process").when(F.col("l_linenumber") % 3 == 1, rules.PATHWAYS[0]).otherwise("PMID")
    terms = lines.where("l_returnflag = 'R'").select(gene, F.col("l_orderkey").alias("seq"), kind.alias("category"), F.concat_ws(" ", "l_linestatus", "l_linenumber").alias("description"), F.lit(None).cast("string").alias("term"))
    shown = {
        "known": "STRING_Data_Available", "n": "Total_Interactions", "high": "High_Confidence_Interactions", "targets": "Drug_Target_Interactions", "hub": "Network_Hub", "target_names": "Drug_Target_Partners", "families": "Drug_Target_Families", "partners": "Top_Partners",
        "pathways": "Pathways", "processes": "Biological_Processes", "score": "Overall_Network_Score", "relevance": "Pathway_Relevance_Score", "connectivity": "Network_Connectivity", "quality": "Network_Quality",
    }
    return features.network(edges, terms).select(F.col("gene_symbol").alias("gene"), *[F.col(f"Step10_{c}").alias(k) for k, c in shown.items()])


# -- expression --------------------------------------------------------------------------------------------------------

_SEEN = ["Brain_Cortex", "Whole_Blood", "Artery_Aorta", "Heart_Atrial", "Spleen", "Stomach", "Liver", "Colon_Sigmoid", "Testis", "Kidney_Cortex", "Lung", "Skin_Leg", "Muscle_Skeletal", "Nerve_Tibial", "Thyroid", "Brain_Cerebellum", "Pituitary"]
_within = lambda words: " OR ".join(f"contains(tissue, {quoted(w)})" for w in words)
_CATEGORIES = ", ".join(f"coalesce(max(tpm) FILTER ({_within(words)}), 0.0) AS c{i}" for i, words in enumerate(rules.TISSUES.values()))
_AT = {name: f"c{i}" for i, name in enumerate(rules.TISSUES)}
_GREATEST = f"greatest({', '.join(_AT.values())})"
_BEST = "CASE " + " ".join(f"WHEN {c} = {_GREATEST} THEN {quoted(name)}" for name, c in _AT.items()) + " END"


@query(f"""WITH lines AS (SELECT 'P' || l_partkey AS gene, {listed(_SEEN)}[1 + l_suppkey * 3 % {len(_SEEN)}] AS tissue, CASE WHEN l_returnflag <> 'N' THEN l_quantity WHEN l_linenumber < 3 THEN l_linenumber / 2.0 ELSE 0.0 END AS tpm FROM lineitem),
sums AS (SELECT gene, count(*) AS total, count(*) FILTER (tpm > 0) AS expressed, coalesce(max(tpm) FILTER (tpm > 0), 0.0) AS most, coalesce(round(sum(tpm) FILTER (tpm > 0) / count(*) FILTER (tpm > 0), 3), 0.0) AS mean,
  coalesce(list_sort(list(tpm) FILTER (tpm > 0))[CAST(count(*) FILTER (tpm > 0) // 2 + 1 AS INT)], 0.0) AS median, count(*) FILTER (tpm >= 10) AS high, count(*) FILTER (tpm >= 1 AND tpm < 10) AS medium, count(*) FILTER (tpm >= 0.1 AND tpm < 1) AS low,
  coalesce(array_to_string((list(tissue || ':' || printf('%.1f', tpm) ORDER BY tpm DESC, tissue) FILTER (tpm > 0))[:3], '; '), '') AS top, count(*) FILTER (tpm > 0.1) AS seen, {_CATEGORIES} FROM lines GROUP BY 1),
told AS (SELECT *, CASE WHEN seen <= 5 THEN 'Highly Specific' WHEN seen <= 15 THEN 'Moderately Specific' WHEN seen <= 30 THEN 'Broadly Expressed' ELSE 'Ubiquitous' END AS spread, {_AT["Blood"]} AS blood, {_AT["Brain"]} AS brain,
  CASE WHEN most >= 50 THEN 5 WHEN most >= 10 THEN 4 WHEN most >= 1 THEN 3 WHEN most >= 0.1 THEN 2 WHEN most > 0 THEN 1 ELSE 0 END AS a FROM sums),
scored AS (SELECT *, CASE WHEN blood >= 10 THEN 5 WHEN blood > 1 THEN 4 WHEN brain > 1 THEN 3 WHEN {_AT["Vascular"]} > 1 OR {_AT["Lung"]} > 1 OR {_AT["Skin"]} > 1 THEN 2 ELSE 1 END AS b FROM told)
SELECT gene, total, expressed, most, mean, median, high, medium, low, top, spread, brain, blood, CASE WHEN blood > 1 OR brain > 1 THEN 'Yes' WHEN blood > 0.1 THEN 'Partial' ELSE 'No' END AS accessible, CAST(least(a + b, 10) AS BIGINT) AS score,
CASE WHEN least(a + b, 10) >= 8 THEN 'Excellent' WHEN least(a + b, 10) >= 6 THEN 'Good' WHEN least(a + b, 10) >= 4 THEN 'Moderate' WHEN least(a + b, 10) >= 2 THEN 'Poor' ELSE 'Very Poor' END AS quality,
CASE WHEN most >= 10 THEN 'Excellent - High expression enables robust validation' WHEN most >= 1 THEN 'Good - Sufficient for most validation methods' WHEN most >= 0.1 THEN 'Moderate - May require sensitive methods' ELSE 'Poor - Low expression may limit validation' END AS feasible,
CASE WHEN blood > 1 THEN 'Systemic delivery feasible' WHEN brain > 1 THEN 'CNS delivery required (BBB penetration)' ELSE 'Targeted delivery to ' || {_BEST} || ' may be needed' END AS delivery,
CASE spread WHEN 'Highly Specific' THEN 'Low - Tissue-specific expression' WHEN 'Moderately Specific' THEN 'Moderate - Some off-target expression expected' ELSE 'High - Broad expression may cause off-target effects' END AS risk FROM scored""")
def q_stage_expression(spark, sf):
    # of half of the genes the answer is found through the reference
    tissue = F.get(F.array(*map(F.lit, _SEEN)), (F.col("l_suppkey") * 3 % len(_SEEN)).cast("int"))
    tpm = F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("double")).when(F.col("l_linenumber") < 3, F.col("l_linenumber") / 2.0).otherwise(0.0)
    data = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.struct(tissue.alias("tissueSiteDetailId"), tpm.alias("median"))).alias("data"))
    led, gene = F.col("l_partkey") % 2 == 0, F.concat(F.lit("P"), "l_partkey")
    answers = data.select(F.when(~led, gene).alias("gene"), F.when(led, F.concat(F.lit("G"), "l_partkey")).alias("gencodeId"), "data")
    reference = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("geneId"), F.lit(1).cast("long").alias("seq"), F.concat(F.lit("G"), "p_partkey").alias("gencodeId"))
    shown = {
        "total": "Total_Tissues", "expressed": "Tissues_With_Expression", "most": "Max_TPM", "mean": "Mean_TPM", "median": "Median_TPM", "high": "High_Expression_Tissues", "medium": "Medium_Expression_Tissues", "low": "Low_Expression_Tissues", "top": "Top_3_Tissues",
        "spread": "Tissue_Specificity", "brain": "Brain_Max_TPM", "blood": "Blood_TPM", "accessible": "Accessible_Expression", "score": "Overall_Expression_Score", "quality": "Expression_Quality", "feasible": "Target_Validation_Feasibility",
        "delivery": "Drug_Delivery_Considerations", "risk": "Off_Target_Risk",
    }
    return features.expression_profile(features.by_gene(answers, reference)).select(F.col("gene_symbol").alias("gene"), *[F.col(f"Step7_{c}").alias(k) for k, c in shown.items()])


# -- disorder and development ------------------------------------------------------------------------------------------


@query("""WITH regions AS (SELECT l_partkey, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 40 AS b FROM lineitem WHERE l_partkey % 3 = 0), consensus AS (
SELECT l_partkey AS k, 100.0 * sum(b - a + 1) / 300 AS pct, sum(b - a + 1) AS n, 300 AS total, count(*) AS regions, max(b - a + 1) AS longest, 'MobiDB Consensus' AS method FROM regions GROUP BY 1), low AS (
SELECT l_partkey AS k, 100.0 * count(*) FILTER (l_quantity < 25) / count(*) AS pct, count(*) FILTER (l_quantity < 25) AS n, count(*) AS total, 0 AS regions, 0 AS longest, 'AlphaFold pLDDT' AS method FROM lineitem WHERE l_partkey % 3 <= 1 GROUP BY 1),
told AS (SELECT 'P' || p_partkey AS gene, coalesce(c.pct, l.pct) AS p, coalesce(c.n, l.n, 0) AS n, coalesce(c.total, l.total, 0) AS total, coalesce(c.regions, l.regions, 0) AS regions, coalesce(c.longest, l.longest, 0) AS longest, coalesce(c.method, l.method, 'None') AS method
FROM part LEFT JOIN consensus c ON c.k = p_partkey LEFT JOIN low l ON l.k = p_partkey)
SELECT gene, round(coalesce(p, 0.0), 2) AS pct, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(regions AS BIGINT) AS regions, CAST(longest AS BIGINT) AS longest, method,
CASE WHEN p IS NULL THEN 'Unknown' WHEN p < 10 THEN 'Highly Ordered' WHEN p < 30 THEN 'Mostly Ordered' WHEN p < 50 THEN 'Moderately Disordered' WHEN p < 70 THEN 'Highly Disordered' ELSE 'Intrinsically Disordered' END AS category,
CASE WHEN p IS NULL THEN 0 WHEN p < 10 THEN 5 WHEN p < 20 THEN 4 WHEN p < 50 THEN 3 WHEN p < 70 THEN 2 ELSE 1 END AS score,
CASE WHEN p IS NULL THEN 0 WHEN longest <= 0 THEN 5 WHEN 100.0 * longest / total < 10 AND regions <= 2 THEN 5 WHEN 100.0 * longest / total < 30 AND regions <= 5 THEN 4 WHEN 100.0 * longest / total < 50 THEN 3 ELSE 2 END AS quality,
CASE WHEN p IS NULL THEN 'Unknown' WHEN p < 20 THEN 'Excellent - Well-structured' WHEN p < 50 THEN 'Good - Druggable (<50% disorder)' WHEN p < 70 THEN 'Challenging - High disorder (>50%)' ELSE 'Poor - Mostly disordered (>70%)' END AS impact,
coalesce(p < 50, false) AS passes FROM told""")
def q_stage_disorder(spark, sf):
    lines, number = table(spark, sf, "lineitem"), F.col("l_linenumber") * 10
    region = F.struct(number.cast("int").alias("start"), (number + F.col("l_quantity").cast("long") % 40).cast("int").alias("end"))
    own = F.concat(F.lit("U"), "l_partkey").alias("uniprot")
    consensus = lines.where("l_partkey % 3 = 0").groupBy(own).agg(F.collect_list(region).alias("regions")).select("uniprot", F.lit(300).alias("length"), "regions")
    low = lines.where("l_partkey % 3 <= 1").groupBy(own).agg(F.count_if(F.col("l_quantity") < 25).alias("n_low"), F.count("*").alias("n_records"))
    genes = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene_symbol"), F.concat(F.lit("U"), "p_partkey").alias("uniprot"))
    shown = {
        "pct": "Disorder_Percentage", "n": "Disordered_Residues", "total": "Total_Residues", "regions": "Num_Disordered_Regions", "longest": "Longest_Disordered_Region", "method": "Disorder_Method", "category": "Disorder_Category", "score": "Disorder_Score",
        "quality": "Structural_Quality_Score", "impact": "Druggability_Impact", "passes": "Passes_50_Percent_Rule",
    }
    found = features.disorder(genes, consensus, low, spark.createDataFrame([], "uniprot string, sequence string"))
    whole = {"n", "total", "regions", "longest"}
    return found.select(F.col("gene_symbol").alias("gene"), *[(F.col(f"Step8_{c}").cast("bigint") if k in whole else F.col(f"Step8_{c}")).alias(k) for k, c in shown.items()])


_LEVEL = lambda i, default: "CASE tdl " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v[i]) if isinstance(v[i], str) else v[i]}" for k, v in rules.LEVELS.items()) + f" ELSE {quoted(default) if isinstance(default, str) else default} END"
_KINDS = [*rules.LEVELS, "Other"]


@query(f"""WITH told AS (SELECT 'S' || s_suppkey AS gene, s_name AS name, coalesce({listed(_KINDS)}[1 + s_suppkey % {len(_KINDS) + 1}], 'Unknown') AS tdl, coalesce(CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey / 25.0 END, 0.5) AS novelty, nullif(repeat(s_name || ' ', s_nationkey), '') AS about,
CASE s_nationkey % 3 WHEN 0 THEN 'Kinase' WHEN 1 THEN '' END AS fam FROM supplier), scored AS (SELECT *, {_LEVEL(1, 0)} AS a, CASE WHEN novelty < 0.1 THEN 5 WHEN novelty < 0.3 THEN 4 WHEN novelty < 0.5 THEN 3 WHEN novelty < 0.7 THEN 2 ELSE 1 END AS b FROM told)
SELECT gene, name, tdl AS level, {_LEVEL(0, "Unknown")} AS means, coalesce(nullif(fam, ''), 'Unknown') AS family, {_LEVEL(3, "Unknown")} AS status, coalesce(about[:200], 'N/A') AS about, a AS level_score, b AS novelty_score, least(a + b, 10) AS score,
{_LEVEL(4, "Unknown")} AS confidence, {_LEVEL(2, "Unknown")} AS potential, {_LEVEL(5, "Further assessment needed")} AS strategy,
CASE WHEN a + b >= 8 THEN 'Excellent' WHEN a + b >= 6 THEN 'Very Good' WHEN a + b >= 4 THEN 'Good' ELSE 'Moderate' END AS quality FROM scored""")
def q_stage_development(spark, sf):
    nation = F.col("s_nationkey")
    answers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("sym"), F.col("s_name").alias("name"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("s_suppkey") % (len(_KINDS) + 1)).cast("int")).alias("tdl"), F.when(nation % 3 == 0, "Kinase").when(nation % 3 == 1, "").alias("fam"),
        F.repeat(F.concat("s_name", F.lit(" ")), nation.cast("int")).alias("description"), F.when(nation % 3 > 0, nation / 25.0).alias("novelty"),
    )
    shown = {
        "name": "Target_Name", "level": "Target_Development_Level", "means": "TDL_Description", "family": "Protein_Family", "status": "Development_Status", "about": "Target_Description", "level_score": "TDL_Score", "novelty_score": "Novelty_Score",
        "score": "Overall_Pharos_Score", "confidence": "Druggability_Confidence", "potential": "Drug_Development_Potential", "strategy": "Recommended_Strategy", "quality": "Target_Quality",
    }
    return features.development(answers).select(F.col("gene_symbol").alias("gene"), *[F.col(f"Step9_{c}").alias(k) for k, c in shown.items()])


# -- drugs and pockets -------------------------------------------------------------------------------------------------


@query("""WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS i FROM lineitem), dgidb AS (
SELECT l_partkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS approved, array_to_string(list('D' || l_suppkey ORDER BY i)[:20], '|') AS drugs, coalesce(array_to_string((list('D' || l_suppkey ORDER BY i) FILTER (l_returnflag = 'R'))[:20], '|'), '') AS approved_drugs,
  array_to_string(list('D' || l_suppkey ORDER BY l_quantity DESC, i)[:5], '|') AS top FROM lines WHERE l_partkey % 4 = 0 GROUP BY 1), kinds AS (
SELECT k, string_agg(t, '|' ORDER BY i) AS types FROM (SELECT l_partkey AS k, l_linestatus || l_returnflag AS t, min(i) AS i FROM lines WHERE l_partkey % 4 = 0 GROUP BY 1, 2) GROUP BY 1), compounds AS (
SELECT l_partkey AS k, l_suppkey AS m, max(CAST(l_linenumber = 4 AS INT)) AS p4, max(CAST(l_linenumber BETWEEN 1 AND 3 AS INT)) AS p13, max(CAST(l_linenumber > 4 AS INT)) AS p0, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1, 2), chembl AS (
SELECT k, sum(p4) AS approved, sum(p13) AS clinical, sum(p0) AS bioactive, count(*) AS compounds, sum(n) AS activities FROM compounds GROUP BY 1), known AS (
SELECT l_partkey AS k, count(*) AS total, count(*) FILTER (l_linenumber = 4) AS p4, count(*) FILTER (l_linenumber = 3) AS p3, count(*) FILTER (l_linenumber = 2) AS p2, count(*) FILTER (l_linenumber = 1) AS p1, array_to_string(list('D' || l_suppkey ORDER BY i)[:10], '|') AS names
  FROM lines WHERE l_partkey % 5 = 0 GROUP BY 1), told AS (
SELECT p_partkey AS k, d.n, d.approved AS da, drugs, approved_drugs, top, types, c.approved AS ca, c.clinical AS cc, c.bioactive AS cb, compounds, activities, o.total, o.p4, o.p3, o.p2, o.p1, names,
  coalesce(d.approved, 0) + coalesce(c.approved, 0) + coalesce(o.p4, 0) AS sold, coalesce(c.clinical, 0) + coalesce(o.p3, 0) + coalesce(o.p2, 0) + coalesce(o.p1, 0) AS trials
FROM part LEFT JOIN dgidb d ON d.k = p_partkey LEFT JOIN kinds t ON t.k = p_partkey LEFT JOIN chembl c ON c.k = p_partkey LEFT JOIN known o ON o.k = p_partkey)
SELECT 'P' || k AS gene, coalesce(n, 0) AS interactions, coalesce(da, 0) AS approved, drugs, approved_drugs, top, types, CAST(ca AS BIGINT) AS compound_approved, CAST(cc AS BIGINT) AS compound_clinical, CAST(cb AS BIGINT) AS compound_bioactive, compounds, CAST(activities AS BIGINT) AS activities,
total AS known, p4, p3, p2, p1, names, sold > 0 AS has_approved, trials > 0 AS has_clinical, coalesce(cb, 0) > 0 AS has_bioactive, CASE WHEN sold > 0 THEN 'HIGH - Approved drugs exist' WHEN trials > 0 THEN 'MEDIUM - Clinical trials ongoing'
WHEN coalesce(cb, 0) > 0 OR coalesce(n, 0) > 0 THEN 'LOW - Bioactive compounds known' ELSE 'NONE - No known drugs' END AS evidence FROM told""")
def q_stage_drugs(spark, sf):
    lines, key = table(spark, sf, "lineitem"), F.col("l_partkey")
    gene, drug = F.concat(F.lit("P"), key).alias("gene"), F.concat(F.lit("D"), "l_suppkey")
    ordered = lambda rows, item: rows.groupBy(gene).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", item.alias("x")))).alias("e")).select("gene", F.transform("e", lambda e: e["x"]).alias("items"))
    kind = F.array(F.struct(F.concat("l_linestatus", "l_returnflag").alias("type")))
    acted = F.struct(F.struct(drug.alias("name"), (F.col("l_returnflag") == "R").alias("approved")).alias("drug"), F.col("l_quantity").cast("double").alias("interactionScore"), kind.alias("interactionTypes"), F.array(F.struct(F.lit("S").alias("fullName"))).alias("sources"))
    interactions = ordered(lines.where(key % 4 == 0), acted).select("gene", F.lit(None).cast("string").alias("longName"), F.array().cast("array<struct<name:string>>").alias("geneCategories"), F.col("items").alias("interactions"))
    measured = F.struct(F.col("l_suppkey").cast("string").alias("molecule_chembl_id"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).cast("int").alias("molecule_max_phase"))
    compounds = lines.where(key % 3 == 0).groupBy(gene).agg(F.collect_list(measured).alias("activities")).select("gene", F.lit("C").alias("target_chembl_id"), F.lit("SINGLE").alias("target_type"), "activities")
    row = F.struct(F.struct(F.lit(None).cast("string").alias("id"), drug.alias("name")).alias("drug"), F.lit("Small molecule").alias("drugType"), F.lit(None).cast("string").alias("mechanismOfAction"), F.col("l_linenumber").cast("int").alias("phase"))
    known = ordered(lines.where(key % 5 == 0), row).select(F.regexp_replace("gene", "P", "E").alias("ensembl_id"), F.lit(None).cast("int").alias("uniqueDrugs"), F.col("items").alias("rows"))
    genes = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("gene_symbol"), F.concat(F.lit("E"), "p_partkey").alias("ensembl_gene_id"))
    out = attach(genes, features.drug_interactions(interactions), "gene_symbol", {"dgidb_num_interactions": 0, "dgidb_num_approved": 0}, both=True)
    out = lookup(attach(out, features.compound_activities(compounds), "gene_symbol", both=True), features.known_drugs(known), "ensembl_gene_id")
    shown = {
        "interactions": "dgidb_num_interactions", "approved": "dgidb_num_approved", "drugs": "dgidb_drugs", "approved_drugs": "dgidb_approved_drugs", "top": "dgidb_top_5_drugs", "types": "dgidb_interaction_types", "compound_approved": "chembl_approved_drugs",
        "compound_clinical": "chembl_clinical_compounds", "compound_bioactive": "chembl_bioactive_compounds", "compounds": "chembl_total_compounds", "activities": "chembl_total_activities", "known": "opentargets_total_drugs", "p4": "opentargets_approved",
        "p3": "opentargets_phase3", "p2": "opentargets_phase2", "p1": "opentargets_phase1", "names": "opentargets_drug_names", "has_approved": "has_approved_drugs", "has_clinical": "has_clinical_drugs", "has_bioactive": "has_bioactive_compounds",
        "evidence": "druggability_evidence",
    }
    return features.drug_evidence(out).select(F.col("gene_symbol").alias("gene"), *[F.col(c).alias(k) for k, c in shown.items()])


@query("""WITH held AS (SELECT 'P' || l_partkey AS gene, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax) AS id, nullif(l_quantity * 20, 20.0) AS v, nullif(l_discount * 10, 0.0) AS d, nullif(l_tax * 10, 0.0) AS h,
  nullif(l_linenumber / 8.0, 0.125) AS s FROM lineitem WHERE l_partkey % 3 = 0), parts AS (
SELECT *, CASE WHEN v >= 500 THEN 1.0 WHEN v >= 200 THEN 0.7 WHEN v IS NOT NULL THEN 0.3 END AS a, CASE WHEN d >= 0.7 THEN 1.0 WHEN d >= 0.5 THEN 0.6 WHEN d IS NOT NULL THEN 0.3 END AS b, CASE WHEN h > 0.5 THEN 0.8 WHEN h > 0.3 THEN 0.5 END AS c, CASE WHEN s > 0.5 THEN 0.7 WHEN s IS NOT NULL THEN 0.4 END AS e FROM held),
told AS (SELECT *, round(CAST(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(e, 0) AS DOUBLE) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) + CAST(e IS NOT NULL AS INT), 0), 8) AS m FROM parts),
best AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY coalesce(d, 0.0) DESC, id) AS r, count(*) OVER (PARTITION BY gene) AS n, count(*) FILTER (m >= 0.5) OVER (PARTITION BY gene) AS good FROM told)
SELECT gene, n AS found, good AS druggable, good > 0 AS has, id AS best, v AS volume, round(d, 2) AS druggability, CASE WHEN m >= 0.8 THEN 'Excellent' WHEN m >= 0.65 THEN 'Good' WHEN m >= 0.5 THEN 'Moderate' ELSE 'Poor' END AS category,
CASE WHEN m >= 0.8 THEN 'High' WHEN m >= 0.65 THEN 'Medium' ELSE 'Low' END AS confidence,
concat_ws('|', CASE WHEN v >= 500 THEN 'Optimal volume (' || printf('%.0f', v) || 'A3)' WHEN v >= 200 THEN 'Adequate volume (' || printf('%.0f', v) || 'A3)' END, CASE WHEN d >= 0.7 THEN 'High druggability (' || printf('%.2f', d) || ')' END) AS favorable,
concat_ws('|', CASE WHEN v < 200 THEN 'Small volume (' || printf('%.0f', v) || 'A3)' END, CASE WHEN d < 0.5 THEN 'Low druggability (' || printf('%.2f', d) || ')' END) AS concerns FROM best WHERE r = 1""")
def q_stage_pockets(spark, sf):
    order = [F.col(f"l_{c}") for c in ("orderkey", "linenumber", "suppkey", "quantity", "discount", "tax")]
    number = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order))
    rare = lambda x, nothing: F.when(x != nothing, x)
    pockets = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").select(
        F.concat(F.lit("P"), "l_partkey").alias("gene_symbol"), number.alias("pocket_id"), rare(F.col("l_quantity").cast("double") * 20, 20.0).alias("volume"), (F.col("l_discount").cast("double") * 10).alias("druggability"), (F.col("l_tax").cast("double") * 10).alias("hydrophobicity"),
        rare(F.col("l_linenumber") / 8.0, 0.125).alias("score"),
    )
    shown = {
        "found": "pockets_found", "druggable": "num_druggable_pockets", "has": "has_druggable_pocket", "best": "best_pocket_id", "volume": "best_pocket_volume", "category": "best_pocket_category", "confidence": "best_pocket_confidence",
        "favorable": "favorable_features", "concerns": "concerns",
    }
    out = features.best_pockets(features.assess_pockets(pockets))
    return out.select(F.col("gene_symbol").alias("gene"), *[F.col(c).alias(k) for k, c in shown.items()], F.round(F.nullif("best_pocket_druggability", F.lit(0.0)), 2).alias("druggability"))


@query("""WITH search AS (SELECT p_partkey AS k, 'S' || p_partkey % 50 AS best, 1 + p_size % 12 AS n FROM part WHERE p_partkey % 2 = 0), meta AS (SELECT 'S' || s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN 1 + s_nationkey / 10.0 END AS r, s_name AS title FROM supplier),
model AS (SELECT p_partkey AS k, CASE WHEN p_size > 2 THEN 2.0 * p_size END AS p FROM part WHERE p_partkey % 3 = 0), told AS (
SELECT p_partkey AS k, coalesce(s.n, 0) AS n, s.best, m.r, m.title, a.k IS NOT NULL AS modelled, a.p FROM part LEFT JOIN search s ON s.k = p_partkey LEFT JOIN meta m ON m.id = s.best LEFT JOIN model a ON a.k = p_partkey), named AS (
SELECT *, CASE WHEN NOT modelled THEN NULL WHEN p >= 90 THEN 'Very High (>90)' WHEN p >= 70 THEN 'High (70-90)' WHEN p >= 50 THEN 'Low (50-70)' WHEN p IS NOT NULL THEN 'Very Low (<50)' ELSE 'Unknown' END AS q, CASE WHEN n > 0 THEN 'PDB' WHEN modelled THEN 'AlphaFold' END AS source FROM told)
SELECT 'P' || k AS gene, n, n > 0 AS held, modelled, best, title, r AS resolution, q AS quality, source, CASE source WHEN 'PDB' THEN CASE WHEN r <= 2.0 THEN 'Excellent (<2.0Å)' WHEN r <= 2.5 THEN 'Good (2.0-2.5Å)' WHEN r <= 3.0 THEN 'Moderate (2.5-3.0Å)'
WHEN r IS NOT NULL THEN 'Low (>' || printf('%.1f', r) || 'Å)' END WHEN 'AlphaFold' THEN q END AS score FROM named""")
def q_stage_structures(spark, sf):
    parts, key = table(spark, sf, "part"), F.col("p_partkey")
    genes = parts.select(F.concat(F.lit("P"), key).alias("gene_symbol"), F.concat(F.lit("U"), key).alias("uniprot"))
    first = F.concat(F.lit("S"), key % 50)
    search = parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("U"), key).alias("uniprot"), F.transform(F.sequence(F.lit(0), F.col("p_size").cast("int") % 12), lambda i: F.when(i == 0, first).otherwise(F.concat(F.lit("X"), i))).alias("ids"))
    nothing = F.lit(None).cast("string")
    meta = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("pdb_id"), F.when(F.col("s_suppkey") % 5 > 0, 1 + F.col("s_nationkey") / 10.0).alias("resolution"), nothing.alias("method"), F.col("s_name").alias("title"), nothing.alias("deposit_date"), nothing.alias("organism"))
    model = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("U"), key).alias("uniprot"), nothing.alias("modelCreatedDate"), F.when(F.col("p_size") > 2, 2.0 * F.col("p_size")).alias("avgPlddt"))
    shown = {
        "n": "num_pdb_structures", "held": "has_pdb_structure", "modelled": "has_alphafold_structure", "best": "best_pdb_id", "title": "best_pdb_title", "resolution": "best_pdb_resolution", "quality": "alphafold_quality", "source": "structure_source",
        "score": "structure_quality_score",
    }
    return features.structures(genes, search, meta, model).select(F.col("gene_symbol").alias("gene"), *[F.col(c).alias(k) for k, c in shown.items()])
