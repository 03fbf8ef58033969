"""Evidence, rule-derived truth, metrics and texts for scored genes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.functions.columns import bands, has_any, ladder, lines, optional
from rankmill.operators import metrics


#: The disease that publications are looked up with, unless another is given.
DISEASE = "migraine"


def evidence(literature: DataFrame, trials: DataFrame, disease: str = DISEASE) -> DataFrame:
    """Publications and trials per gene; of the trials the first five count (``total``, where the trials have it, says how many there are). Publications found with another disease don't; a
    snapshot that names none is of the one asked for."""
    if "disease" in literature.columns:
        literature = literature.where(F.lower(F.coalesce("disease", F.lit(disease))) == disease.lower())
    papers = literature.select(F.col("gene").alias("gene_symbol"), F.coalesce("count", F.lit(0)).alias("Step12_Literature_Publications"), F.transform(F.slice("papers", 1, 5), lambda p: F.struct(p["pmid"].alias("pmid"), p["title"].alias("title"), F.split(p["pubdate"], " ")[0].alias("year"))).alias("papers"))
    first = F.slice("studies", 1, 5)
    among = lambda *words: F.size(F.filter(first, lambda s: reduce(lambda a, b: a | b, [F.upper(s["overallStatus"]).contains(w) for w in words])))
    studies = trials.select(
        F.col("gene").alias("gene_symbol"),
        (F.coalesce("total", F.size("studies")) if "total" in trials.columns else F.size("studies")).alias("Step12_Total_Clinical_Trials"),
        among("ACTIVE", "RECRUITING").alias("Step12_Active_Trials"),
        among("RECRUITING").alias("Step12_Recruiting_Trials"),
    )
    out = papers.join(studies, "gene_symbol", "full").fillna(0, ["Step12_Literature_Publications", "Step12_Total_Clinical_Trials", "Step12_Active_Trials", "Step12_Recruiting_Trials"])
    return out.withColumns({"Step12_Has_Literature_Evidence": F.col("Step12_Literature_Publications") > 0, "Step12_Has_Clinical_Trials": F.col("Step12_Total_Clinical_Trials") > 0})


def truth(df: DataFrame) -> DataFrame:
    """What the drug columns say of each gene, 0 to 100, and whether that is 70 or more. It isn't independent of the scores."""
    number = lambda n: optional(df, n, 0, "double")
    kinds, place, clinical = optional(df, "opentargets_drug_types", "", "string"), optional(df, "subcellular_location", "", "string"), optional(df, "has_clinical_drugs", False, "boolean")
    approved, bioactive, tdl = number("dgidb_num_approved"), number("chembl_bioactive_compounds"), optional(df, "Step9_Target_Development_Level", "Unknown", "string")
    small, protein = kinds.contains("Small molecule"), kinds.contains("Antibody") | kinds.contains("Protein")
    sm = ladder(*[(small & (approved >= n), v) for n, v in ((10, 100), (5, 90), (3, 80), (1, 70))], (clinical & small, 60), *[(bioactive >= n, v) for n, v in ((100, 50), (50, 40), (10, 30))], (tdl == "Tclin", 50), (tdl == "Tchem", 40), default=20)
    bio = ladder((protein & (approved >= 5), 100), (protein & (approved >= 1), 90), (clinical & protein, 70), (place.contains("Secreted"), 60), (place.contains("Cell membrane"), 50), default=30)
    out = df.withColumns({"Step12_SM_Literature_Score": sm, "Step12_Bio_Literature_Score": bio})
    return out.withColumns({"Step12_SM_Is_Druggable": (F.col("Step12_SM_Literature_Score") >= 70).cast("int"), "Step12_Bio_Is_Druggable": (F.col("Step12_Bio_Literature_Score") >= 70).cast("int")})


def combinations(df: DataFrame) -> tuple[Column, Column, Column]:
    """Strategies, combinations by pathway and synthetic lethality, as arrays. Only drug-target partners give strategies."""
    text = lambda c: optional(df, c, "", "string")
    first = lambda c, n: F.slice(F.transform(F.split(text(c), ";"), lambda p: F.trim(p)), 1, n)
    some = optional(df, "Step10_Drug_Target_Interactions", 0, "long") > 0
    partners, kinds = "Step10_Drug_Target_Partners", "Step10_Drug_Target_Families"
    strategies = lines(
        F.when(some & (text(partners) != ""), F.concat(F.lit("Polypharmacology: Target alongside "), F.array_join(first(partners, 3), ", "))),
        F.when(some & (text(kinds) != ""), F.concat(F.lit("Multi-target approach within "), F.array_join(first(kinds, 2), ", "), F.lit(" pathways"))),
        F.when(some, F.lit("Sequential dosing to minimize resistance")),
    )
    routes = F.array_compact(F.transform(first("Step10_Pathways", 3), lambda p: ladder(*[(has_any(p, words), way) for words, way in rules.PATHWAY_COMBINATIONS])))
    lethal = lines(ladder(*[(text("druggable_family_type").contains(word), way) for word, way in rules.SYNTHETIC_LETHALITY]))
    return strategies, routes, lethal


def validate(df: DataFrame, found: DataFrame) -> DataFrame:
    """Truth for all, and for genes of high priority the evidence, tool compounds and validation level."""
    out = truth(df).join(found, "gene_symbol", "left")
    asked = F.col("Step11_Priority") == "High Priority"
    gate = lambda name, kind: F.when(asked, F.col(name)).otherwise(F.lit(None)).cast(kind)
    out = out.withColumns({c: F.coalesce(gate(c, "int"), F.lit(0)) for c in ("Step12_Literature_Publications", "Step12_Total_Clinical_Trials", "Step12_Active_Trials", "Step12_Recruiting_Trials")})
    out = out.withColumns({c: F.coalesce(gate(c, "boolean"), F.lit(False)) for c in ("Step12_Has_Literature_Evidence", "Step12_Has_Clinical_Trials")})
    approved, bioactive, total = (optional(df, c, 0, "long") for c in ("dgidb_num_approved", "chembl_bioactive_compounds", "chembl_total_compounds"))
    tools = asked & ((approved > 0) | (bioactive > 0))
    partners = optional(df, "Step10_Drug_Target_Interactions", 0, "long")
    strategies, routes, lethal = combinations(df)
    out = out.withColumns({
        "Step12_Has_Tool_Compounds": tools, "Step12_Tool_Compound_Count": F.when(asked, approved + bioactive).otherwise(0),
        "Step12_Probe_Quality": ladder((~asked, "Not assessed"), (approved > 0, "Excellent - Approved drugs available"), (bioactive >= 10, "Good - Multiple bioactive compounds"), (bioactive > 0, "Moderate - Limited compounds"), (total > 0, "Poor - Only screening compounds"), default="None - No compounds available"),
        "Step12_Tool_Compound_Summary": ladder(
            (~asked, ""),
            (approved > 0, F.concat(approved.cast("string"), F.lit(" approved drug(s) as chemical probes"))),
            (bioactive >= 10, F.concat(bioactive.cast("string"), F.lit(" bioactive compounds available"))),
            (bioactive > 0, F.concat(bioactive.cast("string"), F.lit(" bioactive compound(s)"))),
            (total > 0, F.concat(total.cast("string"), F.lit(" screening compounds (no validated probes)"))),
            default="No chemical tools available - de novo discovery required",
        ),
        "Step12_Connected_Drug_Targets": F.when(asked, partners).otherwise(0),
        "Step12_Combination_Strategies": F.when(asked, F.array_join(F.slice(strategies, 1, 3), "; ")).otherwise(""), "Step12_Has_Combination_Potential": asked & (partners > 0),
        "Step12_Synthetic_Lethality": F.when(asked, F.array_join(F.slice(lethal, 1, 2), "; ")).otherwise(""), "Step12_Pathway_Combinations": F.when(asked, F.array_join(F.slice(routes, 1, 2), "; ")).otherwise(""),
    })
    points = lambda c, n: F.col(c).cast("int") * n
    out = out.withColumn("Step12_Validation_Score", points("Step12_Has_Literature_Evidence", 3) + points("Step12_Has_Clinical_Trials", 3) + points("Step12_Has_Tool_Compounds", 2) + points("Step12_Has_Combination_Potential", 2))
    return out.withColumn("Step12_Validation_Level", bands("Step12_Validation_Score", (8, "Excellent Validation"), (6, "Strong Validation"), (4, "Moderate Validation"), (2, "Preliminary Validation"), default="Limited Validation"))


def predictions(df: DataFrame) -> DataFrame:
    """What the score, what the literature and what both together say of each gene, with reasons and a recommendation.

    Columns that the table lacks count as nothing found.
    """
    number = lambda c: optional(df, c, 0, "double")
    text = lambda c: optional(df, c, "Unknown", "string")
    flag = lambda c: optional(df, c, False, "boolean")
    score = number("Step11_Composite_Score")
    papers, trials = (optional(df, c, 0, "long") for c in ("Step12_Literature_Publications", "Step12_Total_Clinical_Trials"))
    some, level = trials > 0, text("Step9_Target_Development_Level")
    own = lambda i: bands(score, *[(at, values[i]) for at, values in rules.SCORE_LABELS], default=rules.LOW_SCORE[i])
    known = lambda i: ladder(*zip(((papers >= 10) & some, (papers >= 5) | some, papers > 0), [v[i] for v in rules.LITERATURE_LABELS], strict=True), default=rules.NO_LITERATURE[i])
    cases = ((score >= 80) & ((papers >= 5) | some), score >= 80, (score >= 50) & (papers >= 10), score >= 50)
    final = lambda i: ladder(*zip(cases, [v[i] for v in rules.FINAL_LABELS], strict=True), default=rules.LAST_LABEL[i])
    reasons = lines(
        *[F.when(flag(c), said) for c, said in rules.REASONS],
        ladder((level == "Tclin", "Clinical target (Tclin)"), (level == "Tchem", "Chemical target (Tchem)")),
    )
    found = lines(
        F.when(papers > 0, F.concat(papers.cast("string"), F.lit(" publications"))),
        F.when(some, F.concat(trials.cast("string"), F.lit(" clinical trial(s)"))),
        F.when(flag("Step12_Has_Tool_Compounds"), "Chemical tools available"),
    )
    listed = lambda a, default: F.when(F.size(a) > 0, F.array_join(a, "; ")).otherwise(default)
    return df.select(
        F.col("gene_symbol").alias("Gene"),
        F.round(score, 1).alias("Pipeline_Druggability_Score"),
        F.round(number("Step11_SmallMolecule_Score"), 1).alias("Small_Molecule_Score"),
        F.round(number("Step11_Biologic_Score"), 1).alias("Biologic_Score"),
        optional(df, "Step12_SM_Literature_Score", 0, "int").alias("SM_Literature_Score"),
        optional(df, "Step12_Bio_Literature_Score", 0, "int").alias("Bio_Literature_Score"),
        text("Step11_Best_Modality").alias("Best_Modality"),
        own(0).alias("Pipeline_Prediction"),
        own(1).alias("Pipeline_Confidence"),
        listed(reasons, "Limited evidence").alias("Pipeline_Reasoning"),
        papers.alias("Literature_Publications"),
        trials.alias("Clinical_Trials"),
        known(0).alias("Literature_Prediction"),
        known(1).alias("Literature_Confidence"),
        listed(found, "No literature evidence found").alias("Literature_Reasoning"),
        final(0).alias("Final_Prediction"),
        final(1).alias("Final_Confidence"),
        final(2).alias("Recommendation"),
    )


def performance(df: DataFrame, score: str, label: str, at: float = 70.0) -> DataFrame:
    """One row of metrics of a score against its truth: both clipped to 0..100, the score cut at ``at``."""
    rows = df.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score).cast("double"))).alias("s"), F.col(label).cast("double").alias("y")).dropna()
    rows = rows.withColumn("t", (F.col("y") >= at).cast("int"))
    cells = metrics.confusion(rows, F.col("s") >= at, F.col("t"))
    one = cells.join(metrics.auc(rows, "s", "t").select("auc"), F.lit(True))
    one = one.join(rows.agg(F.count("*").alias("n"), F.corr("s", "y").alias("r")), F.lit(True)).join(metrics.spearman(rows, "s", "y").select("rho"), F.lit(True))
    return one


def protocol(df: DataFrame) -> DataFrame:
    """(gene_symbol, section, line, text): what to look for and to verify for each gene of high priority, in order."""
    text = lambda c: optional(df, c, "Unknown", "string")
    number = lambda c: optional(df, c, 0, "double")
    flag = lambda c: optional(df, c, False, "boolean")
    modality, sm, bio = text("Step11_Best_Modality"), number("Step11_SmallMolecule_Score"), number("Step11_Biologic_Score")
    small = modality == "Small Molecule"
    quoted = F.concat(F.lit('"'), F.col("gene_symbol"), F.lit('"'))
    asked = {
        "any": F.lit(True),
        "small": small | (sm > bio),
        "biologic": (modality == "Biologic") | (bio > sm) | flag("Step11_Is_Biologic_Only"),
        **{family: text("Step9_Protein_Family") == family for family in ("GPCR", "Kinase", "IC")},
    }
    queries = lines(*[F.when(asked[k], F.concat(quoted, F.lit(f" AND {q}"))) for k, each in rules.SEARCHES for q in each])
    of = lambda values: F.array(*map(F.lit, values))
    either = lambda condition, yes, no: F.when(condition, of(yes)).otherwise(of(no))
    sections = (
        ("predicted_modality", F.array(modality)),
        ("literature_search_queries", queries),
        ("key_evidence_to_find", either(flag("has_approved_drugs"), rules.EVIDENCE_WITH_DRUGS, rules.EVIDENCE_WITHOUT)),
        ("validation_experiments", either(small, rules.EXPERIMENTS_SMALL, rules.EXPERIMENTS_OTHER)),
        ("red_flags_to_check", of(rules.RED_FLAGS)),
        ("expected_druggability_markers", either(small, rules.MARKERS_SMALL, rules.MARKERS_OTHER)),
        ("literature_validation_checklist", of(rules.CHECKLIST)),
    )
    held = F.explode(F.array(*[F.struct(F.lit(name).alias("section"), each.alias("texts")) for name, each in sections])).alias("s")
    rows = df.where("Step11_Priority = 'High Priority'").select("gene_symbol", held)
    return rows.select("gene_symbol", F.col("s.section").alias("section"), F.posexplode("s.texts").alias("line", "text"))


def metrics_with_probability(row: dict) -> dict:
    """The metrics row with the two-sided probabilities of its correlations."""
    return row | {"r_p": metrics.correlation_p(row["r"], row["n"]), "rho_p": metrics.correlation_p(row["rho"], row["n"])}


