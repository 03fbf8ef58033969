"""Two composite scores per gene, for small molecules and for biologics, and the class that follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.functions.columns import bands, has_any, ladder, optional, starts_with_any, weighted


def with_inputs(df: DataFrame) -> DataFrame:
    """The inputs as ``i_`` columns, with defaults for what is missing. Missing disorder is 0 unless told apart."""
    text = lambda name, default="": optional(df, name, default, "string")
    number = lambda name: optional(df, name, 0, "double")
    flag = lambda name: optional(df, name, False, "boolean")
    join = lambda *names: F.lower(F.concat_ws(" ", *[text(n) for n in names]))
    return df.withColumns({
        "i_gene": text("gene_symbol"), "i_family9": text("Step9_Protein_Family", "Unknown"), "i_type": text("druggable_family_type", "Unknown"), "i_confidence": text("druggable_family_confidence", "LOW"), "i_druggable": flag("is_druggable_family"),
        "i_dgidb": number("dgidb_num_approved"), "i_approved": F.greatest(number("dgidb_num_approved"), number("opentargets_approved"), number("chembl_approved_drugs")), "i_ot": number("opentargets_approved"), "i_bioactive": number("chembl_bioactive_compounds"),
        "i_has_approved": flag("has_approved_drugs"), "i_has_clinical": flag("has_clinical_drugs"), "i_drug_types": text("opentargets_drug_types"), "i_drug_names": F.lower(text("dgidb_approved_drugs")),
        "i_text": join("druggable_family_type", "protein_class", "uniprot_protein_families", "gene_name", "gene_description", "uniprot_protein_name"), "i_place": join("subcellular_location", "Step6_Subcellular_Location"), "i_topology": F.lower(text("Step6_Topology")),
        "i_pocket": flag("has_druggable_pocket"), "i_pocket_score": number("best_pocket_druggability"), "i_pocket_volume": number("best_pocket_volume"), "i_tdl": text("Step9_Target_Development_Level", "Unknown"), "i_tier": text("Step6_Druggability_Tier", "Unknown"),
        "i_disorder": F.col("Step8_Disorder_Percentage").try_cast("double") if "Step8_Disorder_Percentage" in df.columns else F.lit(None).cast("double"),
        "i_gtex": flag("Step7_GTEx_Data_Available"), "i_tissues": number("Step7_Tissues_With_Expression"), "i_tpm": number("Step7_Max_TPM"), "i_string": flag("Step10_STRING_Data_Available"), "i_targets": number("Step10_Drug_Target_Interactions"), "i_hub": flag("Step10_Network_Hub"),
    })


def only_biologic() -> Column:
    """Whether a target is open to biologics alone; the first rule that applies decides."""
    c = F.col
    signal = has_any("i_text", rules.SIGNAL_TERMS)
    secreted = c("i_place").contains("secreted") & ~c("i_place").contains("membrane")
    return ladder(
        (c("i_gene").isin(list(rules.FALSE_POSITIVES)), True), (c("i_family9").isin(list(rules.DRUGGABLE_FAMILIES)) & (c("i_dgidb") >= 2), False), (starts_with_any("i_gene", rules.BIOLOGIC_PREFIXES), True),
        (c("i_drug_types").contains("Small molecule") & (c("i_dgidb") >= 1), False), (has_any("i_text", rules.BIOLOGIC_TERMS), True), (secreted & signal, True), default=False,
    )


def small_molecule_drugs() -> Column:
    """How many approved small molecules count; null if none do."""
    c = F.col
    named = c("i_drug_types").contains("Small molecule") & (c("i_dgidb") >= 1)
    low = F.lower("i_drug_types")
    biologic = (has_any("i_drug_types", rules.ONLY_BIOLOGIC_WORDS) & ~low.contains("small molecule")) | (c("i_drug_names").contains("mab") & ~c("i_drug_types").contains("small molecule"))
    return ladder((c("i_gene").isin(list(rules.FALSE_POSITIVES)), F.lit(None).cast("long")), (named, c("i_dgidb").cast("long")), (biologic, F.lit(None).cast("long")), (c("i_has_approved") | (c("i_approved") > 0), c("i_approved").cast("long")))


def biologic_drugs() -> Column:
    """How many biologic drugs count; null if the drugs' types name none."""
    c = F.col
    antibodies = F.when(has_any("i_drug_types", ("antibody", "antibodies")), F.greatest(F.lit(1.0), c("i_ot"))).otherwise(0.0)
    names = c("i_drug_names").contains("mab").cast("int") + c("i_drug_names").contains("umab").cast("int")
    return F.when(has_any("i_drug_types", rules.BIOLOGIC_DRUG_WORDS), F.greatest(antibodies, names.cast("double")).cast("long"))


def composite(df: DataFrame) -> DataFrame:
    """The table with the ``Step11_`` columns."""
    c, names = F.col, df.columns
    x = with_inputs(df).withColumns({"i_only": only_biologic(), "i_sm": small_molecule_drugs(), "i_bio": biologic_drugs()})
    only, sm, family = c("i_only"), F.coalesce("i_sm", F.lit(0)), F.concat_ws(" ", "i_family9", "i_type")
    high = c("i_confidence") == "HIGH"
    pocket = lambda score, volume: c("i_pocket") & (c("i_pocket_score") >= score) & (c("i_pocket_volume") >= volume)
    is_in = lambda word: family.contains(word)
    antibody = c("i_drug_types").contains("Antibody") | c("i_drug_types").contains("Protein")
    score = {
        "drugs": ladder((only, 0), (sm >= 10, 10), (sm >= 5, 9), (sm >= 3, 8), (sm >= 1, 7), (c("i_has_clinical"), 4), (c("i_bioactive") >= 100, 3), (c("i_bioactive") >= 50, 2), (c("i_bioactive") >= 10, 1), default=0),
        "family": ladder((only, 0), (is_in("GPCR") | is_in("Kinase"), 10), (c("i_family9").isin("IC", "NR"), 9), (is_in("Protease"), 8), ((is_in("Transporter") | is_in("Enzyme")) & high, 7), (is_in("Enzyme"), 5), (c("i_druggable") & high, 4), (c("i_druggable") & (c("i_confidence") == "MEDIUM"), 3), (c("i_druggable"), 2), default=0),
        "pocket": ladder((only, 0), (pocket(0.8, 500), 10), (pocket(0.6, 400), 8), (pocket(0.5, 300), 6), (pocket(0.3, 200), 3), (c("i_pocket"), 1), default=0),
        "pharos": ladder(*[(c("i_tdl") == k, v[6]) for k, v in rules.LEVELS.items()], default=0),
        "access": ladder(*[(c("i_tier").contains(f"Tier {k}"), v) for k, v in ((1, 10), (2, 7), (3, 4), (4, 1))], default=0),
        "disorder": F.when(c("i_disorder").isNotNull(), bands("i_disorder", (10, 10), (20, 8), (30, 6), (40, 4), (50, 2), default=0, below=True)).otherwise(0),
        "expression": F.when(c("i_gtex"), ladder(((c("i_tissues") >= 40) & (c("i_tpm") >= 10), 10), (c("i_tissues") >= 30, 7), (c("i_tissues") >= 20, 5), (c("i_tissues") >= 10, 3), default=0)).otherwise(0),
        "network": F.when(c("i_string"), ladder(((c("i_targets") >= 10) | (c("i_hub") & (c("i_targets") >= 5)), 10), (c("i_targets") >= 5, 7), (c("i_targets") >= 2, 4), (c("i_targets") >= 1, 2), default=0)).otherwise(0),
        "bio_drugs": ladder((c("i_bio") >= 5, 10), (c("i_bio") >= 3, 9), (c("i_bio") >= 1, 8), (c("i_has_clinical") & antibody, 5), default=0),
        "bio_access": ladder((c("i_gene").startswith("COL"), 2), (c("i_place").contains("secreted"), 10), (has_any("i_place", ("cell membrane", "plasma membrane")) & c("i_topology").contains("extracellular"), 9), (has_any("i_place", ("cell membrane", "plasma membrane")), 6), (has_any("i_place", ("cytoplasm", "nucleus", "mitochondri")), 1), default=3),
    }
    x = x.withColumns({f"s_{k}": v for k, v in score.items()})
    number = lambda text, n, more=" SM drugs": F.concat(n.cast("string"), F.lit(more))
    percent = lambda word: F.concat(F.lit(f"{word} ("), F.format_string("%.1f", c("i_disorder")), F.lit("%)"))
    evidence = {
        "drugs": ladder((only, "BIOLOGIC-ONLY"), (sm >= 3, number("", sm)), (sm >= 1, number("", sm, " SM drug(s)")), (c("i_has_clinical"), "Clinical"), (c("i_bioactive") > 0, F.concat(c("i_bioactive").cast("long").cast("string"), F.lit(" bioactive"))), default="No drugs"),
        "family": ladder((only, "BIOLOGIC-ONLY"), (is_in("GPCR"), "GPCR"), (is_in("Kinase"), "Kinase"), (c("i_family9") == "IC", "Ion Channel"), (c("i_family9") == "NR", "Nuclear Receptor"), (is_in("Protease"), "Protease"), (is_in("Transporter") & high, "Transporter"), (is_in("Enzyme"), "Enzyme"), (c("i_druggable"), F.concat(F.lit("Druggable ("), c("i_confidence"), F.lit(")"))), default="Non-druggable"),
        "pocket": ladder((only, "BIOLOGIC-ONLY"), *[(c("s_pocket") == n, f"{w} pocket") for n, w in ((10, "Excellent"), (8, "Good"), (6, "Moderate"), (3, "Weak"), (1, "Poor"))], default="No pockets"),
        "pharos": ladder((c("i_tdl").isin(list(rules.LEVELS)), c("i_tdl")), default="Unknown"), "access": ladder(*[(c("i_tier").contains(f"Tier {k}"), f"Tier {k}") for k in (1, 2, 3, 4)], default="Unknown"),
        "disorder": ladder((c("i_disorder").isNull(), "No data"), *[(c("i_disorder") < t, percent(w)) for t, w in ((10, "Excellent"), (20, "Very low"), (30, "Low"), (40, "Moderate"), (50, "High"))], default=percent("Very high")),
        "expression": ladder((~c("i_gtex"), "No data"), *[(c("s_expression") == n, F.concat(F.lit(f"{w} ("), c("i_tissues").cast("int").cast("string"), F.lit(" tissues)"))) for n, w in ((10, "Broad"), (7, "Good"), (5, "Moderate"), (3, "Limited"))], default="Poor"),
        "network": ladder((~c("i_string"), "No data"), (c("s_network") >= 4, F.concat(c("i_targets").cast("int").cast("string"), F.lit(" targets"))), (c("s_network") == 2, "1 target"), default="Poor"),
    }
    nothing = reduce(lambda a, b: a & b, [c(f"s_{k}") == 0 for k in ("drugs", "family", "pocket")])
    cap = lambda when, most: F.when(when, F.lit(most)).otherwise(F.lit(100.0))
    x = x.withColumns({
        "Step11_SmallMolecule_Score": F.round(F.least(weighted([(f"s_{k}", w) for k, w in rules.SM_WEIGHTS.items()]), cap(nothing, 30.0), cap(only, 20.0)), 2),
        "Step11_Biologic_Score": F.round(weighted([(f"s_{k}", w) for k, w in rules.BIO_WEIGHTS.items()]), 2),
    })
    a, b = c("Step11_SmallMolecule_Score"), c("Step11_Biologic_Score")
    x = x.withColumn("Step11_Composite_Score", F.greatest(a, b))
    shown = F.slice(F.array_compact(F.array(*[F.when(c(f"s_{k}") >= 7, v) for k, v in evidence.items()])), 1, 8)
    titles = {"drugs": "SM_Drugs", "family": "SM_Family", "pocket": "SM_Pocket", "pharos": "SM_Pharos", "access": "SM_Access", "disorder": "SM_Disorder", "expression": "Expression", "network": "Network", "bio_drugs": "Bio_Drugs", "bio_access": "Bio_Access"}
    return x.select(
        *names, "Step11_Composite_Score", a, b, ladder((a > b, "Small Molecule"), (b > a, "Biologic"), default="Both").alias("Step11_Best_Modality"),
        *[bands("Step11_Composite_Score", (rules.HIGH, f"High {w}"), (rules.MEDIUM, f"Medium {w}"), default=f"Low {w}").alias(f"Step11_{k}") for k, w in (("Classification", "Druggability"), ("Priority", "Priority"))], only.alias("Step11_Is_Biologic_Only"),
        *[c(f"s_{k}").alias(f"Step11_{t}_Score") for k, t in titles.items()], F.when(F.size(shown) > 0, F.array_join(shown, " | ")).otherwise("Limited evidence").alias("Step11_Evidence"), evidence["drugs"].alias("Step11_SM_Drugs_Evidence"), evidence["family"].alias("Step11_SM_Family_Evidence"),
        ladder((c("s_bio_access") == 2, "Collagen - insoluble"), *[(c("s_bio_access") == n, w) for n, w in ((10, "Secreted"), (9, "Membrane + ECD"), (6, "Membrane"), (1, "Intracellular"))], default="Unknown").alias("Step11_Bio_Access_Evidence"),
    )
