"""Feature stages: from snapshots to columns of one wide table, a row per gene.

Each function takes a snapshot (or the table) and returns columns keyed by gene, as one plan of Column expressions; the
caller attaches them. Nothing is fetched, looped over or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.functions.columns import bands, capped_join, col, has_any, ladder, letters_sum, present_mean, upper_median
from rankmill.functions.polymorphic import drop_parsed, listed, listed_in, members, parsed, value
from rankmill.operators.rule_index import matched, rule_table
from rankmill.operators.tables import top_k

# -- 1: identifiers from annotation ----------------------------------------------------------------------------------


def best_first() -> Column:
    """The order of a gene's protein entries: reviewed ones, then as they were answered (``seq``), then by accession."""
    return F.struct(~F.coalesce(F.col("reviewed"), F.lit(False)), F.coalesce("seq", F.lit(2**62)), F.coalesce("primaryAccession", F.lit("")))


def identifiers(annotation: DataFrame, proteins: DataFrame) -> DataFrame:
    """Identifiers per gene. Of several answers to one query the last counts; proteins fill what annotation lacks."""
    last = annotation.groupBy("query").agg(F.max_by(F.struct(*[c for c in annotation.columns if c != "query"]), F.coalesce("seq", F.lit(0))).alias("a")).select(F.col("query").alias("gene_symbol"), "a.*")
    fields = ("alias", "other_names", "ensembl", "uniprot", "refseq", "pdb", "ec", "interpro", "pfam", "prosite", "genomic_pos", "homologene", "wikipedia")
    shown = lambda items, n: F.nullif(capped_join(items, n), F.lit(""))
    place = lambda path: value("genomic_pos", path, first=True)
    whole = F.when(~F.trim("uniprot").startswith("{"), F.get(listed("uniprot"), 0))
    table = parsed(last, *fields).select(
        "gene_symbol", F.col("symbol").alias("gene_symbol_official"), F.col("name").alias("gene_name"), F.col("summary").alias("gene_description"), F.col("type_of_gene").alias("gene_type"),
        shown(listed("alias"), 1000).alias("aliases"), shown(listed("other_names"), 5).alias("other_names"), value("ensembl", "$.gene", first=True).alias("ensembl_gene_id"),
        shown(listed_in("ensembl", "$.transcript", True), 5).alias("ensembl_transcript_ids"), shown(listed_in("ensembl", "$.protein", True), 5).alias("ensembl_protein_ids"),
        F.coalesce(F.get(listed_in("uniprot", "$['Swiss-Prot']"), 0), whole).alias("uniprot_swissprot"), shown(listed_in("uniprot", "$.TrEMBL"), 3).alias("uniprot_trembl"),
        F.col("entrezgene").alias("entrez_gene_id"), *[shown(listed_in("refseq", f"$.{k}"), 3).alias(name) for k, name in (("rna", "refseq_mrna"), ("protein", "refseq_protein"), ("genomic", "refseq_genomic"))],
        F.col("HGNC").alias("hgnc_id"), F.col("MIM").alias("omim_id"), F.col("pharmgkb").alias("pharmgkb_id"), shown(listed("pdb"), 20).alias("pdb_ids"), shown(listed("ec"), 10).alias("ec_number"),
        shown(members("interpro", "id"), 10).alias("interpro_domains"), shown(listed("pfam"), 10).alias("pfam_domains"), shown(listed("prosite"), 10).alias("prosite_domains"),
        place("$.chr").alias("chromosome"), place("$.start").try_cast("long").alias("start_position"), place("$.end").try_cast("long").alias("end_position"), place("$.strand").try_cast("int").alias("strand"),
        F.col("taxid").alias("taxonomy_id"), value("homologene", "$.id").alias("homologene_id"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), value("wikipedia", "$.url_stub")).alias("wikipedia_url"), pathways("pathway").alias("pathways"),
    )
    best = proteins.groupBy(F.col("gene").alias("gene_symbol")).agg(F.min_by(F.struct("primaryAccession", "uniProtkbId", "sequence", "comments", "uniProtKBCrossReferences"), best_first()).alias("p"))
    refs = lambda db: F.transform(F.filter("p.uniProtKBCrossReferences", lambda r: r["database"] == db), lambda r: r["id"])
    joined = table.join(best, "gene_symbol", "left")
    return joined.withColumns({
        "uniprot_swissprot": F.coalesce("uniprot_swissprot", "p.primaryAccession"), "uniprot_entry_name": F.col("p.uniProtkbId"), "protein_length": F.col("p.sequence.length"), "string_id": F.get(refs("STRING"), 0),
        "pdb_ids": F.coalesce("pdb_ids", F.nullif(capped_join(refs("PDB"), 20), F.lit(""))), "subcellular_location": F.nullif(capped_join(locations("p.comments")[0], 5), F.lit("")),
    }).drop("p")


def pathways(x: str) -> Column:
    """{database: [{id}]} (or one object for the list) -> the first five of each as ``database:id``."""
    entries = F.map_entries(F.from_json(x, "map<string,string>"))
    each = lambda e: F.transform(F.slice(F.from_json(F.when(F.trim(e["value"]).startswith("["), e["value"]).otherwise(F.concat(F.lit("["), e["value"], F.lit("]"))), "array<struct<id:string>>"), 1, 5), lambda i: F.concat_ws(":", e["key"], i["id"]))
    return F.nullif(F.array_join(F.flatten(F.transform(entries, each)), "|"), F.lit(""))


def locations(comments: str) -> tuple[Column, Column]:
    """Places and topologies of the first comment on location, each once."""
    first = F.get(F.filter(comments, lambda c: c["commentType"] == "SUBCELLULAR LOCATION"), 0)["subcellularLocations"]
    return tuple(F.array_distinct(F.array_compact(first[k]["value"])) for k in ("location", "topology"))


# -- 2: known drugs --------------------------------------------------------------------------------------------------


def drug_interactions(snapshot: DataFrame) -> DataFrame:
    names = lambda a, f: F.array_distinct(F.flatten(F.transform("interactions", lambda i: F.transform(i[a], lambda x: x[f]))))
    approved = F.filter("interactions", lambda i: i["drug"]["approved"])
    ordered = F.array_sort(F.transform("interactions", lambda i, k: F.struct((-F.coalesce(i["interactionScore"], F.lit(0.0))).alias("s"), k.alias("k"), i["drug"]["name"].alias("n"))))
    drug = lambda a: F.transform(a, lambda i: i["drug"]["name"])
    return snapshot.select(
        F.col("gene").alias("gene_symbol"), F.lit(True).alias("dgidb_found"), F.col("longName").alias("dgidb_long_name"), F.size("interactions").alias("dgidb_num_interactions"), F.size(approved).alias("dgidb_num_approved"),
        capped_join(drug(F.col("interactions")), 20).alias("dgidb_drugs"), capped_join(drug(approved), 20).alias("dgidb_approved_drugs"), capped_join(F.transform(ordered, lambda o: o["n"]), 5).alias("dgidb_top_5_drugs"),
        F.array_join(F.transform("geneCategories", lambda c: c["name"]), "|").alias("dgidb_categories"), F.array_join(names("interactionTypes", "type"), "|").alias("dgidb_interaction_types"), F.array_join(names("sources", "fullName"), "|").alias("dgidb_sources"),
    )


def compound_activities(snapshot: DataFrame, most: int = 1000) -> DataFrame:
    """Compounds of each phase; one compound may be in several. Exploded and counted, so long lists don't stay in a row."""
    rows = snapshot.select(F.col("gene").alias("gene_symbol"), "target_chembl_id", "target_type", F.explode_outer(F.slice("activities", 1, most)).alias("a"))
    one = rows.groupBy("gene_symbol", F.col("a.molecule_chembl_id").alias("m")).agg(
        F.first("target_chembl_id").alias("t"), F.first("target_type").alias("tt"), F.count("a").alias("n"),
        *[F.max(F.when(c, 1).otherwise(0)).alias(k) for k, c in (("p4", F.col("a.molecule_max_phase") == 4), ("p13", F.col("a.molecule_max_phase").between(1, 3)), ("p0", F.col("a").isNotNull() & ~F.coalesce(F.col("a.molecule_max_phase").between(1, 4), F.lit(False))))],
    )
    return one.groupBy("gene_symbol").agg(
        F.lit(True).alias("chembl_found"), F.first("t").alias("chembl_target_id"), F.first("tt").alias("chembl_target_type"), F.sum("p4").alias("chembl_approved_drugs"), F.sum("p13").alias("chembl_clinical_compounds"),
        F.sum("p0").alias("chembl_bioactive_compounds"), F.count("m").alias("chembl_total_compounds"), F.sum("n").alias("chembl_total_activities"),
    )


def known_drugs(snapshot: DataFrame) -> DataFrame:
    """Rows, not drugs, are counted by phase."""
    phase = lambda p: F.size(F.filter("rows", lambda r: r["phase"] == p))
    each = lambda f: F.array_distinct(F.array_compact(F.transform("rows", f)))
    return snapshot.select(
        F.col("ensembl_id").alias("ensembl_gene_id"), F.lit(True).alias("opentargets_found"), F.coalesce("uniqueDrugs", F.size("rows")).alias("opentargets_total_drugs"), phase(4).alias("opentargets_approved"), phase(3).alias("opentargets_phase3"), phase(2).alias("opentargets_phase2"), phase(1).alias("opentargets_phase1"),
        capped_join(F.transform("rows", lambda r: r["drug"]["name"]), 10).alias("opentargets_drug_names"), F.array_join(each(lambda r: r["drugType"]), "|").alias("opentargets_drug_types"), F.array_join(F.slice(each(lambda r: r["mechanismOfAction"]), 1, 5), "|").alias("opentargets_mechanisms"),
    )


def drug_evidence(df: DataFrame) -> DataFrame:
    n = lambda *c: reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in c])
    approved = n("dgidb_num_approved", "chembl_approved_drugs", "opentargets_approved")
    clinical = n("chembl_clinical_compounds", "opentargets_phase3", "opentargets_phase2", "opentargets_phase1")
    bioactive = n("chembl_bioactive_compounds")
    label = ladder((approved > 0, "HIGH - Approved drugs exist"), (clinical > 0, "MEDIUM - Clinical trials ongoing"), ((bioactive > 0) | (n("dgidb_num_interactions") > 0), "LOW - Bioactive compounds known"), default="NONE - No known drugs")
    return df.withColumns({"has_approved_drugs": approved > 0, "has_clinical_drugs": clinical > 0, "has_bioactive_compounds": bioactive > 0, "druggability_evidence": label})


# -- 3: families -----------------------------------------------------------------------------------------------------


def annotated_domains(annotation: DataFrame) -> DataFrame:
    """All InterPro and Pfam ids of each gene's annotation; ``identifiers`` shows only the first ones."""
    last = annotation.groupBy("query").agg(F.max_by(F.struct("interpro", "pfam"), F.coalesce("seq", F.lit(0))).alias("a"))
    return drop_parsed(parsed(last.select(F.col("query").alias("gene_symbol"), "a.*"), "interpro", "pfam").select("gene_symbol", members("interpro", "id").alias("__interpro"), listed("pfam").alias("__pfam")))


def id_and_name(key: Column, name: Column) -> Column:
    """``id:name``, or the id alone where the name is empty; null without an id."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(key, F.lit(":"), name)).otherwise(key)


def domain_entries(snapshot: DataFrame) -> DataFrame:
    """All InterPro ids of each protein from all its answers, in order, with the kinds of entries and the first ten families.

    A name may be a text or an object that holds one.
    """
    held = snapshot.groupBy("uniprot").agg(F.array_sort(F.collect_list(F.struct("seq", "results"))).alias("answers"))
    entries = F.flatten(F.array_compact(F.transform("answers", lambda a: F.transform(a["results"], lambda r: r["metadata"]))))
    name = lambda m: F.when(m["name"].startswith("{"), F.get_json_object(m["name"], "$.name")).otherwise(m["name"])
    named = F.filter("m", lambda m: (m["type"] == "Family") & (F.coalesce(name(m), F.lit("")) != ""))
    return held.select("uniprot", F.array_compact(entries).alias("m")).select(
        "uniprot",
        F.array_compact(F.transform("m", lambda m: F.nullif(m["accession"], F.lit("")))).alias("__entries"),
        F.nullif(capped_join(F.transform(named, lambda m: id_and_name(m["accession"], name(m))), 10), F.lit("")).alias("interpro_families"),
        F.nullif(F.array_join(F.array_distinct(F.transform("m", lambda m: F.nullif(m["type"], F.lit("")))), "|"), F.lit("")).alias("interpro_entry_types"),
    )


def cross_references(references: Column | str, database: str) -> tuple[Column, Column]:
    """The ids of one database among a protein's cross references, and the same as ``id:name`` by their first property."""
    own = F.filter(col(references), lambda r: (r["database"] == database) & (F.coalesce(r["id"], F.lit("")) != ""))
    none = F.array().cast("array<string>")
    named = F.transform(own, lambda r: id_and_name(r["id"], F.get(r["properties"], F.lit(0))["value"]))
    return F.coalesce(F.transform(own, lambda r: r["id"]), none), F.coalesce(named, none)


def first_list(*lists: Column | str) -> Column:
    """The first of the lists that has any values, without its nulls; else an empty one."""
    some = [F.array_compact(F.coalesce(col(x), F.array().cast("array<string>"))) for x in lists]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in some], F.array().cast("array<string>"))


FEW_RULES = 32


def classify_families(df: DataFrame, text: Column, ids: Column, families: dict[str, dict] | DataFrame | None = None, strict: bool = False, key: str | None = None) -> DataFrame:
    """Families by keywords and domain ids. ``families``: name -> {"keywords": [...], "ids": [...]}, in order, or a table
    as of ``rule_table``; those of ``rules.FAMILIES`` unless given.

    Keywords are substrings of the text in lower case, or whole words if ``strict``. Every family that is hit counts, and
    its hits are evidence. The rules are rows, met through their index (a dict of up to ``FEW_RULES`` is one expression, with
    the same results); ``key`` names a column of which each row has
    its own value, without it rows of equal text and ids are looked at once. A null text has no keyword.
    """
    families = rules.FAMILIES if families is None else families
    held = df.withColumns({"__low": F.lower(text), "__ids": ids})  # a column __ids of the table's own is taken up
    if isinstance(families, dict) and sum(len(r.get("keywords", [])) + len(r.get("ids", [])) for r in families.values()) <= FEW_RULES:
        return _with_families(held.withColumn("hits", _few_hits(families, strict)))
    table = rule_table(df.sparkSession, families) if isinstance(families, dict) else families
    own = F.struct(F.col(key)) if key else F.sha2(F.to_json(F.struct("__low", "__ids")), 256)
    held = held.withColumn("__key", own)
    rows = held.select(F.col("__key").alias("key"), F.col("__low").alias("low"), F.col("__ids").alias("ids"))
    hits = matched(rows if key else rows.dropDuplicates(["key"]), table, strict).withColumnRenamed("key", "__key")
    return _with_families(held.join(hits, "__key", "left"))


def _few_hits(families: dict[str, dict], strict: bool) -> Column:
    """The hits of a row by a few rules, as one expression."""
    low = F.col("__low")
    found = lambda k: low.rlike(rf"\b\Q{k}\E\b") if strict else low.contains(k)
    said = lambda name, kind, value: F.struct(F.lit(name).alias("family"), F.lit(f"{name}: {kind}: {value}").alias("evidence"))
    each = []
    for name, rule in families.items():
        each += [F.when(found(k.lower()), said(name, "Keyword", k)) for k in rule.get("keywords", [])]
        each += [F.when(F.array_contains("__ids", i), said(name, "Pfam" if i.startswith("PF") else "InterPro", i)) for i in rule.get("ids", [])]
    hits = F.array_compact(F.array(*each).cast("array<struct<family:string,evidence:string>>"))
    return F.when(F.size(hits) > 0, hits)


def _with_families(out: DataFrame) -> DataFrame:
    """The columns of families from a row's hits (family, evidence), in order; null without any."""
    none = F.array().cast("array<string>")
    evidence = F.coalesce(F.transform("hits", lambda h: h["evidence"]), none)
    names = F.array_distinct(F.coalesce(F.transform("hits", lambda h: h["family"]), none))
    return out.withColumns({
        "is_druggable_family": F.col("hits").isNotNull(), "druggable_family_type": F.array_join(names, "|"),
        "druggable_family_confidence": bands(F.size(evidence), (3, "HIGH"), (2, "MEDIUM"), (1, "LOW"), default="NONE"), "druggable_family_evidence": capped_join(evidence, 10),
    }).drop("hits", "__low", "__ids", "__key")


def protein_texts(side: DataFrame) -> DataFrame:
    """gene_symbol, a protein's entry, and its domains by annotation and by domain entries -> what is said of it: the stage's texts, ``__text``, ``__ids`` and ``__words``."""
    words = F.transform("entry.keywords", lambda k: k["name"])
    about = lambda kind: F.filter(F.flatten(F.array_compact(F.transform(F.filter("entry.comments", lambda c: c["commentType"] == kind), lambda c: F.transform(c["texts"], lambda t: t["value"])))), lambda t: t != "")
    named = F.col("entry.proteinDescription.recommendedName.fullName.value")
    df = side.withColumns({
        "uniprot_protein_name": named, "uniprot_function": F.try_element_at(about("FUNCTION"), F.lit(-1)), "uniprot_protein_families": F.nullif(F.array_join(about("SIMILARITY"), "|"), F.lit("")),
        "uniprot_keywords": F.nullif(capped_join(words, 20), F.lit("")), "__words": words,
    })
    text = F.concat_ws(" ", "uniprot_protein_name", "uniprot_function", "uniprot_protein_families", F.array_join("__words", " "))
    (pfam, pfam_named), (_, interpro_named) = (cross_references("entry.uniProtKBCrossReferences", name) for name in ("Pfam", "InterPro"))
    for kind, said in (("pfam", pfam_named), ("interpro", interpro_named)):
        df = df.withColumns({f"{kind}_domains__s3": F.nullif(capped_join(said, 15), F.lit("")), f"{kind}_domain_count": F.size(said)})
    ids = F.concat(first_list("__entries", "__interpro"), first_list(pfam, "__pfam"))
    return df.withColumns({"__text": text, "__ids": ids}).drop("entry", "__entries", "__interpro", "__pfam")


def family_columns(told: DataFrame, families: dict | DataFrame | None = None) -> DataFrame:
    """The texts with the families that the rules give."""
    df = classify_families(told, F.col("__text"), F.col("__ids"), families, key="gene_symbol")
    return df.withColumn("protein_class", protein_class("druggable_family_type", "__words")).drop("__words", "__text")


def protein_class(family_type: Column | str, keywords: Column | str) -> Column:
    """The first family; else the first of five keywords that names a kind of protein."""
    kinds = ("receptor", "enzyme", "channel", "transporter")
    named = F.get(F.filter(F.slice(col(keywords), 1, 5), lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in kinds])), 0)
    return F.coalesce(F.nullif(F.get(F.split(col(family_type), r"\|"), 0), F.lit("")), named)


# -- 4 and 5: structures and pockets ----------------------------------------------------------------------------------


def structures(genes: DataFrame, search: DataFrame, meta: DataFrame, predicted: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The first structure found, its quality, and the predicted one; genes has gene_symbol and uniprot.

    ``files`` (structure, path), as of ``structure_files``, are those at hand: a source then counts only with its
    file. Without it every structure that is known counts as at hand.
    """
    first = search.select("uniprot", F.size("ids").alias("num_pdb_structures"), capped_join("ids", 10).alias("pdb_ids__s4"), F.get("ids", F.lit(0)).alias("best_pdb_id"))
    about = {"resolution": "resolution", "method": "method", "title": "title", "deposit_date": "date", "organism": "organism"}
    out = genes.join(first, "uniprot", "left")
    out = out.join(meta.select(F.col("pdb_id").alias("best_pdb_id"), *[F.col(c).alias(f"best_pdb_{name}") for c, name in about.items()]), "best_pdb_id", "left")
    model = predicted.select("uniprot", F.lit(True).alias("has_alphafold_structure"), F.col("modelCreatedDate").alias("alphafold_version"), F.col("avgPlddt").alias("alphafold_avg_plddt"))
    out = out.join(model, "uniprot", "left")
    held = lambda key, name: files.select(F.col("structure").alias(key), F.col("path").alias(name)).dropDuplicates([key])
    for key, name in (("best_pdb_id", "pdb_structure_file"), ("uniprot", "alphafold_structure_file")):
        out = out.withColumn(name, F.lit(None).cast("string")) if files is None else out.join(held(key, name), key, "left")
    r, p = F.nullif("best_pdb_resolution", F.lit(0.0)), F.col("alphafold_avg_plddt")
    has, modelled = F.coalesce(F.col("num_pdb_structures") > 0, F.lit(False)), F.coalesce("has_alphafold_structure", F.lit(False))
    at_hand = lambda name: F.lit(files is None) | F.col(name).isNotNull()
    source = ladder((has & at_hand("pdb_structure_file"), "PDB"), (~has & modelled & at_hand("alphafold_structure_file"), "AlphaFold"))
    quality = ladder((~modelled, None), (p >= 90, "Very High (>90)"), (p >= 70, "High (70-90)"), (p >= 50, "Low (50-70)"), (p.isNotNull(), "Very Low (<50)"), default="Unknown")
    known = ladder((r <= 2.0, "Excellent (<2.0Å)"), (r <= 2.5, "Good (2.0-2.5Å)"), (r <= 3.0, "Moderate (2.5-3.0Å)"), (r.isNotNull(), F.concat(F.lit("Low (>"), F.format_string("%.1f", r), F.lit("Å)"))))
    url = lambda kind: F.when(modelled, F.concat(F.lit(rules.MODEL_FILES + "/AF-"), "uniprot", F.lit(f"-F1-{kind}")))
    out = out.withColumns({
        "has_pdb_structure": has, "has_alphafold_structure": modelled, "num_pdb_structures": F.coalesce("num_pdb_structures", F.lit(0)), "alphafold_quality": quality, "structure_source": source,
        "alphafold_model_url": url("model_v4.pdb"), "alphafold_confidence_url": url("confidence_v4.json"), "alphafold_pae_url": url("predicted_aligned_error_v4.json"),
    })
    of = lambda pdb, model: F.when(F.col("structure_source") == "PDB", pdb).when(F.col("structure_source") == "AlphaFold", model)
    return out.withColumns({
        "structure_file": of(F.col("pdb_structure_file"), F.col("alphafold_structure_file")),
        "structure_quality_score": of(known, F.col("alphafold_quality")),
    })


def assess_pockets(pockets: DataFrame) -> DataFrame:
    """Each pocket's mean of what is known of it, its category and its features. A number that is 0 is as good as missing."""
    v, d, h, s = (F.nullif(c, F.lit(0.0)) for c in ("volume", "druggability", "hydrophobicity", "score"))
    parts = [ladder((v >= 500, 1.0), (v >= 200, 0.7), (v.isNotNull(), 0.3)), ladder((d >= 0.7, 1.0), (d >= 0.5, 0.6), (d.isNotNull(), 0.3)), ladder((h > 0.5, 0.8), (h > 0.3, 0.5)), ladder((s > 0.5, 0.7), (s.isNotNull(), 0.4))]
    mean = F.round(present_mean([p.cast("double") for p in parts]), 10)
    text = lambda label, form, x: F.concat(F.lit(label + " ("), F.format_string(form, x), F.lit("A3)" if "f" in form and form == "%.0f" else ")"))
    good = F.array_compact(F.array(F.when(v >= 500, text("Optimal volume", "%.0f", v)).when(v >= 200, text("Adequate volume", "%.0f", v)), F.when(d >= 0.7, text("High druggability", "%.2f", d))))
    bad = F.array_compact(F.array(F.when(v < 200, text("Small volume", "%.0f", v)), F.when(d < 0.5, text("Low druggability", "%.2f", d))))
    out = pockets.withColumn("mean", mean)
    return out.withColumns({
        "is_druggable": F.coalesce(F.col("mean") >= 0.5, F.lit(False)), "category": bands("mean", (0.8, "Excellent"), (0.65, "Good"), (0.5, "Moderate"), default="Poor"),
        "confidence": bands("mean", (0.8, "High"), (0.65, "Medium"), default="Low"), "favorable": good, "concerns": bad,
    })


def best_pockets(assessed: DataFrame) -> DataFrame:
    """(gene_symbol, pocket columns) -> the best pocket of each gene by druggability, the first one on ties, and counts."""
    order = F.struct(F.coalesce("druggability", F.lit(0.0)).alias("d"), (-F.col("pocket_id")).alias("i"))
    best = F.max_by(F.struct("pocket_id", "volume", "druggability", "hydrophobicity", "score", "category", "confidence", "favorable", "concerns"), order)
    by = assessed.groupBy("gene_symbol").agg(best.alias("b"), F.count("*").alias("pockets_found"), F.count_if("is_druggable").alias("num_druggable_pockets"), F.array_sort(F.collect_list(F.struct("pocket_id", "volume", "druggability"))).alias("all"))
    v, d = (lambda x: F.rint(F.nullif(x["volume"], F.lit(0.0)))), (lambda x: F.nullif(x["druggability"], F.lit(0.0)))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    listed = lambda form, of: F.transform("all", lambda x: F.when(of(x).isNotNull(), F.format_string(form, of(x))))
    detail = F.transform("all", lambda x: F.format_string("P%d:Vol=%.0f:Drug=%.2f", x["pocket_id"], zero(v(x)), zero(d(x))))
    return by.select(
        "gene_symbol", F.lit(True).alias("fpocket_run"), "pockets_found", F.col("b.pocket_id").alias("best_pocket_id"), F.col("b.volume").alias("best_pocket_volume"), F.col("b.druggability").alias("best_pocket_druggability"), F.col("b.hydrophobicity").alias("best_pocket_hydrophobicity"), F.col("b.score").alias("best_pocket_score"),
        (F.col("num_druggable_pockets") > 0).alias("has_druggable_pocket"), "num_druggable_pockets", F.col("b.category").alias("best_pocket_category"), F.col("b.confidence").alias("best_pocket_confidence"), F.array_join("b.favorable", "|").alias("favorable_features"), F.array_join("b.concerns", "|").alias("concerns"),
        F.nullif(F.array_join(listed("%.0f", v), "|"), F.lit("")).alias("all_pockets_volumes"), F.nullif(F.array_join(listed("%.2f", d), "|"), F.lit("")).alias("all_pockets_druggability"), capped_join(detail, 10).alias("pocket_details"),
    )


# -- 6: location -----------------------------------------------------------------------------------------------------


def accessibility(df: DataFrame, location: str = "Step6_Subcellular_Location", topology: str = "Step6_Topology") -> DataFrame:
    """The nine accessibility columns; what comes first in priority decides."""
    place = ladder(
        (has_any(location, rules.OUTSIDE_WORDS), "outside"), (has_any(location, rules.MEMBRANE_WORDS) & has_any(topology, rules.DOMAIN_WORDS), "membrane_domain"), (has_any(location, rules.MEMBRANE_WORDS), "membrane"),
        (has_any(location, rules.CYTOPLASM_WORDS), "cytoplasm"), (has_any(location, rules.NUCLEUS_WORDS), "nucleus"), (has_any(location, rules.ORGANELLE_WORDS), "organelle"), default="unknown",
    )
    organelle = ladder(*[(has_any(location, (w,)), name) for w, name in rules.ORGANELLES], default="Unknown")
    out = df.withColumn("__place", place)
    for i, name in enumerate(rules.ACCESS_COLUMNS):
        value = ladder(*[(F.col("__place") == k, v[i]) for k, v in rules.ACCESS.items()])
        out = out.withColumn(f"Step6_{name}", value if i == 0 else F.replace(value, F.lit("{}"), organelle))
    return out.drop("__place")


# -- 7: expression ---------------------------------------------------------------------------------------------------


def tissue_category(name: Column | str) -> Column:
    return ladder(*[(reduce(lambda a, b: a | b, [col(name).contains(p) for p in words]), k) for k, words in rules.TISSUES.items()], default="Other")


def by_gene(expression: DataFrame, reference: DataFrame) -> DataFrame:
    """Expression answers by gene: a gene's first versioned id by the reference leads to the answer with that id.

    A gene that the reference knows has no other answer; an answer that names a gene unknown there is that gene's.
    """
    first = reference.where("geneId IS NOT NULL").groupBy("geneId").agg(F.nullif(F.min_by("gencodeId", F.coalesce("seq", F.lit(0))), F.lit("")).alias("gencodeId"))
    led = first.where("gencodeId IS NOT NULL").withColumnRenamed("geneId", "__gene").join(expression.where("gencodeId IS NOT NULL"), "gencodeId")
    named = expression.where("gene IS NOT NULL").join(first.select(F.col("geneId").alias("gene")), "gene", "left_anti")
    return led.select(F.col("__gene").alias("gene"), "gencodeId", "data").unionByName(named.select("gene", "gencodeId", "data"))


def expression_profile(snapshot: DataFrame) -> DataFrame:
    """Of each gene: where it is expressed and how much. Tissues are few per gene, so they stay a list."""
    data = F.transform("data", lambda t: F.struct(t["tissueSiteDetailId"].alias("tissue"), F.coalesce(t["median"], F.lit(0.0)).alias("tpm")))
    rows = snapshot.select(F.col("gene").alias("gene_symbol"), F.coalesce(data, F.array().cast("array<struct<tissue:string,tpm:double>>")).alias("t"))
    over = lambda x: F.size(F.filter("t", lambda t: t["tpm"] >= x))
    seen = F.transform(F.filter("t", lambda t: t["tpm"] > 0), lambda t: t["tpm"])
    category = lambda name, words: F.array_max(F.transform(F.filter("t", lambda t: reduce(lambda a, b: a | b, [t["tissue"].contains(w) for w in words])), lambda t: t["tpm"]))
    top = F.slice(F.array_sort(F.transform(F.filter("t", lambda t: t["tpm"] > 0), lambda t: F.struct((-t["tpm"]).alias("d"), t["tissue"].alias("n")))), 1, 5)
    specific = F.size(F.filter("t", lambda t: t["tpm"] > 0.1))
    out = rows.withColumns({
        "Step7_GTEx_Data_Available": F.size("t") > 0, "Step7_Total_Tissues": F.size("t"), "Step7_Tissues_With_Expression": F.size(seen), "Step7_Max_TPM": F.round(F.coalesce(F.array_max(seen), F.lit(0.0)), 3),
        "Step7_Mean_TPM": F.round(F.coalesce(F.aggregate(seen, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(seen), F.lit(0)), F.lit(0.0)), 3), "Step7_Median_TPM": F.round(F.coalesce(upper_median(seen), F.lit(0.0)), 3),
        "Step7_High_Expression_Tissues": over(10), "Step7_Medium_Expression_Tissues": over(1) - over(10), "Step7_Low_Expression_Tissues": over(0.1) - over(1),
        "Step7_Top_3_Tissues": F.array_join(F.transform(F.slice(top, 1, 3), lambda x: F.concat(x["n"], F.lit(":"), F.format_string("%.1f", -x["d"]))), "; "),
        "Step7_Tissue_Specificity": ladder((F.size("t") == 0, "Unknown"), (specific <= 5, "Highly Specific"), (specific <= 15, "Moderately Specific"), (specific <= 30, "Broadly Expressed"), default="Ubiquitous"),
    })
    for name, words in rules.TISSUES.items():
        out = out.withColumn(f"__{name}", F.coalesce(category(name, words), F.lit(0.0)))
    out = out.withColumns({"Step7_Brain_Max_TPM": F.round("__Brain", 3), "Step7_Blood_TPM": F.round("__Blood", 3), "Step7_Brain_Expression": ladder((F.col("__Brain") > 1, "Yes"), default="No"), "Step7_Blood_Expression": ladder((F.col("__Blood") > 1, "Yes"), (F.col("__Blood") > 0.1, "Low"), default="No")})
    blood, brain, tpm = F.col("Step7_Blood_Expression"), F.col("Step7_Brain_Expression"), F.col("Step7_Max_TPM")
    spread, known = F.col("Step7_Tissue_Specificity"), F.col("Step7_GTEx_Data_Available")
    near = (F.col("__Vascular") > 1) | (F.col("__Lung") > 1) | (F.col("__Skin") > 1)
    best = F.array_max(F.array(*[F.struct(F.col(f"__{n}").alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(rules.TISSUES)]))
    out = out.withColumns({
        "Step7_Accessible_Expression": ladder(((blood == "Yes") | (brain == "Yes"), "Yes"), (blood == "Low", "Partial"), default="No"),
        "Step7_Expression_Level_Score": ladder((tpm >= 50, 5), (tpm >= 10, 4), (tpm >= 1, 3), (tpm >= 0.1, 2), (tpm > 0, 1), default=0),
        "Step7_Tissue_Accessibility_Score": ladder(((blood == "Yes") & (F.col("__Blood") >= 10), 5), ((blood == "Yes") & (F.col("__Blood") >= 1), 4), (blood == "Yes", 3), (brain == "Yes", 3), (near, 2), default=1),
        "Step7_Expression_Breadth_Score": ladder((spread == "Highly Specific", 5), (spread == "Moderately Specific", 4), (spread == "Broadly Expressed", 3), default=2),
    })
    overall = F.least(F.col("Step7_Expression_Level_Score") + F.col("Step7_Tissue_Accessibility_Score"), F.lit(10))
    out = out.withColumn("Step7_Overall_Expression_Score", overall)
    score = F.col("Step7_Overall_Expression_Score")
    out = out.withColumns({
        "Step7_Expression_Confidence": ladder((known, "High - GTEx V8"), default="Low - No Data"),
        "Step7_Expression_Quality": ladder(((score >= 8) & known, "Excellent"), (score >= 6, "Good"), (score >= 4, "Moderate"), (score >= 2, "Poor"), default="Very Poor"),
        "Step7_Target_Validation_Feasibility": bands(tpm, (10, "Excellent - High expression enables robust validation"), (1, "Good - Sufficient for most validation methods"), (0.1, "Moderate - May require sensitive methods"), default="Poor - Low expression may limit validation"),
        "Step7_Drug_Delivery_Considerations": ladder((blood == "Yes", "Systemic delivery feasible"), (brain == "Yes", "CNS delivery required (BBB penetration)"), default=F.concat(F.lit("Targeted delivery to "), F.when(known, best["n"]).otherwise("Unknown"), F.lit(" may be needed"))),
        "Step7_Off_Target_Risk": ladder((spread == "Highly Specific", "Low - Tissue-specific expression"), (spread == "Moderately Specific", "Moderate - Some off-target expression expected"), default="High - Broad expression may cause off-target effects"),
    })
    return out.drop("t", *[f"__{n}" for n in rules.TISSUES])


# -- 8: disorder -----------------------------------------------------------------------------------------------------


def disorder(genes: DataFrame, consensus: DataFrame, predicted: DataFrame, sequences: DataFrame, merged: bool = False) -> DataFrame:
    """Share of disordered residues by the first of three sources: consensus regions, low confidence, composition.

    Regions are summed as they are, overlaps twice; with ``merged`` each residue counts once.
    """
    size = lambda r: r["end"] - r["start"] + 1
    plain = F.aggregate("regions", F.lit(0), lambda s, r: s + size(r))
    swept = F.aggregate(F.array_sort("regions"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"] - 1, s["to"]))).alias("n"), F.greatest(s["to"], r["end"]).alias("to")), lambda s: s["n"])
    found = consensus.where("length > 0").withColumn("regions", F.coalesce("regions", F.array().cast("array<struct<start:int,end:int>>"))).withColumn("n", swept if merged else plain)
    fields = lambda pct, n, total, k, longest, method: F.struct(pct.cast("double").alias("pct"), n.cast("long").alias("n"), total.cast("long").alias("total"), k.cast("int").alias("k"), longest.cast("int").alias("longest"), F.lit(method).alias("method"))
    zero = F.lit(0)
    a = found.select("uniprot", fields(100.0 * F.col("n") / F.col("length"), F.col("n"), F.col("length"), F.size("regions"), F.coalesce(F.array_max(F.transform("regions", size)), zero), "MobiDB Consensus").alias("a"))
    b = predicted.select("uniprot", fields(100.0 * F.col("n_low") / F.nullif("n_records", F.lit(0)), F.col("n_low"), F.col("n_records"), zero, zero, "AlphaFold pLDDT").alias("b"))
    mean = letters_sum("sequence", rules.PROPENSITY) / F.char_length("sequence")
    pct = ladder((F.col("p") > 0.3, F.least(70 + (F.col("p") - 0.3) * 100, F.lit(90.0))), (F.col("p") > 0, 30 + F.col("p") * 133), default=F.greatest(F.lit(5.0), 30 + F.col("p") * 60))
    c = sequences.where("sequence <> ''").withColumn("p", mean).withColumn("pct", pct)
    c = c.select("uniprot", fields(F.col("pct"), F.floor(F.char_length("sequence") * F.col("pct") / 100), F.char_length("sequence"), zero, zero, "Composition-based").alias("c"))
    out = genes.select("gene_symbol", "uniprot").join(a, "uniprot", "left").join(b, "uniprot", "left").join(c, "uniprot", "left").withColumn("d", F.coalesce("a", "b", "c"))
    known, p = F.col("d").isNotNull(), F.col("d.pct")
    share = 100.0 * F.col("d.longest") / F.nullif("d.total", F.lit(0))
    return out.select(
        "gene_symbol", known.alias("Step8_Disorder_Analysis_Available"), F.round(F.coalesce(p, F.lit(0.0)), 2).alias("Step8_Disorder_Percentage"), F.coalesce("d.n", zero).alias("Step8_Disordered_Residues"), F.coalesce("d.total", zero).alias("Step8_Total_Residues"),
        ladder((~known, "Unknown"), (p < 10, "Highly Ordered"), (p < 30, "Mostly Ordered"), (p < 50, "Moderately Disordered"), (p < 70, "Highly Disordered"), default="Intrinsically Disordered").alias("Step8_Disorder_Category"),
        F.coalesce("d.k", zero).alias("Step8_Num_Disordered_Regions"), F.coalesce("d.longest", zero).alias("Step8_Longest_Disordered_Region"), F.coalesce("d.method", F.lit("None")).alias("Step8_Disorder_Method"),
        ladder((~known, "Unknown"), (p < 20, "Excellent - Well-structured"), (p < 50, "Good - Druggable (<50% disorder)"), (p < 70, "Challenging - High disorder (>50%)"), default="Poor - Mostly disordered (>70%)").alias("Step8_Druggability_Impact"),
        ladder((~known, 0), (p < 10, 5), (p < 20, 4), (p < 50, 3), (p < 70, 2), default=1).alias("Step8_Disorder_Score"),
        ladder((~known, 0), ((F.col("d.total") <= 0) | (F.col("d.longest") <= 0), 5), ((share < 10) & (F.col("d.k") <= 2), 5), ((share < 30) & (F.col("d.k") <= 5), 4), (share < 50, 3), default=2).alias("Step8_Structural_Quality_Score"),
        F.coalesce(p < 50, F.lit(False)).alias("Step8_Passes_50_Percent_Rule"),
        ladder((~known, "Low - No Data"), (F.col("d.method").contains("MobiDB"), "High - MobiDB Consensus"), (F.col("d.method").contains("AlphaFold"), "High - AlphaFold pLDDT"), default="Medium - Estimated").alias("Step8_Druggability_Confidence"),
    )


# -- 9: development level --------------------------------------------------------------------------------------------


def development(snapshot: DataFrame) -> DataFrame:
    tdl, novelty = F.coalesce("tdl", F.lit("Unknown")), F.coalesce("novelty", F.lit(0.5))
    of = lambda i, default: ladder(*[(tdl == k, v[i]) for k, v in rules.LEVELS.items()], default=default)
    out = snapshot.select(
        F.col("sym").alias("gene_symbol"), F.lit(True).alias("Step9_Pharos_Data_Available"), F.coalesce("name", F.lit("Unknown")).alias("Step9_Target_Name"), tdl.alias("Step9_Target_Development_Level"), of(0, "Unknown").alias("Step9_TDL_Description"), F.coalesce(F.nullif("fam", F.lit("")), F.lit("Unknown")).alias("Step9_Protein_Family"),
        of(3, "Unknown").alias("Step9_Development_Status"), F.coalesce(F.nullif(F.substring("description", 1, 200), F.lit("")), F.lit("N/A")).alias("Step9_Target_Description"), novelty.alias("Step9_Novelty_Raw"), of(1, 0).alias("Step9_TDL_Score"),
        bands(novelty, (0.1, 5), (0.3, 4), (0.5, 3), (0.7, 2), default=1, below=True).alias("Step9_Novelty_Score"), of(4, "Unknown").alias("Step9_Druggability_Confidence"), of(2, "Unknown").alias("Step9_Drug_Development_Potential"), of(5, "Further assessment needed").alias("Step9_Recommended_Strategy"),
    )
    out = out.withColumn("Step9_Overall_Pharos_Score", F.least(F.col("Step9_TDL_Score") + F.col("Step9_Novelty_Score"), F.lit(10)))
    return out.withColumn("Step9_Target_Quality", bands("Step9_Overall_Pharos_Score", (8, "Excellent"), (6, "Very Good"), (4, "Good"), default="Moderate"))


# -- 10: network -----------------------------------------------------------------------------------------------------


def network(edges: DataFrame, enrichment: DataFrame, most: int = 20, sure: float = 700.0, required: float = 400.0) -> DataFrame:
    """Partners, drug targets among them, and terms; the scores follow. Edges are cut to ``most`` per gene by score.

    Edges under ``required`` of 1000 (a score of up to 1 is a share of that) don't count.

    Of pathways and processes the first three count, in the order of the answer (``seq``); those without one come last.
    """
    edges = edges.select(F.col("gene").alias("gene_symbol"), F.coalesce("preferredName_B", "stringId_B").alias("partner"), F.coalesce("score", F.lit(0.0)).alias("score"))
    edges = edges.where(F.when(F.col("score") <= 1, F.col("score") * 1000).otherwise(F.col("score")) >= required)
    family = ladder(*[(F.col("partner").isin(list(v)), k) for k, v in rules.DRUG_TARGETS.items()])
    top = top_k(edges, ["gene_symbol"], [F.desc("score"), F.col("partner")], most).withColumn("family", family)
    rows = top.groupBy("gene_symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "partner", "family"))).alias("p"), F.count("*").alias("Step10_Total_Interactions"), F.count_if(F.col("score") > sure).alias("Step10_High_Confidence_Interactions"), F.count("family").alias("Step10_Drug_Target_Interactions"))
    targets = F.filter("p", lambda x: x["family"].isNotNull())
    name = lambda a, f="partner": F.transform(a, lambda x: x[f])
    kinds = F.array_distinct(name(targets, "family"))
    kind = F.when(F.col("category") == "Process", "process").when(F.col("category").isin(list(rules.PATHWAYS)), "pathway")
    terms = enrichment.select(F.col("gene").alias("gene_symbol"), kind.alias("kind"), "seq", F.coalesce("description", "term", F.lit("")).alias("text")).where("kind IS NOT NULL")
    ranked = top_k(terms, ["gene_symbol", "kind"], [F.asc_nulls_last("seq"), F.col("text")], 3)
    first = ranked.groupBy("gene_symbol").agg(*[name(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "text")))), "text").alias(k) for k in ("pathway", "process")])
    none = F.array().cast("array<string>")
    out = rows.join(first, "gene_symbol", "full").withColumns({"pathway": F.coalesce("pathway", none), "process": F.coalesce("process", none), "known": F.col("p").isNotNull(), "targets": targets, "kinds": kinds})
    out = out.fillna(0, ["Step10_Total_Interactions", "Step10_High_Confidence_Interactions", "Step10_Drug_Target_Interactions"])
    n, dt, known = F.col("Step10_Total_Interactions"), F.col("Step10_Drug_Target_Interactions"), F.col("known")
    terms_n = F.greatest(F.size("pathway"), F.size("process"))
    gate = lambda c: F.when(known, c).otherwise(0)
    words = lambda c: F.when(known, c).otherwise("Unknown")
    out = out.withColumns({"Step10_Connectivity_Score": gate(bands(n, (15, 5), (10, 4), (5, 3), (2, 2), default=1)), "Step10_Drug_Target_Proximity_Score": gate(bands(dt, (5, 5), (3, 4), (2, 3), (1, 2), default=1)), "Step10_Pathway_Relevance_Score": gate(bands(terms_n, (3, 5), (2, 4), (1, 3), default=2))})
    out = out.withColumn("Step10_Overall_Network_Score", F.least(F.col("Step10_Connectivity_Score") + F.col("Step10_Drug_Target_Proximity_Score"), F.lit(10)))
    listed = lambda a, k, mark: F.array_join(F.slice(a, 1, k), mark)
    return out.select(
        "gene_symbol", known.alias("Step10_STRING_Data_Available"), n, "Step10_High_Confidence_Interactions", dt, listed(name("targets"), 5, "; ").alias("Step10_Drug_Target_Partners"), F.array_join("kinds", "; ").alias("Step10_Drug_Target_Families"),
        ladder((~known, "Unknown"), (n >= 15, "Highly Connected (Hub)"), (n >= 10, "Well Connected"), (n >= 5, "Moderately Connected"), default="Poorly Connected").alias("Step10_Network_Connectivity"), (n >= 15).alias("Step10_Network_Hub"),
        listed(name("p"), 10, "; ").alias("Step10_Top_Partners"), F.array_join("pathway", "; ").alias("Step10_Pathways"), F.array_join("process", "; ").alias("Step10_Biological_Processes"),
        "Step10_Connectivity_Score", "Step10_Drug_Target_Proximity_Score", "Step10_Pathway_Relevance_Score", "Step10_Overall_Network_Score",
        F.when(~known, "Low - No Data").otherwise(bands("Step10_High_Confidence_Interactions", (5, "High - Strong Evidence"), (2, "Medium - Moderate Evidence"), default="Low - Limited Evidence")).alias("Step10_Network_Confidence"),
        words(bands("Step10_Overall_Network_Score", (8, "Excellent"), (6, "Very Good"), (4, "Good"), default="Moderate")).alias("Step10_Network_Quality"),
        words(bands(dt, (3, "High - Connected to drug targets"), (1, "Moderate - Some drug target links"), default="Low - No direct drug target links")).alias("Step10_Druggability_Via_Network"),
        F.when(dt > 0, F.concat(F.lit("Drug targets: "), listed(name("targets"), 3, ", "), F.lit(" ("), listed("kinds", 3, ", "), F.lit(")"))).when(known, F.concat(F.lit("Top partners: "), listed(name("p"), 3, ", "))).otherwise("").alias("Step10_Key_Interactions"),
        F.when(~known, "").when(F.size("pathway") > 0, listed("pathway", 2, "; ")).when(F.size("process") > 0, listed("process", 2, "; ")).otherwise("No pathway data").alias("Step10_Pathway_Summary"),
        ladder((~known, ""), (n >= 15, "Target hub protein - broad pathway impact"), (dt >= 2, "Target alongside known drugs - combination therapy"), (n >= 5, "Target within pathway - modulate network"), default="Direct targeting - limited network effects").alias("Step10_Network_Strategy"),
    )


def unique_genes(df: DataFrame, key: str = "gene_symbol") -> DataFrame:
    """One row per key, the first by all its columns in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]))).where("__r = 1").drop("__r")
