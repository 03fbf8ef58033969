"""Readers of snapshots: what the remote services answered, as JSON lines or text under one folder.

A snapshot ``name`` is the folder or file ``<root>/<name>``; its schema is fixed here, so nothing is inferred. Services are
never called from tasks. Rows carry ``_status`` and ``_error`` where the answer failed; a line that isn't JSON, or that has
a value of another kind than the schema says, has its text in ``_corrupt``. ``ingest`` parses a snapshot once and parts the two: stages
see good answers alone, and ``failed_answers`` tells what to ask again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.functions.columns import sentinel_null
from rankmill.functions.rules import EMPTY_MARKS

_END = ", _status string, _error string, _corrupt string"
OPTIONAL = ("gene_reference",)  # answers may be by gene themselves
NOTHING_THERE = "404"  # an answer: there is nothing; it needn't be asked again
SCHEMAS = {
    "gene_annotation": "query string, seq long, symbol string, name string, summary string, type_of_gene string, alias string, other_names string, ensembl string, uniprot string, entrezgene string, refseq string, HGNC string, MIM string, pharmgkb string, pdb string, ec string, prosite string, interpro string, pfam string, genomic_pos string, taxid string, homologene string, wikipedia string, pathway string",
    "protein_entry": "gene string, seq long, reviewed boolean, primaryAccession string, uniProtkbId string, sequence struct<length:int,value:string>, comments array<struct<commentType:string,subcellularLocations:array<struct<location:struct<value:string>,topology:struct<value:string>>>,texts:array<struct<value:string>>>>, uniProtKBCrossReferences array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>, features array<struct<type:string,description:string>>, keywords array<struct<name:string>>, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>>",
    "drug_interactions": "gene string, longName string, geneCategories array<struct<name:string>>, interactions array<struct<drug:struct<name:string,approved:boolean>,interactionScore:double,interactionTypes:array<struct<type:string>>,sources:array<struct<fullName:string>>>>",
    "compound_activities": "gene string, target_chembl_id string, target_type string, activities array<struct<molecule_chembl_id:string,molecule_max_phase:int>>",
    "known_drugs": "ensembl_id string, count int, uniqueDrugs int, rows array<struct<drug:struct<id:string,name:string>,drugType:string,mechanismOfAction:string,phase:int,status:string>>",
    "domain_entries": "uniprot string, seq long, results array<struct<metadata:struct<accession:string,name:string,type:string>>>",
    "structure_search": "uniprot string, ids array<string>",
    "structure_meta": "pdb_id string, title string, method string, resolution double, deposit_date string, organism string",
    "predicted_structure": "uniprot string, modelCreatedDate string, paeDocUrl string, pdbUrl string, avgPlddt double",
    "tissue_expression": "gene string, gencodeId string, data array<struct<tissueSiteDetailId:string,median:double>>",
    "gene_reference": "geneId string, seq long, gencodeId string",
    "disorder": "uniprot string, length int, regions array<struct<start:int,end:int>>",
    "target_level": "sym string, name string, tdl string, fam string, description string, novelty double",
    "network_edges": "gene string, preferredName_B string, stringId_B string, score double",
    "enrichment": "gene string, seq long, category string, description string, term string",
    "literature": "gene string, disease string, count int, papers array<struct<pmid:string,title:string,pubdate:string>>",
    "trials": "gene string, studies array<struct<nctId:string,briefTitle:string,overallStatus:string,phase:string>>",
}


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a snapshot, good or not; polymorphic fields are kept as JSON text."""
    return spark.read.schema(SCHEMAS[name] + _END).option("columnNameOfCorruptRecord", "_corrupt").json(f"{root.rstrip('/')}/{name}")


def ingest(spark: SparkSession, root: str, name: str, path: str) -> DataFrame:
    """A snapshot as a table under ``path``, parsed in one pass: its good answers, each column read only when needed.

    ``_outcome`` parts the table's folders: "good", "nothing" (the service has nothing) or "failed": a status that isn't of the 200s, an
    error, or a line that can't be read. An empty snapshot, or one without good answers, gives an empty table; so does an ``OPTIONAL`` one
    that isn't there.
    """
    try:
        rows = read_snapshot(spark, root, name)
    except AnalysisException as e:
        if name not in OPTIONAL or e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMAS[name] + _END)
    known = F.trim(F.coalesce("_status", F.lit("")))
    bad = F.col("_corrupt").isNotNull() | (F.trim(F.coalesce("_error", F.lit(""))) != "") | ~(known.isin("", "OK") | known.rlike(r"^2\d\d$"))
    outcome = F.when(F.col("_corrupt").isNull() & (known == NOTHING_THERE), "nothing").when(bad, "failed").otherwise("good")
    rows.withColumn("_outcome", outcome).write.mode("overwrite").partitionBy("_outcome").parquet(f"{path.rstrip('/')}/{name}")
    return answers(spark, name, path).where("_outcome = 'good'").drop("_status", "_error", "_corrupt", "_outcome")


def answers(spark: SparkSession, name: str, path: str) -> DataFrame:
    """All rows of a snapshot that has been taken in, with their outcome."""
    return spark.read.schema(SCHEMAS[name] + _END + ", _outcome string").parquet(f"{path.rstrip('/')}/{name}")


def failed_answers(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """What to ask again, of all snapshots taken in: snapshot, key (of a broken line as far as it can be read), status, error, answer."""
    out = None
    for name in names:
        key = SCHEMAS[name].partition(" ")[0]
        rows = answers(spark, name, path).where("_outcome = 'failed'")
        said = F.nullif(F.regexp_extract("_corrupt", rf'"{key}"\s*:\s*"([^"]*)"', 1), F.lit(""))
        one = rows.select(F.lit(name).alias("snapshot"), F.coalesce(key, said).alias("key"), F.col("_status").alias("status"), F.coalesce("_error", F.when(F.col("_corrupt").isNotNull(), "not readable")).alias("error"), F.col("_corrupt").alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "snapshot string, key string, status string, error string, answer string")


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """``{"genes": [...]}`` -> gene_symbol, a row per distinct symbol."""
    genes = spark.read.schema("genes array<string>").json(path, multiLine=True).select(F.explode("genes").alias("gene_symbol"))
    return genes.dropDuplicates(["gene_symbol"])


def na_normalize(df: DataFrame) -> DataFrame:
    """Null in place of the strings that a CSV round trip loses."""
    return df.select([sentinel_null(c, EMPTY_MARKS).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_stage_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return na_normalize(spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"'))


def read_sequences(spark: SparkSession, glob: str) -> DataFrame:
    """FASTA files -> accession (the file's name), sequence."""
    files = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("uniprot"), "value")
    return files.select("uniprot", F.regexp_replace(F.regexp_replace("value", r"(?m)^>.*$", ""), r"\s+", "").alias("sequence"))


def read_confidence(spark: SparkSession, glob: str, residues: bool = False) -> DataFrame:
    """Structure text -> accession, mean confidence over ATOM records (or one per residue), and low-confidence records.

    Columns 61 to 66 hold the value; the mean is over records unless ``residues`` asks for CA atoms alone.
    """
    lines = spark.read.text(glob).select(F.regexp_extract(F.input_file_name(), r"AF-([A-Z0-9]+)-", 1).alias("uniprot"), "value").where(F.col("value").startswith("ATOM"))
    if residues:
        lines = lines.where(F.trim(F.substring("value", 13, 4)) == "CA")
    score = F.trim(F.substring("value", 61, 6)).try_cast("double")
    return lines.groupBy("uniprot").agg(F.avg(score).alias("mean_plddt"), F.count_if(score < 50).alias("n_low"), F.count(score).alias("n_records"))


def structure_files(spark: SparkSession, *folders: str) -> DataFrame:
    """The structure files in the folders -> structure, path: by the accession in a predicted structure's name, else by the
    name before ``.pdb``. Only names are read, no contents. Of several files of one structure the last path stays."""
    names = None
    for folder in folders:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdb").load(folder).select("path")
        names = found if names is None else names.union(found)
    stem = F.regexp_extract("path", r"([^/]+)\.pdb$", 1)
    accession = F.regexp_extract("path", r"AF-([A-Z0-9]+)-[^/]*$", 1)
    return names.groupBy(F.coalesce(F.nullif(accession, F.lit("")), stem).alias("structure")).agg(F.max("path").alias("path"))


def still_missing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The structures (column structure) with no file yet: what is left to fetch, however often that is asked."""
    return wanted.where("structure IS NOT NULL").dropDuplicates(["structure"]).join(files, "structure", "left_anti")


def read_pockets(spark: SparkSession, glob: str) -> DataFrame:
    """Pocket information text -> path, pocket_id and its numbers; a number that isn't plain digits is null."""
    text = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return pocket_sections(text)


def pocket_sections(text: DataFrame) -> DataFrame:
    parts = text.select("path", F.posexplode(F.slice(F.split("value", r"Pocket\s+\d+\s*:"), 2, 1_000_000)).alias("i", "section"), F.regexp_extract_all("value", F.lit(r"Pocket\s+(\d+)\s*:"), 1).alias("ids"))
    number = lambda label: F.regexp_extract("section", rf"(?im)^\s*{label}\s*:\s*([\d.]+)", 1).try_cast("double")
    return parts.select(
        "path", F.get("ids", F.col("i")).cast("int").alias("pocket_id"), number("Score").alias("score"), number("Druggability Score").alias("druggability"), number("Volume").alias("volume"),
        number("Hydrophobicity score").alias("hydrophobicity"), number("Polarity score").alias("polarity"), number("Number of Alpha Spheres").cast("int").alias("alpha_spheres"),
    )


def pocket_census(paths: DataFrame) -> DataFrame:
    """Pocket files (path) -> gene, structures, pockets and their ratio."""
    part = lambda p: F.regexp_extract("path", p, 1)
    files = paths.select(part(r"binding_pockets/([^/]+)/").alias("gene"), part(r"/([^/]+)_out/").alias("structure"), part(r"pocket(\d+)_atm\.pdb$").try_cast("int").alias("pocket"))
    by = files.where("gene <> ''").groupBy("gene").agg(F.count_distinct("structure").alias("Step6_PDB_Structures"), F.count("pocket").alias("Step6_Total_Pockets"))
    return by.withColumn("Step6_Avg_Pockets_Per_Structure", F.when(F.col("Step6_PDB_Structures") > 0, F.round(F.col("Step6_Total_Pockets") / F.col("Step6_PDB_Structures"), 2)).otherwise(0.0))
