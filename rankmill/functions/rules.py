"""Words, codes, weights, bounds and labels that results depend on. Nothing here is computed."""

# Tissue categories: the first whose pattern occurs in a tissue's name.
TISSUES = {
    "Brain": ("Brain_",),
    "Blood": ("Whole_Blood",),
    "Vascular": ("Artery_", "Heart_"),
    "Immune": ("Spleen", "Lymph"),
    "Gastrointestinal": ("Stomach", "Colon", "Esophagus", "Small_Intestine", "Liver", "Pancreas"),
    "Reproductive": ("Testis", "Ovary", "Uterus", "Prostate", "Vagina", "Breast"),
    "Kidney": ("Kidney",),
    "Lung": ("Lung",),
    "Skin": ("Skin",),
    "Muscle": ("Muscle",),
    "Adipose": ("Adipose",),
    "Nerve": ("Nerve",),
}

# Families in order: keywords, substrings of the protein's text, and its InterPro and Pfam ids.
FAMILIES = {
    "GPCR": {"keywords": ["g-protein coupled receptor", "gpcr", "7tm", "seven transmembrane", "rhodopsin", "secretin receptor", "metabotropic glutamate", "frizzled", "smoothened", "olfactory receptor"], "ids": ["IPR000276", "IPR017452", "IPR000832", "IPR001879", "PF00001", "PF00002", "PF00003"]},
    "Kinase": {"keywords": ["kinase", "phosphotransferase", "protein kinase", "tyrosine kinase", "serine/threonine kinase", "receptor tyrosine kinase", "mapk", "cdk"], "ids": ["IPR000719", "IPR011009", "IPR017441", "IPR008271", "IPR020635", "PF00069", "PF07714"]},
    "Ion Channel": {"keywords": ["ion channel", "voltage-gated", "ligand-gated", "potassium channel", "sodium channel", "calcium channel", "chloride channel", "transient receptor potential", "trp channel", "aquaporin", "ionotropic receptor", "nicotinic receptor"], "ids": ["IPR005821", "IPR006029", "IPR006078", "IPR001622", "IPR002394", "PF00520", "PF00027", "PF00060"]},
    "Nuclear Receptor": {"keywords": ["nuclear receptor", "nuclear hormone receptor", "steroid receptor", "thyroid hormone receptor", "retinoic acid receptor", "peroxisome proliferator", "estrogen receptor", "androgen receptor", "glucocorticoid receptor"], "ids": ["IPR001628", "IPR008946", "IPR000536", "PF00104", "PF00105"]},
    "Protease": {"keywords": ["protease", "peptidase", "proteinase", "metalloprotease", "serine protease", "cysteine protease", "aspartic protease", "threonine protease", "matrix metalloproteinase", "mmp", "cathepsin", "caspase", "thrombin", "factor xa"], "ids": ["IPR001254", "IPR001969", "IPR001563", "IPR015500", "IPR029058", "PF00089", "PF00413", "PF00082", "PF00112"]},
    "Phosphatase": {"keywords": ["phosphatase", "protein phosphatase", "tyrosine phosphatase", "serine/threonine phosphatase", "dual specificity phosphatase", "ptp", "protein tyrosine phosphatase"], "ids": ["IPR000340", "IPR016130", "IPR000387", "IPR029021", "PF00102", "PF00481"]},
    "Transporter": {"keywords": ["transporter", "solute carrier", "abc transporter", "sodium-dependent", "glucose transporter", "amino acid transporter", "neurotransmitter transporter", "drug transporter"], "ids": ["IPR011527", "IPR001757", "IPR003439", "IPR001066", "PF00005", "PF00664"]},
    "E3 Ubiquitin Ligase": {"keywords": ["e3 ubiquitin ligase", "ubiquitin ligase", "ring finger", "hect domain", "cullin", "f-box", "scf complex", "proteasome", "ubiquitination", "protein degradation"], "ids": ["IPR001841", "IPR013083", "IPR003613", "IPR001810", "IPR019474", "PF00097", "PF12678", "PF00646", "PF13639"]},
    "Deubiquitinase": {"keywords": ["deubiquitinase", "deubiquitinating enzyme", "dub", "ubiquitin-specific protease", "usp", "ubiquitin thioesterase", "ubiquitin carboxyl-terminal hydrolase"], "ids": ["IPR001394", "IPR028889", "IPR018200", "PF00443", "PF02338"]},
    "Histone Methyltransferase": {"keywords": ["histone methyltransferase", "histone-lysine methyltransferase", "set domain", "hmt", "lysine methyltransferase", "dot1"], "ids": ["IPR001214", "IPR003616", "IPR013128", "PF00856"]},
    "Histone Demethylase": {"keywords": ["histone demethylase", "lysine demethylase", "kdm", "jmjc domain", "jumonji"], "ids": ["IPR003347", "IPR013129", "PF02373"]},
    "Histone Acetyltransferase": {"keywords": ["histone acetyltransferase", "hat", "acetyltransferase", "lysine acetyltransferase", "kat", "gcn5", "pcaf"], "ids": ["IPR000182", "IPR016181", "PF00583"]},
    "Histone Deacetylase": {"keywords": ["histone deacetylase", "hdac", "deacetylase", "sirtuin", "class i hdac", "class ii hdac"], "ids": ["IPR000286", "IPR003000", "PF00850"]},
    "Bromodomain Protein": {"keywords": ["bromodomain", "bet protein", "brd2", "brd3", "brd4", "acetyl-lysine binding", "chromatin reader"], "ids": ["IPR001487", "PF00439"]},
    "Chromodomain Protein": {"keywords": ["chromodomain", "heterochromatin protein", "hp1", "methyl-lysine binding", "chromatin reader"], "ids": ["IPR000953", "PF00385"]},
    "DNA Methyltransferase": {"keywords": ["dna methyltransferase", "dnmt", "cytosine methyltransferase", "dna methylation"], "ids": ["IPR001525", "IPR018117", "PF00145"]},
    "Tubulin": {"keywords": ["tubulin", "alpha-tubulin", "beta-tubulin", "microtubule", "gamma-tubulin"], "ids": ["IPR000217", "IPR003008", "PF00091", "PF03953"]},
    "Actin": {"keywords": ["actin", "alpha-actin", "beta-actin", "gamma-actin", "cytoskeletal protein", "microfilament"], "ids": ["IPR004000", "PF00022"]},
    "Motor Protein": {"keywords": ["kinesin", "dynein", "myosin", "motor protein", "microtubule motor", "molecular motor"], "ids": ["IPR001752", "IPR027417", "IPR001609", "PF00225", "PF00063"]},
    "Immune Checkpoint": {"keywords": ["pd-1", "pd-l1", "ctla-4", "cd274", "pdcd1", "lag-3", "tim-3", "b7", "immune checkpoint", "programmed death", "cytotoxic t-lymphocyte"], "ids": ["IPR003599", "IPR013783", "PF00047"]},
    "Cytokine Receptor": {"keywords": ["cytokine receptor", "interleukin receptor", "interferon receptor", "tnf receptor", "chemokine receptor", "colony stimulating factor receptor"], "ids": ["IPR003531", "IPR001859", "IPR003033", "PF00019", "PF01030"]},
    "T-cell Receptor": {"keywords": ["t-cell receptor", "tcr", "t cell antigen receptor", "cd3", "cd4", "cd8"], "ids": ["IPR003599", "IPR007110", "PF00047"]},
    "Chaperone": {"keywords": ["heat shock protein", "hsp90", "hsp70", "hsp60", "chaperone", "chaperonin", "protein folding"], "ids": ["IPR001404", "IPR029047", "IPR013126", "PF00012", "PF00183"]},
    "Cyclooxygenase": {"keywords": ["cyclooxygenase", "cox-1", "cox-2", "prostaglandin", "prostaglandin-endoperoxide synthase", "ptgs"], "ids": ["IPR000898", "PF00008"]},
    "Lipid Kinase": {"keywords": ["phosphatidylinositol 3-kinase", "pi3k", "pi3-kinase", "lipid kinase", "phosphoinositide kinase"], "ids": ["IPR000403", "IPR015433", "PF00454"]},
    "GTPase": {"keywords": ["gtpase", "ras protein", "ras gtpase", "rho gtpase", "rab protein", "ran protein", "small gtpase"], "ids": ["IPR001806", "IPR005225", "IPR027417", "PF00071"]},
    "Integrin": {"keywords": ["integrin", "cell adhesion", "extracellular matrix receptor", "integrin alpha", "integrin beta"], "ids": ["IPR013517", "IPR002369", "PF00357", "PF08441"]},
    "Metalloenzyme": {"keywords": ["metalloenzyme", "zinc finger", "zinc-binding", "carbonic anhydrase", "alcohol dehydrogenase"], "ids": ["IPR001353", "IPR013149", "IPR013154", "PF00107", "PF00096"]},
    "Transcription Factor": {"keywords": ["transcription factor", "dna-binding", "helix-turn-helix", "zinc finger transcription", "homeobox", "leucine zipper"], "ids": ["IPR001356", "IPR009057", "IPR017970", "PF00010", "PF00046"]},
    "Oxidoreductase": {"keywords": ["oxidoreductase", "dehydrogenase", "oxidase", "reductase", "peroxidase", "monooxygenase", "dioxygenase"], "ids": ["IPR016040", "IPR001327"]},
    "Transferase": {"keywords": ["transferase", "methyltransferase", "glycosyltransferase", "acyltransferase", "aminotransferase"], "ids": ["IPR016461"]},
    "Hydrolase": {"keywords": ["hydrolase", "esterase", "lipase", "amidase", "glycosidase", "nuclease"], "ids": []},
    "Lyase": {"keywords": ["lyase", "decarboxylase", "aldolase", "synthase"], "ids": []},
    "Isomerase": {"keywords": ["isomerase", "racemase", "epimerase", "mutase"], "ids": []},
    "Ligase": {"keywords": ["ligase", "synthetase", "carboxylase", "dna ligase"], "ids": []},
}

# Categories of terms that are pathways.
PATHWAYS = ("KEGG", "Reactome", "WikiPathways")

# Partners that count as drug targets, by family.
DRUG_TARGETS = {
    "GPCRs": ("HTR1A", "HTR1B", "HTR1D", "HTR1F", "HTR2A", "HTR2C", "ADRA1A", "ADRA2A", "DRD2", "DRD3"),
    "Ion Channels": ("CACNA1A", "CACNA1C", "SCN1A", "SCN9A", "KCNMA1", "KCNK18", "TRPV1", "TRPM8"),
    "Kinases": ("MAPK1", "MAPK3", "AKT1", "PRKCA", "PRKCE", "CDK1", "CDK2"),
    "Enzymes": ("NOS1", "NOS2", "NOS3", "ACE", "ACE2", "MTHFR", "COMT"),
    "Cytokines": ("TNF", "IL1B", "IL6", "IL10", "IFNG", "TGFB1"),
    "Transporters": ("SLC6A4", "SLC6A3", "ATP1A2", "ATP1A3"),
}

# Development levels: description, score, quality, status, confidence, strategy, composite score.
LEVELS = {
    "Tclin": ("Clinical - Targets with approved drugs or clinical candidates", 5, "Excellent", "Clinical stage or approved", "High - Validated Target", "Repurposing or improved drug design", 10),
    "Tchem": ("Chemical - Targets with bioactive compounds (IC50/Ki <30nM)", 4, "Very Good", "Chemical tool stage", "High - Validated Target", "Lead optimization from known compounds", 7),
    "Tbio": ("Biological - Targets with disease association but no compounds", 3, "Moderate", "Biological validation stage", "Medium - Biological Evidence", "HTS screening, probe development", 3),
    "Tdark": ("Dark - Minimal knowledge, no compounds, no disease association", 2, "Poor", "Early/undeveloped", "Low - Understudied", "Target validation required", 0),
}

# Locations in order of priority: words; then the nine outputs of ACCESS_COLUMNS.
ACCESS_COLUMNS = ("Accessibility_Score", "Location_Category", "Druggability_Tier", "Accessibility_Level", "Accessibility_Description", "Drug_Modality_Options", "Targeting_Difficulty", "Clinical_Precedent", "Druggability_Rationale")
OUTSIDE_WORDS = ("secreted", "extracellular space", "extracellular region", "cell surface", "extracellular matrix", "extracellular")
MEMBRANE_WORDS = ("membrane", "cell membrane", "plasma membrane", "receptor", "transmembrane")
DOMAIN_WORDS = ("extracellular", "outside", "external")
CYTOPLASM_WORDS = ("cytoplasm", "cytosol", "cytoplasmic")
NUCLEUS_WORDS = ("nucleus", "nuclear", "chromatin")
ORGANELLE_WORDS = ("mitochondrion", "mitochondrial", "endoplasmic reticulum", "golgi", "lysosome", "peroxisome", "endosome")
ORGANELLES = (("mitochondr", "Mitochondrial"), ("endoplasmic", "Endoplasmic Reticulum"), ("golgi", "Golgi Apparatus"), ("lysosom", "Lysosomal"))
ACCESS = {
    "outside": (4, "Extracellular/Secreted", "Tier 1 - High", "Excellent", "Direct access via bloodstream - no barrier crossing required", "Small molecule; Antibody; Peptide; Protein therapeutic", "Easy", "High - many approved drugs", "Extracellular targets are highly accessible and have numerous successful examples"),
    "membrane_domain": (3, "Membrane (Extracellular Domain)", "Tier 1 - High", "Very Good", "Extracellular domain accessible from bloodstream", "Small molecule; Antibody (for extracellular epitopes)", "Easy-Moderate", "High - GPCRs, RTKs, ion channels", "Membrane proteins with extracellular domains are prime drug targets"),
    "membrane": (3, "Membrane (Intramembrane/Intracellular)", "Tier 2 - Medium-High", "Good", "Embedded in membrane - requires lipophilic drugs", "Small molecule (membrane permeable)", "Moderate", "Moderate - some ion channels, transporters", "Intramembrane targets accessible but require specific drug properties"),
    "cytoplasm": (2, "Cytoplasmic", "Tier 3 - Medium", "Moderate", "Intracellular - drug must cross plasma membrane", "Small molecule (cell permeable); RNA therapeutics", "Moderate-Difficult", "Moderate - kinases, proteases", "Requires cell-permeable compounds; selectivity can be challenging"),
    "nucleus": (1, "Nuclear", "Tier 4 - Medium-Low", "Poor", "Nuclear - drug must cross plasma and nuclear membranes", "Small molecule (nuclear permeable); Oligonucleotides", "Difficult", "Low-Moderate - transcription factors, chromatin modifiers", "Requires crossing two membranes; historically challenging targets"),
    "organelle": (1, "Organellar ({})", "Tier 4 - Medium-Low", "Poor", "Organelle-specific - requires targeted delivery to {}", "Small molecule (organelle-targeted); Peptide conjugates", "Difficult", "Low - limited approved examples", "Organellar targeting remains a significant challenge"),
    "unknown": (0, "Unknown", "Unassessed", "Unknown", "Location not determined - requires experimental validation", "To be determined", "Unknown", "Unknown", "Cannot assess without location information"),
}

# Disorder propensity of amino acids; others count 0.
PROPENSITY = {"R": 1.0, "K": 1.0, "D": 1.0, "E": 1.0, "Q": 0.8, "S": 0.8, "P": 1.0, "G": 0.9, "A": 0.5, "W": -1.0, "F": -0.9, "Y": -0.9, "I": -0.8, "L": -0.8, "V": -0.8, "M": -0.7, "C": -0.6}

# The composite's weights and bounds.
SM_WEIGHTS = {"drugs": 10, "family": 6, "pocket": 5, "pharos": 2, "access": 2, "disorder": 2, "expression": 1, "network": 1}
BIO_WEIGHTS = {"bio_drugs": 8, "bio_access": 6, "pharos": 3, "expression": 2, "network": 1}
HIGH, MEDIUM = 80, 50
BIOLOGIC_TERMS = ("cytokine", "interleukin", "chemokine", "growth factor", "structural protein", "collagen", "extracellular matrix", "inflammasome", "scaffold protein", "adapter protein", "neurotrophin", "neurotrophic factor", "brain-derived", "bdnf")
SIGNAL_TERMS = ("cytokine", "growth factor", "hormone", "interleukin", "neurotroph")
BIOLOGIC_PREFIXES = ("IL", "TNF", "TSLP", "COL", "BDNF")
# Where the files of predicted structures are.
MODEL_FILES = "https://alphafold.ebi.ac.uk/files"

# Kinds of families, for the roll-up; all others are "other".
FAMILY_KINDS = {
    "classic": ("GPCR", "Kinase", "Ion Channel", "Nuclear Receptor", "Protease", "Phosphatase", "Transporter"),
    "emerging": ("E3 Ubiquitin Ligase", "Deubiquitinase", "Histone Methyltransferase", "Histone Demethylase", "Histone Acetyltransferase", "Histone Deacetylase", "Bromodomain Protein", "Chromodomain Protein", "DNA Methyltransferase"),
    "immune": ("Immune Checkpoint", "Cytokine Receptor", "T-cell Receptor"),
    "structural": ("Tubulin", "Actin", "Motor Protein"),
}

# Columns of each stage's summary, the one it is sorted by, and whether the greatest come first.
SUMMARIES = {
    6: (("Step6_UniProt_ID", "Step6_Protein_Name", "Step6_Total_Pockets", "Step6_PDB_Structures", "Step6_Avg_Pockets_Per_Structure", "Step6_Subcellular_Location", "Step6_Topology", "Step6_Location_Category", "Step6_Accessibility_Score", "Step6_Accessibility_Level", "Step6_Druggability_Tier", "Step6_Drug_Modality_Options", "Step6_Targeting_Difficulty", "Step6_Clinical_Precedent", "Step6_Function"), "Step6_Accessibility_Score", True),
    7: (("Step7_Max_TPM", "Step7_Tissue_Specificity", "Step7_Tissues_With_Expression", "Step7_Top_3_Tissues", "Step7_Overall_Expression_Score", "Step7_Expression_Quality", "Step7_Expression_Summary", "Step7_Target_Validation_Feasibility"), "Step7_Overall_Expression_Score", True),
    8: (("Step8_Disorder_Percentage", "Step8_Passes_50_Percent_Rule", "Step8_Disorder_Category", "Step8_Druggability_Impact"), "Step8_Disorder_Percentage", False),
    9: (("Step9_Target_Development_Level", "Step9_Overall_Pharos_Score", "Step9_Protein_Family"), "Step9_Overall_Pharos_Score", True),
    10: (("Step10_Total_Interactions", "Step10_Drug_Target_Interactions", "Step10_Network_Connectivity", "Step10_Overall_Network_Score"), "Step10_Overall_Network_Score", True),
}

DRUGGABLE_FAMILIES = ("Kinase", "GPCR", "IC", "NR", "Enzyme")
FALSE_POSITIVES = {"BDNF": "Neurotrophin - drugs modulate levels, do not target protein directly", "MTHFR": "Polymorphism target - drugs affect pathway, not protein binding"}
ONLY_BIOLOGIC_WORDS = ("antibody", "antibodies", "mab", "umab", "immunoglobulin", "protein", "peptide")
BIOLOGIC_DRUG_WORDS = ("antibody", "protein", "peptide")

# Combinations by words in a pathway's name, and synthetic lethality by a word in the family; the first that applies.
PATHWAY_COMBINATIONS = (
    (("inflammation",), "Anti-inflammatory combination (e.g., with NSAIDs or biologics)"),
    (("serotonin",), "Serotonergic modulation combination (e.g., with triptans or SSRIs)"),
    (("calcium", "ion"), "Ion channel modulation (e.g., with calcium channel blockers)"),
)
SYNTHETIC_LETHALITY = (("GPCR", "GPCR desensitization pathway components (GRKs, arrestins)"), ("Kinase", "Synthetic lethality with phosphatase inhibitors"), ("Enzyme", "Metabolic compensation pathway targets"))

# Predictions from the score, from the literature and from both: label, confidence and, last, recommendation.
SCORE_LABELS = ((80, ("Highly Druggable", "High")), (50, ("Moderately Druggable", "Medium")))
LOW_SCORE = ("Challenging Target", "Low")
LITERATURE_LABELS = (("Strong Clinical Evidence", "High"), ("Moderate Clinical Evidence", "Medium"), ("Preliminary Evidence", "Low"))
NO_LITERATURE = ("No Direct Evidence", "Very Low")
FINAL_LABELS = (
    ("PRIORITY TARGET - High druggability with clinical validation", "Very High", "PROCEED: Initiate drug discovery program"),
    ("HIGH POTENTIAL - Excellent druggability, needs validation", "High", "VALIDATE: Confirm disease association before proceeding"),
    ("VIABLE TARGET - Moderate druggability with strong evidence", "Medium-High", "CONSIDER: Address druggability challenges"),
    ("POSSIBLE TARGET - Requires optimization", "Medium", "EXPLORE: Fragment-based or alternative approaches"),
)
LAST_LABEL = ("CHALLENGING - Alternative strategies needed", "Low", "CAUTION: Consider biologics or indirect targeting")
REASONS = (
    ("has_approved_drugs", "Approved drugs exist"),
    ("has_druggable_pocket", "Druggable binding pocket"),
    ("is_druggable_family", "Druggable protein family"),
    ("Step8_Passes_50_Percent_Rule", "Low disorder (<50%)"),
)

# What to search the literature for, after the gene's name, by what is known of it; and the lists of the protocol.
SEARCHES = (
    ("any", ("(drug OR inhibitor OR agonist OR antagonist)",)),
    ("small", ('("small molecule" OR "chemical probe" OR "tool compound")', '(IC50 OR Ki OR Kd OR "binding affinity")', '("structure activity relationship" OR SAR OR "medicinal chemistry")', '("crystal structure" OR "binding site" OR "active site")')),
    ("biologic", ('(antibody OR biologics OR "monoclonal antibody")', "(secreted OR extracellular OR membrane)", '(neutralizing OR blocking OR "antibody therapy")')),
    ("GPCR", ('(radioligand OR "binding assay" OR "functional assay")', '("G protein" OR "beta-arrestin" OR signaling)')),
    ("Kinase", ("(kinase AND (inhibitor OR selectivity))", '("kinome" OR "kinase panel" OR "off-target")')),
    ("IC", ('("ion channel" AND (blocker OR modulator))',)),
)
EVIDENCE_WITH_DRUGS = ("1. Approved drug mechanisms", "2. Clinical efficacy data", "3. Drug binding sites")
EVIDENCE_WITHOUT = ("1. Tool compound papers", "2. Proof-of-concept studies", "3. Target validation")
EXPERIMENTS_SMALL = ("Biochemical assays", "Cellular assays", "Structural biology", "In vivo validation")
EXPERIMENTS_OTHER = ("Antibody generation", "Functional assays", "Characterization", "In vivo validation")
RED_FLAGS = ("Target validity issues", "Druggability concerns", "Safety concerns")
MARKERS_SMALL = ("Tool compounds with IC50 < 1 micro M", "Co-crystal structures", "Multiple chemical scaffolds", "Patent literature")
MARKERS_OTHER = ("Secreted or extracellular", "Neutralizing antibodies", "Epitope mapping", "Antibody therapies")
CHECKLIST = ("Tool compounds found", "Binding site characterized", "Target validated", "Clinical precedent", "Safety assessed")

# Strings that stand for nothing after a round trip through CSV.
EMPTY_MARKS = ("", "N/A", "NA", "NaN", "nan", "null", "None", "n/a", "NULL", "<NA>", "#N/A")
