"""Names and orders that results depend on."""

# Class labels, in order.
CLASSES = ["DENV1", "DENV2", "DENV3", "DENV4"]
UNKNOWN = "Unknown"

# Placeholders that mean "missing" (compared in lower case).
MISSING_WORDS = ["", "unknown", "nan", "un", "not found", "none"]

# Country aliases.
COUNTRY_ALIASES = {"DRC": "Democratic Republic of the Congo"}

# Placeholders of the slash-separated source.
SLASH_PLACEHOLDERS = ["", "un", "unknown", "na", "n/a"]

# Country names searched in free text, in order of priority.
COUNTRY_KEYWORDS = [
    "dominican republic", "united states", "french guiana", "new caledonia",
    "french polynesia", "saudi arabia", "cote d'ivoire", "puerto rico",
    "sri lanka", "bangladesh", "bolivia", "india", "china", "brazil",
    "thailand", "vietnam", "indonesia", "mexico", "colombia", "peru", "ghana",
    "angola", "japan", "taiwan", "nepal", "malaysia", "singapore", "usa",
    "france", "germany", "italy", "spain", "guadeloupe", "martinique",
    "djibouti", "eritrea", "somalia", "niger", "seychelles", "uruguay",
    "venezuela", "argentina", "panama", "cambodia",
]

# Time binning and splits.
CUTOFF_YEAR = 2006
BIN_YEARS = 5
VALIDATION_SHARE = 0.10
SEED = 42
FOLDS = 5
YEAR_BINS = ["<2000", "2000-2009", "2010-2019", "2020+"]

# Regions of the position axis, in order.
REGIONS = ["5'UTR", "C", "prM", "E", "NS1", "NS2A", "NS2B", "NS3", "NS4A", "2K",
           "NS4B", "NS5", "3'UTR"]

# Feature types that count as peptides.
PEPTIDE_TYPES = ["mat_peptide", "mature_protein", "peptide"]

# Product name (lower case, '-' as space) and its region, in the
# order in which partial matches are tried.
PRODUCT_REGIONS = [
    ("anchored capsid protein ancc", "C"),
    ("capsid protein c", "C"),
    ("capsid protein", "C"),
    ("membrane glycoprotein precursor prm", "prM"),
    ("premembrane protein prm", "prM"),
    ("premembrane protein", "prM"),
    ("pre membrane protein", "prM"),
    ("membrane glycoprotein precursor", "prM"),
    ("envelope protein e", "E"),
    ("envelope protein", "E"),
    ("envelope glycoprotein", "E"),
    ("nonstructural protein ns1", "NS1"),
    ("non structural protein ns1", "NS1"),
    ("ns1", "NS1"),
    ("nonstructural protein ns2a", "NS2A"),
    ("non structural protein ns2a", "NS2A"),
    ("ns2a", "NS2A"),
    ("nonstructural protein ns2b", "NS2B"),
    ("non structural protein ns2b", "NS2B"),
    ("ns2b", "NS2B"),
    ("nonstructural protein ns3", "NS3"),
    ("non structural protein ns3", "NS3"),
    ("helicase protease ns3", "NS3"),
    ("ns3", "NS3"),
    ("nonstructural protein ns4a", "NS4A"),
    ("non structural protein ns4a", "NS4A"),
    ("ns4a", "NS4A"),
    ("protein 2k", "2K"),
    ("2k peptide", "2K"),
    ("2k", "2K"),
    ("nonstructural protein ns4b", "NS4B"),
    ("non structural protein ns4b", "NS4B"),
    ("ns4b", "NS4B"),
    ("rna dependent rna polymerase ns5", "NS5"),
    ("rna directed rna polymerase ns5", "NS5"),
    ("nonstructural protein ns5", "NS5"),
    ("non structural protein ns5", "NS5"),
    ("ns5", "NS5"),
]

# Region and its standard product name.
REGION_PRODUCTS = {
    "C": "anchored capsid protein ancC",
    "prM": "membrane glycoprotein precursor prM",
    "E": "envelope protein E",
    "NS1": "nonstructural protein NS1",
    "NS2A": "nonstructural protein NS2A",
    "NS2B": "nonstructural protein NS2B",
    "NS3": "nonstructural protein NS3",
    "NS4A": "nonstructural protein NS4A",
    "2K": "protein 2K",
    "NS4B": "nonstructural protein NS4B",
    "NS5": "RNA-dependent RNA polymerase NS5",
}

# Defaults for untranslated ends missing from a coordinate table.
FIVE_PRIME_DEFAULT = (0, 78)
NS5_END_DEFAULT = 10255
GENOME_END = 11195

# Symbol sets.
BASES = ["A", "C", "G", "T"]
AMBIGUITY_CODES = "RYWSKMBDHV"
GAP_SYMBOLS = "-."

# Minimum share of the expected region length.
MIN_REGION_SHARE = 0.65
# Most pairs compared per group in sampled pairwise identity.
MAX_PAIRS = 25000
PAIR_SEED = 13
