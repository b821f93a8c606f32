"""Word lists and limits that define results. All values below are fixed values."""

# ---- Fixed values: word lists -------------------------------------------------------------
STOP = "a an and are as at be by for from had has have i in is it its of on or our that the their them these they this those to was we were with you".split()
AUXILIARY = "am are be been being can could did do does had has have is may might must shall should was were will would".split()
SUBORDINATE = "because how that whether which who whom whose why".split()
DISCOURSE = (
    "actually according additionally also anyway but compared consequently conversely even finally furthermore hence here however instead lastly "
    "meanwhile moreover nevertheless nonetheless notably only otherwise rather similarly since so still then there therefore though thus ultimately well what yet"
).split()
LEADING_FILLER = "the a an this that these those".split()
LEADING_DISCOURSE = [
    "according", "according to", "actually", "additionally", "also", "anyway", "as", "as shown", "basically", "but", "compared", "consequently", "conversely",
    "currently", "even", "finally", "first", "furthermore", "hence", "here", "however", "instead", "lastly", "learn", "meanwhile", "moreover", "nearly",
    "nevertheless", "nonetheless", "notably", "only", "otherwise", "rather", "recently", "second", "similarly", "since", "so", "still", "then", "there",
    "therefore", "though", "thus", "today", "tomorrow", "tonight", "ultimately", "well", "what", "yesterday", "yet",
]
TRAILING_DISCOURSE = "currently here recently there today tomorrow tonight yesterday".split()
TITLE_WORDS = "part chapter section".split()
TITLE_NUMBERS = "one two three four five six seven eight nine ten".split()
GENERIC = "he her hers him his it its me mine my one our ours she someone something that their theirs they this you your yours we what which who whom whose".split()
WEAK = (
    "about all abstract article close click data definition evidence fact facts figure finding findings good introduction issue learn lot many more most new now "
    "only overview page part question reason report research result results section some solution study such summary ten thing things three two view views what "
    "four five six seven eight nine"
).split()
REJECT_STARTS = "how what when where whether why".split()
TEMPORAL = "currently recently today tomorrow tonight yesterday".split()
LINKING_TOKENS = "am are be became become becomes had has have is was were will".split()
LINKING_PHRASES = ["is", "are", "was", "were", "become", "becomes", "became", "has", "have", "had", "will have", "will be"]
AMOUNT_LABELS = ["amount", "are amount", "be amount", "had amount", "has amount", "have amount", "is amount", "was amount", "were amount", "will have amount"]
AMOUNT_UNITS = ["%", "percent", "dollars?", "euros?", "pounds?", "million", "billion", "thousand"]
MONTHS = [
    "Jan(?:uary)?", "Feb(?:ruary)?", "Mar(?:ch)?", "Apr(?:il)?", "May", "Jun(?:e)?", "Jul(?:y)?", "Aug(?:ust)?", "Sep(?:tember)?", "Oct(?:ober)?",
    "Nov(?:ember)?", "Dec(?:ember)?",
]
YEAR = r"(?:18|19|20|21)\d{2}"
CLAUSE_COORDINATORS = "and or but so while whereas although though".split()
RELATION_STOP = "and are but for from has have into not that the this was were with".split()
SUBJECT_PREFIXES = ["according to", "in", "on", "at", "during", "after", "before", "because", "that", "when", "where", "while", "although", "though", "whereas"]
NAVIGATION = ["click here", "learn more", "read more", "see more", "view more"]
TRAILING_NOISE = ["according to", "click here", "learn more", "read more", "see more", "source:", "view more", "via"]
CONTRACTION_BASES = "i you he she it we they there that this what who where when why how".split()
CONTRACTION_ENDS = "m re ve ll d s".split()
MODIFIER_CUES = [
    "about", "above", "according to", "across", "after", "against", "along", "although", "among", "around", "as of", "at", "based on", "because", "because of",
    "before", "below", "between", "by", "despite", "during", "for", "from", "in", "including", "inside", "into", "near", "of", "on", "over", "per", "through",
    "to", "under", "using", "via", "where", "whereas", "when", "while", "with", "within", "without",
]
PARTICIPIAL_CUES = (
    "about across after against along among around at before behind below beneath beside between beyond by inside into near of on over past through to toward under within"
).split()
NEGATIONS = [
    "no", "none", "neither", "not", "never", "cannot", "can't", "won't", "isn't", "aren't", "wasn't", "weren't", "doesn't", "don't", "didn't", "hasn't",
    "haven't", "hadn't", "failed to", "fails to", "unable to", "lack", "lacks", "lacked", "lacking", "absence", "absent", "deny", "denies", "denied", "denying",
    "reject", "rejects", "rejected", "rejecting", "exclude", "excludes", "excluded", "excluding", "preclude", "precludes", "precluded", "precluding", "prevent",
    "prevents", "prevented", "preventing", "false", "unsupported", "unproven", "insufficient", "inadequate", "invalid", "impossible", "unlikely", "unavailable",
]
NOT_NEGATING = ["not only", "not just", "not merely", "not simply"]
SCOPE_BREAKS = "but however although though whereas while except unless".split()
NEGATIVE_RELATIONS = (
    "lack lacks lacked lacking deny denies denied denying reject rejects rejected rejecting exclude excludes excluded excluding preclude precludes precluded "
    "precluding prevent prevents prevented preventing fail fails failed failing"
).split()
LINKING_NEGATIONS = ["am", "are", "be", "became", "become", "becomes", "had", "has", "have", "is", "was", "were", "will be", "will have"]
NEGATION_PROTOTYPES = "not absence lack denial failure unable excluded prevented".split()
NEGATION_PREFIXES = "un non anti dis in im ir il".split()
NEGATION_SUFFIXES = ["less"]
NEGATION_TERMS = "false unsupported unproven insufficient inadequate invalid impossible unlikely unavailable".split()
QUANTIFIER_EXCLUSIONS = ["all time", "one time"]
CORE_QUANTIFIERS = "all some many most several few one none both either".split()
QUANTIFIERS = [
    ("none", ["no", "none", "neither", "zero", "none of", "neither of"]),
    ("some", ["not all", "at least one", "one or more", "any of", "any", "some", "some of"]),
    ("all", ["all", "every", "each", "all of", "each of", "entire", "whole"]),
    ("both", ["both", "both of"]),
    ("most", ["most", "most of", "majority of", "a majority of", "almost all", "nearly all", "more than half", "over half"]),
    ("many", ["many", "many of", "numerous", "multiple", "various", "a lot of", "lots of"]),
    ("several", ["several", "several of"]),
    ("few", ["few", "a few", "few of", "minority of", "a minority of", "less than half", "fewer than half", "under half"]),
    ("either", ["either", "either of"]),
    ("one", ["one", "1", "a single", "single", "exactly one"]),
]
PERCENT_QUALIFIERS = ["more than", "over", "above", "less than", "under", "below", "about", "around", "approximately", "nearly"]
TRAILING_MODALS = "do does did can could may might must should would will".split()
FUTURE_CUES = ["will", "shall", "going to"]
PAST_CUES = ["was", "were", "had", "did"]
STRONG_SUFFIXES = "ed ing izes ises ates ifies".split()
DERIVED_SUFFIXES = "ize ise ate ify".split()
NOT_PLURAL_SUFFIXES = "ics ness ous ss".split()
DERIVATIONAL = "ability ibility able ible ness".split()
TEMPLATE_HEADINGS = [
    "abstract", "analysis", "background", "conclusion", "concrete details", "concrete details continued", "discussion", "evidence", "findings", "introduction",
    "limitations", "relationship evidence", "supporting evidence", "the relationship between target a and target b",
]
PIPELINE_WORDS = [
    ("provided chain", "cited facts"), ("provided chains", "cited facts"), ("argument chain", "relationship"), ("argument chains", "relationships"),
    ("evidence block", "cited facts"), ("evidence blocks", "cited facts"), ("payload", "claim"), ("record", "source detail"), ("extracted graph", "cited facts"),
]
TARGET_QUERIES = ["{}", "{} facts", "{} dates amounts", "{} statistics figures", "{} history", "{} causes effects", "{} recent evidence", "{} policy research"]
BRIDGE_QUERIES = ["{a} {b}", "{a} and {b}", "{a} relationship to {b}", "{a} impact on {b}", "{a} evidence {b}", "{a} causes {b}", "{a} effects on {b}", "{a} data statistics {b}"]

# ---- Fixed values: limits -----------------------------------------------------------------
LIMITS = {
    "queries": 5, "blocks": 16, "min_block_chars": 80, "max_block_chars": 2400, "sentences": 96, "clauses": 180, "claims": 512, "label_chars": 72,
    "label_tokens": 8, "clause_chars": 360, "parts": 4, "expansions": 8, "negation_chars": 72, "candidates": 96, "context": 24, "notes": 40, "grounding": 18,
    "hops": 12, "chain_steps": 20, "pairs": 4, "arguments": 3, "path_records": 6,
}
MERGE_LOW, MERGE_HIGH, MATCH, DIVERSITY, DUP_OVERLAP, DUP_JACCARD, SEMANTIC_NEGATION = 0.84, 0.97, 0.34, 0.72, 0.72, 0.60, 0.74
SEED_SCALE, SEED_JITTER, PARENT_PULL = 420.0, 60.0, 0.15


def phrases(values: list[str]) -> str:
    """An alternation of phrases, longest first, blanks as any white space."""
    ordered = sorted(values, key=len, reverse=True)
    return "|".join(v.replace(" ", r"\s+") for v in ordered)


TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"
TARGET_TOKEN = r"[a-z0-9]+"
NUMBER = rf"[$€£]?\b\d[\d,]*(?:\.\d+)?(?:\s?(?:{'|'.join(AMOUNT_UNITS)}))?"
DATE = rf"\bQ[1-4]\s+{YEAR}\b|\b(?:{'|'.join(MONTHS)})(?:\s+\d{{1,2}})?(?:,\s*)?\s+{YEAR}\b|\b{YEAR}\b"
CONCRETE = r"(?i)(\$|%|\b\d[\d,./:-]*\b|\b(?:million|billion|trillion|percent|dollars?|median|rent|price|cost|income)\b)"
