"""Default dictionaries, patterns and constants.

Every operator takes these as arguments, so a deployment can pass its own.

FIXED VALUES: everything in this module down to the "own values" line must stay
as it is, because the results depend on each entry and on the order of entries.
"""

# Symbol -> letter, for the leet step.
LEET_MAP = {
    "@": "a", "4": "a", "^": "a",
    "8": "b",
    "(": "c", "<": "c", "{": "c",
    "3": "e", "€": "e",
    "6": "g", "9": "g",
    "#": "h",
    "!": "i", "1": "i", "|": "i",
    "7": "t", "+": "t",
    "0": "o",
    "5": "s", "$": "s",
    "v": "v",
    "2": "z",
    "*": "",
}

# Look-alike letter -> Latin.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "В": "B", "Н": "H", "К": "K",
    "М": "M", "Т": "T", "і": "i",
    "α": "a", "ε": "e", "ο": "o", "ι": "i", "κ": "k",
    "ℓ": "l", "℮": "e", "ⅰ": "i", "ⅱ": "ii",
}

# (pattern, canonical word); matched without regard to case, in this order.
SLUR_PATTERNS = [
    (r"\bf+[\W_]*[uv]+[\W_]*[ck]+[\W_]*[ckieyng]*\b", "fuck"),
    (r"\bf+[\W_]*[a@4]+[\W_]*[gq]+[\W_]*[gq]*[\W_]*[oeiy]*[t]*\b", "faggot"),
    (r"\bs+[\W_]*h+[\W_]*[i!1]+[\W_]*t+\b", "shit"),
    (r"\bb+[\W_]*[i!1]+[\W_]*t+[\W_]*[c(]+[\W_]*h+\b", "bitch"),
    (r"\bb+[\W_]*[i!1]+[\W_]*t+[\W_]*v+[\W_]*h*\b", "bitch"),
    (r"\b[a@4]+[\W_]*[s$5]+[\W_]*[s$5]+[\W_]*h+[\W_]*[o0]+[\W_]*l+[\W_]*[e3]*\b", "asshole"),
    (r"\bn+[\W_]*[i!1]+[\W_]*[gq9]+[\W_]*[gq9]+[\W_]*[e3a@]+[\W_]*[r]*\b", "nigger"),
    (r"\bd+[\W_]*[i!1]+[\W_]*[ck]+[\W_]*[ck]*\b", "dick"),
    (r"\br+[\W_]*[e3]+[\W_]*t+[\W_]*[a@4]+[\W_]*r+[\W_]*d+\b", "retard"),
    (r"\bc+[\W_]*[u]+[\W_]*n+[\W_]*t+\b", "cunt"),
    (r"\bk+[\W_]*[i!1]+[\W_]*l+[\W_]*l+\b", "kill"),
    (r"\bd+[\W_]*[i!1]+[\W_]*[e3]+\b", "die"),
    (r"\b[i!1]+[\W_]*d+[\W_]*[i!1]+[\W_]*[o0]+[\W_]*t+\b", "idiot"),
    (r"\bs+[\W_]*t+[\W_]*[u]+[\W_]*p+[\W_]*[i!1]+[\W_]*d+\b", "stupid"),
    (r"\bw+[\W_]*h+[\W_]*[o0]+[\W_]*r+[\W_]*[e3]+\b", "whore"),
]

# (pattern, canonical word) for letters in the wrong order.
TRANSPOSITION_PATTERNS = [
    (r"\bf+c+u+k+(?:e[dr]s?|i+n+g+|s)?\b", "fuck"),
    (r"\bf+u+k+c+(?:e[dr]s?|i+n+g+|s)?\b", "fuck"),
    (r"\bf+k+u+c+(?:e[dr]s?|i+n+g+|s)?\b", "fuck"),
    (r"\bf+c+k+u*(?:e[dr]s?|i+n+g+|s)?\b", "fuck"),
    (r"\bs+i+h+t+(?:s|t+y)?\b", "shit"),
    (r"\bs+t+i+h+\b", "shit"),
    (r"\bh+s+i+t+\b", "shit"),
    (r"\bb+t+i+c+h+\b", "bitch"),
    (r"\bb+i+t+h+c+\b", "bitch"),
    (r"\bb+c+i+t+h+\b", "bitch"),
    (r"\bb+i+h+t+c+\b", "bitch"),
    (r"\bd+c+i+k+\b", "dick"),
    (r"\bd+i+k+c+\b", "dick"),
    (r"\bc+u+t+n+\b", "cunt"),
    (r"\bc+n+t+u+\b", "cunt"),
    (r"\bc+n+u+t+\b", "cunt"),
    (r"\ba+s+h+o+l+e*\b", "asshole"),
]

# Lexicon for the anagram and near-word steps; the order decides between candidates.
TOXIC_WORDS = [
    "fuck", "shit", "bitch", "dick", "cunt", "cock",
    "damn", "hell", "slut", "whore", "ass", "twat",
    "piss", "crap", "tits", "nigg",
]

# Plain English words the anagram and near-word steps leave alone.
SAFE_WORDS = """
    this hits hist hiss tips spit pits snit tins unit units diet edit tide
    tied side dime amid maid said laid disc kids kiss miss skit kits sink
    skin inks link silk milk risk fish wish dish chip chit itch rich kick
    lick nick pick sick tick wick duck luck much such tuck cups puns spun
    stun nuts cuts gust must rust dust just bust snug slug plug drug thus
    shut huts tush gush push bush rush lush mush husk dusk task mask cast
    mast last past fast vast salt malt halt cult hull
    the and for are but not you all can had her was one our out day get has
    him his how its may new now old see way who did let say she too use
""".split()

# Characters trimmed from both ends of a word before it is compared.
WORD_TRIM = ".,!?;:'\"()[]{}"

# Text-model label -> company policy, and the two fallbacks.
POLICIES = {
    "toxic": "🚨 HR Harassment Policy Violated",
    "hate": "🚨 Diversity Hate Speech Policy",
    "sexual": "🚨 Sexual Harassment Policy",
    "threat": "🚨 Workplace Safety Threat",
}
DEFAULT_POLICY = "ℹ️ Review Required"
DEFAULT_ADVICE = "Monitor"
EMPTY_REASON = "Comment cannot be empty."

# Blend weights and thresholds (all comparisons are strict).
ML_WEIGHT, TEXT_WEIGHT = 0.3, 0.7
TOXIC_ABOVE, HIGH_ABOVE, MEDIUM_ABOVE = 0.5, 0.7, 0.3

# Label columns of the training file beside "toxic".
EXTRA_LABELS = ["severe_toxic", "obscene", "threat", "insult", "identity_hate"]
EMPTY_TEXT = "empty comment"

# Whole fields a CSV reader takes as missing: at the first read (raw text) and
# at the second (text already lower-cased).
RAW_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
LOWER_NA = ["", "-nan", "n/a", "nan", "null"]

# Sizes: training sample, vocabulary, least document frequency, audit page.
SAMPLE_ROWS, SEED = 25_000, 42
VOCABULARY_SIZE, MIN_DF = 5_000, 3
VALIDATION_SHARE = 0.2
RECENT_ROWS = 50
PII_ENTITIES = ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN"]

# ---------------------------------------------------------------- own values

# Recognizers for the pattern-shaped entities, most specific first, for
# java.util.regex. The part before the @ is taken as a whole or not at all, so
# that a long run of its characters is read once.
PII_PATTERNS = {
    "EMAIL_ADDRESS": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]+\.\p{L}[\p{L}\p{N}-]*[\p{L}\p{N}]",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "PHONE_NUMBER": r"(?:\+1[ .\u2013-]?(?:\([0-9]{3}\)[ .\u2013-]?|[0-9]{3}[ .\u2013-]?)"
                    r"|\([0-9]{3}\)[ .\u2013-]?|\b[0-9]{3}[ .\u2013-]?)[0-9]{3}[ .\u2013-]?[0-9]{4}\b",
}

# First names that stand in for a trained PERSON recognizer where the caller
# gives no table of names.
FIRST_NAMES = """
    Adam Alice Amy Andrew Anna Anthony Barbara Brian Carlos Carol Charles Chris
    Daniel David Deborah Donna Edward Elizabeth Emily Emma Eric Frank Fatima
    George Hannah Helen James Jane Jason Jennifer Jessica John Joseph Karen
    Kevin Laura Linda Lisa Maria Mark Mary Matthew Michael Mohammed Nancy
    Nicole Olivia Patricia Paul Peter Priya Rachel Richard Robert Ruth Sarah
    Scott Sofia Stephen Steven Susan Thomas Timothy William
""".split()

# Titles that stand before a name.
NAME_TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof"]

# What every match of a recognizer contains; quick to look for.
PII_HINTS = {
    "EMAIL_ADDRESS": "@",
    "US_SSN": "-[0-9]{2}-",
    "PHONE_NUMBER": "[0-9]{4}",
}

# A short list of English function words for the term reports; the classifier
# defaults to the list that ships with Spark ML.
COMMON_STOPS = """
    a an and are as at be been but by for from had has have he her his i in is
    it its not of on or our she that the their them they this to was we were
    what which who will with you your
""".split()

# Word lists of the stand-in text scorer, in order of precedence.
STANDIN_LABELS = {
    "threat": ["kill", "die", "destroy", "hurt"],
    "insult": ["idiot", "moron", "stupid", "worthless"],
    "toxic": TOXIC_WORDS + ["asshole", "faggot", "nigger", "retard"],
}

# Extra safe words of the strict mode: plain words the compat rules rewrite.
STRICT_SAFE_WORDS = """
    that hello where carp rock pass hat than then them cook book dock lock
    sock class mass grass less ask as bass lass tall tell sell well bell help
    held shell what when cram clap trap scrap wrap hit sit shirt short shot
    pitch witch ditch batch back hunt hint count aunt deck dim dam ham kin
    slit hall hill ship shift ditch
""".split()
