"""Fixed values that must equal the reference's for equal results.

Everything in this module is a plain constant (lists, weights, thresholds,
patterns). Regular expressions are written once as templates and expanded
into two dialects: Java (Spark) and RE2 (the DuckDB oracle). The templates use
these placeholders:

  {W}  a word character          (Python's Unicode ``\\w``)
  {S}  a whitespace character    (Python's Unicode ``\\s``)
  {NS} a non-whitespace character
  {D}  a decimal digit           (Python's Unicode ``\\d``)
  {B}  a leading word boundary   (before a word character)
  {E}  a trailing word boundary  (after a word character)
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Seeds, sizes, thresholds
# --------------------------------------------------------------------------
SEED = 42
TRAIN_FRAC = 0.80
VAL_FRAC = 0.10
TEST_FRAC = 0.10
CHUNK_ROWS = 5000            # reader chunk of the reference (S5)
SAMPLE_SIZE = 25             # stress sample (M6)
OVERSAMPLE_FACTOR = 1.7      # O9: int(n / k * 1.7) + 100
OVERSAMPLE_EXTRA = 100
MAX_QUESTION_RATE = 0.18     # Q3
OPENING_CAP = 6              # D5: reject once 6 accepted rows share an opening
OPENING_WORDS = 3
CHAR_RATIO_MIN = 0.92        # J3 char ratio
JACCARD_MIN = 0.87           # J3 word Jaccard
PROGRESS_STEP = 250          # W1
BATCH_SIZE = 10              # posts per generation request
V2_MAX_CHARS = 280
V2_MIN_CHARS = 4
V2_MAX_HASHTAGS = 4
V2_MAX_MENTIONS = 3
TOKEN_WINDOW = 128           # T25
PAD_TOKEN = "<pad>"
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "#N/A", "<NA>", "n/a", "-NaN", "-nan",
               "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN"]

# Label maps
LABEL_TO_ID = {"human": 0, "ai": 1}
ID_TO_LABEL = ["human", "ai"]
SENTIMENT_CLASSES = ["negative", "neutral", "positive"]

# Sentiment buckets (T20): score <= -0.6, <= -0.2, < 0.2, < 0.6, else
SENTIMENT_BUCKETS = [
    ("strongly negative", "<=", -0.6),
    ("negative", "<=", -0.2),
    ("neutral", "<", 0.2),
    ("positive", "<", 0.6),
]
SENTIMENT_TOP = "strongly positive"
# AI buckets (T21): >= 0.7 likely AI, >= 0.4 uncertain, else likely human
AI_BUCKETS = [("likely AI", 0.7), ("uncertain", 0.4)]
AI_BOTTOM = "likely human"

# Length bands (v3): name, min_chars, max_chars, target proportion
LENGTH_BANDS = [
    ("very_short", 10, 55, 0.20),
    ("short", 56, 100, 0.35),
    ("medium", 101, 180, 0.30),
    ("long", 181, 270, 0.15),
]

STANCES = [
    "supportive of a progressive policy approach",
    "supportive of a conservative policy approach",
    "skeptical of government intervention",
    "centrist or tradeoff-focused",
    "critical of both major parties",
    "uncertain or still figuring out the issue",
    "focused on practical local effects",
    "not clearly ideological",
]

TONES = [
    "plainspoken",
    "annoyed",
    "curious",
    "dryly funny",
    "hopeful",
    "skeptical",
    "matter-of-fact",
    "tired but restrained",
    "reflective",
    "enthusiastic",
]

FORM_WEIGHTS = [
    ("direct reaction", 0.22),
    ("personal observation", 0.18),
    ("brief opinion", 0.18),
    ("question", 0.10),
    ("reply-like disagreement", 0.08),
    ("dry joke or sarcasm", 0.03),
    ("sentence fragment", 0.07),
    ("local practical complaint", 0.08),
    ("brief supportive reaction", 0.06),
]

STYLE_WEIGHTS = [
    ("standard", 0.75),
    ("casual_lowercase", 0.10),
    ("internet_reply", 0.05),
    ("short_reaction", 0.08),
    ("emoji_reaction", 0.02),
]

# Replacement style when a short reaction lands on a medium/long band
SHORT_REACTION_BANDS = ["medium", "long"]
SHORT_REACTION_REPLACEMENTS = ["standard", "casual_lowercase", "internet_reply"]
# Replacement forms once the question cap is reached
QUESTION_REPLACEMENTS = [
    "direct reaction",
    "personal observation",
    "brief opinion",
    "reply-like disagreement",
    "sentence fragment",
    "local practical complaint",
]

# v2 quality flags
V2_LEAK_PHRASES = [
    "here is the tweet",
    "here's the tweet",
    "as an ai",
    "according to the prompt",
    "topic:",
    "stance:",
    "persona:",
    "writing approach:",
]
PLACEHOLDER_HANDLE = "@someuser"

# Regex templates (see module docstring for placeholders)
URL_CLEAN = r"https?://{NS}+"                 # T1
MENTION_CLEAN = r"@{W}+"                      # T2
URL_PRESENT = r"(?i)https?://|www\."          # F8
HANDLE_PRESENT = r"{B}@[A-Za-z0-9_]"          # F8 (a 1..30 run starts with one char)
PUNCT_SPAM = r"[!?]{5,}"                      # F5
EMOJI = r"[\x{1F001}-\x{10FFFF}]"             # T11: any code point above U+1F000

V2_BOILERPLATE = [
    r"{B}it'?s worth noting{E}",
    r"{B}constructive (?:discussion|discussions){E}",
    r"{B}moving forward{E}",
    r"{B}real solutions{E}",
    r"{B}what matters{E}",
    r"{B}urgent issues?{E}",
    r"{B}national security concerns{E}",
    r"{B}both sides need to{E}",
    r"{B}this is not about .* it'?s about{E}",
    r"{B}can we get some real leadership{E}",
]

V3_METADATA = [
    r"{B}{D}{1,3}{S}*(?:characters|chars){E}",
    r"{B}character count{E}",
    r"{B}word count{E}",
    r"{B}tweet {D}+{E}",
    r"{B}post {D}+{E}",
    r"{B}target length{E}",
]

V3_BOILERPLATE = [
    r"{B}as an ai{E}",
    r"{B}language model{E}",
    r"{B}it'?s worth noting{E}",
    r"{B}what do you think{E}",
]

# Verdict reasons in check order (F7); the last two come from the greedy step
VERDICT_ORDER = [
    "not_a_string",
    "empty",
    "profile_length_mismatch",
    "contains_url",
    "contains_handle",
    "metadata_leakage",
    "boilerplate",
    "near_duplicate",
    "repeated_opening",
]

# --------------------------------------------------------------------------
# Dialect expansion
# --------------------------------------------------------------------------
_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"
_SPACE_BODY = r"\s\p{Z}\x0b\x1c-\x1f\x85"
_DIGIT = r"\p{Nd}"

_COMMON = {
    "{W}": _WORD,
    "{S}": "[" + _SPACE_BODY + "]",
    "{NS}": "[^" + _SPACE_BODY + "]",
    "{D}": _DIGIT,
}


def _expand(template: str, extra: dict[str, str]) -> str:
    out = template
    for k, v in {**_COMMON, **extra}.items():
        out = out.replace(k, v)
    return out


def java(template: str) -> str:
    """Expand a template for Java regex (Spark ``rlike``/``regexp_*``)."""
    return _expand(template, {"{B}": "(?<!" + _WORD + ")", "{E}": "(?!" + _WORD + ")"})


def re2(template: str) -> str:
    """Expand a template for RE2 (DuckDB). RE2 has no look-around; for an
    existence test a consumed boundary character is equivalent."""
    return _expand(template, {"{B}": "(^|" + _NOT_WORD + ")", "{E}": "($|" + _NOT_WORD + ")"})


SPACE_RUN = "[" + _SPACE_BODY + "]+"
