"""Values that results depend on: vocabularies, word lists, edges and formats.

Everything in this module is a FIXED VALUE.  It is data, not logic, and has to
stay exactly as written for result tables to keep their meaning.
"""

from __future__ import annotations

# --- fixed values: the 28 emotion labels, in index order -----------------------
EMOTIONS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring",
    "confusion", "curiosity", "desire", "disappointment", "disapproval",
    "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief",
    "joy", "love", "nervousness", "optimism", "pride", "realization", "relief",
    "remorse", "sadness", "surprise", "neutral",
)

# --- fixed values: the sentiment group of each emotion -------------------------
POSITIVE_EMOTIONS = (
    "amusement", "excitement", "joy", "love", "desire", "optimism", "caring",
    "pride", "admiration", "gratitude", "relief", "approval",
)
NEGATIVE_EMOTIONS = (
    "fear", "nervousness", "remorse", "embarrassment", "disappointment",
    "sadness", "grief", "disgust", "anger", "annoyance", "disapproval",
)
AMBIGUOUS_EMOTIONS = ("realization", "surprise", "curiosity", "confusion")
SENTIMENTS = ("negative", "neutral", "positive")

# --- fixed values: cleaning markers --------------------------------------------
BOT_AUTHORS = ("AutoModerator", "automoderator")
AUTOMOD_AUTHOR = "AutoModerator"
DELETED_MARKERS = ("[deleted]", "[removed]")

# --- fixed values: funnel step labels ------------------------------------------
FUNNEL_RAW = "Raw dataset"
FUNNEL_DEDUPE = "After deduplicating comments"
FUNNEL_BOTS = "After removing AutoModerator"
FUNNEL_DELETED = "After removing [deleted] / [removed]"
FUNNEL_URLS = "After stripping URLs"
FUNNEL_EMPTY = "After removing empty comments"
FUNNEL_MIN_LENGTH = "After min length ({n})"
FUNNEL_FINAL = "Final cleaned dataset"

# --- fixed values: bins as (label, low, high); a bin holds low < x <= high ------
# The first length bin also holds 0.
LENGTH_BINS = (
    ("1-20", -1, 20), ("21-50", 20, 50), ("51-100", 50, 100),
    ("101-200", 100, 200), ("201-500", 200, 500), ("501-1000", 500, 1000),
    ("1000+", 1000, 10000),
)
SCORE_BINS = (
    ("<-1", -100, -1), ("-1 to 0", -1, 0), ("1", 0, 1), ("2-5", 1, 5),
    ("6-20", 5, 20), ("20+", 20, 1000),
)

# --- fixed values: weekday names, Monday first ---------------------------------
WEEKDAYS = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)

# --- fixed values: stopwords, apostrophes already removed ----------------------
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an",
    "and", "any", "are", "arent", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "cant", "could",
    "couldnt", "did", "didnt", "do", "does", "doesnt", "doing", "dont", "down",
    "during", "each", "even", "few", "for", "from", "further", "get", "gonna",
    "gotta", "had", "hadnt", "has", "hasnt", "have", "havent", "having", "he",
    "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if",
    "im", "in", "into", "is", "isnt", "it", "its", "itself", "just", "like", "ll",
    "me", "more", "most", "much", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "ok", "okay", "on", "once", "one", "only", "or", "other", "our", "ours",
    "ourselves", "out", "over", "own", "re", "really", "s", "same", "she", "should",
    "shouldnt", "so", "some", "such", "t", "than", "that", "thats", "the", "their",
    "theirs", "them", "themselves", "then", "there", "theres", "these", "they",
    "theyre", "this", "those", "through", "to", "too", "under", "until", "up", "us",
    "ve", "very", "wanna", "was", "wasnt", "we", "were", "werent", "what", "whats",
    "when", "where", "which", "while", "who", "whom", "why", "will", "with", "wont",
    "would", "wouldnt", "y", "yeah", "you", "youd", "youll", "your", "youre",
    "yours", "yourself", "yourselves", "ive", "youve", "weve", "theyve", "theyll",
    "theyd", "aint", "lets", "heres", "whos", "still",
)

# --- fixed values: tracked keywords as (label, regular expression) --------------
KEYWORDS = (
    ("midjourney", r"\bmidjourney\b"),
    ("dall-e", r"\bdall[\s-]?e\b"),
    ("stable diffusion", r"\bstable diffusion\b"),
    ("generated", r"\bgenerated\b"),
    ("artificial", r"\bartificial\b"),
    ("deepfake", r"\bdeepfake\b"),
    ("prompt", r"\bprompt\b"),
    ("sora", r"\bsora\b"),
    ("fake", r"\bfake\b"),
    ("real", r"\breal\b"),
    ("photorealistic", r"\bphotorealistic\b"),
)

# --- fixed values: polarity lexicon --------------------------------------------
POSITIVE_WORDS = (
    "love", "amazing", "beautiful", "great", "awesome", "incredible", "stunning",
    "wow", "perfect", "excellent", "good", "nice", "best", "fantastic", "brilliant",
    "impressive", "wonderful", "happy", "cool", "thanks", "thank", "gorgeous",
    "masterpiece", "favorite", "favourite", "enjoy", "liked", "helpful",
)
NEGATIVE_WORDS = (
    "hate", "awful", "terrible", "bad", "ugly", "worse", "worst", "garbage",
    "trash", "stupid", "disappointing", "boring", "creepy", "unsettling", "wrong",
    "horrible", "disgusting", "annoying", "fake", "soulless", "dead", "lazy",
    "bland", "cheap", "scam", "fear", "worried", "concern", "problem", "issue",
)

# --- fixed values: regular expressions -----------------------------------------
# Whitespace is spelled out so that every engine reads the same set: ASCII
# controls, the four separators U+001C-U+001F, and the Unicode space characters.
WS_SET = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_SET = r"\p{L}\p{N}_"
URL_STOP_SET = WS_SET + r"\)\]>" + "\"'"
# A run over these ranges is one emoji term.  The last range is wide: it also
# takes in CJK, kana and Hangul, and U+1F900-U+1F9FF is absent.
EMOJI_SET = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)
MARKDOWN_LINK = r"\[([^\]]*)\]\([^\)]+\)"
EMBEDDED_REPLY = r'\{[^{}]*"emotions"[^{}]*\}'

# --- fixed values: collection defaults -----------------------------------------
VISUAL_HINTS = ("image", "rich:video", "hosted:video")
TARGET_POSTS = 20_000
COMMENTS_PER_POST = 10
SEED = 42
THRESHOLD = 0.5
SCORING_BATCH = 32
MAX_TOKENS = 512
HISTOGRAM_BINS = 40
SCATTER_POINTS = 4000
PREVIEW_ROWS = 200

# --- fixed values: known models as key -> (label, kind) ------------------------
MODELS = {
    "tfidf_logreg": ("TF-IDF + Logistic Regression", "classical"),
    "bert_monologg": ("BERT (monologg)", "transformer"),
    "roberta_samlowe": ("RoBERTa (SamLowe)", "transformer"),
    "ollama_llama": ("Ollama LLM (local)", "llm"),
}
DEFAULT_MODELS = ("tfidf_logreg", "bert_monologg", "roberta_samlowe")
EXPERIMENT_PREFIXES = {
    "roberta_samlowe": "reddit_roberta",
    "bert_monologg": "reddit_bert",
    "tfidf_logreg": "reddit_tfidf",
}

# --- fixed values: the classification prompt around the label list and the text -
PROMPT_HEAD = (
    "Classify the emotions expressed in this Reddit comment.\n"
    "Valid labels (use exact spelling): "
)
PROMPT_TAIL = (
    '\nReturn JSON only: {"emotions": ["label1", "label2"]}\n'
    'Include all labels that apply. Use ["neutral"] if no emotion is expressed.\n'
    "Comment: "
)
