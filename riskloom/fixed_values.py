"""Thresholds, word lists and formats that results depend on."""

# Inclusive lower bounds of the severity levels.
LEVEL_CUTS = (("critical", 0.85), ("high", 0.6), ("medium", 0.3))
LEVELS = ("critical", "high", "medium", "low")
ALERT_THRESHOLD = 0.6

# Source types that the monitoring views know.
SOURCE_TYPES = ("reddit", "rss", "telegram", "url")

# Labels counted as a threat: exact names, then substrings.
THREAT_LABELS = ("label_1", "positive", "toxic")
THREAT_TOKENS = (
    "toxic", "severe", "threat", "hate", "insult", "identity",
    "obscene", "harass", "offensive", "abuse", "extreme",
)

# Path prefixes that never lead to an article.
NON_ARTICLE_PREFIXES = (
    "/tag/", "/category/", "/author/", "/page/", "/topic/",
    "/search", "/login", "/register", "/about", "/contact",
    "/subscribe", "/newsletter", "/rss", "/feed", "/privacy",
    "/terms", "/cookie",
)

# Presentation zone of daily trends and reports.
ZONE = "Australia/Sydney"

# Uploadable file extensions and how each is read.
FILE_READERS = (
    ("txt", "text"), ("csv", "csv"), ("json", "json"),
    ("pdf", "external"), ("docx", "external"), ("xlsx", "external"), ("xls", "external"),
)

CHUNK_CHARS = 4000
TOP_KEYWORDS = 15

# Usual lengths of short displays; no operator cuts by them unless asked to.
FEED_LIMITS = {"rss": 50, "telegram": 30}
ARTICLES_PER_PAGE = 25
TITLE_CHARS = 300
PARAGRAPH_CHARS = 400
FINGERPRINT_CHARS = 500

# Common English words left out of n-gram rankings.
ENGLISH_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers him his how i if in into is it its itself just me more "
    "most my no nor not now of off on once only or other our out over own same she should so some "
    "such than that the their them then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would you your"
).split()

# Frequent function words per language, for language identification.
LANGUAGE_WORDS = {
    "en": "the and of to in that is was for it with as his on be at by this had not are but from".split(),
    "fr": "le la les de des et un une en que qui dans pour pas sur est au avec par plus ce il elle".split(),
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los de y en que las del un una por con para no se su al lo como más o pero".split(),
}

# Illustrative rule lexicon: (category, keyword).
RISK_LEXICON = (
    ("violence", "attack"), ("violence", "kill"), ("violence", "bomb"), ("violence", "weapon"),
    ("extremism", "radical"), ("extremism", "militant"), ("extremism", "extremist"),
    ("fraud", "laundering"), ("fraud", "scam"), ("fraud", "phishing"),
    ("abuse", "hate"), ("abuse", "threat"), ("abuse", "harass"),
)

# Summaries of texts that were not classified.
NO_CONTENT = "No content to analyze."
NO_CLASSIFIER = "ML classifier unavailable (no scorer could run). No reliable threat score could be produced."
