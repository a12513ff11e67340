"""Class lists, character ranges, word lists, lookup tables, defaults.

Everything in this module is data that results depend on.  The values are kept
in their natural order, because order decides ties.
"""

from __future__ import annotations

# --- fixed values: intent classes, in label-id order --------------------------
INTENTS = [
    "complaint",
    "purchase_inquiry",
    "price_negotiation",
    "callback_request",
    "not_interested",
    "positive_confirmation",
]

# --- fixed values: code point ranges treated as emoji --------------------------
EMOJI_RANGES = [
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F300, 0x1F5FF),  # symbols and pictographs
    (0x1F680, 0x1F6FF),  # transport and map symbols
    (0x1F1E0, 0x1F1FF),  # flags
    (0x2702, 0x27B0),
    (0x24C2, 0x1F251),  # wide: also covers CJK, kana, Hangul, U+FE0F
]

# --- fixed values: punctuation that is counted and squeezed when repeated ------
PUNCTUATION = "!?.,;:-_"

# --- fixed values: Unicode white space as code point ranges --------------------
WHITESPACE_RANGES = [
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
]

# --- fixed values: (prefix, suffix) pairs used to augment training rows --------
VARIATIONS = [
    ("", ""),
    ("Arre ", " please"),
    ("Hey, ", "!"),
    ("Bhai ", " jaldi batao"),
    ("Sir ", " kindly confirm"),
    ("Sunna ", "..."),
    ("Dekho ", " actually"),
    ("Hello team, ", ""),
]

# --- fixed values: keyword lists per intent ------------------------------------
KEYWORDS = {
    "complaint": [
        "kharab", "bekar", "refund", "complain", "delay", "issue", "defective",
        "cheat", "fraud", "fault", "broken", "deliver nahi", "stale", "kam nahi",
    ],
    "purchase_inquiry": [
        "detail", "brochure", "information", "available", "specification", "mileage",
        "warranty", "feature", "emi", "kya", "price", "kitna", "stock", "color",
    ],
    "price_negotiation": [
        "discount", "kam", "sasta", "cheaper", "negotiate", "offer", "expensive",
        "coupon", "bargain", "rate", "off", "budget", "cut", "kam karo",
    ],
    "callback_request": [
        "call", "baad", "busy", "meeting", "driving", "kal", "sham", "schedule",
        "ring", "later", "phone", "ghante", "morning", "connect",
    ],
    "not_interested": [
        "nahi chahiye", "not interested", "dnd", "mat call", "stop", "unsubscribe",
        "block", "remove", "don't", "no thanks", "mana", "close my lead",
    ],
    "positive_confirmation": [
        "haan", "yes", "confirm", "done", "agree", "theek", "ready", "proceed",
        "pack", "lock", "approved", "seal", "final", "gpay",
    ],
}
KEYWORD_DEFAULT = "purchase_inquiry"

# --- fixed values: error diagnosis, an ordered decision list -------------------
ERROR_PAIRS = [
    (
        "purchase_inquiry", "price_negotiation",
        "Ambiguous Pricing Terminology: Inquiring about price/cost interpreted as active discount negotiation.",
    ),
    (
        "price_negotiation", "purchase_inquiry",
        "Implicit Negotiation: Asking about lower variant or rate matching mistaken for general inquiry.",
    ),
    (
        "complaint", "not_interested",
        "Negative Sentiment Spillover: Harsh complaint language mistaken for refusal to interact.",
    ),
    (
        "callback_request", "not_interested",
        "Contextual Rejection: 'Abhi busy hu baad me phone karo' mistaken for DND/rejection.",
    ),
    (
        "positive_confirmation", "purchase_inquiry",
        "Confirmation with Follow-up Question: Conditional agreement mistaken for product inquiry.",
    ),
]
NEGATIONS = ["nahi", "no", "mat"]
ERROR_NEGATION = "Negation Ambiguity: Sentence contains negative particles leading to confusion."
ERROR_DEFAULT = "Code-Mixed Lexical Ambiguity: Multi-intent phrases or colloquial transliteration overlap."

ERROR_SOURCE_TEST = "In-Domain (test.csv)"
ERROR_SOURCE_OOD = "OOD Benchmark (test_ood.csv)"

# --- fixed values: next action and marker per intent ---------------------------
ACTIONS = {
    "price_negotiation": (
        "🎯 <strong>Voice Agent Trigger:</strong> Offer standard tier discount coupon or initiate pricing rebuttal protocol.",
        "🏷️",
    ),
    "complaint": (
        "⚠️ <strong>Voice Agent Trigger:</strong> Escalate immediately to Tier-2 Support Lead and initiate ticket resolution workflow.",
        "⚠️",
    ),
    "purchase_inquiry": (
        "🔍 <strong>Voice Agent Trigger:</strong> Send product specifications brochure and offer complimentary live product demo.",
        "🔍",
    ),
    "callback_request": (
        "📞 <strong>Voice Agent Trigger:</strong> Record preferred callback timestamp and queue automated dialer retry in CRM.",
        "📞",
    ),
    "not_interested": (
        "🚫 <strong>Voice Agent Trigger:</strong> Tag as cold lead in sales pipeline, log DND preferences, and end call politely.",
        "🚫",
    ),
    "positive_confirmation": (
        "✅ <strong>Voice Agent Trigger:</strong> Trigger instant payment link via SMS/WhatsApp and mark lead as WON in CRM.",
        "✅",
    ),
}
DEFAULT_ACTION = (
    "🎯 <strong>Voice Agent Action:</strong> Route utterance to conversational sales agent.",
    "🎯",
)

# --- fixed values: backbone dimension ------------------------------------------
# (name, label, org, type, vocab_size, params)
BACKBONES = [
    (
        "distilbert-base-multilingual-cased",
        "DistilBERT Multilingual (Default Production Backbone)",
        "Hugging Face / Google", "General Multilingual (104 languages)", 119547, "135M",
    ),
    (
        "google/muril-base-cased",
        "MuRIL (Multilingual Representations for Indian Languages)",
        "Google Research India", "Domain-Specific Indic & Transliterated", 197285, "236M",
    ),
    (
        "l3cube-pune/hing-bert",
        "L3Cube Hinglish-BERT",
        "L3Cube Pune", "Dedicated Code-Mixed Hindi-English BERT", 119547, "110M",
    ),
    (
        "l3cube-pune/hing-roberta",
        "L3Cube Hinglish-RoBERTa",
        "L3Cube Pune", "Dedicated Code-Mixed Hindi-English RoBERTa", 50265, "125M",
    ),
]
# (params, memory, latency); the last entry is the default for any other size
BACKBONE_COST = [
    ("110M", "220 MB", "30 ms"),
    ("125M", "250 MB", "32 ms"),
    ("135M", "270 MB", "35 ms"),
    (None, "470 MB", "68 ms"),
]
DEFAULT_TOKENS_PER_WORD = 2.50
DEFAULT_TOKENS_PER_TEXT = 16.0

STATUS_BASELINE = "Baseline"
STATUS_TUNED = "Fine-Tuned Production Model"

# --- fixed values: columns of the reports --------------------------------------
ERROR_COLUMNS = [
    "clean_text", "intent", "predicted_intent", "confidence",
    "benchmark_source", "failure_analysis",
]
RUN_COLUMNS = [
    "Rank", "run_name", "learning_rate", "lora_r", "lora_alpha", "epochs",
    "val_loss", "val_accuracy", "val_macro_f1",
]

# --- fixed values: defaults ----------------------------------------------------
SEED = 42
SPLIT_RATIOS = (0.70, 0.15, 0.15)
CONFIDENCE_THRESHOLD = 0.60
MIN_CLEAN_CHARS = 3
MAX_REQUEST_CHARS = 1000
MAX_BATCH_TEXTS = 100
MAX_TOKENS = 128
NB_ALPHA = 0.5
SCORING_BATCH = 32
QUALITY_GATE_F1 = (0.75, 0.99)

# --- fixed values: class binding of the supplied multilingual tables -----------
LANG_LABELS = ["en", "de", "fr", "es"]
LANG_KEYWORDS = {
    "en": ["the ", "of ", "and ", "in "],
    "de": ["der ", "die ", "und ", "sch"],
    "fr": ["le ", "les ", "et ", "que"],
    "es": ["el ", "la ", "que ", "ción"],
}
LANG_DEFAULT = "es"
LANG_OOD_SOURCES = ["src18", "src19"]
LANG_ACTIONS = {
    "en": ("<b>Route</b> to the English desk", "EN"),
    "de": ("<b>Route</b> to the German desk", "DE"),
    "fr": ("<b>Route</b> to the French desk", "FR"),
}
LANG_ERROR_PAIRS = [
    ("en", "es", "English text with few function words."),
    ("fr", "es", "Shared Romance article."),
    ("es", "fr", "Shared Romance conjunction."),
    ("de", "es", "German text with few function words."),
    ("en", "fr", "French fragment inside English text."),
]
