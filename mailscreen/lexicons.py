"""Word lists, weights, names, orders and patterns.

Everything in this module is a constant that has to hold exactly these values for
results to be comparable; there is no logic here.
"""

# --- fixed values: persuasion terms, matched as case-insensitive substrings ---
URGENCY_TERMS = (
    # English
    "urgent", "urgently", "immediately", "asap", "now", "today",
    "expire", "expires", "expiring", "expired",
    "suspend", "suspended", "suspending",
    "verify", "verification", "validate", "confirm", "confirmation",
    "update", "required", "mandatory",
    "limited", "limited time", "last chance",
    "account", "password", "credential", "login", "sign in",
    "click here", "click now", "click below",
    "free", "winner", "won", "prize", "gift", "reward", "bonus",
    "bank", "paypal", "apple", "microsoft", "amazon", "netflix",
    "unauthorized", "unusual", "suspicious", "fraud", "alert",
    "act now", "respond", "respond immediately",
    "dear customer", "dear user", "dear account",
    "billing", "invoice", "payment", "overdue",
    # Spanish
    "urgente", "urgentemente", "inmediatamente", "ahora",
    "verificar", "verificación", "validar", "confirmar",
    "actualizar", "requerido", "obligatorio",
    "cuenta", "contraseña", "acceso", "iniciar sesión",
    "haz clic", "haz click",
    "gratis", "ganador", "premio", "regalo",
    "banco", "suspendido", "vencer", "vence",
    "alerta", "fraude", "inusual", "no autorizado",
    "estimado cliente", "estimado usuario",
    "factura", "pago", "vencido",
)

# --- fixed values: impersonated brands, matched as case-insensitive substrings ---
BRAND_TERMS = (
    "paypal", "apple", "microsoft", "amazon", "netflix",
    "google", "facebook", "instagram", "twitter", "linkedin",
    "chase", "wells fargo", "citibank", "bankofamerica",
    "fedex", "ups", "dhl", "usps",
    "irs", "gov", "gobierno", "sat", "imss", "bbva",
    "bancomer", "banamex", "santander", "hsbc",
)

# --- fixed values: URL shortener hosts, matched as whole hosts ---
SHORTENER_HOSTS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly",
    "buff.ly", "short.link", "is.gd", "v.gd", "rebrand.ly",
    "cutt.ly", "shorte.st", "adf.ly", "bc.vc", "tiny.cc",
    "lnkd.in", "fb.me", "youtu.be",
)

# --- fixed values: high-risk top-level domains ---
RISKY_TLDS = (
    "tk", "ml", "ga", "cf", "gq", "pw", "cc", "xyz",
    "top", "club", "online", "site", "fun", "live",
    "stream", "download", "bid", "win",
)

# --- fixed values: the 32 metadata features, canonical order and types ---
FEATURE_TYPES = {
    "subject_length": "int",
    "body_length": "int",
    "body_word_count": "int",
    "body_digit_count": "int",
    "body_special_char_count": "int",
    "body_entropy": "double",
    "ratio_uppercase_body": "double",
    "ratio_uppercase_subject": "double",
    "exclamation_count": "int",
    "num_urls": "int",
    "num_unique_domains": "int",
    "has_url": "boolean",
    "has_ip_url": "boolean",
    "has_url_shortener": "boolean",
    "num_suspicious_tlds": "int",
    "max_url_entropy": "double",
    "avg_url_length": "double",
    "num_redirect_params": "int",
    "max_url_length": "int",
    "has_html": "boolean",
    "has_form": "boolean",
    "has_iframe": "boolean",
    "has_urgency_words": "boolean",
    "urgency_word_count": "int",
    "brand_mention_count": "int",
    "has_brand_mention": "boolean",
    "subject_is_empty": "boolean",
    "subject_has_re_fwd": "boolean",
    "subject_entropy": "double",
    "subject_exclamations": "int",
    "subject_has_urgency": "boolean",
    "subject_has_brand": "boolean",
}
FEATURES = tuple(FEATURE_TYPES)

# --- fixed values: heuristic metadata weights, summed in this order ---
HEURISTIC_WEIGHTS = {
    "has_ip_url": 0.35,
    "has_form": 0.25,
    "has_iframe": 0.20,
    "has_url_shortener": 0.20,
    "has_urgency_words": 0.15,
    "has_brand_mention": 0.12,
    "num_suspicious_tlds": 0.10,
    "num_redirect_params": 0.10,
    "subject_has_urgency": 0.08,
    "ratio_uppercase_body": 0.06,
    "has_html": 0.04,
    "subject_has_brand": 0.05,
    "subject_is_empty": 0.03,
}

# --- fixed values: heuristic text score ---
URGENCY_DENSITY_FULL = 0.02
URGENCY_DENSITY_WEIGHT = 0.6
URGENCY_COUNT_SCALE = 10.0
URGENCY_COUNT_CAP = 0.4

# --- fixed values: raw label spellings, after trimming and lower-casing ---
PHISHING_LABELS = ("1", "spam", "phishing", "malicious", "true", "yes", "1.0")
LEGITIMATE_LABELS = ("0", "ham", "legit", "legitimate", "benign", "false", "no", "0.0")

# --- fixed values: prepared text and split format ---
TEXT_SEPARATOR = " [SEP] "
UNIFIED_COLUMNS = ("dataset_source", "subject", "body", "label")
SPLIT_COLUMNS = ("subject", "body", "label")
RECALL_TARGET = 0.95

# --- fixed values: CSV cells read as missing (the published pandas defaults) ---
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- fixed values: white space as a regex class body: the Unicode White_Space property
# --- (29 code points together with U+001C-001F); patterns using it set the (?U) flag
WS_CHARS = r"\s\x1c-\x1f"
WS = f"[{WS_CHARS}]"

# --- fixed values: patterns (Java regex syntax) ---
HTML_BLOCK = r"(?isu)<(style|script)[^>]*>.*?</\1>"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"(?iu)</?[a-zA-Z][^>]*>"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL_TAIL = rf"""[^{WS_CHARS}<>"'(){{}}\[\]]+"""
# the leading look-ahead only lets positions be skipped quickly
URL = (
    rf"(?=[HhFfWw])(?iU)(?:(?:https?|ftp)://{URL_TAIL}"
    rf"|(?<![\p{{L}}\p{{N}}_])www\.{URL_TAIL})"
)
URL_TRAILING = r"[.,;:!?)>»\]]+\z"
URL_HOST = rf"(?iU)^(?:https?|ftp)://([^/:?#{WS_CHARS}]+)"
IP_URL = r"(?iu)^https?://\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}(?:[:/]|\z)"
REDIRECT_PARAM = (
    r"(?iu)[?&](?:redirect|url|next|goto|return|redir|continue|target)(?:_url|_to)?="
)
RISKY_TLD_HOST = r"\.(?:" + "|".join(RISKY_TLDS) + r")\z"
HTML_MARK = r"<[a-zA-Z]"  # with a closing bracket somewhere after it
FORM_MARK = r"(?i)<form(?![\p{L}\p{N}_])"
IFRAME_MARK = r"(?i)<iframe(?![\p{L}\p{N}_])"
REPLY_MARK = rf"(?iU)^{WS}*(?:re|fw|fwd){WS}*:"
TOKEN = r"[a-z0-9_]{2,}"
ASCII_SPECIAL = "".join(
    chr(c) for c in range(0x80)
    if not (chr(c).isalnum() or chr(c).isspace())
)
