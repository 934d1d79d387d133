"""Fixed values that results depend on: scores, word lists and patterns."""

SOURCE_BASELINES = {
    "reuters.com": 0.9, "apnews.com": 0.9, "afp.com": 0.9, "tass.com": 0.75, "xinhua.net": 0.7,
    "bbc.com": 0.85, "bbc.co.uk": 0.85, "nytimes.com": 0.85, "washingtonpost.com": 0.85, "theguardian.com": 0.82, "economist.com": 0.85, "ft.com": 0.85, "wsj.com": 0.85,
    "cnn.com": 0.75, "foxnews.com": 0.7, "aljazeera.com": 0.75, "npr.org": 0.82, "france24.com": 0.75, "dw.com": 0.75, "cnbc.com": 0.78, "bloomberg.com": 0.85, "scmp.com": 0.72,
    "foreignpolicy.com": 0.82, "foreignaffairs.com": 0.85, "warontherocks.com": 0.78, "thediplomat.com": 0.75, "responsiblestatecraft.org": 0.75,
    "defenseone.com": 0.78, "breakingdefense.com": 0.75, "defensenews.com": 0.78, "bellingcat.com": 0.8, "news.google.com": 0.6,
    "rt.com": 0.4, "sputniknews.com": 0.4, "breitbart.com": 0.5, "infowars.com": 0.2,
    "twitter.com": 0.3, "x.com": 0.3, "reddit.com": 0.3, "facebook.com": 0.3, "telegram.org": 0.3,
}
SOURCE_TYPE_DEFAULTS = {"wire_service": 0.85, "official_statement": 0.8, "news_outlet": 0.6, "social_media": 0.3, "academic": 0.85, "document": 0.5, "eyewitness": 0.6, "unknown": 0.3}
DOMAIN_SUFFIX_DEFAULTS = {".gov": 0.85, ".mil": 0.85, ".edu": 0.85, ".org": 0.7, ".int": 0.85}
PROXIMITY_DECAY = 0.7
ECHO_ALPHA = 0.2
PRECISION_WEIGHTS = {"entity_count": 0.3, "temporal_precision": 0.3, "has_quote": 0.2, "has_document": 0.2}
TEMPORAL_FACTORS = {"explicit": 1.0, "inferred": 0.6}
FIXABILITY = {"fog": 0.9, "anomaly": 0.8, "phantom": 0.6, "noise": 0.1}
CONFIDENCE_BOOSTS = {"wire_service": 0.3, "official_statement": 0.25, "news_outlet": 0.2, "social_media": 0.1}

TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref", "twclid", "msclkid", "gclid", "gclsrc", "dclid",
    "ref", "source", "mc_cid", "mc_eid", "oly_enc_id", "oly_anon_id", "_ga", "_gl", "_hsenc", "_hsmi", "hsCtaTracking", "vero_id", "nr_email_referer", "mkt_tok",
)
NEWS_DOMAINS = ("reuters.com", "apnews.com", "bbc.com", "nytimes.com", "washingtonpost.com", "theguardian.com", "aljazeera.com")
SOCIAL_DOMAINS = ("reddit.com", "twitter.com", "x.com", "facebook.com")
WIRE_DOMAINS = ("reuters.com", "apnews.com", "afp.com")

VAGUE_ATTRIBUTION = (
    r"sources?\s+(?:say|said|claim|suggest|indicate)", r"according\s+to\s+(?:sources?|officials?|reports?)", r"reportedly", r"allegedly", r"it\s+is\s+(?:said|believed|reported|understood)",
    r"(?:some|many|several)\s+(?:say|believe|think)", r"(?:anonymous|unnamed)\s+(?:source|official)", r"people\s+familiar\s+with", r"those\s+close\s+to", r"insiders?\s+(?:say|claim)",
    r"(?:may|might|could)\s+(?:have|be)", r"appears?\s+to", r"seems?\s+(?:to|like)", r"(?:likely|probably|possibly)",
)
NEGATION_CUES = (
    r"\bno evidence\b", r"\bno proof\b", r"\bno confirmation\b", r"\bno credible\b", r"\bnot true\b", r"\bnot confirmed\b", r"\bnot verified\b", r"\bnot supported\b",
    r"\bfalse claim\b", r"\bfalse report\b", r"\bmisleading claim\b", r"\bfact[ -]check.*false\b", r"\bcontradicts\b", r"\bcontradicted\b", r"\bdisproven\b", r"\bdebunked\b",
    r"\brefuted\b", r"\bdenies\b", r"\bdenied\b", r"\bmisinformation\b", r"\bdisinformation\b",
)
NEGATION_WORDS = ("not", "no", "never", "denied", "rejected", "refused", "false", "untrue", "disputed", "contradicted")
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "in", "on", "at", "to", "for", "of", "and", "or", "but", "has", "have", "had", "that", "this", "with", "by", "from")

WORLD_LEADERS = ("putin", "biden", "xi", "jinping", "modi", "macron", "scholz", "sunak", "zelensky", "zelenskyy", "kim jong", "erdogan", "netanyahu", "khamenei")
SENIOR_TITLES = ("president", "prime minister", "chancellor", "minister", "general", "admiral", "commander")
MAJOR_ORGANIZATIONS = ("nato", "un ", "united nations", "eu ", "european union", "g7", "g20", "pentagon", "kremlin", "white house", "brics", "opec", "asean", "who", "imf", "world bank")
MILITARY_ENTITIES = ("army", "navy", "air force", "military", "troops", "forces")
ENTITY_TYPE_SCORES = {"PERSON": 0.4, "PER": 0.4, "ORGANIZATION": 0.4, "ORG": 0.4, "LOCATION": 0.3, "LOC": 0.3, "GPE": 0.3, "EVENT": 0.5}
CRITICAL_PATTERNS = (
    r"(?:president|prime\s+minister|chancellor|king|queen)\s+\w+", r"(?:xi|putin|biden|modi|macron|scholz|sunak)", r"(?:nato|un|eu|g7|g20|brics|asean|opec)",
    r"(?:pentagon|kremlin|white\s+house|downing\s+street)", r"(?:army|navy|air\s+force|military|troops|soldiers)", r"(?:nuclear|missile|weapon|bomb)",
)
MILITARY_EVENTS = ("attack", "strike", "invasion", "war", "conflict", "military", "nuclear", "missile", "weapon", "troops", "soldiers", "combat")
TREATY_EVENTS = ("treaty", "agreement", "sanction", "embargo")
MAJOR_EVENTS = ("election", "coup", "assassination", "emergency", "crisis")
MEETING_EVENTS = ("summit", "diplomatic", "ambassador", "negotiation")
CLAIM_TYPE_SCORES = {"event": 0.5, "state": 0.3, "relationship": 0.4, "prediction": 0.6, "planned": 0.5}
LOCATIONS = (r"\b(?:New York|London|Paris|Tokyo|Beijing|Moscow|Washington|Berlin|Sydney)\b", r"\b(?:USA|UK|EU|China|Russia|India|Brazil|Japan|Germany|France)\b")
#: Signs of a challenge page, of which it shows two.
CHALLENGE_SIGNS = ("cf-turnstile", "challenge-form", "__cf_chl_f_tk", "cf-browser-verification", "cf_clearance", "Checking your browser", "Enable JavaScript and cookies to continue", r"ray\s+id")
#: Forms of dates, tried in order after the name of the weekday is taken away.
DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy HH:mm:ss z", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM", "yyyy")
