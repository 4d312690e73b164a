"""Word lists and phrases of the counterfactual text variants."""

ACTORS = {
    "military": ["security forces", "armed forces", "government troops", "state forces"],
    "police": ["law enforcement", "security personnel", "officers", "authorities"],
    "soldiers": ["troops", "military personnel", "armed personnel", "government forces"],
    "forces": ["troops", "personnel", "units", "operatives"],
    "state forces": ["non-state forces", "rebel forces", "opposition forces"],
    "government forces": ["rebel fighters", "opposition fighters", "insurgent forces"],
}

INTENSITY = {
    "high": ["severely", "brutally", "violently", "aggressively"],
    "low": ["allegedly", "reportedly", "seemingly", "apparently"],
    "hedging": ["may have", "might have", "possibly", "supposedly"],
}
INTENSITY_VERBS = ["killed", "beat", "shot", "arrested", "attacked"]

ACTIONS = {
    "killed": ["shot", "murdered", "executed", "eliminated"],
    "beat": ["assaulted", "attacked", "struck", "hit"],
    "arrested": ["detained", "captured", "apprehended", "seized"],
    "clashed": ["fought", "engaged", "confronted", "battled"],
}

NEGATION = {"killed": "kill", "injured": "injure", "arrested": "arrest", "beat": "beat", "shot": "shoot"}

SUFFICIENCY = [
    r"\b(military|police|soldiers|forces|troops)\b.*?\b(killed|beat|shot|arrested|attacked)\b.*?\b(civilians?|fighters?|members?)\b",
    r"\b(security forces|armed forces)\b.*?\b(killed|beat|shot|arrested|attacked)\b.*?\b(civilians?|protesters?)\b",
]

LEGITIMIZING = [
    "to restore order",
    "in response to violent provocation",
    "to maintain security",
    "in self-defense",
    "following credible threats",
    "to protect civilians",
]

DELEGITIMIZING = [
    "unprovoked",
    "using excessive force",
    "without justification",
    "in a brutal manner",
    "violating human rights",
    "targeting civilians indiscriminately",
]

SOURCES = [
    "According to state media,",
    "State-run media reported that",
    "Official sources claimed that",
    "Government officials stated that",
    "Independent local reporters said",
    "Local witnesses reported that",
    "Human rights organizations documented that",
    "International observers confirmed that",
]

PLACES = ["Location X", "Location Y"]
PLACE_PATTERNS = [
    r"\([^)]+,\s*[^)]+\)",
    r"\bin\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?:\s+(?:village|town|city|region|province|district))?",
]

# Neutral controls: the first rule of each family that applies.
REPORTING_VERBS = {"said": "stated", "stated": "said", "reported": "noted", "noted": "stated", "confirmed": "stated"}
WEEKDAYS = {"Monday": "Tuesday", "Tuesday": "Wednesday", "Wednesday": "Thursday", "Thursday": "Friday",
            "Friday": "Monday", "Saturday": "Sunday", "Sunday": "Saturday"}
CONNECTIVES = {"later": "afterwards", "afterwards": "later", "while": "during", "before": "prior to",
               "after": "following", "then": "subsequently", "subsequently": "then", "earlier": "previously",
               "previously": "earlier"}
NUMERALS = {"one": "two", "two": "three", "three": "four", "four": "five", "five": "six", "six": "seven"}
