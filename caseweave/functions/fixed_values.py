"""Tables, constants and patterns that results depend on.

They are data, kept together so that a change of a weight, a cue or a threshold
is a change in one place. Every operator also takes them as arguments.
"""
from __future__ import annotations

# Cue words per feature, first label with a matching cue wins.
VEHICLE_CUES = {
    "motorcycle": ["motorcycle", "motor cycle", "bike", "two-wheeler", "ಮೋಟಾರ್ ಸೈಕಲ್", "ದ್ವಿಚಕ್ರ"],
    "car": ["car", "four-wheeler", "ಕಾರು"],
    "auto": ["auto", "rickshaw", "ಆಟೋ"],
}
TARGET_CUES = {
    "gold_chain": ["gold chain", "chain", "ಚಿನ್ನದ ಸರ", "ಸರ"],
    "cash": ["cash", "rs.", "rupees", "ನಗದು", "ರೂ."],
    "mobile": ["mobile", "phone", "ಮೊಬೈಲ್"],
    "jewellery": ["jewellery", "ornaments", "ಚಿನ್ನಾಭರಣ"],
    "vehicle": ["two-wheeler stolen", "bike stolen", "ವಾಹನ"],
}
ENTRY_CUES = {
    "rear_window": ["rear window", "rear-window", "ಹಿಂಬದಿ ಕಿಟಕಿ"],
    "door_break": ["broke the door", "door lock", "ಬಾಗಿಲು"],
    "grill_cut": ["cut the grill", "grill"],
}
WEAPON_CUES = {
    "knife": ["knife", "ಚಾಕು"],
    "firearm": ["pistol", "gun", "firearm"],
    "sharp_weapon": ["machete", "sharp weapon", "ಆಯುಧ"],
}

# Phrases that carry no evidence.
STOP_PHRASES = ["the complainant", "at about", "about hrs", "near the", "on a"]

# Keyword lists per intent, checked in this order.
INTENT_KEYWORDS = {
    "linkage": ["connected", "linked", "are these related", "same series", "serial",
                "same gang", "same person behind"],
    "forecast": ["forecast", "predict", "next target", "strike next", "where next",
                 "ಮುಂದಿನ", "ಗುರಿ", "next window"],
    "hotspots": ["hotspot", "hot spot", "concentrated", "cluster of", "map of", "where are most"],
    "risk_rank": ["repeat offender", "top offender", "habitual", "most active offender", "risk score"],
    "network": ["network", "connections", "associates", "linked to", "web of"],
}
DEFAULT_INTENT = "run_sql"

# Ingredients of each legal section.
SECTION_ELEMENTS = {
    "BNS 304(2)": ("Snatching", ["Sudden/quick seizure of movable property",
                                 "From the person or possession of the victim", "Without consent"]),
    "BNS 3(5)": ("Acts by several persons in furtherance of common intention",
                 ["Two or more persons", "Pre-arranged/shared intention",
                  "Act done in furtherance of that intention"]),
    "BNS 318(4)": ("Cheating and dishonestly inducing delivery of property",
                   ["Deception of the victim", "Dishonest inducement",
                    "Delivery of property / wrongful loss"]),
    "BNS 331(4)": ("House-breaking by night", ["House-trespass", "Committed after sunset and before sunrise",
                                               "Entry by breaking/climbing"]),
    "BNS 305": ("Theft in a dwelling house", ["Dishonest taking of movable property",
                                              "Out of possession without consent",
                                              "From a dwelling/place of custody"]),
    "BNS 103": ("Punishment for murder", ["Act causing death", "Intention or knowledge",
                                          "Not covered by a general/special exception"]),
    "BNS 309": ("Robbery", ["Theft or extortion", "With force or fear of instant hurt",
                            "At or immediately before/after the act"]),
    "ITAct 66D": ("Cheating by personation using a computer resource",
                  ["Use of a communication device / computer resource",
                   "Personation / impersonation", "Cheating thereby"]),
}

# Weights and thresholds.
LINK_WEIGHTS = {"cosine": 0.20, "vehicle": 0.40, "target": 0.05, "tod": 0.20, "dow": 0.00, "geo": 0.15}
LINK_MAX_DAYS = 180
LINK_MAX_KM = 120.0
LINK_GEO_SCALE_KM = 120.0
CLUSTER_MIN_SIZE = 4
CLUSTER_EPSILON = 0.35
CONFIDENCE_FLOOR = 0.55
SCORE_WEIGHTS = {"recency": 0.30, "frequency": 0.35, "gravity": 0.25, "centrality": 0.10}
SCORE_TAU_DAYS = 912.0
SCORE_SATURATION = 4.0
DENIED_FEATURES = frozenset({"religion", "caste", "occupation"})
EARTH_RADIUS_KM = 6371.0
ROW_CAP = 500
IDENTIFIER_PATTERN = r"\b\d{4,5}-\d[\dX]{3,}\b"
CASE_KEY_FIRST_DIGITS = [1, 3, 4, 8]

# Wording of explanations and case packs.
SCORE_EXPLANATION = ("%d prior case(s); most recent %d days before the data cutoff; %d heinous; "
                     "network centrality %.2f.")
SCORE_NO_HISTORY = "No recorded case history."
PACK_EVENT = "FIR registered — "
PACK_SUSPECT_LEAD = "Prioritise surveillance of "
PACK_SUSPECT_REASON = "Highest risk score %.3f"
PACK_SIMILAR_LEAD = "Cross-check MO against similar historical cases for recovery leads"
PACK_SIMILAR_REASON = "%d cases share the narrative MO signature (top similarity %.3f)."
PACK_PRESENT_SOURCE = "BriefFacts / arrest records"
PACK_MISSING_SOURCE = "not yet established — investigation gap"
PACK_DEFAULT_WINDOW = "next 1-2 weeks"
NO_COMMON_FEATURE = "recurring MO"

# Wording of leads.
LEAD_METRICS = {"spike": "stl_residual_z", "repeat_offender": "matching_unsolved_within_3km", "series_growth": "new_cases_14d"}
LEAD_WINDOW = "last %dd"
LEAD_SPIKE_TITLE = "%s %.1fx baseline — %s"
LEAD_SPIKE_ACTION = "Increase night patrols and pickets around %s for the next 14 days."
LEAD_REPEAT_TITLE = "Possible re-offending by %s near home turf"
LEAD_REPEAT_ACTION = "Question %s; verify alibi for the %d unsolved cases near their residence."
LEAD_GROWTH_TITLE = "Series %s grew by %d cases"
LEAD_GROWTH_ACTION = "Escalate %s (%s) to a special team."
