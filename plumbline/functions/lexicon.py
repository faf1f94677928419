"""The word lists and name fragments that the analyses test for."""

POSITIVE_WORDS = [
    "good", "great", "excellent", "best", "amazing", "wonderful", "fantastic",
    "happy", "love", "perfect", "better", "awesome", "nice", "positive",
]
NEGATIVE_WORDS = [
    "bad", "worst", "terrible", "poor", "awful", "horrible", "negative",
    "hate", "wrong", "worse", "disappointing", "disappointed", "useless",
]

LOCATION_TERMS = ["country", "city", "state", "region", "location"]
LATITUDE_TERMS = ["lat", "latitude"]
LONGITUDE_TERMS = ["long", "longitude"]
GEOGRAPHIC_TERMS = LOCATION_TERMS + LATITUDE_TERMS + LONGITUDE_TERMS

# Text that a CSV cell may hold in place of a value.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Candidate formats of a date held as text; "iso" is the SQL timestamp cast.
DATE_FORMATS = [
    "iso", "d-MMM-yy", "d-MMM-yyyy", "M/d/yyyy", "M/d/yy", "yyyy/M/d",
    "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-M-yyyy", "d.M.yyyy",
]
