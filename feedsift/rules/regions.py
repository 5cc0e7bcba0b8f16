"""Region words and patterns.

Patterns in ``rules`` are written with ASCII word boundaries and a whitespace
escape that also covers no-break and other Unicode spaces; see
``functions.regex`` for how each engine gets that meaning.
"""

from __future__ import annotations

# Words that mark a US location.
US_COUNTRY_PATTERN = r"\b(?:usa|u\.?s\.?a|united states|u\.?s\.?)\b"
US_REMOTE_PATTERN = r"\bremote\b"
US_STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont",
    "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
)
US_STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY", "DC",
)

# A location that hides its cities behind a count.
OPAQUE_LOCATION_PATTERN = r"^\d+\s+locations?$"

# The priority region, its ring cities, and the states that share their names.
PRIORITY_NAMES = ("delaware", "philadelphia", "pennsylvania")
PRIORITY_CODES = ("DE", "PA")
RING_CITIES = ("wilmington", "newark")
NAMESAKE_STATES = (
    "new jersey", "north carolina", "massachusetts", "ohio", "new york", "maryland", "virginia",
)

# Location buckets of the tracker, first hit wins.
LOCATION_BUCKETS = (
    ("Remote", ("remote",)),
    ("Delaware", ("delaware", "wilmington", "newark")),
)
LOCATION_BUCKET_DEFAULT = "Other"
