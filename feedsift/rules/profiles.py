"""Title and location rule profiles."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RuleProfile:
    """Terms that decide whether a listing is kept.

    ``include``: the title holds at least one (substring).
    ``exclude``: the title holds none (whole word).
    ``allow``: the location holds one (substring); empty means the region test.
    ``block``: the location holds none (substring).
    """

    include: tuple[str, ...]
    exclude: tuple[str, ...]
    allow: tuple[str, ...]
    block: tuple[str, ...]


# Default location terms that are always turned away.
BLOCK_TERMS = (
    "india", "canada", "united kingdom", "ireland", "germany", "france", "spain",
    "italy", "netherlands", "poland", "romania", "ukraine", "portugal", "sweden",
    "switzerland", "belgium", "austria", "denmark", "norway", "finland", "czech",
    "hungary", "greece", "turkey", "israel", "united arab emirates", "dubai", "saudi",
    "qatar", "egypt", "south africa", "nigeria", "kenya", "argentina", "chile",
    "colombia", "peru", "mexico", "brazil", "costa rica", "panama", "south korea",
    "korea", "japan", "china", "taiwan", "hong kong", "malaysia", "indonesia",
    "thailand", "vietnam", "philippines", "singapore", "australia", "new zealand",
    "pakistan", "bangladesh", "sri lanka", "luxembourg", "scotland", "wales", "england",
    "emea", "apac", "latam", "europe", "middle east", "latin america",
    ", uk", "u.k.", ", on", ", bc",
    "hyderabad", "bangalore", "bengaluru", "pune", "chennai", "mumbai", "gurgaon",
    "gurugram", "noida", "telangana", "karnataka", "kolkata", "bucharest", "krakow",
    "wroclaw", "gdansk", "sao paulo", "são paulo", "toronto", "vancouver", "montreal",
    "tel aviv", "sydney", "melbourne", "tokyo", "beijing", "shanghai", "shenzhen",
    "manila", "cebu", "ho chi minh", "hanoi", "jakarta", "kuala lumpur", "bangkok",
    "seoul", "taipei", "guadalajara",
)

# The default profile.
STRICT = RuleProfile(
    include=(
        "software engineer", "software developer", "data engineer", "data scientist",
        "machine learning", "ml engineer", "backend engineer", "full stack", "fullstack",
        "analytics engineer", "data analyst", "business analyst", "business intelligence",
        "quantitative analyst", "risk analyst", "credit analyst",
    ),
    exclude=(
        "senior", "sr", "principal", "director", "manager", "lead", "staff", "vp", "head",
        "architect",
    ),
    allow=(),
    block=BLOCK_TERMS,
)

# The wider profile used inside the priority region.
LOCAL = RuleProfile(
    include=(
        "software engineer", "software developer", "developer", "data engineer",
        "data scientist", "machine learning", "analyst", "analytics",
        "business intelligence", "reporting", "insights",
    ),
    exclude=(
        "director", "vp", "head of", "chief", "president", "svp", "evp",
        "rn", "nurse", "nursing", "physician", "pharmacist", "therapist",
    ),
    allow=(),
    block=BLOCK_TERMS,
)

# Exclude terms that a seniority-like junior tier switches off.
EXEMPT_TERMS = ("senior", "sr")
EXEMPT_PATTERN = r"\b(?:senior|sr\.?)\s+associate\b"
