"""Signals read from description text."""

from __future__ import annotations

# Ordered flag rules (pattern, reason); the first hit gives the reason.
FLAG_RULES = (
    (r"\bno\b[^.]{0,25}\bsponsorship\b", "no sponsorship"),
    (
        r"\bnot\b[^.]{0,40}\b(?:provide|offer|sponsor)\w*[^.]{0,25}\bsponsorship\b",
        "states it won't provide sponsorship",
    ),
    (
        r"\bsponsorship\b[^.]{0,25}\bnot\b[^.]{0,25}\b(?:available|offered|provided|considered|possible)\b",
        "sponsorship not available",
    ),
    (
        r"\bwithout\b[^.]{0,30}\bsponsorship\b",
        "requires work authorization without sponsorship",
    ),
    (
        r"\bnot\b[^.]{0,30}\brequir\w*\b[^.]{0,25}\bsponsor(?:ship|ing)?\b",
        "candidate must not require sponsorship",
    ),
    (
        r"\b(?:unable|not able|not in a position)\b[^.]{0,25}\bsponsor(?:ship|ing)?\b",
        "unable to sponsor",
    ),
    (r"\bnot\b[^.]{0,40}\bsponsor(?:ship|ing)?\b", "states it will not sponsor"),
    (
        r"\b(?:u\.?s\.?|united states)\s+citizen(?:ship)?\b[^.]{0,30}\b(?:required|only|must|mandatory)\b",
        "US citizenship required",
    ),
    (
        r"\bmust be (?:a |an )?(?:u\.?s\.?|united states)\s+citizen\b",
        "must be a US citizen",
    ),
    (r"\b(?:active |current )?security clearance\b", "requires security clearance"),
    (r"\bmust be (?:a )?u\.?s\.? person\b", "must be a US person"),
)
FLAGGED = "no"
UNFLAGGED = "unknown"

# Words every text hit by the rule of the same position must hold (ours: cheap
# tests that save the pattern scan on texts without them).
FLAG_RULE_NEEDS = (
    ("sponsorship", "no"),
    ("sponsorship", "not"),
    ("sponsorship", "not"),
    ("sponsorship", "without"),
    ("sponsor", "not", "requir"),
    ("sponsor",),
    ("sponsor", "not"),
    ("citizen",),
    ("citizen", "must be"),
    ("security clearance",),
    ("must be", "person"),
)

# Wording that marks the role itself as remote.
REMOTE_PATTERNS = (
    r"\b(?:fully|100%|completely)\s*remote\b",
    r"\bremote[\s-]?(?:eligible|position|role|opportunity|based)\b",
    r"\bwork(?:s|ing)? from home\b",
    r"\bthis (?:role|position|job) (?:is|can be|may be) (?:fully |100% )?remote\b",
    r"\bopen to (?:fully )?remote\b",
    r"\bremote\b[^.]{0,25}\b(?:within|across|anywhere in)\b[^.]{0,12}\b(?:the )?(?:us|u\.s\.|united states)\b",
)
REMOTE_NEEDS = (("remote",), ("remote",), ("from home",), ("remote", "this "), ("open to ",), ("remote",))

# One dollar amount, its parts, and what makes a hit a range.
AMOUNT_PATTERN = r"\$\s?\d[\d,]*(?:\.\d+)?\s?[kK]?"
AMOUNT_PARTS_PATTERN = r"\$\s?(\d[\d,]*(?:\.\d+)?)\s?([kK])?"
AMOUNT_OR_RANGE_PATTERN = AMOUNT_PATTERN + r"(?:\s*(?:-|–|—|to)\s*" + AMOUNT_PATTERN + ")?"
RANGE_MARK_PATTERN = r"-|–|—|\bto\b"
RANGE_BONUS = 1e12

# Wage bands, highest first.
WAGE_BANDS = (
    (130000.0, "📈 high wage → strong H-1B lottery odds"),
    (105000.0, "📈 mid wage → decent H-1B odds"),
)

# Relative and ISO dates (tested on trimmed lower-case text).
DAYS_AGO_PATTERN = r"(\d+)\+?\s+days?\s+ago"
ISO_DATE_PATTERN = r"^(\d{4})-(\d{2})-(\d{2})(?:\D|$)"

# Run defaults.
MAX_AGE_DAYS = 14
MAX_SHOWN = 30
UNKNOWN_AGE_RANK = 999
MESSAGE_LIMIT = 4000
FAILURE_WARNING_AT = 3
PART_SEPARATOR = " · "

# Texts of the display line, digests and tracker rows.
CAP_EXEMPT_MARK = "✅ cap-exempt — no H-1B lottery"
REMOTE_MARK = "🏠 remote-eligible"
SALARY_MARK = "💲"
FLAG_MARK = "⛔"
FLAG_TEXT = "⛔ no sponsorship"
