"""Default source list and paging bounds.

Each feed format has its own way of saying where a board lives:

* ``workday``: tenant, data centre, site
* ``greenhouse``: board token
* ``lever``: board token
* ``oracle``: host, site
* ``icims``: host (no reader; such a source yields no rows)
"""

from __future__ import annotations

YES, UNKNOWN = "Yes", "Unknown"

# Search terms of the formats that are polled per term, in order.
SEARCH_TERMS = ("software engineer", "data engineer", "data scientist", "analyst")

# Page size per format that is paged.
PAGE_SIZES = {"workday": 20, "oracle": 25}

# Offsets at which a poll stops asking, per format, where a run is told to have such caps.
OFFSET_CAPS = {"workday": 200, "oracle": 100}

# What pages whose source is not listed are reported under.
UNKNOWN_SOURCE = "unknown source"

# Default sources in polling order
# (name, format, address parts, e-verify guess, sponsors guess, cap exempt).
SOURCES = (
    ("AstraZeneca", "workday", ("astrazeneca", "wd3", "Careers"), YES, YES, False),
    ("Capital One", "workday", ("capitalone", "wd12", "Capital_One"), YES, YES, False),
    ("ChristianaCare", "workday", ("christianacare", "wd5", "CCHS"), UNKNOWN, UNKNOWN, True),
    ("DuPont", "workday", ("dupont", "wd5", "Jobs"), YES, UNKNOWN, False),
    ("WSFS Bank", "workday", ("wsfsbank", "wd1", "wsfscareers"), UNKNOWN, UNKNOWN, False),
    ("M&T Bank", "workday", ("mtb", "wd5", "MTB"), UNKNOWN, UNKNOWN, False),
    ("Barclays", "workday", ("barclays", "wd3", "external_career_site_barclays"), YES, YES, False),
    ("Citi", "workday", ("citi", "wd5", "2"), YES, YES, False),
    ("Vanguard", "workday", ("vanguard", "wd5", "vanguard_external"), YES, UNKNOWN, False),
    ("Comcast", "workday", ("comcast", "wd5", "Comcast_Careers"), YES, YES, False),
    ("Corteva", "workday", ("corteva", "wd5", "Corteva"), YES, UNKNOWN, False),
    ("Solenis", "workday", ("solenis", "wd1", "Solenis"), YES, UNKNOWN, False),
    ("W.L. Gore", "workday", ("johngore", "wd1", "Careers"), YES, UNKNOWN, False),
    ("Navient", "workday", ("navient", "wd1", "Navient_Jobs"), YES, UNKNOWN, False),
    ("NVIDIA", "workday", ("nvidia", "wd5", "NVIDIAExternalCareerSite"), YES, YES, False),
    ("Salesforce", "workday", ("salesforce", "wd12", "External_Career_Site"), YES, YES, False),
    ("Adobe", "workday", ("adobe", "wd5", "external_experienced"), YES, YES, False),
    ("Pfizer", "workday", ("pfizer", "wd1", "PfizerCareers"), YES, YES, False),
    ("GSK", "workday", ("gsk", "wd5", "GSKCareers"), YES, YES, False),
    ("Cisco", "workday", ("cisco", "wd5", "Cisco_Careers"), YES, YES, False),
    ("PayPal", "workday", ("paypal", "wd1", "jobs"), YES, YES, False),
    ("Workday Inc", "workday", ("workday", "wd5", "Workday"), YES, YES, False),
    ("Affirm", "greenhouse", ("affirm",), YES, YES, False),
    ("Reddit", "greenhouse", ("reddit",), YES, YES, False),
    ("Robinhood", "greenhouse", ("robinhood",), YES, YES, False),
    ("Datadog", "greenhouse", ("datadog",), YES, YES, False),
    ("Databricks", "greenhouse", ("databricks",), YES, YES, False),
    ("GitLab", "greenhouse", ("gitlab",), YES, YES, False),
    ("Stripe", "greenhouse", ("stripe",), YES, YES, False),
    ("Airbnb", "greenhouse", ("airbnb",), YES, YES, False),
    ("Lyft", "greenhouse", ("lyft",), YES, YES, False),
    ("Instacart", "greenhouse", ("instacart",), YES, YES, False),
    ("Pinterest", "greenhouse", ("pinterest",), YES, YES, False),
    ("Dropbox", "greenhouse", ("dropbox",), YES, YES, False),
    ("Twilio", "greenhouse", ("twilio",), YES, YES, False),
    ("Asana", "greenhouse", ("asana",), YES, YES, False),
    ("Figma", "greenhouse", ("figma",), YES, YES, False),
    ("Chime", "greenhouse", ("chime",), YES, YES, False),
    ("Discord", "greenhouse", ("discord",), YES, YES, False),
    ("SoFi", "greenhouse", ("sofi",), YES, YES, False),
    ("Roblox", "greenhouse", ("roblox",), YES, YES, False),
    ("Anthropic", "greenhouse", ("anthropic",), YES, YES, False),
    ("Samsara", "greenhouse", ("samsara",), YES, YES, False),
    ("Scale AI", "greenhouse", ("scaleai",), YES, YES, False),
    ("Brex", "greenhouse", ("brex",), YES, YES, False),
    ("Fivetran", "greenhouse", ("fivetran",), YES, YES, False),
    ("Thoughtworks", "greenhouse", ("thoughtworks",), YES, YES, False),
    ("Gusto", "greenhouse", ("gusto",), YES, YES, False),
    ("Faire", "greenhouse", ("faire",), YES, YES, False),
    ("Carta", "greenhouse", ("carta",), YES, YES, False),
    ("Checkr", "greenhouse", ("checkr",), YES, YES, False),
    ("Airtable", "greenhouse", ("airtable",), YES, YES, False),
    ("Spotify", "lever", ("spotify",), YES, YES, False),
    ("JPMorgan Chase", "oracle", ("jpmc.fa.oraclecloud.com", "CX_1001"), YES, YES, False),
    ("JPMorgan Chase", "oracle", ("jpmc.fa.oraclecloud.com", "CX_1002"), YES, YES, False),
    ("Incyte", "icims", ("careers-incyte.icims.com",), YES, YES, False),
)
