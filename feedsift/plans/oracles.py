"""Reference SQL of the registered queries, for DuckDB.

Written row by row from the meaning of each operator, with other means than
the Spark side where there are any: window frames for the bounded pull, one
test per term instead of one prefix pattern, recursion for the chunks.
"""

from __future__ import annotations

from feedsift.plans import queries as q
from feedsift.operators.rule_table import profile_rows
from feedsift.plans import views
from feedsift.rules import feeds, profiles, regions, signals
from feedsift.rules.profiles import RuleProfile
from feedsift.rules.skills import SKILLS

_SPACE = (
    r"\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
_FLAGGED = "flag_status = 'no'"


# --- SQL pieces ----------------------------------------------------------------


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _pattern(pattern: str, ignore_case: bool = False) -> str:
    # RE2's \b is ASCII already; only whitespace has to be spelled out.
    spelled = pattern.replace(r"[\s-]", f"[{_SPACE}-]").replace(r"\s", f"[{_SPACE}]")
    return _lit(("(?i)" if ignore_case else "") + spelled)


def _found(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches(coalesce({text}, ''), {_pattern(pattern, ignore_case)})"


def _any(tests) -> str:
    return "(" + " OR ".join(tests or ["false"]) + ")"


def _holds(text: str, terms) -> str:
    return _any([f"contains(lower(coalesce({text}, '')), {_lit(t)})" for t in terms])


def _words(words, case=str) -> str:
    return r"\b(?:" + "|".join(case(w) for w in words) + r")\b"


def _title_excluded(profile: RuleProfile, title: str = "title") -> str:
    lowered = f"lower({title})"
    exempt = _found(lowered, profiles.EXEMPT_PATTERN)
    tests = []
    for term in profile.exclude:
        test = _found(lowered, rf"\b{term}\b")
        tests.append(f"({test} AND NOT {exempt})" if term in profiles.EXEMPT_TERMS else test)
    return _any(tests)


def _looks_us(loc: str = "location") -> str:
    return _any([
        _found(f"lower({loc})", regions.US_COUNTRY_PATTERN),
        _found(f"lower({loc})", regions.US_REMOTE_PATTERN),
        _holds(loc, regions.US_STATE_NAMES),
        _found(loc, _words(regions.US_STATE_CODES)),
    ])


def _trimmed(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), {_pattern(r'^\s+|\s+$')}, '', 'g')"


def _allowed(loc: str = "location") -> str:
    return _any([
        f"{_trimmed(loc)} = ''",
        _found(_trimmed(loc), regions.OPAQUE_LOCATION_PATTERN),
        _looks_us(loc),
    ])


def _blocked(loc: str = "location") -> str:
    return _holds(loc, profiles.BLOCK_TERMS)


def _matches(profile: RuleProfile) -> str:
    return (
        f"({_holds('title', profile.include)} AND NOT {_title_excluded(profile)} "
        f"AND NOT {_blocked()} AND {_allowed()})"
    )


def _near(loc: str = "location") -> str:
    others = [c for c in regions.US_STATE_CODES if c not in regions.PRIORITY_CODES]
    signal = _any([
        _found(loc, _words(regions.PRIORITY_NAMES), True),
        _found(loc, rf",\s*(?:{'|'.join(regions.PRIORITY_CODES)})\b", True),
    ])
    elsewhere = _any([
        _found(loc, rf",\s*(?:{'|'.join(others)})\b", True),
        _found(loc, _words(regions.NAMESAKE_STATES), True),
    ])
    return f"({signal} OR ({_found(loc, _words(regions.RING_CITIES), True)} AND NOT {elsewhere}))"


def _by_region() -> str:
    return f"CASE WHEN {_near()} THEN {_matches(profiles.LOCAL)} ELSE {_matches(profiles.STRICT)} END"


def _age(posted: str = "posted_on") -> str:
    s = _trimmed(posted)
    ago, iso = _pattern(signals.DAYS_AGO_PATTERN), _pattern(signals.ISO_DATE_PATTERN)

    def part(n: int) -> str:
        return f"TRY_CAST(regexp_extract({s}, {iso}, {n}) AS INTEGER)"

    day = (
        f"make_date(CASE WHEN {part(1)} < 100 THEN 1900 + {part(1)} ELSE {part(1)} END, 1, 1) "
        f"+ to_months({part(2)} - 1) + to_days({part(3)} - 1)"
    )
    return (
        f"CAST(CASE WHEN contains({s}, 'today') THEN 0 WHEN contains({s}, 'yesterday') THEN 1 "
        f"WHEN regexp_matches({s}, {ago}) THEN CAST(regexp_extract({s}, {ago}, 1) AS BIGINT) "
        f"WHEN regexp_matches({s}, {iso}) THEN "
        f"greatest(0, date_diff('day', CAST({day} AS DATE), DATE '{views.AS_OF}')) END AS BIGINT)"
    )


def _money(text: str) -> str:
    parts = _pattern(signals.AMOUNT_PARTS_PATTERN)
    return (
        f"CASE WHEN regexp_extract({text}, {parts}, 1) <> '' THEN "
        f"CAST(replace(regexp_extract({text}, {parts}, 1), ',', '') AS DOUBLE) "
        f"* CASE WHEN regexp_extract({text}, {parts}, 2) <> '' THEN 1000 ELSE 1 END END"
    )


def _reason(text: str = "description") -> str:
    cases = " ".join(
        f"WHEN {_found(text, pattern, True)} THEN {_lit(reason)}"
        for pattern, reason in signals.FLAG_RULES
    )
    return f"CASE {cases} END"


def _remote(text: str = "description") -> str:
    return _any([_found(text, p, True) for p in signals.REMOTE_PATTERNS])


def _band(amount: str) -> str:
    cases = " ".join(f"WHEN {amount} >= {floor} THEN {_lit(t)}" for floor, t in signals.WAGE_BANDS)
    return f"CASE {cases} END"


def _strip(html: str) -> str:
    no_tags = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({no_tags}, {_pattern(r'\s+')}, ' ', 'g'))"


def _decode(html: str) -> str:
    out = html
    for pattern, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("(?i)&#x27;", "'"),
        ("&nbsp;", " "), ("&amp;", "&"),
    ):
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(char)}, 'g')"
    return out


def _escape(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _meta() -> str:
    return f"""concat_ws(' · ',
      CASE WHEN cap_exempt THEN {_lit(signals.CAP_EXEMPT_MARK)} END,
      CASE WHEN remote THEN {_lit(signals.REMOTE_MARK)} END,
      '{signals.SALARY_MARK}' || nullif(salary, ''),
      {_band(_money("salary"))},
      nullif(posted_on, ''),
      CASE WHEN {_FLAGGED} THEN '{signals.FLAG_TEXT}' || coalesce(' — ' || nullif(flag_reason, ''), '') END)"""


# --- common table expressions ----------------------------------------------------

_POSTINGS = f"p AS ({views.POSTINGS_SQL.format(orders='orders')})"
_PAGES = f"pages_raw AS ({views.PAGES_SQL.format(orders='orders')})"


def _sources() -> str:
    rows = ", ".join(
        f"({n}, {_lit(name)}, {_lit(ats)}, {', '.join(_lit(a) for a in (*address, None, None)[:3])}, "
        f"{_lit(everify)}, {_lit(sponsors)}, {exempt})"
        for n, (name, ats, address, everify, sponsors, exempt) in enumerate(feeds.SOURCES)
    )
    return (
        "src(source_ord, company, ats, a0, a1, a2, everify_guess, sponsors_guess, cap_exempt) "
        f"AS (VALUES {rows})"
    )


def _best_money(source: str, key: str, text: str) -> str:
    """CTEs ending in ``best`` (key, salary)."""
    amounts = _pattern(signals.AMOUNT_OR_RANGE_PATTERN)
    shown = f"trim(regexp_replace(hit, {_pattern(r'\s+')}, ' ', 'g'))"
    return f"""
hits AS (SELECT {key}, unnest(regexp_extract_all({text}, {amounts})) AS hit,
                generate_subscripts(regexp_extract_all({text}, {amounts}), 1) AS pos FROM {source}),
shown AS (SELECT {key}, pos, {shown} AS salary FROM hits),
scored AS (SELECT *, CASE WHEN {_found("salary", signals.RANGE_MARK_PATTERN)} THEN 1e12 ELSE 0 END
                     + coalesce({_money("salary")}, 0) AS score FROM shown),
best AS (SELECT {key}, salary FROM (
           SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, pos) AS rn FROM scored)
         WHERE rn = 1)"""


def _enriched(source: str) -> str:
    """CTEs ending in ``enriched``: ``source`` with the description's signals."""
    return f"""{_best_money(source, "seq", "description")},
enriched AS (SELECT s.*, best.salary, {_reason()} AS flag_reason,
                    CASE WHEN {_reason()} IS NULL THEN 'unknown' ELSE 'no' END AS flag_status,
                    CASE WHEN description IS NOT NULL THEN {_remote()} END AS remote
             FROM {source} s LEFT JOIN best USING (seq))"""


def _detailed(source: str) -> str:
    """CTEs ending in ``detailed``: ``source`` with the description and place of its latest detail."""
    body = f"coalesce({views.feed_body_sql(1)}, '')"
    return f"""
keyed AS (SELECT *, CASE WHEN coalesce(description, '') <> '' THEN NULL
                         WHEN contains(coalesce(url, ''), 'myworkdayjobs.com') THEN url
                         ELSE coalesce(nullif(oracle_detail, ''), nullif(detail_api, '')) END AS detail_key FROM {source}),
counted AS (SELECT *, TRY_CAST(regexp_extract(regexp_replace(detail_key, '%22,.*', ''), '([0-9]+)$', 1) AS BIGINT) AS no FROM keyed),
known AS (SELECT *, coalesce(NOT ({views.FEED_DETAIL_MISSING}) AND NOT ({views.FEED_DETAIL_BROKEN}), false) AS found FROM counted),
detailed AS (SELECT * EXCLUDE (detail_key, no, found, description, location),
  CASE WHEN coalesce(description, '') <> '' THEN description WHEN found THEN {_strip(_decode(body))} END AS description,
  CASE WHEN found AND no % 3 = 0 THEN 'Dover, DE' WHEN found AND no % 3 = 2 THEN 'Oslo' ELSE location END AS location
  FROM known)"""


def _selected(
    source: str = "p", key: str = "company || ':' || id", place: str = "seq", details: bool = False
) -> str:
    """CTEs ending in ``selected``: every stage of a run over ``source``."""
    attached = f"{_detailed('young')}," if details else ""
    return f"""
kept AS (SELECT * FROM {source} WHERE {_by_region()}),
numbered AS (SELECT *, {key} AS listing_key,
                    row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) AS rn,
                    min({place}) OVER (PARTITION BY {key}) AS first_seq FROM kept),
aged AS (SELECT *, {_age()} AS age_days FROM numbered WHERE rn = 1),
young AS (SELECT * FROM aged WHERE age_days IS NULL OR age_days <= {signals.MAX_AGE_DAYS}),
{attached}
{_enriched("detailed" if details else "young")},
selected AS (SELECT * FROM enriched
             WHERE NOT {_blocked()} AND (coalesce(remote, false) OR {_allowed()}))"""


_RANKED = f"""
ranked AS (SELECT *, CASE WHEN {_FLAGGED} THEN 1 ELSE 0 END AS rank_flagged,
                  CASE WHEN {_near()} THEN 0 ELSE 1 END AS rank_elsewhere,
                  CASE WHEN cap_exempt THEN 0 ELSE 1 END AS rank_not_exempt,
                  coalesce({_money("salary")}, 0.0) AS rank_floor,
                  coalesce(age_days, {signals.UNKNOWN_AGE_RANK}) AS rank_age FROM selected),
ordered AS (SELECT *, row_number() OVER (ORDER BY rank_flagged, rank_elsewhere, rank_not_exempt,
                    rank_floor DESC, rank_age, first_seq) AS rank_no,
                   count(*) OVER () AS n_all FROM ranked),
top AS (SELECT *, greatest(n_all - {signals.MAX_SHOWN}, 0) AS extra FROM ordered
        WHERE rank_no <= {signals.MAX_SHOWN})"""

_DIGEST = f"""
entries AS (SELECT rank_no, extra, flag_status, {_meta()} AS meta,
                   CASE WHEN {_FLAGGED} THEN '⛔ ' ELSE '' END AS tag,
                   {_escape("coalesce(company, '')")} AS c, {_escape("coalesce(title, '')")} AS t,
                   {_escape("coalesce(location, '')")} AS l, coalesce(url, '') AS u FROM top),
digest AS (
  SELECT count(*) AS n_shown, max(extra) AS extra,
         (count(*) + max(extra)) || ' new role(s)' AS head,
         count(*) FILTER (WHERE flag_status <> 'no') || ' sponsorable, '
           || count(*) FILTER (WHERE flag_status = 'no') || ' flagged' AS counts,
         CASE WHEN max(extra) > 0 THEN '…and ' || max(extra) || ' more — see the tracker.' END AS more,
         string_agg(tag || '<b>' || c || '</b>: ' || t || chr(10) || '  ' || l
           || CASE WHEN meta <> '' THEN chr(10) || '  ' || {_escape("meta")} ELSE '' END
           || chr(10) || '  ' || u, chr(10) || chr(10) ORDER BY rank_no) AS body,
         string_agg('<li>' || tag || '<strong>' || c || '</strong> — <a href="' || u || '">' || t
           || '</a><br><small>' || l || CASE WHEN meta <> '' THEN ' · ' || {_escape("meta")} ELSE '' END
           || '</small></li>', '' ORDER BY rank_no) AS items
  FROM entries HAVING count(*) > 0),
message AS (SELECT n_shown, extra, '🔔 ' || head || ' — ' || counts || ':' || chr(10) || chr(10) || body
                   || coalesce(chr(10) || chr(10) || more, '') AS text_message,
                   '<p>' || head || ' matched — ' || counts || ':</p><ul>' || items || '</ul>'
                   || coalesce('<p>' || more || '</p>', '') AS html_message FROM digest)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _run(tail: str, *more: str) -> str:
    return _with(_POSTINGS, _selected(), *more) + tail


def _listing(name: str, expression: str) -> str:
    return f"{_with(_POSTINGS)}SELECT seq, {expression} AS {name} FROM p"


# --- feeds -----------------------------------------------------------------------


def _field(name: str) -> str:
    return views.feed_field_sql(name, "k")


_TERM = "run_id, source_ord, term_key"
_CAPPED = "WHERE cap IS NULL OR page_offset < cap"
_PULLED = f"""
{_PAGES},
stats AS (SELECT *, flag_failed OR broken AS failed,
                 CASE WHEN flag_failed OR broken THEN 0 ELSE n_rows END AS n_read,
                 CASE WHEN ats IN ('workday', 'oracle') THEN term_no ELSE -1 END AS term_key,
                 CASE ats WHEN 'workday' THEN 20 WHEN 'oracle' THEN 25 END AS page_size,
                 CASE ats WHEN 'workday' THEN 200 WHEN 'oracle' THEN 100 END AS cap FROM pages_raw),
walked AS (SELECT *, page_size IS NULL OR coalesce(bool_and(
                       NOT failed AND n_read > 0 AND page_offset + page_size < coalesce(total, 0))
                     OVER (PARTITION BY {_TERM} ORDER BY page_offset
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached
           FROM stats {_CAPPED}),
pulled AS (SELECT *, bool_or(failed) OVER (PARTITION BY {_TERM}) AS term_failed
           FROM walked WHERE reached)"""


_ALL_PULLED = _PULLED.replace(_CAPPED, "")


def _listings(source: str) -> str:
    """CTEs ending in ``listed``: the listings of the pages in ``source``."""
    item, bullet = _field("item"), _field("bullet")
    created = f"({_field('created')})"
    lever_day = f"CAST(DATE '1970-01-01' + CAST(floor({created} / 86400000) AS INTEGER) AS VARCHAR)"
    oracle_id = f"{item} || '%22,siteNumber=' || a1"
    detail = "/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?expand=all&finder=ById;Id=%22"
    return f"""
{_sources()},
slots AS (SELECT s.*, unnest(range(CASE WHEN failed THEN 0 ELSE n_read END)) AS k FROM {source} s),
listed AS (
  SELECT run_id, source_ord, term_no, page_offset, k AS pos, src.company, src.ats, src.cap_exempt,
    CASE WHEN src.ats = 'workday' AND {bullet} = 0 THEN 'R' || {item}
         WHEN src.ats = 'workday' THEN '/job/' || {item} ELSE {item} END AS id,
    CASE WHEN src.ats = 'workday' THEN {_field("title")} ELSE coalesce({_field("title")}, '') END AS title,
    CASE WHEN src.ats = 'oracle' THEN
           concat_ws(' · ', nullif({_field("location")}, ''), nullif({_field("second")}, ''))
         ELSE coalesce({_field("location")}, '') END AS location,
    CASE src.ats WHEN 'workday' THEN
           'https://' || a0 || '.' || a1 || '.myworkdayjobs.com/' || a2 || '/job/' || {item}
         WHEN 'greenhouse' THEN 'https://boards.example.com/' || {item}
         WHEN 'lever' THEN 'https://jobs.example.com/' || {item}
         ELSE 'https://' || a0 || '/hcmUI/CandidateExperience/en/sites/' || a1 || '/job/' || {item} END AS url,
    CASE src.ats WHEN 'workday' THEN {_field("posted")}
         WHEN 'greenhouse' THEN substr({_field("iso")}, 1, 10)
         WHEN 'lever' THEN CASE WHEN {created} = 0 THEN '' ELSE {lever_day} END
         ELSE substr(CASE WHEN (page_key + k) % 2 = 0 THEN {_field("iso")} ELSE {_field("posted")} END, 1, 10)
         END AS posted_on,
    CASE WHEN src.ats = 'greenhouse' THEN
      'https://boards-api.greenhouse.io/v1/boards/' || a0 || '/jobs/' || {item} END AS detail_api,
    CASE WHEN src.ats = 'oracle' THEN 'https://' || a0 || '{detail}' || {oracle_id} END AS oracle_detail,
    CASE WHEN src.ats = 'lever' THEN coalesce({_field("description")}, '') END AS description
  FROM slots JOIN src USING (source_ord) WHERE src.ats <> 'icims')"""


_SEQ = "run_id, source_ord, term_no, page_offset, pos"
_PLACE = "term_no * 1000000000 + page_offset * 100000 + pos"


def _union(pulled: str = _PULLED) -> str:
    """CTEs ending in ``feeds``: all listings with their first place."""
    return f"""{pulled},
sound AS (SELECT * FROM pulled WHERE NOT term_failed),
{_listings("sound")},
placed AS (SELECT *, CASE WHEN ats IN ('workday', 'oracle') THEN id
                     ELSE concat_ws('|', id, term_no, page_offset, pos) END AS merge_id,
                  {_PLACE} AS place FROM listed),
merged AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_ord, merge_id ORDER BY place DESC) AS rn,
                  min(place) OVER (PARTITION BY run_id, source_ord, merge_id) AS first_place FROM placed),
feeds AS (SELECT * EXCLUDE (rn), first_place // 1000000000 AS first_term_no,
                 first_place // 100000 % 10000 AS first_page_offset,
                 first_place % 100000 AS first_pos FROM merged WHERE rn = 1)"""


def _normalised(ats: str) -> str:
    return f"""{_with(_PULLED, _listings("stats"))}
SELECT {_SEQ}, company, id, title, location, url, posted_on, detail_api, oracle_detail, description
FROM listed WHERE ats = '{ats}'"""


_DETAILS = f"""
detail_raw AS ({views.DETAIL_BASE_SQL.format(orders='orders')}),
details AS (
  SELECT detail_no, detail_key, ats,
    CASE ats WHEN 'workday' THEN {_strip(f"coalesce({views.WORKDAY_BODY}, '')")}
             WHEN 'greenhouse' THEN {_strip(_decode(f"coalesce({views.GREENHOUSE_BODY}, '')"))}
             ELSE {_strip("concat_ws(' ', " + ", ".join(views.ORACLE_BODIES) + ")")} END AS description,
    list_filter(CASE WHEN ats = 'greenhouse' THEN [place] ELSE [place, place2] END, lambda n: n <> '') AS names
  FROM detail_raw WHERE NOT broken)"""


# --- chunks ----------------------------------------------------------------------


def _chunks(source: str, key: str, body: str, limit: int) -> str:
    """CTE ``chunked`` (key, chunk_no, chunk): the fold as a recursion over lines.

    A line that ends its paragraph carries a paragraph break. ``para`` says how
    a whole paragraph is taken when it starts: joined, alone, or line by line.
    """
    keys = ", ".join(key.split())
    return f"""
whole AS (SELECT {keys}, {body} AS body FROM {source}),
paras AS (SELECT {keys}, unnest(string_split(body, chr(10) || chr(10))) AS para,
                 generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS para_no
          FROM whole WHERE length(body) > {limit}),
steps AS (SELECT {keys}, para_no, 0 AS line_no, para AS piece, true AS is_para FROM paras WHERE length(para) <= {limit}
          UNION ALL
          SELECT {keys}, para_no, generate_subscripts(string_split(para, chr(10)), 1),
                 unnest(string_split(para, chr(10))), false FROM paras WHERE length(para) > {limit}),
placed_steps AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY para_no, line_no) AS step_no,
                        coalesce(NOT is_para AND line_no = 1, false) AS opens FROM steps),
fold AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS step_no, '' AS buf, CAST([] AS VARCHAR[]) AS outs FROM whole WHERE length(body) > {limit}
  UNION ALL
  SELECT {", ".join("s." + k for k in key.split())}, s.step_no,
    CASE WHEN length(s.piece) > {limit} THEN ''
         WHEN f.buf = '' OR (s.opens) THEN s.piece
         WHEN length(f.buf) + (CASE WHEN s.is_para THEN 2 ELSE 1 END) + length(s.piece) <= {limit}
           THEN f.buf || (CASE WHEN s.is_para THEN chr(10) || chr(10) ELSE chr(10) END) || s.piece
         ELSE s.piece END,
    CASE WHEN f.buf <> '' AND (length(s.piece) > {limit} OR s.opens
              OR length(f.buf) + (CASE WHEN s.is_para THEN 2 ELSE 1 END) + length(s.piece) > {limit})
           THEN [f.buf] ELSE CAST([] AS VARCHAR[]) END
      || CASE WHEN length(s.piece) > {limit}
           THEN list_transform(range(CAST(ceil(length(s.piece) / {limit}.0) AS BIGINT)),
                               lambda i: substring(s.piece, CAST(i * {limit} + 1 AS BIGINT), {limit}))
           ELSE CAST([] AS VARCHAR[]) END
  FROM fold f JOIN placed_steps s ON {" AND ".join(f"s.{k} = f.{k}" for k in key.split())} AND s.step_no = f.step_no + 1),
emitted AS (SELECT {keys}, step_no, unnest(outs) AS chunk, generate_subscripts(outs, 1) AS sub_no FROM fold
            UNION ALL
            SELECT {keys}, step_no, buf, 1000000000 FROM (
              SELECT *, max(step_no) OVER (PARTITION BY {keys}) AS last_no FROM fold) WHERE step_no = last_no AND buf <> ''),
chunked AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY step_no, sub_no) - 1 AS chunk_no, chunk FROM emitted
            UNION ALL SELECT {keys}, 0, body FROM whole WHERE length(body) <= {limit})"""


def _skill_ctes(name: str, source: str, key: str, text: str) -> str:
    rules = ", ".join(f"({_lit(label)}, {_pattern(p, True)})" for label, p in SKILLS)
    return f"""
{name}_rules(label, pattern) AS (VALUES {rules}),
{name} AS (SELECT * FROM (
  SELECT {key}, label, CAST(len(regexp_extract_all({text}, pattern)) AS BIGINT) AS n
  FROM {source}, {name}_rules) WHERE n > 0)"""


_LABEL_ORDER = "n DESC, label COLLATE NOCASE"
_EVENT_KEYS = (
    "ev AS (SELECT event_id, ts, event_type || ':' || user_id AS listing_key, event_type, "
    f"user_id, ts < TIMESTAMP '{q.EVENT_CUTOFF}' AS early FROM events)"
)


def _url_oracle() -> str:
    link = (
        "CASE WHEN page_id % 4 = 0 THEN 'https://boards.greenhouse.io/b' || (page_id % 10) || '/jobs/' || page_id "
        "ELSE url END"
    )
    return f"""
WITH links AS (SELECT page_id, {link} AS link FROM pages),
cut AS (SELECT page_id, link, lower(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1)) AS host,
               list_filter(string_split(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
        FROM links)
SELECT page_id, string_split(host, '.')[1] AS tenant, seg[1] AS site,
       '/' || coalesce(array_to_string(seg[2:], '/'), '') AS rest,
       nullif(regexp_extract(link, 'greenhouse\\.io/([^/]+)/jobs/(\\d+)', 1), '') AS board,
       nullif(regexp_extract(link, 'greenhouse\\.io/([^/]+)/jobs/(\\d+)', 2), '') AS listing
FROM cut"""


def _rule_table() -> str:
    """Every listing against every rule of the table."""
    fixed = ", ".join(f"({_lit(kind)}, {_lit(term)})" for _, kind, _, term in profile_rows("wide", profiles.STRICT))
    waived = ", ".join(map(_lit, profiles.EXEMPT_TERMS))
    exempt = _found("title_low", profiles.EXEMPT_PATTERN)
    return f"""
WITH listings AS (SELECT *, lower(coalesce(title, '')) AS title_low, lower(coalesce(location, '')) AS place_low
                  FROM ({views.RULE_LISTINGS_SQL.format(orders='orders')})),
rules AS (SELECT DISTINCT kind, lower(term) AS term FROM (
  SELECT * FROM (VALUES {fixed}) AS fixed(kind, term) UNION ALL {views.CUSTOMER_RULES_SQL.format(customer='customer')})),
hits AS (SELECT seq, kind, term FROM listings JOIN rules
         ON contains(CASE WHEN kind IN ('include', 'exclude') THEN title_low ELSE place_low END, term)
         WHERE kind <> 'exclude' OR regexp_matches(title_low, '\\b' || regexp_escape(term) || '\\b'))
SELECT seq, title, location FROM listings
WHERE seq IN (SELECT seq FROM hits WHERE kind = 'include') AND seq NOT IN (SELECT seq FROM hits WHERE kind = 'block')
AND seq NOT IN (SELECT seq FROM hits JOIN listings USING (seq) WHERE kind = 'exclude' AND NOT (term IN ({waived}) AND {exempt}))
AND {_allowed()}"""


_STATUS = """
unit_status AS (SELECT run_id, source_ord, term_key, bool_or(failed) AS term_failed FROM pulled GROUP BY ALL),
source_state AS (SELECT run_id, source_ord, bool_and(term_failed) AS source_failed FROM unit_status GROUP BY ALL)"""


_TRACKER = f"""'owner' AS user_id, n.company, title AS role,
       CASE WHEN contains(lower(coalesce(location, '')), 'remote') THEN 'Remote'
            WHEN {_holds("location", ("delaware", "wilmington", "newark"))} THEN 'Delaware' ELSE 'Other' END AS location,
       'Wishlist' AS status, url AS link, coalesce(f.everify_guess, 'Unknown') AS everify,
       CASE WHEN {_FLAGGED} THEN 'No' ELSE coalesce(f.sponsors_guess, 'Unknown') END AS sponsors,
       concat_ws(' · ', 'Auto-added by monitor {views.AS_OF}', nullif(location, ''), nullif(posted_on, ''),
                 'Salary ' || nullif(salary, ''), CASE WHEN {_FLAGGED} THEN '⚠ ' || flag_reason END) AS notes"""


def _tracker_oracle() -> str:
    return f"""{_with(_POSTINGS, _selected(), _sources())},
named AS (SELECT s.* EXCLUDE (company), coalesce(src.company, s.company) AS company
          FROM selected s LEFT JOIN src ON src.source_ord = s.source_ord + s.seq % 3),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY source_ord) AS rn FROM src) WHERE rn = 1)
SELECT {_TRACKER} FROM named n LEFT JOIN firsts f ON f.company = n.company"""


_FEED_SEQ = "CAST(run_id * 1000000000000000 + source_ord * 1000000000000 AS BIGINT)"
_POLLS = f"polls AS (SELECT *, {_FEED_SEQ} + place AS seq, {_FEED_SEQ} + first_place AS place_seq FROM feeds)"


def _runs(*more: str) -> str:
    """CTEs ending in ``firsts``: each poll selects for itself; a key belongs to the first poll that selects it."""
    key = "run_id % 4 || '|' || company || ':' || id"
    return _with(
        f"{_union(_ALL_PULLED)},\n{_POLLS}",
        _selected("polls", key, "place_seq", details=True),
        """
marked AS (SELECT * REPLACE (company || ':' || id AS listing_key), run_id % 4 AS poll,
                  row_number() OVER (PARTITION BY company || ':' || id ORDER BY run_id % 4) AS first_no FROM selected),
firsts AS (SELECT * FROM marked WHERE first_no = 1)""",
        *more,
    )


def _incremental_tracker() -> str:
    """Run numbers begin anew with the second job, after half of the polls."""
    return f"""{_runs()},
names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY source_ord) AS rn FROM src) WHERE rn = 1)
SELECT poll % 2 AS run_id, {_TRACKER} FROM firsts n LEFT JOIN names f ON f.company = n.company"""


def _incremental_emails() -> str:
    one = "SELECT * FROM (" + _runs(
        "chosen AS (SELECT * FROM firsts WHERE poll = {poll})", _RANKED.replace("FROM selected)", "FROM chosen)"), _DIGEST
    ) + "SELECT (n_shown + extra) || ' new job match(es)' AS subject, html_message AS html FROM message)"
    return " UNION ALL ".join(one.replace("{poll}", str(poll)) for poll in range(q.N_POLLS))


def _incremental_counters() -> str:
    return f"""{_runs(_STATUS)},
numbers AS (SELECT unnest(range({q.N_POLLS})) AS poll)
SELECT (SELECT count(*) FROM polls WHERE run_id % 4 = n.poll) AS fetched,
       (SELECT count(*) FROM marked WHERE poll = n.poll) AS matched,
       (SELECT count(*) FROM marked WHERE poll = n.poll AND {_FLAGGED}) AS flagged,
       (SELECT count(*) FROM firsts WHERE poll = n.poll) AS fresh,
       (SELECT count(*) FROM firsts WHERE poll = n.poll) AS alertable,
       (SELECT count(*) FROM source_state WHERE source_failed AND run_id % 4 = n.poll) AS failed,
       (SELECT least(count(*), {signals.MAX_SHOWN}) FROM firsts WHERE poll = n.poll) AS shown,
       0 AS pages_left_out
FROM numbers n"""


def all_oracles() -> dict[str, str]:
    place_columns = "first_term_no, first_page_offset, first_pos"
    posting = (
        "company, ats, cap_exempt, id, title, location, url, posted_on, detail_api, oracle_detail, description"
    )
    enriched = _with(_POSTINGS, _enriched("p"))
    pages = "SELECT page_id, {0} AS text FROM pages"
    jd = f"jd AS (SELECT doc_id, {views.skill_text_sql('text', 'doc_id')} AS body FROM documents)"
    own = f"pg AS (SELECT page_id, {views.skill_text_sql('html', 'page_id * 3 + 1')} AS body FROM pages)"
    top, message = _run("", _RANKED), _run("", _RANKED, _DIGEST)
    money = _money("description")
    seen = f"{_runs()}SELECT listing_key, company, title, poll % 2 AS run_id FROM firsts"
    return {
        **{f"norm_{ats}": _normalised(ats) for ats in ("workday", "greenhouse", "lever", "oracle")},
        "detail_flatten": f"""{_with(_DETAILS)}
SELECT detail_no, ats, description, coalesce(array_to_string(names, '|'), '') AS locations,
       CAST(len(names) AS BIGINT) AS n_locations FROM details""",
        "union_feeds": f"{_with(_union())}SELECT {_SEQ}, {place_columns}, {posting} FROM feeds",
        "stamp_source_attr": f"""{_with(_POSTINGS, _sources())}
SELECT source_ord, seq, src.company, ats, coalesce(src.cap_exempt, false) AS cap_exempt
FROM p LEFT JOIN src USING (source_ord)""",
        "unbounded_pull": f"""{_with(_ALL_PULLED)}
SELECT run_id, source_ord, term_no, page_offset, n_read AS n_rows, failed, term_failed FROM pulled""",
        "bounded_pull": f"""{_with(_PULLED)}
SELECT run_id, source_ord, term_no, page_offset, n_read AS n_rows, failed, term_failed FROM pulled""",
        "term_union_dedup": f"""{_with(_union())}
SELECT {_SEQ}, id, title, {place_columns} FROM feeds WHERE ats IN ('workday', 'oracle')""",
        **dict.fromkeys(("attach_detail", "attach_detail_store"), f"""{_with(_POSTINGS, _DETAILS)},
keyed AS (SELECT *, CASE WHEN seq % 7 < 2 THEN nullif(description, '') END AS inline,
                 CASE WHEN seq % 3 < 2 OR seq % 5 <> 0 THEN seq END AS detail_no FROM p)
SELECT seq, CASE WHEN inline IS NULL AND len(d.names) > 0 THEN array_to_string(d.names, ' · ') ELSE location END AS location,
       coalesce(inline, d.description) AS description, inline IS NOT NULL OR d.description IS NOT NULL AS has_detail
FROM keyed k LEFT JOIN details d USING (detail_no)"""),
        "html_strip": pages.format(_strip("html")),
        "html_decode": pages.format(_decode("html")),
        "html_escape": pages.format(_escape("html")),
        "doc_chunks": f"""WITH RECURSIVE {_chunks("documents", "doc_id", "text", q.DOC_CHUNK_LIMIT)}
SELECT doc_id, chunk_no, chunk FROM chunked""",
        "doc_paragraph_chunks": f"""WITH RECURSIVE cut AS (SELECT doc_id, {views.PARAGRAPHS_SQL} AS text FROM documents),
{_chunks("cut", "doc_id", "text", q.DOC_CHUNK_LIMIT)}
SELECT doc_id, chunk_no, chunk FROM chunked""",
        "enrich_documents": f"""WITH told AS (SELECT doc_id AS seq, {views.DOCUMENT_DESCRIPTION_SQL} AS description FROM documents),
{_enriched("told")}
SELECT seq, flag_status, flag_reason, salary, CAST(remote AS VARCHAR) AS remote FROM enriched""",
        "conv_chunks": f"""WITH RECURSIVE {_chunks("conversations", "conv_id turn", "text", q.TURN_CHUNK_LIMIT)}
SELECT conv_id, turn, chunk_no, chunk FROM chunked""",
        "title_include": _listing("included", _holds("title", profiles.STRICT.include)),
        "title_exclude": _listing("excluded", _title_excluded(profiles.LOCAL)),
        "exclude_exemption": _listing("excluded", _title_excluded(profiles.STRICT)),
        "geo_block": _listing("blocked", _blocked()),
        "geo_in_region": _listing("in_region", _looks_us()),
        "geo_allow": _listing("allowed", _allowed()),
        "match_profile": f"{_with(_POSTINGS)}SELECT seq, title, location FROM p WHERE {_matches(profiles.STRICT)}",
        "match_profile_table": _rule_table(),
        "match_by_region": f"{_with(_POSTINGS)}SELECT seq, title, location FROM p WHERE {_by_region()}",
        "priority_region": _listing("near", _near()),
        "recency_filter": f"""{_with(_POSTINGS)}
SELECT * FROM (SELECT seq, posted_on, CAST({_age()} AS DOUBLE) AS age_days FROM p) WHERE age_days IS NULL OR age_days <= 14""",
        "geo_recheck": f"""{enriched}SELECT seq, location, CAST(remote AS VARCHAR) AS remote FROM enriched
WHERE NOT {_blocked()} AND (coalesce(remote, false) OR {_allowed()})""",
        "skip_flagged": f"{enriched}SELECT seq, flag_status FROM enriched WHERE flag_status <> 'no'",
        "detect_remote": _listing("remote", _remote()),
        "posted_age": _listing("age_days", f"CAST({_age()} AS DOUBLE)"),
        "money_value": _listing("amount", money),
        "money_best": f"{enriched}SELECT seq, salary FROM enriched",
        "classify_rules": f"{enriched}SELECT seq, flag_reason, flag_status FROM enriched",
        "wage_band": _listing("band", _band(money)),
        "location_bucket": _listing(
            "bucket",
            "CASE WHEN contains(lower(coalesce(location, '')), 'remote') THEN 'Remote' WHEN "
            f"{_holds('location', ('delaware', 'wilmington', 'newark'))} THEN 'Delaware' ELSE 'Other' END",
        ),
        "dedup_keep_last": f"""{_with(_POSTINGS)}
SELECT listing_key, seq, first_seq, title, location FROM (
  SELECT *, company || ':' || id AS listing_key,
         row_number() OVER (PARTITION BY company, id ORDER BY seq DESC) AS rn,
         min(seq) OVER (PARTITION BY company, id) AS first_seq FROM p) WHERE rn = 1""",
        "skill_counts": f"""{_with(jd, _skill_ctes("hits", "jd", "doc_id", "body"))}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_LABEL_ORDER}) - 1 AS INTEGER) AS hit_no, label, n
FROM hits""",
        "enrich_text": f"{enriched}SELECT seq, flag_status, flag_reason, salary, CAST(remote AS VARCHAR) AS remote FROM enriched",
        "meta_line": f"{enriched}SELECT seq, {_meta()} AS meta FROM enriched",
        "url_parts": _url_oracle(),
        "seen_diff": f"""{_with(_EVENT_KEYS)}
SELECT event_id, listing_key FROM ev WHERE NOT early
AND listing_key NOT IN (SELECT listing_key FROM ev WHERE early)""",
        "lookup_first": """
SELECT c_custkey, c_nationkey % 7 AS group_key, coalesce(
  (SELECT n_name FROM nation WHERE n_regionkey = c_nationkey % 7 ORDER BY n_nationkey LIMIT 1), 'Unknown') AS n_name
FROM customer""",
        **dict.fromkeys(("skills_missing", "skills_missing_files"), f"""{_with(jd, own, _skill_ctes("a", "jd", "doc_id", "body"), _skill_ctes("b", "pg", "page_id", "body"))}
SELECT doc_id AS pair_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_LABEL_ORDER}) - 1 AS INTEGER) AS label_no, label
FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = a.doc_id AND b.label = a.label)"""),
        "rank_rows": f"""{top}SELECT seq, first_seq, rank_flagged, rank_elsewhere, rank_not_exempt, rank_floor,
rank_age FROM ranked""",
        "ranked_positions": f"{top}SELECT rank_no, seq, first_seq FROM ordered",
        "topn_overflow": f"{top}SELECT rank_no, listing_key, title, salary, extra FROM top",
        "flag_breakdown": _run(
            "SELECT count(*) FILTER (WHERE flag_status <> 'no') AS n_open, "
            "count(*) FILTER (WHERE flag_status = 'no') AS n_flagged FROM selected"
        ),
        "source_counts": f"{_with(_union())}SELECT source_ord, count(*) AS n_rows FROM feeds GROUP BY source_ord",
        "run_counters": f"""{_with(_ALL_PULLED, _STATUS, _POSTINGS, _selected())}
SELECT (SELECT count(*) FROM p) AS fetched, count(*) AS matched,
       count(*) FILTER (WHERE flag_status = 'no') AS flagged,
       count(*) FILTER (WHERE source_ord % 5 <> 0) AS fresh,
       count(*) FILTER (WHERE source_ord % 5 <> 0) AS alertable,
       (SELECT count(*) FROM source_state WHERE source_failed) AS failed,
       least(count(*) FILTER (WHERE source_ord % 5 <> 0), 30) AS shown FROM selected""",
        "source_failures": f"""{_with(_ALL_PULLED, _STATUS, _sources())}
SELECT run_id, count(*) AS n_failed, '⚠️ ' || count(*) || ' sources failed to fetch this run: '
       || string_agg(company, ', ' ORDER BY source_ord) AS notice
FROM source_state JOIN src USING (source_ord) WHERE source_failed GROUP BY run_id HAVING count(*) >= 3""",
        "source_health": f"""{_with(_PULLED, _sources())},
runs AS (SELECT DISTINCT run_id FROM stats),
polled AS (SELECT run_id, source_ord, bool_or(NOT failed) AS any_ok,
                  max(CASE WHEN NOT failed THEN total END) AS total FROM stats GROUP BY ALL),
states AS (SELECT r.run_id, s.source_ord, s.company,
                  CASE WHEN s.ats <> 'workday' THEN 'not checked' WHEN coalesce(any_ok, false) THEN 'ok' ELSE 'bad' END AS status,
                  CAST(CASE WHEN s.ats = 'workday' THEN total END AS DOUBLE) AS total
           FROM runs r CROSS JOIN src s LEFT JOIN polled p ON p.run_id = r.run_id AND p.source_ord = s.source_ord)
SELECT *, count(*) FILTER (WHERE status = 'bad') OVER (PARTITION BY run_id) AS n_bad,
       count(*) FILTER (WHERE status = 'bad') OVER (PARTITION BY run_id) = 0 AS all_healthy FROM states""",
        "digest_text": f"{message}SELECT n_shown, extra, text_message FROM message",
        "digest_html": f"{message}SELECT n_shown, extra, html_message FROM message",
        "seen_upsert": f"""{_with(_EVENT_KEYS)}
SELECT listing_key, any_value(event_type) AS company, CAST(any_value(user_id) AS VARCHAR) AS title,
       min(ts) AS seen_at, CAST(CASE WHEN bool_or(early) THEN 0 ELSE 1 END AS BIGINT) AS run_id FROM ev GROUP BY listing_key""",
        "tracker_rows": _tracker_oracle(),
        "digest_parts": "WITH RECURSIVE " + ",\n".join(
            (_POSTINGS, _selected(), _RANKED, _DIGEST, _chunks("message", "n_shown", "text_message", q.PART_LIMIT))
        ) + "\nSELECT CAST(chunk_no AS INTEGER) AS part_no, chunk AS part FROM chunked",
        "preview_run": _run(f"SELECT company, title, location, {_meta()} AS meta, url FROM ranked", _RANKED),
        "feed_ranking": f"""{_with(f"{_union(_ALL_PULLED)},{_POLLS}", _selected("polls", place="place_seq"), _RANKED)}
SELECT rank_no, listing_key, title, greatest(n_all - 200, 0) AS extra FROM ordered WHERE rank_no <= 200""",
        "incremental_run": seen,
        "seed_run": seen,
        "incremental_tracker": _incremental_tracker(),
        "incremental_emails": _incremental_emails(),
        "incremental_counters": _incremental_counters(),
        "incremental_notices": f"""{_with(_ALL_PULLED, _STATUS, _sources())}
SELECT count(*) AS n_failed, '⚠️ ' || count(*) || ' sources failed to fetch this run: '
       || string_agg(company, ', ' ORDER BY source_ord) AS notice
FROM source_state JOIN src USING (source_ord) WHERE source_failed GROUP BY run_id HAVING count(*) >= 3""",
        "stream_dedup": f"""{_with(_EVENT_KEYS)}
SELECT listing_key, CAST(CASE WHEN bool_or(early) THEN 0 ELSE 1 END AS BIGINT) AS run_id FROM ev GROUP BY listing_key""",
    }
