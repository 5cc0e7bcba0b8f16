"""Listing views derived from the order table, as SQL both engines read alike.

The given tables hold no job listings, so each order is read as one listing
(``postings_v``) or one landed page of a feed (``pages_v``): titles, places,
dates and descriptions are picked by the order key and filled with the order's
own price and date. Only ``%``, ``floor``, ``CASE``, casts and ``||`` are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.operators.enrich import detail_key
from feedsift.operators.rule_table import RULE_SCHEMA, profile_rows
from feedsift.rules.profiles import STRICT
from feedsift.sources.dimension import source_dimension
from feedsift.sources.landed import with_source
from feedsift.sources.payloads import explode_pages

AS_OF = "2001-08-02"
PAGES_PER_TERM, TERMS, N_SOURCES = 16, 4, 56
PAGES_PER_SOURCE = PAGES_PER_TERM * TERMS
PAGES_PER_RUN = PAGES_PER_SOURCE * N_SOURCES


def _pick(by: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {n} THEN {value}" for n, value in enumerate(values[:-1]))
    return f"CASE ({by}) % {len(values)} {cases} ELSE {values[-1]} END"


def _quoted(*values: str | None) -> list[str]:
    return ["CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in values]


def title_sql(by: str) -> str:
    return _pick(by, _quoted(
        "Software Engineer", "Senior Software Engineer", "Senior Associate, Data Analyst",
        "Data Analyst, Leadership Program", "Registered Nurse", None, "DATA ENGINEER II",
        "Lead Data Scientist", "Sr. Associate Machine Learning Manager", "Reporting Analyst",
        "VP, Data Analytics", "Full Stack Developer", "Business Analyst & <Planner>",
    ))


def location_sql(by: str) -> str:
    return _pick(by, _quoted(
        "Wilmington, DE", "Newark, NJ", "Austin, TX", "Hyderabad, Telangana", "Remote, India",
        "2 Locations", "", "Indianapolis, Indiana", "Santa Fe, New Mexico", "Remote - US",
        "Philadelphia", "Wilmington, North Carolina", None, "U.S.A", "Newark", "Casablanca",
        "Wilmington, DE · Jersey City, NJ",
    ))


def iso_day_sql(date: str) -> str:
    return f"CAST(CAST({date} AS DATE) AS STRING)"


def posted_sql(by: str, date: str) -> str:
    day = iso_day_sql(date)
    return _pick(by, [
        "'Posted Today'", "'Posted Yesterday'", "'Posted 5 Days Ago'", "'Posted 30+ Days Ago'",
        day, f"'2001-07-' || lpad(CAST(1 + ({by}) % 31 AS STRING), 2, '0')", "'recently'", "''",
        f"{day} || 'T12:00:00Z'", "'2000-13-45'", "' posted 1 day ago '",
    ])


def amount_sql(price: str, more: int = 0) -> str:
    whole = f"(CAST(floor({price}) AS BIGINT) + {more})"
    thousands = f"CAST(CAST(floor({whole} / 1000) AS BIGINT) AS STRING)"
    return f"'$' || {thousands} || ',' || lpad(CAST({whole} % 1000 AS STRING), 3, '0')"


def description_sql(by: str, price: str) -> str:
    low, high = amount_sql(price), amount_sql(price, 20000)
    return _pick(by, [
        f"'No visa sponsorship is available. Pay ' || {low} || ' - ' || {high} || ' per year.'",
        "'We will not provide any kind of visa sponsorship. Base $95K.'",
        "'Sponsorship is currently not available for this role.'",
        "'Authorized to work here without employer sponsorship.'",
        "'Candidates must not require visa sponsoring now or later.'",
        "'We are unable to sponsor applicants. 100% remote.'",
        "'The firm does not sponsor visas.'",
        "'U.S. citizenship is required for this position.'",
        "'Applicants must be a United States citizen.'",
        "'An active security clearance helps.'",
        "'You must be a U.S. person.'",
        f"'We gladly offer visa sponsorship. Base $95K–$120K or ' || {low} || '.'",
        f"'This role is fully remote. Bonus $500. Range ' || {low} || ' to ' || {high}",
        f"'Remote work possible from anywhere in the US. Pay ' || {low}",
        f"'You may work from home. A $500 kids stipend, base ' || {low}",
        "'Hybrid office with a remote-friendly culture.'",
        "''",
        "CAST(NULL AS STRING)",
        "'Python, SQL and Spark with Airflow data pipelines; Java or JavaScript, C++, REST. Pay $ 120k'",
    ])


_ATS = (
    "CASE WHEN {s} < 22 THEN 'workday' WHEN {s} < 52 THEN 'greenhouse' WHEN {s} = 52 THEN 'lever' "
    "WHEN {s} < 55 THEN 'oracle' ELSE 'icims' END"
)

POSTINGS_SQL = f"""
SELECT o_orderkey AS seq,
       CAST(floor(o_orderkey / 8) AS BIGINT) % {N_SOURCES} AS source_ord,
       'Company ' || CAST(CAST(floor(o_orderkey / 8) AS BIGINT) % {N_SOURCES} % 55 AS STRING) AS company,
       CAST(o_orderkey - o_orderkey % 2 AS STRING) AS id,
       {title_sql("o_orderkey")} AS title,
       {location_sql("o_orderkey")} AS location,
       'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
       {posted_sql("o_orderkey", "o_orderdate")} AS posted_on,
       {description_sql("o_orderkey", "o_totalprice")} AS description,
       CAST(floor(o_orderkey / 8) AS BIGINT) % {N_SOURCES} % 9 = 0 AS cap_exempt
FROM {{orders}}
"""

# Listings whose title also names the customer, and a rule table that is built from the customer table:
# its rows stand beside those of the default profile.
RULE_LISTINGS_SQL = f"""
SELECT o_orderkey AS seq,
       {title_sql("o_orderkey")} || ' for Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS title,
       {location_sql("o_orderkey")} AS location
FROM {{orders}}
"""
CUSTOMER_RULES_SQL = """
SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'include' ELSE 'exclude' END AS kind, c_name AS term
FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
"""

# The step of 17 visits every source once per run and reaches each format early.
_SOURCE = f"(CAST(floor(o_orderkey / {PAGES_PER_SOURCE}) AS BIGINT) * 17 + 50) % {N_SOURCES}"
_TERM = f"CAST(floor(o_orderkey / {PAGES_PER_TERM}) AS BIGINT)"

# One page per order. ``flag_failed``: the poll recorded a failure; ``broken``: the payload is not JSON.
PAGES_SQL = f"""
SELECT b.*,
       (CASE WHEN ats = 'oracle' THEN 25 ELSE 20 END) * (page_key % {PAGES_PER_TERM}) AS page_offset,
       CASE WHEN page_key % 29 = 0 THEN 0 ELSE 1 + page_key % 3 END AS n_rows,
       CASE WHEN unit % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE 20 * (1 + unit % 18) END AS total,
       CASE WHEN run_id % 2 = 0 THEN block % 11 = 0 ELSE block % 37 = 0 END
         OR (ats IN ('workday', 'oracle') AND unit % 7 = 0) AS flag_failed,
       ats <> 'icims'
         AND page_key % (CASE WHEN ats IN ('workday', 'oracle') THEN 97 ELSE 1009 END) = 5 AS broken
FROM (
  SELECT o_orderkey AS page_key, o_orderdate AS page_date, o_totalprice AS price,
         CAST(floor(o_orderkey / {PAGES_PER_RUN}) AS BIGINT) AS run_id,
         CAST(floor(o_orderkey / {PAGES_PER_SOURCE}) AS BIGINT) AS block,
         {_TERM} AS unit,
         {_SOURCE} AS source_ord,
         {_TERM} % {TERMS} AS term_no,
         {_ATS.format(s=f"({_SOURCE})")} AS ats
  FROM {{orders}}
) b
"""


# Raw payload fields of listing ``k`` on a page (SQL over the columns of PAGES_SQL and ``k``).
# Listings of one block carry the same items in each of its terms.
def item_sql(k: str) -> str:
    return (
        f"CAST((page_key - page_key % {PAGES_PER_SOURCE}) * 2 + "
        f"(page_key % {PAGES_PER_TERM}) * 4 + {k} AS STRING)"
    )


def feed_field_sql(field: str, k: str) -> str:
    by = f"page_key + {k}"
    return {
        "item": item_sql(k),
        "title": title_sql(by),
        "location": location_sql(by),
        "posted": posted_sql(by, "page_date"),
        "iso": f"{iso_day_sql('page_date')} || 'T08:30:00Z'",
        "second": f"CASE WHEN ({by}) % 3 = 0 THEN 'Dover, DE' ELSE '' END",
        "description": description_sql(by, "price"),
        "bullet": f"({by}) % 4",
        "created": f"(page_key % 20000 - 300) * 86400000 + 3600000 * (({by}) % 24) * CASE WHEN page_key % 11 = 0 THEN 0 ELSE 1 END",
    }[field]


# Documents and pages with a sentence of skill words at the end.
SKILL_SENTENCES = _quoted(
    " We use Python, python, SQL and Java (not JavaScript) with Apache Spark on AWS.",
    " C++, C#, .NET and Node.js; REST or RESTful APIs, CI/CD, GitHub, GitLab, git.",
    " Machine learning, ML, NLP, LLM; scikit-learn, PyTorch. Unit tests.",
    " éjava sqlé javaé; data pipeline and data warehousing, ETL/ELT.",
    "",
    " Postgres, PostgreSQL, MongoDB, k8s, Docker; Agile Scrum, system design.",
    " golang go; Power BI, Tableau; TDD, dbt, Databricks, Data Structures.",
)


DOCUMENT_DESCRIPTION_SQL = f"text || ' ' || ({description_sql('doc_id', '(50000 + doc_id % 100000)')})"
PARAGRAPHS_SQL = "CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) END"


def skill_text_sql(text: str, by: str) -> str:
    return f"{text} || {_pick(by, SKILL_SENTENCES)}"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def _stored(view: DataFrame) -> DataFrame:
    """A view that behaves like a stored table: its columns are made once, before any filter."""
    return view.select(F.inline(F.array(F.struct(*view.columns))))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark.sql(POSTINGS_SQL, orders=read(spark, sf_dir, "orders")))


def rule_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark.sql(RULE_LISTINGS_SQL, orders=read(spark, sf_dir, "orders")))


def rule_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The default profile and the rules of the customers, as rows."""
    fixed = spark.createDataFrame(profile_rows(name, STRICT), RULE_SCHEMA)
    more = spark.sql(CUSTOMER_RULES_SQL, customer=read(spark, sf_dir, "customer"))
    return fixed.unionByName(more.withColumns({"profile": F.lit(name), "ord": F.lit(0)}))


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their counts and no payload."""
    frame = spark.sql(PAGES_SQL, orders=read(spark, sf_dir, "orders"))
    failed = F.col("flag_failed") | F.col("broken")
    return _stored(frame.withColumns(
        {
            "failed": failed,
            "n_rows": F.when(failed, 0).otherwise(F.col("n_rows")).cast("long"),
            "total": F.when(~failed, F.col("total")).cast("double"),
        }
    ))


def _payload_sql() -> str:
    def field(name: str) -> str:
        return feed_field_sql(name, "k")

    def each(struct: str) -> str:
        return f"transform(slice(array(0, 1, 2), 1, CAST(n_rows AS INT)), k -> named_struct({struct}))"

    workday = each(
        f"'title', {field('title')}, 'externalPath', '/job/' || {field('item')}, "
        f"'locationsText', {field('location')}, 'postedOn', {field('posted')}, "
        f"'bulletFields', CASE {field('bullet')} WHEN 0 THEN array('R' || {field('item')}) "
        "WHEN 1 THEN CAST(array() AS ARRAY<STRING>) WHEN 2 THEN CAST(NULL AS ARRAY<STRING>) "
        "ELSE array('') END"
    )
    greenhouse = each(
        f"'id', CAST({field('item')} AS BIGINT), 'title', {field('title')}, "
        f"'location', named_struct('name', {field('location')}), "
        f"'absolute_url', 'https://boards.example.com/' || {field('item')}, 'updated_at', {field('iso')}"
    )
    lever = each(
        f"'id', {field('item')}, 'text', {field('title')}, "
        f"'categories', named_struct('location', {field('location')}), "
        f"'hostedUrl', 'https://jobs.example.com/' || {field('item')}, "
        f"'createdAt', {field('created')}, 'descriptionPlain', {field('description')}"
    )
    oracle = each(
        f"'Id', {field('item')}, 'Title', {field('title')}, 'PrimaryLocation', {field('location')}, "
        f"'PostedDate', {field('posted')}, "
        f"'ExternalPostedStartDate', CASE WHEN (page_key + k) % 2 = 0 THEN {field('iso')} END, "
        f"'secondaryLocations', array(named_struct('Name', {field('second')}))"
    )
    no_list = "n_rows = 0 AND page_key % 2 = 0"
    return f"""CASE
      WHEN flag_failed THEN CAST(NULL AS STRING)
      WHEN broken THEN '{{"jobs": [{{"id": 1'
      WHEN ats = 'workday' THEN to_json(named_struct('total', total, 'jobPostings', CASE WHEN NOT ({no_list}) THEN {workday} END))
      WHEN ats = 'greenhouse' THEN to_json(named_struct('jobs', CASE WHEN NOT ({no_list}) THEN {greenhouse} END))
      WHEN ats = 'lever' THEN to_json({lever})
      WHEN ats = 'oracle' THEN to_json(named_struct('items', array(named_struct('TotalJobsCount', total, 'requisitionList', CASE WHEN NOT ({no_list}) THEN {oracle} END))))
      ELSE '<html></html>' END"""


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with JSON payloads, in the landed layout."""
    frame = spark.sql(PAGES_SQL, orders=read(spark, sf_dir, "orders"))
    return _stored(frame.select(
        "run_id",
        F.col("source_ord").cast("int").alias("source_ord"),
        F.col("term_no").cast("int").alias("term_no"),
        F.col("page_offset").cast("int").alias("page_offset"),
        F.expr(_payload_sql()).alias("payload"),
        F.col("flag_failed").alias("failed"),
    ))


# Detail payloads: one per order, format and text by order key.
DETAIL_BASE_SQL = f"""
SELECT o_orderkey AS detail_no,
       CASE o_orderkey % 3 WHEN 0 THEN 'workday' WHEN 1 THEN 'greenhouse' ELSE 'oracle' END AS ats,
       CASE o_orderkey % 3
         WHEN 0 THEN 'https://firm.wd1.myworkdayjobs.com/site/job/' || CAST(o_orderkey AS STRING)
         WHEN 1 THEN 'https://boards-api.greenhouse.io/v1/boards/firm/jobs/' || CAST(o_orderkey AS STRING)
         ELSE 'https://firm.oraclecloud.com/detail/' || CAST(o_orderkey AS STRING) END AS detail_key,
       {description_sql("o_orderkey", "o_totalprice")} AS body,
       {location_sql("o_orderkey")} AS place,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Dover, DE' WHEN o_orderkey % 4 = 1 THEN '' END AS place2,
       o_orderkey % 101 = 7 AS broken
FROM {{orders}}
"""
# Raw text fields per format; the second carries encoded markup.
WORKDAY_BODY = "'<p>' || body || '</p><br/> <ul><li>a < b</li></ul>  <>  '"
GREENHOUSE_BODY = "'&lt;p class=&quot;x&quot;&gt;' || body || '&lt;/p&gt;&nbsp;It&#039;s R&amp;amp;D &#X27;now&#39;'"
ORACLE_BODIES = ("'<div>' || body || '</div>'", "CASE WHEN detail_no % 2 = 0 THEN 'Needs <b>skill</b>' END", "''")


def landed_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail payloads in the landed layout."""
    frame = spark.sql(DETAIL_BASE_SQL, orders=read(spark, sf_dir, "orders"))
    payload = F.expr(f"""CASE
      WHEN broken THEN '{{"content": '
      WHEN ats = 'workday' THEN to_json(named_struct('jobPostingInfo', named_struct(
        'jobDescription', {WORKDAY_BODY}, 'location', place,
        'additionalLocations', CASE WHEN place2 IS NOT NULL THEN array(place2) END)))
      WHEN ats = 'greenhouse' THEN to_json(named_struct(
        'content', {GREENHOUSE_BODY}, 'location', named_struct('name', place)))
      ELSE to_json(named_struct('items', array(named_struct(
        'ExternalDescriptionStr', {ORACLE_BODIES[0]}, 'ExternalQualificationsStr', {ORACLE_BODIES[1]},
        'ExternalResponsibilitiesStr', {ORACLE_BODIES[2]}, 'PrimaryLocation', place,
        'secondaryLocations', array(named_struct('Name', place2)))))) END""")
    return _stored(frame.select("detail_no", "detail_key", "ats", payload.alias("payload")))


# Details of the listings of all feeds, by the number at the end of their key: some are missing,
# some broken, some landed twice.
FEED_DETAIL_MISSING, FEED_DETAIL_BROKEN, FEED_DETAIL_TWICE = "no % 7 = 3", "no % 11 = 5", "no % 5 = 1"


def feed_body_sql(landing: int) -> str:
    return description_sql(f"(no + {landing})", "(50000 + no % 100000)")


def feed_details(spark: SparkSession, sf_dir: str, landed: DataFrame | None = None) -> DataFrame:
    """Detail payloads of the feeds' listings, each under the key its listing names. ``landed``: the landed pages, where stored."""
    landed = landed_pages(spark, sf_dir) if landed is None else landed
    pages = with_source(landed, source_dimension(spark), "ats", "address")
    listings = explode_pages(pages, "ats").where(F.col("ats") != "lever")
    keys = listings.select("ats", detail_key().alias("detail_key")).where("detail_key IS NOT NULL").distinct()
    number = F.regexp_extract(F.regexp_replace("detail_key", "%22,.*", ""), "([0-9]+)$", 1)
    rows = keys.withColumn("no", number.cast("bigint")).where(f"NOT {FEED_DETAIL_MISSING}")
    landings = F.when(F.expr(FEED_DETAIL_TWICE), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = rows.select("*", F.explode(landings).alias("landed_at"))
    body = F.when(F.col("landed_at") == 0, F.expr(feed_body_sql(0))).otherwise(F.expr(feed_body_sql(1)))
    place = F.when(F.col("no") % 3 == 0, F.lit("Dover, DE")).when(F.col("no") % 3 == 1, F.lit("")).otherwise(F.lit("Oslo"))
    payload = F.expr(f"""CASE
      WHEN {FEED_DETAIL_BROKEN} THEN '{{"content": '
      WHEN ats = 'workday' THEN to_json(named_struct('jobPostingInfo', named_struct('jobDescription', body, 'location', place)))
      WHEN ats = 'greenhouse' THEN to_json(named_struct('content', body, 'location', named_struct('name', place)))
      ELSE to_json(named_struct('items', array(named_struct('ExternalDescriptionStr', body, 'PrimaryLocation', place)))) END""")
    return rows.withColumns({"body": body, "place": place}).select(
        "detail_key", "ats", "landed_at", payload.alias("payload")
    )
