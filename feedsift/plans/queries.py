"""The registered queries: each one operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.functions import extract, predicates, text
from feedsift.operators import digest as digests
from feedsift.operators import enrich, matching, rank, rollup
from feedsift.operators.dedup import lookup_first, unseen
from feedsift.operators.rule_table import matched_by_table
from feedsift.operators.tracker import tracker_rows
from feedsift.plans import views
from feedsift.plans.run import RunOptions, preview, select_listings
from feedsift.rules import profiles
from feedsift.rules.feeds import OFFSET_CAPS, SOURCES
from feedsift.session import delete_at_exit, shared_folder
from feedsift.sources import landed
from feedsift.sources.detail_store import open_details, write_details
from feedsift.sources.details import flatten_details
from feedsift.sources.dimension import read_whole_texts, source_dimension, write_whole_texts
from feedsift.sources.payloads import LISTING_FIELDS, explode_listings, explode_pages
from feedsift.streaming.incremental import Tables, read_finished, seen_table, start_incremental, stream_new_keys
from feedsift.streaming.seen import SeenTable
from feedsift.streaming.tables import SEEN_SCHEMA, Run, seen_rows

Query = Callable[[SparkSession, str], DataFrame]

OPTIONS = RunOptions(as_of=views.AS_OF)  # no caps: every landed page counts
EVENT_CUTOFF = "2024-01-04"
DOC_CHUNK_LIMIT = 4000
TURN_CHUNK_LIMIT = 120
PART_LIMIT = 400
N_POLLS = 4
_POSTING_FIELDS = ("company", "ats", "cap_exempt", *LISTING_FIELDS)


# --- sources -----------------------------------------------------------------


def _feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.with_source(
        views.landed_pages(spark, sf_dir), source_dimension(spark), "company", "ats", "address"
    )


def _normalised(ats: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _feed_pages(spark, sf_dir).where(F.col("ats") == ats)
        return explode_pages(pages, "run_id", "source_ord", "term_no", "page_offset", "company")

    return query


def detail_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_details(views.landed_details(spark, sf_dir)).select(
        "detail_no", "ats", "description",
        F.array_join("locations", "|").alias("locations"),
        F.size("locations").cast("long").alias("n_locations"),
    )


def _scratch(spark: SparkSession, purpose: str) -> str:
    """A shared folder for what a query stores; gone when the driver ends."""
    return delete_at_exit(spark, shared_folder(spark, purpose))


def _landed(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages, parsed and stored once."""
    folder = _scratch(spark, "pages")
    landed.land_pages(pages, source_dimension(spark), folder)
    return landed.read_stored(spark, folder)


def _feeds(spark: SparkSession, sf_dir: str, caps: landed.Caps = OFFSET_CAPS) -> DataFrame:
    pages = _landed(spark, views.landed_pages(spark, sf_dir))
    return landed.collect_listings(pages, source_dimension(spark), caps)


def union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir).select(
        *landed.SEQ_FIELDS,
        F.col("first_seq.term_no").alias("first_term_no"),
        F.col("first_seq.page_offset").alias("first_page_offset"),
        F.col("first_seq.pos").alias("first_pos"),
        *_POSTING_FIELDS,
    )


def stamp_source_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = views.postings(spark, sf_dir).select("seq", F.col("source_ord").cast("int"))
    dimension = source_dimension(spark).select("source_ord", "company", "ats", "cap_exempt")
    return listings.join(dimension, "source_ord", "left").withColumn(
        "cap_exempt", F.coalesce("cap_exempt", F.lit(False))
    )


def bounded_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.page_stats(spark, sf_dir)
    return _pulled(pages, OFFSET_CAPS)


def unbounded_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging by totals alone: no landed page is left out for its offset."""
    return _pulled(views.page_stats(spark, sf_dir), None)


def _pulled(pages: DataFrame, caps: landed.Caps) -> DataFrame:
    return landed.bounded_pull(pages, landed.term_status(pages, caps), caps).select(
        "run_id", "source_ord", "term_no", "page_offset", "n_rows", "failed", "term_failed"
    )


def term_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _landed(spark, views.landed_pages(spark, sf_dir)).where(landed.is_paged())
    listings = explode_listings(
        landed.pulled_pages(pages, OFFSET_CAPS), "run_id", "source_ord", "term_no", "page_offset"
    )
    return landed.union_terms(listings).select(
        *landed.SEQ_FIELDS,
        "id",
        "title",
        F.col("first_seq.term_no").alias("first_term_no"),
        F.col("first_seq.page_offset").alias("first_page_offset"),
        F.col("first_seq.pos").alias("first_pos"),
    )


def _detail_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the listings has an inline text, some have no detail."""
    no = F.col("seq")
    key = F.concat(
        F.when(no % 3 == 0, "https://firm.wd1.myworkdayjobs.com/site/job/")
        .when(no % 3 == 1, "https://boards-api.greenhouse.io/v1/boards/firm/jobs/")
        .otherwise("https://firm.oraclecloud.com/detail/"),
        no.cast("string"),
    )
    return views.postings(spark, sf_dir).withColumns(
        {
            "listing_key": no.cast("string"),
            "description": F.when(no % 7 < 2, F.col("description")),
            "url": F.when(no % 3 == 0, key).otherwise(F.col("url")),
            "detail_api": F.when(no % 3 == 1, key),
            "oracle_detail": F.when((no % 3 == 2) & (no % 5 != 0), key).otherwise(""),
        }
    )


_DETAIL_FIELDS = ("seq", "location", "description", "has_detail")


def attach_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by precedence."""
    details = flatten_details(views.landed_details(spark, sf_dir))
    return enrich.attach_details(_detail_listings(spark, sf_dir), details).select(*_DETAIL_FIELDS)


def attach_detail_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store of details in buckets, written first."""
    path = _scratch(spark, "details")
    write_details(flatten_details(views.landed_details(spark, sf_dir)), path, order="detail_no")
    return enrich.attach_stored_details(_detail_listings(spark, sf_dir), open_details(spark, path)).select(*_DETAIL_FIELDS)


# --- text --------------------------------------------------------------------


def _page_text(column: Callable[[str], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.read(spark, sf_dir, "pages", "page_id", "html").select(
            "page_id", column("html").alias("text")
        )

    return query


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = text.chunk_text("text", DOC_CHUNK_LIMIT)
    return views.read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(pieces).alias("chunk_no", "chunk")
    )


def conv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is cut by itself, so a long conversation is never gathered in one place."""
    pieces = text.chunk_text("text", TURN_CHUNK_LIMIT)
    return views.read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.posexplode(pieces).alias("chunk_no", "chunk")
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = F.concat(
        F.lit("https://boards.greenhouse.io/b"), F.col("page_id") % 10, F.lit("/jobs/"), "page_id"
    )
    link = F.when(F.col("page_id") % 4 == 0, board).otherwise(F.col("url"))
    return (
        views.read(spark, sf_dir, "pages", "page_id", "url")
        .select("page_id", extract.url_parts(link).alias("p"), extract.board_ids(link).alias("b"))
        .select("page_id", "p.tenant", "p.site", "p.rest", "b.board", "b.listing")
    )


# --- predicates and extraction over the listing view --------------------------


def _listing_query(name: str, column: Callable[[], Column]) -> Query:
    """One computed column beside the listing's sequence number."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.postings(spark, sf_dir).select("seq", column().alias(name))

    return query


def match_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.postings(spark, sf_dir).where(
        predicates.matches_profile("title", "location")
    ).select("seq", "title", "location")


def match_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched(views.postings(spark, sf_dir)).select("seq", "title", "location")


def match_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching against a profile kept as a table, with a rule per customer of two segments."""
    rules = views.rule_table(spark, sf_dir, "wide")
    return matched_by_table(views.rule_listings(spark, sf_dir), rules, "wide")


def recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = matching.with_age(views.postings(spark, sf_dir), views.AS_OF)
    return matching.recent(aged).select(
        "seq", "posted_on", F.col("age_days").cast("double").alias("age_days")
    )


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_signals(views.postings(spark, sf_dir))


def _remote_text() -> Column:
    """The flag as text, so that its null (no text to read) compares alike everywhere."""
    return F.col("remote").cast("string").alias("remote")


def geo_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rechecked(_signals(spark, sf_dir)).select("seq", "location", _remote_text())


def skip_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).where(predicates.not_flagged("flag_status")).select(
        "seq", "flag_status"
    )


def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = extract.flag_reason("description")
    return (
        views.postings(spark, sf_dir)
        .select("seq", reason.alias("flag_reason"))
        .withColumn("flag_status", extract.flag_status("flag_reason"))
    )


def enrich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select(
        "seq", "flag_status", "flag_reason", "salary", _remote_text()
    )


def meta_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("seq", extract.meta_line().alias("meta"))


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.deduplicated(views.postings(spark, sf_dir)).select(
        "listing_key", "seq", "first_seq", "title", "location"
    )


def skill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(
        f"SELECT doc_id, {views.skill_text_sql('text', 'doc_id')} AS text FROM {{documents}}",
        documents=views.read(spark, sf_dir, "documents"),
    ).withColumn("low", text.folded("text"))
    hits = extract.skill_hits("text", F.col("low"))
    return docs.select("doc_id", F.posexplode(hits).alias("hit_no", "hit")).select(
        "doc_id", "hit_no", "hit.label", "hit.n"
    )


def _skill_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and pages with a sentence of skill words at their end, by number."""
    def texts(table: str, key: str, body: str, by: str) -> DataFrame:
        sql = f"SELECT {key} AS pair_no, {views.skill_text_sql(body, by)} AS text FROM {{t}}"
        return spark.sql(sql, t=views.read(spark, sf_dir, table))

    return texts("documents", "doc_id", "text", "doc_id"), texts("pages", "page_id", "html", "page_id * 3 + 1")


def _labels_missing(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """Labels of each wanted text that the own text of the same number lacks.

    Labels are read on both sides first, so the join moves short lists, not texts.
    """
    def labels(texts: DataFrame, name: str) -> DataFrame:
        low = texts.withColumn("low", text.folded("text"))
        found = extract.skill_labels(extract.skill_hits("text", F.col("low")))
        return low.select("pair_no", found.alias(name))

    none = F.array().cast("array<string>")
    missing = F.array_except("wanted", F.coalesce("own", none))
    return labels(wanted, "wanted").join(labels(own, "own"), "pair_no", "left").select(
        "pair_no", F.posexplode(missing).alias("label_no", "label")
    )


def skills_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each document that the page of the same number lacks."""
    return _labels_missing(*_skill_texts(spark, sf_dir))


def skills_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files: every document and page is written as a file of its own and read back whole."""
    def through_files(texts: DataFrame, purpose: str) -> DataFrame:
        folder = _scratch(spark, purpose)
        write_whole_texts(texts, "pair_no", "text", folder)
        return read_whole_texts(spark, folder, ends_with_break=True).select(F.col("pair_no").cast("bigint").alias("pair_no"), "text")

    wanted, own = _skill_texts(spark, sf_dir)
    return _labels_missing(through_files(wanted, "documents"), through_files(own, "pages"))


# --- joins and seen state ------------------------------------------------------


def _event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    return views.read(spark, sf_dir, "events", "event_id", "ts", "event_type", "user_id").select(
        "event_id", "ts", key.alias("listing_key")
    )


def _before_cutoff() -> Column:
    return F.col("ts") < F.lit(EVENT_CUTOFF).cast("timestamp_ntz")


def seen_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_keys(spark, sf_dir)
    seen = events.where(_before_cutoff()).select("listing_key").distinct()
    return unseen(events.where(~_before_cutoff()), seen, "listing_key").select(
        "event_id", "listing_key"
    )


def _first_events(events: DataFrame) -> DataFrame:
    """One row per key with its first time; name columns stand in for company and title."""
    return events.groupBy("listing_key").agg(F.min("ts").alias("first_ts")).withColumns(
        {
            "company": F.substring_index("listing_key", ":", 1),
            "title": F.substring_index("listing_key", ":", -1),
        }
    )


def seen_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into the seen table, the second one repeated; the first write of a key stays."""
    seen = SeenTable(spark, _scratch(spark, "seen-upsert"), SEEN_SCHEMA)
    events = _event_keys(spark, sf_dir)
    for run_id, part in ((0, _before_cutoff()), (1, ~_before_cutoff()), (1, ~_before_cutoff())):
        run = Run("events", run_id)
        seen.begin(run)
        fresh = seen.unseen(_first_events(events.where(part)), run)
        seen.record(seen_rows(fresh, F.col("first_ts")), run)
    return seen.rows().drop("job")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys over two arrivals of event files, each processed when it lands."""
    folder = _scratch(spark, "stream-dedup")
    events = _event_keys(spark, sf_dir)
    for part in (_before_cutoff(), ~_before_cutoff()):
        events.where(part).select("listing_key").write.mode("append").parquet(f"{folder}/landed")
        stream_new_keys(
            spark, f"{folder}/landed", "listing_key STRING", "listing_key",
            f"{folder}/keys", f"{folder}/state",
        ).awaitTermination()
    return SeenTable(spark, f"{folder}/keys", "listing_key STRING").rows().drop("job")


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = views.read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(
        "c_custkey", (F.col("c_nationkey") % 7).alias("group_key")
    )
    nations = views.read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "group_key")
    return lookup_first(customers, nations, "group_key", "n_nationkey", {"n_name": "Unknown"})


# --- whole runs ----------------------------------------------------------------


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_listings(views.postings(spark, sf_dir), OPTIONS)


def _to_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.alertable(_selected(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_listings(_to_alert(spark, sf_dir).drop("description"))


def rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.ranked(_to_alert(spark, sf_dir)).select("seq", "first_seq", *rank.RANK_FIELDS)


def ranked_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole list with its place numbers."""
    listings = _to_alert(spark, sf_dir).select("seq", "first_seq", *rank.RANK_FIELDS)
    return rank.positions(listings, _scratch(spark, "ranked")).select("rank_no", "seq", "first_seq")


def preview_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(views.postings(spark, sf_dir), OPTIONS).select(
        "company", "title", "location", extract.meta_line().alias("meta"), "url",
    )


def topn_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select(
        F.col("rank_no").cast("long").alias("rank_no"), "listing_key", "title", "salary", "extra"
    )


def flag_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.flag_breakdown(_selected(spark, sf_dir))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.source_counts(_feeds(spark, sf_dir))


def _page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.source_status(landed.term_status(views.page_stats(spark, sf_dir)))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one run; keys of every fifth source count as seen before."""
    listings = views.postings(spark, sf_dir)
    fresh = F.col("source_ord") % 5 != 0
    return rollup.run_counters(
        listings,
        _selected(spark, sf_dir).withColumn("is_fresh", fresh),
        _page_status(spark, sf_dir),
    )


def source_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.failure_notice(_page_status(spark, sf_dir), source_dimension(spark))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.source_health(views.page_stats(spark, sf_dir), source_dimension(spark), len(SOURCES))


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.digest(_top(spark, sf_dir))


def digest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir).select("n_shown", "extra", "text_message")


def digest_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark, sf_dir).select("n_shown", "extra", "html_message")


def digest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.message_parts(_digest(spark, sf_dir), PART_LIMIT)


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names are mapped onto real source names, so that some are found and one repeats."""
    dimension = source_dimension(spark)
    named = dimension.select("source_ord", F.col("company").alias("name"))
    chosen = _selected(spark, sf_dir).withColumn(
        "source_ord", (F.col("source_ord") + F.col("seq") % 3).cast("int")
    )
    listings = chosen.join(named, "source_ord", "left").withColumn(
        "company", F.coalesce("name", "company")
    )
    return tracker_rows(
        listings, dimension, OPTIONS.user_id, views.AS_OF, len(SOURCES)
    )


def enrich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of whole documents, each with a sentence at its end."""
    documents = views.read(spark, sf_dir, "documents", "doc_id", "text")
    texts = documents.select(F.col("doc_id").alias("seq"), F.expr(views.DOCUMENT_DESCRIPTION_SQL).alias("description"))
    return enrich.with_signals(texts).select(
        "seq", "flag_status", "flag_reason", "salary", F.col("remote").cast("string").alias("remote")
    )


def doc_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents with paragraphs: in two of three, lines that end a sentence end a paragraph."""
    documents = views.read(spark, sf_dir, "documents", "doc_id", "text")
    texts = documents.select("doc_id", F.expr(views.PARAGRAPHS_SQL).alias("text"))
    return texts.select("doc_id", F.posexplode(text.chunk_text("text", DOC_CHUNK_LIMIT)).alias("chunk_no", "chunk"))


def _incremental(spark: SparkSession, sf_dir: str, options: RunOptions = OPTIONS) -> Tables:
    """Polls land one after another and the job runs after each, half-way with a new checkpoint.

    The polls so far lie in folders of their own, so the second job sees the
    later ones only. The run number of a poll within its job is its place there.
    Pages and details are made once and stored; a poll reads what it needs of them.
    """
    folder = _scratch(spark, "incremental")
    tables = Tables(f"{folder}/tables")
    pages = views.landed_pages(spark, sf_dir)
    pages.withColumn("poll", F.col("run_id") % N_POLLS).write.partitionBy("poll").parquet(f"{folder}/pages")
    pages = spark.read.schema(f"{landed.LANDED_SCHEMA}, poll INT").parquet(f"{folder}/pages")
    flat = flatten_details(views.feed_details(spark, sf_dir, pages.drop("poll")))
    flat.write.parquet(f"{folder}/details")
    details = spark.read.schema(flat.schema).parquet(f"{folder}/details")
    for poll in range(N_POLLS):
        job = f"{folder}/job-{poll * 2 // N_POLLS}"
        arrived = pages.where(F.col("poll") == poll).drop("poll")
        arrived.write.mode("append").json(f"{job}/landed")
        start_incremental(
            spark, f"{job}/landed", tables, f"{job}/state", options, details
        ).awaitTermination()
    return tables


def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seen table after all polls."""
    tables = _incremental(spark, sf_dir)
    return seen_table(spark, tables).rows().drop("seen_at", "job")


def seed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that record and stay silent: the seen table is that of other runs."""
    tables = _incremental(spark, sf_dir, replace(OPTIONS, seed=True))
    return seen_table(spark, tables).rows().drop("seen_at", "job")


def incremental_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker rows all polls wrote."""
    tables = _incremental(spark, sf_dir)
    return read_finished(spark, tables, tables.tracker).drop("job")


def incremental_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and body of each poll's e-mail."""
    tables = _incremental(spark, sf_dir)
    return read_finished(spark, tables, tables.emails).drop("job", "run_id")


def incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each poll's run."""
    tables = _incremental(spark, sf_dir)
    return read_finished(spark, tables, tables.counters).drop("job", "run_id")


def incremental_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings of each poll's run."""
    tables = _incremental(spark, sf_dir)
    return read_finished(spark, tables, tables.notices).drop("job", "run_id")


def feed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert order over the listings of all feeds; ties by first place of a key in any term."""
    listings = _feeds(spark, sf_dir, OPTIONS.caps)
    top = rank.top_listings(rank.alertable(select_listings(listings, OPTIONS)).drop("description"), 200)
    return top.select(F.col("rank_no").cast("long").alias("rank_no"), "listing_key", "title", "extra")


def _wide(query: Query) -> Query:
    """Positions and ordinals as BIGINT, the type the reference SQL counts in."""

    @wraps(query)
    def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = query(spark, sf_dir)
        return frame.select(
            *(F.col(n).cast("long").alias(n) if kind == "int" else n for n, kind in frame.dtypes)
        )

    return widened


def all_queries() -> dict[str, Query]:
    def listing(name: str, column: Callable[[], Column]) -> Query:
        return _listing_query(name, column)

    return {
        "norm_workday": _wide(_normalised("workday")),
        "norm_greenhouse": _wide(_normalised("greenhouse")),
        "norm_lever": _wide(_normalised("lever")),
        "norm_oracle": _wide(_normalised("oracle")),
        "detail_flatten": detail_flatten,
        "union_feeds": _wide(union_feeds),
        "stamp_source_attr": _wide(stamp_source_attr),
        "bounded_pull": bounded_pull,
        "unbounded_pull": unbounded_pull,
        "term_union_dedup": _wide(term_union_dedup),
        "attach_detail": attach_detail,
        "attach_detail_store": attach_detail_store,
        "html_strip": _page_text(text.strip_tags),
        "html_decode": _page_text(text.decode_entities),
        "html_escape": _page_text(text.escape_html),
        "doc_chunks": _wide(doc_chunks),
        "conv_chunks": _wide(conv_chunks),
        "doc_paragraph_chunks": _wide(doc_paragraph_chunks),
        "enrich_documents": enrich_documents,
        "title_include": listing("included", lambda: predicates.title_included("title")),
        "title_exclude": listing(
            "excluded", lambda: predicates.title_excluded("title", profiles.LOCAL)
        ),
        "exclude_exemption": listing("excluded", lambda: predicates.title_excluded("title")),
        "geo_block": listing("blocked", lambda: predicates.location_blocked("location")),
        "geo_in_region": listing("in_region", lambda: predicates.looks_us("location")),
        "geo_allow": listing("allowed", lambda: predicates.location_allowed("location")),
        "match_profile": match_profile,
        "match_profile_table": match_profile_table,
        "match_by_region": match_by_region,
        "priority_region": listing("near", lambda: predicates.in_priority_region("location")),
        "recency_filter": recency_filter,
        "geo_recheck": geo_recheck,
        "skip_flagged": skip_flagged,
        "detect_remote": listing("remote", lambda: predicates.mentions_remote("description")),
        "posted_age": listing("age_days", lambda: extract.posted_age("posted_on", views.AS_OF).cast("double")),
        "money_value": listing("amount", lambda: extract.money_value("description")),
        "money_best": listing("salary", lambda: extract.best_money_text("description")),
        "classify_rules": classify_rules,
        "wage_band": listing("band", lambda: extract.wage_band("description")),
        "location_bucket": listing("bucket", lambda: extract.location_bucket("location")),
        "dedup_keep_last": dedup_keep_last,
        "skill_counts": skill_counts,
        "enrich_text": enrich_text,
        "meta_line": meta_line,
        "url_parts": url_parts,
        "seen_diff": seen_diff,
        "lookup_first": lookup,
        "skills_missing": skills_missing,
        "skills_missing_files": skills_missing_files,
        "rank_rows": rank_rows,
        "ranked_positions": ranked_positions,
        "topn_overflow": topn_overflow,
        "flag_breakdown": flag_breakdown,
        "source_counts": _wide(source_counts),
        "run_counters": run_counters,
        "source_failures": source_failures,
        "source_health": source_health,
        "digest_text": digest_text,
        "digest_html": digest_html,
        "seen_upsert": seen_upsert,
        "tracker_rows": tracker,
        "digest_parts": digest_parts,
        "preview_run": preview_run,
        "feed_ranking": feed_ranking,
        "incremental_run": incremental_run,
        "seed_run": seed_run,
        "incremental_tracker": incremental_tracker,
        "incremental_emails": incremental_emails,
        "incremental_counters": incremental_counters,
        "incremental_notices": incremental_notices,
        "stream_dedup": stream_dedup,
    }
