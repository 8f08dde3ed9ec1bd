"""Shows from several providers: merge, filter, rank, and alert watches.

Input has the SHOW schema. ``primary`` is the provider whose row leads a merged show and
``secondary`` the one whose loose taxonomy needs the stricter filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import labels
from gaugeworks.functions.text import has_any, provider_key, show_key
from gaugeworks.operators.joins import contains_pairs
from gaugeworks.session import cut_lineage

PRIMARY = "ticketmaster"
SECONDARY = "seatgeek"
KEY = "event_dedupe_key"

# Artists and words that prove a rock show, and taxonomy tokens that do.
ROCK_TERMS = (
    "rock", "metal", "alternative", "punk", "grunge", "hardcore", "metalcore", "hard rock",
    "shinedown", "disturbed", "sevendust", "metallica", "slayer", "anthrax", "megadeth",
)
ROCK_TAXONOMY = (
    "rock", "metal", "alternative", "punk", "indie", "hard rock", "classic rock", "hard-rock",
)


def normalise(shows: DataFrame) -> DataFrame:
    """Nulls to empty text, ticket link as fallback page, and both identity keys."""
    texts = ("source", "provider_event_id", "artist_or_title", "venue", "city", "state",
             "starts_at", "ticket_url", "genre_or_classification")
    out = shows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts})
    raw = F.col("raw_url") if "raw_url" in shows.columns else F.lit(None)
    return out.withColumns({
        "raw_url": F.coalesce(F.nullif(raw, F.lit("")), "ticket_url"),
        "dedupe_key": provider_key("source", "provider_event_id"),
        KEY: show_key("artist_or_title", "venue", "starts_at"),
    })


def union_providers(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# ---- filters -------------------------------------------------------------------------

def _set(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) != ""


def passes_genre(genre: Column, artist: Column, secondary: str = SECONDARY) -> Column:
    """Artist watches pass; of the genres only rock filters, and only positive signals pass."""
    label = F.coalesce("genre_or_classification", F.lit(""))
    signal = F.when(F.col("source") == secondary, labels.taxonomy_signal(label)).otherwise(
        labels.genre_signal(label))
    return _set(artist) | ~_set(genre) | (F.lower(F.trim(genre)) != "rock") | (signal == "positive")


def is_noise(genre: Column, artist: Column, secondary: str = SECONDARY) -> Column:
    """Secondary-provider rows with a generic concert taxonomy and no sign of rock."""
    label = F.lower(F.trim(F.coalesce("genre_or_classification", F.lit(""))))
    tokens = F.transform(
        labels.taxonomy_tokens(label), lambda t: F.regexp_replace(t, r"\s+", " "))
    rock = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in ROCK_TAXONOMY]))
    blob = F.lower(F.trim(F.regexp_replace(
        F.concat_ws(" ", "artist_or_title", "venue"), r"\s+", " ")))
    bare = F.array_contains(tokens, "concert") | (F.size(tokens) == 0)
    noisy = (labels.taxonomy_signal(label) == "negative") | (~rock & ~has_any(blob, ROCK_TERMS) & bare)
    return (F.col("source") == secondary) & ~_set(artist) & _set(genre) & noisy


# ---- merge ---------------------------------------------------------------------------

def merge(shows: DataFrame, primary: str = PRIMARY, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per show: fields of the leading provider row, distinct sources, row count.

    The leading row is picked by an aggregate that merges map-side, so a show that holds a
    third of all rows still reduces before the shuffle. The members stay a long frame, see
    :func:`members`; they are never gathered into one row.
    """
    fields = ("artist_or_title", "venue", "city", "state", "starts_at", "ticket_url",
              "genre_or_classification")
    rank = F.struct(F.when(F.col("source") == primary, 0).otherwise(1).alias("r"),
                    F.col("ticket_url").alias("u"), F.col("source").alias("s"),
                    F.col("provider_event_id").alias("i"))
    keyed = shows.filter(F.coalesce(F.col(KEY), F.lit("")) != "")
    merged = keyed.groupBy(*extra_keys, KEY).agg(
        F.min_by(F.struct(*fields), rank).alias("_lead"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count(F.lit(1)).alias("member_count"),
    )
    return merged.select(
        *extra_keys, KEY, "_lead.*", "sources", F.array_join("sources", ", ").alias("source_label"),
        "member_count")


def members(shows: DataFrame) -> DataFrame:
    """Provider rows of the merged shows, one row each, keyed by the show."""
    return shows.filter(F.coalesce(F.col(KEY), F.lit("")) != "")


def duplicate_groups(shows: DataFrame, order: Sequence[str] = ("source", "provider_event_id")):
    """Shows with several provider rows: count and the first row's fields.

    The ids of a group are rows of :func:`members` joined on the key.
    """
    keyed = members(shows)
    first = F.struct(*order)
    return keyed.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.min_by("artist_or_title", first).alias("artist_or_title"),
        F.min_by("venue", first).alias("venue"),
        F.min_by("starts_at", first).alias("starts_at"),
    ).filter("member_count >= 2")


def duplicate_members(shows: DataFrame) -> DataFrame:
    groups = duplicate_groups(shows).select(KEY)
    return members(shows).join(groups, KEY, "left_semi").select(
        KEY, "provider_event_id", "dedupe_key")


def genre_counts(shows: DataFrame) -> DataFrame:
    label = F.trim(F.coalesce("genre_or_classification", F.lit("")))
    return shows.groupBy(F.when(label == "", "(none)").otherwise(label).alias("label")).count()


def taxonomy_counts(shows: DataFrame) -> DataFrame:
    tokens = F.explode(labels.taxonomy_tokens("genre_or_classification"))
    return shows.select(tokens.alias("token")).groupBy("token").count()


# ---- rank and funnel -----------------------------------------------------------------

def rank_score(artist: Column, genre: Column, primary: str = PRIMARY, secondary: str = SECONDARY):
    def tidy(value: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))

    needle, hay = tidy(artist), tidy(F.col("artist_or_title"))
    match = F.when((needle == "") | (hay == ""), 0).when(hay == needle, 1000).when(
        F.contains(hay, needle), 500).otherwise(0)
    lead = F.array_contains("sources", primary)
    only = (F.size("sources") == 1) & F.array_contains("sources", secondary)
    return (
        match + F.when(lead, 100).otherwise(0) - F.when(only, 10).otherwise(0)
        + F.when(_set(genre) & ~_set(artist) & lead, 50).otherwise(0)
    )


def ranked(merged: DataFrame, artist: Column, genre: Column, **providers) -> DataFrame:
    """Merged shows with ``score``, best first."""
    return merged.withColumn("score", rank_score(artist, genre, **providers)).orderBy(
        F.col("score").desc(), "starts_at", F.lower("artist_or_title"))


def funnel(
    shows: DataFrame, genre: Column, artist: Column, *, primary: str = PRIMARY,
    secondary: str = SECONDARY, display_limit: int = 10,
) -> DataFrame:
    """Counters of one search: returned per provider, kept, hidden, merged, displayed.

    One pass flags the rows; the merged count is the number of distinct keys kept.
    """
    keep = passes_genre(genre, artist, secondary)
    noise = keep & is_noise(genre, artist, secondary)
    flagged = shows.withColumns({"_keep": keep, "_noise": noise})
    merged = F.count_distinct(F.when(
        F.col("_keep") & ~F.col("_noise") & (F.coalesce(F.col(KEY), F.lit("")) != ""), F.col(KEY)))
    out = flagged.agg(
        F.count_if(F.col("source") == primary).alias("primary_returned"),
        F.count_if(F.col("source") == secondary).alias("secondary_returned"),
        F.count_if("_keep").alias("after_genre_filter"), F.count_if("_noise").alias("noise_hidden"),
        merged.alias("merged_count"))
    return out.withColumn("displayed_count", F.least("merged_count", F.lit(display_limit)).cast("long"))


# ---- areas ---------------------------------------------------------------------------

# Fixed values: (area, city, state, latitude, longitude, radius in miles).
METROS = (
    ("houston", "Houston", "TX", 29.7604, -95.3698, 75),
    ("dallas", "Dallas", "TX", 32.7767, -96.7970, 75),
    ("austin", "Austin", "TX", 30.2672, -97.7431, 60),
    ("san antonio", "San Antonio", "TX", 29.4241, -98.4936, 60),
)
EAST_TEXAS = (
    ("Tyler", "TX", 32.3513, -95.3011, 50),
    ("Longview", "TX", 32.5007, -94.7405, 50),
    ("Beaumont", "TX", 30.0802, -94.1266, 50),
    ("Lufkin", "TX", 31.3382, -94.7291, 50),
    ("Nacogdoches", "TX", 31.6035, -94.6555, 50),
)
LOUISIANA = (
    ("New Orleans", "LA", 29.9511, -90.0715, 60),
    ("Baton Rouge", "LA", 30.4515, -91.1871, 60),
    ("Lafayette", "LA", 30.2241, -92.0198, 50),
    ("Lake Charles", "LA", 30.2266, -93.2174, 50),
    ("Shreveport", "LA", 32.5252, -93.7502, 60),
)
NATIONWIDE = "nationwide"
AREAS = ("houston", "dallas", "austin", "san antonio", "east texas", "louisiana", "texas",
         NATIONWIDE)


def area_key(area: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(area, F.lit("")), r"\s+", " ")))


def _place(city, state, lat, lng, radius, label) -> Column:
    def lit(v, kind):
        return v.cast(kind) if isinstance(v, Column) else F.lit(v).cast(kind)

    return F.struct(
        lit(city, "string").alias("geo_city"), lit(state, "string").alias("geo_state"),
        lit(lat, "double").alias("lat"), lit(lng, "double").alias("lng"),
        lit(radius, "int").alias("radius"), lit(label, "string").alias("label"))


def expand_areas(watches: DataFrame) -> DataFrame:
    """One row per place a watch covers. Input: area, city, state, radius_miles.

    Nationwide is one row without a place; an unknown area or neither area nor city is one
    row with ``geo_error``. The presets are constants, so nothing is joined.
    """
    radius = F.col("radius_miles").try_cast("int")

    def preset(rows, label) -> Column:
        return F.array(*[
            _place(city, st, lat, lng, F.coalesce(radius, F.lit(r)), label(area, city))
            for area, city, st, lat, lng, r in rows])

    def by_area(area, city):
        return area

    def by_city(area, city):
        return f"{area} ({city})"

    east = [("east texas", *row) for row in EAST_TEXAS]
    west = [("louisiana", *row) for row in LOUISIANA]
    table = {row[0]: preset([row], by_area) for row in METROS}
    table["east texas"] = preset(east, by_city)
    table["louisiana"] = preset(west, by_city)
    table["texas"] = F.concat(preset(METROS, by_area), preset(east, by_city))
    nowhere = F.array(_place(None, None, None, None, None, None))
    key = area_key(F.col("area"))
    city = F.trim(F.coalesce("city", F.lit("")))
    state = F.upper(F.trim(F.coalesce(F.nullif("state", F.lit("")), F.lit("TX"))))
    explicit = F.array(_place(city, state, None, None, F.coalesce(radius, F.lit(50)),
                              F.concat(city, F.lit(", "), state)))
    for area, _, _, lat, lng, r in METROS:
        explicit = F.when(F.lower(city) == area, F.array(_place(
            city, state, lat, lng, F.coalesce(radius, F.lit(r)), city))).otherwise(explicit)
    places = F.when(key == NATIONWIDE, nowhere)
    for area, rows in table.items():
        places = places.when(key == area, rows)
    places = places.when(key != "", nowhere).when(city != "", explicit).otherwise(nowhere)
    error = (
        F.when((key != "") & ~key.isin(*AREAS),
               F.concat(F.lit("Unknown area preset: '"), F.col("area"), F.lit("'")))
        .when((key == "") & (city == ""),
              "Provide area preset or city (optionally with state/radius).")
    )
    return watches.withColumn("geo_error", error).withColumn("_g", F.explode(places)).select(
        *watches.columns, "geo_error", "_g.*")


def check_criteria(watches: DataFrame) -> DataFrame:
    """``valid`` and ``reason`` per watch. Input: artist, genre, area, city, force."""
    artist, genre = _set(F.col("artist")), _set(F.col("genre"))
    key = area_key(F.col("area"))
    city = _set(F.col("city"))
    force = F.coalesce("force", F.lit(False))
    reason = (
        F.when(~artist & ~genre, 'Provide artist:"..." and/or genre:"...".')
        .when((key != "") & ~key.isin(*AREAS), F.concat(
            F.lit("Unknown area '"), F.col("area"), F.lit("'. Supported: " + ", ".join(sorted(AREAS)))))
        .when((key == NATIONWIDE) & genre & ~artist & ~force,
              "Broad nationwide genre watches are too noisy. "
              'Add-item artist:"..." or add force:true to override.')
        .when((key == "") & ~city & genre & ~artist,
              'Broad genre watches require area:"..." or city:"...".')
    )
    return watches.withColumn("reason", reason).withColumn("valid", reason.isNull())


# ---- watches -------------------------------------------------------------------------

#: What of a watch decides which shows it meets.
CRITERIA = ("artist", "genre", "area", "city", "state", "radius_miles", "days_forward")
#: Watches of equal criteria that share a row before their alerts are written out, on average.
CHUNK = 1000
#: Merged shows of all kinds that every task may hold.
FEW_SHOWS = 20_000
#: Alerts that a task writes out for its watches, on average.
TASK_ALERTS = 250_000


def _kinds(watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active watches by equal criteria: (``_kind``, criteria), one row for each set of criteria of
    a watch, and (``watch_id``, ``_kind``, ``_chunk``), one row a watch."""
    own = watches.filter("active").groupBy("watch_id").agg(
        F.array_sort(F.collect_set(F.struct(*CRITERIA))).alias("_criteria"))
    # Named by its first watch, so that a kind is a short text in the joins.
    name = F.concat(F.lit("="), F.col("watch_id").cast("string"))
    kinds = own.groupBy("_criteria").agg(
        F.coalesce(F.min(name), F.lit("")).alias("_kind"),
        F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    of_watch = own.join(kinds, "_criteria").select("watch_id", "_kind", F.pmod(
        F.xxhash64("watch_id"), F.col("_chunks")).cast("int").alias("_chunk"))
    return kinds.select("_kind", F.explode("_criteria").alias("_c")).select("_kind", "_c.*"), of_watch


def _kind_candidates(kinds: DataFrame, shows: DataFrame, today: Column) -> DataFrame:
    """(kind, show row) pairs that meet place, date and artist, without a cross join.

    Kinds with an artist meet shows by a substring join on the title; genre kinds by an
    equi-join on the place, which every genre watch must have (see :func:`check_criteria`),
    apart from forced nationwide ones, which by definition take every show and join on a
    constant per date range of shows still to come.
    """
    placed = expand_areas(kinds).filter(F.col("geo_error").isNull()).select(
        "_kind", F.lower(F.trim(F.coalesce("artist", F.lit("")))).alias("_artist"), "artist",
        "genre", "days_forward", F.lower("geo_city").alias("_city"), F.upper("geo_state").alias("_state"))
    day = F.to_date(F.substring("starts_at", 1, 10))
    dated = shows.withColumns({
        "_day": day, "_title": F.lower("artist_or_title"), "_c": F.lower(F.trim("city")),
        "_s": F.upper(F.trim("state"))}).filter(F.col("_day") >= today)
    in_time = F.col("_day") <= F.date_add(today, F.col("days_forward"))
    in_place = F.col("_city").isNull() | (
        (F.col("_city") == F.col("_c")) & (F.col("_state") == F.col("_s")))
    artists = placed.filter(F.col("_artist") != "")
    by_artist = contains_pairs(dated, artists, hay_text="_title", needle_text="_artist").filter(
        in_time & in_place)
    genres = placed.filter(F.col("_artist") == "")
    local = dated.join(
        genres.filter(F.col("_city").isNotNull()),
        (F.col("_c") == F.col("_city")) & (F.col("_s") == F.col("_state")) & in_time)
    days = genres.filter(F.col("_city").isNull()).withColumn(
        "_on", F.explode(F.sequence(today, F.date_add(today, F.col("days_forward")))))
    wide = dated.join(days, F.col("_day") == F.col("_on"))
    columns = ["_kind", "artist", "genre", *shows.columns]
    out = by_artist.select(*columns)
    for part in (local, wide):
        out = out.unionByName(part.select(*columns))
    return out.dropDuplicates(["_kind", "dedupe_key"])


def watch_candidates(watches: DataFrame, shows: DataFrame, today: Column) -> DataFrame:
    """(watch, show row) pairs that meet place, date and artist, without a cross join.

    Watches of equal criteria meet the shows once, see :func:`_kind_candidates`; the pairs of
    each watch are made in the last join and not shuffled.
    """
    kinds, of_watch = _kinds(watches)
    found = _kind_candidates(kinds, shows, today).join(of_watch.select("watch_id", "_kind"), "_kind")
    return found.select("watch_id", "artist", "genre", *shows.columns)


def _alerts_by_watch(of_watch: DataFrame, merged: DataFrame, ledger: DataFrame) -> DataFrame:
    """The shows of each watch's kind that the ledger has not told it of.

    Watches are dealt out by id, to as many tasks as their alerts ask for, and meet the shows
    where they lie. So the alerts of a watch come out of one task, and what is reduced by watch
    after this, as a ledger is, needs no shuffle of them.
    """
    watches = cut_lineage(of_watch)
    keys = merged.groupBy("_kind").agg(F.collect_list(KEY).alias("_keys"))
    told = ledger.join(F.broadcast(merged.select(KEY).distinct()), KEY, "left_semi").groupBy("watch_id").agg(
        F.collect_set(KEY).alias("_told"))
    alerts = watches.groupBy("_kind").count().join(F.broadcast(keys), "_kind").agg(
        F.sum(F.col("count") * F.size("_keys"))).first()[0] or 0
    tasks = max(of_watch.sparkSession.sparkContext.defaultParallelism, -(-alerts // TASK_ALERTS))
    # A watch without an id is told of by no ledger.
    dealt = watches.join(told, "watch_id", "left").repartition(tasks, "watch_id").join(F.broadcast(keys), "_kind")
    left = F.when(F.col("_told").isNull(), F.col("_keys")).otherwise(F.array_except("_keys", "_told"))
    due = dealt.select("watch_id", "_kind", F.explode(left).alias(KEY)).join(F.broadcast(merged), ["_kind", KEY])
    return due.select("watch_id", *[c for c in merged.columns if c != "_kind"])


def watch_alerts(
    watches: DataFrame, shows: DataFrame, ledger: DataFrame, today: Column, *,
    primary: str = PRIMARY, secondary: str = SECONDARY,
) -> DataFrame:
    """Merged shows each active watch must still be told about.

    A show counts as told only when the ledger has it; write the ledger for delivered
    alerts (``sinks.tables.ledger_rows``), so a failed delivery comes up again.

    Shows are merged once for watches of equal criteria, and counted. Few go to all tasks, see
    :func:`_alerts_by_watch`. With many, the ledger meets chunks of their watches, and only what
    is left is written out a row per watch, without a shuffle.
    """
    kinds, of_watch = _kinds(watches)
    found = _kind_candidates(kinds, shows, today)
    genre, artist = F.col("genre"), F.col("artist")
    kept = found.filter(passes_genre(genre, artist, secondary) & ~is_noise(genre, artist, secondary))
    merged = cut_lineage(merge(kept, primary, extra_keys=["_kind"]))
    if merged.limit(FEW_SHOWS + 1).count() <= FEW_SHOWS:
        return _alerts_by_watch(of_watch.select("watch_id", "_kind"), merged, ledger)
    chunk = ["_kind", "_chunk"]
    told = of_watch.join(ledger.select("watch_id", KEY), "watch_id").groupBy(*chunk, KEY).agg(
        F.collect_set("watch_id").alias("_told"))
    lists = of_watch.groupBy(*chunk).agg(F.collect_list("watch_id").alias("_ids"), F.count_if(F.col("watch_id").isNull()).alias("_none"))
    due = merged.join(lists.select(*chunk), "_kind").join(told, [*chunk, KEY], "left").join(lists, chunk)
    # Lists hold no null; the watch without an id is told of by no ledger.
    left = F.concat(
        F.array_except("_ids", F.coalesce("_told", F.slice("_ids", 1, 0))),
        F.when(F.col("_none") > 0, F.array(F.lit(None))).otherwise(F.slice("_ids", 1, 0)))
    columns = [c for c in merged.columns if c != "_kind"]
    return due.select(F.explode(left).alias("watch_id"), *columns)


def watch_summary(watches: DataFrame, found: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per active watch: shows found and alerts due; watches without any stay at zero."""
    shows = found.groupBy("watch_id").agg(F.count_distinct(KEY).alias("shows_found"))
    due = alerts.groupBy("watch_id").agg(F.count(F.lit(1)).alias("alerts_due"))
    zero = F.lit(0).cast("long")
    return watches.filter("active").select("watch_id").join(shows, "watch_id", "left").join(
        due, "watch_id", "left").select(
        "watch_id", F.coalesce("shows_found", zero).alias("shows_found"),
        F.coalesce("alerts_due", zero).alias("alerts_due"))


def area_table(spark: SparkSession) -> DataFrame:
    """The presets as a table, for reports."""
    return spark.createDataFrame(
        [*METROS, *(("east texas", *r) for r in EAST_TEXAS), *(("louisiana", *r) for r in LOUISIANA)], "area string, city string, state string, lat double, lng double, radius int")
