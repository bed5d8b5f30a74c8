"""Profiles of match JSON: sample lists, match details, telemetry events."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KILL_TYPES = ("LogPlayerKill", "LogPlayerKillV2")
DAMAGE_FIELDS = ("killerDamageInfo", "finishDamageInfo", "dBNODamageInfo")
#: Counters of the members of a damage object.
DAMAGE_MEMBERS = {"damage_type": "damageTypeCategory", "damage_causer": "damageCauserName", "damage_reason": "damageReason"}
UNKNOWN = "UNKNOWN"


def explode_events(files: DataFrame, text: str = "value", match: str = "match_id") -> DataFrame:
    """(match, event): one row of JSON text for each element of the arrays in `text`, whatever it is; null for a JSON null."""
    return files.select(match, F.explode(F.from_json(F.col(text), "array<string>")).alias("event"))


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def _kind(path: str) -> Column:
    """JSON type of what a path leads to, null if nothing."""
    return F.schema_of_variant(_at(path))


def _number(path: str) -> Column:
    """A JSON number; texts that look like one are none."""
    kind = _kind(path)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("v", f"$.{path}", "double"))


def _text(path: str) -> Column:
    """A value as text; null if it is missing, null, empty, zero or false."""
    text = F.try_variant_get("v", f"$.{path}", "string")
    empty = F.when(_kind(path) == "STRING", text == "").otherwise(text.isin("false", "[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return F.when(~empty, text)


def _parsed(events: DataFrame) -> DataFrame:
    """`events` with v, the parsed element, is_event (it is an object) and kind (its type, UNKNOWN if it names none)."""
    parsed = events.withColumn("v", F.try_parse_json("event"))
    is_event = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("is_event", is_event).withColumn("kind", F.when(F.col("is_event"), F.coalesce(_text("_T"), F.lit(UNKNOWN))))


def telemetry_profile(events: DataFrame, match: str | None = "match_id") -> DataFrame:
    """By match, or in total: elements, events (the objects among them), types, kills, kills with a place, kills at the origin, kills with each damage field, key sets of kills.

    Reads each event's JSON by path, so events need no common schema. Key sets are bounded by the format.
    """
    kill = F.col("kind").isin(*KILL_TYPES)
    x, y = _number("victim.location.x"), _number("victim.location.y")
    place = kill & x.isNotNull() & y.isNotNull()
    damage = {name: kill & _kind(name).startswith("OBJECT") for name in DAMAGE_FIELDS}
    keys = F.when(kill, F.json_object_keys("event"))
    return _parsed(events).groupBy(*([match] if match else [])).agg(
        F.count("*").alias("event_count"),
        F.count_if("is_event").alias("object_events"),
        F.count_distinct("kind").alias("event_types"),
        F.count_if(F.col("kind") == UNKNOWN).alias("untyped_events"),
        F.count_if(kill).alias("kill_events"),
        F.count_if(place).alias("located_kills"),
        F.count_if(place & (x == 0) & (y == 0)).alias("zero_zero_kills"),
        *(F.count_if(c).alias(f"with_{n}") for n, c in damage.items()),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(keys)))).alias("kill_keys"),
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    """Frequency of event types, most frequent first; elements that are no objects have none."""
    return _parsed(events).where("is_event").groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), "event_type")


def damage_values(events: DataFrame) -> DataFrame:
    """(counter, value, event_count): values of the members of all damage objects of kills; empty ones do not count."""
    told = [F.struct(F.lit(counter).alias("counter"), _text(f"{field}.{member}").alias("value")) for field in DAMAGE_FIELDS for counter, member in DAMAGE_MEMBERS.items()]
    kills = _parsed(events).where(F.col("kind").isin(*KILL_TYPES))
    return kills.select(F.inline(F.array(*told))).where("value is not null").groupBy("counter", "value").agg(F.count("*").alias("event_count"))


def damage_keys(events: DataFrame) -> DataFrame:
    """(field, key, event_count): members of the damage objects of kills, whatever their values, by the field that holds the object."""
    kills = _parsed(events).where(F.col("kind").isin(*KILL_TYPES))
    told = F.array(*(F.struct(F.lit(f).alias("field"), F.when(_kind(f).startswith("OBJECT"), F.json_object_keys(F.try_variant_get("v", f"$.{f}", "string"))).alias("keys")) for f in DAMAGE_FIELDS))
    return kills.select(F.inline(told)).select("field", F.explode("keys").alias("key")).groupBy("field", "key").agg(F.count("*").alias("event_count"))


def match_profiles(details: DataFrame, events: DataFrame, match: str = "match_id") -> DataFrame:
    """telemetry_profile of the matches of `details` (match_details, with the match's id) with their map and mode, UNKNOWN where empty."""
    named = [F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(UNKNOWN)).alias(c) for c in ("map_name", "game_mode")]
    return details.select(match, *named, "created_at").join(telemetry_profile(events, match), match)


def pilot_counts(profiles: DataFrame) -> DataFrame:
    """(counter, value, match_count) of match_profiles: matches by map and by mode."""
    told = F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in ("map_name", "game_mode")))
    return profiles.select(F.inline(told)).groupBy("counter", "value").agg(F.count("*").alias("match_count"))


def pilot_summary(profiles: DataFrame) -> DataFrame:
    """One row over match_profiles: matches, the span of their times, events, kills, kills with a place and at the origin."""
    told = F.when(F.col("created_at") != "", F.col("created_at"))
    sums = {"event_count": "object_events", "kill_event_count": "kill_events", "victim_location_count": "located_kills", "zero_zero_count": "zero_zero_kills"}
    return profiles.agg(F.count("*").alias("successful_match_count"), F.min(told).alias("created_at_min"), F.max(told).alias("created_at_max"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))


def sample_windows(now: datetime, days: int) -> list[tuple[str, str | None]]:
    """(label, start) of the newest sample and of the UTC days before it, the start being a day's first second."""
    now = now.astimezone(timezone.utc)
    ends = [(now - timedelta(days=k)).strftime("%Y-%m-%d") for k in range(1, days)]
    return [(f"latest_{now:%Y-%m-%d}", None), *((f"ending_{day}", f"{day}T00:00:00Z") for day in ends)]


_MATCHES = "struct<data:struct<relationships:struct<matches:struct<data:array<struct<id:string>>>>>>"


def sample_matches(samples: DataFrame, text: str = "value", window: str = "window") -> DataFrame:
    """(window, position, match_id) of the references in sample lists; empty and missing ids are dropped."""
    listed = F.from_json(F.col(text), _MATCHES)["data"]["relationships"]["matches"]["data"]
    return samples.select(window, F.posexplode(listed).alias("position", "reference")).select(window, "position", F.col("reference.id").alias("match_id")).where("match_id <> ''")


def sample_summary(samples: DataFrame, text: str = "value", window: str = "window") -> DataFrame:
    """References and distinct matches by window."""
    return sample_matches(samples, text, window).groupBy(window).agg(F.count("*").alias("reference_count"), F.count_distinct("match_id").alias("unique_matches"))


def sample_totals(samples: DataFrame, text: str = "value", window: str = "window") -> DataFrame:
    """One row over all windows: windows, references and distinct matches, each match counted once however many windows list it."""
    counted = sample_matches(samples, text, window).groupBy("match_id").count()
    totals = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("match_reference_count"), F.count("*").alias("unique_match_id_count"))
    return samples.agg(F.count_distinct(window).alias("window_count")).crossJoin(F.broadcast(totals))


def first_matches(samples: DataFrame, n: int, text: str = "value", window: str = "window") -> DataFrame:
    """The first n distinct matches of all lists, in window and list order; an error if there are fewer."""
    first = sample_matches(samples, text, window).groupBy("match_id").agg(F.min(F.struct(window, "position")).alias("place")).orderBy("place", "match_id").limit(n)
    if (found := first.count()) < n:
        raise ValueError(f"{n} matches wanted, {found} found")
    return first.select("match_id")


_DETAIL = "struct<data:struct<attributes:struct<mapName:string,gameMode:string,createdAt:string>>,included:array<struct<type:string,attributes:struct<name:string,URL:string>>>>"


def checked_matches(files: DataFrame, text: str = "value") -> DataFrame:
    """`files` with fault: why a match document cannot be used, null if it can.

    NOT_JSON, NO_DATA (no data object), NO_INCLUDED (included is no array), NO_TELEMETRY (no telemetry asset with an
    address), in this order. Documents with a fault are counted, not lost in a later join.
    """
    parsed = files.withColumn("v", F.try_parse_json(text))
    detail = F.from_json(F.col(text), _DETAIL)
    assets = F.filter(detail["included"], lambda a: (a["type"] == "asset") & (a["attributes"]["name"] == "telemetry") & (a["attributes"]["URL"] != ""))
    fault = (
        F.when(F.col("v").isNull(), "NOT_JSON")
        .when(~F.coalesce(_kind("data").startswith("OBJECT"), F.lit(False)), "NO_DATA")
        .when(~F.coalesce(_kind("included").startswith("ARRAY"), F.lit(False)), "NO_INCLUDED")
        .when(F.coalesce(F.size(assets), F.lit(0)) < 1, "NO_TELEMETRY")
    )
    return parsed.withColumn("fault", fault).drop("v")


def collection_report(checked: DataFrame, events: DataFrame, match: str = "match_id") -> DataFrame:
    """One row over checked_matches and telemetry events: documents asked for, sound ones with events, failures, and these by reason.

    A sound document without a telemetry event fails as NO_EVENTS.
    """
    told = events.groupBy(match).agg(F.count("*").alias("n"))
    reason = F.coalesce("fault", F.when(F.col("n").isNull(), "NO_EVENTS"))
    judged = checked.join(told, match, "left").select(reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("n"))
    names = ("NOT_JSON", "NO_DATA", "NO_INCLUDED", "NO_TELEMETRY", "NO_EVENTS")
    return judged.agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("reason").isNull()).alias("succeeded"),
        F.count_if(F.col("reason").isNotNull()).alias("failed"),
        *(F.count_if(F.col("reason") == n).alias(n.lower()) for n in names),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("event_count"),
    )


def match_details(files: DataFrame, text: str = "value") -> DataFrame:
    """Map, mode, time and telemetry address of match documents."""
    detail = F.from_json(F.col(text), _DETAIL)
    assets = F.filter(detail["included"], lambda a: (a["type"] == "asset") & (a["attributes"]["name"] == "telemetry"))
    attributes = detail["data"]["attributes"]
    return files.select(*(c for c in files.columns if c != text), attributes["mapName"].alias("map_name"), attributes["gameMode"].alias("game_mode"), attributes["createdAt"].alias("created_at"), F.get(assets, F.lit(0))["attributes"]["URL"].alias("telemetry_url"))
