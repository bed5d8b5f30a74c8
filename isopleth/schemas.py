"""Schemas of the inputs and of the clean event table."""

from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


DEATHS = _schema(
    killed_by="s", killer_name="s", killer_placement="d", killer_position_x="d", killer_position_y="d", map="s", match_id="s", time="l",
    victim_name="s", victim_placement="d", victim_position_x="d", victim_position_y="d",
)
AGGREGATE = _schema(
    date="s", game_size="l", match_id="s", match_mode="s", party_size="l", player_assists="l", player_dbno="l", player_dist_ride="d",
    player_dist_walk="d", player_dmg="d", player_kills="l", player_name="s", player_survive_time="d", team_id="l", team_placement="l",
)
CLEAN_EVENTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "killed_by", "map", "match_id")]
    + [T.StructField("date", T.DateType())]
    + [T.StructField(n, T.DoubleType()) for n in ("victim_position_x", "victim_position_y")]
)
