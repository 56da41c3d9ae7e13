"""Parsing of semi-structured payloads stored as text columns (IO13, IO14).

Both are Spark jobs over tables of stored documents: JSON via ``from_json``
with a fixed schema, HTML row blocks via JVM-side regular expressions; no
per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, StringType, StructField,
                               StructType)

from delaylens import constants as K

GEOJSON_SCHEMA = StructType([StructField("features", ArrayType(StructType([
    StructField("properties", StructType([
        StructField("gtfs_stop_id", StringType(), True),
        StructField("stop_id", StringType(), True),
        StructField("stop_name", StringType(), True),
    ]), True),
    StructField("geometry", StructType([
        StructField("coordinates", ArrayType(DoubleType()), True),
    ]), True),
])), True)])


def stops_from_geojson(payloads: DataFrame, column: str = "value") -> DataFrame:
    """IO13: GeoJSON documents -> (gtfs_stop_id, stop_name, coordinates).

    The id falls back to ``stop_id``; features without id, name or
    coordinates (missing, empty or null geometry) are dropped.
    """
    doc = F.from_json(F.col(column), GEOJSON_SCHEMA)
    f = payloads.select(F.explode(doc["features"]).alias("f"))
    sid = F.coalesce(F.col("f.properties.gtfs_stop_id"), F.col("f.properties.stop_id"))
    out = f.select(sid.alias("gtfs_stop_id"), F.col("f.properties.stop_name").alias("stop_name"),
                   F.col("f.geometry.coordinates").alias("coordinates"))
    return out.where((F.length("gtfs_stop_id") > 0) & (F.length("stop_name") > 0)
                     & (F.size("coordinates") > 0))


# --- fixed values: markup of the match-list page ---------------------------
ROW_CLASS = "e-tables-table-overview__row"
CELL_LEAGUE = "e-tables-table-overview__cell--league"
CELL_ROUND = "e-tables-table-overview__cell--round"
CELL_GRAY = "e-tables-table-overview__cell--gray"
TEAM_LABEL = "e-tables-table-overview__result-team-label"
SCORE_INNER = "e-tables-table-overview__result-score-inner"
NO_SCORE = "- : -"


def _cell_texts(block, css_class: str, tag: str = "div"):
    """Inner texts of all ``<tag class="...css_class...">text</tag>`` cells."""
    pat = rf'<{tag}[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>\s*([^<]*?)\s*</{tag}>'
    return F.regexp_extract_all(block, F.lit(pat), 1)


def html_row_blocks(pages: DataFrame, row_class: str = ROW_CLASS, column: str = "html") -> DataFrame:
    """Split each page into its row blocks: from one row opening tag to the
    next (or the end of the page). One output row per block."""
    opening = rf'<div[^>]*class="[^"]*\b{row_class}\b[^"]*"[^>]*>'
    parts = F.split(F.col(column), opening)
    keep = [c for c in pages.columns if c != column]
    return (pages.select(*keep, F.posexplode(parts).alias("block_no", "block"))
            .where(F.col("block_no") > 0))


def matches_from_html(pages: DataFrame, team: str = K.HOME_TEAM, column: str = "html") -> DataFrame:
    """IO14: match rows from stored match-list pages: competition, round,
    date, time (third and fourth grey cells), teams, score, side, opponent."""
    from delaylens.operators.events import side_from_teams
    b = html_row_blocks(pages, column=column)
    gray = _cell_texts(F.col("block"), CELL_GRAY)
    teams = _cell_texts(F.col("block"), TEAM_LABEL)
    league = _cell_texts(F.col("block"), CELL_LEAGUE)
    rnd = _cell_texts(F.col("block"), CELL_ROUND)
    score = _cell_texts(F.col("block"), SCORE_INNER, tag="span")
    four = F.size(gray) >= 4
    out = b.select(
        *[c for c in b.columns if c != "block"],
        F.coalesce(F.try_element_at(teams, F.lit(1)), F.lit("")).alias("Home Team"),
        F.coalesce(F.try_element_at(teams, F.lit(2)), F.lit("")).alias("Away Team"),
        F.coalesce(F.try_element_at(league, F.lit(1)), F.lit("")).alias("Competition"),
        F.coalesce(F.try_element_at(rnd, F.lit(1)), F.lit("")).alias("Round"),
        F.when(four, F.try_element_at(gray, F.lit(3))).otherwise(F.lit("")).alias("Date"),
        F.when(four, F.try_element_at(gray, F.lit(4))).otherwise(F.lit("")).alias("Time"),
        F.coalesce(F.try_element_at(score, F.lit(1)), F.lit(NO_SCORE)).alias("Score"),
    )
    out = side_from_teams(out, team=team)
    return out.withColumn("datetime", F.concat_ws(" ", "Date", "Time"))


def link_blocks(pages: DataFrame, column: str = "html") -> DataFrame:
    """Repeated ``<li><a href="...">label</a></li>`` blocks of stored pages
    as (page_id, href, label) rows - the same block extraction applied to
    navigation lists."""
    pat = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    h = F.regexp_extract_all(F.col(column), F.lit(pat), 1)
    t = F.regexp_extract_all(F.col(column), F.lit(pat), 2)
    keep = [c for c in pages.columns if c not in (column, "url")]
    z = pages.select(*keep, F.explode(F.arrays_zip(h.alias("href"), t.alias("label"))).alias("z"))
    return z.select(*keep, "z.href", "z.label")
