"""Token layout of trip sequences.

Tokens are laid out as delta buckets, three markers, route x direction, stop name, weekday, hour and the
skip marker. Routes and stop names are configuration; the layout follows from the sizes of the two lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The metro routes and the stop names, each in token order.
METRO_ROUTES = [
    "9011001001000000", "9011001001100000", "9011001001300000", "9011001001400000", "9011001001700000",
    "9011001001800000", "9011001001900000",
]
METRO_STOPS = [
    "Kungsträdgården", "T-Centralen", "Rådhuset", "Fridhemsplan", "Stadshagen", "Västra skogen", "Huvudsta",
    "Solna strand", "Sundbybergs centrum", "Duvbo", "Rissne", "Rinkeby", "Tensta", "Hjulsta", "Solna centrum",
    "Näckrosen", "Hallonbergen", "Kymlinge norrut", "Kista", "Husby", "Akalla", "Kymlinge söderut", "Norsborg",
    "Hallunda", "Alby", "Fittja", "Masmo", "Vårby gård", "Vårberg", "Skärholmen", "Sätra", "Bredäng", "Mälarhöjden",
    "Axelsberg", "Örnsberg", "Aspudden", "Liljeholmen", "Hornstull", "Zinkensdamm", "Mariatorget", "Slussen",
    "Gamla stan", "Östermalmstorg", "Karlaplan", "Gärdet", "Ropsten", "Mörby centrum", "Danderyds sjukhus",
    "Bergshamra", "Universitetet", "Tekniska högskolan", "Stadion", "Fruängen", "Västertorp", "Hägerstensåsen",
    "Telefonplan", "Midsommarkransen", "Skarpnäck", "Bagarmossen", "Kärrtorp", "Björkhagen", "Hammarbyhöjden",
    "Skärmarbrink", "Gullmarsplan", "Skanstull", "Medborgarplatsen", "Hötorget", "Rådmansgatan", "Odenplan",
    "S:t Eriksplan", "Thorildsplan", "Kristineberg", "Alvik", "Stora mossen", "Abrahamsberg", "Brommaplan",
    "Åkeshov", "Ängbyplan", "Islandstorget", "Blackeberg", "Råcksta", "Vällingby", "Johannelund", "Hässelby gård",
    "Hässelby strand", "Farsta strand", "Farsta", "Hökarängen", "Gubbängen", "Tallkrogen", "Skogskyrkogården",
    "Sandsborg", "Blåsut", "Hagsätra", "Rågsved", "Högdalen", "Bandhagen", "Stureby", "Svedmyra", "Sockenplan",
    "Enskede gård", "Globen",
]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

MAX_DELTA = 15
ZERO_DELTA = 15
SOS, EOS, PAD = 31, 32, 33


@dataclass(frozen=True)
class Layout:
    """Token offsets for given vocabulary sizes."""

    routes: int = len(METRO_ROUTES)
    stops: int = len(METRO_STOPS)

    @property
    def route0(self) -> int:
        return PAD + 1

    @property
    def stop0(self) -> int:
        return self.route0 + 2 * self.routes

    @property
    def weekday0(self) -> int:
        return self.stop0 + self.stops

    @property
    def hour0(self) -> int:
        return self.weekday0 + 7

    @property
    def skip(self) -> int:
        return self.hour0 + 24

    @property
    def size(self) -> int:
        return self.skip + 1


def delta_token(seconds: Column) -> Column:
    """Delay change truncated to minutes, clamped to +-15 and moved to 0..30."""
    minutes = F.call_function("div", seconds, F.lit(60))
    return (F.greatest(F.least(minutes, F.lit(MAX_DELTA)), F.lit(-MAX_DELTA)) + ZERO_DELTA).cast("int")


def token_minutes(token: Column) -> Column:
    """Delay change in minutes of a token; tokens that are no delta count as 0."""
    return F.when(token > 2 * MAX_DELTA, 0).otherwise(token - ZERO_DELTA)


def route_tokens(spark: SparkSession, routes: list[str] = METRO_ROUTES) -> DataFrame:
    return spark.createDataFrame([(r, i) for i, r in enumerate(routes)], "route_id string, route_ix int")


def stop_tokens(spark: SparkSession, stops: list[str] = METRO_STOPS) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(stops)], "stop_name string, stop_ix int")


def token_table(routes: DataFrame, stops: DataFrame, layout: Layout) -> DataFrame:
    """The whole vocabulary as rows ``(token, text, kind)``; unique in both directions.

    ``routes`` has ``(route_id, route_ix)`` and ``stops`` has ``(stop_name, stop_ix)``.
    """
    spark = routes.sparkSession
    delta = F.when(F.col("id") < ZERO_DELTA, F.concat(F.lit("d-"), ZERO_DELTA - F.col("id"))).otherwise(
        F.concat(F.lit("d+"), F.col("id") - ZERO_DELTA)
    )
    fixed = [(SOS, "<sos>", "marker"), (EOS, "<eos>", "marker"), (PAD, "<pad>", "marker")]
    fixed += [(layout.weekday0 + i, day, "weekday") for i, day in enumerate(WEEKDAYS)]
    fixed += [(layout.hour0 + h, f"h{h}", "hour") for h in range(24)]
    fixed += [(layout.skip, "<skp>", "marker")]
    directions = F.explode(F.array(F.lit(0), F.lit(1)))
    return (
        spark.range(2 * MAX_DELTA + 1)
        .select(F.col("id").cast("int").alias("token"), delta.alias("text"), F.lit("delta").alias("kind"))
        .unionByName(spark.createDataFrame(fixed, "token int, text string, kind string"))
        .unionByName(
            routes.select("*", directions.alias("dir")).select(
                (layout.route0 + layout.routes * F.col("dir") + F.col("route_ix")).cast("int").alias("token"),
                F.concat_ws("|", "route_id", "dir").alias("text"),
                F.lit("route").alias("kind"),
            )
        )
        .unionByName(
            stops.select(
                (layout.stop0 + F.col("stop_ix")).cast("int").alias("token"),
                F.col("stop_name").alias("text"),
                F.lit("stop").alias("kind"),
            )
        )
    )
