"""Geocoding against a reference address table: query strings, street numbers, hit choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .address import STATES
from .ordering import meet

#: What is taken out of address parts, and the suffix of each part of a query.
UNWANTED = r"""["'*^]|%22"""
PART_SUFFIXES = (("house", "/"), ("house_number", ""), ("road", ","), ("suburb", ","), ("state", ""))
#: Largest gazetteer side, in rows, that is broadcast.
BROADCAST_ROWS = 200_000


def clean_part(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, UNWANTED, ""), r"^\s+|\s+$", "")


def clean_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_part(F.col(c)) for c in ("house", "house_number", "road", "suburb")})


def query_string(postcode: Column) -> Column:
    """The parts that are there, each with its suffix, joined by plus signs; blanks become plus signs too."""
    parts = [F.when(F.length(F.col(c)) > 0, F.concat(F.col(c), F.lit(s))) for c, s in PART_SUFFIXES]
    return F.concat(F.regexp_replace(F.concat_ws("+", *parts), r"\s+", "+"), F.format_string("+%.0f", postcode.cast("double")))


def street_number(c: Column) -> Column:
    """What follows the last slash, lower case, without leading blanks."""
    return F.regexp_replace(F.regexp_extract(F.lower(c), r"([^/]*)$", 1), r"^\s+", "")


def same_number(number: Column, wanted: Column) -> Column:
    found = street_number(wanted)
    return (F.lower(number) == found) & (found != "")


def state_code(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    low = F.lower(c)
    return F.coalesce(F.element_at(table, low), low)


def hit_pairs(strict: bool = False) -> list[tuple[str, str]]:
    """What a hit and an address have to share: the street alone, or street, city, region and postcode if strict."""
    return [("hit_street", "road"), ("hit_city", "suburb"), ("hit_region", "state"), ("hit_postcode", "postcode")][: None if strict else 1]


def first_hit(hits: Column, wanted: Column) -> Column:
    """The first of an array of hits (struct with number) that has the street number."""
    return F.try_element_at(F.filter(hits, lambda h: same_number(h["number"], wanted)), F.lit(1))


def geocode(addresses: DataFrame, gazetteer: DataFrame, key: str = "row_id", strict: bool = False) -> DataFrame:
    """Addresses with latitude, longitude and geocoding_is_valid from a gazetteer.

    gazetteer: number, street, city, region, postcode, x, y, hit_rank.  Hits share suburb and street number; the road, and
    then the smallest rank, choose among them.  Without a hit: null, null, false.

    Only the best entry of all that an address cannot tell apart is ever a hit, so the gazetteer is brought down to those
    first: an address meets two rows at most, the best of its own street and the best of its suburb and number.
    """
    cleaned = clean_parts(addresses)
    asked = cleaned.withColumns({"_number": street_number(F.col("house_number")), "_suburb": F.lower("suburb")})
    place, pairs = ["_number", "_suburb"], hit_pairs(strict)
    codes = [f"_{hit}" for hit, _ in pairs]
    order = F.struct(F.col("hit_rank").isNull().alias("unranked"), "hit_rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    table = gazetteer.select(
        F.lower("number").alias("_number"), F.lower("city").alias("_suburb"), order.alias("_order"),
        *[state_code(F.col(hit.removeprefix("hit_")).cast("string")).alias(c) for c, (hit, _) in zip(codes, pairs, strict=True)],
    ).where("_number IS NOT NULL AND _suburb IS NOT NULL")
    own = table.groupBy(*place, *codes).agg(F.min("_order").alias("_own"))
    any_ = table.groupBy(*place).agg(F.min("_order").alias("_any"))
    asked = asked.withColumns({c: state_code(F.col(part).cast("string")) for c, (_, part) in zip(codes, pairs, strict=True)})

    def joined(rows: DataFrame, hits: DataFrame, by: list[str]) -> DataFrame:
        few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return rows.join(F.broadcast(hits), by, "left") if few else meet(rows, hits, by, "left")

    met = joined(joined(asked, own, [*place, *codes]), any_, place)
    met = met.select(*addresses.columns, F.col("_own").isNotNull().alias("_ok"), F.coalesce("_own", "_any").alias("_hit"))
    best = Window.partitionBy(key).orderBy(F.desc("_ok"), F.col("_hit.hit_rank").asc_nulls_last())
    first = met.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return first.select(*addresses.columns, F.col("_hit.y").alias("latitude"), F.col("_hit.x").alias("longitude"), F.col("_ok").alias("geocoding_is_valid"))


# --- forgiving hits ------------------------------------------------------------------------------------------------

#: Edits that a street's name may be away, and characters from which on it may be.
MOST_EDITS = 2
LEAST_CHARS = 4


def street_pieces(street: Column, size: Column, side: str) -> Column:
    """Keys under which streets within MOST_EDITS edits meet: one of three parts of a name is left as it is.

    side "kept": the parts of a name of its own length.  side "asked": for every length that the other name may have and
    every place that its part may have moved to, the substring there.
    """
    third = lambda n, i: F.floor(n * i / (MOST_EDITS + 1)).cast("int")
    pieces = []
    for i in range(MOST_EDITS + 1):
        if side == "kept":
            start, end = third(size, i), third(size, i + 1)
            pieces.append(F.array(F.struct(size.alias("size"), F.lit(i).alias("part"), F.substr(street, start + 1, end - start).alias("piece"))))
        else:
            for more in range(-MOST_EDITS, MOST_EDITS + 1):
                n = size + more
                start, end = third(n, i), third(n, i + 1)
                moves = F.array(*[F.when((start + m >= 0) & (end + m <= size), F.struct(n.alias("size"), F.lit(i).alias("part"), F.substr(street, start + m + 1, end - start).alias("piece"))) for m in range(-MOST_EDITS, MOST_EDITS + 1)])
                pieces.append(F.when(n > MOST_EDITS, F.filter(moves, lambda p: p.isNotNull())))
    return F.array_distinct(F.flatten(F.filter(F.array(*pieces), lambda p: p.isNotNull())))


def near_streets(asked: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """suburb, road, street, edits: the gazetteer's streets of a suburb within MOST_EDITS edits of a road asked for.

    asked: suburb, road; gazetteer: suburb, street; all in lower case.  Names of fewer than LEAST_CHARS characters have
    to be equal.  A street that is meant shares one of three parts with the road, so both sides are posted under parts
    and only streets that meet are measured: no suburb is paired with itself, and none is left out.
    """
    roads = asked.select("suburb", "road").where("suburb IS NOT NULL AND road IS NOT NULL").distinct()
    streets = gazetteer.select("suburb", "street").where("suburb IS NOT NULL AND street IS NOT NULL").distinct()
    same = roads.join(streets.withColumn("road", F.col("street")), ["suburb", "road"]).withColumn("edits", F.lit(0))
    long = F.length("road") >= LEAST_CHARS
    wanted = roads.where(long).select("suburb", "road", F.explode(street_pieces(F.col("road"), F.length("road"), "asked")).alias("key"))
    held = streets.where(F.length("street") >= LEAST_CHARS).select("suburb", "street", F.explode(street_pieces(F.col("street"), F.length("street"), "kept")).alias("key"))
    met = wanted.join(held, ["suburb", "key"]).where("road <> street").select("suburb", "road", "street").distinct()
    near = met.withColumn("edits", F.levenshtein("road", "street", MOST_EDITS)).where(F.col("edits").between(1, MOST_EDITS))
    return same.select("suburb", "road", "street", "edits").unionByName(near)


def geocode_forgiving(addresses: DataFrame, gazetteer: DataFrame, key: str = "row_id") -> DataFrame:
    """Addresses with latitude, longitude, street_found, edits and geocoding_is_valid; spelling may be off a little.

    The suburb and street number must be equal, the street within MOST_EDITS edits; fewest edits first, then the
    smallest rank, then the street's name.  Without a hit: nulls and false.  Missing parts hit nothing; addresses that
    are repeated are answered each; an empty gazetteer hits nothing.
    """
    asked = clean_parts(addresses).select(F.col(key).alias("_key"), F.lower("suburb").alias("suburb"), F.lower("road").alias("road"), street_number(F.col("house_number")).alias("number")).where("number <> ''")
    table = gazetteer.select(F.lower("city").alias("suburb"), F.lower("street").alias("street"), F.lower("number").alias("number"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "hit_rank")
    # Of entries that share suburb, street and number only the first can be a hit.
    rank = F.coalesce("hit_rank", F.lit((1 << 31) - 1)).alias("r")
    first = table.groupBy("suburb", "street", "number").agg(F.min(F.struct(rank, "x", "y")).alias("_first")).select("suburb", "street", "number", "_first.*")
    hits = asked.join(near_streets(asked, table), ["suburb", "road"]).join(first, ["suburb", "street", "number"])
    order = F.struct("edits", "r", "street", "x", "y")
    best = hits.groupBy("_key").agg(F.min_by(F.struct("x", "y", "street", "edits"), order).alias("_hit"))
    found = addresses.join(best, F.col(key) == F.col("_key"), "left")
    return found.select(*addresses.columns, F.col("_hit.y").alias("latitude"), F.col("_hit.x").alias("longitude"), F.col("_hit.street").alias("street_found"), F.col("_hit.edits").alias("edits"), F.col("_hit").isNotNull().alias("geocoding_is_valid"))
