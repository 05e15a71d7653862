"""Free-form addresses: clean-up substitutions, component arrays, validation, and a rule grammar for parsing.

Components are arrays of struct<value, label>.  The statistical parser that a deployment may have is pluggable: any
function from a text column to such an array; the default is a grammar of rules over comma-separated parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substitutions before parsing, in order (Java syntax, flags in front).
CLEAN_UPS = [
    (r"  ", r" "),
    (r"([a-zA-Z]+)(?: & )([a-zA-Z]+)", r"$1 and $2"),
    (r"(.*)(?:\d{2}\.{3})$", r"$1"),
    (r"(.*)(?:\.{3})$", r"$1"),
    (r"^(\. )", r""),
    (r"'([a-zA-Z ]+)'/", r"$1 "),
    (r"'([a-zA-Z ]+)'", r"$1"),
    (r"^(\d+) (-\d+)", r"$1$2"),
    (r"(?i)([a-zA-Z ]+)/blocks ([0-9]+)- section ([0-9]+), ", r"$1 block __$2__ section __$3__, __no_street__ street, "),
    (r"(?i)block ([a-zA-Z0-9]+) section ([a-zA-Z0-9]+)( [a-zA-Z]+)?, ", r"block __$1__ section __$2__$3, __no_street__ street, "),
    (r"(?i)^(?:\* |\*/\* )\(no street name\), ", r"__no_street__ street, "),
    (r"(?i)^(.*), address available on request$", r"__address_available_on_request__ street, $1"),
    (r"(?i)^units? (\d+), ", r"$1/"),
    (r"(?i)(\d+ taggerty), (ngunnawal)", r"$1 Street, $2"),
    (r"(?i)(\d+ yerradhang), (ngunnawal)", r"$1 Street, $2"),
    (r"(?i)(\d+ bunda), (city)", r"$1 Street, $2"),
    (r"(?i)(\d+ chaseling), (phillip)", r"$1 Street, $2"),
    (r"(?i)(\d+ constitution), (reid)", r"$1 Avenue, $2"),
    (r"(?i)(1-9 totterdell), (belconnen)", r"$1 Street, $2"),
    (r"(?i)^(\d+/\d+) manhattan on the park ([a-zA-Z]+)", r"__manhattan_on_the_park__ $1 $2"),
    (r"(?i)^(nibu) - (\d+)", r"__$1__ $2"),
    (r"(?i)^(\d+ [a-zA-Z ]+) (form), ", r"__$2__ $1, "),
    (r"(?i)^(\d+ [a-zA-Z ]+) (hudson) (square), ", r"__$2_$3__ $1, "),
    (r"(?i)^(\d+) (mosaic),(\d+)", r"__$2__ $1/$3"),
    (r"(?i)^(malmo) (\d+)", r"__$1__, $2"),
]
# Street names that are protected while an address is parsed.
PROTECTED_STREETS = [
    "macfarlane burnet avenue", "newman morris circuit", "rolph place", "hesel tine street", "millhouse crescent", "lads place", "hobday place", "buckmaster crescent", "tarrant crescent",
    "greg urwin circuit", "fleay place", "barraclough crescent", "quinlivan crescent", "jeff snell crescent", "menzel crescent", "glenbawn place", "nullarbor avenue", "elia ware crescent",
    "elphick place", "lawrenson circuit", "shirley taylor place", "pedrail place", "ulysses circuit", "flower place", "chinner crescent", "medley st", "bambridge crescent", "arden place",
    "florence taylor street", "ern florence crescent", "New South Wales Crescent", "elizabeth jolley crescent",
]
# Components replaced after parsing, (value, label) by (value, label).
REPLACED_COMPONENTS = [
    (("__act__", "road"), ("act", "state")),
    (("__act__", "city"), ("act", "state")),
    (("__nibu__", "house"), ("nibu", "house")),
    (("__form__", "house"), ("form", "house")),
    (("__hudson_square__", "house"), ("hudson square", "house")),
    (("__mosaic__", "house"), ("mosaic", "house")),
    (("__malmo__", "house"), ("malmo", "house")),
    (("__manhattan_on_the_park__", "house"), ("manhattan on the park", "house")),
    (("__address_available_on_request__ street", "road"), ("address available on request", "special")),
]
# Labels of which an address needs one each, and names of states.
REQUIRED = (("state", "special"), ("postcode", "special"), ("city", "suburb"))
STATES = {
    "queensland": "qld",
    "new south wales": "nsw",
    "australian capital territory": "act",
    "victoria": "vic",
    "south australia": "sa",
    "tasmania": "tas",
    "western australia": "wa",
    "northern territory": "nt",
}
#: Words that end a street's name.
STREET_KINDS = ("street", "st", "place", "avenue", "ave", "crescent", "circuit", "court", "close", "drive", "road", "rd", "terrace", "view", "way", "lane", "parade", "loop", "boulevard", "highway", "walk", "rise", "gardens", "square")

COMPONENTS = "array<struct<value: string, label: string>>"


def protected(street: str) -> str:
    return f"__{street.replace(' ', '_')}__ street"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it: a one-element array's transform."""
    return F.transform(F.array(value), body)[0]


def clean(text: Column) -> Column:
    """All substitutions, then the street protections (any case), each once and only where one of the streets is there."""
    for pattern, replacement in CLEAN_UPS:
        text = F.regexp_replace(text, pattern, replacement)
    patterns = {s: f"{re.escape(s).replace(chr(92) + ' ', ' ')}, " for s in PROTECTED_STREETS}

    def protect(found):
        marked = found
        for street, pattern in patterns.items():
            marked = F.regexp_replace(marked, f"(?i){pattern}", protected(street) + ", ")
        return F.when(found.rlike(f"(?i){'|'.join(patterns.values())}"), marked).otherwise(found)

    return let(text, protect)


def component(value: Column | str, label: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(value).alias("value"), as_column(label).alias("label"))


def restore(components: Column) -> Column:
    """Undo the protections: fake streets go, marks of blocks and known replacements come off."""
    kept = F.filter(components, lambda c: ~((c["value"] == "__no_street__ street") & (c["label"] == "road")))
    block = r"^.*block __[a-z0-9]+__ section __[a-z0-9]+__"
    kept = F.transform(kept, lambda c: component(F.when(c["value"].rlike(block), F.regexp_replace(c["value"], "__", "")).otherwise(c["value"]), c["label"]))
    table = {f"{v}|{label}": f"{w}|{other}" for (v, label), (w, other) in REPLACED_COMPONENTS}
    table |= {f"{protected(s).lower()}|road": f"{s.lower()}|road" for s in PROTECTED_STREETS}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def swapped(c):
        found = F.element_at(known, F.concat(c["value"], F.lit("|"), c["label"]))
        return F.when(found.isNotNull(), component(F.split_part(found, F.lit("|"), F.lit(1)), F.split_part(found, F.lit("|"), F.lit(2)))).otherwise(c)

    return F.transform(kept, swapped)


def parse_by_rules(text: Column) -> Column:
    """The default grammar, over lower-case text.

    A trailing postcode and state are taken off; the last comma-separated part is then the suburb, and the one before it
    the street.  A part that stands alone is cut after its last word that names a kind of street.  Of the street, a marked
    name or words before a number are the house, a leading unit is the unit, a leading number the house number, and the
    rest the road.  Earlier parts are the house.
    """
    absent = lambda c: F.nullif(c, F.lit(""))
    names = "|".join([*STATES, *STATES.values()])
    kinds = rf"^(.*\b(?:{'|'.join(STREET_KINDS)}))(?: (.+))?$"
    house = r"^(__\w+?__(?= (?!street))|(?!lot |block |corner |units? )[a-z][a-z' ]*?(?= \d)) "
    unit = r"^(unit(?= \d+/)|unit \d+[a-z]?(?= [a-z])) "
    number = r"^((?:units )?[a-z]?\d+[a-z]?(?:\s*[-/&]\s*\d+[a-z]?)*)\s+"

    def whole(t):
        postcode = F.regexp_extract(t, r"(?:^|[ ,])(\d{4})$", 1)
        return let(F.trim(F.regexp_replace(t, r"[ ,]*(?:^|[ ,])\d{4}$", "")), lambda rest: without_code(rest, postcode))

    def without_code(t, postcode):
        state = F.regexp_extract(t, rf"(?:^|[ ,])({names})$", 1)
        rest = F.regexp_replace(t, rf"[ ,]*(?:^|[ ,])(?:{names})$", "")
        parts = F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p != "")
        return let(parts, lambda found: let(cut_alone(found), lambda cut: places(found, cut, state, postcode)))

    def cut_alone(parts):
        """A single part's street and what follows it, or two empty texts."""
        last = F.try_element_at(parts, F.lit(-1))
        one = F.size(parts) == 1
        return F.struct(F.when(one, F.regexp_extract(last, kinds, 1)).otherwise("").alias("street"), F.when(one, F.regexp_extract(last, kinds, 2)).otherwise("").alias("rest"))

    def places(parts, cut, state, postcode):
        n, last = F.size(parts), F.try_element_at(parts, F.lit(-1))
        suburb = F.when(cut["street"] != "", absent(cut["rest"])).otherwise(last)
        street = F.regexp_replace(F.when(n >= 2, F.try_element_at(parts, F.lit(-2))).when(cut["street"] != "", cut["street"]), r"^- ", "")
        earlier = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ", "))
        ends = (component(suburb, "suburb"), component(absent(state), "state"), component(absent(postcode), "postcode"))
        return let(street, lambda s: let(F.regexp_replace(s, house, ""), lambda rest: let(F.regexp_replace(rest, unit, ""), lambda road: F.array(
            component(F.coalesce(absent(F.regexp_extract(s, house, 1)), earlier), "house"), component(absent(F.regexp_extract(rest, unit, 1)), "unit"),
            component(absent(F.regexp_extract(road, number, 1)), "house_number"), component(absent(F.trim(F.regexp_replace(road, number, ""))), "road"), *ends,
        ))))

    return F.filter(let(F.trim(F.lower(text)), whole), lambda c: c["value"].isNotNull())


def labels(components: Column) -> Column:
    return F.transform(components, lambda c: c["label"])


def valid_components(components: Column) -> Column:
    """No label twice, not both suburb and city, one of each required set, and no value that begins with a mark."""
    names = labels(components)
    ok = (F.size(F.array_distinct(names)) == F.size(names)) & ~(F.array_contains(names, "suburb") & F.array_contains(names, "city"))
    for choices in REQUIRED:
        ok = ok & F.arrays_overlap(names, F.array(*[F.lit(c) for c in choices]))
    return F.coalesce(ok & ~F.exists(components, lambda c: F.startswith(c["value"], F.lit("__"))), F.lit(False))


def address_record(components: Column) -> Column:
    """The components as a struct of seven; of a repeated label the later one counts, and suburb falls back to city."""
    def value(label):
        own = F.filter(components, lambda c: c["label"] == label)
        return F.try_element_at(own, F.lit(-1))["value"]

    return F.struct(
        value("house").alias("house"), value("house_number").alias("house_number"), value("road").alias("road"), F.coalesce(value("suburb"), value("city")).alias("suburb"),
        value("state").alias("state"), value("postcode").alias("postcode"), valid_components(components).alias("address_is_valid"),
    )


def parse_addresses(df: DataFrame, text: str = "address_text", parser: Callable[[Column], Column] = parse_by_rules) -> DataFrame:
    """The table with the seven address columns; those it has already are overwritten.  Missing text is invalid."""
    parsed = df.withColumn("_components", F.when(F.col(text).isNotNull(), restore(parser(clean(F.col(text))))))
    parsed = parsed.withColumn("_address", address_record(F.col("_components")))
    fields = ("house", "house_number", "road", "suburb", "state", "postcode", "address_is_valid")
    return parsed.withColumns({f: F.col("_address")[f] for f in fields}).drop("_components", "_address")
