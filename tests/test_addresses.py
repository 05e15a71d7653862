import pytest
from pyspark.sql import functions as F

from parcelmill.functions import address, geocode


def parsed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, address_text string")
    return [r.asDict() for r in address.parse_addresses(df).orderBy("i").collect()]


def test_missing_text_is_invalid(spark):
    (r,) = parsed(spark, None)
    assert r["address_is_valid"] is False and r["road"] is None


def test_protected_streets_come_back(spark):
    a, b = parsed(spark, "8 Rolph Place, Gilmore, ACT 2905", "1 new south wales crescent, Forrest, ACT 2603")
    assert (a["house_number"], a["road"], a["suburb"], a["state"], a["postcode"], a["address_is_valid"]) == ("8", "rolph place", "gilmore", "act", "2905", True)
    assert b["road"] == "new south wales crescent" and b["address_is_valid"]


@pytest.mark.parametrize("text, cleaned", [
    ("a  b", "a b"),
    ("Smith & Jones st", "Smith and Jones st"),
    ("1 High St, Reid 26...", "1 High St, Reid "),
    ("'The Mill'/4", "The Mill 4"),
    ("Unit 4, 5 High St", "4/5 High St"),
    ("Block 3 Section 9, Reid", "block __3__ section __9__, __no_street__ street, Reid"),
    ("Reid, Address available on request", "__address_available_on_request__ street, Reid"),
])
def test_clean_ups(spark, text, cleaned):
    assert spark.range(1).select(address.clean(F.lit(text))).first()[0] == cleaned


def test_validation(spark):
    def valid(*pairs):
        array = F.array(*[address.component(v, k) for k, v in pairs])
        return spark.range(1).select(address.valid_components(array)).first()[0]

    whole = [("suburb", "reid"), ("state", "act"), ("postcode", "2612")]
    assert valid(*whole)
    assert not valid(*whole, ("suburb", "city"))
    assert not valid(*whole, ("city", "canberra"))
    assert not valid(*whole[:2])
    assert valid(("suburb", "reid"), ("special", "address available on request"))
    assert not valid(*whole, ("road", "__x"))


def test_later_label_wins_and_city_stands_in(spark):
    array = F.array(address.component("a", "road"), address.component("b", "road"), address.component("canberra", "city"))
    r = spark.range(1).select(address.address_record(array).alias("a")).select("a.*").first()
    assert (r["road"], r["suburb"], r["address_is_valid"]) == ("b", "canberra", False)


def test_query_strings(spark):
    df = spark.createDataFrame([("the  mill", "4", "high st", "reid", "act", 2612), (None, "", "high st", "reid", None, 2612)], "house string, house_number string, road string, suburb string, state string, postcode int")
    got = [r[0] for r in df.select(geocode.query_string(F.col("postcode"))).collect()]
    assert got == ["the+mill/+4+high+st,+reid,+act+2612", "high+st,+reid,+2612"]


def test_geocode(spark):
    rows = spark.createDataFrame([(0, None, "2/ 7", "high st", "reid", "act", 2612), (1, None, "7", "low st", "reid", "act", 2612), (2, None, "9", "high st", "reid", "act", 2612)], "row_id long, house string, house_number string, road string, suburb string, state string, postcode int")
    gazetteer = spark.createDataFrame([("7", "High St", "Reid", "Australian Capital Territory", "2612", 149.1, -35.2, 1), ("7", "Other St", "Reid", "NSW", "2612", 1.0, 2.0, 0)], "number string, street string, city string, region string, postcode string, x double, y double, hit_rank int")
    for strict in (False, True):
        got = {r["row_id"]: (r["latitude"], r["geocoding_is_valid"]) for r in geocode.geocode(rows, gazetteer, strict=strict).collect()}
        assert got == {0: (-35.2, True), 1: (2.0, False), 2: (None, False)}


@pytest.mark.parametrize("text, house, number, road, suburb, valid", [
    ("12 Kurrajong Street Hawker ACT 2614", None, "12", "kurrajong street", "hawker", True),
    ("'The Grange'/9 Giles Street, Kingston, ACT 2604", "the grange", "9", "giles street", "kingston", True),
    ("Units 3-5/21 Lowe Street, Queanbeyan, NSW 2620", None, "units 3-5/21", "lowe street", "queanbeyan", True),
    ("Unit 3/21 Lowe Street, Queanbeyan, NSW 2620", None, "3/21", "lowe street", "queanbeyan", True),
    ("Unit 30 Lowe Street, Queanbeyan, NSW 2620", None, None, "lowe street", "queanbeyan", True),
    ("9 Kern Street 'Form', Yarralumla, ACT 2600", "form", "9", "kern street", "yarralumla", True),
    ("- Emu View, Kingston, ACT 2604", None, None, "emu view", "kingston", True),
    ("5 Wentworth Avenue, ACT 2604", None, "5", "wentworth avenue", None, False),
    ("Gundaroo, NSW 2620", None, None, None, "gundaroo", True),
    ("", None, None, None, None, False),
])
def test_grammar(spark, text, house, number, road, suburb, valid):
    (r,) = parsed(spark, text)
    assert (r["house"], r["house_number"], r["road"], r["suburb"], r["address_is_valid"]) == (house, number, road, suburb, valid)
