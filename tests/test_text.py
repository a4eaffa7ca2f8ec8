import random
import re
import unicodedata

from pyspark.sql import functions as F

from lodestitch.functions import text as T


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_legal_forms(spark):
    names = ["ACME Industrial Holdings B.V.", "Acme Industrial Holdings BV", "acme industrial holding, b.v.", "Northgate Bluewater Logistics Inc.", "Bluewater Northgate Logistics Inc", "Smith & Sons, Inc.", "Smith and Sons Inc", "Acme Limited Liability Company", "Group Inc.", "", None, "Ind. Mfg"]
    got = col(spark, names, T.name_parts)
    assert {g.legal_suffix for g in got[:3]} == {"bv"}
    assert got[3].name_core_tokens == got[4].name_core_tokens
    assert got[5].normalized_name == got[6].normalized_name == "smith and sons inc"
    assert got[7].legal_suffix == "co" and got[7].name_core_tokens == ["acme", "liability"]
    assert got[8].name_core_tokens == [] and got[8].normalized_name == "inc"
    assert got[9].normalized_name == got[10].normalized_name == ""
    assert got[11].normalized_name == "industrial manufacturing"


def test_postal_codes(spark):
    texts = ["123 Maple St, Denver, CO 80202", "Kerkstraat 12, 1017 AB Amsterdam", "123 Maple St, Denver, CO", "4208 Sunset Avenue, Tulsa, 74103", "12 Oak St, Reno", "3267 Oak St, Reno", None]
    assert col(spark, texts, T.postal_from_address) == ["80202", "1017AB", "", "74103", "", "3267", ""]


def test_postal_against_plain_regex(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789  -,abAé") for _ in range(rng.randrange(25))) for _ in range(3000)]
    pattern = re.compile(T.POSTAL.removeprefix("(?U)"))
    want = [re.sub(r"[\s-]", "", m[-1]).upper() if (m := pattern.findall(t)) else "" for t in texts]
    assert col(spark, texts, T.postal_from_address) == want


def test_cities(spark):
    texts = ["500 Oak St, St. Louis, MO 63101", "Kerkstraat 12, 1017 AB Amsterdam", "Kerkstraat 12, 1017 AB, Amsterdam", "5 Elm St, Reno", "nowhere", "", None]
    assert col(spark, texts, T.city_from_address) == ["saint louis", "amsterdam", "1017 ab", "reno", "", "", ""]


def test_accents(spark):
    texts = ["Café ß Łódź ﬁne", "plain", "naïvé", "ØÆ", "①½"]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert col(spark, texts[:4], T.strip_accents) == [fold(t) for t in texts[:4]]


def test_soundex(spark):
    assert col(spark, ["robert", "rupert", "tymczak", "ashcraft", "123", "3com", "über"], T.soundex) == ["R163", "R163", "T522", "A261", "1000", "3250", "Ü160"]
