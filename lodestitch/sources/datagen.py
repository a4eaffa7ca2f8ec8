"""Made-up multi-source entities with known truth.

Rows come from ``spark.range`` and hashes of ``(seed, id, purpose)``, so any row can be
made anywhere, in any order, at any scale.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.sources import files

# Word stocks of this generator.
_FIRST = "Alder Basalt Cinder Dunmore Elmfield Farrow Gable Hazel Inver Juniper Kestrel Larch Mallow Northam Orchard Penrose Quarry Rowan Saltire Thistle Upland Verity Willow Yarrow".split()
_TRADE = "Bakery Carpentry Chandlery Drainage Electric Fabrics Glazing Haulage Instruments Joinery Kitchens Leather Masonry Nurseries Optics Plumbing Quilting Roofing Surveying Textiles Upholstery Vending".split()
_EXTRA = "Trading Partners Works Supply".split()
_STREETS = "Oak Mill Harbor Chapel Orchard Station Bridge Garden Castle Spring".split()
_US = (("Austin", "787"), ("Boise", "837"), ("Fresno", "937"), ("Mobile", "366"), ("Omaha", "681"), ("Provo", "846"), ("Tampa", "336"), ("Utica", "135"))
_EU = (("Breda", "48"), ("Delft", "26"), ("Leiden", "23"), ("Utrecht", "35"), ("Zwolle", "80"))
_US_FORMS = (("Inc.", "Incorporated"), ("LLC", "L.L.C."), ("Corp.", "Corporation"), ("Co.", "Company"))
_EU_FORMS = (("B.V.", "BV"), ("N.V.", "NV"), ("GmbH", "GmbH"), ("Holding", "Holdings"))


@dataclass
class Generated:
    loaded: DataFrame
    truth: DataFrame
    source_rows: DataFrame


class _Dice:
    def __init__(self, seed: int):
        self.seed = seed

    def number(self, purpose: str, below: int, *on: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(purpose), *on), F.lit(below)).cast("int")

    def chance(self, purpose: str, share: float, *on: Column) -> Column:
        return self.number(purpose, 1_000_000, *on) < int(share * 1_000_000)

    def choice(self, purpose: str, stock, *on: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, stock)), self.number(purpose, len(stock), *on) + 1)


def _typo(text: Column, dice: _Dice, *on: Column) -> Column:
    """One swap, loss, repetition or neighbouring letter inside a text of four characters or more."""
    at = dice.number("typo at", 1 << 20, *on) % F.greatest(F.length(text) - 2, F.lit(1)) + 2
    head, c, d, tail = F.substr(text, F.lit(1), at - 1), F.substr(text, at, F.lit(1)), F.substr(text, at + 1, F.lit(1)), F.substr(text, at + 2)
    kind = dice.number("typo kind", 4, *on)
    near = F.translate(c, "abcdefghijklmnopqrstuvwxyz", "svxswdfyujkbjpioqeagtyixrs"[:26].ljust(26, "e"))
    made = F.when(kind == 0, F.concat(head, d, c, tail)).when(kind == 1, F.concat(head, d, tail)).when(kind == 2, F.concat(head, c, c, d, tail)).otherwise(F.concat(head, near, d, tail))
    return F.when(F.length(text) < 4, text).otherwise(made)


def generate(spark: SparkSession, n_entities: int = 350, confusable_fraction: float = 0.12, seed: int = 42, missing_field_rate: float = 0.12) -> Generated:
    """Entities seen by up to three sources under mangled names and thinned-out addresses.

    A share of entities comes in pairs of namesakes in different cities.
    """
    dice, e = _Dice(seed), F.col("entity")
    twins = 2 * int(n_entities * confusable_fraction / 2)
    twin = e < twins
    brand = F.when(twin, F.floor(e / 2)).otherwise(e)
    us = dice.chance("region", 0.6, brand) | twin
    place = lambda stock, i: F.element_at(F.array(*[F.lit(s[i]) for s in stock]), F.pmod(dice.number("city", 1000, brand) + F.when(twin, e % 2).otherwise(F.lit(0)), F.lit(len(stock))).cast("int") + 1)
    base = spark.range(n_entities).select(F.col("id").alias("entity"))
    base = base.withColumn("us", us).withColumn("confusable", twin)
    extra = F.when(dice.chance("extra", 0.4, brand), F.concat(F.lit(" "), dice.choice("extra word", _EXTRA, brand))).otherwise(F.lit(""))
    core = F.concat_ws(" ", dice.choice("first", _FIRST, brand), dice.choice("trade", _TRADE, brand))
    base = base.withColumn("core", F.concat(core, extra)).withColumn("form", dice.number("form", 4, brand))
    base = base.withColumn("street", F.concat_ws(" ", (dice.number("house", 9000, e) + 12).cast("string"), dice.choice("street", _STREETS, e), F.when(F.col("us"), dice.choice("way", ("St", "Ave", "Rd"), e)).otherwise(F.lit("Straat"))))
    base = base.withColumn("city", F.when(F.col("us"), place(_US, 0)).otherwise(place(_EU, 0)))
    digits = F.lpad(dice.number("zip", 100, e).cast("string"), 2, "0")
    base = base.withColumn("postal", F.when(F.col("us"), F.concat(place(_US, 1), digits)).otherwise(F.concat(place(_EU, 1), digits, F.lit(" "), dice.choice("letters", ("AB", "CD", "KL", "XZ"), e))))
    times = F.when(F.col("confusable"), dice.number("times", 2, e) + 2).otherwise(dice.choice("times", (2, 2, 3, 3, 4), e))
    seen = base.withColumn("look", F.explode(F.sequence(F.lit(0), times - 1)))
    on = (e, F.col("look"))
    source = F.element_at(F.array(*map(F.lit, files.LOADERS)), F.pmod(dice.number("from", 3, e) + F.col("look"), F.lit(3)).cast("int") + 1)
    forms = lambda i: F.when(F.col("us"), F.element_at(F.array(*[F.lit(x[i]) for x in _US_FORMS]), F.col("form") + 1)).otherwise(F.element_at(F.array(*[F.lit(x[i]) for x in _EU_FORMS]), F.col("form") + 1))
    plain = F.concat_ws(" ", "core", forms(0))
    parts = F.split("core", " ")
    turned = F.concat_ws(" ", F.array_join(F.reverse(parts), " "), forms(0))
    roll = dice.number("mangle", 100, *on)
    name = (
        F.when(roll < 20, F.col("core"))
        .when(roll < 35, F.concat_ws(" ", "core", forms(1)))
        .when((roll < 50) & (F.size(parts) > 2), turned)
        .when((roll >= 50) & (roll < 60), F.regexp_replace(F.regexp_replace(plain, "Partners", "Assoc"), "Trading", "Intl"))
        .when((roll >= 60) & (roll < 78), _typo(plain, dice, *on))
        .when((roll >= 78) & (roll < 88), F.upper(plain))
        .otherwise(plain)
    )
    seen = seen.withColumn("source", source).withColumn("name", name).withColumn("street", F.when(dice.chance("street typo", 0.3, *on), _typo(F.col("street"), dice, *on, F.lit(1))).otherwise(F.col("street")))
    seen = seen.withColumn("postal", F.when(dice.chance("no postal", missing_field_rate, *on), "").otherwise(F.col("postal"))).withColumn("city", F.when(dice.chance("no city", 0.4 * missing_field_rate, *on), "").otherwise(F.col("city")))
    number = F.row_number().over(Window.partitionBy("source").orderBy("entity", "look"))
    prefix = F.when(F.col("source") == "registry", "REG-").when(F.col("source") == "directory", "DIR-").otherwise("CRM-")
    rows = seen.withColumn("row", number.cast("long")).withColumn("external_id", F.concat(prefix, F.lpad(F.col("row").cast("string"), 5, "0"))).withColumn("true_entity_id", F.concat(F.lit("E"), F.lpad(e.cast("string"), 6, "0")))
    address = F.when(F.col("source") == "crm", files.joined("street", "city")).otherwise(files.joined("street", "city", "postal"))
    structured = F.col("source") != "directory"
    order = F.array_position(F.array(*map(F.lit, files.LOADERS)), F.col("source")).cast("int") - 1
    loaded = rows.select("source", "external_id", F.col("name").alias("raw_name"), address.alias("raw_address"), F.when(structured, F.col("city")).otherwise("").alias("city"), F.when(structured, F.col("postal")).otherwise("").alias("postal_code"), "row", order.alias("source_order"))
    truth = rows.select("source", "external_id", "true_entity_id", F.col("confusable").alias("is_confusable_distinct"))
    return Generated(loaded, truth, rows.select("source", "external_id", "name", "street", "city", "postal", "us", "row"))


def write_dataset(made: Generated, folder: str | Path, seed: int = 42) -> dict[str, Path]:
    """The source files and the ground truth as single CSV files."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    dice, key = _Dice(seed), F.col("external_id")
    year, phone = (dice.number("year", 39, key) + 1985).cast("string"), F.concat(F.lit("+1-555-"), F.lpad(dice.number("phone", 10_000, key).cast("string"), 4, "0"))
    rows = made.source_rows
    tables = {
        "registry": (files.REGISTRY, rows.where("source = 'registry'").orderBy("row").select("external_id", "name", "street", "city", "postal", F.when(F.col("us"), "US").otherwise("EU"), year)),
        "directory": (files.DIRECTORY, rows.where("source = 'directory'").orderBy("row").select("external_id", "name", files.joined("street", "city", "postal"), phone, F.lit("business"))),
        "crm": (files.CRM, rows.where("source = 'crm'").orderBy("row").select("external_id", "name", "street", "city", "postal", F.lit("unknown"))),
        "ground_truth": (files.TRUTH, made.truth.orderBy("source", "external_id").select("source", "external_id", "true_entity_id", F.col("is_confusable_distinct").cast("int"))),
    }
    paths = {}
    for name, (header, table) in tables.items():
        paths[name] = folder / (f"{name}.csv" if name == "ground_truth" else f"source_{name}.csv")
        with paths[name].open("w", newline="", encoding="utf-8") as file:
            out = csv.writer(file)
            out.writerow(header)
            out.writerows(tuple(r) for r in table.toLocalIterator())
    return paths
