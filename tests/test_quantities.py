from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators.quantities import infer_units, package_contents

FACTORS = {
    "mg": ("mg", 1.0), "g": ("mg", 1e3), "dag": ("mg", 1e4), "kg": ("mg", 1e6), "pfund": ("mg", 5e5), "oz": ("mg", 28349.523125),
    "lb": ("mg", 453592.37), "ml": ("ul", 1e3), "cl": ("ul", 1e4), "dl": ("ul", 1e5), "l": ("ul", 1e6), "fl_oz": ("ul", 29573.5295625),
    "pint": ("ul", 473176.473), "piece": ("piece", 1.0), "dozen": ("piece", 12.0),
}
FEEDS = [("de", "de", ",", None), ("de-g", "de", ",", "g"), ("en", "en", ".", None), ("en-oz", "en", ".", "oz"), ("fr", "fr", ",", None), ("none", None, None, None)]
SCHEMA = "doc_id bigint, title string, feed_id string, price double, arrived_at timestamp"

CASES = [
    ("de", "Mehl 500 g", "mg", 500_000), ("de", "Mehl 500G", "mg", 500_000), ("de", "1,5 kg Mehl Typ 550", "mg", 1_500_000),
    ("de", "Mehl Typ 550", None, None), ("de", "Mehl 2.500 g", "mg", 2_500_000), ("en", "Flour 2,500 g", "mg", 2_500_000),
    ("en", "Flour 2.5 kg", "mg", 2_500_000), ("fr", "Farine 1 250 g", "mg", 1_250_000), ("fr", "Farine 0,125 kg", "mg", 125_000),
    ("de", "Tee 8 Beutel zu 40 g", "mg", 320_000), ("de", "Saft 6 x 0,33 l", "ul", 1_980_000), ("de", "Saft 6×330 ml", "ul", 1_980_000),
    ("de", "Saft 4*0,5l Los 5ab", "ul", 2_000_000), ("de", "Mus 4 Gläser mit je 125g", "mg", 500_000), ("de", "Bier 12er-Träger à 0,5 Liter", "ul", 6_000_000),
    ("en", "Oil 6-pack, 12 fl oz bottles", "ul", 2_129_294), ("en", "Oil (pack of 2, 10 fl. oz. each)", "ul", 591_471), ("en", "Jam 6 ct x 8oz", "mg", 1_360_777),
    ("en", "Jam pack of 4 x 8 oz", "mg", 907_185), ("fr", "Jus lot de 12 bouteilles de 75cl", "ul", 9_000_000), ("fr", "Thé sachet de 40 g", "mg", 40_000),
    ("en", "Jam 1 lb 4 oz", "mg", 566_990), ("en", "Jam half a pound", "mg", 226_796), ("en", "Jam 3/4 lb", "mg", 340_194), ("en", "Jam 1½ lb", "mg", 680_389),
    ("de", "Saft ab 3 Jahre 1 1/2 Liter", "ul", 1_500_000), ("de", "Klasse 1 ½ kg Mehl", "mg", 500_000), ("de", "ein halbes Kilo Mehl", "mg", 500_000),
    ("de", "ein Liter Saft", "ul", 1_000_000), ("fr", "un demi-litre", "ul", 500_000), ("de", "Ei ein Dutzend", "piece", 12), ("fr", "Œufs une douzaine", "piece", 12),
    ("en", "Eggs half a dozen", "piece", 6), ("en", "Eggs 2 dozen", "piece", 24), ("de", "Riegel 10 Stk.", "piece", 10), ("de", "Riegel 15-Stück-Packung", "piece", 15),
    ("de", "Riegel 4er-Pack", "piece", 4), ("fr", "boîte de 30", "piece", 30), ("fr", "Biscuits x12", "piece", 12), ("en", "Bars PACK OF 40", "piece", 40),
    ("de", "Mehl 1,5-kg-Sack 1 kg = 5,98 €", "mg", 1_500_000), ("de", "Suppe 400 g (Abtropfgewicht 240 g)", "mg", 400_000), ("en", "Peas (240 g drained) 400 g", "mg", 400_000),
    ("de", "Keks 300 g Portion à 30 g", "mg", 300_000), ("en", "Chips serving size 30 g", None, None), ("fr", "Café 250 g soit 4,98 € le kg", "mg", 250_000),
    ("en", "Nuts ($0.42/oz) 8 oz.", "mg", 226_796), ("de", "Mehl (100 g = 1,19 EUR)", None, None), ("de", "Saft 60 % Frucht 2 Sorten bis 90 Grad", None, None),
    ("de", "Mehl ca. 500 g", "mg", 500_000), ("de", "Mehl 500", None, None), ("de-g", "Mehl 500", "mg", 500_000), ("de-g", "Mehl Jahrgang 2021", None, None),
    ("de-g", "Mehl B12", None, None), ("de-g", "Riegel x6", "piece", 6), ("en-oz", "Flour 16", "mg", 453_592), ("de", "Mehl 0 g", None, None), ("de", "", None, None),
    ("de", None, None, None), ("de", "x" * 100_000 + " 5 kg", "mg", 5_000_000), ("de", "Art. 5g Mehl", None, None), ("fr", "Miel (T65) (500 g)", "mg", 500_000),
]


def tables(spark, rows):
    feeds = spark.createDataFrame(FEEDS, "feed_id string, country string, decimal_mark string, default_unit string")
    factors = spark.createDataFrame([(u, b, f) for u, (b, f) in FACTORS.items()], "unit string, base_unit string, factor double")
    return spark.createDataFrame(rows, SCHEMA), feeds, factors


def test_titles(spark):
    when = datetime(2024, 1, 1)
    rows = [(i, title, feed, 1.0, when) for i, (feed, title, _, _) in enumerate(CASES)]
    titles, feeds, factors = tables(spark, rows)
    got = {r.doc_id: (r.base_unit, r.amount) for r in package_contents(titles.withColumn("unit", F.lit("kg")), feeds, factors).collect()}
    expected = {i: (unit, amount) for i, (_, _, unit, amount) in enumerate(CASES) if unit}
    assert {CASES[i]: got.get(i) for i in expected | got} == {CASES[i]: expected.get(i) for i in expected | got}


def test_latest_state_and_rows_without_id(spark):
    days = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, "a 1 kg", "de", 1.0, days[1]), (1, "a 2 kg", "de", 1.0, days[0]), (1, "a 1 kg", "de", 1.0, days[1]), (2, "b 1 kg", "de", 1.0, days[0]), (2, None, "de", 1.0, days[2]), (None, "c 1 kg", "de", 1.0, days[0]), (3, "d 1 kg", "unknown", 1.0, None)]
    got = {r.doc_id: r.amount for r in package_contents(*tables(spark, rows)).collect()}
    assert got == {1: 1_000_000, 3: 1_000_000}
    assert package_contents(*tables(spark, [])).count() == 0


def test_without_a_style_the_price_decides_or_the_title_is_flagged(spark):
    when = datetime(2024, 1, 1)
    rows = [(1, "a 1.500 g", "none", 1.0, when), (2, "a 1.500 g (2,00 €/kg)", "none", 3.0, when), (3, "a 1,500 g ($2/kg)", None, 0.003, when), (4, "a 500 g", "none", 1.0, when)]
    got = {r.doc_id: (r.amount, r.is_unique) for r in package_contents(*tables(spark, rows)).collect()}
    assert got == {1: (1_500, False), 2: (1_500_000, True), 3: (1_500, True), 4: (500_000, True)}


def test_units_of_sources(spark):
    rows = []
    for source, (m, d, v) in {"a": (1.0, 1.0, 1.0), "b": (1e3, 1.0, 1.0), "c": (1.0, 1e3, 1e-3)}.items():
        for i in range(1, 40):
            volume, density = 0.1 * i, 0.7 + 0.01 * i
            rows.append((source, volume * density / m, density / d, volume / v))
    rows += [("a", None, 1.0, 1.0), ("a", -1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), ("empty", 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "feed string, mass double, density double, volume double")
    units = {"mass": {"kg": 1.0, "t": 1e3}, "density": {"kg/l": 1.0}, "volume": {"l": 1.0}}
    identity = {"mass": 1, "density": -1, "volume": -1}
    got = {r.feed: r for r in infer_units(df, "feed", identity, units).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].n_rows == 39
    assert (got["a"].unit_mass, got["b"].unit_mass) == ("kg", "t") and got["a"].is_unique and got["b"].residual < 1e-9
    twice = units | {"volume": {"l": 1.0, "m3": 1e3}}
    got = {r.feed: r for r in infer_units(df, "feed", identity, twice).collect()}
    assert not got["a"].is_unique  # tonnes and cubic metres fit as well as kilograms and litres
    with pytest.raises(ValueError):
        infer_units(df, "feed", identity, {"mass": {"kg": 1.0}})
