"""Quantities recorded in different units, brought to common base units.

Two operators share one idea: units are right if the identities that physics demands hold.

* :func:`infer_units` works on numeric columns.  Quantities tied by an identity (mass = density x volume, written as
  exponents) are recorded by each source in units of its own.  Of all combinations of units, that one is chosen whose
  identity leaves the smallest log residual over the source's rows; several that are equally good are flagged.
* :func:`package_contents` works on text.  A title gives numbers with units in the style of its feed.  All readings of
  its numbers are listed: several items of one content, parts that add up, one content, a number of pieces, a bare number
  in the feed's unit, each in every style that the feed leaves open.  The reading with the smallest log residual of the
  identities is chosen: content of the package = number of items x content of one (or the sum of its parts); content now =
  content in the document's first state; price = content x price of a base unit.  Only readings that the identities leave
  equal are told apart by precedence, and a title whose best readings differ in the amount is flagged.

Everything is column expressions; nothing but tables of units and of feeds is joined.
"""

from __future__ import annotations

import itertools
import math
import re
from functools import lru_cache, reduce
from operator import or_
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings of each unit of the table of factors, in lower case.
SPELLINGS = {
    "mg": "mg milligramm milligram milligrams milligramme milligrammes",
    "g": "g gr gramm gram grams gramme grammes",
    "dag": "dag deka dekagramm",
    "kg": "kg kilo kilos kilogramm kilogram kilograms kilogramme kilogrammes",
    "pfund": "pfund",
    "oz": "oz ounce ounces unze unzen once onces",
    "lb": "lb lbs pound pounds",
    "ml": "ml milliliter milliliters millilitre millilitres",
    "cl": "cl zentiliter centiliter centiliters centilitre centilitres",
    "dl": "dl deziliter deciliter deciliters decilitre decilitres décilitre décilitres",
    "l": "l ltr liter liters litre litres",
    "fl_oz": "fl_oz floz",
    "pint": "pint pints",
    "piece": "piece pieces pc pcs ct count st stk stck stück stücke pièce pièces unité unités",
    "dozen": "dozen dozens dutzend douzaine douzaines",
}

# Number words, and words before a number that is no content.
_ARTICLE = "(?:ein|eine|einen|einem|un|une|a|an|one)"
_LABELS = r"(?:typ|type|stufe|klasse|nr\.?|no\.?|n°|jahrgang|vintage|cuvée|médaille|stage|grade|since|depuis|seit|size)"
_BEFORE = r"(?:ab|bis|dès|up to|aged|von|from|mit|with|aux)"
_CODES = r"(?:art\.?|los|ref\.?|sku|#)"
_DRAINED = r"(?:abtropfgewicht|atg|poids net égoutté|poids égoutté|drained weight|drained)"
_PORTION = r"(?:portionen|portions|portion|serving size|serving|per)"

_NOT_IN_WORD = r"(?<![\p{L}\p{N}.,/])"
_ENDS = r"(?![\p{L}\p{N}])"
_NUM = r"(?:\d+(?:\.\d+)?)"
_NUMBER = _NOT_IN_WORD + r"(\d+(?:\.\d+)?)(?![\d%])"


@lru_cache(maxsize=8)
def _patterns(units: tuple[str, ...] = ()) -> SimpleNamespace:
    """The patterns of titles; ``units`` are units of the table besides those with known spellings, which are spelled as
    they are named."""
    unit_of = {spelling: unit for unit, all_of_it in SPELLINGS.items() for spelling in all_of_it.split()}
    unit_of |= {u.lower(): u for u in units if u.lower() not in unit_of}
    unit = "(" + "|".join(sorted(map(re.escape, unit_of), key=lambda s: (-len(s), s))) + r")" + _ENDS
    words_of_one = "(?:" + "|".join(sorted((re.escape(s) for s in unit_of if len(s) > 3), key=lambda s: (-len(s), s))) + ")"
    money = r"(?:€|eur|euro|\$|£)"

    start = r"(?<= |^|\()"
    # Numbers that only name something.
    names = "|".join(
        [
            rf"{start}{_CODES} ?[\p{{L}}\p{{N}}]+",
            r"(?<= |^)/[\p{L}\p{N}]+",
            rf"{start}{_LABELS} ?\d+(?![\d.,]*\d)",
            rf"{start}{_BEFORE} \d+(?![\d.,]*\d)(?! ?-?{unit})(?! \p{{L}}+ (?:zu|à|je|de|of) )",
        ]
    )
    # Drained weights, portions and reference prices.
    others = "|".join(
        [
            rf"{_DRAINED}:? ?{_NUM} ?-?{unit}\.?",
            rf"{_NOT_IN_WORD}{_NUM} ?-?{unit}\.? (?:drained|égoutté|abgetropft)(?: weight)?",
            rf"{start}{_PORTION}(?: (?:à|de|zu|von|of|je))? ?{_NUM} ?{unit}\.?(?: serving| portion)?",
            rf"{_NOT_IN_WORD}{_NUM} ?{unit}\.? ?= ?{money}? ?{_NUM}(?: ?{money})?",
            rf"{money}? ?{_NOT_IN_WORD}{_NUM} ?{money}? ?(?:/|le |la |per |pro |je )(?:{_NUM} ?)?{unit}\.?",
        ]
    )
    # (pattern, replacement, texts of which one has to be in the title), applied in this order to a title in lower case with
    # plain single spaces.  Patterns with one replacement are one alternation, so that the code of a row stays small; most
    # titles have none of the texts and skip the pattern.
    tidy = [
        (r"fl(?:uid|\.)? ?(?:oz|ounces?)" + _ENDS + r"\.?", "fl_oz", ("oz", "ounce")),
        (
            names,
            "~",
            (
                "#", "/", "art", "los", "ref", "sku", "typ", "stufe", "klasse", "nr", "no", "n°", "jahrgang", "vintage", "cuvée", "médaille",
                "stage", "grade", "since", "depuis", "seit", "size", "ab ", "bis ", "dès ", "up to ", "aged ", "von ", "from ", "mit ", "with ",
                "aux ",
            ),
        ),
        (
            rf"{start}(?:{_ARTICLE} )?(?:halbe[srnm]?|half|demie?)[ -](?:{_ARTICLE} )?(?={words_of_one}{_ENDS})",
            "½ ",
            ("hal", "demi"),
        ),
        (rf"{start}{_ARTICLE} (?={words_of_one}{_ENDS})", "1 ", ("ein", "un", "a ", "an ", "one ")),
        (_NOT_IN_WORD + r"(\d+) ?(?:½|(?<= )1/2(?![\d/]))", "$1.5", ("½", "1/2")),
        (_NOT_IN_WORD + r"(?:½|1/2(?![\d/]))", "0.5", ("½", "1/2")),
        (_NOT_IN_WORD + r"(?:¼|1/4(?![\d/]))", "0.25", ("¼", "1/4")),
        (_NOT_IN_WORD + r"(?:¾|3/4(?![\d/]))", "0.75", ("¾", "3/4")),
        (
            others,
            "~",
            ("€", "$", "£", "eur", "=", "abtropf", "abgetropft", "atg", "égoutté", "drained", "portion", "serving", "per "),
        ),
    ]

    between = (
        r"(?: ?[x×*] ?"  # 6 x 250 g
        r"|[ -]?(?:ct|count|pcs|pieces?|stk\.?|st\.?|stück|pièces?|unités?) ?[x×*] ?"  # 6 ct x 8 oz
        r"|er[ -]?\p{L}+ (?:à|zu|je|mit je|mit|a|de|of) "  # 6er-Pack à 250 g
        r"|[ -]?pack,? (?:of )?"  # 6-pack, 12 fl oz
        r"| \p{L}+\.? (?:zu je|zu|à|mit je|je|de|of|von|with) "  # 6 Gläser mit je 250 g
        r"|, )"  # pack of 6, 12 fl oz
    )
    multi = _NOT_IN_WORD + r"(\d+)" + between + rf"({_NUM})[ -]{{0,2}}" + unit
    single = _NUMBER + r"[ -]{0,2}" + unit
    sum = _NUMBER + r" ?(?:lb|lbs|pounds?)\.?,? " + rf"({_NUM}) ?(?:oz|ounces?){_ENDS}"
    pack = (
        _NOT_IN_WORD + r"(?:(\d+)er[ -]?(?:pack|packung|karton|träger|box|set)" + _ENDS
        + r"|(\d+)-(?:pack|count)" + _ENDS
        + r"|(?:pack|box|set|lot|boîte|paquet|carton)s? (?:of|de) (\d+)" + r"(?![\p{L}\d.,/])"
        + r"|x(\d+)(?![\p{L}\d.,/]))"
    )
    rate = rf"({_NUM}) ?{money}? ?(?:/|le |la |per |pro ){unit}"
    equal = rf"({_NUM}) ?{unit}\.? ?= ?{money}? ?({_NUM})"
    bare = _NUMBER + r"\)?$"
    bare_multi = _NOT_IN_WORD + r"(\d+)" + between + rf"({_NUM})\)?$"
    return SimpleNamespace(
        unit_of=unit_of, tidy=tidy, multi=multi, single=single, sum=sum, pack=pack, rate=rate, equal=equal, bare=bare, bare_multi=bare_multi
    )


#: What a title has that states a number of pieces; quicker to find than the whole pattern.
_PACKS = r"\d(?:er|-)|x\d|(?:of|de) \d"
#: Units of the table of factors; a table has a few dozen.
UNITS = 10_000
#: Log residual of a reading that breaks its own style: more than any that prices give.
_DOUBTFUL = 1_000.0


def _styled(text: Column, mark: Column, spaces: bool) -> Column:
    """Numbers of a title in lower case, rewritten without marks of thousands and with a decimal point."""
    comma = F.regexp_replace(text, r"(?<=\d)\.(?=\d{3}(?!\d))", "")
    if spaces:
        comma = F.regexp_replace(comma, _NOT_IN_WORD + r"(\d{1,3}) (?=\d{3}(?!\d))", "$1")
    comma = F.regexp_replace(comma, r"(?<=\d),(?=\d)", ".")
    point = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.when(mark == ",", comma).otherwise(point)


def _plain(title: Column) -> Column:
    text = F.lower(F.regexp_replace(title, r"[\s\p{Z}]+", " "))
    return F.btrim(F.regexp_replace(text, r"\( +", "("))


def _without_noise(rows: DataFrame, tidy: list) -> DataFrame:
    """Tidies the column ``text``; one projection a pattern, as each refers to the text several times."""
    text = F.col("text")
    for pattern, replacement, needed in tidy:
        tidied = F.regexp_replace(text, pattern, replacement)
        rows = rows.withColumn("text", F.when(reduce(or_, map(text.contains, needed)), tidied).otherwise(text))
    return rows.withColumn("text", F.btrim("text"))


def _title_rows(titles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``(doc_id, price, default_unit, open, mark, role, styled, odd)``: the current title of each document (``role`` 0) in each
    style that its feed leaves open, and if that is more than one (``open``), also the first title that it had (1)."""
    states = [
        F.max(F.struct("arrived_at", "title", "feed_id", "price")).alias("s"), F.min(F.struct("arrived_at", "title")).alias("w")
    ]
    current = titles.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*states).where("trim(s.title) <> ''")
    # The tables of feeds and units are small and fixed; Spark checks their size before it broadcasts them.
    style = feeds.groupBy("feed_id").agg(F.min(F.struct("country", "decimal_mark", "default_unit")).alias("f")).select("feed_id", "f.*")
    known = current.select("doc_id", "s.feed_id", "s.price", "s.title", F.col("w.title").alias("first")).join(style, "feed_id", "left")
    marks = F.when(F.col("decimal_mark").isin(",", "."), F.array("decimal_mark")).otherwise(F.array(F.lit(","), F.lit(".")))
    spaced = F.coalesce(F.col("country") == "fr", F.lit(False)).alias("spaced")
    known = known.select("doc_id", "price", "default_unit", spaced, "title", "first", F.explode(marks).alias("mark"), (F.size(marks) > 1).alias("open"))

    def role(column: str, number: int):
        return F.struct(F.lit(number).alias("role"), F.col(column).alias("title"))

    both = F.col("open") & (F.col("first") != F.col("title"))
    shown = F.when(both, F.array(role("title", 0), role("first", 1))).otherwise(F.array(role("title", 0)))
    rows = known.select("doc_id", "price", "default_unit", "open", "spaced", "mark", F.inline(shown))
    rows = rows.select("doc_id", "price", "default_unit", "open", "spaced", "mark", "role", _plain(F.col("title")).alias("plain")).where("plain <> ''")
    plain, mark = F.col("plain"), F.col("mark")
    styled = F.when(F.col("spaced"), _styled(plain, mark, True)).otherwise(_styled(plain, mark, False))
    # A decimal mark of the other style makes a reading doubtful; it stays if there is no better one.
    odd = F.when(mark == ",", plain.rlike(r"\d\.(?!\d{3}(?!\d))\d")).otherwise(plain.rlike(r"\d,(?!\d{3}(?!\d))\d"))
    return rows.select("doc_id", "price", "default_unit", "open", "mark", "role", styled.alias("styled"), odd.alias("odd"))


def _readings(rows: DataFrame, factors: DataFrame, known: SimpleNamespace) -> DataFrame:
    """All readings of ``rows`` (see :func:`_title_rows`): ``rank``, the place in the order of precedence, ``exact``, the
    content of the package in base units, and ``expected``, what the price of a unit in the title lets expect."""
    keys = ["doc_id", "price", "default_unit", "open", "mark", "role", "odd", "styled"]

    def ended(columns: list[str], **more: Column) -> list[Column]:
        # One generated row ends the code of a step; in one piece it would be too long for the JVM to compile.
        return [*columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in more.items()))))]

    read = _without_noise(rows.select(*ended(keys[:-1], styled=F.col("styled"))).withColumn("text", F.col("styled")), known.tidy)
    read = read.select(*ended(keys, text=F.col("text")))
    text, digit = F.col("text"), F.col("text").rlike(r"\d")

    def matched(pattern: str, where: Column, column: str = "text") -> Column:
        return F.when(where, F.regexp_extract(column, pattern, 0)).otherwise("")

    read = read.withColumn("multi", matched(known.multi, digit)).withColumn("single", matched(known.single, digit))
    read = read.withColumns(
        {
            "pair": matched(known.sum, (F.col("single") != "") & (text.contains("lb") | text.contains("pound"))),
            "pack": matched(known.pack, digit & text.rlike(_PACKS)),
            "equal": matched(known.equal, F.col("open"), "styled"),  # elsewhere the price decides nothing
            "per": matched(known.rate, F.col("open"), "styled"),
        }
    )
    # Only a title that names no unit is read in the unit of its feed.
    bare = digit & (F.col("multi") == "") & (F.col("single") == "") & (F.col("pack") == "")
    read = read.withColumn("bare_multi", matched(known.bare_multi, bare)).withColumn("bare", matched(known.bare, bare))

    # What was found, as "count|value|unit|more of the unit"; the unit of a bare number is left empty.
    kinds = [
        ("multi", known.multi, "$1|$2|$3|0"), ("pair", known.sum, "16|$1|oz|$2"), ("single", known.single, "1|$1|$2|0"),
        ("pack", known.pack, "1|$1$2$3$4|piece|0"), ("bare_multi", known.bare_multi, "$1|$2||0"), ("bare", known.bare, "1|$1||0"),
    ]
    found = [
        F.when(F.col(n) != "", F.struct(F.lit(i).alias("rank"), F.split(F.regexp_replace(n, pattern, parts), r"\|").alias("f")))
        for i, (n, pattern, parts) in enumerate(kinds)
    ]
    priced = F.when(F.col("equal") != "", F.regexp_replace("equal", known.equal, "$3|$1|$2")).when(
        F.col("per") != "", F.regexp_replace("per", known.rate, "$1|1|$2")
    )
    listed = read.select(*ended(keys[:-1], found=F.array_compact(F.array(*found)), r=F.split(priced, r"\|")))
    listed = listed.select(*keys[:-1], "r", F.inline("found"))
    spelled = F.create_map(*(F.lit(x) for pair in known.unit_of.items() for x in pair))

    def number(text: Column) -> Column:
        return text.try_cast("double")

    f, r = F.col("f"), F.col("r")
    readings = listed.select(
        *keys[:-1],
        "rank",
        F.when(f[2] == "", F.col("default_unit")).otherwise(spelled[f[2]]).alias("unit"),
        (number(f[0]) * number(f[1]) + number(f[3])).alias("amount"),
        (number(r[0]) / number(r[1])).alias("rate"),
        spelled[r[2]].alias("rate_unit"),
    ).where("amount > 0")
    rates = factors.select(F.col("unit").alias("rate_unit"), F.col("factor").alias("rate_factor"), F.col("base_unit").alias("rate_base"))
    based = readings.join(factors, "unit").join(rates, "rate_unit", "left").withColumn("exact", F.col("amount") * F.col("factor"))
    expected = F.when(F.col("rate_base") == F.col("base_unit"), F.col("rate") / F.col("rate_factor") * F.col("exact"))
    return based.select("doc_id", "price", "mark", "role", "odd", "rank", "base_unit", "exact", expected.alias("expected"))


def package_contents(
    titles: DataFrame,
    feeds: DataFrame,
    unit_factors: DataFrame,
    tolerance: float = 1e-9,
) -> DataFrame:
    """``(doc_id, base_unit, amount bigint, is_unique, decided_by)`` for documents whose current title states a content.

    ``titles(doc_id, title, feed_id, price, arrived_at)`` may hold several states of a document; the latest counts (of
    several at one time the greatest title).  ``feeds(feed_id, country, decimal_mark, default_unit)`` gives the number
    style; with no or an unknown feed both styles are read.  ``unit_factors(unit, base_unit, factor)`` are brought to
    the base unit and rounded half up; a unit without known spellings is spelled as it is named.  Of several rows of a
    feed or unit the smallest counts.

    ``decided_by`` is ``reading`` if all readings of the title give one amount, ``identity`` if the log residuals of the
    identities decide, else ``precedence``.  The price decides only where a feed leaves the style open.  ``is_unique`` is
    false if two readings with other amounts fit equally well and have one precedence; then the smaller amount is given.
    Rows without a doc_id are no documents; null or blank titles state nothing; further columns are not read; empty tables
    give no rows.
    """
    factors = unit_factors.where("unit IS NOT NULL AND factor IS NOT NULL").groupBy("unit").agg(F.min(F.struct("base_unit", "factor")).alias("f"))
    factors = factors.select("unit", "f.base_unit", "f.factor")
    names = [r["unit"] for r in factors.select("unit").limit(UNITS + 1).collect()]
    if len(names) > UNITS:
        raise ValueError(f"more than {UNITS} units")
    known = _patterns(tuple(sorted(n for n in names if n.strip() and n not in SPELLINGS)))
    readings = _readings(_title_rows(titles, feeds), factors, known)
    columns = ["mark", "role", "odd", "rank", "base_unit", "exact", "expected"]
    # A document has at most two styles of two titles with a reading of each kind.
    listed = readings.groupBy("doc_id").agg(F.first("price").alias("price"), F.collect_list(F.struct(*columns)).alias("all"))
    listed = listed.select("doc_id", "price", F.filter("all", lambda c: c["role"] == 0).alias("own"), F.filter("all", lambda c: c["role"] == 1).alias("first"))
    is_open = F.exists("own", lambda c: c["mark"] != F.col("own")[0]["mark"])

    def apart(a: Column, b: Column) -> Column:
        return F.abs(F.ln(a) - F.ln(b))

    def residual(c: Column) -> Column:
        # Several items or parts: what the package holds is their product or sum, and a reading that leaves some out is apart.
        whole = F.array_min(F.transform(F.filter("own", lambda o: (o["rank"] <= 1) & (o["mark"] == c["mark"])), lambda o: F.struct(o["rank"], o["base_unit"], o["exact"])))
        items = F.when(whole["base_unit"] == c["base_unit"], apart(whole["exact"], c["exact"]))
        same = F.filter("first", lambda o: (o["mark"] == c["mark"]) & (o["base_unit"] == c["base_unit"]))
        earlier = F.array_min(F.transform(same, lambda o: apart(o["exact"], c["exact"])))
        price = F.when(is_open & (F.col("price") > 0) & (c["expected"] > 0), apart(F.col("price"), c["expected"]))
        parts = [F.coalesce(x, F.lit(0.0)) for x in (items, earlier, price)]
        return F.round((parts[0] + parts[1] + parts[2] + F.when(c["odd"], _DOUBTFUL).otherwise(0.0)) / F.lit(tolerance))

    def scored(c: Column) -> Column:
        return F.struct(residual(c).alias("steps"), c["rank"].alias("rank"), F.round(c["exact"]).cast("bigint").alias("amount"), c["base_unit"].alias("base_unit"))

    # Most titles have one reading, which needs no choice.
    only = F.struct(F.lit(0.0).alias("steps"), F.col("own")[0]["rank"].alias("rank"), F.round(F.col("own")[0]["exact"]).cast("bigint").alias("amount"), F.col("own")[0]["base_unit"].alias("base_unit"))
    weighed = listed.where(F.size("own") > 0).select("doc_id", F.when(F.size("own") == 1, F.array(only)).otherwise(F.transform("own", scored)).alias("fits"))
    chosen = weighed.select("doc_id", "fits", F.array_min("fits").alias("low"))
    low = F.col("low")

    def other(c: Column) -> Column:
        return (c["amount"] != low["amount"]) | (c["base_unit"] != low["base_unit"])

    equal = F.exists("fits", lambda c: other(c) & (c["steps"] == low["steps"]))
    decided = F.when(~F.exists("fits", other), "reading").when(equal, "precedence").otherwise("identity")
    unique = ~F.exists("fits", lambda c: other(c) & (c["steps"] == low["steps"]) & (c["rank"] == low["rank"]))
    return chosen.select("doc_id", "low.base_unit", "low.amount", unique.alias("is_unique"), decided.alias("decided_by"))


def infer_units(
    records: DataFrame,
    source: str,
    identity: dict[str, float],
    units: dict[str, dict[str, float]],
    tolerance: float = 0.02,
) -> DataFrame:
    """The unit in which each source records each quantity, from an identity among them.

    ``identity`` gives the exponents of a product that is 1 in base units, such as
    ``{"mass": 1, "density": -1, "volume": -1}``; ``units`` the factors to base units that are possible for each of its
    columns.  One row per source: ``source``, ``unit_<column>`` of the best combination, ``residual`` (mean log residual
    of the identity, absolute), ``n_rows`` that were used and ``is_unique``, false if another combination is within
    ``tolerance`` of the best.

    Rows with a null source, or with a null, zero or negative quantity, say nothing about units and are left out; a
    source without other rows is not in the result.  All rows of a source are reduced to one mean before the
    combinations are tried, so a source may hold any share of the rows.
    """
    names = list(identity)
    if not names or any(not units.get(n) or min(units[n].values()) <= 0 for n in names):
        raise ValueError("each column of the identity needs units with positive factors")
    logs = [F.lit(float(identity[n])) * F.ln(F.col(n).cast("double")) for n in names]
    usable = F.col(source).isNotNull()
    for n in names:
        usable = usable & (F.col(n).cast("double") > 0)
    means = (
        records.where(usable)
        .groupBy(F.col(source).alias("source"))
        .agg(F.avg(sum(logs[1:], logs[0])).alias("mean_log"), F.count("*").alias("n_rows"))
    )
    combinations = [
        F.struct(
            F.lit(sum(identity[n] * math.log(units[n][u]) for n, u in zip(names, chosen))).alias("shift"),
            *(F.lit(u).alias(f"unit_{n}") for n, u in zip(names, chosen)),
        )
        for chosen in itertools.product(*(sorted(units[n]) for n in names))
    ]
    tried = F.transform(
        F.array(*combinations),
        lambda c: F.struct(F.abs(F.col("mean_log") + c["shift"]).alias("residual"), *(c[f"unit_{n}"].alias(f"unit_{n}") for n in names)),
    )
    ranked = means.select("source", "n_rows", F.array_sort(tried).alias("ranked"))
    best, second = F.col("ranked")[0], F.get("ranked", F.lit(1))
    return ranked.select(
        F.col("source").alias(source),
        *(best[f"unit_{n}"].alias(f"unit_{n}") for n in names),
        best["residual"].alias("residual"),
        "n_rows",
        F.coalesce(second["residual"] - best["residual"] > tolerance, F.lit(True)).alias("is_unique"),
    )
