"""Quantities in common units: amounts and unit words read from text, and conversions estimated across sources.

A fact's amount stands in raw_value; its unit and scale in raw_value, unit and the unit of its table, in this order
of precedence. Words of the lexicon say what they mean. What a word that the lexicon lacks means in a source is estimated: facts
that hold it are linked with facts of the same entity, attribute, time and scope in other sources whose value is
known, each pair of sources gives a robust scale and offset, the scale is snapped to a known conversion, and sources that
become known so are the ground for further ones, until none is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import latest, written

# Spellings of the units of unit_rates, without points and spaces, in lower case.
UNIT_WORDS = {
    "inr": ["inr", "rs", "re", "rupee", "rupees", "₹"],
    "usd": ["usd", "us$", "$", "dollar", "dollars", "usdollar", "usdollars"],
    "eur": ["eur", "€", "euro", "euros"],
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"],
    "tonne": ["t", "mt", "ton", "tons", "tonne", "tonnes", "metrictonne", "metrictonnes", "metricton", "metrictons", "kt"],
    "quintal": ["quintal", "quintals", "qtl", "qtls"],
    "lb": ["lb", "lbs", "pound", "pounds"],
    "m": ["m", "metre", "metres", "meter", "meters", "mtr", "mtrs"],
    "km": ["km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"],
    "mile": ["mile", "miles", "mi"],
    "sqm": ["sqm", "m²", "sqmetre", "sqmetres", "sqmeter", "sqmeters", "squaremetre", "squaremetres", "squaremeter", "squaremeters", "sqmtr", "sqmtrs"],
    "sqft": ["sqft", "ft²", "sqfeet", "sqfoot", "squarefoot", "squarefeet"],
    "acre": ["acre", "acres", "ac"],
    "hectare": ["hectare", "hectares", "ha"],
    "minute": ["minute", "minutes", "min", "mins"],
    "hour": ["hour", "hours", "hr", "hrs", "h"],
    "day": ["day", "days"],
    "percent": ["%", "pct", "percent", "percentage", "pc"],
    "bps": ["bps", "bp", "basispoint", "basispoints"],
    "count": ["count", "counts", "number", "numbers", "no", "nos", "unit", "units", "shipment", "shipments", "parcel", "parcels", "vehicle", "vehicles", "order", "orders", "customer", "customers", "trip", "trips", "pallet", "pallets", "employee", "employees", "facility", "facilities", "pincode", "pincodes", "truck", "trucks", "hub", "hubs", "centre", "centres", "center", "centers", "warehouse", "warehouses", "branch", "branches", "store", "stores", "package", "packages", "consignment", "consignments", "item", "items", "piece", "pieces", "people", "persons", "worker", "workers", "driver", "drivers", "partner", "partners", "route", "routes", "city", "cities", "state", "states", "country", "countries", "share", "shares"],
}
# Spellings of the scales of unit_rates.
SCALE_WORDS = {
    "thousand": ["thousand", "thousands", "k", "'000", "000", "'000s", "000s", "kt"],
    "lakh": ["lakh", "lakhs", "lac", "lacs"],
    "million": ["million", "millions", "mn", "mln", "mio"],
    "crore": ["crore", "crores", "cr", "crs"],
    "billion": ["billion", "billions", "bn", "bln"],
}
# Words that say nothing about unit or scale.
OTHER_WORDS = ["in", "of", "all", "figures", "amount", "amounts", "unit:", "values", "value", "and", "the", "per", "about", "approx", "approximately", "around", "circa", "c", "nearly", "almost", "over", "under", "above", "below", "roughly", "some", "minus", "negative", "less", "plus", "n", "see", "note", "a", "to", "from", "total", "net", "gross", "is", "was", "others", "less than", "more", "than", "least", "most", "up"]

#: Phrases of several words or signs that are one word; then words, signs and thousands written as digits.
_PHRASES = r"per\s?cent|basis\s?points?|sq\.?\s?(?:ft|feet|foot|metres?|meters?|mtrs?|m)(?![a-z])|square\s(?:feet|foot|metres?|meters?)|metric\s?tons?|metric\s?tonnes?|us\s?dollars?|us\s?\$|pin\s?codes?|ft²|m²|'?000s|'000|(?<=in )000(?!\d)|[a-z]+|[₹$€%]"
_SPACES = r"[\s\x{A0}\x{2007}\x{2009}\x{202F}]+"
_GROUPED = r"\d{1,3}(?: \d{3})+(?:[.,]\d+)?(?!\d)|\d[\d.,]*\d|\d"
_PERIOD = r"(?:^|[^a-z])(?:fy|q|h)\s?'?\d|jan(?:uary)?\b|feb(?:ruary)?\b|march\b|\bmar\b|april\b|\bapr\b|\bmay\b|june?\b|july?\b|aug(?:ust)?\b|sept?(?:ember)?\b|oct(?:ober)?\b|nov(?:ember)?\b|dec(?:ember)?\b|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}"
#: The fewest pairs and the widest relative spread with which a scale is believed, and how near a known one must be.
MIN_LINKS, MAX_SPREAD, SNAP = 3, 0.02, 0.01


def plain(text: Column) -> Column:
    """Lower case, one ordinary space for any white space, typographic apostrophes and minus signs as ASCII."""
    return F.lower(F.trim(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "), "’‘−–—", "''---")))


def _lookup(words: dict[str, list[str]], hidden: tuple[str, ...]) -> dict[str, str]:
    return {s: code for code, spellings in words.items() for s in spellings if s not in hidden}


def words_of(text: Column, amount: bool = False) -> Column:
    """The unit and scale words of a plain text, squeezed. Where the text holds an amount, its digits are no word."""
    cleaned = F.regexp_replace(text, r"\bunit\s?:", " ")
    if amount:
        cleaned = F.regexp_replace(cleaned, r"(?<!')(?:" + _GROUPED + ")", " ")
    return F.transform(F.regexp_extract_all(cleaned, F.lit(_PHRASES), F.lit(0)), lambda w: F.regexp_replace(w, r"[\s.]+", ""))


def _first(words: Column, table: dict[str, str]) -> Column:
    """What the first word of a table stands for there. Words are tried against a set of all of them before they are looked up."""
    here = F.get(F.filter(words, lambda w: w.isin(list(table))), F.lit(0))
    return T.let(here, lambda w: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), w))


def unit_in(words: Column, hidden: tuple[str, ...] = ()) -> Column:
    """Unit code of the first word that names one."""
    return _first(words, _lookup(UNIT_WORDS, hidden))


def scale_in(words: Column, hidden: tuple[str, ...] = ()) -> Column:
    return _first(words, _lookup(SCALE_WORDS, hidden))


def strange_in(words: Column, hidden: tuple[str, ...] = ()) -> Column:
    """The first word of letters that is in no list, without the s of a plural: what conversions are estimated for."""
    known = [*_lookup(UNIT_WORDS, hidden), *_lookup(SCALE_WORDS, hidden), *OTHER_WORDS]
    word = F.get(F.filter(words, lambda w: w.rlike(r"^[^\d]{2,}$") & ~w.isin(known)), F.lit(0))
    return F.regexp_replace(word, "(?<=[a-z]{3})s$", "")


def amount_in(text: Column) -> Column:
    """The one number of a plain raw value with its sign, as DECIMAL(24,6); null for none, two, dates and periods.

    Points and commas: where both stand, the last is the decimal mark; a comma before one or two closing digits is
    one too; several of one kind, or a comma before three digits, group thousands, as spaces do.
    """
    # Digits written for thousands belong to the unit.
    return T.let(F.regexp_replace(text, r"'000s?|(?<![\d.,])000s", " "), lambda bare: T.let(F.regexp_extract_all(bare, F.lit(_GROUPED), F.lit(0)), lambda numbers: F.when((F.size(numbers) == 1) & ~text.rlike(_PERIOD), _signed(bare, F.get(numbers, F.lit(0))))))


def _signed(bare: Column, first: Column) -> Column:
    before = F.substring(bare, F.lit(1), F.call_function("instr", bare, first) - 1)
    inside = F.regexp_replace(before, r"\([^()]*\)", "").contains("(") & bare.contains(")")
    negative = inside | before.rlike(r"(?:^|[\s(~+])-|-[^a-z0-9]*$|\b(?:minus|negative)\b")
    return T.let(F.regexp_replace(first, r"[ ]|[.,]+$", ""), lambda number: T.let(_clean(number).try_cast("decimal(24,6)"), lambda value: F.when(negative, -value).otherwise(value)))


def _clean(number: Column) -> Column:
    """The number with a point for its decimal mark and no marks of thousands."""
    points, commas = F.regexp_count(number, F.lit(r"\.")), F.regexp_count(number, F.lit(","))
    comma_last = F.instr(F.reverse(number), ",") < F.instr(F.reverse(number), ".")
    without = lambda c: F.replace(number, F.lit(c), F.lit(""))
    european = F.replace(without("."), F.lit(","), F.lit("."))
    return (
        F.when((points == 0) & (commas == 0), number)
        .when((points > 0) & (commas > 0), F.when(comma_last, european).otherwise(without(",")))
        .when((commas > 0) & number.rlike(r",\d{1,2}$"), F.when(commas == 1, european).otherwise(F.regexp_replace(F.regexp_replace(number, r",(\d{1,2})$", ".$1"), ",", "")))
        .when(commas > 0, without(","))
        .when(points > 1, without("."))
        .otherwise(number)
    )


def read_facts(facts: DataFrame, tables: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """One row per fact with its amount and what each field says: unit and scale codes by precedence, and a strange word.

    Rows that repeat a fact count once, the last loaded; null ids are left out. Only facts whose unit or scale is still
    open are joined with the tables' units, and facts without evidence spread over all tasks. Words in hidden count as unknown.
    """
    narrow = latest(facts.select("fact_id", "entity", "attribute", "time", "scope", "source_file", "raw_value", "unit", "evidence_id", "loaded_at"), "fact_id")
    raw = plain(F.col("raw_value"))
    read = narrow.withColumn("_raw", raw).withColumn("amount", amount_in(F.col("_raw"))).where("amount is not null")
    read = read.withColumn("_w1", words_of(F.col("_raw"), amount=True)).withColumn("_w2", words_of(plain(F.col("unit"))))
    read = read.select("*", unit_in(F.col("_w1"), hidden).alias("u1"), scale_in(F.col("_w1"), hidden).alias("s1"), unit_in(F.col("_w2"), hidden).alias("u2"), scale_in(F.col("_w2"), hidden).alias("s2"))
    read = read.withColumn("word", F.when(F.coalesce("u1", "u2").isNull(), F.coalesce(strange_in(F.col("_w1"), hidden), strange_in(F.col("_w2"), hidden))))
    read = written(read.select("fact_id", "entity", "attribute", "time", "scope", "source_file", "evidence_id", "amount", "u1", "s1", "u2", "s2", "word"), "facts")
    units = tables.select(F.explode("evidence_ids").alias("evidence_id"), F.struct("loaded_at", "unit").alias("v")).where("evidence_id is not null").groupBy("evidence_id").agg(F.max("v").alias("v"))
    units = units.withColumn("_w3", words_of(plain(F.col("v.unit"))))
    # Written, so that the join is of two plain shuffles: a partition with a very common evidence id can be split.
    units = written(units.select(F.col("evidence_id").alias("_key"), unit_in(F.col("_w3"), hidden).alias("u3"), scale_in(F.col("_w3"), hidden).alias("s3"), strange_in(F.col("_w3"), hidden).alias("word3")), "units")
    keyed = read.withColumn("_key", F.when(F.coalesce("u1", "u2").isNotNull() & F.coalesce("s1", "s2").isNotNull(), None).otherwise(F.col("evidence_id"))).withColumn("_key", F.coalesce("_key", F.concat(F.lit("\0"), "fact_id")))
    full = keyed.join(units, "_key", "left").drop("_key")
    unit = F.coalesce("u1", "u2", "u3")
    agrees = lambda u: F.col(u).isNull() | (F.col(u) == unit)
    scale = F.coalesce(F.col("s1"), F.when(agrees("u2"), F.col("s2")), F.when(agrees("u3"), F.col("s3")))
    return full.select("fact_id", "entity", "attribute", "time", "scope", "source_file", "amount", unit.alias("unit_code"), scale.alias("scale_code"), F.when(unit.isNull(), F.coalesce("word", "word3")).alias("word"))


def _rates(rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and scales of unit_rates: a fixed table of some tens of rows, so both are broadcast."""
    units = rates.where("kind = 'unit'").select(F.col("unit_code"), "base_unit", F.col("factor").cast("decimal(18,8)").alias("factor"))
    scales = rates.where("kind = 'scale'").select(F.col("unit_code").alias("scale_code"), F.col("factor").cast("decimal(12,0)").alias("scale"))
    return F.broadcast(units), F.broadcast(scales)


def in_base_units(read: DataFrame, rates: DataFrame) -> DataFrame:
    """read with scaled, base_unit and base_value, the last two null where the unit is unknown; halves are rounded away from zero."""
    units, scales = _rates(rates)
    value = (F.col("amount") * F.coalesce("scale", F.lit(1).cast("decimal(12,0)"))).cast("decimal(28,6)")
    joined = read.join(units, "unit_code", "left").join(scales, "scale_code", "left").withColumn("scaled", value)
    return joined.withColumn("base_value", F.round(F.col("scaled") * F.col("factor"), 0).try_cast("bigint")).drop("factor", "scale")


def _same_thing() -> Column:
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return F.sha1(F.concat_ws("|", norm("entity"), norm("attribute"), norm("time"), norm("scope")))


def source_pairs(values: DataFrame, rates: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """(source, word, ground, base_unit, links, scale, offset, known): what a strange word of a source multiplies an amount by, from each source that knows.

    values: thing, source, word, x (amounts with a strange word), base_unit, y (amounts in base units); one row of a source,
    thing and word each, so a thing stated very often in a source is one point. Of each pair of sources, the median ratio of
    its things is the scale if the ratios' middle half agrees within MAX_SPREAD; else the median slope between things next in
    size is, with the median residual as the offset, if the residuals agree so. A scale that is near no known conversion of the
    base unit is dropped; known is the conversion it is near. Sources that know nothing of a pair's things make no rows.
    """
    strange = values.where("base_unit is null").select("thing", "source", "word", "x")
    ground = values.where("base_unit is not null").select("thing", F.col("source").alias("ground"), "base_unit", "y").join(strange.select("thing").distinct(), "thing", "left_semi")
    pair = ["source", "word", "ground", "base_unit"]
    points = written(strange.join(ground, "thing").where("source <> ground and x <> 0 and y <> 0"), "points")
    ratio = points.withColumn("r", F.col("y") / F.col("x")).groupBy(*pair).agg(F.count(F.lit(1)).alias("links"), *[F.percentile_approx("r", p).alias(n) for n, p in (("scale", 0.5), ("_low", 0.25), ("_high", 0.75))]).where(F.col("links") >= min_links)
    straight = F.col("_high") - F.col("_low") <= MAX_SPREAD * F.abs("scale")
    ratio = written(ratio.withColumn("_straight", straight), "ratios")
    bent = points.join(ratio.where("not _straight").select(*pair), pair)
    w = Window.partitionBy(*pair).orderBy("x", "y")
    steps = bent.withColumn("_dx", F.col("x") - F.lag("x").over(w)).withColumn("_dy", F.col("y") - F.lag("y").over(w)).where("_dx > 0")
    slope = steps.groupBy(*pair).agg(F.percentile_approx(F.col("_dy") / F.col("_dx"), 0.5).alias("scale"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_links - 1)
    rest = bent.join(slope, pair).withColumn("_b", F.col("y") - F.col("scale") * F.col("x"))
    line = rest.groupBy(*pair, "scale").agg(F.count(F.lit(1)).alias("links"), F.percentile_approx("_b", 0.5).alias("offset"), F.percentile_approx("_b", 0.25).alias("_low"), F.percentile_approx("_b", 0.75).alias("_high"), F.percentile_approx(F.abs("y"), 0.5).alias("_y"))
    line = line.where(F.col("_high") - F.col("_low") <= MAX_SPREAD * F.col("_y"))
    columns = [*pair, "links", "scale", "offset"]
    fits = ratio.where("_straight").withColumn("offset", F.lit(0.0)).select(*columns).unionByName(line.select(*columns))
    units, _ = _rates(rates)
    # unit_rates is a fixed table: five scales besides the scale of one.
    scales = [1.0, *sorted(r.factor for r in rates.where("kind = 'scale'").select("factor").collect())]
    conversions = F.broadcast(units.select("base_unit", "factor", F.explode(F.array(*[F.lit(s) for s in scales])).alias("s")).select("base_unit", (F.col("factor").cast("double") * F.col("s")).alias("known")).distinct())
    near = fits.join(conversions, "base_unit").withColumn("_off", F.abs(F.col("scale") / F.col("known") - 1)).where(F.col("_off") <= SNAP)
    return near.groupBy(*columns).agg(F.min_by("known", F.struct("_off", "known")).alias("known"))


def _agreed(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key…, _unit, _scale, _offset): the conversion that most links of a key speak for, if more than half do."""
    votes = pairs.groupBy(*key, "base_unit", "known", F.round(F.col("offset") / F.col("known"), 2).alias("_o")).agg(F.sum("links").alias("n"), F.avg("offset").alias("offset"))
    best = votes.groupBy(*key).agg(F.sum("n").alias("all"), F.max(F.struct("n", "base_unit", "known", "offset")).alias("b")).where(F.col("b.n") * 2 > F.col("all"))
    return best.select(*key, F.col("b.base_unit").alias("_unit"), F.col("b.known").alias("_scale"), F.col("b.offset").alias("_offset"))


def propagate(valued: DataFrame, rates: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """valued (rows as from in_base_units()) with base_unit and base_value of the strange words that sources' links tell.

    The sources are a graph: those whose words are known are its ground. In each round every (source, word) that has links
    with a source that knows takes the conversion which most links speak for, and is ground in the next round. When no more are
    reached so, a word that all sources known so far read alike is read so in the others too. It ends when a round adds nothing.
    """
    open_ = F.col("word").isNotNull() & F.col("base_value").isNull()
    source = F.coalesce(F.nullif(F.substring_index("source_file", "/", 1), F.lit("")), F.col("fact_id"))
    rows = valued.where(open_).withColumn("source", source)
    if rows.isEmpty():
        return valued
    thing = _same_thing()
    left = written(rows.groupBy("source", "word", thing.alias("thing")).agg(F.percentile_approx(F.col("scaled").cast("double"), 0.5).alias("x")), "strange")
    known = valued.where("base_value is not null").withColumn("source", source).withColumn("thing", thing).join(left.select("thing").distinct(), "thing", "left_semi")
    ground = written(known.groupBy("source", "base_unit", "thing").agg(F.percentile_approx(F.col("base_value").cast("double"), 0.5).alias("y")), "ground")
    told: DataFrame | None = None
    while not left.isEmpty():
        values = left.select("thing", "source", "word", "x", F.lit(None).cast("string").alias("base_unit"), F.lit(None).cast("double").alias("y")).unionByName(ground.select("thing", "source", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("x"), "base_unit", "y"))
        new = written(_agreed(source_pairs(values, rates, min_links), ["source", "word"]), "told")
        if new.isEmpty():
            if told is None:
                break
            alike = told.groupBy("word").agg(F.countDistinct("_unit", "_scale").alias("n"), F.min("_unit").alias("_unit"), F.min("_scale").alias("_scale"), F.avg("_offset").alias("_offset")).where("n = 1").drop("n")
            new = written(left.select("source", "word").distinct().join(alike, "word").select("source", "word", "_unit", "_scale", "_offset"), "told")
            if new.isEmpty():
                break
        told = new if told is None else told.unionByName(new)
        reached = left.join(new, ["source", "word"])
        ground = written(ground.unionByName(reached.select("source", F.col("_unit").alias("base_unit"), "thing", (F.col("x") * F.col("_scale") + F.col("_offset")).alias("y"))), "ground")
        left = written(left.join(new.select("source", "word"), ["source", "word"], "left_anti"), "strange")
    if told is None:
        return valued
    more = rows.join(told, ["source", "word"], "left")
    value = F.round(F.col("scaled") * F.col("_scale").cast("decimal(20,8)") + F.col("_offset").cast("decimal(20,6)"), 0).try_cast("bigint")
    more = more.withColumn("base_unit", F.when(value.isNotNull(), F.col("_unit"))).withColumn("base_value", value)
    return valued.where(~open_).unionByName(more.select(*valued.columns))


def normalize_quantities(facts: DataFrame, tables: DataFrame, rates: DataFrame) -> DataFrame:
    """(fact_id, base_unit, base_value): each fact that holds one number and whose unit of measure can be told, once.

    Null and empty fields supply nothing; ranges, dates, periods and texts without a number give no row, nor does a
    value too large for BIGINT. Words the lexicon lacks are told by propagate(); facts with a word that is not told so give no row.
    """
    valued = written(in_base_units(read_facts(facts, tables), rates), "valued")
    return propagate(valued, rates).where("base_value is not null").select("fact_id", "base_unit", "base_value")


def held_out(facts: DataFrame, tables: DataFrame, rates: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(base_unit, facts, told, right): how many facts the lexicon values by the given words, and how many are told, and rightly, without them."""
    truth = written(in_base_units(read_facts(facts, tables), rates).where("base_value is not null").select("fact_id", F.col("base_unit").alias("_unit"), F.col("base_value").alias("_value")), "truth")
    blind = written(in_base_units(read_facts(facts, tables, words), rates), "blind")
    hit = blind.where("word is not null and base_value is null").select("fact_id").join(truth, "fact_id")
    got = propagate(blind, rates).where("base_value is not null").select("fact_id", "base_unit", "base_value")
    right = (F.col("base_unit") == F.col("_unit")) & (F.abs(F.col("base_value") - F.col("_value")) <= 1)
    return hit.join(got, "fact_id", "left").groupBy(F.col("_unit").alias("base_unit")).agg(F.count(F.lit(1)).alias("facts"), F.count("base_value").alias("told"), F.count_if(right).alias("right"))
