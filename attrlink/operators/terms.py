"""Units, synonyms and abbreviations applied to values.

The dictionaries are a few dozen fixed entries, so they enter the plan as map literals: a lookup
is a codegen expression on the row, with no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dictionaries import ABBREVIATIONS, OFFSETS, SYNONYMS, UNITS
from ..schema import KEYS
from .matching import first_rows

QUANTITY = rf"([+-]?{X.DIGIT}+\.?{X.DIGIT}*){X.SPACE}*(°?[a-zA-Zµμ]+)"
SIGNIFICANT = 4


def _literal_map(pairs, value=F.lit) -> Column:
    return F.create_map(*(x for k, v in pairs for x in (F.lit(k), value(v))))


_UNIT_TABLE = [
    (unit, dimension, factor, OFFSETS.get(unit, 0.0) if dimension == "temperature" else 0.0)
    for dimension, units in UNITS.items()
    for unit, factor in units.items()
]


def quantities(value, attribute=None) -> Column:
    """All ``number unit`` parts as (number, unit, dimension, base); unknown units are left out.

    Bare ``c``, ``f`` and ``k`` read as temperatures only if the attribute speaks of one; with a
    degree sign they always do.
    """
    value = X._col(value)
    table = _literal_map(
        (
            (u, F.struct(F.lit(d).alias("dimension"), F.lit(f).alias("factor"), F.lit(o).alias("offset")))
            for u, d, f, o in _UNIT_TABLE
        ),
        value=lambda v: v,
    )
    named = F.lower(X.text(attribute)).contains("temp") if attribute is not None else F.lit(False)
    found = F.arrays_zip(
        F.regexp_extract_all(value, F.lit(QUANTITY), F.lit(1)).alias("number"),
        F.regexp_extract_all(value, F.lit(QUANTITY), F.lit(2)).alias("unit"),
    )

    def parse(part):
        plain = F.translate(F.lower(part["unit"]), "°µμ", "")
        micro = F.regexp_replace(F.lower(part["unit"]), "[µμ]", "u")
        unit = F.when(part["unit"].contains("°"), plain).otherwise(micro)
        entry = F.try_element_at(table, unit)
        number = part["number"].try_cast("double")
        heat = entry["dimension"] == "temperature"
        sure = ~heat | part["unit"].contains("°") | named
        return F.when(
            sure & number.isNotNull() & entry.isNotNull(),
            F.struct(
                number.alias("number"),
                unit.alias("unit"),
                entry["dimension"].alias("dimension"),
                (number * entry["factor"] + entry["offset"]).alias("base"),
            ),
        )

    return F.array_compact(F.transform(found, parse))


def round_significant(number: Column, digits: int = SIGNIFICANT) -> Column:
    """Round to significant digits, so nearly equal conversions print the same."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(number))))
    return F.when(number == 0, 0.0).otherwise(F.round(number * scale) / scale)


def unit_normalize(value, attribute=None) -> Column:
    """Quantities of a value in base units, ``dimension=number`` joined by spaces; '' if none."""
    parts = F.transform(
        quantities(value, attribute),
        lambda q: F.concat(q["dimension"], F.lit("="), round_significant(q["base"]).cast("string")),
    )
    return F.array_join(parts, " ")


def expand_abbreviations(value) -> Column:
    """Lower words with abbreviations written out."""
    words = _literal_map(ABBREVIATIONS.items())
    return F.array_join(
        F.transform(X.tokens(F.lower(X._col(value))), lambda t: F.coalesce(F.try_element_at(words, t), t)),
        " ",
    )


def _meanings() -> dict[str, list[str]]:
    meanings: dict[str, list[str]] = {}
    for kept, words in SYNONYMS.items():
        for word in words:
            meanings.setdefault(word, []).append(kept)
    return meanings


def expand_synonyms(value, attribute) -> Column:
    """Lower words with synonyms replaced by the word to keep.

    A word with several meanings is replaced only where the attribute name has one of them.
    """
    table = _literal_map(
        _meanings().items(), value=lambda ws: F.array(*(F.lit(w) for w in ws))
    )
    topic = F.lower(X.text(attribute))

    def replace(token):
        options = F.try_element_at(table, token)
        scoped = F.try_element_at(F.filter(options, lambda o: topic.contains(o)), F.lit(1))
        return F.coalesce(
            F.when(F.size(options) == 1, F.get(options, F.lit(0))).otherwise(scoped), token
        )

    return F.array_join(F.transform(X.tokens(F.lower(X._col(value))), replace), " ")


@dataclass(frozen=True)
class ValueRules:
    """What counts as the same spelling of a value; the defaults are plain normalization."""

    normalize_case: bool = True
    remove_punctuation: bool = False
    handle_units: bool = False
    handle_synonyms: bool = False
    handle_abbreviations: bool = False

    def apply(self, value, attribute) -> Column:
        v = X.text(value)
        if self.handle_units:
            v = base_units(v, attribute)
        if self.handle_synonyms:
            v = expand_synonyms(v, attribute)
        if self.handle_abbreviations:
            v = expand_abbreviations(v)
        v = X.normalize(v, lower=self.normalize_case)
        if self.remove_punctuation:
            v = F.array_join(X.tokens(F.regexp_replace(v, r"[^\p{L}\p{N}_ ]", " ")), " ")
        return v


def base_units(value, attribute) -> Column:
    """A value with its quantities in base units, if every quantity in it is known."""
    value = X._col(value)
    known = quantities(value, attribute)
    all_known = F.size(known) == F.size(F.regexp_extract_all(value, F.lit(QUANTITY), F.lit(0)))
    rest = F.array_join(X.tokens(F.regexp_replace(value, QUANTITY, " ")), " ")
    parts = F.transform(
        known,
        lambda q: F.concat(round_significant(q["base"]).cast("string"), F.lit(" "), q["dimension"]),
    )
    rewritten = F.array_join(F.concat(F.filter(F.array(rest), lambda r: r != ""), parts), " ")
    return F.when((F.size(known) > 0) & all_known, rewritten).otherwise(value)


def unit_matches(
    inputs: DataFrame, reference: DataFrame, tolerance: float = 0.001, k: int = 5
) -> DataFrame:
    """Inputs and reference rows of one key whose single quantity is the same in base units.

    Equality within a relative tolerance is an equi-join on logarithmic bands: reference values
    sit in one band, input values look into their own and the two next to it. Both sides are
    reduced to distinct quantities first, so hot values meet once.
    """
    by = [*KEYS, "dimension", "base"]
    band = F.floor(F.log(F.abs("base")) / F.lit(2.0 * tolerance))
    side = {"sign": F.signum("base"), "band": F.coalesce(band, F.lit(0))}

    def one(df, value):
        q = quantities(value, "attribute_name")
        df = df.withColumn("q", q).filter(F.size("q") == 1)
        only = F.get("q", F.lit(0))
        return df.withColumns({"dimension": only["dimension"], "base": only["base"]})

    known = first_rows(one(reference, "preset_value"), by, ["preset_value"], k)
    known = known.withColumnRenamed("base", "preset_base")
    known = known.withColumn("base", F.col("preset_base")).withColumns(side).drop("base")
    asked = one(inputs, "input_value")
    near = asked.select(*by).distinct().withColumns(side)
    near = near.withColumn(
        "band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))
    )
    gap = F.abs(F.col("base") - F.col("preset_base"))
    largest = F.greatest(F.abs("base"), F.abs("preset_base"))
    pairs = near.join(known, [*KEYS, "dimension", "sign", "band"]).filter(
        gap <= F.lit(tolerance) * largest
    )
    found = F.transform(
        "rows",
        lambda r: F.struct(
            gap.alias("gap"), r["row_id"].alias("row_id"), r["preset_value"].alias("preset_value"),
            F.col("preset_base").alias("preset_base"),
        ),
    )
    nearest = Window.partitionBy(*by).orderBy(gap, "rank")
    pairs = pairs.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k)
    answers = pairs.groupBy(*by).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(found))), 1, k).alias("matches")
    )
    hits = asked.join(answers, by).select(
        "input_id", *KEYS, "input_value", "dimension", "base",
        F.posexplode("matches").alias("place", "m"),
    )
    return hits.select(
        "input_id", (F.col("place") + 1).alias("match_rank"), *KEYS, "input_value", "dimension",
        "base", F.col("m.row_id").alias("preset_row_id"), "m.preset_value", "m.preset_base",
    )
