"""Amounts recorded in different scales and currencies, as won.

The numbers are taken to be one log-scale distribution of sums seen through units: a mixture whose components are that
distribution shifted by the logarithms of the known factors (scales, rates of currencies, and the thousand that numbers
are too large by). The distribution is that of the sums which notes state, its density smoothed over a histogram; the
weights of the components come from EM over the numbers without a stated unit.

Each number gets the unit of the largest posterior, flagged where that is small. A note's evidence goes into the
posterior: a stated unit leaves only its component, a stated sum only components that lead from the number to it; a
number that no component leads there is of no known unit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom.functions.money import notes_to_won
from noticeloom.session import materialise

#: Won that the number 1 stands for, by unit; the last is of numbers too large by a thousand.
UNITS = {"원": 1.0, "천원": 1e3, "만원": 1e4, "백만원": 1e6, "억원": 1e8, "천분의 1원": 1e-3}
#: Bins a decade of the histograms that the mixture is fitted on; 64-bit numbers have less than 19 decades.
BINS, DECADES = 100, 19
#: Width, in decades, that the histogram of stated sums is smoothed by, and density everywhere besides.
SMOOTH, FLOOR = 0.05, 1e-6
#: Width, in decades, of the sums that a component leads to.
NEAR = 0.01
#: Posteriors under this are flagged.
SURE = 0.9
#: Currencies whose rates may be components; they go to the driver.
MAX_CURRENCIES = 1000

_NOTE = T.StructType([T.StructField("basis", T.StringType()), T.StructField("currency", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("factor", T.DoubleType())])


@dataclass(frozen=True)
class Mixture:
    """names and factors of the components, and for each bin of a number's logarithm their posteriors."""

    names: tuple[str, ...]
    factors: tuple[float, ...]
    posteriors: np.ndarray

    def table(self, like: DataFrame) -> DataFrame:
        rows = [(k, [float(x) for x in p]) for k, p in enumerate(self.posteriors)]
        return like.sparkSession.createDataFrame(rows, "bin int, prior array<double>")


def components(fx_rates: DataFrame) -> dict[str, float]:
    """The factor of each unit and currency; the table of rates is a small one, more than MAX_CURRENCIES are refused."""
    rates = fx_rates.where("krw_per_unit > 0 AND currency IS NOT NULL").groupBy("currency").agg(F.max("krw_per_unit").alias("rate")).limit(MAX_CURRENCIES + 1).collect()
    if len(rates) > MAX_CURRENCIES:
        raise ValueError(f"more than {MAX_CURRENCIES} currencies")
    return UNITS | {r["currency"]: float(r["rate"]) for r in sorted(rates) if r["currency"] != "KRW"}


def bin_of(amount: Column) -> Column:
    return F.round(F.log10(amount.cast("double")) * BINS).cast("int")


def fit_mixture(parsed: DataFrame, factors: dict[str, float], rounds: int = 100) -> Mixture:
    """EM on histograms of the logarithms; they are counted over all rows and have a bounded number of bins.

    Without stated sums every component is as likely as its weight; without bare numbers all weights are equal.
    """
    stated = F.col("won").isNotNull() & (F.col("won") > 0)
    kinds = parsed.select(F.when(stated, "stated").otherwise("bare").alias("kind"), bin_of(F.when(stated, F.col("won")).otherwise(F.when(F.col("amount_max_krw") > 0, F.col("amount_max_krw")))).alias("bin"))
    counts = {"stated": np.zeros(BINS * DECADES + 1), "bare": np.zeros(BINS * DECADES + 1)}
    for r in kinds.where("bin IS NOT NULL").groupBy("kind", "bin").count().collect():
        counts[r["kind"]][min(r["bin"], BINS * DECADES)] += r["count"]
    reach = np.arange(-4 * int(SMOOTH * BINS), 4 * int(SMOOTH * BINS) + 1)
    kernel = np.exp(-0.5 * (reach / (SMOOTH * BINS)) ** 2)
    known = counts["stated"].sum()
    density = np.convolve(counts["stated"], kernel / kernel.sum(), "same") / max(known, 1) * BINS + FLOOR
    shifts = [round(math.log10(f) * BINS) for f in factors.values()]
    at = np.arange(len(density))[:, None] + np.array(shifts)[None, :]
    shifted = np.where((at >= 0) & (at < len(density)), density[np.clip(at, 0, len(density) - 1)], FLOOR)
    weights = np.full(len(shifts), 1 / len(shifts))
    for _ in range(rounds if counts["bare"].sum() else 0):
        p = shifted * weights
        weights = (counts["bare"][:, None] * p / p.sum(axis=1, keepdims=True)).sum(axis=0) / counts["bare"].sum()
    p = shifted * weights
    return Mixture(tuple(factors), tuple(factors.values()), p / p.sum(axis=1, keepdims=True))


def parse_notes(extractions: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """extraction_id, amount_max_krw, note, basis (amount, unit or none) and won, the sum in won that the note gives.

    Each distinct note is parsed once a batch. Foreign sums are multiplied by the rate and rounded to whole won; a
    currency without rate gives no sum. Repeated extraction rows count once, of differing ones the smallest.
    """
    note = F.pandas_udf(notes_to_won, _NOTE)
    rows = extractions.select("extraction_id", F.col("overview.amount_max_krw").alias("amount_max_krw"), F.col("overview.amount_note").alias("note")).groupBy("extraction_id").agg(F.min(F.struct("amount_max_krw", "note")).alias("e")).select("extraction_id", "e.*")
    rows = rows.withColumn("n", note("note"))
    rates = fx_rates.groupBy("currency").agg(F.max("krw_per_unit").alias("rate")).withColumnRenamed("currency", "rate_of")
    rows = rows.join(rates, F.col("n.currency") == F.col("rate_of"), "left")
    rate = F.when(F.col("n.currency") == "KRW", F.lit(1.0)).otherwise(F.col("rate"))
    number = F.when(F.col("n.basis") == "amount", F.col("n.amount")).otherwise(F.col("amount_max_krw") * F.col("n.factor"))
    return rows.select("extraction_id", "amount_max_krw", "note", F.coalesce("n.basis", F.lit("none")).alias("basis"), F.floor(number * rate + 0.5).cast("bigint").alias("won"))


def amounts_in_won(extractions: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """Each extraction's amount in won: extraction_id, amount_max_krw, note, basis, amount_krw, unit, posterior, unsure.

    unit is the component of the largest posterior, null where no known unit leads from the number to what the note
    states, or where the number is null or not positive. Where the note states a sum (basis amount) or a unit, amount_krw
    is what it gives; where it states neither (basis none), the number times the unit's factor, unsure where the
    posterior is under SURE. Empty tables give empty results.
    """
    parsed = materialise(parse_notes(extractions, fx_rates), "parsed-notes")
    mix = fit_mixture(parsed, components(fx_rates))
    amount, won = F.col("amount_max_krw"), F.col("won")
    rows = parsed.withColumn("bin", bin_of(F.when(amount > 0, amount))).join(mix.table(parsed), "bin", "left")
    names, factors = F.array(*map(F.lit, mix.names)), F.array(*map(F.lit, mix.factors))
    # what the note says of each component; that of won is certain or excluded
    off = lambda f: F.log10(amount.cast("double")) + F.log10(f) - F.log10(won.cast("double"))
    said = lambda f: F.when(F.col("basis") == "none", 1.0).when(won.isNull() | (won <= 0), 0.0).when(f == 1.0, F.when(amount == won, 1.0).otherwise(0.0)).otherwise(F.exp(-0.5 * F.pow(off(f) / NEAR, F.lit(2))))
    weighed = F.zip_with(F.transform(factors, said), "prior", lambda s, p: s * p)
    rows = rows.withColumn("p", weighed).withColumn("all", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).withColumn("top", F.array_max("p"))
    led = F.col("all") > FLOOR**2
    at = F.when(led, F.array_position("p", F.col("top")).cast("int"))
    bare = (F.col("basis") == "none") & led
    rows = rows.withColumn("at", at)
    return rows.select(
        "extraction_id", "amount_max_krw", "note", "basis",
        F.when(bare, F.floor(amount * F.element_at(factors, F.col("at")) + 0.5).cast("bigint")).when(F.col("basis") == "none", amount).otherwise(won).alias("amount_krw"),
        F.element_at(names, F.col("at")).alias("unit"), F.when(led, F.col("top") / F.col("all")).alias("posterior"),
        F.coalesce(bare & (F.col("top") / F.col("all") < SURE), F.lit(False)).alias("unsure"),
    )


def wrong_amounts(amounts: DataFrame) -> DataFrame:
    """Extractions whose number isn't in won by its posterior, where the note states a sum or unit; then the exact check."""
    stated = F.col("basis").isin("amount", "unit") & F.col("amount_krw").isNotNull() & F.col("amount_max_krw").isNotNull()
    other_unit = F.coalesce(F.col("unit") != "원", F.lit(True))
    return amounts.where(stated & other_unit & (F.col("amount_max_krw") != F.col("amount_krw"))).select("extraction_id")
