"""The second step: ensembles of spectra to cut-off frequencies, and corrected fluxes from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turbula.operators import correction, ensemble, spectra


def cutoffs_by_class(binned: DataFrame, essentials: DataFrame, class_column: str, least: int = 10, noise_above: float | None = None) -> DataFrame:
    """Cut-off frequency of each class from its mean spectrum.

    ``binned``: period, bin, freq, density; ``essentials``: period and a class.
    """
    sound = spectra.plausible_bins(binned, ["period"])
    classed = sound.join(essentials.select("period", class_column), "period").where(F.col(class_column).isNotNull())
    mean = ensemble.class_average(classed, [class_column], least=least)
    if noise_above is not None:
        mean = ensemble.remove_noise(mean, [class_column], noise_above)
    fits = ensemble.fit_models(mean, [class_column], "freq", "density", "first_order")
    return fits.select(class_column, "n", F.element_at("parameters", 1).alias("factor"), F.abs(F.element_at("parameters", 2)).alias("cutoff"))


def correct_fluxes(essentials: DataFrame, cutoffs: DataFrame, class_column: str, flux: str, wind: str, a: float, b: float) -> DataFrame:
    """Fluxes times the factor that their class's cut-off gives; without one they stay."""
    factor = correction.ibrom_07(a, b, F.col(wind), F.col("cutoff"))
    out = essentials.join(cutoffs.select(class_column, "cutoff"), class_column, "left")
    return out.withColumn(f"{flux}_corrected", F.col(flux) * F.coalesce(factor, F.lit(1.0)))
