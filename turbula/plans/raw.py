"""From raw records to a row of fluxes for each averaging period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turbula.functions import stats, thermo
from turbula.operators import bootstrap_lag, correction, fluxes, footprint, masks, quality, spectra, transform, uncertainty
from turbula.plans.config import Run
from turbula.plans.stage import kept

WIND = ["u", "v", "w"]


def prepare(records: DataFrame, run: Run, scalars: list[str], planes: DataFrame | None = None) -> DataFrame:
    """Masked, despiked and rotated records. ``records``: period, rec, u, v, w, ts and scalars.

    Everything up to the statistics needs the records of a period together, so
    they are dealt out by period once and each step reuses that. ``planes``: see
    :func:`fit_planes`; without it a planar fit takes those of these records.
    """
    return rotated(despiked(masked(records, run, scalars), run, scalars), run, planes)


def dealt(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records dealt out by period and put in order, which later steps keep."""
    return records.select("period", "rec", *columns).repartition("period").sortWithinPartitions("period", "rec")


def plausible(df: DataFrame, run: Run, columns: list[str]) -> DataFrame:
    """Without implausible values, and without variables that miss too many in a period."""
    df = masks.finite(df, columns)
    df = masks.gross_limits(df, WIND, ["ts"])
    if run.limits:
        df = masks.limits_mask(df, {k: v for k, v in run.limits.items() if k in columns})
    return masks.corrupted_variables(df, "period", columns, None, run.max_missing_percent)


def masked(records: DataFrame, run: Run, scalars: list[str]) -> DataFrame:
    """Records dealt out by period, without implausible values."""
    columns = [*WIND, "ts", *scalars]
    return plausible(dealt(records, columns), run, columns)


def despiked(df: DataFrame, run: Run, scalars: list[str]) -> DataFrame:
    """Records without spikes; how many there were is left out, or it would go with every record through the later steps."""
    columns = [*WIND, "ts", *scalars]
    if run.despike == "none":
        return df
    options = {"window": max(60, int(run.minutes * 10 * run.hertz))} if run.despike == "moving" else {}
    return quality.despike(df, "period", columns, "rec", run.despike, **options).drop(*[f"{c}_spikes" for c in columns])


def rotated(df: DataFrame, run: Run, planes: DataFrame | None = None) -> DataFrame:
    if run.rotation in ("double_rotation", "triple_rotation"):
        df = transform.double_rotation(df, "period")
    if run.rotation == "triple_rotation":
        df = transform.third_rotation(df, "period")
    if run.rotation.startswith("planar_fit"):
        df = planar_rotation(df, run.rotation == "planar_fit", run.sectors, planes)
    return df


def fit_planes(df: DataFrame, bias: bool = True, sectors: int = 1) -> DataFrame:
    """The plane of each wind sector through the period means: ``sector, b0, b1, b2``; a table to be written and given to later runs."""
    means = df.groupBy("period").agg(*[F.avg(c).alias(c) for c in WIND])
    means = means.withColumn("sector", transform.wind_sector(stats.wind_direction("u", "v"), sectors))
    return transform.borrow_sectors(transform.planar_fit(means, "sector", bias=bias), "sector", sectors).select("sector", "b0", "b1", "b2")


def planar_rotation(df: DataFrame, bias: bool = True, sectors: int = 1, planes: DataFrame | None = None) -> DataFrame:
    """Turn into the plane (of ``planes``, or else) fitted to the period means of the wind's sector, then into each period's mean wind.

    A sector without a plane borrows its neighbour's; without any, its records stay as they are.
    """
    over = Window.partitionBy("period")
    mean = {c: F.avg(c).over(over) for c in WIND}
    fit = planes if planes is not None else fit_planes(df, bias, sectors)
    df = df.withColumn("sector", transform.wind_sector(stats.wind_direction(mean["u"], mean["v"]), sectors))
    out = df.join(F.broadcast(fit), "sector", "left")  # at most 360 rows
    p = transform.planar_rotation(F.col("b1"), F.col("b2"))
    w0 = F.col("w") - F.col("b0")
    turned = [F.coalesce(r[0] * F.col("u") + r[1] * F.col("v") + r[2] * w0, F.when(F.col("b1").isNull(), F.col(c))) for c, r in zip(WIND, p, strict=True)]
    out = out.select(*[c for c in out.columns if c not in (*WIND, "sector", "b0", "b1", "b2")], *[t.alias(c) for c, t in zip(WIND, turned, strict=True)])
    out = out.withColumn("_yaw", F.atan2(mean["v"], mean["u"]))
    return out.withColumns({"u": F.col("u") * F.cos("_yaw") + F.col("v") * F.sin("_yaw"), "v": F.col("v") * F.cos("_yaw") - F.col("u") * F.sin("_yaw")}).drop("_yaw")


def align(df: DataFrame, run: Run, scalars: list[str]) -> tuple[DataFrame, list[str]]:
    """Scalars shifted by their lags, and the columns that tell the lags found."""
    if run.lag == "none":
        return df, []
    if run.lag == "constant":
        return transform.shift(df, "period", scalars, run.default_lag), []
    names = [f"{x}_{c}" for c in scalars for x in ("lag", "default_lag")]
    if run.lag == "pwb":
        df = kept(df)  # read for the lags, and again to apply them
        found = bootstrap_lag.detect_lags(df, "period", scalars, run.hertz, run.bootstrap, run.default_lag)
        lags = bootstrap_lag.accept_lags(found, "period", run.hertz, run.instruments, run.bootstrap)
        each = [F.max(F.when(F.col("gas") == c, x)).alias(f"{n}_{c}") for c in scalars for n, x in (("lag", F.col("applied")), ("default_lag", F.col("reliability") == "fallback"))]
        return transform.apply_own_lags(df.join(lags.groupBy("period").agg(*each), "period", "left"), "period", scalars), names
    lags = range(run.lag_range[0], run.lag_range[1] + 1)
    df = transform.align_to_best_lags(df, "period", "w", scalars, lags, run.default_lag, fallback=run.lag.endswith("default"))
    return df, names


def fluctuate(df: DataFrame, run: Run, columns: list[str]) -> DataFrame:
    if run.detrend == "ld":
        return transform.linear_detrend(df, "period", columns)
    if run.detrend == "rm":
        return transform.running_mean(df, "period", columns, max(1, int(run.time_constant * run.hertz)))
    if run.detrend == "ew":
        return transform.exponential_average(df, "period", columns, run.hertz, run.time_constant)
    return transform.block_average(df, "period", columns)


def statistics_by_level(records: DataFrame, run: Run, scalars: tuple[str, ...] = ("co2", "h2o")) -> DataFrame:
    """Statistics of every variable after each step: one row for each ``period, level, variable``.

    Levels: 1 as read, 2 without implausible values, 3 despiked, 4 rotated, 5 with
    lags, 6 fluctuations. Columns: n, mean, sd, lowest, highest, skewness,
    kurtosis, cov_w (with the vertical wind of the same level). The steps run once:
    a record carries what each of them changed, and a level without a change has
    the statistics of the one before.
    """
    names, x = list(scalars), [*WIND, "ts", *scalars]
    levels: list[list] = []  # first level, last level with the same values, column of each variable

    def noted(df: DataFrame, level: int, changed: list[str], suffix: str = "") -> DataFrame:
        if not changed:
            levels[-1][1] = level
            return df
        new = {c: f"_{level}_{c}" for c in changed}
        levels.append([level, level, (levels[-1][2] if levels else {}) | new])
        return df.withColumns({n: F.col(c + suffix) for c, n in new.items()})

    df = noted(dealt(records, x), 1, x)
    df = noted(plausible(df, run, x), 2, x)
    df = noted(despiked(df, run, names), 3, x if run.despike != "none" else [])
    if run.despike != "none" and run.rotation.startswith("planar_fit"):
        df = kept(df)  # read for the planes, and again to turn into them
    df = noted(rotated(df, run), 4, WIND if run.rotation != "none" else [])
    df = noted(align(df, run, names)[0], 5, names if run.lag != "none" else [])
    df = noted(fluctuate(df, run, x), 6, x, "_p")
    cells = [F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.lit(i).alias("_i"), F.col(at[c]).alias("_x"), F.col(at["w"]).alias("_w")) for a, b, at in levels for i, c in enumerate(x, 1)]
    found = df.select("period", F.inline(F.array(*cells))).groupBy("period", "_a", "_b", "_i").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.min("_x").alias("lowest"), F.max("_x").alias("highest"),
        stats.helper_skewness("_x").alias("skewness"), stats.helper_kurtosis("_x").alias("kurtosis"), stats.covariance("_w", "_x").alias("cov_w"),
    )
    variable = F.element_at(F.array(*[F.lit(c) for c in x]), F.col("_i")).alias("variable")
    return found.select("period", F.explode(F.sequence("_a", "_b")).alias("level"), variable, *[c for c in found.columns if c[0] != "_" and c != "period"])


def fluxes_by_period(records: DataFrame, run: Run, scalars: tuple[str, ...] = ("co2", "h2o"), planes: DataFrame | None = None) -> DataFrame:
    """One row per period: means, covariances, level 0 to 3 fluxes, flags and footprint.

    ``co2`` and ``h2o`` are densities in mmol/m3, ``ts`` is in K; for a closed
    path they are those in the cell, at the air's temperature where ``tc``, the
    cell's, is not among ``scalars``. The records are dealt out by period once;
    what needs a period's records together is one aggregation of them; for the random
    uncertainty, a second one, the prepared records are kept.
    """
    scalars = list(scalars)
    df, lags = align(prepare(records, run, scalars, planes), run, scalars)
    df = fluctuate(df, run, [*WIND, "ts", *scalars])
    main = scalars[0] if scalars else "ts"
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy("period")))
    if run.uncertainty != "none":
        df = kept(df.select("period", "rec", "_n", *WIND, "ts", *scalars, *[f"{c}_p" for c in [*WIND, "ts", *scalars]], *lags))
    agg = [F.count("*").alias("n_records"), F.count("w").alias("n_valid")]
    agg += [F.avg(c).alias(f"mean_{c}") for c in [*WIND, "ts", *scalars]]
    agg += [stats.covariance("w_p", f"{c}_p").alias(f"cov_w{c}") for c in ["u", "v", "ts", *scalars]]
    agg += [F.stddev_pop("w_p").alias("sigma_w"), F.stddev_pop("u_p").alias("sigma_u"), stats.turbulent_kinetic_energy("u", "v", "w").alias("tke")]
    agg += [F.var_pop(f"{main}_p").alias("_var_main"), quality.chunk_covariances("w_p", f"{main}_p", "rec", F.col("_n")).alias("_inner")]
    agg += [F.max(c).alias(c) for c in lags]
    row = df.groupBy("period").agg(*agg)
    c = F.col
    pressure = F.lit(run.pressure) if run.pressure else thermo.air_pressure(run.altitude, F.lit(None).cast("double"), F.lit(None).cast("double"))
    t, p = c("mean_ts"), pressure
    water = c("mean_h2o") if "h2o" in scalars else F.lit(0.0)
    e = water * 1e-3 * 8.314 * t  # mmol/m3 to Pa
    q, rho_d, rho_w = thermo.specific_humidity(e, t, p), thermo.dry_density(e, t, p), thermo.vapour_density(e, t)
    humidity = F.least(F.lit(100.0), 100 * e / thermo.saturation_pressure(t))
    row = row.withColumns({
        "ta": thermo.air_temperature_from_sonic(t, q), "rh": humidity, "rho_w": rho_w, "rho_d": rho_d, "rho_cp": thermo.heat_capacity(e, humidity, t, p),
        "sigma": rho_w / rho_d, "ustar": fluxes.friction(c("cov_wu"), c("cov_wv")), "wind_speed": F.sqrt(c("mean_u") * c("mean_u") + c("mean_v") * c("mean_v")),
    })
    length = fluxes.obukhov_length(c("ustar"), c("ta"), p, c("cov_wts"))
    row = row.withColumns({"h_0": c("rho_cp") * c("cov_wts"), "l": length, "z_l": fluxes.stability(run.height, run.displacement, length), "tau": fluxes.momentum_flux(c("rho_d") + c("rho_w"), c("ustar"), c("cov_wu"))})
    factor = F.lit(1.0)
    if run.high_frequency != "none":
        row = _with_factor(row, run)
        factor = F.coalesce(c("factor"), F.lit(1.0))
    row = row.withColumn("h", c("h_0") * factor)
    row = _densities(row, run, scalars, factor, p)
    if run.flags != "none":
        cov = c(f"cov_w{main}")
        sw, _ = quality.itc_models(c("z_l"), run.latitude, c("ustar"))
        deviation = F.when(cov != 0, F.floor(F.abs((c("_inner") - cov) / cov) * 100).cast("long"))
        row = row.withColumns({"deviation": deviation, "turbulence": quality.developed_turbulence(c("sigma_w") / F.nullif(c("ustar"), F.lit(0.0)), sw)})
        a, b = quality.partial_flag(c("deviation")), quality.partial_flag(c("turbulence"))
        overall = {"mauder_foken_04": quality.overall_flag_0_2, "foken_03": quality.overall_flag_1_9, "goeckede_06": quality.overall_flag_1_5}[run.flags]
        row = row.withColumn("flag", overall(a, b))
    row = _with_uncertainty(row, df, run, main)
    zm = run.height - run.displacement
    if run.footprint == "kljun_04":
        row = row.withColumns({f"foot_{k}": v for k, v in footprint.kljun_04(c("sigma_w"), c("ustar"), c("z_l"), zm, run.roughness).items()})
    elif run.footprint == "hsieh_00":
        zu = footprint.hsieh_scale(zm, run.roughness)
        row = row.withColumns({f"foot_{k}": v for k, v in footprint.hsieh_00(zu / c("l"), c("l"), zu).items()})
    elif run.footprint == "kormann_meixner_01":
        row = row.withColumn("_f", footprint.kormann_meixner_01(c("ustar"), c("z_l"), c("wind_speed"), zm))
        row = row.withColumns({f"foot_{k}": c("_f")[k] for k in ("peak", *footprint.SHARES)}).drop("_f")
    return row.drop("_inner", "_var_main")


def _densities(row: DataFrame, run: Run, scalars: list[str], factor: Column, p: Column) -> DataFrame:
    """Evaporation and gas fluxes, with the density terms of the analyser's path."""
    c = F.col
    heating = F.lit(0.0)
    if run.self_heating and run.path == "open":
        heating = F.coalesce(fluxes.surface_heating(c("ta"), c("wind_speed"), run.self_heating), F.lit(0.0))
    t_cell = c("mean_tc") if "tc" in scalars else c("ta")
    p_cell = F.lit(run.cell_pressure) if run.cell_pressure else p
    h_cell = c("rho_cp") * c("cov_wtc") if "tc" in scalars else F.lit(0.0)
    va = thermo.molar_volume(t_cell, p_cell)
    no_pressure_term = F.lit(None).cast("double")
    if "h2o" in scalars:
        e1 = c("cov_wh2o") * 0.01802 * 1e-3 * factor
        e3 = e1
        if run.density_terms and run.path == "open":
            e3 = fluxes.open_path_evaporation(e1, c("h"), c("rho_w"), c("rho_cp"), c("ta"), c("sigma"), heating)
        elif run.density_terms:
            ratio = p / p_cell * t_cell / c("ta")
            e3 = fluxes.closed_path_evaporation(e1, h_cell, no_pressure_term, c("rho_w"), c("rho_cp"), t_cell, p_cell, ratio, c("sigma"))
        row = row.withColumns({"evaporation": e3, "le": e3 * thermo.vaporisation_heat(c("ta")), "et": e3 * 3600})
    wet = c("evaporation") if "h2o" in scalars else F.lit(0.0)
    for s in scalars:
        if s not in ("h2o", "tc"):
            f1 = c(f"cov_w{s}") * 1e3 * factor
            f3 = f1
            if run.density_terms and run.path == "open":
                f3 = fluxes.open_path_gas(f1, wet, c("h"), c(f"mean_{s}"), c("rho_d"), c("rho_cp"), c("ta"), c("sigma"), heating)
            elif run.density_terms:
                chi = c(f"mean_{s}") * va * 1e3  # mmol/m3 to umol/mol
                f3 = fluxes.closed_path_gas(f1, wet, h_cell, no_pressure_term, chi, c("rho_w"), c("rho_cp"), t_cell, p_cell, va, c("sigma"))
            row = row.withColumn(f"flux_{s}", f3)
    return row


def _with_uncertainty(row: DataFrame, df: DataFrame, run: Run, main: str) -> DataFrame:
    c, x = F.col, f"{main}_p"
    if run.uncertainty == "none":
        return row
    if run.uncertainty == "mann_lenschow_94":
        scale = uncertainty.integral_scale(df, "period", "w_p", x, "rec", 20, run.hertz, 0.0)
        corr = F.abs(c(f"cov_w{main}")) / F.nullif(c("sigma_w") * F.sqrt("_var_main"), F.lit(0.0))
        found = uncertainty.mann_lenschow(c(f"cov_w{main}"), corr, c("its"), c("n_records") / run.hertz)
        return row.join(scale, "period", "left").withColumn("uncertainty", found).drop("its")
    found = {
        "mahrt_98": lambda: uncertainty.mahrt(df, "period", "w_p", x, "rec"),
        "finkelstein_sims_01": lambda: uncertainty.finkelstein_sims(df, "period", "w_p", x, "rec", 20),
        "billesbach_11": lambda: uncertainty.billesbach(df, "period", "w_p", x, "rec"),
    }[run.uncertainty]()
    return row.join(found.select("period", "uncertainty"), "period", "left")


def spectra_by_period(records: DataFrame, run: Run, scalars: tuple[str, ...] = ("co2", "h2o"), bins: int = 30) -> DataFrame:
    """Binned cospectra of vertical wind, each divided by its covariance: ``period, pair, bin, freq, density, n``."""
    df, _ = align(prepare(records, run, list(scalars)), run, list(scalars))
    df = fluctuate(df, run, [*WIND, "ts", *scalars])
    columns = ["u", "ts", *scalars]
    long = spectra.cospectra(df, "period", "rec", [("w_p", f"{x}_p") for x in columns], run.hertz, run.taper)
    covariances = df.groupBy("period").agg(*[F.covar_pop("w_p", f"{x}_p").alias(f"w_p_{x}_p") for x in columns])
    covariances = covariances.unpivot(["period"], [f"w_p_{x}_p" for x in columns], "pair", "cov")
    scaled = spectra.normalised(long, covariances, ["period", "pair"])
    return spectra.binned(scaled, ["period", "pair"], 1 / (run.minutes * 60), run.hertz / 2, bins)


def _with_factor(row: DataFrame, run: Run) -> DataFrame:
    u, zl, z = F.col("wind_speed"), F.col("z_l"), run.height - run.displacement
    if run.high_frequency == "horst_97":
        return row.withColumn("factor", correction.horst_97(u, run.sensor_tau, z, zl))
    if run.high_frequency == "massman_00":
        return row.withColumn("factor", correction.massman_00(u, z, zl, run.sensor_tau, run.minutes, run.detrend))
    if run.high_frequency == "ibrom_07":
        return row.withColumn("factor", correction.ibrom_07(*run.ibrom, u, F.lit(run.cutoff)))
    xp = correction.Arrays

    def model(f, u, zl):
        return correction.model_cospectrum(f * z / u, f, zl, xp=xp)

    def transfer(f, u, zl):
        return correction.first_order(f, run.sensor_tau, xp) * correction.high_pass(f, run.detrend, run.minutes, run.hertz, run.time_constant, xp)

    return row.withColumn("factor", correction.analytic_factor(F.when(u > 0, u), zl, model, transfer))
