"""Parcel scores: criteria, three axes, global score, ranking and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glebe.functions import scoring as points

# Default weight of each axis, and of each criterion within its axis.
DEFAULT_WEIGHTS = {"economique": 0.35, "eau": 0.35, "topographie": 0.30}
AXIS_CRITERIA = {
    "economique": {"prix_achat": 0.4, "distance_marche": 0.35, "acces_vehicule": 0.25},
    "eau": {"acces_eau": 0.6, "precipitation": 0.4},
    "topographie": {"pente": 0.3, "exposition": 0.25, "risque_gel": 0.25, "altitude": 0.2},
}
AXIS_LABELS = {"economique": "Économique", "eau": "Eau", "topographie": "Topographie"}
AXIS_TITLES = {
    "economique": "Économique & Logistique",
    "eau": "Eau & Irrigation",
    "topographie": "Topographie & Exposition",
}

# Rows of either side that meet under one key of the scenario join; the number of keys follows from the counts.
SCENARIO_BLOCK = 2000
SCENARIO = T.StructType([
    T.StructField("scenario", T.StringType(), False),
    *(T.StructField(f"poids_{axis}", T.DoubleType(), False) for axis in DEFAULT_WEIGHTS),
])


def criterion(name: str) -> Column:
    return F.col(f"critere_{name}")


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights of the three axes; their sum must be 1 within 0.01."""
    total = sum(weights[axis] for axis in DEFAULT_WEIGHTS)
    if not 0.99 <= total <= 1.01:
        raise ValueError(f"weights must sum to 1.0, not {total:.2f}")
    return weights


def normalized_weights(raw: dict[str, float]) -> dict[str, float]:
    """Slider values of any sum as shares of 1."""
    total = sum(raw.values())
    return {axis: value / total for axis, value in raw.items()}


def _weighted(parts: list[tuple[Column, Column | float]]) -> Column:
    """Sum of value times weight in the given order, in doubles, truncated to whole points."""
    total = None
    for value, weight in parts:
        term = value.cast("double") * (weight if isinstance(weight, Column) else F.lit(float(weight)))
        total = term if total is None else total + term
    return total.cast("int")


def score_axes(parcels: DataFrame, price_basis: str = "total", clamp_price: bool = False) -> DataFrame:
    """Add the nine reported criteria and the three axis scores.

    ``price_basis`` "total" compares the whole asked price with the price per hectare, as it is declared;
    "per_ha" divides it by the area first. Missing inputs score as the criteria define.
    """
    if price_basis not in ("total", "per_ha"):
        raise ValueError(f"unknown price basis {price_basis!r}")
    p = F.col
    asked = p("prix_achat") if price_basis == "total" else F.try_divide(p("prix_achat"), p("surface_ha"))
    access = points.water_access_score(p("acces_eau")) + points.flow_adjustment(p("debit_estime_m3h"), p("acces_eau"))
    criteria = {
        "prix_achat": points.price_score(asked, p("prix_comparable_eur_ha"), clamp_price),
        "distance_marche": points.market_distance_score(p("distance_marche_km")),
        "acces_vehicule": points.vehicle_access_score(p("acces_vehicule")),
        "acces_eau": F.greatest(F.lit(0), F.least(F.lit(100), access)),
        "precipitation": points.rain_score(p("meteo_precip_annuelle_mm")),
        "pente": points.slope_score(p("pente_pct")),
        "exposition": points.aspect_score(p("exposition")),
        "risque_gel": points.frost_score(p("risque_gel_tardif"), p("meteo_jours_gel")),
        "altitude": points.altitude_score(p("altitude_m")),
    }
    scored = parcels.withColumns({f"critere_{name}": c for name, c in criteria.items()})
    return scored.withColumns({
        f"score_{axis}": _weighted([(criterion(name), w) for name, w in members.items()])
        for axis, members in AXIS_CRITERIA.items()
    })


def _global(weights: dict[str, Column | float]) -> Column:
    return _weighted([(F.col(f"score_{axis}"), weights[axis]) for axis in DEFAULT_WEIGHTS])


def score_parcels(parcels: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """Parcels with criteria, axis scores and ``score_global`` at one set of weights."""
    weights = check_weights(weights or DEFAULT_WEIGHTS)
    return score_axes(parcels, **options).withColumn("score_global", _global(weights))


def score_scenarios(parcels: DataFrame, scenarios: dict[str, dict[str, float]] | DataFrame, **options) -> DataFrame:
    """Every parcel under every weighting: ``scenario``, its weights and ``score_global``.

    Scenarios are a dict of weightings or a table (scenario, poids_economique, poids_eau,
    poids_topographie) of any length; a sum off 1 stops the query.
    """
    return under_scenarios(score_axes(parcels, **options), scenarios, parcels.columns)


def under_scenarios(scored: DataFrame, scenarios: dict[str, dict[str, float]] | DataFrame,
                    own: list[str] | None = None) -> DataFrame:
    """``score_scenarios`` of rows that have their axis scores; ``own`` names the columns that tell rows apart.

    A table is joined on salted keys, a block of some ``SCENARIO_BLOCK`` rows of either side to a key, so the keys grow
    with the product, and a row is copied once for each block of scenarios. Both sides are counted first, as subqueries
    of the same plan. The blocks are dealt to all tasks before they meet, however few files hold the rows, and no side is
    broadcast, as its copies grow with the other. Further columns of the table are kept.
    """
    if isinstance(scenarios, DataFrame):
        names = SCENARIO.fieldNames()
        more = [c for c in scenarios.columns if c not in names]
        rows = scenarios.select(*(F.col(f.name).cast(f.dataType) for f in SCENARIO), *more)
        total = sum((F.col(f"poids_{axis}") for axis in DEFAULT_WEIGHTS), F.lit(0.0))
        checked = F.when(total.between(0.99, 1.01), F.struct(*names, *more)).otherwise(
            F.raise_error(F.lit("weights must sum to 1.0")))
        def blocks(side: DataFrame) -> Column:
            return side.agg(F.greatest(F.ceil(F.count(F.lit(1)) / SCENARIO_BLOCK), F.lit(1))).scalar()

        def all_of(count: Column) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))

        # Salts come from the rows alone, so that a task that runs again deals its rows alike.
        dealt = rows.select(checked.alias("_s"), F.pmod(F.xxhash64(*names), blocks(rows)).alias("_i"),
                            all_of(blocks(scored)).alias("_j"))
        tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = scored.withColumn("_j", F.pmod(F.xxhash64(*(own or scored.columns)), blocks(scored))).withColumn(
            "_i", all_of(blocks(rows))).repartition(tasks, "_i", "_j").join(dealt.hint("merge"), ["_i", "_j"])
    else:
        rows = [
            F.struct(F.lit(name).alias("scenario"),
                     *(F.lit(float(check_weights(w)[axis])).alias(f"poids_{axis}") for axis in DEFAULT_WEIGHTS))
            for name, w in scenarios.items()
        ]
        spread = scored.withColumn("_s", F.explode(F.array(*rows)))
    spread = spread.select(*scored.columns, "_s.*")
    return spread.withColumn("score_global", _global({axis: F.col(f"poids_{axis}") for axis in DEFAULT_WEIGHTS}))


def scenario_totals(parcels: DataFrame, scenarios: DataFrame, **options) -> DataFrame:
    """``score_scenarios`` of a table summed up: every parcel with ``n_scenarios``, and the ``total``, ``lowest`` and
    ``highest`` of its ``score_global`` over all of them.

    The global score follows from the three axis scores and the three weights, nothing else. So each combination of axis
    scores, which are whole points, meets each combination of weights once, with the number of scenarios that have it;
    parcels then look up their combination. No weight or score is left out, and where none occurs twice every pair is
    scored, in blocks.
    """
    scored = score_axes(parcels, **options)
    axes, weights = ([f"{kind}_{axis}" for axis in DEFAULT_WEIGHTS] for kind in ("score", "poids"))
    weightings = scenarios.groupBy(*weights).agg(F.min("scenario").alias("scenario"), F.count(F.lit(1)).alias("_n"))
    each = under_scenarios(scored.select(*axes).distinct(), weightings)
    totals = each.groupBy(*axes).agg(
        F.sum("_n").alias("n_scenarios"), F.sum(F.col("score_global") * F.col("_n")).alias("total"),
        F.min("score_global").alias("lowest"), F.max("score_global").alias("highest"))
    totals = totals.withColumnsRenamed({axis: f"_{axis}" for axis in axes})
    same = [F.col(axis).eqNullSafe(F.col(f"_{axis}")) for axis in axes]
    return scored.join(totals, same).drop(*(f"_{axis}" for axis in axes))


def order_by_score(scored: DataFrame) -> DataFrame:
    """Best parcels first; equal scores by id."""
    return scored.orderBy(F.col("score_global").desc_nulls_last(), "id")


def rank_scores(scored: DataFrame, by: list[str] | None = None, score: str = "score_global") -> DataFrame:
    """Add ``rang``: 1 + the number of better parcels, over all or per scenario.

    Scores are whole points, so parcels are counted per score and only those few counts are ordered.
    """
    by = by or []
    counts = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(score).isNotNull())
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    better = (
        Window.partitionBy(*(by or ["_all"])).orderBy(F.col(score).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = counts.select(*by, score, (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).cast("int").alias("rang"))
    return scored.join(ranks, [*by, score], "left").select(*scored.columns, "rang")


def choose(parcels: DataFrame, chosen: DataFrame | list[str]) -> DataFrame:
    """The parcels with a chosen id, in id order."""
    if isinstance(chosen, DataFrame):
        kept = parcels.join(chosen.select("id").distinct(), "id", "left_semi")
    else:
        kept = parcels.filter(F.col("id").isin(*chosen))
    return kept.orderBy("id")


def summary_table(scored: DataFrame) -> DataFrame:
    """Side-by-side table under display names, best first."""
    return order_by_score(scored).select(
        F.col("nom").alias("Parcelle"), F.col("id").alias("ID"), F.col("score_global").alias("Score global"),
        F.col("score_economique").alias("Éco (35%)"), F.col("score_eau").alias("Eau (35%)"),
        F.col("score_topographie").alias("Topo (30%)"),
    )


def axis_rows(scored: DataFrame) -> DataFrame:
    """Long form: id, nom, axe, score."""
    pairs = [F.struct(F.lit(label).alias("axe"), F.col(f"score_{axis}").alias("score"))
             for axis, label in AXIS_LABELS.items()]
    return scored.select("id", "nom", F.inline(F.array(*pairs)))


def axis_table(scored: DataFrame, names: list[str]) -> DataFrame:
    """Wide form: one row per axis, one column per named parcel (a handful, as on a comparison page)."""
    wide = axis_rows(scored).filter(F.col("nom").isin(*names))
    return wide.groupBy(F.col("axe").alias("Axe")).pivot("nom", names).agg(F.max("score"))


def criteria_rows(scored: DataFrame, style: str = "title") -> DataFrame:
    """One row per parcel and criterion: axis, label, score and mention.

    Labels as on the comparison page ("title") or as in the report ("sentence").
    """
    rows = []
    for axis, members in AXIS_CRITERIA.items():
        for name in members:
            words = name.replace("_", " ")
            rows.append(F.struct(
                F.lit(AXIS_LABELS[axis]).alias("axe"),
                F.lit(words.title() if style == "title" else words.capitalize()).alias("critere"),
                criterion(name).alias("score"),
            ))
    return scored.select("id", "nom", F.inline(F.array(*rows))).withColumn("mention", points.mention(F.col("score")))


def best_per_axis(scored: DataFrame) -> DataFrame:
    """Per axis the parcel with the highest score; ties go to the smallest id."""
    return axis_rows(scored).groupBy("axe").agg(
        F.max("score").alias("score"),
        F.min(F.struct((-F.col("score")).alias("s"), "id", "nom")).alias("_best"),
    ).select("axe", F.col("_best.id").alias("id"), F.col("_best.nom").alias("nom"), "score")


def with_verdict(scored: DataFrame) -> DataFrame:
    """Add the mention of the global score and whether the parcel is recommended (70 and above)."""
    return scored.withColumn("mention", points.mention(F.col("score_global"))).withColumn(
        "recommandee", points.recommended(F.col("score_global")))


def report_rows(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One nested row per parcel for a report: identity, scores with criteria, characteristics, notes."""
    weights = check_weights(weights or DEFAULT_WEIGHTS)

    def axis(name: str) -> Column:
        members = [x for c in AXIS_CRITERIA[name] for x in (F.lit(c), criterion(c))]
        return F.struct(
            F.lit(AXIS_TITLES[name]).alias("nom"),
            F.col(f"score_{name}").alias("score"),
            F.lit(float(weights[name])).alias("poids"),
            points.mention(F.col(f"score_{name}")).alias("mention"),
            F.create_map(*members).alias("criteres"),
        )

    # Fields of each report section.
    sections = {
        "identite": ["surface_ha", "commune", "departement", "lat", "lon", "prix_achat", "prix_location_annuel",
                     "prix_comparable_eur_ha", "acces_vehicule"],
        "eau": ["acces_eau", "debit_estime_m3h", "distance_cours_eau_m", "forages_brgm_count"],
        "topographie": ["pente_pct", "exposition", "altitude_m", "risque_gel_tardif"],
        "meteo": ["meteo_precip_annuelle_mm", "meteo_jours_gel", "meteo_etp_annuelle_mm"],
        "logistique": ["acces_vehicule", "distance_marche_km", "distance_agglo_km"],
    }
    return scored.select(
        "id", "nom", "score_global", points.mention(F.col("score_global")).alias("mention"),
        F.struct(*sections["identite"]).alias("identite"),
        F.array(*(axis(name) for name in DEFAULT_WEIGHTS)).alias("axes"),
        F.struct(*(F.struct(*fields).alias(name) for name, fields in sections.items() if name != "identite"))
        .alias("caracteristiques"),
        "notes",
    )
