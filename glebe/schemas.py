"""Target schemas, header aliases and code lists of the landed sources."""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, DOUBLE, STRING, DATE = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.DateType()


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Measures both weather sources share.
# Names and order of measures and columns, here and in the tables below.
SHARED_MEASURES = (
    "temperature_2m_max",
    "temperature_2m_min",
    "temperature_2m_mean",
    "precipitation_sum",
    "et0_fao_evapotranspiration",
    "wind_speed_10m_max",
)
GRID_MEASURES = (*SHARED_MEASURES, "shortwave_radiation_sum")

WEATHER_DAILY = struct(
    ("date", DATE), ("latitude", DOUBLE), ("longitude", DOUBLE), *((m, DOUBLE) for m in GRID_MEASURES)
)

# Station field -> (measure, factor from raw unit to project unit).
STATION_FIELDS = {
    "TX": ("temperature_2m_max", 0.1),
    "TN": ("temperature_2m_min", 0.1),
    "TM": ("temperature_2m_mean", 0.1),
    "RR": ("precipitation_sum", 0.1),
    "FFM": ("wind_speed_10m_max", 0.36),
    "ETP": ("et0_fao_evapotranspiration", 0.1),
    "INST": ("sunshine_duration_min", 1.0),
}
STATION_MISSING = -9999.0

STATION_DAILY = struct(
    ("date", DATE),
    ("latitude", DOUBLE),
    ("longitude", DOUBLE),
    *((measure, DOUBLE) for measure, _ in STATION_FIELDS.values()),
)

PRICE_QUOTES = struct(
    ("annee", INT), ("semaine", INT), ("date", STRING), ("produit", STRING), ("marche", STRING),
    ("stade", STRING), ("categorie", STRING), ("calibre", STRING), ("variete", STRING),
    ("origine", STRING), ("unite", STRING), ("prix_min", DOUBLE), ("prix_max", DOUBLE),
    ("prix_moyen", DOUBLE),
)

# Accepted header names per target column of the price quotes.
PRICE_QUOTE_ALIASES = {
    "date": ["date_cotation", "DateDebut", "date_debut", "date", "Date", "Semaine", "date cotation"],
    "annee": ["annee", "Annee", "année", "year"],
    "semaine": ["semaine", "Semaine", "num_semaine", "week"],
    "produit": ["produit_libelle", "produit", "Produit", "libelle_produit", "Libelle_Produit"],
    "marche": ["marche_libelle", "marche", "Marche", "libelle_marche", "Libelle_Marche", "marché"],
    "stade": ["stade_libelle", "stade", "Stade"],
    "categorie": ["categorie", "Categorie", "catégorie", "code produit"],
    "calibre": ["calibre", "Calibre"],
    "variete": ["variete", "Variete", "variété"],
    "origine": ["origine", "Origine"],
    "unite": ["unite", "Unite", "unité", "Unité"],
    "prix_min": ["prix_min", "Prix Min", "PrixMin", "prix min", "min", "valeur en euro(s)"],
    "prix_max": ["prix_max", "Prix Max", "PrixMax", "prix max", "max", "valeur en euro(s)"],
    "prix_moyen": ["prix_moyen", "Prix Moyen", "PrixMoyen", "prix moyen", "moyen", "Moyen", "valeur en euro(s)"],
}

# Cell texts that stand for a missing quote value.
QUOTE_NULL_TOKENS = ["", "NA", "N/A", "-", "nd", "ND"]

LAND_SALES = struct(
    ("annee", INT), ("trimestre", INT), ("date_mutation", STRING), ("valeur_fonciere", DOUBLE),
    ("code_departement", STRING), ("code_commune", STRING), ("code_postal", STRING),
    ("type_local", STRING), ("surface_reelle_bati", DOUBLE), ("nombre_pieces_principales", INT),
    ("longitude", DOUBLE), ("latitude", DOUBLE), ("id_parcelle", STRING), ("nature_mutation", STRING),
    ("numero_voie", STRING), ("nom_voie", STRING), ("surface_terrain", DOUBLE),
)

# Accepted header names per target column of the land sales.
LAND_SALE_ALIASES = {
    "date_mutation": ["date_mutation", "DATE_MUTATION", "date mutation", "date"],
    "valeur_fonciere": ["valeur_fonciere", "VALEUR_FONCIERE", "valeur fonciere", "valeur"],
    "code_departement": ["code_departement", "CODE_DEPARTEMENT", "departement", "code_dept"],
    "code_commune": ["code_commune", "CODE_COMMUNE", "commune"],
    "code_postal": ["code_postal", "CODE_POSTAL", "postal"],
    "type_local": ["type_local", "TYPE_LOCAL"],
    "surface_reelle_bati": ["surface_reelle_bati", "SURFACE_REELLE_BATI", "surface_bati", "surface_reelle"],
    "nombre_pieces_principales": ["nombre_pieces_principales", "NOMBRE_PIECES_PRINCIPALES", "nombre_pieces"],
    "longitude": ["longitude", "LONGITUDE", "lon"],
    "latitude": ["latitude", "LATITUDE", "lat"],
    "id_parcelle": ["id_parcelle", "ID_PARCELLE", "id_parcel"],
    "nature_mutation": ["nature_mutation", "NATURE_MUTATION", "nature"],
    "numero_voie": ["numero_voie", "NUMERO_VOIE"],
    "nom_voie": ["nom_voie", "NOM_VOIE"],
    "surface_terrain": ["surface_terrain"],
}

CROP_PARCELS = struct(
    ("id_parcel", STRING), ("code_culture", STRING), ("surface_ha", DOUBLE),
    ("libelle_culture", STRING), ("geometry_wkt", STRING),
)

# Crop code -> label.
CROP_LABELS = {
    "1": "Blé tendre", "2": "Blé dur", "3": "Orge", "4": "Autres céréales", "5": "Maïs", "6": "Oléagineux",
    "7": "Protéagineux", "8": "Légumineuses", "11": "Prairies permanentes", "12": "Prairies temporaires",
    "13": "Estives et landes", "14": "Gel", "15": "Légumes ou fleurs", "16": "Arboriculture",
    "17": "Viticulture", "18": "Vergers", "19": "Fruits à coque", "20": "Cultures industrielles",
    "23": "Chanvre", "24": "Lin", "25": "Divers", "28": "Semences",
}
UNKNOWN_CROP = "Inconnu"

WELLS = struct(
    ("code_bss", STRING), ("bss_id", STRING), ("libelle_pe", STRING), ("nom_commune", STRING),
    ("code_commune_insee", STRING), ("code_departement", STRING), ("nom_departement", STRING),
    ("longitude", DOUBLE), ("latitude", DOUBLE), ("altitude_station", DOUBLE),
    ("profondeur_investigation", DOUBLE), ("date_debut_mesure", STRING), ("date_fin_mesure", STRING),
    ("nb_mesures_piezo", LONG), ("code_bdlisa", STRING), ("nom_masse_eau", STRING), ("distance_km", DOUBLE),
)

GROUNDWATER = struct(
    ("code_bss", STRING), ("date_mesure", DATE), ("profondeur_nappe", DOUBLE), ("niveau_eau_ngf", DOUBLE),
    ("mode_obtention", STRING), ("qualification", STRING), ("code_qualification", LONG),
)

# Columns of the work log.
WORK_LOG_FIELDS = ("id", "date", "debut", "fin", "duree_h", "poste", "notes", "source")
WORK_HOURS = struct(
    ("id", STRING), ("date", DATE), ("debut", STRING), ("fin", STRING), ("duree_h", DOUBLE),
    ("poste", STRING), ("notes", STRING), ("source", STRING),
    ("annee", INT), ("mois", INT), ("semaine", INT), ("jour_semaine", INT),
)

# French weekday name -> days after Monday.
WEEKDAYS = {"lundi": 0, "mardi": 1, "mercredi": 2, "jeudi": 3, "vendredi": 4, "samedi": 5, "dimanche": 6}

# Month number -> short French label.
MONTH_LABELS = {
    1: "Jan", 2: "Fév", 3: "Mar", 4: "Avr", 5: "Mai", 6: "Jun",
    7: "Jul", 8: "Aoû", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Déc",
}

PARCELS = struct(
    ("id", STRING), ("nom", STRING), ("surface_ha", DOUBLE), ("commune", STRING), ("departement", STRING),
    ("lat", DOUBLE), ("lon", DOUBLE), ("prix_achat", DOUBLE), ("prix_location_annuel", DOUBLE),
    ("acces_eau", STRING), ("debit_estime_m3h", DOUBLE), ("distance_cours_eau_m", DOUBLE),
    ("pente_pct", DOUBLE), ("exposition", STRING), ("altitude_m", DOUBLE),
    ("risque_gel_tardif", T.BooleanType()), ("distance_marche_km", DOUBLE), ("distance_agglo_km", DOUBLE),
    ("acces_vehicule", STRING), ("notes", STRING), ("statut", STRING),
    ("date_creation", T.TimestampNTZType()), ("date_modification", T.TimestampNTZType()),
    ("meteo_precip_annuelle_mm", DOUBLE), ("meteo_jours_gel", INT), ("meteo_etp_annuelle_mm", DOUBLE),
    ("prix_comparable_eur_ha", DOUBLE), ("forages_brgm_count", INT),
)

# Parcel constraints and defaults.
PARCEL_REQUIRED = ("id", "nom", "surface_ha", "commune", "departement", "lat", "lon")
PARCEL_RANGES = {
    "surface_ha": (0.1, None),
    "prix_achat": (0.0, None),
    "prix_location_annuel": (0.0, None),
    "debit_estime_m3h": (0.0, None),
    "distance_cours_eau_m": (0.0, None),
    "pente_pct": (0.0, 100.0),
    "altitude_m": (-100.0, 3000.0),
    "distance_marche_km": (0.0, None),
    "distance_agglo_km": (0.0, None),
}
PARCEL_ENUMS = {
    "acces_eau": ("forage", "riviere", "reseau", "aucun", "inconnu"),
    "exposition": ("N", "NE", "E", "SE", "S", "SO", "O", "NO", "plat"),
    "acces_vehicule": ("facile", "limite", "difficile"),
    "statut": ("prospect", "visite", "evalue", "archive"),
}
PARCEL_DEFAULTS = {
    "acces_eau": "inconnu", "exposition": "plat", "acces_vehicule": "facile", "notes": "", "statut": "prospect",
}
