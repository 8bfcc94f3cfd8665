"""Values the results depend on, in one place.

Everything in this module is a fixed value: thresholds, labels, messages and
formats that have to be exactly these for the results to be right.
"""

from __future__ import annotations

# --- column names -----------------------------------------------------------

STATION = "station"
TS = "ts"
DATE = "date"
POLLEN = ("pollen_a", "pollen_b")
WEATHER = ("temperature", "precipitation", "wind")
MEASURES = POLLEN + WEATHER

# Source variable name -> canonical column name.
SOURCE_NAMES = {
    "time": "ts",
    "birch_pollen": "pollen_a",
    "grass_pollen": "pollen_b",
    "temperature_2m": "temperature",
    "precipitation": "precipitation",
    "wind_speed_10m": "wind",
}
PAYLOAD_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"

# --- risk -------------------------------------------------------------------

LOW_MAX = 30.0        # up to here: class 0
MODERATE_MAX = 80.0   # up to here: class 1, above: class 2
LOW_LABEL = "Faible"
RISK_LABEL = "À risque"
CLASS3_LABELS = ("Faible", "Modéré", "Élevé")
PROFILES = (
    ("Peu sensible 😊", 0.70),
    ("Sensibilité normale 😐", 0.50),
    ("Très sensible 😰", 0.30),
)
DEFAULT_THRESHOLD = 0.5

# --- calendar ---------------------------------------------------------------

YEAR_LENGTH = 365     # also in leap years
MONTHS_PER_YEAR = 12
WEEKDAYS_FR = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")
MONTHS_FR = (
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août",
    "Septembre", "Octobre", "Novembre", "Décembre",
)
# In-season months of each taxon (first, last).
SEASON_MONTHS = {"pollen_a": (3, 7), "pollen_b": (5, 9)}

# --- features ---------------------------------------------------------------

GDD_BASE = 5.0
WEATHER_FEATURES = (
    "doy_sin", "doy_cos", "month_sin", "month_cos", "season", "year",
    "temp_lag1", "temp_roll7", "gdd_cumul",
    "precip_lag1", "precip_lag2", "precip_roll7",
    "wind_lag1", "wind_roll7",
)
FEATURES = WEATHER_FEATURES + (
    "pollen_a_lag1", "pollen_a_lag2", "pollen_a_lag3", "pollen_a_mean3",
    "pollen_b_lag1", "pollen_b_lag2", "pollen_b_lag3", "pollen_b_mean3",
)

# --- indicators -------------------------------------------------------------

TAXON_A_NAME = "🌳 Bouleau"
TAXON_B_NAME = "🌾 Graminées"
TIE_NAME = "Égalité"
WIND_REFERENCE = 50.0
WIND_MESSAGES = (
    (4.0, "Air calme — pollen concentré localement"),
    (7.0, "Vent modéré — pollen dispersé sur plusieurs km"),
    (None, "Vent fort — pollen transporté très loin"),
)
WASHOUT_DAYS = 3
WASHOUT_REFERENCE = 15.0
WASHOUT_MESSAGES = (
    (20, "Air sec — pollen non lavé"),
    (60, "Lessivage partiel de l'atmosphère"),
    (None, "Pluie récente — air bien nettoyé ✨"),
)
HEAT_TARGET = 300
HEAT_REACHED = "Seuil bouleau (300°C·j) atteint — floraison active"
HEAT_REMAINING = "°C·j avant le seuil de floraison"  # after the number of degree days
PROGRESS_BANDS = (60, 85)
PROGRESS_PAST_PEAK = 65
PROGRESS_MESSAGES = ("Saison en cours", "Le plus dur est passé 🎉")
ANOMALY_WINDOW = 7
ANOMALY_NORMAL = 15
ANOMALY_MESSAGES = (
    "Dans la normale saisonnière",
    ("Saison +", "% au-dessus de la normale"),  # around the number, which has its own minus
    ("Saison ", "% en dessous de la normale"),
)
SEASON_START_LEVEL = 10.0
SHIFT_USUAL = 3
SHIFT_MESSAGES = (
    " jours d'avance sur la moyenne",  # after the number of days
    " jours de retard sur la moyenne",
    "Démarrage dans les temps habituels",
)
INSUFFICIENT = "Données insuffisantes"
PEAK_BAND = 20
TREND_DAYS = 30
OVERLAY_WINDOW = 30

# --- scoring ----------------------------------------------------------------

SCORE_DAYS = 20       # days of history loaded for one scored date
HORIZON_DAYS = 25     # days of archive loaded before the forecast days
HORIZONS = (1, 2, 3)
BULLETIN_DAYS = 120
FEATURE_LOOKBACK = 7  # longest lookback of a windowed feature, in days
SOURCE_API = "api"
SOURCE_FORECAST = "forecast"
SOURCE_CACHE = "cache"

# (label of taxon A, label of taxon B, message).
ADVICE = (
    ("Faible", "Faible",
     "Bonne nouvelle ! Les deux types de pollen sont à des niveaux bas. "
     "Profitez de l'extérieur en toute tranquillité."),
    ("Faible", "À risque",
     "Prudence avec les graminées. Évitez les pelouses entre 12h–17h "
     "et pensez à votre traitement si vous êtes allergique."),
    ("À risque", "Faible",
     "Le bouleau est actif aujourd'hui. Gardez les fenêtres fermées, "
     "prenez votre traitement le matin et préférez sortir tôt ou en soirée."),
    ("À risque", "À risque",
     "Journée difficile pour les allergiques ! Prenez votre traitement dès le matin, "
     "gardez les fenêtres fermées et limitez les sorties entre 10h et 18h."),
)
HOURS_ALL_DAY = "Toute la journée"
HOURS_GOOD = "Avant 9h · Après 19h"
HOURS_AVOID = "10h – 18h"
# (horizon in days, when, reliability).
HORIZON_TEXT = (
    (1, "Demain", "⭐⭐⭐ Très fiable"),
    (2, "Dans 2 jours", "⭐⭐ Fiable"),
    (3, "Dans 3 jours", "⭐ Estimation"),
)

# --- model selection --------------------------------------------------------

TRAIN_LAST_YEAR = 2024
FOLDS = 5
SEED = 42
# Hyperparameter grid, in the order in which ties are resolved. A depth of
# None means unlimited.
GRID = {
    "logistic": {"c": (0.1, 1.0, 10.0)},
    "tree": {"max_depth": (5, 10, None)},
    "forest": {"max_depth": (3, 5, 10, None), "min_leaf": (1, 5, 10), "trees": (100, 200)},
    "boosted": {"rate": (0.05, 0.1), "max_depth": (5, 10), "rounds": (100, 200)},
}
LOGISTIC_MAX_ITER = 1000
