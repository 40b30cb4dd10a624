"""Fixed values. They define the results, so they are stated as they are."""

# Reading campaigns: label prefix, month and the day a reading is placed on.
SEASONS = ["JAN", "MAY", "AUG", "NOV"]
SEASON_MONTH = {"JAN": 1, "MAY": 5, "AUG": 8, "NOV": 11}
READING_DAY = 15

# Year blocks and split sizes.
TRAIN_YEARS = (2000, 2014)
VALID_YEARS = (2015, 2017)
TEST_YEARS = (2018, 2022)
DISTRICT_FOLDS = 5
SEED = 42

# Quality limits.
DEPTH_LIMITS = (-5.0, 200.0)      # exclusive
MIN_READINGS = 4
GAP_DAYS = (45, 400)              # inclusive
MAX_STEP = 30.0                   # inclusive

# Driver windows and thresholds.
TRAILING_DAYS = [30, 60, 90, 180, 365, 730]
SEQUENCE_WEEKS = 104
WET_MM = 2.5                      # at least
HEAVY_MM = 35.0                   # at least, interval features
HEAVY_DAY_MM = 64.5               # at least, day summary
SHOWN_DAY_MM = 0.6                # at least, cells listed in a day summary
MONSOON_MONTHS = [6, 7, 8, 9]
SMOOTH_DAYS = 31
ROLLING_MONTHS = [3, 6, 12, 24, 36]
MIN_CORNER_WEIGHT = 1e-6
QUANTUM = 33.0                    # log1p(mm) * 33 fits a byte

# Distances.
KM_PER_DEGREE = 110.6
EARTH_DIAMETER_KM = 12742.0
SEARCH_RADII_KM = [25, 50, 100, 150, 200, 300]
TOWN_CUTOFF_DEG = 0.1
MIN_TOWN_POPULATION = 5000

# Category tokens that mean "not recorded".
BLANK_TOKENS = ["-", "Not available", "", "nan", "None"]
AQUIFER_SOURCES = {"recorded": "cgwb", "inferred": "inferred_dug_well", "neither": "unknown"}
DUG_TYPES = ["Dug well", "Dug cum bore well"]
ROCK_CLASS = {
    0.018: "folded metasediments / sedimentary aquitard",
    0.020: "jointed crystalline",
    0.023: "fractured crystalline",
    0.043: "consolidated sedimentary, permeable",
    0.130: "unconsolidated sedimentary (alluvium)",
}

# Scenario and forecast.
WATERLOGGED_M = 2.0
SHIFTS_PCT = [-30, -20, -10, 0, 10, 20, 30]
RESPONSE_FACTORS = [0.5, 0.8, 1.2, 1.5]
WRONG_WAY_TOLERANCE = 1e-4
FIRST_REPLAY_YEAR = 2000
LAST_REPLAY_YEAR = 2022
SKILL_YEARS = 5
HISTORY_FROM = 2012

# Columns that may never be features.
FORBIDDEN = [
    "depth_start_m", "depth_mbgl", "normal_ref_m", "season_year", "year", "lat", "lon", "district", "state",
    "well_uid", "campaign_date", "prev_date", "split", "district_fold", "delta_h_m",
]
CATEGORICAL = ["season", "aquifer", "well_type", "transition"]
CHANNELS = ["rain_mm", "in_interval", "doy_sin", "doy_cos", "rain_anom_mm", "wet_frac"]
