"""Fixed values that results depend on.

These are behavioural constants of the analysis (thresholds, labels, offsets)
and must stay exactly as listed for results to agree with the original tool.
"""

# --- fixed values -----------------------------------------------------------
PEAK_HOURS = (7, 8, 9, 16, 17, 18)          # hours counted as peak
MORNING_PEAK = (7, 9)                        # inclusive hour range, label below
EVENING_PEAK = (16, 18)                      # inclusive hour range, label below
PERIOD_LABELS = ("Morning Peak", "Evening Peak", "Off-Peak")
WEEKEND_DAYS = (5, 6)                        # Monday = 0
MIN_SAMPLE = 5                               # fewer history rows -> no prediction
MIN_RECENT = 3                               # fewer recent rows -> no correction
RECENT_WINDOW_MINUTES = 60
CONFIDENCE = 0.95
RELIABILITY_WEIGHTS = (0.4, 0.4, 0.2)        # sample size, CI width, conditions
RELIABILITY_SAMPLE_SATURATION = 30
PEAK_FACTOR = 0.8
MATCH_DAY_FACTOR = 0.9
SAMPLE_ROWS = 300_000                        # newest rows kept in sample mode

# Delay histogram bins: (label, lower exclusive, upper inclusive); None = open.
DELAY_BINS = (
    ("0-60s", None, 60),
    ("60-120s", 60, 120),
    ("120-180s", 120, 180),
    ("180-300s", 180, 300),
    (">300s", 300, None),
)

# Marker colour by mean delay in seconds (upper inclusive); above all: darkred.
DELAY_COLORS = ((60, "green"), (120, "yellow"), (180, "orange"), (300, "red"))
DELAY_COLOR_ABOVE = "darkred"

# Comparison days around a match (label, day offset).
COMPARISON_OFFSETS = (
    ("Match Day", 0),
    ("Day Before", -1),
    ("Day After", 1),
    ("Week Before", -7),
    ("Week After", 7),
)

# Hour windows around kickoff hour h: (label, start offset, end offset),
# rows count when h+start <= hour < h+end.
MATCH_WINDOWS = (
    ("3 hours before", -3, 0),
    ("2 hours before", -2, 0),
    ("1 hour before", -1, 0),
    ("1 hour after", 0, 1),
    ("2 hours after", 0, 2),
    ("3 hours after", 0, 3),
)
MATCH_TIME_RADIUS_HOURS = 2                  # kickoff hour +- 2, inclusive
RECOMMEND_RATIO = 1.2                        # match mean above 1.2 x regular
DAY_TYPE_EVENT = ("Match Days", "Regular Days")
DAY_TYPE_MATCH = ("Match Day", "Regular Day")

KMEANS_K = 3
KMEANS_SEED = 42

# Recommendation texts (fixed values); {start}/{end} are kickoff hour -1/+1.
RECOMMEND_CAPACITY = "Consider additional public transport capacity {start}:00 - {end}:00"
RECOMMEND_SIGNALS = "Review traffic light timing during peak impact hours"
RECOMMEND_OFFICERS = "Deploy additional traffic officers at key intersections"
RECOMMEND_PARKING = "Consider temporary parking restrictions in residential areas"
RECOMMEND_ADEQUATE = "Current traffic management measures appear adequate for this type of match"
IMPACT_NORMAL = "Normal traffic"
IMPACT_ABOVE = "Above normal"
DEFAULT_OPPONENT = "TBD"
HOME_TEAM = "Sparta Praha"
