"""Model parameters.

Fixed values: they define the published numbers, so results only agree with
other producers of the same index when these stay as they are.
"""

BASELINE_RATING = 1500.0
HOME_ADVANTAGE = 65.0

# Settlement
SETTLE_K = 30.0
GRAVITY_V3 = 0.08
GRAVITY_CUP = 0.0
GRAVITY_V2 = 0.05
SURPRISE_EPS = 0.001
EXPECTED_SANE = (0.02, 0.98)
CUP_LEAGUE = "CUP"

# Market overlay
ALPHA = 0.40
W_NEXT = 0.15
OVERLAY_CLAMP = 120.0
SIGMA_CEILING = 900.0
BOOKS_FULL = 5
SPREAD_FULL = 0.08
RECENCY_HOURS = 48.0
HORIZON_DAYS = 21.0

# Windowed rating solve
SIGMA_PRIOR = 300.0
SIGMA_SPARSE = 200.0
WINDOW_DAYS = 30
WINDOW_EXPANDED_DAYS = 45
MIN_FIXTURES = 5
PAST_SCALE_DAYS = 14.0
AHEAD_SCALE_DAYS = 7.0
SOLVE_TOL = 0.01
SOLVE_MAX_ITER = 50
SOLVE_STEP_CLAMP = 100.0

# Daily panel
PANEL_WINDOW_DAYS = 60
PANEL_HALF_LIFE = 14.0
PANEL_PASSES = 50
PANEL_GAIN = 40.0
PRIOR_PULL = 0.15
CARRY_DECAY = 0.005
CARRY_FLOOR = 0.5
PRICE_SPREAD = 220.0
SHOCK_K_REACTIVE, SHOCK_HL_REACTIVE = 32.0, 7.0
SHOCK_K_ORACLE, SHOCK_HL_ORACLE = 20.0, 10.0
DRIFT_SCALE = 400.0
DRIFT_MIN_HOURS = 12.0
DRIFT_FADE_DAYS = 7.0
DRIFT_LOOKAHEAD_DAYS = 14
OUTRIGHT_WEIGHT = 0.15
EMA_SPAN = 5
EMPTY_HOME_RATE = 0.46
MODEL_WEIGHT = 0.7

# Off-season drift and feedback
FUTURES_OFFSET = (-200.0, 300.0)
FUTURES_PROB_FLOOR = 0.0001
FUTURES_FULL_VOLUME = 50_000.0
FUTURES_STALE_HOURS = 24.0
FUTURES_TOLERANCE_MINUTES = 2
DRIFT_LAMBDA = 0.02
DRIFT_CAP_PER_DAY = 5.0
DRIFT_MIN_VOLUME = 10_000.0
DRIFT_MIN_GAP_HOURS = 24.0
DRIFT_TRIVIAL = 0.01
REGIME_WEIGHTS = {"live": 0.15, "prematch": 0.10, "between": 0.05, "offseason": 0.05}
FEEDBACK_CLAMP = 20.0

# Live layer
FRESH_MINUTES = 3
LIVE_HOURS = 4
SYNTHETIC_ID_BASE = 9_000_000
SYNTHETIC_ID_RANGE = 1_000_000
