"""Fixed values. They must stay as they are for results to agree with published ones."""

# --- sampling, filter, detector ---
FS_HZ = 1000
BAND_LOW_HZ, BAND_HIGH_HZ, BAND_ORDER = 0.5, 150.0, 2
REFRACTORY_MS = 55
MAD_HEIGHT, MAD_PROMINENCE, MIN_PROMINENCE_MV = 4.0, 0.3, 0.005
NEAR_FLOOR_MS = 65.0
PRE_R_MS, POST_R_MS = 100, 150
BEATS_PER_AVERAGE = 4

# --- acceptance gates ---
HR_ACCEPT = (300.0, 700.0)
MIN_PEAKS = 10
MAX_MEDIAN_ABS = 50.0
MIN_SEGMENT_S = 2
RR_CV_CLEAN = 0.15
T_EXCURSION_MIN_MV = 0.005

# --- annotation window search ---
GAP_MIN_S, GAP_MAX_S = 10, 120
GAP_MAX_LONG_S, LONG_USE_S = 900, 60
SINGLE_USE_S = 30
EXCLUDED_WORDS = ("oc 1", "oc 2", "oc1", "oc2", "jugular", "jugcan", "injection", "inject")
END_WORDS = ("end", "done", "stop")
START_WORDS = ("baseline", "ecg", "start")
BASELINE_WORD, BASELINE_TYPO = "baseline", "basline"
MARKER_PREFIXES = ("*", "1", "2", "3")
MARKER_PATTERN = r"#([*1-3])"

# --- quality window search ---
QUALITY_WIDTH_S, QUALITY_STEP_S, QUALITY_REACH_S = 15, 5, 90
QUALITY_HR = (350.0, 700.0)
QUALITY_RR_STD_MAX = 120.0
QUALITY_MIN_BEATS = 10
QUALITY_PASS_RATE, QUALITY_PERCENTILE = 0.30, 0.75

# --- recovery sweeps ---
RR_KEEP_MS = (60000.0 / 700.0, 60000.0 / 300.0)
RECOVERY_MIN_COUNT = 5

# --- waves, in ms relative to R: (name, first, last, sign) ---
PIPELINE_WAVES = (
    ("P", -70, -35, 1),
    ("Q", -14, -2, -1),
    ("S", 8, 32, -1),
    ("J", 10, 30, 1),
    ("T", 40, 80, 1),
)
GALLERY_WAVES = (
    ("P", -70, -35, 1),
    ("Q", -14, -2, -1),
    ("S", 0, 8, -1),
    ("J", 4, 16, 1),
    ("T", 14, 30, -1),
)

# --- study design ---
GROUPS = ("Control", "Dox", "Dox+Etn1.6", "Dox+Etn16", "Dox+Etn160")
ETN_DOSES = (1.6, 16.0, 160.0)
DOSE_BY_GROUP = {"Control": 0.0, "Dox": 0.0, "Dox+Etn1.6": 1.6, "Dox+Etn16": 16.0, "Dox+Etn160": 160.0}

# --- feature table ---
FEATURE_COLUMNS = (
    "animal_id", "recording_date", "study_guess", "source_file", "status", "n_beats", "heart_rate_bpm",
    "rr_mean_ms", "rr_std_ms", "median_rr_ms", "pct_near_floor", "r_amplitude_mv", "qrs_duration_ms",
    "j_wave_amplitude_mv", "t_wave_amplitude_mv", "t_wave_excursion_mv", "rt_interval_ms", "qt_ms", "qtc_ms",
    "qt_std_ms", "qrs_std_ms", "r_amplitude_std_mv", "p_wave_amplitude_mv", "pr_interval_ms",
    "q_wave_amplitude_mv", "s_wave_amplitude_mv", "qtc_formula",
)
TESTED_PARAMETERS = (
    "heart_rate_bpm", "rr_mean_ms", "qt_ms", "qtc_ms", "qrs_duration_ms", "r_amplitude_mv",
    "p_wave_amplitude_mv", "q_wave_amplitude_mv", "s_wave_amplitude_mv", "t_wave_amplitude_mv",
    "j_wave_amplitude_mv",
)
CLUSTER_FEATURES = (
    "heart_rate_bpm", "rr_mean_ms", "rr_std_ms", "r_amplitude_mv", "qrs_duration_ms", "j_wave_amplitude_mv",
    "t_wave_amplitude_mv", "qt_ms", "qtc_ms", "rt_interval_ms", "qt_std_ms", "qrs_std_ms",
    "r_amplitude_std_mv", "rr_cv",
)
CAUSE_FLAGS = ("beats_detected", "rhythm_regular", "twave_isolated", "enough_beats_for_sd")

# Shape and rate of the Gamma priors on precisions.
WEAK_GAMMA = (0.01, 0.01)

# The heart rates that the template study accepts.
TEMPLATE_HR = (300, 700)

# The recordings of the validation gallery.
GALLERY = (211, 206, 239, 247, 208, 218, 248, 142, 230, 136)
