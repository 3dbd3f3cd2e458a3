"""They must equal those of the field they come from for right results."""

#: Wave speeds by pipe material, m/s.
WAVE_SPEEDS = {
    "ductile_iron": 1400,
    "steel": 5000,
    "pvc": 450,
    "cast_iron": 3500,
    "concrete": 3700,
    "copper": 3560,
    "hdpe": 400,
    "asbestos_cement": 3100,
    "galvanized_steel": 4900,
}

#: Speed of sound in water: reference state, and m/s for each °C and bar.
REFERENCE_TEMPERATURE_C, REFERENCE_PRESSURE_BAR = 20.0, 1.0
PER_DEGREE, PER_BAR = 2.4, 0.16

#: Frequency bands, Hz.
BANDS = {"low": (50, 400), "mid": (400, 800), "high": (800, 1500), "full": (100, 1500)}

#: Repair categories; anything else is "unknown".
REPAIRED_AS = {
    "Boundary Box": "unknown",
    "Ferrule": "ferrule",
    "Fire Hydrant": "firehydrant",
    "Main": "main",
    "Manifold": "mainifold",
    "N/A": "unknown",
    "Network Valve": "valve",
    "OSV": "osv",
    "Repair": "unknown",
    "Service Pipe": "pipe",
    "Washout": "washout",
}

#: Recordings: samples a second, seconds, samples of a long and of a short window.
SAMPLE_RATE, DURATION_S, LONG_WINDOW, SHORT_WINDOW = 4096, 10, 1024, 512

#: Matched recordings taken of a sensor pair.
MAX_BATCH_PAIRS = 1000

#: Limits: seconds of delay and of clock drift, metres of tolerance and of sensor separation, dB, shares.
MAX_DELAY_S, MAX_DRIFT_S, TOLERANCE_M, MIN_SEPARATION_M, MAX_SEPARATION_M = 5.0, 5.0, 5.0, 10.0, 1000.0
MIN_SNR_DB, MIN_CONFIDENCE, MIN_PEAK_HEIGHT, MIN_SHARPNESS = 10.0, 0.7, 0.3, 1.5
EARTH_RADIUS_M = 6_371_000.0
