"""Column names, file schemas and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature groups, bounds, gear and status names of the data model.
CONTINUOUS = ["latitude", "longitude", "rot", "sog", "cog", "heading", "draught"]
STATIC = ["width", "length", "trawling"]
MODEL_FEATURES = [
    "latitude", "longitude", "rot", "sog", "cog", "heading", "width", "length", "draught",
]
POSITION_FEATURES = ["latitude", "longitude"]
CLAMP_LIMITS = {"sog": (0.0, 40.0), "rot": (-90.0, 90.0)}
SKEWED_POSITIVE = ["sog", "draught"]
SKEWED_SIGNED = ["rot"]
UNLABELLED_GEAR = ["UNKNOWN", "INCONCLUSIVE"]
FISHING_STATUS = "Engaged in fishing"
TRAWL_GEAR = "TRAWLERS"
TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
TIME_HEADER = "# Timestamp"
CRITICAL_ZONE_M = 1602.0
ENTRY_ZONE_M = 3738.0
NEAR_CABLE_M = 2200.0
METRES_PER_DEGREE = 111320.0

# Share of cells to blank out per trajectory feature, in percent.
MISSING_SHARES = {"signed_turn": 29, "bearing": 21, "euc_speed": 1, "distanceToShore": 70}

# Forecast horizon in steps for (minutes ahead, sampling seconds).
HORIZON_STEPS = {(10, 30): 20, (10, 60): 10, (10, 180): 4, (20, 30): 40, (20, 60): 20, (20, 180): 7}
UNSAMPLED_STEPS_PER_MINUTE = 6
# Lead steps of ten seconds for an output minute.
MINUTE_TO_LEAD = {1: 6, 5: 30, 10: 60, 15: 90, 20: 120}

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

# The 28 fields of a labelled message file, in file order.
MESSAGE_FILE_FIELDS = [
    ("# Timestamp", _S), ("Type of mobile", _S), ("MMSI", _I), ("Latitude", _D), ("Longitude", _D),
    ("Navigational status", _S), ("ROT", _D), ("SOG", _D), ("COG", _D), ("Heading", _D),
    ("IMO", _S), ("Callsign", _S), ("Name", _S), ("Ship type", _S), ("Cargo type", _S),
    ("Width", _I), ("Length", _I), ("Type of position fixing device", _S), ("Draught", _D),
    ("Destination", _S), ("ETA", _S), ("Data source type", _S),
    ("A", _I), ("B", _I), ("C", _I), ("D", _I), ("Gear Type", _S), ("trawling", _I),
]
MESSAGE_FILE = T.StructType([T.StructField(n, t) for n, t in MESSAGE_FILE_FIELDS])

# File headers -> column names used inside the engine.
RENAMES = {
    "MMSI": "mmsi", "Type of mobile": "mobile_type", "Latitude": "latitude",
    "Longitude": "longitude", "Navigational status": "nav_status", "ROT": "rot", "SOG": "sog",
    "COG": "cog", "Heading": "heading", "IMO": "imo", "Callsign": "callsign", "Name": "name",
    "Ship type": "ship_type", "Cargo type": "cargo_type", "Width": "width", "Length": "length",
    "Type of position fixing device": "fix_device", "Draught": "draught",
    "Destination": "destination", "ETA": "eta", "Data source type": "source_type",
    "A": "dim_a", "B": "dim_b", "C": "dim_c", "D": "dim_d", "Gear Type": "gear_type",
}

EXPORT_TYPES = {
    "timestamp_epoch": "bigint", "mmsi": "int", "latitude": "float", "longitude": "float",
    "rot": "float", "sog": "float", "cog": "float", "heading": "float", "width": "float",
    "length": "float", "draught": "float", "trawling": "int",
}
