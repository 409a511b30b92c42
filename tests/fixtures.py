"""The demonstration tables and small helpers of the tests."""

# Demonstration reference rows and inputs.
KEYS16 = [
    ("Switches", "Push Button", "Brand"),
    ("Switches", "Push Button", "Voltage"),
    ("Switches", "Push Button", "Current"),
    ("Switches", "Push Button", "Material"),
    ("Connectors", "Terminal Block", "Brand"),
    ("Connectors", "Terminal Block", "Voltage Rating"),
    ("Connectors", "Terminal Block", "Current Rating"),
    ("Connectors", "Terminal Block", "Material"),
    ("Sensors", "Temperature", "Brand"),
    ("Sensors", "Temperature", "Temperature Range"),
    ("Sensors", "Temperature", "Accuracy"),
    ("Sensors", "Temperature", "Output Type"),
    ("Resistors", "Carbon Film", "Brand"),
    ("Resistors", "Carbon Film", "Resistance"),
    ("Resistors", "Carbon Film", "Tolerance"),
    ("Resistors", "Carbon Film", "Power Rating"),
]
FIRST = [
    "EAO, 02", "24V", "1A", "Plastic", "Phoenix Contact", "24V", "10A", "Metal", "Honeywell",
    "-40°C to +85°C", "±0.5°C", "Analog", "Vishay", "10kΩ", "±5%", "0.25W",
]
SECOND = [
    "IDEC, AL6", "12V", "2A", "Metal", "WAGO", "12V", "8A", "Plastic", "Sensirion",
    "-20°C to +60°C", "±1°C", "Digital", "Yageo", "1kΩ", "±1%", "0.125W",
]
PRESETS = [
    (i + 16 * n, *KEYS16[i], v) for n, vs in enumerate((FIRST, SECOND)) for i, v in enumerate(vs)
]
DEMO_INPUTS = [
    (0, "EAO, 02"), (1, "24v"), (2, "1 a"), (3, "plastic"), (4, "Phoenix Contact"), (5, "24 V"),
    (6, "10 A"), (8, "Honeywell"), (9, "-40°C to +85°C"), (10, "±0.5°C"), (12, "Vishay"),
    (13, "10k ohm"), (14, "±5%"),
]
INPUTS = [(n, *KEYS16[k], v) for n, (k, v) in enumerate(DEMO_INPUTS)]
PRESET_DDL = "row_id long, category string, sub_category string, attribute_name string, preset_value string"
INPUT_DDL = "input_id long, category string, sub_category string, attribute_name string, input_value string"


def presets(spark, rows=None):
    return spark.createDataFrame(PRESETS if rows is None else rows, PRESET_DDL)


def inputs(spark, rows=None):
    return spark.createDataFrame(INPUTS if rows is None else rows, INPUT_DDL)
