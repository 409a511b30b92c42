"""Units, synonyms and abbreviations as fixed tables."""

# Units per dimension, with the factor to the base unit of the dimension.
UNITS = {
    "length": {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "inch": 25.4, "ft": 304.8},
    "weight": {"g": 1.0, "kg": 1000.0, "lb": 453.592, "oz": 28.3495},
    "voltage": {"v": 1.0, "mv": 0.001, "kv": 1000.0},
    "current": {"a": 1.0, "ma": 0.001, "ua": 0.000001},
    "power": {"w": 1.0, "mw": 0.001, "kw": 1000.0},
    "frequency": {"hz": 1.0, "khz": 1000.0, "mhz": 1000000.0, "ghz": 1000000000.0},
    "temperature": {"c": 1.0, "f": 5.0 / 9.0, "k": 1.0},
}
# Temperatures need an offset too: base degrees Celsius = value * factor + offset.
OFFSETS = {"c": 0.0, "f": -160.0 / 9.0, "k": -273.15}

# Words that mean the same; the first word of each line is the one to keep.
SYNONYMS = {
    "voltage": ["v", "volt", "volts"],
    "current": ["a", "amp", "amps", "ampere", "amperes"],
    "power": ["w", "watt", "watts"],
    "frequency": ["hz", "hertz"],
    "resistance": ["ohm", "ohms", "r"],
    "capacitance": ["f", "farad", "farads"],
    "inductance": ["h", "henry", "henries"],
    "temperature": ["temp", "°c", "°f", "celsius", "fahrenheit"],
    "length": ["l", "len", "long"],
    "width": ["w", "wide"],
    "height": ["h", "high", "tall"],
    "diameter": ["dia", "d"],
    "thickness": ["thick", "t"],
}

# Abbreviations and their long forms.
ABBREVIATIONS = {
    "max": "maximum",
    "min": "minimum",
    "nom": "nominal",
    "typ": "typical",
    "std": "standard",
    "stdby": "standby",
    "pwr": "power",
    "gnd": "ground",
    "ref": "reference",
    "temp": "temperature",
    "volt": "voltage",
    "amp": "current",
    "watt": "power",
    "ohm": "resistance",
    "farad": "capacitance",
    "henry": "inductance",
}
