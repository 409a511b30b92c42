"""Column names, fixed labels and the result schema."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["category", "sub_category", "attribute_name"]
PRESET_VALUE = "preset_value"
INPUT_VALUE = "input_value"
REFERENCE_COLUMNS = [*KEYS, PRESET_VALUE]
INPUT_COLUMNS = [*KEYS, INPUT_VALUE]

# Column headers of the tables users hand in and get back.
REFERENCE_HEADERS = {
    "Category": "category",
    "Sub-Category": "sub_category",
    "Attribute Name": "attribute_name",
    "Preset values": "preset_value",
}
INPUT_HEADERS = {
    "Category": "category",
    "Sub-Category": "sub_category",
    "Attribute Name": "attribute_name",
    "Input Value": "input_value",
}
INPUT_ALIASES = {
    "Structure": "Category",
    "Full Structure": "Sub-Category",
    "Attribute value": "Input Value",
}
RESULT_HEADERS = {
    "original_input": "Original Input",
    "matched_value": "Matched Preset Value",
    "similarity": "Similarity %",
    "comment": "Comment",
    "suggested_value": "Suggested Value",
    "status": "Status",
    "category": "Category",
    "sub_category": "Sub-Category",
    "attribute_name": "Attribute Name",
    "preset_row_id": "Preset Row ID",
}
EXACT, SIMILAR, NOT_FOUND = "Exact Match", "Similar Match", "Not Found"
STATUSES = [EXACT, SIMILAR, NOT_FOUND]

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("input_id", T.LongType()),
        T.StructField("match_rank", T.IntegerType()),
        T.StructField("original_input", T.StringType()),
        T.StructField("matched_value", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("comment", T.StringType()),
        T.StructField("suggested_value", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("attribute_name", T.StringType()),
        T.StructField("preset_row_id", T.LongType()),
        T.StructField("match_type", T.StringType()),
    ]
)


class MissingColumns(ValueError):
    """A table lacks required columns."""

    def __init__(self, missing):
        self.missing = list(missing)
        super().__init__(f"Missing required columns: {self.missing}")
