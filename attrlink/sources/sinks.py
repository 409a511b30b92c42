"""Writing results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import report as R
from ..plans.cascade import display_columns


def write_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results as CSV with a header; one file per partition. Quotes are doubled, as usual."""
    results.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(
    results: DataFrame, path: str, file_format: str = "csv", exported_at: str | None = None,
    mode: str = "errorifexists",
) -> list[str]:
    """The report: results, summary, status breakdown and, with a category column, the category
    analysis, each as a folder under ``path``. Returns the names of the parts."""
    parts = {
        "comparison_results": display_columns(results),
        "summary": R.summary(results, exported_at).drop("position"),
        "status_breakdown": R.status_breakdown(results),
    }
    if "category" in results.columns:
        parts["category_analysis"] = R.category_status(results)
    for name, part in parts.items():
        writer = part.write.mode(mode).format(file_format)
        if file_format == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{path}/{name}")
    return list(parts)
