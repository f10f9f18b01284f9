"""Yearly data resources described by a package manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a resource name or link reveals its year, and the fields of one resource.
YEAR_PATTERNS = (
    r"(?i)historic[\W_]*demand[\W_]*data[\W_]*(20\d{2})",
    r"(?i)demanddata[\W_]*(20\d{2})\.csv",
)
RESOURCE_SCHEMA = (
    "id string, name string, title string, format string, mimetype string, url string, "
    "path string, last_modified string, metadata_modified string, datastore_active boolean"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per resource of a manifest file, with its position in the file."""
    document = spark.read.schema(f"resources array<struct<{_as_struct()}>>")
    return (
        document.option("multiLine", True).json(path)
        .select(F.posexplode("resources").alias("position", "r"))
        .select("position", "r.*")
    )


def _as_struct() -> str:
    return ", ".join(field.strip().replace(" ", ":", 1) for field in RESOURCE_SCHEMA.split(","))


# The fields of a resource. A manifest of another make names the keys under which to look for each, in turn.
RESOURCE_KEYS = {field.split()[0]: (field.split()[0],) for field in RESOURCE_SCHEMA.split(", ")}


def resources_from_text(
    documents: DataFrame, text: str, keys: dict[str, tuple[str, ...]] | None = None, carry: tuple[str, ...] = (), listed: str | None = "resources",
) -> DataFrame:
    """One row per resource of JSON texts, with its position in the text and the ``carry`` columns of its document.

    A text is parsed once, as a variant, so documents need no common schema: a field is the first of its ``keys`` that is
    there and readable. ``listed`` names the array of resources; without it a text is one resource. A null or broken text,
    or one without resources, gives none where an array is asked for, and a resource without fields otherwise.
    """
    chosen = RESOURCE_KEYS | (keys or {})
    parsed = documents.select(*carry, F.try_parse_json(F.col(text)).alias("_v"))
    if listed:
        each = F.try_variant_get("_v", f"$.{listed}", "array<variant>")
        parsed = parsed.select(*carry, F.posexplode(each).alias("position", "_v"))
    else:
        parsed = parsed.withColumn("position", F.lit(0))
    kinds = dict(field.split() for field in RESOURCE_SCHEMA.split(", "))
    value = lambda name: F.coalesce(*[F.try_variant_get("_v", f"$.{k}", kinds[name]) for k in chosen[name]]).alias(name)
    return parsed.select(*carry, "position", *map(value, kinds))


def first_filled(*names: str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def extracted_year(name: Column, link: Column) -> Column:
    """Year found in the name, else in the link, by the fixed patterns."""
    found = [
        F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), pattern, 1), F.lit(""))
        for source in (name, link)
        for pattern in YEAR_PATTERNS
    ]
    return F.coalesce(*found).cast("int")


def is_csv(fmt: Column, link: Column) -> Column:
    """Advertised as CSV, or linking to a ``.csv`` file once the query string is cut off."""
    plain = F.split_part(F.lower(F.coalesce(link, F.lit(""))), F.lit("?"), F.lit(1))
    return F.lower(F.coalesce(fmt, F.lit(""))).contains("csv") | plain.endswith(".csv")


def manifest_inventory(resources: DataFrame, selected_years: DataFrame | None = None) -> DataFrame:
    """Clean description of every resource; ``selected_years`` holds one column ``year``."""
    name, link = first_filled("name", "title"), first_filled("url", "path")
    inventory = resources.select(
        "position",
        name.alias("resource_name"),
        first_filled("format", "mimetype").alias("format"),
        link.alias("url_or_path"),
        F.col("id").alias("resource_id"),
        first_filled("last_modified", "metadata_modified").alias("last_modified"),
        F.col("datastore_active").alias("datastore_available"),
        extracted_year(name, link).alias("extracted_year"),
    )
    if selected_years is None:
        return inventory.withColumn("selected_for_download", F.lit(False))
    chosen = selected_years.select(
        F.col("year").alias("extracted_year"), F.lit(True).alias("_chosen")
    ).distinct()
    return (
        inventory.join(chosen, "extracted_year", "left")
        .withColumn("selected_for_download", F.coalesce("_chosen", F.lit(False)))
        .drop("_chosen")
    )


def select_years(
    inventory: DataFrame,
    start: int,
    end: int | None = None,
    current_year: int | None = None,
    include_current: bool = False,
) -> DataFrame:
    """First CSV resource of each year within ``[start, end]``.

    The running year is left out unless asked for; without ``end`` the latest allowed year closes
    the range, which the filter on the running year already expresses.
    """
    running = F.year(F.current_date()) if current_year is None else F.lit(current_year)
    year = F.col("extracted_year")
    usable = inventory.where(
        year.isNotNull() & F.col("url_or_path").isNotNull() & is_csv(F.col("format"), F.col("url_or_path"))
    )
    allowed = (year <= running) if include_current else (year < running)
    in_range = (year >= start) if end is None else year.between(start, end)
    # min-by-position first: a year with very many resources must not meet in one sort
    earliest = usable.where(allowed & in_range).groupBy("extracted_year").agg(
        F.min_by(F.struct("position", "resource_name", "url_or_path"), "position").alias("r")
    )
    return earliest.select(
        F.col("extracted_year").alias("year"), "r.position",
        F.coalesce(
            "r.resource_name", F.concat(F.lit("historic_demand_data_"), F.col("extracted_year").cast("string"))
        ).alias("resource_name"),
        "r.url_or_path",
    )
