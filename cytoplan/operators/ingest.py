"""Names, alignment and annotations of cells and genes on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns in which names are looked for, in this order.
CELL_COLUMNS = ("Barcode", "barcode", "cell", "cell_id")
FEATURE_COLUMNS = ("Symbol", "symbol", "gene_name", "feature_name", "ID", "id", "gene_id")


def unique_names(df: DataFrame, column: str, order: str) -> DataFrame:
    """Later rows of one name get .1, .2 and so on, past numbers that other names have already.

    `order` (distinct numbers) says which row is the first. Only names that stand twice are put in order; a name
    that most rows share is one task's work.
    """
    count = df.groupBy(F.col(column).alias("n__")).agg(F.count(F.lit(1)).alias("k__"))
    twice = count.where("k__ > 1").select("n__")
    form = r"^(.*)\.([1-9][0-9]{0,8})$"
    numbered = count.where(F.col("n__").rlike(form)).select(F.regexp_extract("n__", form, 1).alias("n__"), F.regexp_extract("n__", form, 2).cast("int").alias("used__"))
    taken = numbered.join(twice, "n__", "left_semi").groupBy("n__").agg(F.sort_array(F.collect_set("used__")).alias("used__"))
    named = df.withColumn("n__", F.col(column)).join(count.where("k__ > 1"), "n__", "left").join(taken, "n__", "left")
    again = F.when(F.col("k__") > 1, F.row_number().over(Window.partitionBy("n__", F.when(F.col("k__").isNull(), F.col(order))).orderBy(order)) - 1).otherwise(0)
    named = named.withColumn("again__", again)
    free = F.aggregate(F.coalesce("used__", F.array().cast("array<int>")), F.col("again__"), lambda k, used: F.when(used <= k, k + 1).otherwise(k))
    name = F.when(F.col("again__") > 0, F.concat(F.col("n__"), F.lit("."), free.cast("string"))).otherwise(F.col("n__"))
    return named.withColumn(column, name).select(*df.columns)


def name_column(df: DataFrame, choices: tuple[str, ...]) -> str | None:
    """The first of the columns that holds a name."""
    here = [c for c in choices if c in df.columns]
    if not here:
        return None
    some = df.agg(*(F.max((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int")).alias(f"c{i}") for i, c in enumerate(here))).first()
    return next((c for i, c in enumerate(here) if some[f"c{i}"]), None)


def feature_names(genes: DataFrame, position: str, choices: tuple[str, ...] = FEATURE_COLUMNS, current: str | None = None) -> DataFrame:
    """genes with `feature`: the best column's name, else the current one, else feature_<position>; the current one stays as feature_id."""
    column = name_column(genes, choices)
    rest = F.col(current).cast("string") if current else F.concat(F.lit("feature_"), F.col(position).cast("string"))
    name = F.when(F.trim(F.col(column).cast("string")) != "", F.col(column).cast("string")) if column else F.lit(None).cast("string")
    kept = genes.withColumn("feature_id", F.col(current)) if current and "feature_id" not in genes.columns else genes
    return unique_names(kept.withColumn("feature", F.coalesce(name, rest)), "feature", position)


def cell_names(cells: DataFrame, position: str) -> DataFrame:
    """cells with `cell_id` from the first barcode column."""
    column = name_column(cells, CELL_COLUMNS)
    if column is None:
        raise ValueError(f"no cell names; expected one of {', '.join(CELL_COLUMNS)}")
    named = cells.withColumn("cell_id", F.col(column).cast("string"))
    if not named.where(F.coalesce("cell_id", F.lit("")) == "").isEmpty():
        raise ValueError(f"some cells have no name in {column}")
    return unique_names(named, "cell_id", position)


def aligned(metadata: DataFrame, ids: DataFrame, key: str, what: str) -> DataFrame:
    """The rows of metadata for exactly these ids; an error names some that are missing."""
    rows, wanted = metadata.count(), ids.count()
    if rows != wanted:
        raise ValueError(f"{what} has {rows} rows, not {wanted}")
    missing = ids.select(key).join(metadata, key, "left_anti").limit(10).collect()
    if missing:
        raise ValueError(f"{what} lacks identifiers: {', '.join(str(r[0]) for r in missing)}")
    return ids.select(key).join(metadata, key)


def annotated(cells: DataFrame, columns: dict[str, str | None], values: dict[str, object]) -> DataFrame:
    """Constant sample, batch, condition or time columns. columns: role to its column; values: role to its constant."""
    fixed = {columns.get(role) or role: F.lit(v) for role, v in values.items() if v is not None}
    out = cells.withColumns(fixed) if fixed else cells
    require(out, [c for c in columns.values() if c], "annotation")
    return out


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} columns not found: {', '.join(missing)}")
