"""Merging count tables of several objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_genes(tables: list[DataFrame], mode: str = "intersect") -> DataFrame:
    genes = [t.select("gene_id").distinct() for t in tables]
    found = reduce(DataFrame.intersect if mode == "intersect" else DataFrame.union, genes).distinct()
    if found.isEmpty():
        raise ValueError("the objects share no gene")
    return found


def merge_objects(objects: list[tuple[str, DataFrame, DataFrame]], mode: str = "intersect") -> tuple[DataFrame, DataFrame]:
    """objects: (prefix, cells, counts). Cell ids that stand in several objects get their object's prefix in all."""
    if len(objects) < 2:
        raise ValueError("at least two objects are merged")
    ids = reduce(DataFrame.unionByName, [c.select("cell_id").distinct() for _, c, _ in objects])
    clash = not ids.groupBy("cell_id").count().where("count > 1").isEmpty()
    genes = shared_genes([k for _, _, k in objects], mode)
    cells, counts = [], []
    for prefix, c, k in objects:
        name = F.concat_ws("_", F.lit(prefix), F.col("cell_id").cast("string")) if clash else F.col("cell_id").cast("string")
        cells.append(c.withColumn("original_cell_id", F.col("cell_id")).withColumn("cell_id", name))
        counts.append(k.join(genes, "gene_id", "left_semi").withColumn("cell_id", name))
    fill = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(fill, cells), reduce(fill, counts)


def prefix_of(cells: DataFrame, position: int, columns: tuple[str, ...] = ("sample", "batch")) -> str:
    """The only value that an object's cells have in the first column with one, else sample and its position from 1."""
    for c in columns:
        if c in cells.columns:
            found = cells.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(2).collect()
            if len(found) == 1:
                return found[0][0]
    return f"sample{position}"


def merge_logcounts(objects: list[tuple[str, DataFrame, DataFrame | None]], counts: list[DataFrame], mode: str = "intersect") -> DataFrame | None:
    """The log counts of merged objects, with the ids of merge_objects over the same counts; None unless every object has them."""
    if any(logs is None for _, _, logs in objects):
        return None
    ids = reduce(DataFrame.unionByName, [c.select("cell_id").distinct() for _, c, _ in objects])
    clash = not ids.groupBy("cell_id").count().where("count > 1").isEmpty()
    genes = shared_genes(counts, mode)
    name = lambda prefix: F.concat_ws("_", F.lit(prefix), F.col("cell_id").cast("string")) if clash else F.col("cell_id").cast("string")
    return reduce(DataFrame.unionByName, [logs.join(genes, "gene_id", "left_semi").select(name(prefix).alias("cell_id"), "gene_id", "logcount") for prefix, _, logs in objects])


def coalesce_metadata(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of the columns; the first value that is not null, in the order of the tables."""
    tagged = [t.withColumn("order__", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("order__", c)))[c].alias(c)
    return rows.groupBy(key).agg(*(first(c) for c in rows.columns if c not in (key, "order__")))


def merge_reductions(objects: list[tuple[DataFrame, dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(kept, skipped): embeddings that all objects have, with null for cells without one, and why others were left out.

    objects: (cells, reductions by name); cells: cell_id, original_cell_id; reductions: cell_id (the original), embedding.
    """
    kept, skipped = {}, {}
    for name in [n for n in objects[0][1] if all(n in r for _, r in objects)]:
        parts, sizes = [], set()
        for cells, reductions in objects:
            size = F.size("embedding")
            ends = reductions[name].agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
            sizes |= {ends["low"], ends["high"]}
            ids = cells.select("cell_id", F.col("original_cell_id").alias("id__"))
            parts.append(ids.join(reductions[name].select(F.col("cell_id").alias("id__"), "embedding"), "id__", "left").drop("id__"))
        if len(sizes) > 1:
            skipped[name] = f"embeddings of different lengths ({', '.join(map(str, sorted(s for s in sizes if s is not None)))})"
        elif any(p.where("embedding is not null").isEmpty() for p in parts):
            skipped[name] = "no cell of an object is in its embedding"
        else:
            kept[name] = reduce(DataFrame.unionByName, parts)
    return kept, skipped
