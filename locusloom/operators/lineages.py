"""Classes of lineages. The dictionary is small and order-dependent, so it is folded on the driver and published as a
table; lineages are classified by joins with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The root of each class of concern, in the order in which lineages are classified.
ROOTS = {"Alpha": "B.1.1.7", "Beta": "B.1.351", "Gamma": "P.1", "Delta": "B.1.617.2", "Omicron": "B.1.1.529"}
#: The order in which aliases are given to classes.
ALIAS_ORDER = ("Delta", "Alpha", "Beta", "Gamma", "Omicron")


def voc_table(spark: SparkSession, aliases: dict[str, str | list[str]]) -> DataFrame:
    """(voc, lineage, ord): the roots, and every alias whose lineage is a root, lies below one, or starts with an alias
    given to the class before it."""
    members = {k: {v: 0} for k, v in ROOTS.items()}
    for at, (alias, lineages) in enumerate(aliases.items(), 1):
        for lineage in [lineages] if isinstance(lineages, str) else lineages:
            head = lineage.partition(".")[0]
            home = next((k for k in ALIAS_ORDER if lineage == ROOTS[k] or f"{ROOTS[k]}." in lineage or head in members[k]), None)
            if home:
                members[home].setdefault(alias, at)
    return spark.createDataFrame([(k, m, o) for k, ms in members.items() for m, o in ms.items()], "voc string, lineage string, ord int")


def classified(df: DataFrame, lineage: str, vocs: DataFrame, name: str = "voc") -> DataFrame:
    """df with the first class that holds the lineage or its first part, or whose root (with a dot) occurs in it;
    `Non-VOC` else. Both member lookups are equi-joins."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ROOTS) for x in (k, i)])
    member = vocs.groupBy("lineage").agg(F.min(rank[F.col("voc")]).alias("_r"))
    head = F.split_part(F.col(lineage), F.lit("."), F.lit(1))
    out = df.withColumn("_head", head)
    out = out.join(member.select(F.col("lineage").alias(lineage), F.col("_r").alias("_whole")), lineage, "left")
    out = out.join(member.select(F.col("lineage").alias("_head"), F.col("_r").alias("_part")), "_head", "left")
    inside = F.least(*[F.when(F.col(lineage).contains(f"{root}."), i) for i, root in enumerate(ROOTS.values())], F.lit(None).cast("int"))
    best = F.least("_whole", "_part", inside)
    names = F.create_map(*[F.lit(x) for i, k in enumerate(ROOTS) for x in (i, k)])
    return out.withColumn(name, F.coalesce(names[best], F.lit("Non-VOC"))).select(*df.columns, name)
