"""Reading and writing tables, columns from paths, drug records and links (SRC1-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format and options of a file name's last part.
FORMATS = {"csv": ("csv", {"header": True}), "tsv": ("csv", {"header": True, "sep": "\t"}), "parquet": ("parquet", {}), "json": ("json", {}), "orc": ("orc", {})}


def _format(path: str) -> tuple[str, dict]:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {path}")
    return FORMATS[kind]


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str | None = None) -> DataFrame:
    """A table of files; ``kind`` is the format of a folder of chunks, or of names, that don't say it."""
    kind, options = _format(f".{kind}" if kind else path)
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes ``df`` unless it is empty."""
    kind, options = _format(path)
    if not df.isEmpty():
        df.write.mode("overwrite").format(kind).options(**options).partitionBy(*partition_by).save(path)


def from_path(pattern: str, group: int = 1) -> Column:
    """Part of the path of the file that a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_tree(spark: SparkSession, pattern: str, names: list[str], kind: str | None = None, schema: str | None = None) -> DataFrame:
    """All files of a tree of variants, e.g. ``root/*/*/scores*.parquet``, with the last folders of each file's path and its stem as
    columns ``names`` (the last of them: the stem). Parquet files may differ in columns: those that one lacks are null."""
    kind, options = _format(f".{kind}" if kind else pattern)
    reader = spark.read.format(kind).options(**options, **({"mergeSchema": True} if kind in ("parquet", "orc") else {}))
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda back: F.element_at(parts, -back)
    columns = [at(len(names) - k).alias(n) for k, n in enumerate(names[:-1])]
    return (reader.schema(schema) if schema else reader).load(pattern).select("*", *columns, F.regexp_extract(at(1), r"\A(.*?)(?:\.[^.]*)?\z", 1).alias(names[-1]))


def drug_records(spark: SparkSession, path: str) -> DataFrame:
    """Drug dictionary from XML: name, cas_number, mass, drug_id (the first one), synonyms, products, brands, mixtures (names) and
    their parts, the four classes, experimental and calculated properties; mixture names leave products and brands.

    Texts are in lower case with single spaces, values of properties keep their case. What isn't there is null, empty in lists
    and maps; of entries of one name the last counts.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    text = lambda c: F.lower(plain(c))
    named, properties = "array<struct<name:string>>", "struct<property:array<struct<kind:string,value:string>>>"
    schema = (
        "name string, `cas-number` string, `average-mass` string, `drugbank-id` array<string>, synonyms struct<synonym:array<string>>, "
        f"products struct<product:{named}>, `international-brands` struct<`international-brand`:{named}>, mixtures struct<mixture:array<struct<name:string,ingredients:string>>>, "
        f"classification struct<kingdom:string,superclass:string,class:string,subclass:string>, `experimental-properties` {properties}, `calculated-properties` {properties}"
    )
    raw = spark.read.format("xml").option("rowTag", "drug").schema(schema).load(path)
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array()), text)))

    def entries(rows: Column, key: str, value, kind: str) -> Column:
        """Map of an array's structs by ``key``; seen from the end, the first of a name counts."""
        known = F.reverse(F.filter(rows, lambda e: e[key].isNotNull()))
        keys, found = F.transform(known, lambda e: text(e[key])), F.transform(known, value)
        once = F.array_distinct(keys)
        return F.coalesce(F.map_from_arrays(once, F.transform(once, lambda k: F.get(found, (F.array_position(keys, k) - 1).cast("int")))), F.create_map().cast(kind))

    values = lambda c: entries(F.col(c), "kind", lambda e: plain(e["value"]), "map<string,string>")
    # unlike names first: a later column of one select could take an earlier one's alias for its source
    rows = raw.select(
        F.col("name").alias("r_name"), F.col("`cas-number`").alias("r_cas"), F.col("`average-mass`").alias("r_mass"), F.get("drugbank-id", F.lit(0)).alias("r_id"),
        F.col("synonyms.synonym").alias("r_synonyms"), F.col("products.product.name").alias("r_products"), F.col("`international-brands`.`international-brand`.name").alias("r_brands"),
        F.col("mixtures.mixture").alias("r_mixtures"), F.col("classification").alias("r_classes"),
        F.col("`experimental-properties`.property").alias("r_experimental"), F.col("`calculated-properties`.property").alias("r_calculated"),
    )
    out = rows.select(
        text(F.col("r_name")).alias("name"), F.col("r_cas").alias("cas_number"), text(F.col("r_mass")).alias("mass"), F.col("r_id").alias("drug_id"),
        names(F.col("r_synonyms")).alias("synonyms"), names(F.col("r_products")).alias("products"), names(F.col("r_brands")).alias("brands"), names(F.col("r_mixtures.name")).alias("mixtures"),
        entries(F.col("r_mixtures"), "name", lambda e: F.split(text(e["ingredients"]), r" \+ "), "map<string,array<string>>").alias("parts"),
        *(text(F.col(f"r_classes.{c}")).alias(c) for c in ("kingdom", "superclass", "class", "subclass")),
        values("r_experimental").alias("experimental"), values("r_calculated").alias("calculated"),
    )
    return out.withColumns({c: F.array_except(c, "mixtures") for c in ("products", "brands")})


def links(page: Column) -> Column:
    """Targets of the links of a page, in order; empty for a null page."""
    tags = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    target = lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    bare = F.transform(tags, lambda t: F.regexp_replace(target(t), r"(?is)\A\shref\s*=\s*[\"']?|[\"']\z", ""))
    return F.filter(bare, lambda t: t != "")
