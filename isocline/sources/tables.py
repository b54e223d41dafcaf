"""Readers: explicit schemas, missing values to null at the scan, optional columns, ranged reads of tiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a gazetteer's tab-separated file.
GAZETTEER = "geonameid long, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation int, dem int, timezone string, modified string"
PLACE = "label string, country string, admin1 string, lat double, lon double, pop long, domain string"
# Columns of occurrence records, lower-cased.
OCCURRENCE = "gbifid string, decimallatitude double, decimallongitude double, coordinateuncertaintyinmeters double, eventdate string, recordedby string, datasetkey string, occurrenceid string, year int, month int, establishmentmeans string, countrycode string, basisofrecord string, license string"


def missing_to_null(df: DataFrame, sentinels: Mapping[str, float] | None = None, over: float = 1e19) -> DataFrame:
    """NaN, fill values above `over` and a column's sentinel become null, so that no aggregate meets them."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) < over), c)
        if sentinels and name in sentinels:
            c = F.when(c != sentinels[name], c)
        out.append(c.alias(name))
    return df.select(*out)


def csv_table(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",", quote: str | None = '"', null: str = "") -> DataFrame:
    """A CSV whose empty fields are null; text such as the country code NA survives. Columns are pruned in the parser."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, quote=quote or "\u0000", nullValue=null, emptyValue=null, enforceSchema=False)


def places(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, PLACE)


def gazetteer(spark: SparkSession, path: str, least_population: int = 0) -> DataFrame:
    """Populated places of a tab-separated gazetteer without quoting."""
    return csv_table(spark, path, GAZETTEER, header=False, sep="\t", quote=None).where((F.col("feature_class") == "P") & (F.col("population") >= least_population))


def trimmed(df: DataFrame) -> DataFrame:
    """Headers and text values without surrounding blanks."""
    return df.select(*[(F.trim(F.col(f"`{n}`")) if t == "string" else F.col(f"`{n}`")).alias(n.strip()) for n, t in df.dtypes])


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns whatever their case in df; those that df lacks are null, lists of text are joined by pipes."""
    by_lower = {n.lower(): (n, t) for n, t in df.dtypes}
    out = []
    for field in T._parse_datatype_string(schema) if isinstance(schema, str) else schema:
        name, kind = by_lower.get(field.name.lower(), (None, ""))
        c = F.lit(None) if name is None else F.array_join(F.col(f"`{name}`"), "|") if kind.startswith("array<string") else F.col(f"`{name}`")
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def occurrences(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return missing_to_null(conformed(spark.read.option("pathGlobFilter", "*.parquet").parquet(*([path] if isinstance(path, str) else path)), OCCURRENCE))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON documents, with scenarios as a map."""
    schema = "species struct<name:string,group:string>, tier string, confidence string, published boolean, hard_failures array<string>, soft_flags array<string>, scenarios map<string,struct<ssp:string,period:string,n_models:int,novel_share:double>>"
    return spark.read.schema(schema).json(path, multiLine=True)


def tiles(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of a box: partitions by tile are pruned, then row groups by grid_row."""
    wanted = [f"r{r}c{c}" for r in range(rows[0] // 1080, rows[1] // 1080 + 1) for c in range(cols[0] // 2160, cols[1] // 2160 + 1)]
    return spark.read.parquet(path).where(F.col("tile").isin(wanted) & F.col("grid_row").between(*rows) & F.col("grid_col").between(*cols))


def tile_of(row, col):
    return F.concat(F.lit("r"), F.floor(row / 1080).cast("string"), F.lit("c"), F.floor(col / 2160).cast("string"))


def decoded(code, scale: float, offset: float, reserved: int):
    """A scaled integer, null where it is the reserved value."""
    return F.when(code != reserved, code * scale + offset)


def newest_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """group, year, path of the newest version of each file; pattern has groups: name, year, major, minor version."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "path")
    g = [F.regexp_extract("file", pattern, k) for k in range(1, 5)]
    named = files.where(F.col("file").rlike(pattern)).select(g[0].alias("name"), g[1].cast("int").alias("year"), F.struct(g[2].cast("int"), g[3].cast("int")).alias("v"), "path")
    return named.groupBy("name", "year").agg(F.max_by("path", "v").alias("path"))


def product_key(key):
    """label, scenario and period of an object's key."""
    scenario = F.regexp_extract(key, r"(ssp\d{3}|rcp\d{2})", 1)
    period = F.coalesce(F.nullif(F.regexp_extract(key, r"(\d{4}[-_]\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(key, r"(\d{4}s)", 1), F.lit("")))
    return F.struct(F.regexp_extract(key, r"([^/]+?)[_-](?:ssp|rcp)", 1).alias("label"), F.nullif(scenario, F.lit("")).alias("scenario"), F.replace(period, F.lit("_"), F.lit("-")).alias("period"))


def predicate(equals: Mapping[str, object] | None = None, within: Mapping[str, Sequence] | None = None, least: Mapping[str, object] | None = None, most_or_null: Mapping[str, object] | None = None):
    """One condition from parts that are all pushed down to the scan."""
    test = F.lit(True)
    for name, v in (equals or {}).items():
        test = test & (F.col(name) == v)
    for name, v in (within or {}).items():
        test = test & F.col(name).isin(list(v))
    for name, v in (least or {}).items():
        test = test & (F.col(name) >= v)
    for name, v in (most_or_null or {}).items():
        test = test & (F.col(name).isNull() | (F.col(name) <= v))
    return test
