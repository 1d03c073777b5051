"""Raw works in, relational tables out; papers in the flat form; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.functions.scalar import inverted_text, real_doi, short_id, topic_refs

_PLACE = "id: string, display_name: string"
#: The nested work as it comes, one JSON object a line.
WORK = (
    "id string, display_name string, title string, publication_year int, publication_date string, cited_by_count bigint, doi string, "
    f"topics array<struct<{_PLACE}, score: double, subfield: struct<{_PLACE}>, field: struct<{_PLACE}>, domain: struct<{_PLACE}>>>, "
    f"authorships array<struct<author: struct<{_PLACE}>, institutions: array<struct<{_PLACE}, country_code: string>>, countries: array<string>>>, "
    "abstract_inverted_index map<string, array<int>>, open_access struct<oa_url: string>, primary_location struct<landing_page_url: string>, "
    "abstract string, year int, date string, countries array<string>, _corrupt_record string"
)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of JSON lines with their line order; malformed lines have _corrupt_record set."""
    raw = spark.read.schema(WORK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.withColumn("line", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def is_usable(raw: DataFrame) -> DataFrame:
    return raw.filter("_corrupt_record IS NULL AND id IS NOT NULL AND publication_year IS NOT NULL")


def rejects(raw: DataFrame) -> DataFrame:
    """The number of lines that are malformed or lack an id or a year."""
    bad = "_corrupt_record IS NOT NULL OR id IS NULL OR publication_year IS NULL"
    return raw.agg(F.count(F.when(F.expr(bad), 1)).alias("skipped"), F.count("*").alias("lines"))


def _last(rows: DataFrame, key: str) -> DataFrame:
    cols = [c for c in rows.columns if c not in (key, "line")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "line").alias("r")).select(key, "r.*")


def normalise(raw: DataFrame) -> dict[str, DataFrame]:
    """The six tables. Of a repeated id the last record's scalars win; bridges are unions."""
    w = is_usable(raw).withColumn("work_id", short_id("id"))
    name = F.substring(F.coalesce("display_name", "title", F.lit("")), 1, 300)
    works = w.select("work_id", name.alias("title"), F.col("publication_year").alias("pub_year"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by"), "line")
    t = w.select("work_id", "line", F.explode("topics").alias("t")).filter("t.id IS NOT NULL")
    a = w.select("work_id", "line", F.explode("authorships").alias("a")).filter("a.author.id IS NOT NULL")
    first = F.get("a.institutions", 0)
    own = F.concat(F.coalesce("a.countries", F.array().cast("array<string>")), F.coalesce(F.transform("a.institutions", lambda i: i["country_code"]), F.array().cast("array<string>")))
    every = w.select("work_id", F.explode("authorships").alias("a"))
    return {
        "works": _last(works, "work_id"),
        "topics": _last(t.select(short_id("t.id").alias("topic_id"), F.col("t.display_name").alias("topic"), F.col("t.field.display_name").alias("field"), F.col("t.domain.display_name").alias("domain"), "line"), "topic_id"),
        "authors": _last(a.select(short_id("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("author"), first["display_name"].alias("institution"), first["country_code"].alias("country"), "line"), "author_id"),
        "work_topics": t.groupBy("work_id", short_id("t.id").alias("topic_id")).agg(F.max_by(F.coalesce("t.score", F.lit(0.0)), "line").alias("score")),
        "work_authors": a.select("work_id", short_id("a.author.id").alias("author_id")).distinct(),
        "work_countries": every.select("work_id", F.explode(own).alias("c")).select("work_id", F.upper(F.trim("c")).alias("country")).filter("country <> ''").distinct(),
    }


def paper(raw: DataFrame) -> DataFrame:
    """The flat paper, from raw works or from records already flat."""
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull())
    codes = F.flatten(F.transform("authorships", lambda a: F.concat(F.coalesce(a["countries"], F.array().cast("array<string>")), F.coalesce(F.transform(a["institutions"], lambda i: i["country_code"]), F.array().cast("array<string>")))))
    countries = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(codes, "countries"), lambda c: F.upper(F.trim(c))), lambda c: c.isNotNull() & (c != ""))))
    # A column of its own: below, "topics" may also mean the alias of the flat names.
    refs = F.col("_w_refs")
    usable = raw.filter("_corrupt_record IS NULL AND id IS NOT NULL").withColumns({"_w_refs": topic_refs(F.col("topics")), "_w_countries": countries})
    return usable.select(
        short_id("id").alias("id"),
        F.coalesce("display_name", "title", F.lit("")).alias("title"),
        F.coalesce("publication_year", "year", F.substring(F.coalesce("publication_date", "date"), 1, 4).try_cast("int")).alias("year"),
        F.coalesce("publication_date", "date").alias("date"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by"),
        real_doi(F.col("doi")).alias("doi"),
        F.coalesce(F.when(F.size("abstract_inverted_index") > 0, inverted_text(F.col("abstract_inverted_index"))), "abstract").alias("abstract"),
        F.coalesce("open_access.oa_url", "primary_location.landing_page_url").alias("original_url"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.coalesce("_w_countries", F.array().cast("array<string>")).alias("countries"),
        F.array_distinct(F.transform(refs, lambda r: r["name"])).alias("topics"),
        refs.alias("topic_refs"),
    )


def append_new(spark: SparkSession, path: str, new: DataFrame, key: str = "id") -> int:
    """Append rows whose key is not held yet, the first of each; returns their number."""
    fresh = new.dropDuplicates([key])
    try:
        held = spark.read.parquet(path).select(key).distinct()
        fresh = fresh.join(held, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def replace_mart(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Full replacement; the commit protocol makes it atomic by job."""
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, sorted by id within files."""
    df.sort("id").write.mode("overwrite").json(path)


def first_readable(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, str | None]:
    """The first Parquet path that opens and has rows."""
    for p in paths:
        try:
            df = spark.read.parquet(p)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                continue
            raise
        if not df.isEmpty():
            return df, p
    return None, None


def put_document(spark: SparkSession, root: str, kind: str, payload: str) -> None:
    """One JSON document by kind."""
    if not kind.replace("_", "").replace("-", "").isalnum():
        raise ValueError(f"bad kind: {kind!r}")
    spark.createDataFrame([(kind, payload)], "kind string, payload string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{kind}")


def get_document(spark: SparkSession, root: str, kind: str) -> str | None:
    df, _ = first_readable(spark, [f"{root}/{kind}"])
    return df.first()["payload"] if df is not None else None


def missing_key(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose JSON lacks a key (a null value is not a missing key)."""
    return rows.filter(~F.array_contains(F.json_object_keys(column), key))


def sample_works(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """A synthetic corpus in the raw form's essentials: id, year and topics from planted clusters
    that live in different years."""
    r = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1000)) / 1000.0
    base = spark.range(n).withColumn("publication_year", (F.lit(2000) + F.floor(r(1) * 27)).cast("int"))
    start = F.when(F.col("publication_year") < 2009, 0).when(F.col("publication_year") < 2018, 4).otherwise(8)
    cluster = start + F.floor(r(2) * 4).cast("int")
    topics = F.transform(F.sequence(F.lit(1), (F.lit(2) + F.floor(r(3) * 3)).cast("int")), lambda i: F.concat(F.lit("Topic "), cluster.cast("string"), F.lit("."), i.cast("string")))
    return base.select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("work_id"), F.col("publication_year").alias("pub_year"), topics.alias("topics"))
