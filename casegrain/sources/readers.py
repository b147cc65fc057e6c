"""Readers: explicit schemas, and only what Spark can read from any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACT = "struct<fact_id:string,atomic_fact:string,onset:string,duration:string,frequency:string,severity:string>"
ITEM = "struct<test_name:string,modality:string,findings:string,image_id:string,panel_id:string>"


def rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by suffix, else JSON lines; blank lines are no rows, and a malformed one is an error when it is read."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".parquet"):
        return reader.parquet(path)
    return reader.option("mode", "FAILFAST").json(path)


def records(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """A folder of parts, Parquet, a JSON array (``array``) or JSON lines, with ``_file`` and ``_at`` for order."""
    reader = spark.read.schema(schema) if schema else spark.read
    if array:
        found = reader.option("multiLine", True).json(path)
    elif path.endswith((".json", ".jsonl")):
        found = reader.json(path)
    else:
        found = reader.option("mergeSchema", True).parquet(path)
    return found.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))


def replayed_cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last well-formed row of each key of an append-only JSON-lines cache."""
    found = records(spark, path, f"{schema}, _bad string").where(f"{key} is not null")
    columns = [c for c in found.columns if c not in ("_file", "_at", "_bad")]
    return found.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_file", "_at")).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Crop manifest: the last row of each (image_id, panel_id), after its invariants are checked."""
    found = records(spark, path, schema)
    broken = (F.col("panel_asset_id") != F.concat_ws("#", "image_id", "panel_id")) | (F.col("group_asset_id").isNotNull() & ~F.startswith("group_asset_id", F.concat("image_id", F.lit("#"))))
    bad = found.where(F.coalesce(broken, F.lit(True))).select("image_id", "panel_id").limit(5).collect()
    if bad:
        raise ValueError(f"manifest rows break their ids: {[tuple(r) for r in bad]}")
    columns = [c for c in found.columns if c not in ("_file", "_at")]
    return found.groupBy("image_id", "panel_id").agg(F.max_by(F.struct(*columns), F.struct("_file", "_at")).alias("r")).select("r.*")


def donors(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """Donor rows in file order whose crop exists; a row without a category is an error."""
    found = records(spark, path, "case_id string, crop_path string, category string")
    if found.where("category is null").limit(1).count():
        raise ValueError("a donor has no category")
    return found.join(existing, "crop_path", "left_semi").orderBy("_file", "_at").drop("_file", "_at")


def name_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, pred, gold) with the longer column names as second choices."""
    found = spark.read.schema("case_id string, pred string, predicted string, predicted_diagnosis string, gold string, ground_truth string").json(path)
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c])
    return found.select("case_id", first("pred", "predicted", "predicted_diagnosis").alias("pred"), first("gold", "ground_truth").alias("gold"))


def headed_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.options(header=True, quote='"', escape='"', **options).csv(path)


def piped(spark: SparkSession, path: str, columns: list[str], suppress: str | None = None) -> DataFrame:
    """Pipe-delimited rows (gzip or not) without comment lines and suppressed rows."""
    found = spark.read.option("sep", "|").option("comment", "#").schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return found if suppress is None else found.where(F.coalesce(F.col(suppress) != "Y", F.lit(True)))


def stanzas(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """names and parents of a stanza-formatted ontology file.

    Obsolete terms are left out, their names given to the live term that
    replaces them; is_a and part_of both make parents.
    """
    text = spark.read.option("lineSep", "[Term]").text(path).where(r"value rlike '(?m)^id: '").withColumn("at", F.monotonically_increasing_id())
    one = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    every = lambda p: F.regexp_extract_all("value", F.lit(p), F.lit(1))
    terms = text.select(
        "at", one(r"(?m)^id: (\S+)").alias("cid"), one(r"(?m)^name: (.+?)\s*$").alias("label"), F.col("value").rlike(r"(?m)^is_obsolete: true").alias("obsolete"), one(r"(?m)^replaced_by: (\S+)").alias("to"),
        every(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"').alias("synonyms"), every(r'(?m)^def: "((?:[^"\\]|\\.)*)"').alias("defs"), F.concat(every(r"(?m)^is_a: (\S+)"), every(r"(?m)^relationship: part_of (\S+)")).alias("up"),
    )
    live = terms.where("not obsolete")
    given = terms.where("obsolete and to is not null").join(live.select(F.col("cid").alias("to")), "to", "left_semi")
    named = lambda df, cid, kind, c: df.select(F.col(cid).alias("cid"), F.explode(c).alias("name"), F.lit(kind).alias("kind"), "at")
    names = (
        live.where("label is not null").select("cid", F.col("label").alias("name"), F.lit("pref").alias("kind"), "at")
        .unionByName(named(live, "cid", "synonym", "synonyms")).unionByName(named(live, "cid", "def", "defs"))
        .unionByName(given.where("label is not null").select(F.col("to").alias("cid"), F.col("label").alias("name"), F.lit("synonym").alias("kind"), "at")).unionByName(named(given, "to", "synonym", "synonyms"))
    )
    order = F.row_number().over(Window.partitionBy("cid").orderBy("at", "kind", "name"))
    return {"names": names.withColumn("ord", order).drop("at"), "parents": live.select(F.col("cid").alias("child"), F.explode("up").alias("parent")).distinct()}


def xml_classes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """names and parents of an OWL file's labelled classes."""
    schema = (
        "`_rdf:about` string, `rdfs:label` array<string>, `efo:alternative_term` array<string>, `efo:definition` array<string>, `skos:notation` string, "
        "`rdfs:subClassOf` array<struct<`_rdf:resource`:string, `owl:Restriction`:struct<`owl:someValuesFrom`:struct<`_rdf:resource`:string>>>>"
    )
    found = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    short = lambda c: F.element_at(F.split(c, "[/#]"), -1)
    base = found.where(F.size("`rdfs:label`") > 0).select(short(F.col("`_rdf:about`")).alias("cid"), F.col("`rdfs:label`").alias("labels"), F.col("`efo:alternative_term`").alias("alts"), F.col("`efo:definition`").alias("defs"), F.col("`rdfs:subClassOf`").alias("ups"))
    named = lambda kind, c: base.select("cid", F.explode(c).alias("name"), F.lit(kind).alias("kind"))
    ups = base.select("cid", F.explode("ups").alias("u")).select(F.col("cid").alias("child"), short(F.coalesce(F.col("u.`_rdf:resource`"), F.col("u.`owl:Restriction`.`owl:someValuesFrom`.`_rdf:resource`"))).alias("parent"))
    return {"names": named("pref", "labels").unionByName(named("synonym", "alts")).unionByName(named("def", "defs")), "parents": ups.where("parent is not null").distinct()}


def cached_lookup(terms: DataFrame, cache: DataFrame, keys: list[str], most: int, by_length: bool = True) -> DataFrame:
    """The first hits of each term in a lookup cache: shortest display first, or the server's order."""
    order = [F.length("display"), F.col("display")] if by_length else [F.col("ord")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return terms.join(cache, keys, "left").withColumn("place", place).where(F.col("place") <= most)


def plan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows of all chunks written below a folder, partitioned by chunk."""
    return spark.read.parquet(path)


def episode_facts(cases: DataFrame, key: str = "case_id", column: str = "examination") -> DataFrame:
    """One row for each fact of a case's JSON sections; a bare object is a section of one."""
    sections = F.from_json(F.col(column), "map<string,string>")
    each = cases.select(key, F.explode(sections).alias("section", "json"))
    listed = F.when(F.ltrim("json").startswith("["), F.col("json")).otherwise(F.concat(F.lit("["), F.col("json"), F.lit("]")))
    return each.select(key, "section", F.posexplode(F.from_json(listed, f"array<{FACT}>")).alias("pos", "fact")).select(key, "section", "pos", "fact.*")


def episode_records(cases: DataFrame, sections: list[str], key: str = "case_id") -> DataFrame:
    """One row for each study of the cases' JSON columns, with its place ``rid`` in the case."""
    empty = F.array().cast("array<struct<test_name:string,modality:string,findings:string,image_id:string,panel_id:string,section:string>>")

    def items(section: str):
        return F.coalesce(F.transform(F.from_json(F.col(section), f"array<{ITEM}>"), lambda x: x.withField("section", F.lit(section))), empty)

    arrays = [items(s) for s in sections]
    return cases.select(key, F.posexplode(F.concat(*arrays)).alias("rid", "item")).select(key, "rid", "item.*")
