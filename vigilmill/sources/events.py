"""Readers of event logs, corpora and catalogs with fixed schemas, and their sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "hook_event_name string, session_id string, ts timestamp, tool_name string, tool_use_id string, prompt string, cwd string, tool_input string, tool_response string"
KNOWN = ("SessionStart", "UserPromptSubmit", "PreToolUse", "PostToolUse", "Stop")
TEXT_ROW = "text string, label string, source string, split string"


def read_lines(spark: SparkSession, path: str, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of JSON lines; a rejected row keeps its text.  Blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.where("r._bad is null").select("r.*").drop("_bad"), lines.where("r._bad is not null").select(F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def tolerant(spark: SparkSession, path: str, schema: str, key: list[str], order: list[str] | None = None, keep=None) -> DataFrame:
    """Rows that parse as objects (and meet the condition `keep`), one for each key, sorted by `order` (the key, if not told)."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return (rows.where(keep) if keep is not None else rows).dropDuplicates(key).orderBy(*(order or key))


def optional(spark: SparkSession, path: str, schema: str = TEXT_ROW) -> DataFrame:
    """The rows of a corpus, or none if it is missing."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def corpus(*parts: DataFrame) -> DataFrame:
    """Union of corpora by name, one row for each text, with a default split."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.withColumn("split", F.coalesce("split", F.lit("test"))).dropDuplicates(["text"])


def append_events(events: DataFrame, path: str) -> None:
    """Append with a gapless sequence in each session that goes on from what is stored; by ts, then tool_use_id."""
    spark = events.sparkSession
    w = Window.partitionBy("session_id").orderBy("ts", "tool_use_id")
    fresh = events.withColumn("sequence", F.row_number().over(w))
    try:
        last = spark.read.parquet(path).groupBy("session_id").agg(F.max("sequence").alias("_last"))
    except AnalysisException:
        last = spark.createDataFrame([], "session_id string, _last int")
    numbered = fresh.join(last, "session_id", "left").withColumn("sequence", F.col("sequence") + F.coalesce("_last", F.lit(0))).drop("_last")
    numbered.write.mode("append").parquet(path)


def manifest_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, mismatch, missing or unlisted; manifest: path (from the folder on), sha256."""
    root = folder.rstrip("/").removeprefix("file:") + "/"
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(inside.alias("path"), F.sha2("content", 256).alias("found"))
    files = files.select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "found")
    state = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("mismatch")
    return manifest.join(files, "path", "full").select("path", state.alias("state"))


def export_feed(items: DataFrame) -> DataFrame:
    """(name, feed): one JSON feed a name, its indicators that are not revoked, in order of kind and value; aliases (rows with a group that is not their value) are left out.

    items: name, kind, value, status, group.
    """
    kept = items.where("status <> 'revoked' and (`group` is null or `group` = value)")
    rows = F.array_sort(F.collect_list(F.struct("kind", "value", "status")))
    return kept.groupBy("name").agg(F.to_json(F.struct(F.first("name").alias("name"), rows.alias("indicators"))).alias("feed"))


FEED = "name string, indicators array<struct<value:string,kind:string,status:string>>, fingerprints array<struct<text:string,status:string>>"


def import_feed(lines: DataFrame, column: str = "value", most: int = 10_000, longest: int = 2_048) -> tuple[DataFrame, DataFrame]:
    """(taken, skipped) indicators of JSON feeds: value, kind (exact by default), status (observed by default); skipped rows say why.

    A feed that does not parse, an empty or too long value, a value with blanks and what comes after `most` of a feed are skipped.
    """
    fed = lines.select(F.col(column).alias("line"), F.from_json(column, FEED).alias("f"))
    bad = fed.where("f is null or f.indicators is null").select(F.lit(None).cast("string").alias("name"), F.left("line", F.lit(200)).alias("value"), F.lit("not a feed").alias("reason"))
    rows = fed.where("f.indicators is not null").select("f.name", F.posexplode("f.indicators").alias("n", "i"))
    value = F.lower(F.trim("i.value"))
    reason = F.when(F.col("n") >= most, "too many").when(value.isNull() | (value == ""), "empty").when(F.length(value) > longest, "too long").when(value.contains(" "), "blanks")
    kind = F.coalesce("i.kind", F.lit("exact"))
    reason = F.coalesce(reason, F.when(~kind.isin("exact", "domain"), "kind"))
    told = rows.select("name", value.alias("value"), kind.alias("kind"), F.coalesce("i.status", F.lit("observed")).alias("status"), reason.alias("reason"))
    skipped = told.where("reason is not null").select("name", "value", "reason").unionByName(bad)
    return told.where("reason is null").drop("reason").dropDuplicates(["kind", "value"]), skipped


def case_grid(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A grid of cases, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def responses(nested: DataFrame) -> DataFrame:
    """(server, instance, data, model, response) of servers > instances > datas > responses by model.

    nested: server, instances array<struct<name, datas array<struct<id, responses map<string, string>>>>>.
    """
    i = nested.select("server", F.explode_outer("instances").alias("i"))
    d = i.select("server", F.col("i.name").alias("instance"), F.explode_outer("i.datas").alias("d"))
    return d.select("server", "instance", F.col("d.id").alias("data"), F.explode_outer("d.responses").alias("model", "response"))


def append_scores(scores: DataFrame, path: str) -> None:
    """Append (key, score) rows that the cache lacks; the first score of a key stays."""
    spark = scores.sparkSession
    try:
        known = spark.read.parquet(path).select("key")
    except AnalysisException:
        known = spark.createDataFrame([], "key string")
    scores.dropDuplicates(["key"]).join(known, "key", "left_anti").write.mode("append").parquet(path)


def save_vectors(vectors: DataFrame, path: str, embedder: str) -> None:
    """Vectors with the embedder's name in every row, so that a reader can refuse others."""
    vectors.withColumn("embedder", F.lit(embedder)).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, embedder: str) -> DataFrame:
    """The vectors of a folder; refused if another embedder made any."""
    found = spark.read.parquet(path)
    others = found.where(~F.col("embedder").eqNullSafe(F.lit(embedder))).select("embedder").limit(1).collect()
    if others:
        raise ValueError(f"made by {others[0][0]}, not by {embedder}")
    return found.drop("embedder")


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """(source, report): a SARIF 2.1.0 report a source; findings: source, rule, level, message, uri.  Results are in order of rule, uri and message."""
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule", "uri", F.col("message").alias("m"), F.to_json(result).alias("r")))), lambda x: x["r"])
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.to_json(F.struct(r.alias("id"))))
    report = F.concat(
        F.lit(f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":['), F.array_join(rules, ","),
        F.lit(']}},"results":['), F.array_join(ordered, ","), F.lit("]}]}"),
    )
    return findings.groupBy("source").agg(report.alias("report"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(line): rows as lines of a markdown table, bars in cells escaped, nulls as a dash."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), F.lit("|"), F.lit("\\|")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def tool_catalogs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tools, bad): name and description of the tools in JSON lists, one file a server; files that are no such list."""
    kind = "array<struct<name:string,description:string>>"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", kind).alias("tools"))
    return files.where("tools is not null").select("file", F.inline("tools")), files.where("tools is null").select("file")
