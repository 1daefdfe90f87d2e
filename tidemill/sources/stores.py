"""Readers and writers: Markdown folders, JSON with defaults, event streams as text, run logs and vector stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import fields, text as tx


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, title, type, codes, tools, updated, body of each ``.md`` file; unknown types are ``sop``."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("doc_id"), F.col("value").alias("body"), tx.front_matter(F.col("value")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    kind = F.when(at("type").isin("runbook", "sop", "incident", "spec"), at("type")).otherwise("sop")
    listed = lambda k: tx.comma_list(F.coalesce(at(k), F.lit("")))
    return rows.select("doc_id", F.coalesce(at("title"), "doc_id").alias("title"), kind.alias("type"), listed("codes").alias("codes"), listed("tools").alias("tools"), F.try_to_timestamp(at("updated")).cast("date").alias("updated"), "body")


def corpus_sections(docs: DataFrame) -> DataFrame:
    """section_id, doc_id, heading, text, index of each section; the index counts kept sections."""
    rows = docs.select("doc_id", "title", F.posexplode(tx.sections(F.col("body"))).alias("index", "s"))
    return rows.select(F.concat_ws("#", "doc_id", "s.heading").alias("section_id"), "doc_id", "title", F.col("s.heading").alias("heading"), F.col("s.body").alias("text"), "index")


def corpus_chunks(sections: DataFrame, most: int = 180) -> DataFrame:
    """chunk_id, section_id, doc_id, header, text, hash."""
    rows = sections.select("section_id", "doc_id", F.concat_ws(" › ", "title", "heading").alias("header"), F.posexplode(tx.pack_chunks(F.col("text"), most)).alias("i", "text"))
    return rows.select(F.concat_ws(":", "section_id", "i").alias("chunk_id"), "section_id", "doc_id", "header", "text", F.sha1(F.concat_ws("\n", "header", "text")).alias("hash"))


def read_json_or(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON documents; none where nothing is there. Files whose names begin with ``_`` are skipped by Spark."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def encode_events(events: DataFrame) -> DataFrame:
    """value: one frame of an event stream for each row."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}), F.lit("\n\n")).alias("value"))


def decode_events(frames: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of the frames, by their blank lines; lines that are no JSON are skipped."""
    lines = frames.select(F.explode(F.split(value, r"\r?\n")).alias("line")).where(F.col("line").startswith("data:"))
    body = F.trim(F.substring("line", 6, 1 << 30))
    return lines.where(F.try_parse_json(body).isNotNull()).select(F.from_json(body, schema).alias("e")).select("e.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new`` and those of ``old`` without their keys; columns that either lacks are null. The last row of a key in ``new`` by ``_seq``, if it has one, counts."""
    if "_seq" in new.columns:
        latest = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
        new = new.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_seq")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save_vectors(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """hash, model, vector, dealt by model; readers take the newest row of a key."""
    rows.withColumn("saved_at", F.current_timestamp()).write.mode("append").partitionBy("model").parquet(path)


def load_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Only the partition of the model is read."""
    rows = spark.read.parquet(path).where(F.col("model") == model)
    return rows.groupBy("hash", "model").agg(F.max_by("vector", "saved_at").alias("vector"))


def fingerprint(df: DataFrame, digits: int = 12) -> DataFrame:
    """One row: a digest of all rows that does not depend on their order; nulls count as a sign of their own."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in df.columns])
    h = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.substring(F.sha1(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")))), 1, digits).alias("fingerprint"))


def guardrail_rows(runs: DataFrame, column: str = "guardrails") -> DataFrame:
    """stage, rule, action, n of the JSON lists in a column; what cannot be read counts as empty."""
    parsed: Column = F.from_json(column, "array<struct<stage:string,rule:string,action:string>>")
    return runs.select(F.explode(parsed).alias("g")).groupBy("g.stage", "g.rule", "g.action").agg(F.count("*").alias("n"))


def seed_if_absent(rows: DataFrame, path: str) -> None:
    """Write the rows unless something is there."""
    rows.write.mode("ignore").parquet(path)


def seed(rows: DataFrame, path: str) -> None:
    """Write the rows in place of what is there."""
    rows.write.mode("overwrite").parquet(path)


_CORPORA: dict[tuple[str, str], DataFrame] = {}


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a Markdown folder, kept in memory until a file of it changes."""
    docs = read_markdown(spark, folder)
    version = fingerprint(docs.select("doc_id", "body")).first().fingerprint
    key = (folder, version)
    if key not in _CORPORA:
        for old in [k for k in _CORPORA if k[0] == folder]:
            _CORPORA.pop(old).unpersist()
        _CORPORA[key] = corpus_chunks(corpus_sections(docs)).cache()
    return _CORPORA[key]


def localized(sections: DataFrame, translations: DataFrame, language: str) -> DataFrame:
    """Sections (doc_id, index, heading, text) in a language where a translation (doc_id, lang, index, heading, text) has them, else as they are."""
    own = translations.where(F.col("lang") == language).select("doc_id", "index", F.col("heading").alias("_h"), F.col("text").alias("_t"))
    rows = sections.join(own, ["doc_id", "index"], "left")
    return rows.withColumns({"translated": F.col("_t").isNotNull(), "heading": F.coalesce("_h", "heading"), "text": F.coalesce("_t", "text")}).drop("_h", "_t")


def read_json_folder(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of the JSON documents of a folder but those whose names begin with an underscore, ordered by name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(folder)


def save_inbox(items: DataFrame, path: str) -> None:
    """All items in place of the old ones, the newest first: few rows, in one file."""
    items.orderBy(F.desc("published"), "id").coalesce(1).write.mode("overwrite").json(path)


def pending(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "pending")


def token_stream(lines: DataFrame, value: str = "value") -> DataFrame:
    """kind, text, prompt_tokens, completion_tokens of the lines of a model's reply, as events with ``data:`` or as JSON a line. Lines that are no JSON are skipped."""
    raw = lines.select(F.trim(F.regexp_replace(F.col(value), r"^data:", "")).alias("raw")).where(F.try_parse_json("raw").isNotNull())
    shape = "choices array<struct<delta:struct<content:string>>>, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, message struct<content:string>, done boolean, prompt_eval_count int, eval_count int"
    e = raw.select(F.from_json("raw", shape).alias("e")).select("e.*")
    text = F.coalesce(F.get("choices", F.lit(0))["delta"]["content"], F.col("message.content"), F.lit(""))
    prompt = F.coalesce("usage.prompt_tokens", "prompt_eval_count")
    completion = F.coalesce(fields.completion_tokens(F.col("usage.prompt_tokens"), F.col("usage.completion_tokens"), F.col("usage.total_tokens")), F.col("eval_count"))
    kind = F.when(prompt.isNotNull(), "usage").when(text != "", "token")
    return e.select(kind.alias("kind"), text.alias("text"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens")).where("kind is not null")


def record_runs(old: DataFrame, new: DataFrame, old_spans: DataFrame, new_spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and spans after new ones came in: a run that comes again takes the place of the old one with all its spans."""
    return upsert(old, new, ["id"]), old_spans.join(new.select(F.col("id").alias("run_id")), "run_id", "left_anti").unionByName(new_spans, allowMissingColumns=True)


def run_trace(runs: DataFrame, spans: DataFrame, run_id) -> DataFrame:
    """The spans of one run in order, each with the number of all of them."""
    own = spans.where(F.col("run_id") == run_id).join(runs.where(F.col("id") == run_id).select(F.col("id").alias("run_id"), "status"), "run_id")
    return own.withColumn("span_count", F.count("*").over(Window.partitionBy("run_id"))).orderBy("started_at", "span_id")


def write_report(results: DataFrame, path: str) -> None:
    """The cases of an evaluation as JSON and, beside it, a table of them in Markdown: few rows, in one file each."""
    results.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    cell = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("-")) for c in results.columns]
    head = [" | ".join(results.columns), " | ".join("-" for _ in results.columns)]
    lines = results.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("value"))
    spark = results.sparkSession
    spark.createDataFrame([(f"| {h} |",) for h in head], "value string").coalesce(1).unionByName(lines.coalesce(1)).coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
