"""Readers of files: tables, whole texts, source trees, JSON, logs, event feeds, episodes."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semid.functions.text import LANGUAGES, language_of
from semid.operators.episodes import EPISODE
from semid.operators.graphs import parse_commit_log

# Folders that a source tree's walk leaves out.
SKIPPED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target"]


def read_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: StructType | str | None = None, fmt: str = "parquet", limit_files: int | None = None) -> DataFrame:
    """A projected scan. ``limit_files`` takes the first files by path."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    paths = path if isinstance(path, list) else [path]
    if limit_files is not None:
        paths = sorted(r["file"] for r in list_files(spark, paths[0]).collect())[:limit_files]
    df = reader.load(paths)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(file, size, modified) of a folder, from metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def newest_file(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return list_files(spark, folder, glob).agg(F.max_by("file", F.struct("modified", "file")).alias("file"))


def subfolders(spark: SparkSession, folder: str) -> DataFrame:
    """The folders below ``folder`` that hold files, by name."""
    rest = F.substring_index("file", folder.rstrip("/") + "/", -1)
    return list_files(spark, folder, recursive=True).select(rest.alias("rest")).where(F.contains("rest", F.lit("/"))).select(F.substring_index("rest", "/", 1).alias("folder")).distinct()


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def source_files(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(path, rel_path, ext, language, text) of a source tree: known extensions, without vendor folders and files that are not UTF-8."""
    exts = languages or list(LANGUAGES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", root.rstrip("/") + "/", -1)
    out = raw.select("path", name.alias("rel_path"), "content").withColumn("ext", F.lower(F.substring_index("rel_path", ".", -1)))
    folders = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    kept = out.where(F.col("ext").isin(exts) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", "rel_path", "ext", language_of(F.col("ext")).alias("language"), F.decode("content", "UTF-8").alias("text"))


def git_commits(spark: SparkSession, root: str, most: int = 5000) -> DataFrame:
    """(commit_id, files) of a repository's history without merges; the log is read once, on the driver, and bounded by ``most``."""
    log = subprocess.run(["git", "-C", root, "log", "--no-merges", f"-n{most}", "--name-only", "--pretty=format:__COMMIT__"], capture_output=True, text=True, check=True).stdout
    return parse_commit_log(spark.createDataFrame([(log,)], "text string"))


def corpus(spark: SparkSession, blobs: list[DataFrame], markdown: str | None = None) -> DataFrame:
    """(text) of all blobs (text) and the folder's markdown files, without blank ones."""
    parts = [b.select("text") for b in blobs]
    if markdown:
        parts.append(spark.read.option("wholetext", True).text(f"{markdown}/*.md").select(F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.trim("text") != "")


def episodes(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """``<root>/*/episode.json``, a file for each episode or, with ``lines``, a line as ``write_episodes`` makes them, with the defaults of missing fields; unknown fields are left out."""
    raw = spark.read.schema(EPISODE).option("multiLine", not lines).json(f"{root}/*/episode.json")
    blank = {"game_seed": "", "scenario": "crashlanded", "difficulty": "strive_to_survive"}
    return raw.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in blank.items()} | {"steps": F.coalesce("steps", F.array())})


def parse_state(raw: Column) -> Column:
    """A live state's JSON with numbers coerced and defaults for what is missing."""
    s = F.from_json(raw, "colonists array<struct<name string, mood string, health string, job string>>, resources map<string,string>, research map<string,string>, season string, day string, temperature string, wealth string")
    number = lambda c, kind="double": F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
    numbers = lambda m: F.transform_values(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda _, v: number(v))
    people = F.transform(F.coalesce(s["colonists"], F.array()), lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), number(c["mood"]).alias("mood"), number(c["health"]).alias("health"), F.coalesce(c["job"], F.lit("")).alias("job")))
    return F.struct(people.alias("colonists"), numbers(s["resources"]).alias("resources"), numbers(s["research"]).alias("research_progress"), F.coalesce(s["season"], F.lit("")).alias("season"), number(s["day"], "int").alias("day"), number(s["temperature"]).alias("temperature"), number(s["wealth"]).alias("wealth"))


def event_lines(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """Server-sent lines: those that start with ``data:``, decoded. Works on streams and tables alike."""
    body = F.trim(F.substring(F.col(col), F.lit(6), F.length(col)))
    return lines.where(F.col(col).startswith("data:")).select(F.from_json(body, schema).alias("event")).select("event.*")


def split_outputs(texts: DataFrame, col: str = "value") -> DataFrame:
    """(pos, text) of outputs set apart by a line of three equals signs."""
    return texts.select(F.posexplode(F.split(col, "\n===\n")).alias("pos", "text"))


def with_step_numbers(steps: DataFrame, key: str, order: str) -> DataFrame:
    return steps.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
