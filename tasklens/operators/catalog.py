"""Definitions, plans and benchmark grids: drift of what is installed from what is expected, plan texts as rows, cells of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNNERS, WORKERS, MIXES = 4, (8, 16), ("enqueue", "drain", "steady", "fan-out", "barrier", "mixed-speed", "fairness")


def normalized_definition(ddl: Column) -> Column:
    """A definition in lower case, without quotes, schema, IF NOT EXISTS, default method and casts, with single spaces."""
    t = F.lower(ddl)
    for pattern, to in ((r'["`]', ""), (r"\bif not exists\b", " "), (r"\bconcurrently\b", " "), (r"\bon\s+[a-z_][a-z0-9_]*\.", "on "), (r"\busing btree\b", " "), (r"::[a-z_ ]+(\[\])?", ""), (r"[()]", " "), (r"\s*,\s*", ", "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, ";$", ""))


def drift(expected: DataFrame, installed: DataFrame) -> DataFrame:
    """name, status of definitions (name, ddl): ok, absent, drifted, or retired where nothing expects it."""
    a = expected.select("name", normalized_definition(F.col("ddl")).alias("want"))
    b = installed.select("name", normalized_definition(F.col("ddl")).alias("have"))
    status = F.when(F.col("have").isNull(), "absent").when(F.col("want").isNull(), "retired").when(F.col("want") != F.col("have"), "drifted").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def reconciled(drifted: DataFrame, rebuild: bool = False) -> DataFrame:
    """name, status, action for what is not ok."""
    action = F.when(F.col("status") == "absent", "create").when(F.col("status") == "retired", "drop").otherwise("rebuild" if rebuild else "report")
    return drifted.where("status <> 'ok'").withColumn("action", action)


def storage_parameters(tables: DataFrame) -> DataFrame:
    """table, parameter, value of each name=value of options (table, options); values in lower case without quotes or blanks."""
    pairs = tables.select("table", F.explode(F.filter(F.split("options", r"\s*,\s*"), lambda x: x != "")).alias("pair"))
    return pairs.select("table", F.lower(F.trim(F.regexp_extract("pair", r"^([^=]*)", 1))).alias("parameter"), F.lower(F.trim(F.regexp_replace(F.regexp_extract("pair", r"^[^=]*=(.*)$", 1), "'", ""))).alias("value"))


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, bytes, files of tables by path, from the files' own metadata; no row is read."""
    made = None
    for name, path in sorted(paths.items()):
        files = spark.read.format("binaryFile").load(path).select(F.lit(name).alias("table"), "length")
        made = files if made is None else made.unionByName(files)
    return made.groupBy("table").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def table_schema(df: DataFrame, name: str) -> DataFrame:
    """name, ddl of each column of a frame, to be compared with drift."""
    return df.sparkSession.createDataFrame([(f"{name}.{f.name}", f.dataType.simpleString()) for f in df.schema], "name string, ddl string")


# plan texts


def plan_nodes(lines: DataFrame) -> DataFrame:
    """cell, line_no, depth, node, rows, index, time_ms, buffers of the node lines of plan texts (cell, line_no, text)."""
    t = F.col("text")
    node = F.regexp_extract(t, r"^\s*(?:->\s+)?([A-Z][A-Za-z ]*?)(?: using \S+)?(?: on \S+)?(?: \S+)?\s+\(cost=", 1)
    number = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("double")
    hits = lines.join(lines.select("cell", (F.col("line_no") - 1).alias("line_no"), F.regexp_extract("text", r"Buffers: shared hit=(\d+)", 1).try_cast("bigint").alias("buffers")), ["cell", "line_no"], "left")
    made = hits.select(
        "cell", "line_no", (F.length(t) - F.length(F.ltrim(t))).alias("depth"), node.alias("node"), number(r"actual time=[\d.]+\.\.[\d.]+ rows=([\d.]+)").cast("bigint").alias("rows"),
        F.nullif(F.regexp_extract(t, r" using (\S+)", 1), F.lit("")).alias("index"), number(r"actual time=[\d.]+\.\.([\d.]+)").alias("time_ms"), "buffers",
    )
    return made.where("node <> ''")


def plan_summary(lines: DataFrame) -> DataFrame:
    """cell, root, scans, sorted, planning_ms, execution_ms of each plan text."""
    nodes = plan_nodes(lines).groupBy("cell").agg(F.min_by("node", "line_no").alias("root"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("node").contains("Scan"), F.col("node")))), ",").alias("scans"), F.max(F.col("node") == "Sort").alias("sorted"))
    times = lines.groupBy("cell").agg(*[F.max(F.regexp_extract("text", rf"{w} Time: ([\d.]+) ms", 1).try_cast("double")).alias(n) for w, n in (("Planning", "planning_ms"), ("Execution", "execution_ms"))])
    return nodes.join(times, "cell")


def cte_lines(lines: DataFrame, name: str) -> DataFrame:
    """cell, line_no of the subtree under "CTE name": the lines behind it that stand deeper, up to the first that does not."""
    depth = F.length("text") - F.length(F.ltrim("text"))
    w = Window.partitionBy("cell").orderBy("line_no")
    is_head = F.trim("text") == f"CTE {name}"
    marked = lines.select("cell", "line_no", depth.alias("depth"), is_head.alias("is_head")).withColumn("head_depth", F.last(F.when(F.col("is_head"), F.col("depth")), True).over(w))
    left = marked.withColumn("past", F.max(F.when(~F.col("is_head") & (F.col("depth") <= F.col("head_depth")), 1).otherwise(0)).over(w))
    return left.where("head_depth IS NOT NULL AND NOT is_head AND past = 0").select("cell", "line_no")


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def any_class(sql: Column) -> Column:
    """A statement without its predicate on the executor class."""
    return F.regexp_replace(sql, r"\s+AND \(executor_class = \S+ OR executor_class = ''\)", "")


def pinned_token(sql: Column, token: str) -> Column:
    return F.replace(sql, F.lit("$token"), quoted(F.lit(token)))


def in_schema(dsn: Column, schema: str) -> Column:
    return F.concat(dsn, F.when(dsn.contains("?"), "&").otherwise("?"), F.lit(f"search_path={schema}"))


# grids


def benchmark_cells(spark: SparkSession, depths: tuple[int, ...], workers: tuple[int, ...] = WORKERS, mixes: tuple[str, ...] = ("drain", "enqueue", "steady"), indexes: tuple[str, ...] = ("full", "correctness-only")) -> DataFrame:
    """Every combination of a few short lists, by name."""
    made = spark.range(1)
    for name, values in (("mix", mixes), ("depth", depths), ("workers", workers), ("index", indexes)):
        made = made.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    made = made.drop("id")
    return made.withColumn("cell", F.format_string("%s_d%d_w%d_%s", "mix", "depth", "workers", "index"))


def explained_cells(variants: DataFrame, statements: DataFrame) -> DataFrame:
    """variant, statement pairs of short lists; a variant's `only` keeps it to one statement."""
    return variants.crossJoin(statements).where("only IS NULL OR only = statement").select("variant", "statement")


def sorted_cells(cells: DataFrame) -> DataFrame:
    return cells.orderBy("condition", "predicate", "variant")


def total_jobs(rows: Column, children: Column, barrier: Column) -> Column:
    return rows * (1 + children) + F.when(barrier, rows).otherwise(0)


def connections(runners: Column, workers: Column, overhead: int) -> Column:
    return runners * (workers + 1) + overhead
