"""From article files to the tables of a library."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folia.plans.library import SCHEMAS, Library
from folia.sources import esx, store

NODE = "struct<node_path:string,parent_path:string,pos:int,depth:int,tag:string,attrs:map<string,string>,raw:string,node_type:string,symbol:string,format:string>"
ITEM = f"file_path string, sha256 string, place int, article string, kind string, subkind string, number int, lib_id string, title string, text_content string, raw_xml string, statement_kind string, parent_lib_id string, constructor string, origin string, symbols array<string>, formats array<string>, nodes array<{NODE}>, error string"
#: Rows of items, and one of each file with place -1, its size, and its text if the file is new.
PARSED = f"{ITEM}, bytes long, known boolean, content string"
#: part: the folder of the generation in which the file was parsed.
VERSIONS = "path string, sha256 string, bytes long, version int, indexed_at timestamp, part string"
RUNS = "generation int, files int, unchanged int, failed int, items long, nodes long, started_at timestamp, finished_at timestamp, duration_ms long"
#: Parts beyond which the rows of all files are written anew, so that a library is not read from ever more folders.
PARTS = 16
# Statistics of an ingest in their order; of a table, or of a column of item_node that is not null.
STATISTICS = (
    "article", "mml_item", "constructor", "notation", "statement", "registration", "symbol", "format", "item_constructor_ref", "notation_symbol", "notation_constructor", "notation_format",
    "format_symbol", "constructor_definition", "constructor_definiens", "registration_relation", "item_node", "item_node.constructor_item_id", "item_node.symbol_id", "item_node.format_id",
)


@dataclass
class IngestSummary:
    generation: int
    files: int
    unchanged: int
    failed: int
    counts: dict[str, int]


def article_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256) of all .esx files at or below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.esx").option("recursiveFileLookup", True).load(path)
    return hashed(files.filter("length > 0"))


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def parse_files(files: DataFrame) -> DataFrame:
    """A row for each item; of a file that is no XML, or has no item, one row with the error.

    And a row for each file (path, content, sha256, and known if there is such a column), with
    place -1: its size and, unless it is known, its text. Known files are not parsed.
    """

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, sha256, known in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                of_file = {"file_path": path, "sha256": sha256, "place": -1, "bytes": len(content), "known": known, "content": None if known else content.decode("utf-8", "replace")}
                yield pa.RecordBatch.from_pylist([of_file], schema)
                if known:
                    continue
                rows, error = [], None
                try:
                    rows = [{"file_path": path, "sha256": sha256, "place": place, **item.row()} for place, item in enumerate(esx.shred(content, path))]
                except esx.ET.ParseError as e:
                    error = f"not well-formed: {e}"
                for row in rows:
                    for node in row["nodes"]:
                        node["attrs"] = list(node["attrs"].items())
                if not rows:
                    error = error or f"no item; tags: {sorted(esx.tag_counts(content).items(), key=lambda x: -x[1])[:25]}"
                    rows = [{"file_path": path, "sha256": sha256, "place": 0, "error": error}]
                yield pa.RecordBatch.from_pylist(rows, schema)

    known = F.col("known") if "known" in files.columns else F.lit(False)
    return files.select("path", "content", "sha256", known.alias("known")).mapInArrow(each, PARSED)


def _id(*parts) -> F.Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def library_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables, with ids made of natural keys; of items with one key the last of the last file counts.

    parsed is what parse_files returned, written or cached.

    Edges are what the markup states: a pattern belongs to the constructor that its
    absoluteconstrMMLId names, which its definition defines; absoluteorigconstrMMLId names the
    origin of a redefined one; any other node with an absoluteconstrMMLId refers to that
    constructor from its item, or puts it into its registration. Edges to constructors that no
    file has are left out until one has.
    """
    spark = parsed.sparkSession
    contents = parsed.filter("place = -1 and content is not null").select("file_path", F.col("content").alias("xml_content"))
    items = parsed.filter("place >= 0 and error is null").withColumn("article_id", _id(F.lit("article"), F.col("article")))
    same_lib = F.coalesce(F.concat(F.lit("lib:"), "lib_id"), F.concat_ws(":", F.lit("nr"), "article", "subkind", "number"))
    last = Window.orderBy(F.desc("file_path"), F.desc("place"))
    items = items.withColumn("key", F.concat_ws(":", "kind", same_lib)).withColumn("n", F.row_number().over(last.partitionBy("key"))).filter("n = 1")
    # two library ids with one (article, subkind, number): the later one has it
    items = items.withColumn("n", F.row_number().over(last.partitionBy("article", "subkind", "number"))).filter("n = 1").drop("n").withColumn("id", _id(F.lit("item"), F.col("key")))
    names = items.groupBy("article_id", F.col("article").alias("name")).agg(F.max("file_path").alias("file_path"))
    article = names.join(contents, "file_path", "left")
    nodes = items.select("id", "article_id", "kind", F.explode("nodes").alias("n")).select(F.col("id").alias("item_id"), "article_id", "kind", "n.*")
    node_id = lambda path: _id(F.lit("node"), F.col("item_id"), F.col(path))
    symbol_id = lambda c: F.when(F.col(c).isNotNull(), _id(F.lit("symbol"), F.col("article_id"), F.col(c)))
    format_id = lambda c: F.when(F.col(c).isNotNull(), _id(F.lit("format"), F.col("article_id"), F.col(c)))
    of_notation = items.filter("kind = 'notation'").select(F.col("id").alias("notation_id"), "article_id", "symbols", "formats", "constructor")
    symbols = of_notation.select("notation_id", "article_id", F.posexplode("symbols").alias("p", "text"))
    formats = of_notation.select("notation_id", "article_id", F.posexplode("formats").alias("p", "name"))
    statements = items.filter("kind = 'statement'")
    definitions = statements.select(F.col("lib_id").alias("parent_lib_id"), F.col("id").alias("definition_item_id")).dropDuplicates(["parent_lib_id"])
    constructors = items.filter("kind = 'constructor'")
    known = constructors.select(F.col("lib_id").alias("constructor_lib_id"), F.col("id").alias("constructor_item_id"))
    named = nodes.withColumn("constructor_lib_id", F.trim(F.col("attrs")["absoluteconstrMMLId"])).filter("constructor_lib_id <> ''")
    positive = F.lower(F.coalesce(F.col("attrs")["nonocc"], F.lit(""))) != "true"
    # a pattern's own constructor is no reference
    pending = named.filter(~F.col("tag").isin(*sorted(esx.PATTERN_TAGS))).select("item_id", "kind", "constructor_lib_id", F.lit("ref").alias("role"), positive.alias("is_positive"))
    node_constructor = named.join(known, "constructor_lib_id").select("item_id", "node_path", "constructor_item_id")
    in_registration = pending.filter("kind = 'registration'").join(known, "constructor_lib_id").groupBy("item_id", "constructor_item_id", "role").agg(F.bool_or("is_positive").alias("is_positive"))
    out = {
        "article": article.withColumn("id", F.col("article_id")),
        "mml_item": items,
        "statement": statements.select(F.col("id").alias("item_id"), "statement_kind", F.col("text_content").alias("statement_text")),
        "registration": items.filter("kind = 'registration'").select(F.col("id").alias("item_id"), F.col("subkind").alias("registration_kind")),
        "notation": items.filter("kind = 'notation'").join(definitions, "parent_lib_id", "left").select(F.col("id").alias("item_id"), F.col("subkind").alias("notation_kind"), "definition_item_id"),
        "constructor": constructors.select(F.col("id").alias("item_id"), F.col("subkind").alias("constructor_kind"), F.col("title").alias("short_name")),
        "item_node": nodes.join(node_constructor, ["item_id", "node_path"], "left").select(
            node_id("node_path").alias("id"), "item_id", F.when(F.col("parent_path").isNotNull(), node_id("parent_path")).alias("parent_node_id"), "node_path", "node_type",
            symbol_id("symbol").alias("symbol_id"), format_id("format").alias("format_id"), "constructor_item_id", "pos", "depth", "raw", "tag", "attrs",
        ),
        "symbol": symbols.select("article_id", "text").union(nodes.select("article_id", F.col("symbol").alias("text"))).filter("text is not null").distinct()
            .select(symbol_id("text").alias("id"), "text", F.lower("text").alias("normalized"), "article_id"),
        "format": formats.select("article_id", "name").union(nodes.select("article_id", F.col("format").alias("name"))).filter("name is not null").distinct().select(format_id("name").alias("id"), "name", "article_id"),
        "notation_symbol": symbols.select("notation_id", symbol_id("text").alias("symbol_id"), (F.col("p") + 1).alias("pos")),
        "notation_format": formats.select("notation_id", format_id("name").alias("format_id"), (F.col("p") + 1).alias("pos")),
        "notation_constructor": of_notation.withColumnRenamed("constructor", "constructor_lib_id").join(known, "constructor_lib_id").select("notation_id", "constructor_item_id", F.lit("main").alias("role")),
        "constructor_definition": constructors.join(definitions, "parent_lib_id").select(F.col("id").alias("constructor_item_id"), "definition_item_id"),
        "constructor_redefinition": constructors.select(F.col("id").alias("copy_item_id"), F.col("origin").alias("constructor_lib_id")).join(known, "constructor_lib_id").select("copy_item_id", F.col("constructor_item_id").alias("origin_item_id")),
        "registration_relation": in_registration.select(_id(F.lit("relation"), F.col("item_id"), F.col("constructor_item_id"), F.col("role")).alias("id"), F.col("item_id").alias("registration_item_id"), "constructor_item_id", "role", "is_positive"),
    }
    out = {n: _shaped(df, SCHEMAS[n]) for n, df in out.items()}
    out["item_constructor_ref"] = _shaped(resolve_references(pending.drop("kind"), Library(spark, out)), SCHEMAS["item_constructor_ref"])
    return out


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    columns = [c.strip().split(" ") for c in schema.replace("map<string,string>", "map<string;string>").split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in columns])


def resolve_references(pending: DataFrame, library: Library) -> DataFrame:
    """Edges (item, constructor, role) from references by library id: one join, once all items are known.

    Of items with one library id the one of the highest component rank counts. Edges to things
    that are no constructors are dropped, and repeated ones added up: positive if one of them is.
    """
    best = Window.partitionBy("lib_id").orderBy(F.desc_nulls_last("component_rank"), "item_id")
    known = library.view_items.filter("lib_id is not null").withColumn("n", F.row_number().over(best)).filter("n = 1")
    known = known.select(F.col("lib_id").alias("constructor_lib_id"), F.col("item_id").alias("constructor_item_id")).join(library.constructor.select(F.col("item_id").alias("constructor_item_id")), "constructor_item_id", "left_semi")
    edges = pending.join(known, "constructor_lib_id").groupBy("item_id", "constructor_item_id", "role").agg(F.bool_or("is_positive").alias("is_positive"), F.count(F.lit(1)).cast("int").alias("occurrences"))
    return edges.select(_id(F.lit("edge"), F.col("item_id"), F.col("constructor_item_id"), F.col("role")).alias("id"), "item_id", "constructor_item_id", "role", "is_positive", "occurrences")


def backfilled_types(library: Library) -> DataFrame:
    """(item node id, node_type) as the item's kind tells: symbols, then registrations, definitions, schemes, theorems."""
    kinds = library.mml_item.select(F.col("id").alias("item_id"), "kind").join(library.statement.select("item_id", "statement_kind"), "item_id", "left")
    by_item = F.when(F.col("kind") == "registration", "registrations").when(F.col("statement_kind").isin("def", "dfs"), "definitions").when(F.col("statement_kind") == "sch", "schemes").when(F.col("statement_kind") == "th", "theorems")
    rows = library.item_node.join(kinds, "item_id", "left")
    node_type = F.when(F.col("symbol_id").isNotNull(), "symbols").when(F.col("depth") == 0, F.coalesce(by_item, F.lit("no_nodes"))).otherwise("no_nodes")
    return rows.select("id", node_type.alias("node_type"))


def backfilled(library: Library) -> Library:
    """The library with node types as its items' kinds tell, for tables that were written without them."""
    types = backfilled_types(library)
    nodes = library.item_node
    return Library(library.spark, library.tables | {"item_node": nodes.drop("node_type").join(types, "id").select(*nodes.columns)})


def ingest(spark: SparkSession, source: str, target: str) -> IngestSummary:
    """Read all articles at or below source and write a new generation of the library at target.

    Files are read once. One whose content the generation before has is not parsed again: its
    rows are read from the part in which they were written. Readers see the new generation once
    it is whole; an attempt that fails leaves a folder that nothing reads, and the next one
    begins anew.
    """
    return ingest_files(spark, article_files(spark, source), target)


def ingest_files(spark: SparkSession, files: DataFrame, target: str, *, whole: bool = True) -> IngestSummary:
    """ingest() of the files (path, content, sha256). Unless they are the whole source, others keep their place."""
    started, (before, last) = time.time(), store.latest(spark, target)
    folder = store.attempt(before + 1)
    base = f"{target}/{folder}"
    none = spark.createDataFrame([], VERSIONS)
    seen = spark.read.schema(VERSIONS).parquet(f"{target}/{last}/versions") if last else none
    marked = files.join(seen.select("path", "sha256", F.lit(True).alias("known")), ["path", "sha256"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    parse_files(marked).write.parquet(f"{base}/parsed")
    scan = spark.read.schema(PARSED).parquet(f"{base}/parsed")

    found = scan.filter("place = -1").select(F.col("file_path").alias("path"), "sha256", "bytes", "known")
    old = seen.select("path", F.col("sha256").alias("last_sha"), F.col("version").alias("last"), F.col("indexed_at").alias("last_at"), F.col("part").alias("last_part"))
    versions = found.join(old, "path", "left").select(
        "path", "sha256", "bytes", F.when(F.col("known"), F.col("last")).otherwise(F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"),
        F.when(F.col("known"), F.col("last_at")).otherwise(F.current_timestamp()).alias("indexed_at"), F.when(F.col("known"), F.col("last_part")).otherwise(F.lit(folder)).alias("part"),
    )
    if not whole:
        versions = versions.unionByName(seen.join(found.select("path"), "path", "left_anti"))
    versions.write.parquet(f"{base}/versions")
    versions = spark.read.schema(VERSIONS).parquet(f"{base}/versions")

    parts = sorted(r.part for r in versions.select("part").distinct().collect())  # at most PARTS + 1
    rows = [spark.read.schema(PARSED).parquet(f"{target}/{p}/parsed").filter("place >= 0 or content is not null").withColumn("part", F.lit(p)) for p in parts]
    current = versions.select(F.col("path").alias("file_path"), "sha256", "part")
    parsed = scan.limit(0)
    for r in rows:
        parsed = parsed.unionByName(r.join(current, ["file_path", "sha256", "part"], "left_semi").drop("part"))
    if len(parts) > PARTS:
        folder = store.attempt(before + 1)
        base = f"{target}/{folder}"
        parsed.write.parquet(f"{base}/parsed")
        parsed = spark.read.schema(PARSED).parquet(f"{base}/parsed")
        versions.withColumn("part", F.lit(folder)).write.parquet(f"{base}/versions")
        versions = spark.read.schema(VERSIONS).parquet(f"{base}/versions")

    tables = library_tables(parsed)
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}")
    library = Library(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(f"{base}/{n}") for n in tables})
    counts = statistics(library)
    total = versions.count()
    fresh = scan.filter("place >= 0").agg(F.countDistinct("file_path"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("file_path")))).first()
    run = (before + 1, total, total - fresh[0], fresh[1], counts["mml_item"], counts["item_node"], started, time.time())
    run = spark.createDataFrame([run], "generation int, files int, unchanged int, failed int, items long, nodes long, s double, f double").select(
        "generation", "files", "unchanged", "failed", "items", "nodes", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("f").alias("finished_at"), ((F.col("f") - F.col("s")) * 1000).cast("long").alias("duration_ms")
    )
    if last:
        run = spark.read.schema(RUNS).parquet(f"{target}/{last}/runs").unionByName(run)
    run.coalesce(1).write.parquet(f"{base}/runs")
    store.commit(spark, target, folder)
    return IngestSummary(before + 1, total, total - fresh[0], fresh[1], counts)


def statistics(library: Library) -> dict[str, int]:
    """Rows of each table, and nodes with each kind of link, in the fixed order."""
    links = [n for n in STATISTICS if "." in n]
    of_nodes = library.item_node.agg(F.count(F.lit(1)), *[F.count(n.partition(".")[2]) for n in links]).first()
    nodes = dict(zip(["item_node", *links], of_nodes, strict=True))
    return {n: nodes[n] if n in nodes else getattr(library, n).count() for n in STATISTICS}


def run_log(spark: SparkSession, target: str) -> DataFrame:
    """All runs that were committed."""
    _, folder = store.latest(spark, target)
    return spark.read.schema(RUNS).parquet(f"{target}/{folder}/runs") if folder else spark.createDataFrame([], RUNS)


def latest_run(spark: SparkSession, target: str) -> dict | None:
    row = run_log(spark, target).orderBy(F.desc("generation")).limit(1).first()
    return row.asDict() if row else None


def attribute_count(library: Library) -> DataFrame:
    """Attributes of all nodes, by item."""
    return library.item_node.groupBy("item_id").agg(F.sum(F.size("attrs")).alias("attributes"))


def tag_diagnostics(library: Library, most: int = 25) -> DataFrame:
    return library.item_node.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(most)


