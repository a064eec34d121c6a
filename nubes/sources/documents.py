"""Documents as partitioned Parquet: points by document and cloud, a table of
documents with format version and metadata, a catalogue of fields, and each
document's tool log. A set of documents is a folder; a root may be one or hold
several.

Each save has a folder in each of the four tables (``points/save=...`` and so
on), and a manifest lists the saves that count (``manifest``). A document is
read from the latest save that has it, its log from all. So a save becomes
visible as a whole, an edit writes only the documents that it touches, and
earlier versions can still be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..model import FORMAT_VERSION, field_types
from ..operators.grid import with_curve
from ..operators.labels import remap_by
from ..operators.schema import matching_fields, schema_from_json
from .manifest import commit, file_system, new_save, read_manifest

CATALOG = "doc_name string, cloud_id string, field_name string, field_type string, width int, schema_name string, schema_json string"
LOG = "doc_name string, entry string"
DOCUMENTS = "doc_name string, format_version int, meta map<string,string>"
KEYS = ("save", "doc_name", "cloud_id")


def _saved(spark: SparkSession, root: str, kind: str, columns: str, saves: list[dict], partitions: tuple[str, ...] = ("save",)) -> DataFrame:
    """The rows of one table in these saves, with the column ``save``."""
    own = [x["save"] for x in saves if kind in x["tables"]]
    schema = StructType.fromDDL(columns) if isinstance(columns, str) else columns
    for c in partitions:  # as text, whatever the names look like
        schema = StructType([*schema.fields, StructField(c, StringType())])
    if not own:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{kind}/save={x}" for x in own]
    return spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*paths)


def _live(spark: SparkSession, root: str, saves: list[dict]) -> DataFrame:
    """``doc_name, save, format_version, meta``: each document's latest save."""
    order = F.create_map(*(F.lit(v) for n, x in enumerate(saves) for v in (x["save"], n))) if saves else F.create_map(F.lit(""), F.lit(0))
    docs = _saved(spark, root, "documents", DOCUMENTS, saves).withColumn("_n", order[F.col("save")])
    return docs.groupBy("doc_name").agg(F.max_by(F.struct("save", "format_version", "meta"), "_n").alias("d")).select("doc_name", "d.*")


def _points(spark: SparkSession, root: str, saves: list[dict]) -> DataFrame:
    """All saved points with ``save``; fields that a save lacks are null there.
    The columns come from the manifest, no file is opened for them."""
    fields: dict[str, StructField] = {}
    for x in saves:
        for f in StructType.fromJson(x["schema"]).fields if x.get("schema") else ():
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"field {f.name} is {fields[f.name].dataType.simpleString()} in one save and {f.dataType.simpleString()} in another")
    data = [f for n, f in fields.items() if n not in KEYS]
    return _saved(spark, root, "points", StructType(data), saves, KEYS)


def _write(points: DataFrame, catalog: DataFrame, docs: DataFrame, log: DataFrame | None, root: str) -> dict:
    """Write a save that nothing refers to yet; its entry for the manifest."""
    if "save" in points.columns:
        raise ValueError("points can't have a field named save")
    save = new_save()
    schema = StructType([StructField(f.name, f.dataType, True, f.metadata) for f in points.schema.fields])
    points.write.partitionBy("doc_name", "cloud_id").parquet(f"{root}/points/save={save}")
    catalog.select("doc_name", "cloud_id", "field_name", "field_type", "width", "schema_name", "schema_json").write.parquet(f"{root}/field_catalog/save={save}")
    tables = ["points", "field_catalog", "documents"]
    if log is not None:
        log.select("doc_name", "entry").write.parquet(f"{root}/tool_log/save={save}")
        tables.append("tool_log")
    docs.select("doc_name", "format_version", "meta").write.parquet(f"{root}/documents/save={save}")
    return {"save": save, "tables": tables, "schema": schema.jsonValue()}


def write_documents(points: DataFrame, root: str, schemas: dict[str, tuple[str, str]] | None = None, meta: dict[str, str] | None = None, log: DataFrame | None = None, cluster: int = 0) -> int:
    """Points need ``doc_name`` and ``cloud_id``. ``schemas`` gives a semantic
    field's schema name and JSON; ``log`` (doc_name, entry) is the tool log that
    is kept with the documents. A name that the set already has is an error.
    With ``cluster`` points are dealt out over so many ranges of a space-filling
    curve and sorted along it, so that the files' statistics let box and radius
    queries pass over what lies elsewhere. Returns the number of the set's new version."""
    spark = points.sparkSession
    version, saves = read_manifest(spark, root)
    clouds = points.select("doc_name", "cloud_id").distinct()
    taken = clouds.join(_live(spark, root, saves), "doc_name", "left_semi").limit(1).collect() if saves else ()
    if taken:
        raise ValueError(f"document {taken[0].doc_name} exists")
    rows = [(n, k, *(schemas or {}).get(n, (None, None))) for n, k in field_types(points).items()]
    kinds = spark.createDataFrame(rows, "field_name string, field_type string, schema_name string, schema_json string")
    widths = F.when(F.col("field_type").isin("COLOR", "NORMAL"), 3).otherwise(1)
    cat = clouds.crossJoin(F.broadcast(kinds)).withColumn("width", widths)
    names = clouds.select("doc_name").distinct()
    own = log.join(names, "doc_name", "left_semi") if log is not None else None
    info = F.create_map(*(F.lit(x) for kv in (meta or {"type": "Document"}).items() for x in kv))
    docs = names.select("doc_name", F.lit(FORMAT_VERSION).alias("format_version"), info.alias("meta"))
    if cluster:
        columns = points.columns
        points = with_curve(points, "_curve").repartitionByRange(cluster, "doc_name", "cloud_id", "_curve").sortWithinPartitions("doc_name", "cloud_id", "_curve").select(columns)
    return commit(spark, root, version, [*saves, _write(points, cat, docs, own, root)])


def _checked(docs: DataFrame, newer_only: bool) -> DataFrame:
    bad = F.col("format_version") > FORMAT_VERSION if newer_only else F.col("format_version") != FORMAT_VERSION
    fail = F.raise_error(F.concat(F.lit("format version "), F.col("format_version"))).cast("int")
    return docs.withColumn("format_version", F.when(bad, fail).otherwise(F.col("format_version")))


def _plain(path: Column) -> Column:
    """A path with one slash after its scheme."""
    return F.regexp_replace(path, "^([a-zA-Z0-9]+):/+", "$1:/")


def list_documents(spark: SparkSession, *roots: str) -> DataFrame:
    """``doc_name, format_version, meta, root`` of the documents in the roots and
    one level below them: the first set that has a name wins, sets at a root
    before those below it; newer versions are an error. However many sets there
    are, one scan reads the manifests and one the documents."""
    seen, order = [], []
    for i, r in enumerate(roots):
        for depth, pattern in ((0, r), (1, f"{r}/*")):
            p, fs = file_system(spark, f"{pattern}/manifests")
            if fs.globStatus(p):
                seen.append(pattern)
                base, _ = file_system(spark, r)
                order.append((fs.makeQualified(base).toString(), depth, i))
    if not seen:
        return spark.createDataFrame([], f"{DOCUMENTS}, root string")
    texts = spark.read.text([f"{x}/manifests/*.json" for x in seen], wholetext=True)
    at = F.regexp_extract("_metadata.file_path", "^(.*)/manifests/([0-9]+)[.]json$", 1)
    number = F.regexp_extract("_metadata.file_path", "^(.*)/manifests/([0-9]+)[.]json$", 2).cast("long")
    last = texts.select(_plain(at).alias("root"), number.alias("number"), "value").groupBy("root").agg(F.max_by("value", "number").alias("value"))
    saves = last.select("root", F.posexplode(F.from_json("value", "array<struct<save:string>>")).alias("_n", "s")).select("root", "_n", "s.save")
    docs = spark.read.schema(DOCUMENTS).parquet(*[f"{x}/documents/save=*" for x in seen])
    path = F.col("_metadata.file_path")
    docs = docs.select("*", _plain(F.regexp_extract(path, "^(.*)/documents/save=([^/]+)/[^/]*$", 1)).alias("root"), F.regexp_extract(path, "^(.*)/documents/save=([^/]+)/[^/]*$", 2).alias("save"))
    live = docs.join(saves, ["root", "save"]).groupBy("root", "doc_name").agg(F.max_by(F.struct("format_version", "meta"), "_n").alias("d")).select("doc_name", "d.*", "root")
    bases = spark.createDataFrame(order, "base string, _depth int, _nth int").withColumn("base", _plain(F.col("base")))
    above = F.regexp_replace("root", "/[^/]*$", "")
    placed = live.join(F.broadcast(bases), F.when(F.col("_depth") == 0, F.col("root")).otherwise(above) == F.col("base"))
    rank = F.row_number().over(Window.partitionBy("doc_name").orderBy("_depth", "_nth", "root"))
    return _checked(placed, True).withColumn("_r", rank).where("_r = 1").select("doc_name", "format_version", "meta", "root")


def read_documents(spark: SparkSession, root: str, *names: str, version: int | None = None) -> DataFrame:
    """The points of documents (all without names), as they are or were in an
    earlier version of the set; format versions must match."""
    saves = read_manifest(spark, root, version)[1]
    docs, points = _checked(_live(spark, root, saves), False), _points(spark, root, saves)
    if names:
        docs, points = docs.where(F.col("doc_name").isin(*names)), points.where(F.col("doc_name").isin(*names))
    same = docs.where("format_version IS NOT NULL").select("doc_name", "save")
    return points.join(same, ["doc_name", "save"], "left_semi").drop("save")


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The catalogue of fields of the documents."""
    saves = read_manifest(spark, root, version)[1]
    cat = _saved(spark, root, "field_catalog", CATALOG, saves)
    return cat.join(_live(spark, root, saves).select("doc_name", "save"), ["doc_name", "save"], "left_semi").drop("save")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """``doc_name, entry`` of the documents' tool logs."""
    return _saved(spark, root, "tool_log", LOG, read_manifest(spark, root)[1]).drop("save")


def update_documents(spark: SparkSession, root: str, field: str, name: str, old: Column, new_json: str, pairs: DataFrame) -> int:
    """Edit a schema in a set: every document whose ``field`` uses the schema
    ``name`` with the classes ``old`` (a literal array of struct<id, name,
    color>) gets its labels remapped by a table (old, new, seq) and the new
    classes in the catalogue. Only these documents are read and written, to a
    save of their own; all other files stay as they are. Returns the number of
    the set's new version, the present one if no document uses the schema."""
    version, saves = read_manifest(spark, root)
    cat, live = read_catalog(spark, root), _live(spark, root, saves)
    own = cat.where((F.col("field_name") == field) & F.col("schema_json").isNotNull()).withColumn("classes", schema_from_json(F.col("schema_json")))
    hit = matching_fields(own, name, old).select("doc_name").distinct()
    if not hit.limit(1).count():
        return version
    points = _points(spark, root, saves).join(live.join(hit, "doc_name", "left_semi").select("doc_name", "save"), ["doc_name", "save"], "left_semi").drop("save")
    json = F.when((F.col("field_name") == field) & (F.col("schema_name") == name), F.lit(new_json)).otherwise(F.col("schema_json"))
    edited = remap_by(points, field, pairs).select(points.columns)
    entry = _write(edited, cat.join(hit, "doc_name", "left_semi").withColumn("schema_json", json), live.join(hit, "doc_name", "left_semi"), None, root)
    return commit(spark, root, version, [*saves, entry])


def scan_schemas(spark: SparkSession, root: str) -> DataFrame:
    """``key, schema_name, schema_json`` of every semantic field that has a
    schema; points are not read."""
    cat = read_catalog(spark, root).where("field_type = 'SEMANTIC' AND schema_json IS NOT NULL")
    return cat.select(F.concat_ws("/", "doc_name", "cloud_id", "field_name", "schema_name").alias("key"), "doc_name", "schema_name", "schema_json")


def new_documents(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known, "doc_name", "left_anti")


def duplicate_names(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_names(files: DataFrame, known: DataFrame, extensions: tuple[str, ...] = ("ply", "npy", "npz", "h5", "hdf5")) -> DataFrame:
    """``path, doc_name`` for files to be imported: the file's name without a
    known extension, with the next free ``_%03d`` where it is taken. Files of
    one base name, in path order, share out its free numbers."""
    base = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), rf"\.({'|'.join(extensions)})$", "")
    by = Window.partitionBy("base")
    want = files.select("path", base.alias("base")).withColumn("at", F.row_number().over(by.orderBy("path")) - 1)
    plain = known.select(F.col("doc_name").alias("base"), F.lit(-1).alias("used"))
    number = F.regexp_extract("doc_name", r"^(.*)_(\d{3})$", 2)
    counted = known.where(number != "").select(F.regexp_extract("doc_name", r"^(.*)_(\d{3})$", 1).alias("base"), number.cast("int").alias("used"))
    used = plain.unionByName(counted).distinct()
    # so many numbers, from -1 on, are free below a used one; the k-th free number lies beyond the used ones with k free ones below them or fewer
    free_below = used.withColumn("at", F.col("used") + 2 - F.row_number().over(by.orderBy("used"))).select(F.lit(None).cast("string").alias("path"), "base", "at", F.lit(1).alias("_used"))
    both = want.select("path", "base", "at", F.lit(0).alias("_used")).unionByName(free_below)
    passed = F.sum("_used").over(by.orderBy("at", F.desc("_used")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = both.withColumn("n", F.col("at") - 1 + passed).where("_used = 0")
    return named.select("path", F.when(F.col("n") < 0, F.col("base")).otherwise(F.format_string("%s_%03d", "base", F.col("n").cast("int"))).alias("doc_name"))


def add_cloud(points: DataFrame, cloud: DataFrame, cloud_id: str) -> DataFrame:
    if points.where(F.col("cloud_id") == cloud_id).limit(1).count():
        raise ValueError(f"cloud {cloud_id} exists")
    return points.unionByName(cloud.withColumn("cloud_id", F.lit(cloud_id)), allowMissingColumns=True)


def remove_cloud(points: DataFrame, cloud_id: str) -> DataFrame:
    return points.where(F.col("cloud_id") != cloud_id)


def item_id(kind: str, number: int) -> str:
    """Upper-case letters of the type and a counter, as in PCD_0001."""
    return "".join(c for c in kind if c.isupper()) + f"_{number:04d}"


def item_id_of(kind: Column, number: Column) -> Column:
    """As item_id, for columns."""
    return F.concat(F.regexp_replace(kind, "[^A-Z]", ""), F.format_string("_%04d", number))


def export_regions(points: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """One folder for each chunk and region, with the chosen columns; what has
    no region goes to the chunk's folder of region -1. Rows of a folder are
    brought together first, large ones in parts, so that files do not multiply
    with the tasks."""
    out = points.withColumn("region_id", F.coalesce("region_id", F.lit(-1)))
    if columns:
        out = out.select("chunk_id", "region_id", *columns)
    out.hint("rebalance", "chunk_id", "region_id").write.partitionBy("chunk_id", "region_id").parquet(path)


def split_by_label(points: DataFrame, label: str, path: str) -> None:
    points.withColumn("label_id", F.col(label)).write.partitionBy("label_id").parquet(path)


def join_segments(spark: SparkSession, path: str, color: str | None = None) -> DataFrame:
    """Read split segments back with ``labels``, the segment's ordinal; colours
    above 1 in a segment are scaled to the unit range."""
    p = spark.read.parquet(path)
    # a row a segment, numbered in one task; Spark broadcasts it if it is small
    order = p.select("label_id").distinct().select("label_id", (F.row_number().over(Window.orderBy("label_id")) - 1).cast("int").alias("labels"))
    p = p.join(order, "label_id")
    if color:
        top = p.groupBy("label_id").agg(F.max(F.array_max(color)).alias("_top"))
        p = p.join(top, "label_id").withColumn(color, F.when(F.col("_top") > 1, F.transform(color, lambda v: v / 255)).otherwise(F.col(color))).drop("_top")
    return p.drop("label_id")
