"""Word-level recognition output and other text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.schemas import CONFIG, TSV_WORDS

WORD_LEVEL = "5"
#: fixed values: how lines of image names begin, and marks at a page's head
IMAGE_LINE, HEADING_MARKS = "tbocrtifs", ["༄༅། །", "༄༅"]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return words_of(spark.read.csv(path, sep="\t", header=True, quote="", schema=TSV_WORDS).withColumn("doc", F.col("_metadata.file_path")))


def words_of(raw: DataFrame) -> DataFrame:
    """Rows of words with numbers for their places; others, and rows that don't parse, go."""
    number = {c: F.expr(f"try_cast({c} as int)") for c in ("page_num", "left", "top", "width", "height")}
    rows = raw.withColumns(number).where((F.col("level") == WORD_LEVEL) & (F.trim("text") != ""))
    return rows.dropna(subset=["left", "top", "width", "height"]).withColumn("seq", F.struct(*[F.expr(f"try_cast({c} as int)").alias(c) for c in ("block_num", "par_num", "line_num", "word_num")]))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def save_config(config: DataFrame, path: str) -> bool:
    """Adds the settings of one row to those stored at ``path``, unless equal ones are; whether they were added."""
    spark = config.sparkSession
    own = config.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in config.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CONFIG])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = read_config(spark, path)
        same = [own[f.name].eqNullSafe(stored[f.name]) for f in CONFIG]
        own = own.join(stored, same, "left_anti")
    if own.isEmpty():
        return False
    own.coalesce(1).write.mode("append").json(path)
    return True


def training_rows(spark: SparkSession, paths: list[str], width: int = 1024) -> DataFrame:
    """(label, px): distinct rows of all training files, a label and ``width`` pixels a line."""
    every = None
    for path in paths:
        cells = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double").cast("int"))
        rows = spark.read.text(path).where(F.trim("value") != "").select(cells.alias("c")).where(F.size("c") == width + 1)
        rows = rows.select(F.get("c", F.lit(0)).alias("label"), F.slice("c", 2, width).alias("px"))
        every = rows if every is None else every.unionByName(rows)
    return every.distinct()


def normal_page(lines: DataFrame, keys: list[str], order: str, line: str = "value") -> DataFrame:
    """(keys, text): a recognised page without lines of image names, heading marks and the notice before it, its lines joined."""
    own = lines.where(~F.col(line).startswith(IMAGE_LINE))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat(line, F.lit("\n")).alias("__t")))), lambda s: s["__t"])
    text = F.array_join(parts, "")
    for mark in HEADING_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    text = F.replace(F.regexp_replace(text, "་{2,}\n", "་\n"), F.lit("\n"), F.lit(""))
    return own.groupBy(*keys).agg(F.regexp_replace(text, r"^This.*corrections\.", "").alias("text"))


def write_volume(pages: DataFrame, path: str, title: str) -> None:
    """Pages (name, text) in the order of their names as one text: a title, and each page under its name."""
    head = pages.sparkSession.sql("SELECT '' AS name").select("name", F.lit(title).alias("value"))
    body = pages.select("name", F.concat(F.lit("\n"), "name", F.lit("\n"), "text").alias("value"))
    head.unionByName(body).orderBy("name").select("value").coalesce(1).write.text(path)  # the pages of one volume


def merged_config(base: dict, *overrides: dict) -> dict:
    """Later settings win unless they are None; nothing that is given is changed."""
    out = dict(base)
    for o in overrides:
        out |= {k: v for k, v in o.items() if v is not None}
    return out


def read_pages(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).orderBy("path")


def write_libsvm(df: DataFrame, path: str) -> None:
    df.write.format("libsvm").save(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*.pgm") -> DataFrame:
    """(path, h, w, px): grey images as rows of bytes, 255 white; files that don't decode have nulls."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from termloom.operators.vision import decode_pgm

        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    image = decode_pgm(raw)
                    out.append((name, *image.shape, image.tobytes()))
                except ValueError:
                    out.append((name, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["path", "h", "w", "px"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, h int, w int, px binary")
