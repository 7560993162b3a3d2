"""Commands over a term store: search, recent, export, ingest.

    python -m termloom search STORE TEXT
    python -m termloom recent STORE [--count 20]
    python -m termloom export STORE [--days N | --contributor NAME] [--share]
    python -m termloom ingest STORE FOLDER
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.operators import store
from termloom.plans import export, ingest
from termloom.sources.words import read_tsv


def main(arguments: list[str] | None = None) -> str:
    """Runs one command; gives and prints its text."""
    parser = argparse.ArgumentParser(prog="termloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("search", ["text"]), ("recent", []), ("export", []), ("ingest", ["folder"])):
        command = commands.add_parser(name)
        for argument in ("store", *more):
            command.add_argument(argument)
    commands.choices["recent"].add_argument("--count", type=int, default=20)
    commands.choices["export"].add_argument("--days", type=int)
    commands.choices["export"].add_argument("--contributor")
    commands.choices["export"].add_argument("--share", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    terms, newest = store.open_terms(spark, given.store), [F.desc("date_added"), F.desc("id")]
    if given.command == "ingest":
        out = _ingest(spark, given.store, given.folder)
    elif given.command == "export":
        now = str(spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') AS t").first()["t"])
        document = export.recent_document(terms, now, given.days) if given.days else export.contributor_document(terms, given.contributor, now) if given.contributor else export.whole_document(terms, now)
        out = export.as_text(document) + (export.SHARE if given.share else "")
    else:
        found = store.search(terms, given.text, ["source_term", "target_term"], newest) if given.command == "search" else store.recent(terms, given.count, *newest)
        out = "\n".join(r["line"] for r in found.select(F.concat_ws(" → ", "source_term", "target_term").alias("line")).toLocalIterator())
    print(out)
    return out


def _ingest(spark: SparkSession, path: str, folder: str) -> str:
    """Adds the new terms of a folder of word files to the store, written beside it first."""
    terms = store.open_terms(spark, path)
    new = store.with_defaults(ingest.new_terms(read_tsv(spark, folder), terms, ["doc", "page_num"]))
    full, _ = store.insert(terms, new, ["source_term", "target_term"])
    n = terms.count()
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    full.select(*terms.columns).write.parquet(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop(path), True)
    files.rename(hadoop(beside), hadoop(path))
    return f"{spark.read.parquet(path).count() - n} new terms"


if __name__ == "__main__":
    main()
