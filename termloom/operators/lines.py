"""Entries that run over several lines, and entries from placed blocks of text.

Lines come as rows of (keys, order, line); a page's lines are sorted once, by a window
over its keys, and an entry is a run of them.  Blank lines are left out, null ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions import parse as P
from termloom.functions.text import SHAD, TIBETAN, has_tibetan
from termloom.operators.layout import leaders

#: fixed values: a gap between columns, what a block may stand left of the next column's start, and a row's height
COLUMN_GAP, COLUMN_SLACK, ROW_GAP = 30.0, 20.0, 3.0


def text_lines(pages: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, at, line): the lines of each page's text that aren't blank, stripped."""
    lines = pages.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    return lines.withColumn("line", P.strip(F.col("line"))).where("line <> ''")


def _in_order(value: Column, keep: Column, order: str) -> Column:
    """The kept values of a group, by order."""
    return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda s: s["v"])


def parsed_entries(lines: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """(keys, entry, english, subject, term, definition): a line with English columns begins an entry, others continue its English or its definition."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = lines.withColumn("p", P.parse_line(F.col("line"))).withColumn("head", F.col("p.english") != "")
    own = own.withColumn("entry", F.sum(F.col("head").cast("int")).over(w)).where("entry > 0")
    line, more = F.col("line"), ~F.col("head")
    to_english = more & ~has_tibetan(line) & P.starts_with_lower_case(line)
    first = lambda c: F.max(F.when(F.col("head"), F.col(f"p.{c}")))
    tail = lambda keep: F.array_join(_in_order(F.concat(F.lit(" "), line), keep, order), "")
    return own.groupBy(*keys, "entry").agg(
        F.concat(first("english"), tail(to_english)).alias("english"), first("subject").alias("subject"),
        first("term").alias("term"), F.concat(first("definition"), tail(more & ~to_english)).alias("definition"),
    )


def rebuilt_lines(lines: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """(keys, at, line): broken lines put together again.

    A line that begins with a Latin letter, or a page's first, begins a row of four
    columns; the others are added to the column that their script tells: pure Tibetan
    ones to the definition, if the term has begun and they hold a shad or are long.
    """
    w = W.partitionBy(*keys).orderBy(order)
    line = F.col("line")
    own = lines.withColumn("head", P.starts_with_english(line) | (F.row_number().over(w) == 1))
    own = own.withColumn("entry", F.sum(F.col("head").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("cells", P.content_columns(line))
    latin, tibetan, more = line.rlike("[a-zA-Z]"), has_tibetan(line), ~F.col("head")
    begun = F.when(F.col("head"), F.col("cells.tibetan") != "").otherwise(tibetan).cast("int")
    inside = W.partitionBy(*keys, "entry").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("begun", F.coalesce(F.max(begun).over(inside), F.lit(0)) == 1)
    parts = F.split(line, r"\s{2,}")
    several = F.size(parts) > 1
    of_script = lambda wanted: F.array_join(F.filter(parts, wanted), " ")
    mixed = more & (latin == tibetan)
    to_definition = more & tibetan & ~latin & F.col("begun") & (line.contains(SHAD) | (F.length(line) > 30))
    pieces = {
        "e": F.when(F.col("head"), F.col("cells.english")).when(more & latin & ~tibetan, line).when(mixed & several, of_script(lambda p: p.rlike("[a-zA-Z]") & ~p.rlike(TIBETAN))).when(mixed & ~tibetan, line),
        "s": F.when(F.col("head"), F.col("cells.subject")),
        "t": F.when(F.col("head"), F.col("cells.tibetan")).when(more & tibetan & ~latin & ~to_definition, line).when(mixed & several, of_script(lambda p: p.rlike(TIBETAN))).when(mixed & tibetan, line),
        "d": F.when(to_definition, line),
    }
    own = own.withColumns(pieces)
    cell = lambda c: P.strip(F.array_join(_in_order(F.col(c), F.col(c) != "", order), " "))
    put = own.groupBy(*keys, "entry").agg(F.min(order).alias(order), *[cell(c).alias(c) for c in pieces])
    return put.select(*keys, order, F.concat_ws(" ", *pieces).alias("line"))


def column_entries(lines: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """(keys, at, english, subject, term, definition) of rebuilt lines; lines up to the next with English at its start continue the definition."""
    w = W.partitionBy(*keys).orderBy(order)
    own = lines.withColumn("line", P.strip(F.col("line")))
    begins = P.is_column_english(P.clean_english_column(P.strip(F.left("line", F.lit(25)))))
    own = own.withColumn("part", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("p", P.detect_columns(F.col("line")))
    rest = F.collect_list("line").over(W.partitionBy(*keys, "part").orderBy(order).rowsBetween(1, W.unboundedFollowing))
    own = own.withColumn("rest", rest).where("p is not null")
    definition = F.array_join(F.filter(F.concat(F.array("p.definition"), F.col("rest")), lambda x: x != ""), " ")
    return own.select(*keys, order, "p.english", "p.subject", "p.term", P.strip(definition).alias("definition"))


def two_line_entries(lines: DataFrame, keys: list[str], order: str = "at", english_end: int = 25, subject_end: int = 35) -> DataFrame:
    """(keys, at, english, subject, term, definition) of English terms that run over two lines of fixed columns."""
    w = W.partitionBy(*keys).orderBy(order)
    own = lines.withColumn("next", F.lead("line").over(w))
    first, second = F.col("line"), F.col("next")
    english = lambda c: P.clean_english_column(P.strip(F.left(c, F.lit(english_end))))
    body = P.strip(P.from_place(second, F.lit(subject_end)))
    found = ~P.has_content(P.strip(P.from_place(first, F.lit(english_end)))) & P.is_column_english(english(first)) & P.is_column_english(english(second)) & P.has_other_script(body)
    subject = P.strip(F.substring("next", english_end + 1, subject_end - english_end))
    own = own.where(found).withColumn("p", P.entry(F.concat_ws(" ", english(first), english(second)), subject, P.split_by_position(body)))
    return own.select(*keys, order, "p.*")


def placed_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` (keys, text, x, y) with their row and column numbers on the page, from 0.

    A row takes what stands up to ROW_GAP below its first block, a column begins over
    COLUMN_GAP right of the one before it, and a block is in the first column whose
    start is less than COLUMN_SLACK left of it.  Every page has as many numbers as places,
    so the pages are never broadcast, however small their input is.
    """
    pages = blocks.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("x").cast("double"))).alias("__x"), F.sort_array(F.collect_set(F.col("y").cast("double"))).alias("__y"))
    pages = pages.select(*keys, leaders(F.col("__x"), COLUMN_GAP).alias("__columns"), leaders(F.col("__y"), ROW_GAP).alias("__rows"))
    column = F.array_position(F.transform("__columns", lambda b: F.col("x") < b + COLUMN_SLACK), True).cast("int")
    row = F.size(F.filter("__rows", lambda r: r <= F.col("y"))) - 1
    own = blocks.join(pages.hint("merge"), keys).withColumn("row", row).withColumn("column", F.when(column > 0, column - 1).otherwise(F.size("__columns")))
    return own.drop("__columns", "__rows")


def coordinate_entries(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, english, subject, term, definition) of placed blocks; each column takes what it may hold, and a term without a definition is split."""
    own = placed_rows(blocks, keys).withColumn("clean", P.squeeze(F.col("text"))).where("clean <> ''")
    clean, column = F.col("clean"), F.col("column")
    own = own.withColumn("place", F.struct("x", "y", "clean"))
    cell = lambda keep: F.array_join(_in_order(clean, keep, "place"), " ")
    rows = own.groupBy(*keys, "row").agg(
        cell((column == 0) & P.is_english(clean)).alias("english"), cell((column == 1) & P.is_subject(clean)).alias("subject"),
        cell((column == 2) & has_tibetan(clean)).alias("term"), cell(column >= 3).alias("definition"),
    )
    pair = P.split_term(F.col("term"), P.COORDINATE_RULES)
    rows = rows.withColumn("p", F.when((F.col("term") != "") & (F.col("definition") == ""), pair).otherwise(F.struct("term", "definition")))
    rows = rows.select(*keys, "row", "english", "subject", P.without_english(F.col("p.term")).alias("term"), P.without_english(F.col("p.definition")).alias("definition"))
    return rows.where((P.strip(F.col("english")) != "") & (P.strip(F.col("term")) != "") & (F.length("english") >= 3))


def spelling_scores(lines: DataFrame, lexicon: DataFrame, keys: list[str], order: str = "at") -> DataFrame:
    """(keys, at, n, dict_score, standard_score, target_score, bad) for each line and, with ``at`` null, for each page.

    A syllable is bad if it breaks the rules and is not in ``lexicon`` (syllable);
    the scores are shares of all syllables, a line without any has 0 of them and no score.
    """
    from termloom.functions.spelling import breaks_rules, syllables

    own = lines.select(*keys, order, F.explode_outer(syllables(F.col("line"))).alias("syllable"))
    known = lexicon.select("syllable").distinct().withColumn("known", F.lit(1))
    own = own.join(known, "syllable", "left").withColumn("broken", breaks_rules(F.col("syllable")))
    found, bad = F.count("known"), F.count_if(F.col("broken") & F.col("known").isNull())
    n = F.count("syllable")
    whole = own.groupingSets([[*keys, order], [*keys]], *keys, order)
    return whole.agg(n.alias("n"), F.try_divide(found, n).alias("dict_score"), F.try_divide(F.count_if(~F.col("broken")), n).alias("standard_score"), F.try_divide(n - bad, n).alias("target_score"), bad.alias("bad"))
