"""Terms as a text to share: a title, a heading wherever the pair of languages changes, the terms, and how many there are.

A line's place follows from its day: days are summed first, so that no task orders
all terms.  What stands before a day's first term is the newest term of the day before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions.text import language_pair, optional_line, status_icon

NEWEST = 1000
#: fixed values: the wording and the rules of the exported texts; a glossary's own name may be given instead of the first two
NAME, WHOLE_NAME = "Glossário", "GLOSSÁRIO COMPLETO"
SHORT_RULE, LONG_RULE, HEADING_RULE, LONG_HEADING_RULE = "═══════════════════════", "═══════════════════════════", "───────────────", "───────────────────"
SHARE = "\n\n🔗 _Compartilhe este glossário com outros tradutores!_\n💡 _Para sugerir correções ou novos termos, entre em contato._"


def days_before(now: Column, days: int) -> Column:
    """The time ``days`` before ``now`` as text, as terms are compared with it."""
    return F.date_format(now - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd HH:mm:ss")


def _order() -> list[Column]:
    return [F.desc("date_added"), F.desc("id")]


def numbered_by_day(terms: DataFrame) -> DataFrame:
    """``terms`` with ``position`` (from 1, newest first) and ``before``, the pair of languages of the term before."""
    own = terms.withColumn("__pair", language_pair(F.col("source_language"), F.col("target_language"))).withColumn("__day", F.to_date("date_added"))
    oldest = F.min_by("__pair", F.struct("date_added", "id"))
    days = own.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"), oldest.alias("__oldest"))
    later = W.orderBy(F.desc("__day"))  # a row for each day
    days = days.select("__day", F.coalesce(F.sum("__n").over(later.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.lag("__oldest").over(later).alias("__above"))
    day = W.partitionBy("__day").orderBy(*_order())
    own = own.withColumn("__rank", F.row_number().over(day)).withColumn("__own", F.lag("__pair").over(day))
    joined = own.join(days, own["__day"].eqNullSafe(days["__day"])).withColumn("position", (F.col("__first") + F.col("__rank")).cast("long"))
    return joined.withColumn("before", F.coalesce("__own", "__above")).select(*terms.columns, "position", "before")


def _heading(rule: str) -> Column:
    pair = language_pair(F.col("source_language"), F.col("target_language"))
    text = F.concat(F.when(F.col("before").isNotNull(), "\n").otherwise(""), F.lit("🌍 *"), F.upper(pair), F.lit(f"*\n{rule}\n"))
    return F.when(~pair.eqNullSafe(F.col("before")), text).otherwise("")


def export_lines(terms: DataFrame) -> DataFrame:
    """(position, line) of terms, newest first, with headings."""
    body = F.concat(_heading(HEADING_RULE), F.lit("• **"), F.col("source_term"), F.lit("**\n  ➜ "), F.col("target_term"), F.lit("\n"), optional_line("  📝 _", F.col("context"), "_\n"), optional_line("  👤 ", F.col("contributor")), F.lit("\n"))
    return numbered_by_day(terms).select("position", body.alias("line"))


def _document(lines: DataFrame, title: str, rule: str, made: str, noun: str, none: str, gap: str = "") -> DataFrame:
    """The lines with what stands before (position 0) and after them; ``none`` alone if there are none."""
    n = lines.agg(F.count(F.lit(1)).alias("n"))  # one row
    head = F.when(F.col("n") > 0, f"{title}\n{rule}\n\n").otherwise(none)
    foot = F.concat(F.lit(f"{gap}{rule}\n📊 Total: "), F.col("n").cast("string"), F.lit(f" {noun}\n🕐 Gerado em: "), F.date_format(F.lit(made).cast("timestamp"), "dd/MM/yyyy HH:mm"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("position"), head.alias("line")), F.struct((F.col("n") + 1).alias("position"), F.when(F.col("n") > 0, foot).alias("line")))).alias("e")).select("e.position", "e.line")
    return lines.unionByName(ends.where("line is not null"))


def as_text(document: DataFrame) -> str:
    """A document as one text, for a screen or a file."""
    return "".join(r["line"] for r in document.orderBy("position").toLocalIterator())


def shared(text: Column) -> Column:
    return F.concat(text, F.lit(SHARE))


def export_recent(terms: DataFrame, cutoff: str) -> DataFrame:
    """(position, line) of the terms added after a time, without title and totals."""
    return export_lines(terms.where(F.col("date_added") > F.lit(cutoff).cast("timestamp")))


def _title(name: str) -> str:
    return f"📚 *{name}*"


def recent_document(terms: DataFrame, now: str, days: int = 7, name: str = NAME) -> DataFrame:
    """(position, line) of the terms added in the last days, with title and totals."""
    cutoff = days_before(F.lit(now).cast("timestamp"), days).cast("timestamp")
    none = f"{_title(name)} - Nenhum termo novo nos últimos {days} dias"
    return _document(export_lines(terms.where(F.col("date_added") > cutoff)), f"{_title(name)}\n🗓️ Novos termos dos últimos {days} dias", SHORT_RULE, now, "novos termos", none)


def newest(terms: DataFrame) -> DataFrame:
    return terms.orderBy(*_order()).limit(NEWEST)


def whole_document(terms: DataFrame, now: str, name: str = WHOLE_NAME) -> DataFrame:
    """(position, line) of the newest NEWEST terms with their states."""
    body = F.concat(_heading(LONG_HEADING_RULE), F.lit("• **"), F.col("source_term"), F.lit("** → "), F.col("target_term"), F.lit(" "), status_icon(F.col("verified_status")), F.lit("\n"), optional_line("  📝 _", F.col("context"), "_\n"))
    lines = numbered_by_day(newest(terms)).select("position", body.alias("line"))
    return _document(lines, _title(name), LONG_RULE, now, "termos", f"{_title(name)} - Nenhum termo no banco de dados", "\n")


def _by_contributor(terms: DataFrame, name: str) -> DataFrame:
    return newest(terms).where(F.col("contributor") == name)


def export_by_contributor(terms: DataFrame, name: str) -> DataFrame:
    """(position, line): of the newest NEWEST terms those of one contributor; the limit comes first."""
    return export_lines(_by_contributor(terms, name))


def contributor_document(terms: DataFrame, contributor: str, now: str, name: str = NAME) -> DataFrame:
    """As ``export_by_contributor``, with dates instead of headings, and with title and totals."""
    body = F.concat(F.lit("• **"), F.col("source_term"), F.lit("**\n  ➜ "), F.col("target_term"), F.lit("\n"), optional_line("  📝 _", F.col("context"), "_\n"), F.lit("  📅 "), F.date_format("date_added", "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    lines = numbered_by_day(_by_contributor(terms, contributor)).select("position", body.alias("line"))
    return _document(lines, f"{_title(name)}\n👤 Contribuições de: {contributor}", SHORT_RULE, now, "termos", f"{_title(name)} - Nenhum termo encontrado para {contributor}")


def detail_view() -> Column:
    """All that is known of a term; lines without a value are left out."""
    c = F.col
    return F.concat(
        F.lit("🔤 Termo Original: "), c("source_term"), F.lit("\n🌍 Idioma Original: "), c("source_language"), F.lit("\n\n📝 Tradução: "), c("target_term"), F.lit("\n🌍 Idioma Tradução: "), c("target_language"), F.lit("\n\n"),
        optional_line("📖 Contexto: ", c("context"), "\n\n"), optional_line("👤 Contribuidor: ", c("contributor")), F.lit("📅 Data: "), F.date_format("date_added", "yyyy-MM-dd HH:mm:ss"), F.lit("\n✓ Status: "), F.coalesce("verified_status", F.lit("null")), F.lit("\n"),
        optional_line("📌 Notas: ", c("notes")),
    )
