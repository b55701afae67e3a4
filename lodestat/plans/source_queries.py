"""Queries that write files of the reference's kinds from the given tables and scan them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.plans.inputs import RUN_FIELDS, run_fields, table
from lodestat.plans.registry import query
from lodestat.sources import files
from lodestat.sources.scratch import removed_at_exit, scratch_path

LINE = "doc_id long, lang string, source string, n_chars long"


def own_path(spark, name):
    return removed_at_exit(spark, scratch_path(spark, name))


@query("json_lines_scan", "select doc_id, lang, source, n_chars::bigint as n_chars from documents")
def json_lines_scan(spark, d):
    path = own_path(spark, "lines")
    files.write_json_lines(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return files.json_lines(spark, path, LINE)


@query("checked_archive_scan", "select doc_id, lang, source, n_chars::bigint as n_chars from documents where text is not null")
def checked_archive_scan(spark, d):
    """Gzip lines whose digests are frozen when they are written and checked before they are read."""
    path = own_path(spark, "archive")
    table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "source", "n_chars").write.option("compression", "gzip").json(path)
    frozen = own_path(spark, "manifest")
    files.digests(spark, path).write.parquet(frozen)
    return files.checked_lines(spark, path, spark.read.parquet(frozen), LINE)


@query("score_sheet_scan", f"""with {RUN_FIELDS} select run::varchar as run, doc::varchar as doc, field, case when gold is not distinct from pred then 'same' else 'differs' end as verdict, (gold is not distinct from pred) <> (doc % 7 > 0) as rewritten from run_fields""")
def score_sheet_scan(spark, d):
    """Sheets with a verdict by hand, worked out anew from gold and prediction when they are read."""
    path, columns = own_path(spark, "sheet"), ["run", "doc", "field", "gold", "pred", "verdict"]
    sheet = run_fields(spark, d).withColumn("verdict", F.when(F.col("doc") % 7 > 0, "same").otherwise("differs")).select(*columns)
    sheet.write.options(nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    read = files.score_sheet(spark, path, columns).withColumns({c: F.when(F.col(c) != "\\N", F.col(c)) for c in ("gold", "pred")})
    derived = F.when(F.col("gold").eqNullSafe(F.col("pred")), "same").otherwise("differs")
    return files.rewritten_sheet(read, "verdict", derived).select("run", "doc", "field", "verdict", "rewritten")


@query("ledgered_ingestion", "select event_id, event_type from events")
def ledgered_ingestion(spark, d):
    """Events arrive in three overlapping parts; each is appended once, and only appends with keys in its range are read for that."""
    e, path = table(spark, d, "events").select("event_id", "event_type"), own_path(spark, "ingested")
    cut = e.agg(F.percentile_approx("event_id", F.array(F.lit(0.4), F.lit(0.7))).alias("at")).first()["at"] or [0, 0]
    for part in (F.col("event_id") <= cut[1], F.col("event_id") >= cut[0], F.lit(True)):
        files.append_missing(e.where(part), path, "event_id")
    out = files.appended(spark, path)
    return e.limit(0) if out is None else out
