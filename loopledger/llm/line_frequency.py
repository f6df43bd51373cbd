"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

For every host, the pages that contain a line are divided by all pages of the host; lines on more
than a given share of the pages, and on a least number of them, are dropped.  The share falls with
the length of a line: it is RATIO at ten words and RATIO * 10 / words in general, as a short line
recurs by chance and a long passage does not.

Copied pages are not boilerplate.  A page is copied if lines over the share hold more than COPIED of
its words; such pages keep their text, and a line must be over the share on the other pages alone.

Lines are counted by (host, 128-bit digest), with partial sums before the shuffle, so neither a
host with a third of all pages nor a line on every page gathers in one task.  A host keeps only
the digests over the ratio: at most its mean number of words a page divided by ten times the ratio.
These short lists are written and counted.  Up to BROADCAST_DIGESTS they are sent to the pages, which
do not move; beyond, pages meet them in a join on host and a salt, so a large host still spreads.

Defined cases: lines end at a line feed; blank lines are never dropped; a line that repeats on a
page counts once there but goes everywhere; a page that would lose every line that is not blank
is a copied page and stays as it is; words are counted by blanks; a null text has no lines and stays
null; a null host is a host of its own; repeated rows are pages each; a very long text has more lines;
an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopledger.llm.shared import workspace, written

RATIO = 0.01
LEAST_PAGES = 5
#: Share of a page's words from which on lines over the ratio make it a copy.
COPIED = 0.8
#: Digests of 16 bytes that may be broadcast, and the tasks a host spreads over when there are more.
BROADCAST_DIGESTS = 200_000
SALTS = 64


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def _is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def _over(lines: DataFrame, totals: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, digests) of (host, line) and (host, pages), one row for every page with the line; line: digest and words."""
    counts = lines.groupBy("host", "line.digest").agg(F.count(F.lit(1)).alias("with_line"), F.first("line.words").alias("words"))
    over = counts.where(F.col("with_line") >= least).join(totals, "host").where(
        F.col("with_line") * F.col("words") > F.lit(10 * ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.array_sort(F.collect_list("digest")).alias("digests"))


def _meet(rows: DataFrame, found: DataFrame, broadcast: int) -> DataFrame:
    """rows with the digests of their host, null if it has none."""
    if (found.agg(F.sum(F.size("digests"))).first()[0] or 0) <= broadcast:
        return rows.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["host", "salt"], "left").drop("salt")


def _share(lines: Column, digests: Column) -> Column:
    """Share of a page's words in lines with one of the digests."""
    def words(kept: Column) -> Column:
        return F.aggregate(kept, F.lit(0), lambda n, x: n + _words(x))

    full = F.filter(lines, lambda x: ~_is_blank(x))
    return F.try_divide(words(F.filter(full, lambda x: F.array_contains(digests, _digest(x)))), words(full))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST_PAGES,
                broadcast: int = BROADCAST_DIGESTS) -> tuple[DataFrame, DataFrame]:
    """(host, digests) of the lines over the ratio on all pages, and of those over it on pages that are not copied."""
    folder = workspace(pages.sparkSession, "boilerplate")
    rows = pages.select(_host(host).alias("host"), _lines(F.col(text)).alias("lines"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))

    def own(keep) -> Column:
        full = F.filter("lines", lambda x: ~_is_blank(x) & keep(x))
        return F.explode(F.array_distinct(F.transform(full, lambda x: F.struct(_digest(x).alias("digest"), _words(x).alias("words")))))

    first = written(_over(rows.select("host", own(lambda x: F.lit(True)).alias("line")), totals, ratio, least), f"{folder}/first")
    met = _meet(rows, first, broadcast).where("digests IS NOT NULL")
    others = met.where(_share(F.col("lines"), F.col("digests")) <= COPIED)
    again = others.select("host", own(lambda x: F.array_contains(F.col("digests"), _digest(x))).alias("line"))
    return first, written(_over(again, totals, ratio, least), f"{folder}/second")


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES,
    broadcast: int = BROADCAST_DIGESTS,
) -> DataFrame:
    """pages with the cleaned text, and n_lines and n_dropped; columns of these names are replaced."""
    first, second = boilerplate(pages, host, text, ratio, least, broadcast)
    both = first.join(second.withColumnRenamed("digests", "dropped"), "host").select(
        "host", F.struct("digests", "dropped").alias("found"), "digests")
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _host(host).alias("host"))
    lines = _lines(F.col(f"row.`{text}`"))
    kept = F.filter("lines", lambda x: _is_blank(x) | ~F.array_contains(F.col("found.dropped"), _digest(x)))
    met = _meet(row, both, broadcast).select("row", lines.alias("lines"), "found")
    copied = _share(F.col("lines"), F.col("found.digests")) > COPIED
    chosen = met.select("row", "lines", F.when(F.col("found").isNull() | copied, F.col("lines")).otherwise(kept).alias("kept"))
    dropped = F.coalesce(F.size("lines") - F.size("kept"), F.lit(0))
    return chosen.select(
        *[F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text
          else F.col(f"row.`{c}`").alias(c) for c in names],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("int").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(dropped).cast("int").alias("n_dropped"),
    )


#: The same in SQL over a relation {docs}, for the columns of documents.
SQL = """
WITH pages_ AS (SELECT row_number() OVER () AS row_, * FROM {docs}),
lines_ AS (SELECT row_, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS at_
           FROM pages_ WHERE text IS NOT NULL),
full_ AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM lines_ WHERE trim(line) <> ''),
totals AS (SELECT source, count(*) AS pages FROM pages_ GROUP BY source),
over_ AS (SELECT l.source, l.line FROM (SELECT DISTINCT row_, source, line, words FROM full_) l
          JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
          GROUP BY l.source, l.line, l.words, t.pages
          HAVING count(*) >= {least} AND count(*) * l.words > CAST(10 * {ratio} AS DOUBLE) * t.pages),
copied AS (SELECT f.row_ FROM full_ f LEFT JOIN over_ o ON f.source IS NOT DISTINCT FROM o.source AND f.line = o.line
           GROUP BY f.row_ HAVING coalesce(sum(f.words) FILTER (o.line IS NOT NULL), 0) / sum(f.words) > {copied}),
over2 AS (SELECT l.source, l.line FROM (
            SELECT DISTINCT f.row_, f.source, f.line, f.words FROM full_ f JOIN over_ o
            ON f.source IS NOT DISTINCT FROM o.source AND f.line = o.line WHERE f.row_ NOT IN (SELECT row_ FROM copied)) l
          JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
          GROUP BY l.source, l.line, l.words, t.pages
          HAVING count(*) >= {least} AND count(*) * l.words > CAST(10 * {ratio} AS DOUBLE) * t.pages),
marked AS (SELECT l.row_, l.at_, l.line, o.line IS NOT NULL AND c.row_ IS NULL AND trim(l.line) <> '' AS drop_
           FROM lines_ l LEFT JOIN over2 o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line
           LEFT JOIN copied c ON c.row_ = l.row_),
pages2 AS (SELECT row_, count(*) AS n_lines, count(*) FILTER (drop_) AS n_drop,
                  string_agg(line, chr(10) ORDER BY at_) FILTER (NOT drop_) AS left_
           FROM marked GROUP BY row_),
cleaned AS (SELECT p.doc_id, CASE WHEN n_drop > 0 THEN left_ ELSE p.text END AS text,
                   p.lang, p.source, p.n_chars, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
                   CAST(coalesce(n_drop, 0) AS INTEGER) AS n_dropped
            FROM pages_ p LEFT JOIN pages2 USING (row_))
"""
